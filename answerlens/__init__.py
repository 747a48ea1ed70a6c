"""answerlens: retrieval, diagnosis and evaluation of question answering as Spark jobs."""
