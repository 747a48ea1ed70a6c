"""Contradictions between answers and their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerlens.functions.text import severity, topic_tokens
from answerlens.functions.text_udf import claims, polarity, sentences

DAYS, RELATIVE, POINTS = 1, 0.2, 5.0
MOST = 20


def _answer_sentences(answers: DataFrame) -> DataFrame:
    each = answers.select("trace_id", F.posexplode(sentences(F.col("answer"))).alias("idx", "s"))
    return each.select("trace_id", "idx", F.col("s.text").alias("sentence"))


def _source_sentences(context: DataFrame) -> DataFrame:
    each = context.select("trace_id", "rank", "chunk_id", F.posexplode(sentences(F.col("text"))).alias("sidx", "s"))
    return each.select("trace_id", "rank", "chunk_id", "sidx", F.col("s.text").alias("sentence"))


def _claims(rows: DataFrame, prefix: str) -> DataFrame:
    """P13 with P12: each claim with the topic tokens of its sentence, its own words blanked."""
    each = rows.select("*", F.posexplode(claims(F.col("sentence"))).alias("cidx", "c"))
    blank = F.concat(F.substring("sentence", F.lit(1), F.col("c.start")), F.lit(" "), F.substring("sentence", F.col("c.end") + 1, F.length("sentence")))
    keep = [c for c in rows.columns if c not in ("trace_id", "sentence")]
    return each.select("trace_id", F.col("c.family").alias("family"), F.col("c.kind").alias("kind"), *[F.col(c).alias(f"{prefix}_{c}") for c in keep], F.col("cidx").alias(f"{prefix}_cidx"), F.col("sentence").alias(f"{prefix}_sentence"), F.col("c.value").alias(f"{prefix}_value"), F.col("c.raw").alias(f"{prefix}_raw"), topic_tokens(blank).alias(f"{prefix}_topics"))


def consistent(kind: Column, a: Column, s: Column) -> Column:
    delta = F.abs(a - s)
    relative = F.when(F.greatest(F.abs(a), F.abs(s)) == 0, 0.0).otherwise(delta / F.greatest(F.abs(a), F.abs(s)))
    return F.when(kind == "date", delta <= DAYS).when((kind == "percent") & (delta >= POINTS), False).otherwise((delta <= 0) | (relative <= RELATIVE))


def numeric(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Claims that no source of the same family and topic confirms, with the closest source."""
    a = _claims(_answer_sentences(answers), "a")
    s = _claims(_source_sentences(context), "s").drop("kind")
    pairs = a.join(s, ["trace_id", "family"]).where(F.arrays_overlap("a_topics", "s_topics"))
    delta = F.abs(F.col("a_value") - F.col("s_value"))
    relative = F.when(F.greatest(F.abs("a_value"), F.abs("s_value")) == 0, 0.0).otherwise(delta / F.greatest(F.abs("a_value"), F.abs("s_value")))
    pairs = pairs.withColumn("delta", delta).withColumn("relative", F.bround(relative, 4)).withColumn("same", consistent(F.col("kind"), F.col("a_value"), F.col("s_value")))
    nearest = F.struct("delta", "s_rank", "s_sidx", "s_cidx", "relative", "s_chunk_id", "s_raw", "s_value", "s_sentence")
    g = pairs.groupBy("trace_id", "a_idx", "a_cidx", "kind", "a_sentence", "a_value", "a_raw").agg(F.max("same").alias("ok"), F.min(nearest).alias("n"))
    return g.where("NOT ok").select("trace_id", F.col("a_idx").alias("idx"), F.col("a_sentence").alias("sentence"), "kind", F.col("n.s_chunk_id").alias("chunk_id"), F.col("a_raw").alias("answer_value"), F.col("n.s_raw").alias("source_value"), F.col("n.delta").alias("delta"), F.col("n.relative").alias("relative"), severity(F.col("kind"), F.col("n.delta"), F.col("n.relative")).alias("severity"))


def opposite(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Sentences of one topic that hold a concept the other way round."""
    each = lambda rows, p: rows.select("*", F.explode(polarity(F.col("sentence"))).alias("p"), topic_tokens(F.col("sentence")).alias("topics")).select("trace_id", F.col("p.concept").alias("concept"), *[F.col(c).alias(f"{p}_{c}") for c in rows.columns if c != "trace_id"], F.col("p.polarity").alias(f"{p}_polarity"), F.col("p.phrase").alias(f"{p}_phrase"), F.col("topics").alias(f"{p}_topics"))
    a, s = each(_answer_sentences(answers), "a"), each(_source_sentences(context), "s")
    j = a.join(s, ["trace_id", "concept"]).where((F.col("a_polarity") != F.col("s_polarity")) & F.arrays_overlap("a_topics", "s_topics"))
    first = j.groupBy("trace_id", "a_idx", "a_sentence", "concept", "a_phrase").agg(F.min(F.struct("s_rank", "s_sidx", "s_chunk_id", "s_phrase")).alias("n"))
    return first.select("trace_id", F.col("a_idx").alias("idx"), F.col("a_sentence").alias("sentence"), F.concat(F.lit("polarity:"), F.col("concept")).alias("kind"), F.col("n.s_chunk_id").alias("chunk_id"), F.col("a_phrase").alias("answer_value"), F.col("n.s_phrase").alias("source_value"), F.lit(1.0).alias("delta"), F.lit(1.0).alias("relative"), F.lit("high").alias("severity"))


def detect(answers: DataFrame, context: DataFrame, most: int = MOST) -> DataFrame:
    """G7 + T5: both kinds, one row for each value pair of a sentence and chunk, the worst first, at most 20 a trace."""
    both = numeric(answers, context).unionByName(opposite(answers, context))
    key = ["trace_id", "sentence", "chunk_id", "kind", "answer_value", "source_value"]
    w = Window.partitionBy(*key).orderBy("idx", "delta")
    one = both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    order = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    worst = Window.partitionBy("trace_id").orderBy(order, F.desc("relative"), "idx", "kind", "answer_value", "chunk_id", "source_value")
    return one.withColumn("place", F.row_number().over(worst)).where(F.col("place") <= most)


def attach(sentence_rows: DataFrame, found: DataFrame) -> DataFrame:
    """Sentences with their contradictions, by exact text."""
    g = found.groupBy("trace_id", "sentence").agg(F.array_sort(F.collect_list(F.struct("place", "kind", "chunk_id", "severity"))).alias("contradictions"))
    return sentence_rows.join(g, ["trace_id", "sentence"], "left").withColumn("has_contradiction", F.col("contradictions").isNotNull())
