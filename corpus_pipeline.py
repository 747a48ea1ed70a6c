"""A training corpus in stages; each is written as Parquet and read again by the next.

Stages, in order: language ID drops what it rejects, exact dedup keeps one row of
equal texts, the n-gram join keeps one document of each group of near copies, mixing
repeats and selects documents to the sources' target weights, and BPE encoding
turns the texts into token ids.  All but the last return the columns of documents.

Defined cases: a null text or one without a letter is no known language and goes; of
repeated rows one stays until mixing, which may take a document up to twice; a null
doc_id or source is a value like any other; an empty table gives no rows; other
columns are carried along whatever their names.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.llm.bpe_automaton import encode_documents
from answerlens.llm.common import shared_dir
from answerlens.llm.exact_dedup import dedup, earlier_half, normalised, sha256
from answerlens.llm.language_id import classify, train
from answerlens.llm.mixing import mix
from answerlens.llm.ngram_join import join


def _row(docs: DataFrame) -> DataFrame:
    """docs as one struct column, so that columns set beside it cannot clash with any of theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; models learn from the labelled documents of the input."""
    models = train(docs.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang"))
    return classify(docs, models).where("NOT rejected").select("row.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: the longest before normalisation, then the smallest id; of repeated rows one."""
    kept = dedup(docs.select("doc_id", "text"), earlier_half(docs)).where("kept")
    twice = kept.groupBy("doc_id", "digest").count().where("count > 1").limit(1).count()
    keys = kept.select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest")).distinct()
    rows = _row(docs).withColumn("doc_id", F.col("row.doc_id")).withColumn("digest", sha256(normalised(F.col("row.text"))))
    rows = rows.join(keys, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")), "left_semi")
    return (rows.dropDuplicates(["doc_id", "digest"]) if twice else rows).select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the smallest id; where an id has several texts, each is a document of its own."""
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return _without_near_copies_by_text(docs)
    groups = join(docs.select("doc_id", "text"))
    kept = groups.where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    return _row(docs).join(kept, F.col("row.doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select("row.*")


def _without_near_copies_by_text(docs: DataFrame) -> DataFrame:
    """The same by id and text: their 64-bit hash stands for a document, and of a group the smallest id (then hash) stays; of equal rows one."""
    rows = _row(docs).withColumn("key", F.xxhash64("row.doc_id", "row.text")).dropDuplicates(["key"])
    groups = join(rows.select(F.col("key").alias("doc_id"), "row.text")).select(F.col("doc_id").alias("key"), "component_id")
    named = groups.join(rows.select("key", F.col("row.doc_id").alias("id")), "key")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "key"))["key"].alias("key"))
    return rows.join(first.select("key"), "key", "left_semi").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: a document appears once for each time it is taken."""
    return mix(docs).where("epochs > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("epochs")))).select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and how many."""
    ids = F.when(F.col("ids") == "", F.array().cast("array<int>")).otherwise(F.split("ids", " ").cast("array<int>"))
    return encode_documents(docs, decoded=False).select("doc_id", ids.alias("ids")).withColumn("n_tokens", F.size("ids"))


STAGES = [
    ("language ID", known_language),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing to target weights", mixed),
    ("BPE encoding", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents; what a stage leaves is written in the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
