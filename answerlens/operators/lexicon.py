"""Synonyms and query rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerlens.functions.text import key_terms, keywords, tokens


def from_mapping(spark: SparkSession, mapping: dict) -> DataFrame:
    """Term -> list of synonyms or one; repeated values keep the first place."""
    rows = [(k, list(dict.fromkeys(v if isinstance(v, list) else [v]))) for k, v in mapping.items()]
    return spark.createDataFrame(rows, "term string, synonyms array<string>")


def table(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("term").agg(F.array_sort(F.collect_set("synonym")).alias("synonyms"))


def add(pairs: DataFrame, more: DataFrame) -> DataFrame:
    """Union of pairs (term, synonym)."""
    return pairs.unionByName(more).distinct()


def remove(pairs: DataFrame, gone: DataFrame, whole_terms: bool = False) -> DataFrame:
    """Without single values, or without whole terms; the rest as a table."""
    return table(pairs.join(gone, ["term"] if whole_terms else ["term", "synonym"], "left_anti"))


def expand(queries: DataFrame, synonyms: DataFrame, most: int = 2, terms=tokens) -> DataFrame:
    """Each term of a query followed by its first synonyms."""
    each = queries.select("query_id", F.posexplode(terms(F.col("query"))).alias("pos", "term"))
    small = synonyms.limit(100_001).count() <= 100_000
    joined = each.join(F.broadcast(synonyms) if small else synonyms, "term", "left")
    both = F.when(F.col("synonyms").isNull(), F.array("term")).otherwise(F.concat(F.array("term"), F.slice("synonyms", 1, most)))
    packed = joined.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", both.alias("t")))).alias("p"))
    return packed.select("query_id", F.flatten(F.transform("p", lambda x: x["t"])).alias("terms"))


def rewrite(queries: DataFrame, synonyms: DataFrame, correct=None) -> DataFrame:
    """P10: typos corrected, key terms expanded; unchanged queries stay; with the reason."""
    fixed = queries.withColumn("corrected", correct(F.col("query"))["corrected"] if correct else F.col("query"))
    expanded = expand(fixed.select("query_id", F.col("corrected").alias("query")), synonyms, terms=key_terms)
    out = fixed.join(expanded, "query_id", "left")
    joined = F.when(F.size("terms") > 0, F.array_join("terms", " ")).otherwise(F.col("corrected"))
    out = out.withColumn("_new", F.coalesce(joined, F.col("corrected")))
    typo = F.col("corrected") != F.col("query")
    changed = typo | (F.col("_new") != F.lower("query"))
    reason = F.when(typo, "typo_corrected").when(changed, "expanded").otherwise("unchanged")
    return out.withColumn("rewritten", F.when(changed, F.col("_new")).otherwise(F.col("query"))).withColumn("reason", reason).drop("_new")


def suggestions(summaries: DataFrame, most: int = 5) -> DataFrame:
    """P25: questions from the first two long terms of a summary, then a fixed one."""
    first = F.slice(keywords(F.col("summary")), 1, 2)
    asked = F.concat(F.transform(first, lambda w: F.concat(F.lit("What is "), w, F.lit("?"))), F.transform(first, lambda w: F.concat(F.lit("How does "), w, F.lit(" work?"))), F.array(F.lit("What does this collection cover?")))
    return summaries.withColumn("suggestions", F.slice(asked, 1, most))
