"""Comparison of retrieval settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_VARIANTS = 100


def by_name() -> Window:
    return Window.partitionBy("query_id").orderBy("variant_name")


def grid(queries: DataFrame, variants: DataFrame) -> DataFrame:
    """Every query under every variant; variants are a handful by definition, which is checked."""
    if variants.limit(MOST_VARIANTS + 1).count() > MOST_VARIANTS:
        raise ValueError(f"more than {MOST_VARIANTS} variants")
    return queries.crossJoin(F.broadcast(variants))


def by_variant(runs: DataFrame) -> DataFrame:
    """Means by variant."""
    s = F.col("overall_score")
    return runs.groupBy("variant_name").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(s), 4).alias("mean_score"), F.round(F.avg("context_count"), 1).alias("mean_context"), F.round(F.avg("drift_rate"), 4).alias("mean_drift"), F.round(F.min(s), 4).alias("min_score"), F.round(F.max(s), 4).alias("max_score"))


def winners(runs: DataFrame) -> DataFrame:
    """runs(query_id, pos, ...) -> the first variant that is best by score, recall and drift (below 1), and whether scores compare."""
    first = -F.col("pos")
    return runs.groupBy("query_id").agg(
        F.max_by("variant_name", F.struct("overall_score", first)).alias("by_score"),
        F.max_by("variant_name", F.struct("context_count", first)).alias("by_recall"),
        F.min_by("variant_name", F.when(F.col("drift_rate") < 1.0, F.struct("drift_rate", "pos"))).alias("by_drift"),
        (F.count_distinct("rubric_version", "scenario_id") <= 1).alias("comparable"),
    )


def differences(runs: DataFrame) -> DataFrame:
    """Pairs of variants of one query, in order."""
    cols = ["query_id", "variant_name", "pos", "answer_length", "context_count", "overall_score", "drift_rate"]
    a, b = runs.select(*cols).alias("a"), runs.select(*cols).alias("b")
    d = lambda c: F.col(f"b.{c}") - F.col(f"a.{c}")
    return a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.pos") < F.col("b.pos"))).select("a.query_id", F.col("a.variant_name").alias("first"), F.col("b.variant_name").alias("second"), d("answer_length").alias("d_length"), d("context_count").alias("d_context"), F.round(d("overall_score"), 6).alias("d_score"), F.round(d("drift_rate"), 6).alias("d_drift"))
