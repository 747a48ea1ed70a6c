"""Metric credits, overall scores, gates and summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerlens.functions.text import long_tokens
from answerlens.operators.scope import refusal

PASS_CREDIT = 0.7


@dataclass(frozen=True)
class Metric:
    """direction: higher, lower, bool or band; a band has two targets."""

    name: str
    direction: str
    group: str
    weight: float
    target: float | None = None
    low: float | None = None
    high: float | None = None


#: The rubric; rows can be added or replaced.
RUBRIC = (
    Metric("retrieval_score_avg", "higher", "retrieval", 0.10, 0.5),
    Metric("retrieval_score_std", "lower", "retrieval", 0.05, 0.3),
    Metric("answer_coverage_ratio", "higher", "grounding", 0.15, 0.5),
    Metric("citation_coverage", "higher", "grounding", 0.15, 0.6),
    Metric("hallucination_rate", "lower", "grounding", 0.15, 0.2),
    Metric("faithfulness", "higher", "semantic", 0.10, 0.6),
    Metric("relevance", "higher", "semantic", 0.10, 0.5),
    Metric("rejection_accuracy", "higher", "behaviour", 0.05, 1.0),
    Metric("empty_response", "bool", "behaviour", 0.05, 1.0),
    Metric("response_length", "band", "behaviour", 0.10, None, 50, 2000),
)


def rubric_table(spark, rubric: tuple[Metric, ...] = RUBRIC) -> DataFrame:
    rows = [(m.name, m.direction, m.group, m.weight, m.target, None if m.low is None else float(m.low), None if m.high is None else float(m.high)) for m in rubric]
    return spark.createDataFrame(rows, "metric string, direction string, grp string, weight double, target double, target_min double, target_max double")


def credit(v: Column, direction: Column, t: Column, low: Column, high: Column) -> Column:
    """The pass line earns 0.7, beyond it linearly up to 1, below it in proportion."""
    higher = F.when(t <= 0, 1.0).when(v >= t, F.when(t >= 1, 1.0).otherwise(PASS_CREDIT + (1 - PASS_CREDIT) * (v - t) / (1 - t))).otherwise(PASS_CREDIT * v / t)
    lower = F.when(t <= 0, 1.0).when(v <= t, PASS_CREDIT + (1 - PASS_CREDIT) * (1 - v / t)).otherwise(F.greatest(F.lit(0.0), PASS_CREDIT * (1 - (v / t - 1))))
    far = F.greatest(low - v, v - high)
    band = F.when(far <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), PASS_CREDIT * (1 - far / F.greatest(high - low, F.lit(1e-9)))))
    raw = F.when(direction == "higher", higher).when(direction == "lower", lower).when(direction == "band", band).otherwise(F.when(v >= 1, 1.0).otherwise(0.0))
    return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def passed(v: Column, direction: Column, t: Column, low: Column, high: Column) -> Column:
    return F.when(direction == "higher", v >= t).when(direction == "lower", v <= t).when(direction == "band", (v >= low) & (v <= high)).otherwise(v >= 1)


def judge(values: DataFrame, rubric: DataFrame) -> DataFrame:
    """values(trace_id, metric, value, error) -> with credit and is_pass; an error earns 0, a null value nothing at all."""
    cols = [F.col(c) for c in ("value", "direction", "target", "target_min", "target_max")]
    out = values.join(F.broadcast(rubric), "metric")  # one row a metric
    return out.withColumn("credit", F.when(F.col("error").isNotNull(), 0.0).otherwise(credit(*cols))).withColumn("is_pass", F.when(F.col("error").isNotNull(), False).otherwise(passed(*cols)))


def overall(judged: DataFrame, total_weight: float = 1.0) -> DataFrame:
    """Weighted mean of the credits that could be measured, and the weight they cover."""
    ok = F.col("credit").isNotNull()
    w = F.sum(F.when(ok, F.col("weight")))
    return judged.groupBy("trace_id").agg(F.round(F.sum(F.col("weight") * F.col("credit")) / w, 4).alias("raw_score"), F.round(w / total_weight, 4).alias("weight_coverage"))


def contributions(judged: DataFrame) -> DataFrame:
    """What each metric adds to its trace's score."""
    w = F.sum(F.when(F.col("credit").isNotNull(), F.col("weight"))).over(Window.partitionBy("trace_id"))
    return judged.withColumn("contribution", F.round(F.col("weight") * F.col("credit") / w, 9))


def gates(judged: DataFrame, scored: DataFrame, context: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A10: context(trace_id, context_count, mean_score, boundary_confidence) -> adjusted score, gates that failed, verdict."""
    needed = judged.where(F.col("metric").isin("empty_response", "hallucination_rate")).groupBy("trace_id").pivot("metric", ["empty_response", "hallucination_rate"]).agg(F.first("is_pass"))
    out = scored.join(needed, "trace_id", "left").join(context, "trace_id", "left")
    score = F.when(F.coalesce("context_count", F.lit(0)) == 0, 0.0).otherwise(F.col("raw_score"))
    score = F.when(F.col("mean_score") < threshold * 0.3, F.least(score, F.lit(0.3))).otherwise(score)
    score = F.when(F.col("boundary_confidence") < 0.5, score * F.greatest(F.lit(0.5), F.col("boundary_confidence"))).otherwise(score)
    out = out.withColumn("overall_score", F.round(score, 6))
    checks = [
        ("retrieved_context", F.coalesce("context_count", F.lit(0)) > 0),
        ("overall_score", F.col("overall_score") >= 0.7),
        ("weight_coverage", F.col("weight_coverage") >= 0.6),
        ("empty_response", F.coalesce("empty_response", F.lit(False))),
        ("hallucination_rate", F.coalesce("hallucination_rate", F.lit(False))),
    ]
    failures = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in checks]))
    return out.withColumn("gate_failures", failures).withColumn("is_passing", F.size("gate_failures") == 0)


def retrieval_stats(context: DataFrame) -> DataFrame:
    """A2: mean (0 without context is left to the join) and population deviation, null below two chunks."""
    return context.groupBy("trace_id").agg(F.round(F.avg("score"), 6).alias("score_avg"), F.when(F.count(F.lit(1)) >= 2, F.round(F.stddev_pop("score"), 6)).alias("score_std"))


def coverage_ratio(answer: Column, context: Column) -> Column:
    """A3: share of the answer's distinct tokens that the context has; null without tokens."""
    a = long_tokens(answer)
    return F.when(F.size(a) > 0, F.round(F.size(F.array_intersect(a, long_tokens(context))) / F.size(a), 6))


def behaviour(answers: DataFrame, phrases: tuple[str, ...]) -> DataFrame:
    """Rejection accuracy (out of scope only), whether there is an answer, its length."""
    refused = refusal(F.col("answer"), phrases)
    return answers.withColumns({
        "rejection_accuracy": F.when(~F.col("in_scope"), refused.cast("double")),
        "empty_response": F.when(F.trim("answer") == "", 0.0).otherwise(1.0),
        "response_length": F.length("answer").cast("double"),
    })


def summary(evaluations: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Totals (means with and without zero scores) and per metric mean, extremes and pass rate."""
    s = F.col("overall_score")
    totals = evaluations.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_passing").alias("passing"), F.round(F.avg(s), 4).alias("mean_all"), F.round(F.avg(F.when(s != 0, s)), 4).alias("mean_nonzero"))
    per = judged.groupBy("metric").agg(F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg(F.coalesce(F.col("is_pass"), F.lit(False)).cast("int")), 4).alias("pass_rate"))
    return totals, per


def nearest_rank(values: DataFrame, group: str, column: str, shares: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Nearest-rank percentiles at index round(q (n-1)), half to even, by a window rather than by collected lists."""
    w = Window.partitionBy(group)
    placed = values.where(F.col(column).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(column)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    at = [F.max(F.when(F.col("_i") == F.bround(F.lit(q) * (F.col("_n") - 1), 0), F.col(column))).alias(f"p{int(q * 100)}") for q in shares]
    return placed.groupBy(group).agg(*at, F.round(F.avg((F.col(column) >= 0.9).cast("int")), 4).alias("share_high"), F.round(F.avg(column), 4).alias("mean"))
