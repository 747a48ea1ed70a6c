"""Whole evaluations, A/B runs and regression sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from answerlens.functions.text import hashed_vector
from answerlens.functions.text_udf import find_claims, sentence_spans
from answerlens.operators import evaluate as E
from answerlens.operators import abtest, retrieve, trace
from answerlens.operators.index import Index
from answerlens.session import kept

REFUSALS = ("cannot answer", "do not know", "no information")
EXTRA: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def register_metric(name: str, compute: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """compute(answers, context) -> trace_id, value; the rubric table given to ``evaluate`` needs a row for it."""
    EXTRA[name] = compute


def metric_rows(answers: DataFrame, context: DataFrame, embedder=hashed_vector, refusals: tuple[str, ...] = REFUSALS) -> DataFrame:
    """answers(trace_id, query, answer, in_scope), context(trace_id, rank, chunk_id, text, score) -> trace_id, metric, value, error."""
    spans = kept(trace.spans(answers))
    joined = context.groupBy("trace_id").agg(F.array_join(F.collect_list("text"), "\n").alias("joined"))
    covered = answers.join(joined, "trace_id", "left").select("trace_id", E.coverage_ratio(F.col("answer"), F.coalesce("joined", F.lit(""))).alias("answer_coverage_ratio"))
    stats = E.retrieval_stats(context).withColumnsRenamed({"score_avg": "retrieval_score_avg", "score_std": "retrieval_score_std"})
    far = trace.hallucination(spans, context, embedder)
    out = answers.select("trace_id")

    def long(df: DataFrame, *names: str) -> DataFrame:
        error = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
        each = df.select("trace_id", error.alias("error"), F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m"))
        return each.select("trace_id", "m.metric", "m.value", "error")

    rows = long(out.join(stats, "trace_id", "left").fillna(0.0, ["retrieval_score_avg"]), "retrieval_score_avg", "retrieval_score_std")
    for df, names in (
        (covered, ("answer_coverage_ratio",)),
        (trace.citation_coverage(spans, context), ("citation_coverage",)),
        (far, ("hallucination_rate",)),
        (trace.semantic(answers, context, embedder), ("faithfulness", "relevance")),
        (E.behaviour(answers, refusals), ("rejection_accuracy", "empty_response", "response_length")),
    ):
        rows = rows.unionByName(long(df, *names))
    for name, compute in EXTRA.items():
        rows = rows.unionByName(long(compute(answers, context).withColumnRenamed("value", name), name))
    return rows


def evaluate(answers: DataFrame, context: DataFrame, rubric: DataFrame, embedder=hashed_vector) -> tuple[DataFrame, DataFrame]:
    """(judged metric rows, evaluations); answers also carry boundary_confidence."""
    judged = kept(E.judge(metric_rows(answers, context, embedder), rubric))
    about = context.groupBy("trace_id").agg(F.count(F.lit(1)).alias("context_count"), F.avg("score").alias("mean_score"))
    about = answers.select("trace_id", "boundary_confidence").join(about, "trace_id", "left")
    return judged, E.gates(judged, E.overall(judged), about)


def compare(runs: DataFrame, context: DataFrame, rubric: DataFrame) -> DataFrame:
    """runs(query_id, variant_name, trace_id, query, answer, ...) -> a row for each, as A14 and J14 take them."""
    _, done = evaluate(runs, context, rubric)
    drift = trace.drift(trace.trace(runs, context)).select("trace_id", "drift_rate")
    n = context.groupBy("trace_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    out = runs.join(done.select("trace_id", "overall_score"), "trace_id").join(drift, "trace_id", "left").join(n, "trace_id", "left")
    return out.select("query_id", "variant_name", "overall_score", F.coalesce("n", F.lit(0)).alias("context_count"), F.coalesce("drift_rate", F.lit(0.0)).alias("drift_rate"), F.length("answer").alias("answer_length"))


def ab_run(queries: DataFrame, variants: DataFrame, chunks: DataFrame, index: Index, answers: DataFrame, rubric: DataFrame) -> DataFrame:
    """G9 whole: J13 -> G1 -> G6, G8: queries(query_id, kb_id, query, vec) under variants(variant_name, Params' fields), supplied answers(query_id, answer) -> a row for each pair, as A14 and J14 take them.

    Settings shape the plan, so retrieval is planned once a variant; variants are a handful, which the grid checks.
    """
    runs = abtest.grid(queries.select("query_id", "query"), variants.select("variant_name")).join(answers, "query_id")
    runs = runs.withColumns({"trace_id": F.concat_ws(":", F.col("query_id").cast("string"), "variant_name"), "in_scope": F.lit(True), "boundary_confidence": F.lit(1.0)})
    context = None
    for v in variants.collect():
        settings = {k: x for k, x in v.asDict().items() if k != "variant_name" and x is not None}
        got = retrieve.retrieve(queries, chunks, index, retrieve.Params(**settings)).where("kept")
        rows = got.select(F.concat_ws(":", F.col("query_id").cast("string"), F.lit(v["variant_name"])).alias("trace_id"), F.col("final_rank").alias("rank"), "chunk_id", F.col("compressed").alias("text"), "score")
        context = rows if context is None else context.unionByName(rows)
    return compare(kept(runs), kept(context), rubric)


def regression(golden: DataFrame, results: DataFrame) -> DataFrame:
    """golden(id, expected struct) x results(id, in_domain, status, intent_type, answer) -> id, passed and what failed."""
    j = golden.join(results, "id", "left")
    e = lambda c: F.col(f"expected.{c}")
    intent = F.contains(F.lower("intent_type"), F.lower(e("intent_type"))) | F.contains(F.lower(e("intent_type")), F.lower("intent_type"))
    checks = [("in_domain", e("in_domain").isNull() | (e("in_domain") == F.col("in_domain"))), ("status", e("status").isNull() | (e("status") == F.col("status"))), ("intent_type", e("intent_type").isNull() | intent), ("answer_contains", e("answer_contains").isNull() | F.forall(e("answer_contains"), lambda w: F.contains("answer", w)))]
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks]))
    return j.select("id", failed.alias("failed"), (F.size(failed) == 0).alias("passed"))


@udtf(returnType="text string, start int, end int, closed boolean")
class SplitSentences:
    """E5: sentences of a text, for SQL."""

    def eval(self, text: str):
        yield from sentence_spans(text or "")


@udtf(returnType="kind string, value double, raw string, start int, end int, family string")
class ExtractClaims:
    """E5: quantities of a text, for SQL."""

    def eval(self, text: str):
        for c in find_claims(text or ""):
            yield c["kind"], c["value"], c["raw"], c["start"], c["end"], c["family"]


def register_functions(spark: SparkSession) -> None:
    """E5"""
    spark.udtf.register("split_sentences", SplitSentences)
    spark.udtf.register("extract_claims", ExtractClaims)
