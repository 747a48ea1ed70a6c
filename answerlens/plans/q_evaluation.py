"""Queries over evaluation and A/B comparison, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlens.operators import abtest, evaluate as E
from answerlens.plans.q_text import TOK, t

NAMES = [m.name for m in E.RUBRIC]


def metric_values(spark, d):
    """Metric values made from events: ten traces' worth of kinds, with nulls and errors in fixed places."""
    e = t(spark, d, "events")
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.pmod("event_id", F.lit(10)) + 1).cast("int"))
    value = F.when(F.pmod("event_id", F.lit(10)) == 9, F.col("value") * 30).when(F.pmod("event_id", F.lit(10)) == 8, (F.col("value") > 5).cast("double")).otherwise(F.least(F.col("value") / 50, F.lit(1.0)))
    return e.select(F.floor(F.col("event_id") / 10).cast("long").alias("trace_id"), name.alias("metric"), F.when(F.pmod("event_id", F.lit(37)) != 0, value).alias("value"), F.when(F.pmod("event_id", F.lit(41)) == 0, "embedding failed").alias("error"))


def _judged(spark, d):
    return E.judge(metric_values(spark, d), E.rubric_table(spark))


def a8_credit(spark, d):
    return _judged(spark, d).select("trace_id", "metric", F.round("credit", 9).alias("credit"), "is_pass")


def a9_overall(spark, d):
    return E.overall(_judged(spark, d))


def a9_contribution(spark, d):
    return E.contributions(_judged(spark, d)).select("trace_id", "metric", "contribution")


def _evaluated(spark, d):
    j = _judged(spark, d)
    ctx = t(spark, d, "embeddings").select(F.col("vec_id").alias("trace_id"), F.pmod("vec_id", F.lit(4)).alias("context_count"), (F.pmod("vec_id", F.lit(7)) / 10.0).alias("mean_score"), (F.pmod("vec_id", F.lit(11)) / 10.0).alias("boundary_confidence"))
    return E.gates(j, E.overall(j), ctx)


def a10_gates(spark, d):
    return _evaluated(spark, d).select("trace_id", "overall_score", "is_passing", F.array_join("gate_failures", ",").alias("gate_failures"))


def a11_summary(spark, d):
    return E.summary(_evaluated(spark, d), _judged(spark, d))[0]


def a11_metrics(spark, d):
    return E.summary(_evaluated(spark, d), _judged(spark, d))[1].select("metric", "mean", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "pass_rate")


def a12_recalibrate(spark, d):
    """Scores under two schemes of targets: the rubric's and one a tenth stricter."""
    r = E.rubric_table(spark)
    schemes = r.withColumn("scheme", F.lit("now")).unionByName(r.withColumn("target", F.col("target") * F.when(F.col("direction") == "lower", 0.9).otherwise(1.1)).withColumn("scheme", F.lit("strict")))
    j = None
    for s in ("now", "strict"):
        part = E.overall(E.judge(metric_values(spark, d), schemes.where(F.col("scheme") == s).drop("scheme"))).withColumn("scheme", F.lit(s))
        j = part if j is None else j.unionByName(part)
    return E.nearest_rank(j, "scheme", "raw_score")


def a2_retrieval_stats(spark, d):
    c = t(spark, d, "events").select(F.col("user_id").alias("trace_id"), (F.col("value") / 100).alias("score"))
    return E.retrieval_stats(c)


def a3_coverage(spark, d):
    c = t(spark, d, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    q = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    return a.join(q, ["conv_id", "turn"]).select("conv_id", "turn", E.coverage_ratio(F.col("answer"), F.col("context")).alias("ratio"))


def a7_behaviour(spark, d):
    a = t(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"), (F.pmod("conv_id", F.lit(3)) != 0).alias("in_scope"))
    return E.behaviour(a, ("the",)).select("conv_id", "turn", "rejection_accuracy", "empty_response", "response_length")


def runs(spark, d):
    """A/B rows from events: user as query, event type as variant."""
    return t(spark, d, "events").groupBy(F.col("user_id").alias("query_id"), F.col("event_type").alias("variant_name")).agg(F.round(F.avg("value") / 100, 9).alias("overall_score"), F.count(F.lit(1)).cast("int").alias("context_count"), F.round(F.min("value") / 10, 9).alias("drift_rate"), F.min("event_id").alias("answer_length")).withColumns({"rubric_version": F.lit("v2"), "scenario_id": F.lit("s")})


def a14_variants(spark, d):
    return abtest.by_variant(runs(spark, d))


def a14_winners(spark, d):
    return abtest.winners(runs(spark, d).withColumn("pos", F.dense_rank().over(abtest.by_name())))


def j13_grid(spark, d):
    q = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    v = t(spark, d, "region").select(F.col("r_name").alias("variant_name"))
    return abtest.grid(q, v)


def j14_differences(spark, d):
    r = runs(spark, d).withColumn("pos", F.dense_rank().over(abtest.by_name()))
    return abtest.differences(r)


QUERIES = {f.__name__: f for f in (a2_retrieval_stats, a3_coverage, a7_behaviour, a8_credit, a9_overall, a9_contribution, a10_gates, a11_summary, a11_metrics, a12_recalibrate, a14_variants, a14_winners, j13_grid, j14_differences)}

RUB = ", ".join(f"('{m.name}', '{m.direction}', {m.weight}::DOUBLE, {m.target if m.target is not None else 'NULL'}::DOUBLE, {m.low if m.low is not None else 'NULL'}::DOUBLE, {m.high if m.high is not None else 'NULL'}::DOUBLE)" for m in E.RUBRIC)


def judged_sql(factor: str = "1") -> str:
    return f"""r0(metric, direction, weight, t0, lo, hi) AS (VALUES {RUB}),
    r AS (SELECT metric, direction, weight, t0 * {factor} AS t, lo, hi FROM r0),
    v AS (SELECT event_id // 10 AS trace_id, {NAMES}[event_id % 10 + 1] AS metric, CASE WHEN event_id % 37 <> 0 THEN CASE WHEN event_id % 10 = 9 THEN value * 30 WHEN event_id % 10 = 8 THEN (value > 5)::INT::DOUBLE ELSE least(value / 50, 1.0) END END AS v, event_id % 41 = 0 AS err FROM events),
    c AS (SELECT v.*, r.* EXCLUDE (metric), CASE direction
        WHEN 'higher' THEN CASE WHEN t <= 0 THEN 1 WHEN v >= t THEN CASE WHEN t >= 1 THEN 1 ELSE 0.7::DOUBLE + 0.3::DOUBLE * (v - t) / (1 - t) END ELSE 0.7::DOUBLE * v / t END
        WHEN 'lower' THEN CASE WHEN t <= 0 THEN 1 WHEN v <= t THEN 0.7::DOUBLE + 0.3::DOUBLE * (1 - v / t) ELSE greatest(0, 0.7::DOUBLE * (1 - (v / t - 1))) END
        WHEN 'band' THEN CASE WHEN greatest(lo - v, v - hi) <= 0 THEN 1 ELSE greatest(0, 0.7::DOUBLE * (1 - greatest(lo - v, v - hi) / (hi - lo))) END
        ELSE CASE WHEN v >= 1 THEN 1 ELSE 0 END END AS raw,
        CASE direction WHEN 'higher' THEN v >= t WHEN 'lower' THEN v <= t WHEN 'band' THEN v >= lo AND v <= hi ELSE v >= 1 END AS ok FROM v JOIN r USING (metric)),
    j AS (SELECT trace_id, metric, weight, v AS value, CASE WHEN err THEN 0 WHEN v IS NOT NULL THEN greatest(0, least(1, raw)) END AS credit, CASE WHEN err THEN false ELSE ok END AS is_pass FROM c),
    o AS (SELECT trace_id, round(sum(weight * credit) / sum(CASE WHEN credit IS NOT NULL THEN weight END), 4) AS raw_score, round(sum(CASE WHEN credit IS NOT NULL THEN weight END), 4) AS weight_coverage FROM j GROUP BY trace_id)"""


GATED = "WITH " + judged_sql() + """,
    n AS (SELECT trace_id, bool_or(is_pass) FILTER (metric = 'empty_response') AS er, bool_or(is_pass) FILTER (metric = 'hallucination_rate') AS hr FROM j GROUP BY trace_id),
    x AS (SELECT vec_id AS trace_id, vec_id % 4 AS cc, (vec_id % 7) / 10.0::DOUBLE AS ms, (vec_id % 11) / 10.0::DOUBLE AS bc FROM embeddings),
    g AS (SELECT o.*, er, hr, coalesce(cc, 0) AS cc, ms, bc, CASE WHEN coalesce(cc, 0) = 0 THEN 0 ELSE raw_score END AS s0 FROM o LEFT JOIN n USING (trace_id) LEFT JOIN x USING (trace_id)),
    h AS (SELECT *, CASE WHEN ms < 0.5::DOUBLE * 0.3::DOUBLE THEN least(s0, 0.3) ELSE s0 END AS s1 FROM g),
    k AS (SELECT *, round(CASE WHEN bc < 0.5 THEN s1 * greatest(0.5, bc) ELSE s1 END, 6) AS overall_score FROM h),
    e AS (SELECT *, list_filter([CASE WHEN cc = 0 THEN 'retrieved_context' END, CASE WHEN overall_score < 0.7 THEN 'overall_score' END, CASE WHEN weight_coverage < 0.6 THEN 'weight_coverage' END, CASE WHEN NOT coalesce(er, false) THEN 'empty_response' END, CASE WHEN NOT coalesce(hr, false) THEN 'hallucination_rate' END], lambda x: x IS NOT NULL) AS f FROM k)"""
RUNS = """WITH r AS (SELECT user_id AS query_id, event_type AS variant_name, round(avg(value) / 100, 9) AS overall_score, count(*) AS context_count, round(min(value) / 10, 9) AS drift_rate, min(event_id) AS answer_length, dense_rank() OVER (ORDER BY event_type) AS pos FROM events GROUP BY 1, 2)"""
ORACLES = {
    "a2_retrieval_stats": "SELECT user_id AS trace_id, round(avg(value / 100), 6) AS score_avg, CASE WHEN count(*) >= 2 THEN round(stddev_pop(value / 100), 6) END AS score_std FROM events GROUP BY 1",
    "a3_coverage": f"""WITH p AS (SELECT a.conv_id, a.turn, list_distinct(list_filter({TOK.format('a.text')}, lambda x: length(x) > 1)) AS x, list_distinct(list_filter({TOK.format('q.text')}, lambda x: length(x) > 1)) AS y FROM conversations a JOIN conversations q ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE a.role = 'assistant' AND q.role = 'user')
        SELECT conv_id, turn, CASE WHEN len(x) > 0 THEN round(len(list_intersect(x, y))::DOUBLE / len(x), 6) END AS ratio FROM p""",
    "a7_behaviour": "WITH r AS (SELECT *, trim(text) = '' OR (contains(lower(text), 'the') AND (3 >= 0.4 * length(text) OR length(text) <= 120)) AS rf FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN rf::INT::DOUBLE END AS rejection_accuracy, CASE WHEN trim(text) = '' THEN 0.0 ELSE 1.0 END::DOUBLE AS empty_response, length(text)::DOUBLE AS response_length FROM r",
    "a8_credit": "WITH " + judged_sql() + " SELECT trace_id, metric, round(credit, 9) AS credit, is_pass FROM j",
    "a9_overall": "WITH " + judged_sql() + " SELECT * FROM o",
    "a9_contribution": "WITH " + judged_sql() + " SELECT trace_id, metric, round(weight * credit / sum(CASE WHEN credit IS NOT NULL THEN weight END) OVER (PARTITION BY trace_id), 9) AS contribution FROM j",
    "a10_gates": GATED + " SELECT trace_id, overall_score, len(f) = 0 AS is_passing, array_to_string(f, ',') AS gate_failures FROM e",
    "a11_summary": GATED + " SELECT count(*) AS n, count_if(len(f) = 0)::BIGINT AS passing, round(avg(overall_score), 4) AS mean_all, round(avg(CASE WHEN overall_score <> 0 THEN overall_score END), 4) AS mean_nonzero FROM e",
    "a11_metrics": "WITH " + judged_sql() + " SELECT metric, round(avg(value), 4) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(coalesce(is_pass, false)::INT), 4) AS pass_rate FROM j GROUP BY metric",
    "a14_variants": RUNS + " SELECT variant_name, count(*) AS queries, round(avg(overall_score), 4) AS mean_score, round(avg(context_count), 1) AS mean_context, round(avg(drift_rate), 4) AS mean_drift, round(min(overall_score), 4) AS min_score, round(max(overall_score), 4) AS max_score FROM r GROUP BY 1",
    "a14_winners": RUNS + """ SELECT query_id, arg_max(variant_name, (overall_score * 100000000 - pos)) AS by_score, arg_max(variant_name, (context_count * 1000 - pos)) AS by_recall, arg_min(variant_name, (drift_rate * 100000000 + pos)) FILTER (drift_rate < 1.0) AS by_drift, true AS comparable FROM r GROUP BY 1""",
    "j13_grid": "SELECT item_id AS query_id, r_name AS variant_name FROM benchmark, region",
    "j14_differences": RUNS + " SELECT a.query_id, a.variant_name AS first, b.variant_name AS second, b.answer_length - a.answer_length AS d_length, b.context_count::INT - a.context_count::INT AS d_context, round(b.overall_score - a.overall_score, 6) AS d_score, round(b.drift_rate - a.drift_rate, 6) AS d_drift FROM r a JOIN r b ON a.query_id = b.query_id AND a.pos < b.pos",
}
_a12 = lambda name, f: f"SELECT '{name}' AS scheme, raw_score AS s FROM (WITH {judged_sql(f)} SELECT * FROM o)"
ORACLES["a12_recalibrate"] = f"""WITH z AS ({_a12('now', '1')} UNION ALL {_a12('strict', "CASE WHEN direction = 'lower' THEN 0.9::DOUBLE ELSE 1.1::DOUBLE END")}),
    w AS (SELECT *, row_number() OVER (PARTITION BY scheme ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY scheme) AS n FROM z WHERE s IS NOT NULL)
    SELECT scheme, max(CASE WHEN i = round_even(0.1::DOUBLE * (n - 1), 0) THEN s END) AS p10, max(CASE WHEN i = round_even(0.5::DOUBLE * (n - 1), 0) THEN s END) AS p50, max(CASE WHEN i = round_even(0.9::DOUBLE * (n - 1), 0) THEN s END) AS p90, round(avg((s >= 0.9)::INT), 4) AS share_high, round(avg(s), 4) AS mean FROM w GROUP BY scheme"""
