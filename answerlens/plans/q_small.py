"""Queries over scalar functions, cuts and the parts of composite operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from answerlens.functions import text as X
from answerlens.operators import contradict, history, retrieve, trace
from answerlens.plans.q_retrieval import COS, vectors
from answerlens.plans.q_text import t
from answerlens.plans.q_trace import CONFLICTS, answers


def c1_cosine(spark, d):
    v = vectors(spark, d)
    w = v.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("vec").alias("next"))
    return v.join(w, "chunk_id").select(F.col("chunk_id").alias("vec_id"), F.round(X.cosine(F.col("vec"), F.col("next")), 6).alias("cosine"))


def c4_status(spark, d):
    return t(spark, d, "events").select("event_id", X.rule_status(F.pmod("event_id", F.lit(5)), F.col("value") / 100).alias("status"))


def c6_levels(spark, d):
    name = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "warning").when(F.col("event_type") == "view", "DEBUG").otherwise("other")
    return t(spark, d, "events").select("event_id", X.level_rank(name).alias("rank"))


def c7_timestamps(spark, d):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return t(spark, d, "events").select("event_id", F.unix_timestamp(X.timestamp(text)).alias("seconds"))


def c8_json(spark, d):
    wrapped = F.concat(F.lit("Sure! "), F.to_json(F.struct(F.col("user_id").alias("u"), F.col("event_type").alias("k"))), F.lit(" done"))
    return t(spark, d, "events").select("event_id", X.json_object(F.when(F.pmod("event_id", F.lit(3)) != 0, wrapped).otherwise("none"), "u long, k string").alias("j")).select("event_id", "j.u", "j.k")


def c9_half_even(spark, d):
    return t(spark, d, "events").select("event_id", X.bround(F.col("event_id") / 8, 2).alias("x"))


def s3_chunk_ids(spark, d):
    return t(spark, d, "documents").select("doc_id", history.chunk_id("source", F.col("doc_id").cast("string"), "text").alias("chunk_id"))


def f2_floor(spark, d):
    v = vectors(spark, d)
    q = v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vec")
    return retrieve.knn(q, v, None, 0.1).groupBy("query_id").agg(F.count(F.lit(1)).alias("passed"))


def _scored(spark, d):
    return t(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("chunk_id"), F.col("value").alias("score"))


def w3_normalised(spark, d):
    best = F.max("score").over(Window.partitionBy("query_id"))
    return _scored(spark, d).select("query_id", "chunk_id", F.round(F.col("score") / best, 6).alias("norm"))


def t1_top5(spark, d):
    return retrieve.top(_scored(spark, d), 5, F.desc("score"), F.col("chunk_id"))


def t2_nearest(spark, d):
    v = vectors(spark, d)
    q = v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vec")
    return retrieve.knn_blocks(q, v, 3).select("query_id", "chunk_id", "rank")


def t3_rerank(spark, d):
    first = retrieve.top(_scored(spark, d), 10, F.desc("score"), F.col("chunk_id")).drop("rank")
    return retrieve.top(first.where("score >= 10"), 5, F.desc("score"), F.col("chunk_id"))


def t7_capped(spark, d):
    s = _scored(spark, d)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    ten = s.withColumn("r", F.row_number().over(w)).where("r <= 10")
    return ten.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "chunk_id"))), lambda x: x["chunk_id"].cast("string")), ",").alias("shown"))


def t4_sources(spark, d):
    a, c = answers(spark, d)
    return trace.trace(a, c).select("trace_id", "idx", F.inline("sources")).select("trace_id", "idx", "place", "chunk_id", "score", "is_cited")


def t5_worst(spark, d):
    a, c = answers(spark, d)
    return contradict.detect(a, c, 1).select("trace_id", "place", "kind", "severity")


def j5_numeric(spark, d):
    a, c = answers(spark, d)
    return contradict.numeric(a, c).select("trace_id", "kind", "answer_value", "source_value", "delta", "severity")


def j6_polarity(spark, d):
    a, c = answers(spark, d)
    return contradict.opposite(a.withColumn("answer", F.concat("answer", F.lit(" The ticket is refundable."))), c.withColumn("text", F.concat("text", F.lit(" A ticket is non-refundable.")))).select("trace_id", "kind", "answer_value", "source_value", "severity")


def j9_attach(spark, d):
    a, c = answers(spark, d)
    return contradict.attach(trace.spans(a), contradict.detect(a, c)).select("trace_id", "idx", "has_contradiction")


QUERIES = {f.__name__: f for f in (c1_cosine, c4_status, c6_levels, c7_timestamps, c8_json, c9_half_even, s3_chunk_ids, f2_floor, w3_normalised, t1_top5, t2_nearest, t3_rerank, t7_capped, t4_sources, t5_worst, j5_numeric, j6_polarity, j9_attach)}

TOP = "row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)"
PAIR = "SELECT a.conv_id * 1000 + a.turn AS trace_id FROM conversations a JOIN conversations u ON u.role = 'user' AND u.conv_id * 1000 + u.turn + 1 = a.conv_id * 1000 + a.turn WHERE a.role = 'assistant'"
ORACLES = {
    "c1_cosine": f"SELECT a.vec_id, round(({COS.replace('greatest(0, ', '(')}), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "c4_status": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'unused' WHEN value / 100 >= 0.7 THEN 'effective' WHEN value / 100 >= 0.4 THEN 'partial' ELSE 'ineffective' END AS status FROM events",
    "c6_levels": "SELECT event_id, CASE event_type WHEN 'error' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 0 ELSE 1 END::INT AS rank FROM events",
    "c7_timestamps": "SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS seconds FROM events",
    "c8_json": "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN user_id END AS u, CASE WHEN event_id % 3 <> 0 THEN event_type END AS k FROM events",
    "c9_half_even": "SELECT event_id, round_even(event_id / 8, 2)::DOUBLE AS x FROM events",
    "s3_chunk_ids": "SELECT doc_id, sha256(concat_ws(chr(31), source, doc_id::VARCHAR, text)) AS chunk_id FROM documents",
    "f2_floor": f"SELECT query_id, count(*) AS passed FROM (SELECT a.vec_id AS query_id, round({COS}, 6) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE s >= 0.1 GROUP BY 1",
    "w3_normalised": "SELECT user_id AS query_id, event_id AS chunk_id, round(value / max(value) OVER (PARTITION BY user_id), 6) AS norm FROM events",
    "t1_top5": f"SELECT user_id AS query_id, event_id AS chunk_id, value AS score, ({TOP})::INT AS rank FROM events QUALIFY rank <= 5",
    "t2_nearest": f"SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, (row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COS}, 6) DESC, b.vec_id))::INT AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY rank <= 3",
    "t3_rerank": f"SELECT user_id AS query_id, event_id AS chunk_id, value AS score, ({TOP})::INT AS rank FROM events WHERE value >= 10 QUALIFY rank <= 5",
    "j5_numeric": f"{CONFLICTS} SELECT trace_id, kind, answer_value, source_value, delta, severity FROM conflict",
    "t5_worst": f"{CONFLICTS} SELECT trace_id, place, kind, severity FROM conflict WHERE place = 1",
    "t7_capped": f"SELECT query_id, string_agg(event_id::VARCHAR, ',' ORDER BY r) AS shown FROM (SELECT user_id AS query_id, event_id, {TOP} AS r FROM events) WHERE r <= 10 GROUP BY 1",
}
