"""Queries over tracing, contradictions, diagnosis and streams, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlens.functions import text as X
from answerlens.functions import text_udf as U
from answerlens.operators import contradict, diagnose, retrieve, trace
from answerlens.operators import index as I
from answerlens.plans.q_retrieval import COS, FUSED, _fused, asked, chunks, vectors
from answerlens.plans.q_text import KEY, TOK, chunk_sql, t
from answerlens.session import shared_folder as folder
from answerlens.streaming import live


def answers(spark, d):
    """Assistant turns with the user turn before them as the one source."""
    c = t(spark, d, "conversations").withColumn("trace_id", F.col("conv_id") * 1000 + F.col("turn"))
    said = F.format_string(" It costs %d dollars [%d]. It took %d days [%d].", 3 + F.pmod("conv_id", F.lit(7)), 1 + F.pmod("conv_id", F.lit(3)), 3 + F.pmod("turn", F.lit(4)), 7 + F.pmod("conv_id", F.lit(2)))
    a = c.where("role = 'assistant'").select("trace_id", F.concat("text", said).alias("answer"))
    s = c.where("role = 'user'").select((F.col("trace_id") + 1).alias("trace_id"), F.lit(1).alias("rank"), F.concat(F.lit("c"), F.col("trace_id").cast("string")).alias("chunk_id"), F.concat(F.col("text"), F.lit(" It costs 9 dollars. It took 3 days.")).alias("text"))
    ids = a.select("trace_id").join(s.select("trace_id"), "trace_id")
    return a.join(ids, "trace_id"), s.join(ids, "trace_id")


def p2_chunks(spark, d):
    return t(spark, d, "documents").select("doc_id", F.inline(U.chunks(F.col("text")))).select("doc_id", "chunk_index", "char_count", F.md5("text").alias("digest"))


def p4_sentences(spark, d):
    s = t(spark, d, "documents").select("doc_id", "text", F.posexplode(U.sentences(F.col("text"))).alias("idx", "s"))
    return s.select("doc_id", "idx", "s.start", "s.end", "s.closed", (F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")) == F.col("s.text")).alias("exact"))


def p9_typos(spark, d):
    fix = U.corrector({"teh": "the", "recieve": "receive", "thier": "their", "onnt": "ont"})
    return t(spark, d, "documents").select("doc_id", fix(F.col("text")).alias("f")).select("doc_id", F.size("f.corrections").alias("n"), F.md5("f.corrected").alias("digest"))


def p13_claims(spark, d):
    return t(spark, d, "documents").select("doc_id", F.inline(U.claims(F.col("text")))).select("doc_id", "kind", "value", "raw", "start", "end", "family")


def p14_polarity(spark, d):
    return t(spark, d, "documents").select("doc_id", F.inline(U.polarity(F.col("text"), {"reference": (("not the",), ("the",))})))


def p16_structure(spark, d):
    s = t(spark, d, "documents").select("doc_id", U.structure(F.col("text")).alias("s"))
    return s.select("doc_id", "s.title", F.size("s.sections").alias("sections"))


def p23_embedding(spark, d):
    v = X.hashed_vector(F.col("text"), 16)
    return t(spark, d, "benchmark").select("item_id", F.round(X.dot(v, v), 6).alias("norm"), F.size(v).alias("dim"))


def j7_similarity(spark, d):
    a, c = answers(spark, d)
    return trace.similarity(trace.spans(a), c).select("trace_id", "idx", "chunk_id", "score")


def j8_citations(spark, d):
    a, c = answers(spark, d)
    v = trace.validate(a, c)
    return v.select("trace_id", *[F.array_join(x, ",").alias(x) for x in ("valid", "invalid", "missing")])


def a4_citation_coverage(spark, d):
    a, c = answers(spark, d)
    return trace.citation_coverage(trace.spans(a), c)


def a5_hallucination(spark, d):
    a, c = answers(spark, d)
    return trace.hallucination(trace.spans(a), c)


def a6_semantic(spark, d):
    a, c = answers(spark, d)
    return trace.semantic(a.withColumn("query", F.lit("what does it cost")), c)


def a13_drift(spark, d):
    rows = t(spark, d, "events").select(F.col("user_id").alias("trace_id"), F.when(F.col("event_type") == "error", "drift").when(F.col("event_type") == "signup", "unverified").when(F.col("event_type") == "view", "direct_quote").otherwise("summary").alias("level"))
    return trace.drift(rows)


def w1_rank_ratio(spark, d):
    rows = t(spark, d, "events").select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("idx"), F.when(F.col("event_type") != "error", F.floor("value")).alias("score"))
    return trace.rank_ratio(rows).select("trace_id", "idx", F.round("rank_ratio", 6).alias("rank_ratio"), "scored")


def g6_trace(spark, d):
    a, c = answers(spark, d)
    return trace.trace(a, c).select("trace_id", "idx", "start", "end", "score", "level", F.size("invalid_citations").alias("invalid"))


def g7_contradictions(spark, d):
    a, c = answers(spark, d)
    return contradict.detect(a, c).select("trace_id", "place", "kind", "answer_value", "source_value", "severity")


def f8_what_if(spark, d):
    ctx = t(spark, d, "events").select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("rank"), F.col("event_id").alias("chunk_id"), "event_type")
    return trace.without_chunks(ctx, ctx.where("event_type = 'error'").select("trace_id", "chunk_id")).select("trace_id", "chunk_id", "rank")


def u1_mode_difference(spark, d):
    f = _fused(spark, d)
    got = retrieve.top(f, 5, F.desc("score"), F.col("chunk_id")).select("query_id", "chunk_id")
    out = diagnose.mode_difference(f, got, asked(spark, d), chunks(spark, d))
    return out.select("query_id", "kind", "n", "valuable", F.array_join("examples", ",").alias("examples"))


def u2_keyword_gap(spark, d):
    p = spark.createDataFrame([("tion", "^th.*tion$"), ("end", "^en.*nd$")], "domain string, pattern string")
    q = asked(spark, d).withColumn("kb_id", F.concat(F.lit("src"), F.pmod("query_id", F.lit(20)).cast("string")))
    out = diagnose.keyword_gap(q, I.vocabulary(chunks(spark, d, F.col("source"))), p)
    return out.select("query_id", "domain", F.array_join("missing", ",").alias("missing"))


def j16_misses(spark, d):
    v = vectors(spark, d)
    docs = v.join(chunks(spark, d).select("chunk_id", "text"), "chunk_id")
    q = asked(spark, d).join(v.withColumnRenamed("chunk_id", "query_id"), "query_id").select("query_id", "query", "vec")
    got = v.where("chunk_id < 20").select(F.col("chunk_id").alias("query_id"), "chunk_id")
    return diagnose.misses(q, docs, got, threshold=0.2).select("query_id", "chunk_id", "similarity", F.col("overlap").cast("long").alias("overlap"), "cause")


def _diagnosis(spark, d):
    """G4's items: source is the base, lang the file type, and file names carry a year."""
    f, every, v = _fused(spark, d), chunks(spark, d), vectors(spark, d)
    q = asked(spark, d).withColumn("kb_id", F.concat(F.lit("src"), F.pmod("query_id", F.lit(20)).cast("string")))
    got = retrieve.top(f, 5, F.desc("score"), F.col("chunk_id")).select("query_id", "chunk_id")
    files = t(spark, d, "documents").select(F.col("source").alias("kb_id"), F.col("lang").alias("file_type"), F.concat(F.lit("report "), (F.pmod("doc_id", F.lit(5)) + 2020).cast("string")).alias("file_name"))
    patterns = spark.createDataFrame([("tion", "^th.*tion$"), ("end", "^en.*nd$")], "domain string, pattern string")
    modes = diagnose.mode_difference(f, got, asked(spark, d), every).groupBy("query_id").agg(F.sum(F.when(F.col("kind") != "both", F.col("n")).otherwise(0)).alias("count"), (F.sum("valuable") > 0).alias("high"))
    missed = diagnose.misses(q.join(v.withColumnRenamed("chunk_id", "query_id"), "query_id"), v.join(every.select("chunk_id", "text"), "chunk_id"), got, threshold=0.2)
    return diagnose.diagnose({
        "metadata_filter": diagnose.metadata_filter(q, files).groupBy("query_id").agg(F.sum("count").alias("count"), F.lit(False).alias("high")),
        "near_threshold": diagnose.near_threshold(f).withColumn("high", F.col("count") >= 3),
        "mode_difference": modes.where("count > 0"),
        "keyword_gap": diagnose.keyword_gap(q, I.vocabulary(chunks(spark, d, F.col("source"))), patterns).groupBy("query_id").agg(F.sum(F.size("missing")).alias("count"), F.lit(False).alias("high")),
        "potential_misses": missed.groupBy("query_id").agg(F.count(F.lit(1)).alias("count"), F.lit(True).alias("high")),
    })


def g4_diagnosis(spark, d):
    return diagnose.summarise(_diagnosis(spark, d), asked(spark, d))


def g5_business(spark, d):
    e = t(spark, d, "events")
    return diagnose.business(e.select(F.col("user_id").alias("query_id")).distinct(), e.where("event_type = 'view'").select(F.col("user_id").alias("query_id"), (F.col("value") / 100).alias("score")))


def w5_running_ratio(spark, d):
    rows = t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("long").alias("trace_id"), F.col("vec_id").alias("idx"), F.round(F.col("embedding")[0].cast("double"), 4).alias("score"))
    return live.running_ratio(rows).select("trace_id", "idx", F.round("running_ratio", 6).alias("running_ratio"))


def _stream(spark, d, name):
    return spark.readStream.schema(t(spark, d, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def x1_assembly(spark, d):
    c = _stream(spark, d, "conversations").where("role = 'assistant'").withColumn("trace_id", F.col("conv_id") * 1000 + F.col("turn"))
    third = F.greatest(F.ceil(F.length("text") / 3), F.lit(1)).cast("int")
    each = c.select("trace_id", "text", third.alias("w"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("seq"))
    deltas = each.select("trace_id", "seq", F.substring("text", F.col("seq") * F.col("w") + 1, F.col("w")).alias("delta"), (F.col("seq") == 2).alias("is_end"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    return live.run_once(live.assemble(deltas), folder(spark))


def x2_verdicts(spark, d):
    e = _stream(spark, d, "events").select(F.col("user_id").alias("trace_id"), F.col("event_id").cast("int").alias("idx"), (F.col("value") / 100).alias("score"), F.col("ts").cast("timestamp").alias("ts"))
    return live.run_once(live.running_verdicts(e, "ts"), folder(spark))


def x4_threshold(spark, d):
    e = _stream(spark, d, "events").select(F.col("event_type").alias("feedback_type"), F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return live.run_once(live.feedback_threshold(e, ts="ts"), folder(spark))


def x5_health(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").cast("string").alias("service"), F.col("event_id").alias("call_id"), "ts", F.col("value").alias("duration"), (F.col("event_type") == "error").alias("error"))
    return live.health(e)


def x5_shares(spark, d):
    e = _stream(spark, d, "events").select(F.pmod("user_id", F.lit(9)).alias("service"), "ts", F.col("value").alias("duration"), (F.col("event_type") == "error").alias("error"))
    return live.run_once(live.shares(e, "1 day"), folder(spark), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


def x6_metrics(spark, d):
    e = _stream(spark, d, "events").select("ts", F.col("event_type").alias("endpoint"), F.col("value").alias("duration"), (F.pmod("user_id", F.lit(9)) == 0).alias("error"))
    out = live.run_once(live.metrics(e, "1 hour"), folder(spark), "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


QUERIES = {f.__name__: f for f in (p2_chunks, p4_sentences, p9_typos, p13_claims, p14_polarity, p16_structure, p23_embedding, j7_similarity, j8_citations, a4_citation_coverage, a5_hallucination, a6_semantic, a13_drift, w1_rank_ratio, g6_trace, g7_contradictions, f8_what_if, u1_mode_difference, u2_keyword_gap, j16_misses, g4_diagnosis, g5_business, w5_running_ratio, x1_assembly, x2_verdicts, x4_threshold, x5_health, x5_shares, x6_metrics)}

#: The claims of answers() that its sources contradict: money by more than a fifth of 9, days by more than a fifth of their own number.
CONFLICTS = """SELECT *, (row_number() OVER (PARTITION BY trace_id ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, relative DESC))::INT AS place FROM (
        SELECT *, CASE WHEN relative >= 0.5 THEN 'high' WHEN relative >= 0.2 THEN 'medium' ELSE 'low' END AS severity FROM (
        SELECT trace_id, 'money' AS kind, v || ' dollars' AS answer_value, '9 dollars' AS source_value, abs(v - 9)::DOUBLE AS delta, abs(v - 9) / 9 AS relative FROM (SELECT a.conv_id * 1000 + a.turn AS trace_id, 3 + a.conv_id % 7 AS v FROM pair a)
        UNION ALL SELECT trace_id, 'duration', v || ' days', '3 days', (v - 3) * 86400.0::DOUBLE, (v - 3) / v FROM (SELECT a.conv_id * 1000 + a.turn AS trace_id, 3 + a.turn % 4 AS v FROM pair a)) WHERE relative > 0.2)"""
CONFLICTS = f"WITH pair AS (SELECT a.conv_id, a.turn FROM conversations a JOIN conversations u ON u.role = 'user' AND u.conv_id * 1000 + u.turn + 1 = a.conv_id * 1000 + a.turn WHERE a.role = 'assistant'), conflict AS ({CONFLICTS})"
LOW = r"lower(text)"
BEFORE = "substring(lower(text), greatest(1, strpos(lower(text), 'the') - 40), strpos(lower(text), 'the') - greatest(1, strpos(lower(text), 'the') - 40))"
LINES = r"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
ORACLES = {
    "p16_structure": rf"""WITH l AS (SELECT doc_id, {LINES} AS lines FROM documents), k AS (SELECT doc_id, lines, len(list_filter(lines, lambda x: regexp_matches(x, '^[0-9]+\.?\s+\S'))) AS n FROM l)
        SELECT doc_id, coalesce(list_filter(lines, lambda x: NOT regexp_matches(x, '^[0-9*•·-]'))[1], '') AS title, CASE WHEN n > 0 THEN n WHEN len(list_filter(lines, lambda x: regexp_matches(x, '^[*•·-]'))) > 0 THEN 1 ELSE 0 END::INT AS sections FROM k""",
    "p2_chunks": f"WITH RECURSIVE {chunk_sql('doc_id, text')} SELECT doc_id, chunk_index, length(chunk)::INT AS char_count, md5(chunk) AS digest FROM chunks",
    "p9_typos": "SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE (length(text) - length(replace(text, 'teh', ''))) // 3 + (length(text) - length(replace(text, 'recieve', ''))) // 7 + (length(text) - length(replace(text, 'thier', ''))) // 5 + (length(text) - length(replace(text, 'onnt', ''))) // 4 END::INT AS n, md5(replace(replace(replace(replace(text, 'teh', 'the'), 'recieve', 'receive'), 'thier', 'their'), 'onnt', 'ont')) AS digest FROM documents",
    "p14_polarity": rf"""SELECT doc_id, 'reference' AS concept, CASE WHEN contains({LOW}, 'not the') OR regexp_matches({BEFORE}, '((^|[^\p{{L}}\p{{N}}_])(not|no|never|cannot)|n''t|不|未|没有)\s*([\p{{L}}\p{{N}}_]+\s+)?$') THEN -1 ELSE 1 END::INT AS polarity, CASE WHEN contains({LOW}, 'not the') THEN 'not the' ELSE 'the' END AS phrase FROM documents WHERE contains({LOW}, 'the')""",
    "u2_keyword_gap": f"""WITH p AS (SELECT * FROM (VALUES ('tion', '^th.*tion$'), ('end', '^en.*nd$')) x(domain, pattern)), q AS (SELECT DISTINCT item_id AS query_id, 'src' || (item_id % 20) AS kb_id, unnest({KEY}) AS word FROM benchmark),
        h AS (SELECT DISTINCT query_id, kb_id, domain FROM q JOIN p ON regexp_matches(word, pattern)), v AS (SELECT DISTINCT source AS kb_id, unnest({KEY}) AS word FROM documents), w AS (SELECT DISTINCT kb_id, domain, word FROM v JOIN p ON regexp_matches(word, pattern)),
        g AS (SELECT query_id, domain, word FROM h JOIN w USING (kb_id, domain) WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.query_id = h.query_id AND q.word = w.word) QUALIFY row_number() OVER (PARTITION BY query_id, domain ORDER BY word) <= 10)
        SELECT query_id, domain, string_agg(word, ',' ORDER BY word) AS missing FROM g GROUP BY ALL""",
    "x2_verdicts": """WITH e AS (SELECT user_id AS trace_id, event_id::INT AS idx, value / 100 AS score FROM events), r AS (SELECT a.trace_id, a.idx, a.score, (count_if(b.score < a.score) + 1) / count(b.score) AS ratio, count(b.score) AS n FROM e a JOIN e b ON b.trace_id = a.trace_id AND b.idx <= a.idx GROUP BY ALL)
        SELECT trace_id, idx, CASE WHEN score IS NULL THEN 'no_source' WHEN score < 0.35 THEN 'drift' WHEN score >= 0.75 AND (n < 3 OR ratio >= 0.9) THEN 'direct_quote' WHEN score >= 0.55 AND (n < 3 OR ratio >= 0.75) THEN 'summary' ELSE 'low_confidence' END AS level FROM r""",
    "j8_citations": "SELECT conv_id * 1000 + turn AS trace_id, CASE WHEN conv_id % 3 = 0 THEN '1' ELSE '' END AS valid, CASE WHEN conv_id % 3 = 0 THEN '' ELSE (1 + conv_id % 3) || ',' END || (7 + conv_id % 2) AS invalid, CASE WHEN conv_id % 3 = 0 THEN '' ELSE '1' END AS missing FROM conversations a WHERE role = 'assistant' AND EXISTS (SELECT 1 FROM conversations u WHERE u.role = 'user' AND u.conv_id * 1000 + u.turn + 1 = a.conv_id * 1000 + a.turn)",
    "a13_drift": """WITH r AS (SELECT user_id AS trace_id, count(*) AS n, count_if(event_type = 'error')::BIGINT AS drift, count_if(event_type = 'signup')::BIGINT AS unverified, count_if(event_type = 'view') AS hi FROM events GROUP BY 1)
        SELECT trace_id, n, drift, unverified, round(drift / n, 4) AS drift_rate, round(CASE WHEN n > unverified THEN drift / (n - unverified) ELSE 0 END, 4) AS verified_drift_rate, round(unverified / n, 4) AS unverified_rate, round(hi / n, 4) AS high_confidence_rate FROM r""",
    "w1_rank_ratio": "WITH r AS (SELECT user_id AS trace_id, event_id AS idx, CASE WHEN event_type <> 'error' THEN floor(value) END AS s FROM events) SELECT trace_id, idx, CASE WHEN s IS NOT NULL THEN round(rank() OVER (PARTITION BY trace_id, s IS NULL ORDER BY s) / count(*) OVER (PARTITION BY trace_id, s IS NULL), 6) END AS rank_ratio, count(s) OVER (PARTITION BY trace_id) AS scored FROM r",
    "f8_what_if": "SELECT user_id AS trace_id, event_id AS chunk_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INT AS rank FROM events WHERE event_type <> 'error'",
    "u1_mode_difference": FUSED + f""", g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM fused),
        m AS (SELECT g.*, CASE WHEN in_bm25 AND in_vector THEN 'both' WHEN in_bm25 THEN 'bm25_only' ELSE 'vector_only' END AS kind,
            len(list_intersect(list_distinct(list_filter({TOK.format('q.text')}, lambda x: length(x) > 1)), list_distinct(list_filter({TOK.format("CASE WHEN length(d.text) > 100 THEN substring(d.text, 1, 100) || '...' ELSE d.text END")}, lambda x: length(x) > 1)))) >= 2 AND greatest(bm25_score, vector_score) > 0.3 AS valuable
            FROM g JOIN benchmark q ON q.item_id = query_id JOIN documents d ON d.doc_id = chunk_id WHERE r > 5),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, chunk_id) AS p FROM m)
        SELECT query_id, kind, count(*) AS n, count_if(valuable)::BIGINT AS valuable, string_agg(chunk_id::VARCHAR, ',' ORDER BY p) FILTER (p <= 5) AS examples FROM o GROUP BY ALL""",
    "j16_misses": f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round({COS}, 6) AS similarity, len(list_intersect(list_distinct(list_filter({TOK.format('q.text')}, lambda x: length(x) > 1)), list_distinct(list_filter({TOK.format('d.text')}, lambda x: length(x) > 1)))) AS overlap
        FROM embeddings a JOIN benchmark q ON q.item_id = a.vec_id, embeddings b JOIN documents d ON d.doc_id = b.vec_id WHERE NOT (a.vec_id = b.vec_id AND b.vec_id < 20))
        SELECT query_id, chunk_id, similarity, overlap, CASE WHEN overlap = 0 THEN 'embedding_mismatch' WHEN similarity >= 0.2::DOUBLE - 0.02::DOUBLE THEN 'threshold_edge' WHEN overlap <= 1 THEN 'keyword_missing' ELSE 'partial_match' END AS cause FROM s WHERE similarity >= 0.15 AND similarity < 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) <= 10""",
    "g5_business": "WITH q AS (SELECT DISTINCT user_id AS query_id FROM events), m AS (SELECT user_id AS query_id, round(avg(value / 100), 6) AS mean_score FROM events WHERE event_type = 'view' GROUP BY 1) SELECT query_id, mean_score, CASE WHEN mean_score IS NULL OR mean_score < 0.2 THEN 'critical' WHEN mean_score < 0.4 THEN 'warning' WHEN mean_score < 0.6 THEN 'caution' ELSE 'healthy' END AS status FROM q LEFT JOIN m USING (query_id)",
    "w5_running_ratio": "WITH r AS (SELECT vec_id // 10 AS trace_id, vec_id AS idx, round(embedding[1]::DOUBLE, 4) AS s FROM embeddings) SELECT a.trace_id, a.idx, round((count_if(b.s < a.s) + 1) / count(*), 6) AS running_ratio FROM r a JOIN r b ON a.trace_id = b.trace_id AND b.idx <= a.idx GROUP BY ALL",
    "g7_contradictions": f"{CONFLICTS} SELECT trace_id, place, kind, answer_value, source_value, severity FROM conflict",
    "x5_shares": "SELECT date_trunc('day', ts) AS start, user_id % 9 AS service, count(*) AS n, count_if(event_type = 'error')::BIGINT AS failed, count_if(value > 30)::BIGINT AS slow, round(count_if(event_type = 'error' OR value > 30) / count(*), 6) AS bad_share, count(*) >= 10 AND count_if(event_type = 'error' OR value > 30) >= count(*) * 0.5 AS down FROM events GROUP BY ALL",
    "x4_threshold": "SELECT feedback_type, key, unnest(range(1, n // 3 + 1))::INT AS number FROM (SELECT event_type AS feedback_type, user_id::VARCHAR AS key, count(*) AS n FROM events GROUP BY ALL)",
    "x6_metrics": "SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS end, event_type AS endpoint, count(*) AS n, count_if(user_id % 9 = 0)::BIGINT AS errors, round(sum(value), 6) AS total, max(value) AS longest FROM events GROUP BY ALL",
}
