"""Queries over corpus analysis, rules, feedback, history and logs, with their SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlens.operators import corpus as C
from answerlens.operators import history as H
from answerlens.operators import rules as R
from answerlens.operators.bases import Bases
from answerlens.plans.q_text import KEY, TOK, t
from answerlens.session import shared_folder


def docs(spark, d):
    return t(spark, d, "documents").select("doc_id", "text")


def asked(spark, d):
    return t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def j10_relations(spark, d):
    return C.relations(docs(spark, d), related=0.8, duplicate=0.95)


def j10_relations_default(spark, d):
    """J10 whole: pairs above 0.4, duplicates above 0.8."""
    return C.relations(docs(spark, d))


def j15_coverage(spark, d):
    return C.coverage(asked(spark, d), docs(spark, d))


def _pairs(spark, d):
    """Neighbouring documents as pairs."""
    return docs(spark, d).select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))


def u3_merge(spark, d):
    return C.merged(docs(spark, d), _pairs(spark, d)).select("a", "b", F.md5("text").alias("digest"))


def u3_merge_duplicates(spark, d):
    """U3 over the duplicates of J10."""
    return C.merged_duplicates(docs(spark, d), digest=True)


def u4_distinct_pairs(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("question"), F.floor("value").cast("string").alias("answer"))
    return C.distinct_pairs(e)


def u5_new_lines(spark, d):
    a = docs(spark, d)
    return C.new_lines(a.select("doc_id", F.substring("text", 1, 300).alias("text")), a)


def g10_issues(spark, d):
    return C.issues(docs(spark, d), "a-zA-Z")


def p17_section_pairs(spark, d):
    s = t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("title"), F.array(F.concat(F.lit("status: "), F.col("o_orderstatus")), F.col("o_orderpriority")).alias("items"))
    return C.section_pairs(s)


def p18_render(spark, d):
    qa = t(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("question"), F.col("event_type").alias("answer"))
    return C.render(docs(spark, d), qa).select("doc_id", "variant", F.md5("content").alias("digest"))


def feedback(spark, d):
    """Feedback rows from events."""
    return t(spark, d, "events").select(F.col("event_id").alias("trace_id"), F.when(F.col("event_type") == "view", "recall_missing").when(F.col("event_type") == "click", "intent_wrong").otherwise(F.col("event_type")).alias("feedback_type"), F.concat(F.lit("kb"), F.pmod("user_id", F.lit(7)).cast("string")).alias("kb_id"), F.lit(None).cast("string").alias("intent_type"), F.when(F.pmod("event_id", F.lit(2)) == 0, F.concat(F.lit("i"), F.pmod("user_id", F.lit(5)).cast("string"))).alias("intent_correction"), F.concat(F.lit("question of "), F.col("user_id").cast("string")).alias("query"), F.col("event_type").alias("action"), "ts")


def g11_feedback_pairs(spark, d):
    f = feedback(spark, d).withColumn("doc_id", F.col("kb_id")).withColumn("pos", F.col("trace_id"))
    return C.feedback_pairs(f)


def a15_suggestions(spark, d):
    return R.suggestions(feedback(spark, d)).select("feedback_type", "key", "n", "rule_type", "action", F.array_join("queries", "|").alias("queries"))


def a15_remaining(spark, d):
    """A suggestion needs a twenty-fifth of all feedback."""
    f = feedback(spark, d)
    return R.remaining(f, R.suggestions(f, least=f.count() // 25)).select("trace_id", "feedback_type", "key")


def rule_events(spark, d):
    return t(spark, d, "events").select("event_id", F.col("user_id").alias("rule_id"), "ts", (F.col("event_type") != "error").alias("effective"), F.when(F.col("event_type") != "view", F.col("value") / 100).alias("evaluation_score"))


def a16_effectiveness(spark, d):
    rules = t(spark, d, "documents").select(F.col("doc_id").alias("rule_id"))
    return R.effectiveness(rules, rule_events(spark, d))


def a16_recent(spark, d):
    return R.recent(rule_events(spark, d)).select("rule_id", "event_id", "rank")


def a17_histogram(spark, d):
    f = t(spark, d, "events").select(F.col("event_type").alias("feedback_type"), F.concat(F.lit("i"), F.pmod("user_id", F.lit(3)).cast("string")).alias("intent_type"))
    return R.histogram(f)


def logs(spark, d):
    return t(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"), (F.pmod("conv_id", F.lit(5)) / 4.0).alias("score"), (F.pmod("conv_id", F.lit(3)) == 0).alias("is_passing"))


def a18_effectiveness(spark, d):
    return R.query_effectiveness(logs(spark, d))


def t6_top_keywords(spark, d):
    return R.top_keywords(logs(spark, d))


def j4_rules(spark, d):
    q = asked(spark, d).withColumn("intent", F.when(F.pmod("query_id", F.lit(2)) == 0, "howto").otherwise("status")).withColumn("kb_id", F.when(F.pmod("query_id", F.lit(3)) != 0, "kb1"))
    r = t(spark, d, "nation").select(F.col("n_nationkey").alias("rule_id"), F.when(F.pmod("n_nationkey", F.lit(5)) != 4, F.array(F.lower(F.substring("n_name", 1, 2)), F.lit("th"))).alias("keywords"), F.when(F.pmod("n_nationkey", F.lit(2)) == 0, "any").otherwise("all").alias("match_type"), F.when(F.pmod("n_nationkey", F.lit(3)) == 0, F.array(F.lit("howto"))).alias("intent_types"), F.when(F.pmod("n_nationkey", F.lit(4)) == 0, F.array(F.lit("kb2"))).alias("kb_ids"))
    return R.match(q, r)


def calls(spark, d):
    return t(spark, d, "events").select("event_id", "ts", F.col("event_type").alias("endpoint"), F.col("value").alias("duration"), (F.pmod("user_id", F.lit(9)) == 0).alias("error"))


def a21_requests(spark, d):
    return H.requests(calls(spark, d))


def a21_total(spark, d):
    return H.requests_total(calls(spark, d))


def w4_moving_mean(spark, d):
    return H.moving_mean(calls(spark, d)).select("event_id", "moving")


def traces(spark, d):
    return t(spark, d, "events").select(F.col("event_id").alias("trace_id"), F.concat(F.lit("kb"), F.pmod("user_id", F.lit(4)).cast("string")).alias("kb_id"), F.col("event_type").alias("query"), F.col("props").alias("answer"), F.col("ts").alias("created_at"), F.to_date("ts").alias("dt"), F.col("value").alias("duration"), (F.col("event_type") != "error").alias("is_passing"), (F.col("value") / 100).alias("score"))


def f6_history(spark, d):
    return H.search(traces(spark, d), "kb1", F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"), "view", 2, 20).select("trace_id", "total")


def a20_statistics(spark, d):
    return H.statistics(traces(spark, d), F.lit("2024-01-10").cast("date"))


def s13_retention(spark, d):
    return H.retained(traces(spark, d), "2024-01-30", 10).groupBy("dt").agg(F.count(F.lit(1)).alias("n"))


def f7_lines(spark, d):
    e = t(spark, d, "events").select(F.col("event_id").alias("line_no"), F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "WARNING").otherwise("INFO").alias("level"))
    return H.lines(e, "WARNING", 300)


def kb_chunks(spark, d):
    return t(spark, d, "documents").select(F.col("source").alias("kb_id"), F.col("lang").alias("file_name"), F.col("lang").alias("file_id"), F.col("doc_id").alias("chunk_id"), "text")


def a19_inventory(spark, d):
    kbs = t(spark, d, "documents").select(F.col("source").alias("kb_id")).distinct().unionByName(t(spark, d, "region").select(F.col("r_name").alias("kb_id")))
    return H.inventory(kb_chunks(spark, d), kbs)


def s4_replace(spark, d):
    old = kb_chunks(spark, d).select("kb_id", "file_id", "chunk_id")
    new = t(spark, d, "embeddings").select(F.lit("src1").alias("kb_id"), F.lit("en").alias("file_id"), (F.col("vec_id") + 10**6).alias("chunk_id"))
    return H.replace_files(old, new)


def s5_scan(spark, d):
    return kb_chunks(spark, d).where("kb_id = 'src3'").select("chunk_id", F.length("text").alias("n"))


def s6_page(spark, d):
    return H.page(kb_chunks(spark, d).where("file_name = 'en'"), 100, 100).select("chunk_id")


def _changed(spark, d) -> tuple[Bases, DataFrame]:
    """All documents stored as bases by source and files by language, then one file replaced."""
    bases = Bases(spark, f"{shared_folder(spark)}/s4-{uuid4().hex}")
    bases.replace(kb_chunks(spark, d))
    new = t(spark, d, "embeddings").select(F.lit("src1").alias("kb_id"), F.lit("en").alias("file_name"), F.lit("en").alias("file_id"), (F.col("vec_id") + 1000000).alias("chunk_id"), F.concat(F.lit("word"), F.col("label").cast("string")).alias("text"))
    return bases, bases.replace(new)


def s4_stored(spark, d):
    return _changed(spark, d)[0].table("chunks").select("kb_id", "file_id", "chunk_id")


def s4_deleted(spark, d):
    return _changed(spark, d)[1]


def s4_postings(spark, d):
    """The index goes with the chunks: chunks and terms of each base after the change."""
    terms = _changed(spark, d)[0].index().terms
    return terms.groupBy("kb_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"))


def s15_stored(spark, d):
    """A base created, one dropped: what is left, and how many chunks it has."""
    bases = Bases(spark, f"{shared_folder(spark)}/s15-{uuid4().hex}")
    bases.replace(kb_chunks(spark, d))
    names = t(spark, d, "nation")
    bases.create(names.select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("kb_id")))
    bases.drop(names.where("n_nationkey % 4 = 1").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("kb_id")))
    n = bases.table("chunks").groupBy("kb_id").agg(F.count(F.lit(1)).alias("chunks"))
    return bases.manifest().select("kb_id").join(n, "kb_id", "left").fillna(0, ["chunks"])


def s6_pages(spark, d):
    """All pages of all bases, with totals."""
    return H.pages(kb_chunks(spark, d), 100).select("kb_id", "chunk_id", "page", "total")


def s6_lookup(spark, d):
    """Chunks found by id in a table stored for that."""
    folder = f"{shared_folder(spark)}/s6-{uuid4().hex}"
    H.store_for_lookup(kb_chunks(spark, d), folder)
    return H.lookup(spark, folder, [7, 100, 205, -1]).select("kb_id", "chunk_id", "file_name")


def s15_create_drop(spark, d):
    kbs = t(spark, d, "documents").select(F.col("source").alias("kb_id")).distinct()
    new = t(spark, d, "region").select(F.col("r_name").alias("kb_id")).unionByName(spark.createDataFrame([("src1",), ("src2",)], "kb_id string"))
    return H.drop(H.create(kbs, new), "src2")


def j12_scenario(spark, d):
    q = t(spark, d, "events").select(F.col("event_id").alias("query_id"), F.concat(F.lit("src"), F.pmod("user_id", F.lit(30)).cast("string")).alias("kb_id"), F.when(F.col("event_type") == "view", "asked").alias("scenario_id"))
    k = t(spark, d, "documents").groupBy(F.col("source").alias("kb_id")).agg(F.min("lang").alias("scenario_id"))
    return H.scenario(q, k)


QUERIES = {f.__name__: f for f in (j10_relations, j10_relations_default, j15_coverage, u3_merge, u3_merge_duplicates, u4_distinct_pairs, u5_new_lines, g10_issues, p17_section_pairs, p18_render, g11_feedback_pairs, a15_suggestions, a15_remaining, a16_effectiveness, a16_recent, a17_histogram, a18_effectiveness, t6_top_keywords, j4_rules, a21_requests, a21_total, w4_moving_mean, f6_history, a20_statistics, s13_retention, f7_lines, a19_inventory, s4_replace, s5_scan, s4_stored, s4_deleted, s4_postings, s15_stored, s6_page, s6_pages, s6_lookup, s15_create_drop, j12_scenario)}
QUERIES |= {"p18_render_all": p18_render, "a15_remaining_all": a15_remaining}  # the names under which the whole tables were first read

FB = """f AS (SELECT event_id AS trace_id, CASE event_type WHEN 'view' THEN 'recall_missing' WHEN 'click' THEN 'intent_wrong' ELSE event_type END AS feedback_type, 'kb' || (user_id % 7) AS kb_id, CASE WHEN event_id % 2 = 0 THEN 'i' || (user_id % 5) END AS ic, 'question of ' || user_id AS query, event_type AS action, ts FROM events),
    k AS (SELECT *, CASE WHEN feedback_type = 'recall_missing' THEN kb_id ELSE coalesce(ic, 'other') END AS key FROM f)"""
ORACLES = {
    "j10_relations": f"""WITH d AS (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents WHERE length(text) > 100), nn AS (SELECT count(*) AS n FROM documents WHERE length(text) > 100),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL), df AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 ORDER BY total DESC, term LIMIT 1000),
        r AS (SELECT doc_id, term, tf * (ln((n + 1) / (df + 1)) + 1) AS w FROM tf JOIN df USING (term), nn), m AS (SELECT doc_id, sqrt(sum(w * w)) AS nm FROM r GROUP BY 1), w AS (SELECT doc_id, term, w / nm AS w FROM r JOIN m USING (doc_id)),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, round(sum(a.w * b.w), 6) AS s FROM w a JOIN w b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL HAVING s > 0.8)
        SELECT a, b, CASE WHEN s > 0.95 THEN 'duplicate' ELSE 'related' END AS relation, s AS similarity FROM p""",
    "j15_coverage": f"""WITH q AS (SELECT DISTINCT item_id, unnest({KEY}) AS word FROM benchmark), q2 AS (SELECT * FROM q WHERE length(word) >= 2), w AS (SELECT DISTINCT word FROM q2), h AS (SELECT doc_id, word FROM documents JOIN w ON contains(lower(text), word))
        SELECT d.doc_id, round(count(DISTINCT item_id)::DOUBLE / (SELECT count(*) FROM benchmark), 6) AS coverage, count(DISTINCT h.word) AS words FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN q2 ON q2.word = h.word GROUP BY d.doc_id""",
    "u3_merge": "WITH p AS (SELECT doc_id AS a, doc_id + 1 AS b FROM documents), l AS (SELECT DISTINCT a, b, line FROM p JOIN (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) x ON x.doc_id IN (a, b) WHERE trim(line, ' ') <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY line) AS r FROM l) SELECT a, b, md5(string_agg(line, chr(10) ORDER BY r)) AS digest FROM r WHERE r <= 100 GROUP BY a, b",
    "u4_distinct_pairs": "SELECT user_id AS doc_id, event_type AS question, floor(value)::BIGINT::VARCHAR AS answer, min(event_id) AS pos FROM events GROUP BY ALL",
    "u5_new_lines": """WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), a AS (SELECT doc_id, trim(line, ' ') AS line, pos FROM x WHERE trim(line, ' ') <> ''),
        b AS (SELECT doc_id, trim(unnest(string_split(substring(text, 1, 300), chr(10))), ' ') AS line FROM documents),
        f AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = a.doc_id AND b.line = a.line)) SELECT doc_id, r::INT AS rank, substring(line, 1, 80) AS line FROM f WHERE r <= 5""",
    "g10_issues": r"""WITH x AS (SELECT doc_id, text, length(text) AS n, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS own FROM documents)
        SELECT doc_id, 'too_short' AS issue, 'critical' AS severity FROM x WHERE n < 100 UNION ALL SELECT doc_id, 'too_long', 'warning' FROM x WHERE n > 5000 UNION ALL SELECT doc_id, 'little_text', 'warning' FROM x WHERE own < 50 AND own > 0
        UNION ALL SELECT doc_id, 'page_marks', 'medium' FROM x WHERE regexp_matches(text, '\[Page [0-9]+\]|\bPage [0-9]+ of [0-9]+\b') UNION ALL SELECT doc_id, 'other_script', 'critical' FROM x WHERE own = 0""",
    "p17_section_pairs": """SELECT o_orderkey AS doc_id, pos::INT AS pos, question, answer FROM (
        SELECT o_orderkey, 0 AS pos, 'What does ' || o_orderpriority || ' cover?' AS question, 'status: ' || o_orderstatus || '; ' || o_orderpriority AS answer FROM orders
        UNION ALL SELECT o_orderkey, 1, 'What is status?', o_orderstatus FROM orders UNION ALL SELECT o_orderkey, 2, 'What does ' || o_orderpriority || ' say about status?', 'status: ' || o_orderstatus FROM orders
        UNION ALL SELECT o_orderkey, 3, 'Does ' || o_orderpriority || ' include ' || o_orderpriority || '?', 'Yes: ' || o_orderpriority FROM orders)""",
    "p18_render": "WITH q AS (SELECT user_id AS doc_id, string_agg('Q: ' || event_type || chr(10) || 'A: ' || event_type, chr(10) ORDER BY event_id) AS qa FROM events GROUP BY 1), b AS (SELECT d.doc_id, coalesce(qa, '') AS qa, text FROM documents d LEFT JOIN q USING (doc_id)) SELECT doc_id, 'opt' AS variant, md5(qa) AS digest FROM b UNION ALL SELECT doc_id, 'suggestion', md5(qa || chr(10) || chr(10) || text) FROM b",
    "g11_feedback_pairs": f"WITH {FB} SELECT kb_id AS doc_id, query AS question, CASE feedback_type WHEN 'recall_missing' THEN 'Covered under: ' || query WHEN 'intent_wrong' THEN 'Meant: ' || coalesce(ic, 'unknown') ELSE 'Under review' END AS answer, min(trace_id) AS pos FROM f GROUP BY ALL",
    "a15_suggestions": f"WITH {FB}, r AS (SELECT *, row_number() OVER (PARTITION BY feedback_type, key ORDER BY ts, trace_id) AS r FROM k) SELECT feedback_type, key, count(*) AS n, CASE feedback_type WHEN 'recall_missing' THEN 'boost' WHEN 'intent_wrong' THEN 'intent' ELSE 'review' END AS rule_type, arg_min(action, r) AS action, string_agg(substring(query, 1, 50), '|' ORDER BY r) FILTER (r <= 5) AS queries FROM r GROUP BY feedback_type, key HAVING count(*) >= 3",
    "a15_remaining": f"WITH {FB} SELECT trace_id, feedback_type, key FROM k QUALIFY count(*) OVER (PARTITION BY feedback_type, key) < (SELECT count(*) // 25 FROM events)",
    "a16_effectiveness": "WITH a AS (SELECT user_id AS rule_id, count(*) AS used, count_if(event_type <> 'error') AS effective, round(avg(CASE WHEN event_type <> 'view' THEN value / 100 END), 9) AS mean_score FROM events GROUP BY 1), j AS (SELECT doc_id AS rule_id, coalesce(used, 0) AS used, coalesce(effective, 0)::BIGINT AS effective, mean_score, round(CASE WHEN used > 0 THEN effective::DOUBLE / used ELSE 0 END, 4) AS rate FROM documents LEFT JOIN a ON a.rule_id = doc_id) SELECT *, (used - effective)::BIGINT AS ineffective, CASE WHEN used = 0 THEN 'unused' WHEN rate >= 0.7 THEN 'effective' WHEN rate >= 0.4 THEN 'partial' ELSE 'ineffective' END AS status FROM j",
    "a16_recent": "SELECT user_id AS rule_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))::INT AS rank FROM events QUALIFY rank <= 20",
    "a17_histogram": "SELECT event_type AS feedback_type, intent_type, count(*) AS n, grouping_id(event_type, intent_type) AS level FROM (SELECT event_type, 'i' || (user_id % 3) AS intent_type FROM events) GROUP BY GROUPING SETS ((event_type), (intent_type), ())",
    "a18_effectiveness": "SELECT count(*) AS queries, count_if((conv_id % 5) / 4.0 > 0 OR conv_id % 3 = 0)::BIGINT AS effective, count_if(conv_id % 3 <> 0)::BIGINT AS ineffective FROM conversations WHERE role = 'user'",
    "t6_top_keywords": f"SELECT word, count(*) AS n FROM (SELECT unnest({KEY}) AS word FROM conversations WHERE role = 'user') WHERE length(word) >= 2 GROUP BY word ORDER BY n DESC, word LIMIT 20",
    "j4_rules": """WITH q AS (SELECT item_id, text, CASE WHEN item_id % 2 = 0 THEN 'howto' ELSE 'status' END AS intent, CASE WHEN item_id % 3 <> 0 THEN 'kb1' END AS kb FROM benchmark), r AS (SELECT n_nationkey AS k, lower(n_name[1:2]) AS w FROM nation)
        SELECT item_id AS query_id, k AS rule_id FROM q, r WHERE (k % 5 = 4 OR CASE WHEN k % 2 = 0 THEN contains(text, w) OR contains(text, 'th') ELSE contains(text, w) AND contains(text, 'th') END) AND (k % 3 <> 0 OR intent = 'howto') AND (k % 4 <> 0 OR kb IS NULL)""",
    "a21_requests": "SELECT event_type AS endpoint, count(*) AS n, count_if(user_id % 9 = 0)::BIGINT AS errors, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, max(value) AS longest, min(value) AS shortest FROM events GROUP BY 1",
    "a21_total": "SELECT count(*) AS n, round(avg((user_id % 9 = 0)::INT) * 100, 2) AS error_rate, round(avg(value), 4) AS mean FROM events",
    "w4_moving_mean": "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW), 9) AS moving FROM events",
    "f6_history": "WITH x AS (SELECT * FROM events WHERE user_id % 4 = 1 AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' AND (contains(event_type, 'view') OR contains(props, 'view'))) SELECT event_id AS trace_id, (SELECT count(*) FROM x) AS total FROM x ORDER BY ts DESC, event_id LIMIT 20 OFFSET 20",
    "a20_statistics": "SELECT count(*) AS total, count_if(ts::DATE = DATE '2024-01-10')::BIGINT AS today, round(avg(value), 2) AS mean_duration, round(avg((event_type <> 'error')::INT) * 100, 2) AS pass_rate, round(avg(value / 100), 4) AS mean_score FROM events",
    "s13_retention": "SELECT ts::DATE AS dt, count(*) AS n FROM events WHERE ts::DATE >= DATE '2024-01-20' GROUP BY 1",
    "f7_lines": "WITH l AS (SELECT event_id AS line_no, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' ELSE 'INFO' END AS level FROM events ORDER BY event_id DESC LIMIT 300) SELECT * FROM l WHERE level <> 'INFO'",
    "a19_inventory": "WITH k AS (SELECT DISTINCT source AS kb_id FROM documents UNION ALL SELECT r_name FROM region) SELECT kb_id, count(DISTINCT lang) AS files, count(doc_id) AS chunks FROM k LEFT JOIN documents ON source = kb_id GROUP BY kb_id",
    "s4_stored": "SELECT source AS kb_id, lang AS file_id, doc_id AS chunk_id FROM documents WHERE NOT (source = 'src1' AND lang = 'en') UNION ALL SELECT 'src1', 'en', vec_id + 1000000 FROM embeddings",
    "s4_deleted": "SELECT 'src1' AS kb_id, 'en' AS file_id, count(*) AS deleted FROM documents WHERE source = 'src1' AND lang = 'en'",
    "s4_postings": f"""WITH c AS (SELECT source AS kb_id, doc_id AS id, text FROM documents WHERE NOT (source = 'src1' AND lang = 'en') UNION ALL SELECT 'src1', vec_id + 1000000, 'word' || label FROM embeddings),
        p AS (SELECT DISTINCT kb_id, id, unnest({TOK.format("text")}) AS term FROM c) SELECT kb_id, count(DISTINCT term) AS terms, count(*) AS postings FROM p GROUP BY kb_id""",
    "s15_stored": "WITH b AS (SELECT source AS kb_id FROM documents UNION SELECT 'src' || n_nationkey FROM nation) SELECT kb_id, (SELECT count(*) FROM documents WHERE source = kb_id) AS chunks FROM b WHERE kb_id NOT IN (SELECT 'src' || n_nationkey FROM nation WHERE n_nationkey % 4 = 1)",
    "s4_replace": "SELECT source AS kb_id, lang AS file_id, doc_id AS chunk_id FROM documents WHERE NOT (source = 'src1' AND lang = 'en') UNION ALL SELECT 'src1', 'en', vec_id + 1000000 FROM embeddings",
    "s5_scan": "SELECT doc_id AS chunk_id, length(text)::INT AS n FROM documents WHERE source = 'src3'",
    "s6_pages": "SELECT source AS kb_id, doc_id AS chunk_id, (row_number() OVER w - 1) // 100 AS page, count(*) OVER (PARTITION BY source) AS total FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)",
    "s6_lookup": "SELECT source AS kb_id, doc_id AS chunk_id, lang AS file_name FROM documents WHERE doc_id IN (7, 100, 205, -1)",
    "s6_page": "SELECT doc_id AS chunk_id FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 100 OFFSET 100",
    "s15_create_drop": "SELECT DISTINCT source AS kb_id FROM documents WHERE source <> 'src2' UNION SELECT r_name FROM region",
    "j12_scenario": "WITH k AS (SELECT source AS kb_id, min(lang) AS s FROM documents GROUP BY 1) SELECT 'src' || (user_id % 30) AS kb_id, event_id AS query_id, coalesce(CASE WHEN event_type = 'view' THEN 'asked' END, s) AS scenario_id FROM events LEFT JOIN k ON k.kb_id = 'src' || (user_id % 30)",
}
ORACLES["j10_relations_default"] = ORACLES["j10_relations"].replace("HAVING s > 0.8)", "HAVING s > 0.4)").replace("s > 0.95 THEN", "s > 0.8 THEN")
ORACLES["u3_merge_duplicates"] = ORACLES["u3_merge"].replace("SELECT doc_id AS a, doc_id + 1 AS b FROM documents", f"SELECT a, b FROM ({ORACLES['j10_relations_default']}) WHERE relation = 'duplicate'")
ORACLES |= {f"{name}_all": ORACLES[name] for name in ("p18_render", "a15_remaining")}
