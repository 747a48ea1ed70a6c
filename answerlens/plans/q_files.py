"""Queries that write files in the shared folder and read them back, and joins of several operators, with their SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlens.operators import abtest, composite, corpus, lexicon
from answerlens.operators import evaluate as E
from answerlens.operators import index as I
from answerlens.plans.q_retrieval import asked, chunks, stored, vectors
from answerlens.plans.q_text import CLEAN, TOK, chunk_sql, t
from answerlens.session import shared_folder
from answerlens.sources import files
from answerlens.streaming import live


def place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def _array_files(rows: DataFrame, by, folder: str) -> None:
    """One file with a JSON array for each value of by."""
    packed = rows.groupBy(by.alias("part")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    packed.write.partitionBy("part").text(folder)


def s1_documents(spark, d):
    """All documents of a source as one text, which the tasks write in files side by side; read back line by line, as a text may be larger than what is admitted or held."""
    folder = place(spark, "s1")
    key = F.coalesce(F.concat(F.lit("is "), "source"), F.lit("none"))  # a folder's name can't be null or empty
    t(spark, d, "documents").select(key.alias("part"), F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("part").text(folder, lineSep="\n")
    source = F.when(F.col("part").startswith("is "), F.substr("part", F.lit(4)))
    return files.counts(spark, folder, "part").select(source.alias("source"), "char_count", "line_count", F.col("decode_error").isNull().alias("fine"))


def s2_admission(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("txt", "exe", "pdf", "docx", "md"))), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    head = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.lit("%PDF-1.4 ")).otherwise(F.lit(""))
    rows = t(spark, d, "documents").select("doc_id", F.concat(F.lit("/x/file."), kind).alias("path"), F.concat(head, "text").cast("binary").alias("content")).withColumn("length", F.length("content"))
    return files.admit(rows, most=5000).select("doc_id", "accepted", F.coalesce("reason", F.lit("")).alias("reason"))


def s7_traces(spark, d):
    """Traces written as JSON, read, saved by day and read again."""
    e = t(spark, d, "events").select(F.col("event_id").cast("string").alias("trace_id"), F.col("event_type").alias("query"), F.lit("success").alias("status"), F.col("value").alias("duration"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"))
    folder, saved = place(spark, "s7"), place(spark, "s7-saved")
    e.write.json(folder)
    files.save_traces(files.traces(spark, folder, lines=True).where("_corrupt_record IS NULL"), saved)
    return spark.read.parquet(saved).groupBy(F.col("dt").cast("date").alias("dt"), "query").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("duration"), 6).alias("longest"))


def s8_feedback(spark, d):
    e = t(spark, d, "events").select(F.col("event_id").cast("string").alias("trace_id"), F.col("event_type").alias("feedback_type"), F.create_map(F.lit("kind"), F.col("event_type")).alias("suggested_action"), F.pmod("user_id", F.lit(5)).cast("int").alias("answer_rating"))
    folder = place(spark, "s8")
    e.write.json(folder)
    return files.feedback(spark, folder, lines=True).groupBy("feedback_type", F.col("suggested_action")["kind"].alias("action"), "answer_rating").agg(F.count(F.lit(1)).alias("n"))


def s8_rules(spark, d):
    r = t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("rule_id"), F.array(F.lower("n_name"), F.lit("x")).alias("keywords"), F.lit("any").alias("match_type"))
    folder = place(spark, "s8-rules")
    _array_files(r, F.pmod(F.col("rule_id").cast("long"), F.lit(3)), folder)
    return files.rules(spark, folder).select("rule_id", F.array_join("keywords", ",").alias("keywords"), "match_type")


def s9_dictionary(spark, d):
    """Regions as terms with their nations as synonyms: a dictionary, so of bounded size; repeated values keep the first place."""
    rows = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").collect()
    mapping: dict = {}
    for r in rows:
        mapping.setdefault(r["r_name"], []).extend([r["n_name"], r["n_name"]])
    return lexicon.from_mapping(spark, mapping).select("term", F.array_join("synonyms", ",").alias("synonyms"))


def _log(spark, d) -> DataFrame:
    """Log lines of events: rule outcomes, contradictions and searches."""
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    message = (
        F.when(F.col("event_type") == "view", F.format_string("rule_id=r%d effective=%s", F.pmod("user_id", F.lit(20)), F.when(F.col("value") > 40, "true").otherwise("false")))
        .when(F.col("event_type") == "click", F.format_string("contradiction type=%s severity=%s", F.when(F.pmod("user_id", F.lit(2)) == 0, "money").otherwise("date"), F.when(F.col("value") > 50, "high").otherwise("low")))
        .otherwise(F.format_string("search mode=%s results=%d", F.when(F.pmod("user_id", F.lit(3)) == 0, "bm25").otherwise("hybrid"), F.pmod("event_id", F.lit(4))))
    )
    folder = place(spark, "log")
    t(spark, d, "events").select(F.concat_ws(" - ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), level, F.lit("core.rules"), message).alias("value")).write.text(folder)
    return files.log_lines(spark, folder)


def s11_log_lines(spark, d):
    return _log(spark, d).groupBy(F.to_date("ts").alias("dt"), "level", "module").agg(F.count(F.lit(1)).alias("n"))


def a22_log_summary(spark, d):
    s = files.log_summary(_log(spark, d))
    text = lambda *c: F.concat_ws("|", *c).alias("item")
    rules_ = s["rules"].select(F.lit("rule").alias("part"), text("rule_id", "status"), "n", F.col("rate").alias("share"))
    return rules_.unionByName(s["contradictions"].select(F.lit("contradiction").alias("part"), text("kind", "severity"), "n", "share")).unionByName(s["modes"].select(F.lit("mode").alias("part"), text("mode"), "n", F.col("success_rate").alias("share")))


def s12_reports(spark, d):
    folder = place(spark, "s12")
    e = t(spark, d, "events").select("event_id", "value", "event_type")
    for k, kind in enumerate(("view", "click")):
        files.save_report(e.where(F.col("event_type") == kind).drop("event_type"), folder, f"report-{kind}", f"2024-01-0{k + 1}")
    return files.reports(spark, folder).select("report_id", F.col("created_at").cast("string").alias("created_at"), "rows")


def s14_optimised(spark, d):
    folder = place(spark, "s14")
    docs = t(spark, d, "documents").select("doc_id", "text")
    qa = docs.select("doc_id", F.lit(0).alias("pos"), F.concat(F.lit("What is "), F.substring("text", 1, 20)).alias("question"), F.substring("text", 1, 50).alias("answer"))
    files.save_optimised(corpus.render(docs, qa), folder)
    return spark.read.parquet(folder).select("doc_id", "variant", F.md5("content").alias("digest"))


def j17_cross_questions(spark, d):
    """Neighbouring documents as related pairs; title and points are the first two lines of their texts."""
    docs = t(spark, d, "documents")
    line = lambda i: F.coalesce(F.get(F.split("text", "\n"), F.lit(i)), F.lit(""))
    s = docs.select("doc_id", line(0).alias("title"), F.array(line(1), F.col("lang")).alias("points"))
    pairs = docs.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    return corpus.cross_questions(s, pairs).select("a", "b", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


def g9_ab_run(spark, d):
    """Every benchmark passage under three settings; what is retrieved is scored for answers that repeat the whole passage."""
    v = vectors(spark, d)
    q = asked(spark, d).join(v.withColumnRenamed("chunk_id", "query_id"), "query_id", "left")
    every = chunks(spark, d)
    variants = spark.createDataFrame([("a", "hybrid", 0.6, 0.4, 0.5, 5), ("b", "bm25", 1.0, 0.0, 0.2, 5), ("c", "hybrid", 0.3, 0.7, 0.3, 3)], "variant_name string, mode string, bm25_weight double, vector_weight double, similarity_threshold double, top_k int")
    answers = q.select("query_id", F.concat("query", F.lit(" It is so [1].")).alias("answer"))
    runs = composite.ab_run(q, variants, every.join(v, "chunk_id", "left"), stored(spark, d), answers, E.rubric_table(spark))
    return abtest.by_variant(runs)


def x3_ingestion(spark, d):
    """Documents as a stream of files, a file a batch: chunked, indexed segment by segment; the statistics of every base at the end."""
    docs = spark.readStream.schema(t(spark, d, "documents").schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/documents.parque[t]")  # a file or a folder of files
    stream = docs.select(F.col("source").alias("kb_id"), "doc_id", "text")
    folder = place(spark, "x3")
    live.ingest(stream, f"{folder}/chunks", f"{folder}/index", f"{folder}/state").awaitTermination()
    terms = I.load(spark, f"{folder}/index").terms
    return terms.groupBy("kb_id").agg(F.round(F.max("avgdl"), 6).alias("avgdl"), F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"), F.round(F.max("idf"), 6).alias("rarest"))


QUERIES = {f.__name__: f for f in (s1_documents, s2_admission, s7_traces, s8_feedback, s8_rules, s9_dictionary, s11_log_lines, a22_log_summary, s12_reports, s14_optimised, j17_cross_questions, g9_ab_run, x3_ingestion)}

LOG = """l AS (SELECT ts, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, event_type AS k, user_id, event_id, value FROM events)"""
ORACLES = {
    "s1_documents": "SELECT source, sum(length(coalesce(text, '')) + 1)::BIGINT AS char_count, (sum(len(string_split(coalesce(text, ''), chr(10)))) + 1)::BIGINT AS line_count, true AS fine FROM documents GROUP BY source",
    "s2_admission": """WITH x AS (SELECT doc_id, doc_id % 5 AS k, doc_id % 2 = 0 AS pdf, strlen(text) + CASE WHEN doc_id % 2 = 0 THEN 9 ELSE 0 END AS n FROM documents),
        r AS (SELECT doc_id, CASE WHEN k = 1 THEN 'suffix' WHEN n > 5000 THEN 'size' WHEN k IN (0, 4) AND pdf OR k = 2 AND NOT pdf OR k = 3 THEN 'content' ELSE '' END AS reason FROM x) SELECT doc_id, reason = '' AS accepted, reason FROM r""",
    "s7_traces": "SELECT ts::DATE AS dt, event_type AS query, count(*) AS n, round(max(value), 6) AS longest FROM events GROUP BY ALL",
    "s8_feedback": "SELECT event_type AS feedback_type, event_type AS action, (user_id % 5)::INT AS answer_rating, count(*) AS n FROM events GROUP BY ALL",
    "s8_rules": "SELECT n_nationkey::VARCHAR AS rule_id, lower(n_name) || ',x' AS keywords, 'any' AS match_type FROM nation",
    "s9_dictionary": "SELECT r_name AS term, string_agg(n_name, ',' ORDER BY n_nationkey) AS synonyms FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "s11_log_lines": f"WITH {LOG} SELECT ts::DATE AS dt, level, 'core.rules' AS module, count(*) AS n FROM l GROUP BY ALL",
    "a22_log_summary": f"""WITH {LOG}, r AS (SELECT 'r' || (user_id % 20) AS id, count(*) AS n, round(avg((value > 40)::INT), 4) AS rate FROM l WHERE k = 'view' GROUP BY 1),
        c AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'money' ELSE 'date' END || '|' || CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS item, count(*) AS n FROM l WHERE k = 'click' GROUP BY 1),
        m AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'bm25' ELSE 'hybrid' END AS item, count(*) AS n, round(avg((event_id % 4 > 0)::INT), 4) AS share FROM l WHERE k NOT IN ('view', 'click') GROUP BY 1)
        SELECT 'rule' AS part, id || '|' || CASE WHEN rate >= 0.7 THEN 'effective' WHEN rate >= 0.4 THEN 'partial' ELSE 'ineffective' END AS item, n, rate AS share FROM r
        UNION ALL SELECT 'contradiction', item, n, round(n / sum(n) OVER (), 4) FROM c UNION ALL SELECT 'mode', item, n, share FROM m""",
    "s12_reports": "SELECT 'report-' || event_type AS report_id, CASE event_type WHEN 'view' THEN '2024-01-01' ELSE '2024-01-02' END AS created_at, count(*) AS rows FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL",
    "s14_optimised": "WITH q AS (SELECT doc_id, text, 'Q: What is ' || substring(text, 1, 20) || chr(10) || 'A: ' || substring(text, 1, 50) AS qa FROM documents) SELECT doc_id, 'opt' AS variant, md5(qa) AS digest FROM q UNION ALL SELECT doc_id, 'suggestion', md5(qa || chr(10) || chr(10) || text) FROM q",
    "j17_cross_questions": """WITH s AS (SELECT doc_id, string_split(text, chr(10))[1] AS t, coalesce(string_split(text, chr(10))[2], '') || '; ' || lang AS p FROM documents)
        SELECT a.doc_id AS a, b.doc_id AS b, md5('How do ' || a.t || ' and ' || b.t || ' relate?') AS question, md5(a.t || ': ' || a.p || chr(10) || b.t || ': ' || b.p) AS answer FROM s a JOIN s b ON b.doc_id = a.doc_id + 1""",
    "x3_ingestion": f"""WITH RECURSIVE {chunk_sql("doc_id, source AS kb_id, " + CLEAN + " AS text", "kb_id")},
        tok AS (SELECT kb_id, doc_id, chunk_index, unnest({TOK.format("chunk")}) AS term FROM chunks), tf AS (SELECT DISTINCT * FROM tok),
        corpus AS (SELECT kb_id, count(*) AS n, avg(len({TOK.format("chunk")})) AS avgdl FROM chunks GROUP BY kb_id),
        df AS (SELECT kb_id, term, count(*) AS df FROM tf GROUP BY ALL),
        raw AS (SELECT d.*, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df d JOIN corpus c ON c.kb_id IS NOT DISTINCT FROM d.kb_id)
        SELECT kb_id, round(max(avgdl), 6) AS avgdl, count(*) AS terms, sum(df)::BIGINT AS postings, round(max(CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END), 6) AS rarest
        FROM (SELECT *, avg(raw) OVER (PARTITION BY kb_id) AS mean FROM raw) GROUP BY kb_id""",
}
