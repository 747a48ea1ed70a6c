"""Queries over text preparation, scope gates and parameters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerlens.functions import text as X
from answerlens.operators import lexicon, scope
from answerlens.operators.retrieve import effective_params, weight_warnings

TOK = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+')"
STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '[\x00-\x08\x0B-\x1F\x7F]', '', 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g')"


def chunk_sql(row: str, more: str = "", size: int = 512, overlap: int = 128) -> str:
    """P2 as recursive CTEs that end with chunks(doc_id, more, chunk_index, chunk); row: doc_id, text and more of a document."""
    also = f", {more}" if more else ""
    tail = f"substr(buffer, greatest(length(buffer) - {overlap} + 1, 1))"
    last = f"(CASE WHEN contains({tail}, '。') THEN length({tail}) - strpos(reverse({tail}), '。') ELSE length({tail}) - strpos(reverse({tail}), '.') END)"
    cut = f"(CASE WHEN (contains({tail}, '。') OR contains({tail}, '.')) AND {last} > 0 THEN substr({tail}, {last} + 2) ELSE {tail} END)"
    return rf"""doc AS (SELECT {row} FROM documents),
    split AS (SELECT doc_id{also}, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM doc),
    lines AS (SELECT doc_id{also}, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM split WHERE regexp_matches(line, '\S')),
    pack AS (
        SELECT doc_id{also}, 0::BIGINT AS i, '' AS buffer, 0::BIGINT AS used, []::VARCHAR[] AS done FROM doc
        UNION ALL
        SELECT p.doc_id{also.replace(", ", ", p.")}, p.i + 1,
            CASE WHEN used + length(line) <= {size} THEN CASE WHEN buffer = '' THEN line ELSE buffer || chr(10) || line END
                 WHEN buffer = '' THEN '' WHEN length(buffer) > {overlap} THEN {cut} || chr(10) || line ELSE line END,
            CASE WHEN used + length(line) <= {size} THEN used + length(line) + 1
                 WHEN buffer = '' THEN used WHEN length(buffer) > {overlap} THEN length({cut}) + 1 + length(line) ELSE length(line) END,
            CASE WHEN used + length(line) <= {size} THEN [] WHEN buffer <> '' THEN [buffer]
                 ELSE list_transform(range(0, length(line), {size - overlap}), lambda x: substr(line, x + 1, {size})) END
        FROM pack p JOIN lines l ON l.doc_id = p.doc_id AND l.i = p.i + 1),
    every AS (SELECT doc_id{also}, i, unnest(done) AS chunk, generate_subscripts(done, 1) AS j FROM pack
        UNION ALL SELECT doc_id{also}, i + 1, buffer, 1 FROM (SELECT * FROM pack QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1) WHERE buffer <> ''),
    chunks AS (SELECT doc_id{also}, (row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1)::INT AS chunk_index, chunk FROM every)"""


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_clean(spark, d):
    return t(spark, d, "documents").select("doc_id", X.clean_text(F.col("text")).alias("clean"))


def p3_warnings(spark, d):
    ext = F.when(F.pmod("doc_id", F.lit(2)) == 0, "pdf").otherwise("txt")
    return t(spark, d, "documents").select("doc_id", F.array_join(X.parse_warnings(F.col("text"), ext), ",").alias("warnings"))


def p5_sentence_key(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", X.sentence_key(F.col("text")).alias("key"))


def p6_tokens(spark, d):
    tok = X.tokens(F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.size(tok).alias("n_tokens"), F.size(F.array_distinct(tok)).alias("n_distinct"))


def p7_key_terms(spark, d):
    return t(spark, d, "benchmark").select("item_id", F.array_join(X.key_terms(F.col("text")), " ").alias("terms"))


def p8_keywords(spark, d):
    words = t(spark, d, "conversations").select(F.explode(X.keywords(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def p11_citations(spark, d):
    marked = F.concat(F.col("text"), F.lit(" [1] and [Doc 2], [chunk_3] [x]"))
    return t(spark, d, "conversations").select("conv_id", "turn", F.array_join(X.citations(marked), ",").alias("cited"))


def p12_topic_tokens(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", F.size(X.topic_tokens(F.col("text"))).cast("long").alias("n_topic"))


def p15_intent(spark, d):
    q = t(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    out = scope.intents(q, INTENTS)
    return out.select("conv_id", "turn", "intent", "confidence", F.size("time_constraints").cast("long").alias("n_time"))


INTENTS = (("howto", ("the", "how")), ("status", ("and", "when")), ("policy", ("que", "rule")))


def p20_disclaimer(spark, d):
    answers = t(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.concat(F.col("text"), F.lit(" Note:  check  this. Note: check this.")).alias("answer"), (F.pmod("turn", F.lit(2)) == 0).alias("low_quality"))
    return answers.select("conv_id", "turn", scope.disclaimer(F.col("answer"), F.col("low_quality"), "Note: check this.").alias("answer"))


def p21_params(spark, d):
    e = t(spark, d, "events")
    q = t(spark, d, "events").select(F.col("event_id").alias("query_id"), F.concat(F.lit("s"), F.pmod("user_id", F.lit(4)).cast("string")).alias("scenario_id"), F.when(F.col("event_type") == "view", F.round("value", 2)).alias("bm25_weight"), F.when(F.col("event_type") == "click", F.lit(0.0)).alias("vector_weight"), F.lit(None).cast("double").alias("similarity_threshold"), F.when(F.col("event_type") == "error", F.lit(0)).alias("top_k"))
    s = e.select(F.concat(F.lit("s"), F.pmod("user_id", F.lit(3)).cast("string")).alias("scenario_id")).distinct().withColumns({"bm25_weight": F.lit(0.7), "vector_weight": F.lit(None).cast("double"), "similarity_threshold": F.when(F.col("scenario_id") == "s1", F.lit(0.3)), "top_k": F.lit(7)})
    out = effective_params(q, s)
    return out.select("query_id", "eff_bm25_weight", "eff_vector_weight", "eff_similarity_threshold", "eff_top_k")


def p22_weight_lint(spark, d):
    v = t(spark, d, "events").select(F.col("event_id").alias("variant_id"), F.when(F.col("event_type") == "view", "bm25").otherwise("hybrid").alias("mode"), F.lit(0.4).alias("bm25_weight"), (F.pmod("event_id", F.lit(10)) / 10.0).alias("vector_weight"), F.lit(0.5).alias("similarity_threshold"))
    return weight_warnings(v).select("variant_id", F.array_join("warnings", ",").alias("warnings"))


def p24_vector_profile(spark, d):
    p = X.vector_profile(F.col("embedding"))
    return t(spark, d, "embeddings").select("vec_id", p["dim"].alias("dim"), F.round(p["low"], 6).alias("low"), F.round(p["high"], 6).alias("high"), F.round(p["mean"], 6).alias("mean"))


def p25_suggestions(spark, d):
    out = lexicon.suggestions(t(spark, d, "benchmark").select(F.col("item_id").alias("kb_id"), F.col("text").alias("summary")))
    return out.select("kb_id", F.array_join("suggestions", "|").alias("suggestions"))


def s10_dictionary_edits(spark, d):
    words = t(spark, d, "documents").select("source", F.explode(F.slice(X.tokens(F.col("text")), 1, 2)).alias("word")).distinct()
    base = words.select(F.col("word").alias("term"), F.col("source").alias("synonym"))
    added = lexicon.add(base, base.select("term", F.lit("extra").alias("synonym")).distinct())
    out = lexicon.remove(added, base.where("synonym = 'src1'"))
    return out.select("term", F.array_join(F.array_sort("synonyms"), ",").alias("synonyms"))


def j11_expand(spark, d):
    syn = lexicon.table(t(spark, d, "nation").select(F.lower("n_name").alias("term"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("synonym")).unionByName(spark.createDataFrame([("the", "das"), ("of", "von")], "term string, synonym string")))
    q = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return lexicon.expand(q, syn).select("query_id", F.array_join("terms", " ").alias("terms"))


def f3_keyword_gate(spark, d):
    q = t(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    return scope.keyword_gate(q, ("tion",), ("que", "XX")).select("conv_id", "turn", "in_scope", "confidence")


def f9_refusal(spark, d):
    a = t(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    return a.select("conv_id", "turn", scope.refusal(F.col("answer"), ("the", "cannot answer")).alias("refusal"))


def c3_severity(spark, d):
    e = t(spark, d, "events").select("event_id", F.element_at(F.array(F.lit("date"), F.lit("percent"), F.lit("number")), (F.pmod("event_id", F.lit(3)) + 1).cast("int")).alias("kind"), F.col("value").alias("delta"), (F.col("value") / 100).alias("relative"))
    return e.select("event_id", "kind", X.severity(F.col("kind"), F.col("delta"), F.col("relative")).alias("severity"))


def c5_number(spark, d):
    return t(spark, d, "orders").select("o_orderkey", X.number(F.format_number(F.col("o_totalprice").cast("double"), 2)).alias("value"))


def c2_preview(spark, d):
    return t(spark, d, "documents").select("doc_id", X.preview(F.col("text"), 100).alias("preview"))


QUERIES = {f.__name__: f for f in (p1_clean, p3_warnings, p5_sentence_key, p6_tokens, p7_key_terms, p8_keywords, p11_citations, p12_topic_tokens, p15_intent, p20_disclaimer, p21_params, p22_weight_lint, p24_vector_profile, p25_suggestions, s10_dictionary_edits, j11_expand, f3_keyword_gate, f9_refusal, c2_preview, c3_severity, c5_number)}

KEY = f"list_filter({TOK.format('text')}, lambda x: NOT list_contains({STOP}, x) AND NOT regexp_full_match(x, '[0-9]+'))"
ORACLES = {
    "p1_clean": f"SELECT doc_id, {CLEAN} AS clean FROM documents",
    "p3_warnings": r"""SELECT doc_id, array_to_string(list_filter([
        CASE WHEN length(text) = 0 THEN 'empty' END,
        CASE WHEN doc_id % 2 = 0 AND length(text) < 50 THEN 'pdf_too_short' END,
        CASE WHEN doc_id % 2 = 0 AND len(regexp_extract_all(text, '\[Page [0-9]+\]')) > 1 AND length(text) < 200 THEN 'pdf_sparse' END,
        CASE WHEN doc_id % 2 = 0 AND len(regexp_extract_all(text, '\[Page [0-9]+\]')) > 0 AND length(regexp_replace(text, '\[Page [0-9]+\]|[ \t\r\n]+', '', 'g')) = 0 THEN 'pdf_only_page_marks' END,
        CASE WHEN length(text) > 0 AND length(text) < 100 THEN 'short' END], lambda x: x IS NOT NULL), ',') AS warnings FROM documents""",
    "p5_sentence_key": r"SELECT conv_id, turn, trim(regexp_replace(text, '[ \t\r\n\f\x0B]+', ' ', 'g')) AS key FROM conversations",
    "p6_tokens": f"SELECT doc_id, len({TOK.format('text')})::INT AS n_tokens, len(list_distinct({TOK.format('text')}))::INT AS n_distinct FROM documents",
    "p7_key_terms": f"SELECT item_id, array_to_string({KEY}, ' ') AS terms FROM benchmark",
    "p8_keywords": f"SELECT word, count(*) AS n FROM (SELECT unnest({KEY}) AS word FROM conversations) WHERE length(word) >= 2 GROUP BY word",
    "p11_citations": r"SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(text || ' [1] and [Doc 2], [chunk_3] [x]', '\[(?i:(?:doc(?:ument)?\s*|chunk_|文档\s*)?(\d+))\]', 1), lambda x: CAST(x AS INT)), ',') AS cited FROM conversations",
    "p12_topic_tokens": f"SELECT conv_id, turn, len(list_distinct(list_filter({TOK.format('text')}, lambda x: length(x) > 1 AND NOT list_contains({STOP}, x)))) AS n_topic FROM conversations",
    "p15_intent": r"""SELECT conv_id, turn,
        CASE WHEN contains(lower(text), 'the') OR contains(lower(text), 'how') THEN 'howto' WHEN contains(lower(text), 'and') OR contains(lower(text), 'when') THEN 'status' WHEN contains(lower(text), 'que') OR contains(lower(text), 'rule') THEN 'policy' ELSE 'other' END AS intent,
        CASE WHEN regexp_matches(lower(text), 'the|how|and|when|que|rule') THEN 0.7 ELSE 0.3 END::DOUBLE AS confidence,
        len(regexp_extract_all(lower(text), '\b(?:today|yesterday|tomorrow|(?:last|this|next) (?:day|week|month|quarter|year)|(?:19|20)[0-9]{2}(?:-[0-9]{2}){0,2})\b')) AS n_time FROM conversations WHERE role = 'user'""",
    "p20_disclaimer": r"""SELECT conv_id, turn, 'Note: check this. ' || trim(regexp_replace(text || ' Note:  check  this. Note: check this.', '\s*Note:\s+check\s+this\.\s*', ' ', 'g')) AS answer FROM conversations WHERE role = 'assistant'""",
    "p21_params": """WITH s AS (SELECT DISTINCT 's' || (user_id % 3) AS scenario_id, 0.7::DOUBLE AS bw, CASE WHEN user_id % 3 = 1 THEN 0.3::DOUBLE END AS st, 7 AS tk FROM events WHERE event_id < 500),
        q AS (SELECT event_id AS query_id, 's' || (user_id % 4) AS scenario_id, CASE WHEN event_type = 'view' THEN round(value, 2) END AS b, CASE WHEN event_type = 'click' THEN 0.0::DOUBLE END AS v, CASE WHEN event_type = 'error' THEN 0 END AS k FROM events),
        e AS (SELECT q.*, s.st, s.tk, coalesce(b, CASE WHEN v IS NOT NULL THEN round(1 - v, 4) END, s.bw, 0.6::DOUBLE) AS eb FROM q LEFT JOIN s USING (scenario_id))
        SELECT query_id, eb AS eff_bm25_weight, coalesce(v, round(1 - eb, 4)) AS eff_vector_weight, coalesce(st, 0.5::DOUBLE) AS eff_similarity_threshold, coalesce(k, tk, 5)::INT AS eff_top_k FROM e""",
    "p22_weight_lint": """SELECT event_id AS variant_id, CASE WHEN event_type = 'view' THEN '' WHEN (event_id % 10) / 10.0 < 0.5 THEN 'bm25_weight_below_threshold,vector_weight_below_threshold' ELSE 'bm25_weight_below_threshold' END AS warnings FROM events""",
    "p24_vector_profile": "SELECT vec_id, len(embedding)::INT AS dim, round(list_min(embedding)::DOUBLE, 6) AS low, round(list_max(embedding)::DOUBLE, 6) AS high, round(list_sum(embedding::DOUBLE[]) / len(embedding), 6) AS mean FROM embeddings",
    "p25_suggestions": f"""WITH k AS (SELECT item_id AS kb_id, list_filter({KEY}, lambda x: length(x) >= 2)[1:2] AS t FROM benchmark)
        SELECT kb_id, array_to_string(list_concat(list_transform(t, lambda x: 'What is ' || x || '?'), list_transform(t, lambda x: 'How does ' || x || ' work?'), ['What does this collection cover?'])[1:5], '|') AS suggestions FROM k""",
    "s10_dictionary_edits": f"""WITH w AS (SELECT DISTINCT source, unnest({TOK.format('text')}[1:2]) AS term FROM documents), b AS (SELECT term, source AS synonym FROM w UNION SELECT term, 'extra' FROM w)
        SELECT term, string_agg(synonym, ',' ORDER BY synonym) AS synonyms FROM b WHERE synonym <> 'src1' GROUP BY term""",
    "j11_expand": f"""WITH s AS (SELECT lower(n_name) AS term, 'n' || n_nationkey AS synonym FROM nation UNION ALL VALUES ('the', 'das'), ('of', 'von')),
        q AS (SELECT item_id AS query_id, unnest({TOK.format('text')}) AS term, generate_subscripts({TOK.format('text')}, 1) AS i FROM benchmark),
        e AS (SELECT query_id, i, term FROM q UNION ALL SELECT q.query_id, i + 0.5, s.synonym FROM q JOIN s USING (term))
        SELECT query_id, string_agg(term, ' ' ORDER BY i) AS terms FROM e GROUP BY query_id""",
    "f3_keyword_gate": "SELECT conv_id, turn, CASE WHEN contains(text, 'que') OR contains(text, 'XX') THEN false WHEN contains(text, 'tion') THEN true END AS in_scope, CASE WHEN contains(text, 'que') OR contains(text, 'XX') THEN 0.0 WHEN contains(text, 'tion') THEN 0.8 END::DOUBLE AS confidence FROM conversations WHERE role = 'user'",
    "f9_refusal": "SELECT conv_id, turn, trim(text) = '' OR (contains(lower(text), 'the') AND (3 >= 0.4 * length(text) OR length(text) <= 120)) OR (contains(lower(text), 'cannot answer') AND (13 >= 0.4 * length(text) OR length(text) <= 120)) AS refusal FROM conversations WHERE role = 'assistant'",
    "c2_preview": "SELECT doc_id, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS preview FROM documents",
    "c3_severity": """SELECT event_id, ['date', 'percent', 'number'][event_id % 3 + 1] AS kind, CASE WHEN event_id % 3 = 0 THEN CASE WHEN value >= 7 THEN 'high' WHEN value >= 2 THEN 'medium' ELSE 'low' END
        ELSE CASE WHEN CASE WHEN event_id % 3 = 1 THEN greatest(value / 100, value / 50) ELSE value / 100 END >= 0.5 THEN 'high' WHEN CASE WHEN event_id % 3 = 1 THEN greatest(value / 100, value / 50) ELSE value / 100 END >= 0.2 THEN 'medium' ELSE 'low' END END AS severity FROM events""",
    "c5_number": "SELECT o_orderkey, o_totalprice::DOUBLE AS value FROM orders",
}
