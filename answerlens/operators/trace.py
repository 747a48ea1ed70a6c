"""Attribution of answer sentences to their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerlens.functions.text import citations, cosine, hashed_vector, sentence_key
from answerlens.functions.text_udf import sentences
from answerlens.session import kept

FINE, COARSE = 1.0, 0.8
LOW, SUMMARY, QUOTE = 0.35, 0.55, 0.75
SUMMARY_RANK, QUOTE_RANK = 0.75, 0.90


def spans(answers: DataFrame, column: str = "answer") -> DataFrame:
    """P4 over a table: trace_id, idx, sentence, start, end, closed, cited."""
    each = answers.select("trace_id", F.posexplode(sentences(F.col(column))).alias("idx", "s"))
    return each.select("trace_id", "idx", F.col("s.text").alias("sentence"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.closed").alias("closed"), citations(F.col("s.text")).alias("cited"))


def embed(texts: DataFrame, column: str, embedder=hashed_vector) -> DataFrame:
    """Every distinct text once: column, vec (E1: embedder is a function of a column)."""
    return texts.select(column).distinct().withColumn("vec", embedder(F.col(column)))


def resolve_citations(sentence_rows: DataFrame, context: DataFrame) -> DataFrame:
    """Markers of all sentences in order of appearance, with the chunk they point at or null."""
    each = sentence_rows.select("trace_id", "idx", F.posexplode("cited").alias("pos", "number"))
    first = each.groupBy("trace_id", "number").agg(F.min(F.struct("idx", "pos")).alias("at"))
    return first.join(context.select("trace_id", F.col("rank").alias("number"), "chunk_id"), ["trace_id", "number"], "left").select("trace_id", "number", "chunk_id", F.col("chunk_id").isNotNull().alias("valid"), "at.idx", "at.pos")


def citation_coverage(sentence_rows: DataFrame, context: DataFrame) -> DataFrame:
    """A4: share of sentences with a marker in 1..n."""
    n = context.groupBy("trace_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    j = sentence_rows.join(n, "trace_id", "left")
    ok = F.exists("cited", lambda c: (c >= 1) & (c <= F.coalesce(F.col("n"), F.lit(0))))
    return j.groupBy("trace_id").agg(F.round(F.avg(ok.cast("int")), 6).alias("citation_coverage"))


def similarity(sentence_rows: DataFrame, context: DataFrame, embedder=hashed_vector) -> DataFrame:
    """trace_id, idx, chunk_id, score and the closest fragment: the best sentence of a chunk, or the whole chunk at 0.8."""
    parts = context.select("trace_id", "chunk_id", F.explode(sentences(F.col("text"))).alias("p")).select("trace_id", "chunk_id", F.col("p.text").alias("fragment"))
    whole = context.select("trace_id", "chunk_id", F.col("text").alias("fragment"))
    vec = lambda df, c, name: df.join(embed(df, c, embedder).select(F.col(c), F.col("vec").alias(name)), c)
    s = vec(sentence_rows.select("trace_id", "idx", "sentence"), "sentence", "sv")
    fine = s.join(vec(parts, "fragment", "fv"), "trace_id").withColumn("c", F.greatest(F.lit(0.0), cosine(F.col("sv"), F.col("fv"))))
    fine = fine.groupBy("trace_id", "idx", "chunk_id").agg(F.max(F.struct("c", "fragment")).alias("best"))
    coarse = s.join(vec(whole, "fragment", "fv"), "trace_id").select("trace_id", "idx", "chunk_id", F.greatest(F.lit(0.0), cosine(F.col("sv"), F.col("fv"))).alias("whole"))
    fused = F.bround(F.greatest(FINE * F.coalesce("best.c", F.lit(0.0)), COARSE * F.coalesce("whole", F.lit(0.0))), 4)
    return fine.join(coarse, ["trace_id", "idx", "chunk_id"], "full").select("trace_id", "idx", "chunk_id", fused.alias("score"), F.col("best.fragment").alias("fragment")).where("score > 0")


def rank_ratio(rows: DataFrame) -> DataFrame:
    """rows(trace_id, idx, score): share of the answer's scored sentences at or below, ties at the low value; null score, no rank."""
    w = Window.partitionBy("trace_id", F.col("score").isNull())
    ratio = F.rank().over(w.orderBy("score")) / F.count(F.lit(1)).over(w)
    return rows.withColumn("rank_ratio", F.when(F.col("score").isNotNull(), ratio)).withColumn("scored", F.count("score").over(Window.partitionBy("trace_id")))


def level(score: Column, ratio: Column, n: Column, cited: Column, verified: Column) -> Column:
    """How well a sentence is grounded."""
    absolute = F.when(score >= QUOTE, "direct_quote").when(score >= SUMMARY, "summary").when(score >= LOW, "low_confidence").otherwise("drift")
    relative = F.when(score < LOW, "drift").when((score >= QUOTE) & (ratio >= QUOTE_RANK), "direct_quote").when((score >= SUMMARY) & (ratio >= SUMMARY_RANK), "summary").otherwise("low_confidence")
    return F.when(cited, "citation_verified").when(~verified, "unverified").when(score.isNull(), "no_source").when(n < 3, absolute).otherwise(relative)


def top_sources(similar: DataFrame, cited: DataFrame, k: int = 3) -> DataFrame:
    """T4: the best sources of each sentence, cited ones first even if they share nothing."""
    both = similar.join(cited.withColumn("is_cited", F.lit(True)), ["trace_id", "idx", "chunk_id"], "full").fillna({"is_cited": False, "score": 0.0})
    w = Window.partitionBy("trace_id", "idx").orderBy(F.desc("is_cited"), F.desc("score"), "chunk_id")
    best = both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return best.groupBy("trace_id", "idx").agg(F.array_sort(F.collect_list(F.struct("place", "chunk_id", "score", "is_cited", "fragment"))).alias("sources"))


def trace(answers: DataFrame, context: DataFrame, embedder=hashed_vector) -> DataFrame:
    """answers(trace_id, answer), context(trace_id, rank, chunk_id, text) -> one row for each sentence."""
    s = kept(spans(answers))
    cited = s.select("trace_id", "idx", F.explode(F.array_distinct("cited")).alias("rank")).join(context.select("trace_id", "rank", "chunk_id"), ["trace_id", "rank"], "left")
    valid = cited.where("chunk_id IS NOT NULL").select("trace_id", "idx", "chunk_id")
    bad = cited.where("chunk_id IS NULL").groupBy("trace_id", "idx").agg(F.sort_array(F.collect_set("rank")).alias("invalid"))
    similar = kept(similarity(s, context, embedder))
    best = similar.groupBy("trace_id", "idx").agg(F.max("score").alias("score"))
    known = embed(s, "sentence", embedder).select("sentence", F.col("vec").isNotNull().alias("verified"))
    rows = s.join(best, ["trace_id", "idx"], "left").join(valid.select("trace_id", "idx").distinct().withColumn("is_cited", F.lit(True)), ["trace_id", "idx"], "left").join(known, "sentence").join(bad, ["trace_id", "idx"], "left")
    ranked = rank_ratio(rows)
    grade = level(F.col("score"), F.col("rank_ratio"), F.col("scored"), F.coalesce("is_cited", F.lit(False)), F.col("verified"))
    return ranked.withColumn("level", grade).join(top_sources(similar, valid), ["trace_id", "idx"], "left").select("trace_id", "idx", "sentence", "start", "end", "closed", "score", "rank_ratio", "level", F.coalesce("invalid", F.array().cast("array<int>")).alias("invalid_citations"), "sources")


def drift(rows: DataFrame) -> DataFrame:
    """rows(trace_id, level) -> counts and rates; unverified is not drift."""
    n = F.count(F.lit(1))
    c = lambda *x: F.count_if(F.col("level").isin(*x))
    verified = n - c("unverified")
    return rows.groupBy("trace_id").agg(n.alias("n"), c("drift").alias("drift"), c("unverified").alias("unverified"), F.round(c("drift") / n, 4).alias("drift_rate"), F.round(F.when(verified > 0, c("drift") / verified).otherwise(0.0), 4).alias("verified_drift_rate"), F.round(c("unverified") / n, 4).alias("unverified_rate"), F.round(c("direct_quote", "citation_verified") / n, 4).alias("high_confidence_rate"))


def hallucination(sentence_rows: DataFrame, context: DataFrame, embedder=hashed_vector, floor: float = LOW) -> DataFrame:
    """A5 and the consistency of A6: share of sentences far from the joined context, their mean cosine; an embedding that fails is an error."""
    packed = context.groupBy("trace_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("joined"))
    j = sentence_rows.join(packed, "trace_id", "left").withColumn("c", cosine(embedder(F.col("sentence")), embedder(F.col("joined"))))
    failed = F.max(F.col("c").isNull().cast("int")) == 1
    return j.groupBy("trace_id").agg(F.when(~failed, F.round(F.avg((F.col("c") < floor).cast("int")), 6)).alias("hallucination_rate"), F.round(F.avg("c"), 6).alias("consistency"), F.when(failed, "embedding failed").alias("error"))


def semantic(answers: DataFrame, context: DataFrame, embedder=hashed_vector) -> DataFrame:
    """Faithfulness cos(answer, context), relevance cos(query, answer)."""
    packed = context.groupBy("trace_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("joined"))
    j = answers.join(packed, "trace_id", "left")
    a = embedder(F.col("answer"))
    return j.select("trace_id", F.round(cosine(a, embedder(F.col("joined"))), 6).alias("faithfulness"), F.round(cosine(embedder(F.col("query")), a), 6).alias("relevance"))


def without_chunks(context: DataFrame, excluded: DataFrame) -> DataFrame:
    """F8: the context as it would be without the chosen chunks, ranks closed up."""
    left = context.join(excluded, ["trace_id", "chunk_id"], "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("trace_id").orderBy("rank")))


def validate(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Valid, invalid and missing markers of whole answers."""
    each = answers.select("trace_id", F.explode(F.array_distinct(citations(F.col("answer")))).alias("rank"))
    n = context.groupBy("trace_id").agg(F.max("rank").alias("n"))
    got = each.groupBy("trace_id").agg(F.sort_array(F.collect_set("rank")).alias("c"))
    j = answers.select("trace_id").join(n, "trace_id", "left").join(got, "trace_id", "left").fillna({"n": 0}).withColumn("c", F.coalesce("c", F.array().cast("array<int>")))
    inside = lambda x: (x >= 1) & (x <= F.col("n"))
    every = F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>"))
    return j.select("trace_id", F.filter("c", inside).alias("valid"), F.filter("c", lambda x: ~inside(x)).alias("invalid"), F.array_except(every, F.col("c")).alias("missing"))


def normalised_key(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", sentence_key(F.col("sentence")))
