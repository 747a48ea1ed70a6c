"""Scope gates, intents, refusals and disclaimers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIME = r"\b(?:today|yesterday|tomorrow|(?:last|this|next) (?:day|week|month|quarter|year)|(?:19|20)[0-9]{2}(?:-[0-9]{2}){0,2})\b"
REGION = r"\b(?:in|within|across) ((?:[A-Z]\w+)(?: [A-Z]\w+)*)"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)) if words else F.lit(False)


def keyword_gate(queries: DataFrame, allow: tuple[str, ...], deny: tuple[str, ...]) -> DataFrame:
    """in_scope and confidence, null where no list has a word of the query; the deny list wins."""
    bad, good = _any(F.col("query"), deny), _any(F.col("query"), allow)
    return queries.withColumn("in_scope", F.when(bad, False).when(good, True)).withColumn("confidence", F.when(bad, 0.0).when(good, 0.8))


def retrieval_gate(queries: DataFrame, results: DataFrame, floor: float = 0.3) -> DataFrame:
    """results(query_id, score) -> out with confidence 0 without results, out with the mean score below the floor, else silent."""
    mean = results.groupBy("query_id").agg(F.round(F.avg("score"), 6).alias("mean_score"))
    out = queries.join(mean, "query_id", "left")
    low = F.coalesce(F.col("mean_score") < floor, F.lit(True))
    return out.withColumn("retrieval_in", F.when(low, False)).withColumn("retrieval_confidence", F.when(low, F.coalesce("mean_score", F.lit(0.0))))


def verdict(queries: DataFrame, enabled: bool = True) -> DataFrame:
    """the keyword verdict decides; else a vote of semantic (optional columns) and retrieval; no evidence is in with 0.7."""
    if not enabled:
        return queries.withColumns({"in_scope": F.lit(True), "confidence": F.lit(1.0), "decided_by": F.lit("disabled")})
    sides = [(n, F.col(f"{n}_in"), F.col(f"{n}_confidence")) for n in ("semantic", "retrieval") if f"{n}_in" in queries.columns]
    votes = F.array_compact(F.array(*[F.when(i.isNotNull(), F.struct(i.alias("i"), c.alias("c"))) for _, i, c in sides]))
    n = F.size(votes)
    inside = F.size(F.filter(votes, lambda v: v["i"]))
    mean = F.aggregate(votes, F.lit(0.0), lambda s, v: s + v["c"]) / n
    by_word = F.col("keyword_in").isNotNull()
    return queries.withColumns({
        "in_scope": F.when(by_word, F.col("keyword_in")).when(n == 0, True).otherwise(inside >= n / 2),
        "confidence": F.when(by_word, F.col("keyword_confidence")).when(n == 0, 0.7).otherwise(F.round(mean, 6)),
        "decided_by": F.when(by_word, "keyword").when(n == 0, "default").otherwise("vote"),
    })


def intents(queries: DataFrame, table: tuple[tuple[str, tuple[str, ...]], ...]) -> DataFrame:
    """The first intent with a word in the query, and its time and region constraints."""
    low = F.lower("query")
    name, hit = F.lit("other"), F.lit(False)
    for intent, words in reversed(table):
        name = F.when(_any(low, words), intent).otherwise(name)
        hit = hit | _any(low, words)
    return queries.withColumns({
        "intent": name,
        "confidence": F.when(hit, 0.7).otherwise(0.3),
        "time_constraints": F.regexp_extract_all(low, F.lit(TIME), F.lit(0)),
        "region_constraints": F.regexp_extract_all(F.col("query"), F.lit(REGION), F.lit(1)),
    })


def refusal(answer: Column, phrases: tuple[str, ...]) -> Column:
    """a blank answer, or one that a refusal phrase makes up: 0.4 of it or 120 characters in all."""
    low = F.lower(answer)
    hit = F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p) & ((F.length(p) >= 0.4 * F.length(answer)) | (F.length(answer) <= 120)))
    return (F.trim(answer) == "") | hit


def disclaimer(answer: Column, low_quality: Column, sentence: str) -> Column:
    """P20: repeated copies of the sentence become one leading copy; where it is missing, low quality gets one."""
    pattern = r"\s*" + r"\s+".join(map(re.escape, sentence.split())) + r"\s*"
    rest = F.trim(F.regexp_replace(answer, pattern, " "))
    return F.when(answer.rlike(pattern) | low_quality, F.concat(F.lit(sentence + " "), rest)).otherwise(answer)


def prompts(queries: DataFrame, context: DataFrame, high: float = 0.4) -> DataFrame:
    """context(query_id, rank, source, text, score) -> numbered blocks and the quality label of each query."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("source"), F.lit(" ("), F.format_number("score", 2), F.lit(")\n"), F.col("text"))
    packed = context.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"), F.avg("score").alias("mean_score"))
    out = queries.join(packed, "query_id", "left")
    quality = F.when(F.col("context").isNull(), "none").when(F.col("mean_score") > high, "high").otherwise("low")
    return out.withColumn("quality", quality).withColumn("prompt", F.concat(F.coalesce("context", F.lit("No context was found.")), F.lit("\n\nQuestion: "), F.col("query")))
