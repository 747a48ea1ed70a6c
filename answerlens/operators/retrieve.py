"""Hybrid retrieval for tables of queries over tables of chunks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from answerlens.functions.text import key_terms, preview, tokens
from answerlens.operators.blocks import QueryBlock, shards_of
from answerlens.operators.index import Index, term_score
from answerlens.session import kept


@dataclass(frozen=True)
class Params:
    """Shipped defaults; each can be overridden by scenario or query."""

    mode: str = "hybrid"
    bm25_weight: float = 0.6
    vector_weight: float = 0.4
    similarity_threshold: float = 0.5
    vector_floor: float = 0.1
    top_k: int = 5
    rerank_top_k: int = 10
    rerank_enabled: bool = True
    route_handover: bool = True
    budget: int = 2048


def effective_params(queries: DataFrame, scenarios: DataFrame, defaults: Params = Params()) -> DataFrame:
    """queries(query_id, scenario_id, overrides...) with the first defined value of query, scenario, default.

    Zero is a value.  An override of one weight alone derives the other.
    """
    names = ["bm25_weight", "vector_weight", "similarity_threshold", "top_k"]
    s = scenarios.select("scenario_id", *[F.col(n).alias(f"_{n}") for n in names])
    d = asdict(defaults)
    out = queries.join(s, "scenario_id", "left")
    b, v = F.col("bm25_weight"), F.col("vector_weight")
    derived_b = F.coalesce(b, F.when(v.isNotNull(), F.round(1 - v, 4)), F.col("_bm25_weight"), F.lit(d["bm25_weight"]))
    out = out.withColumn("eff_bm25_weight", derived_b).withColumn("eff_vector_weight", F.coalesce(v, F.round(1 - F.col("eff_bm25_weight"), 4)))
    for n in names[2:]:
        out = out.withColumn(f"eff_{n}", F.coalesce(F.col(n), F.col(f"_{n}"), F.lit(d[n])))
    return out.drop(*[f"_{n}" for n in names])


def weight_warnings(variants: DataFrame) -> DataFrame:
    """In hybrid mode a route whose weight is below the threshold cannot pass it alone."""
    hybrid = F.col("mode") == "hybrid"
    low = [F.when(hybrid & (F.col(f"{r}_weight") < F.col("similarity_threshold")), F.lit(f"{r}_weight_below_threshold")) for r in ("bm25", "vector")]
    return variants.withColumn("warnings", F.array_compact(F.array(*low)))


def top(df: DataFrame, k: int | Column, *order: Column, by: str | list[str] = "query_id", rank: str = "rank") -> DataFrame:
    """The first k of each group; planned with WindowGroupLimit."""
    w = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def bm25(queries: DataFrame, index: Index, k: int | None = 5) -> DataFrame:
    """J1 + W3 + T1: queries(query_id, kb_id, query) -> query_id, chunk_id, bm25_score, bm25_norm, rank (without k: all scores, no rank).

    The first k come from blocks (``search``).  All scores come from a join of query
    tokens with postings by term; AQE splits terms that most chunks have.
    """
    terms = queries.select("query_id", "kb_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "kb_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    if k is not None:
        total = top(search(terms, index, k), k, F.desc("bm25_score"), F.col("chunk_id"))
    else:
        weighed = terms.join(index.terms, ["kb_id", "term"])
        scored = weighed.join(index.postings, ["kb_id", "term"]).withColumn("s", F.col("qtf") * term_score())
        total = scored.groupBy("query_id", "chunk_id").agg(F.round(F.sum("s"), 6).alias("bm25_score")).where("bm25_score > 0")
    best = F.max("bm25_score").over(Window.partitionBy("query_id"))
    return total.withColumn("bm25_norm", F.round(F.col("bm25_score") / best, 6))


#: Query terms that one pass over the blocks takes along (about 100 bytes each).
PASS_TERMS = 200_000


def search(terms: DataFrame, index: Index, k: int) -> DataFrame:
    """J1 + T1: terms(query_id, kb_id, term, qtf) -> query_id, chunk_id, bm25_score: of each shard the best k that can still be among all shards' k.

    A stated query set against all blocks of its terms, PASS_TERMS of them at a time.
    """
    weighed = terms.join(index.terms.withColumnRenamed("kb_id", "_kb"), F.col("kb_id").eqNullSafe(F.col("_kb")) & (terms["term"] == index.terms["term"]))
    weighed = kept(weighed.select("query_id", "kb_id", terms["term"], (F.col("qtf") * F.col("idf")).alias("weight"), "avgdl"))
    n = max(1, -(-weighed.count() // PASS_TERMS))
    passes = [weighed.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)]
    return reduce(DataFrame.unionByName, [_search_pass(asked.collect(), asked, index, k) for asked in passes])  # about PASS_TERMS rows each


def _search_pass(rows: list, asked: DataFrame, index: Index, k: int) -> DataFrame:
    """One pass: each task takes its shards one after the other and passes by what cannot reach the k-th best score so far."""
    spark = asked.sparkSession
    q_kind, c_kind = asked.schema["query_id"].dataType, index.blocks.schema["chunk_ids"].dataType.elementType
    shared = spark.sparkContext.broadcast(QueryBlock(rows, k))
    of = asked.select(F.col("kb_id").alias("_kb"), F.col("term").alias("_term")).distinct()
    bases = of.select("_kb").distinct()
    some = index.blocks.where("term IS NOT NULL").join(F.broadcast(of), F.col("kb_id").eqNullSafe(F.col("_kb")) & (F.col("term") == F.col("_term")), "left_semi")
    who = index.blocks.where("term IS NULL").join(F.broadcast(bases), F.col("kb_id").eqNullSafe(F.col("_kb")), "left_semi")
    schema = T.StructType([T.StructField("query_id", q_kind), T.StructField("chunk_id", c_kind), T.StructField("bm25_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        state = block.start()
        for shard in shards_of(batches):
            found = block.best_of(shard, state)
            if found:
                ids, places, scores = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([block.query_ids.take(pa.array(ids)), shard[0]["chunk_ids"][0].values.take(pa.array(places)), pa.array(scores)], names=schema.names)

    return some.unionByName(who).repartition("shard", "kb_id").sortWithinPartitions("shard", "kb_id", F.col("term").asc_nulls_first()).mapInArrow(run, schema)


#: Components of all queries' vectors (8 bytes each) that tasks take along; beyond, queries go in blocks as well.
BROADCAST_COMPONENTS = 4_000_000


def knn(queries: DataFrame, chunks: DataFrame, k: int | None = 10, floor: float = 0.0) -> DataFrame:
    """J2 + F2 + T2: exact cosine, clipped at 0: queries(query_id, vec), chunks(chunk_id, vec); both ways compute it alike."""
    size = queries.agg(F.sum(F.size("vec"))).first()[0] or 0
    return knn_blocks(queries, chunks, k, floor) if size > BROADCAST_COMPONENTS else _knn_along(queries, chunks, k, floor)


def _units(vectors: list) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _best(scores: np.ndarray, k: int | None, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the scores from the floor on, of each row the best k with ties."""
    passing = scores >= floor
    if k is not None:
        most = min(k, scores.shape[1])
        passing &= scores >= np.partition(scores, scores.shape[1] - most, axis=1)[:, [scores.shape[1] - most]]
    return np.nonzero(passing)


def _knn_along(queries: DataFrame, chunks: DataFrame, k: int | None, floor: float) -> DataFrame:
    """All queries meet each batch of chunks, whose best k they keep."""
    rows = queries.select("query_id", "vec").collect()  # BROADCAST_COMPONENTS at most
    shared = queries.sparkSession.sparkContext.broadcast([(r["query_id"], r["vec"]) for r in rows])
    schema = T.StructType([queries.schema["query_id"], chunks.schema["chunk_id"], T.StructField("vector_score", T.DoubleType())])
    kind = to_arrow_type(queries.schema["query_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        ids = pa.array([q for q, _ in asked], kind)
        units = _units([v for _, v in asked]) if asked else None
        for batch in batches:
            if asked and batch.num_rows:
                x = _units(batch["vec"].to_numpy(zero_copy_only=False))
                for low in range(0, len(units), 256):
                    s = np.clip(units[low : low + 256] @ x.T, 0, None).round(6)
                    i, j = _best(s, k, floor)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i + low)), batch["chunk_id"].take(pa.array(j)), pa.array(s[i, j])], names=schema.names)

    found = chunks.select("chunk_id", "vec").mapInArrow(run, schema)
    return found if k is None else top(found, k, F.desc("vector_score"), F.col("chunk_id"))


def knn_blocks(queries: DataFrame, chunks: DataFrame, k: int | None = 10, floor: float = 0.0, block: int = 4096, rows: int = 50_000) -> DataFrame:
    """J2 (b): a stated query set of any size, in blocks: every block of queries meets every block of chunks in one task, which keeps its best k (all from the floor on where k is None)."""
    nq, nv = max(1, -(-queries.count() // block)), max(1, -(-chunks.count() // rows))
    q_kind, c_kind = dict(queries.dtypes)["query_id"], dict(chunks.dtypes)["chunk_id"]

    def side(df: DataFrame, own: str, n: int, place: str, other: str, m: int) -> DataFrame:
        ids = [F.col(c).alias(c) if c == own else F.lit(None).cast(kind).alias(c) for c, kind in (("query_id", q_kind), ("chunk_id", c_kind))]
        return df.select(*ids, F.lit(own == "query_id").alias("asks"), F.col("vec").cast("array<double>").alias("vec"), F.pmod(F.xxhash64(own), F.lit(n)).cast("int").alias(place), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"]
        a, b = pdf[asks], pdf[~asks]
        out = [pd.DataFrame({"query_id": a["query_id"].iloc[:0], "chunk_id": b["chunk_id"].iloc[:0], "vector_score": np.zeros(0)})]
        if len(a) and len(b):
            q, x = (_units(list(side["vec"])) for side in (a, b))
            for low in range(0, len(q), 256):
                s = np.clip(q[low : low + 256] @ x.T, 0, None).round(6)
                i, j = _best(s, k, floor)
                out.append(pd.DataFrame({"query_id": a["query_id"].to_numpy()[low + i], "chunk_id": b["chunk_id"].to_numpy()[j], "vector_score": s[i, j]}))
        return pd.concat(out)

    both = side(queries, "query_id", nq, "i", "j", nv).unionByName(side(chunks, "chunk_id", nv, "j", "i", nq))
    found = both.groupBy("i", "j").applyInPandas(meet, f"query_id {q_kind}, chunk_id {c_kind}, vector_score double")
    return found if k is None else top(found, k, F.desc("vector_score"), F.col("chunk_id"))


def fuse(bm25_rows: DataFrame, vector_rows: DataFrame, weights: DataFrame | None = None, params: Params = Params()) -> DataFrame:
    """J3 with the handover: query_id, chunk_id, bm25_score, vector_score, score, in_bm25, in_vector.

    Where a query has no BM25 candidate and its BM25 weight is above 0, the vector route gets the whole weight.
    """
    b = bm25_rows.select("query_id", "chunk_id", F.col("bm25_norm").alias("bm25_score"), F.lit(True).alias("in_bm25"))
    v = vector_rows.select("query_id", "chunk_id", "vector_score", F.lit(True).alias("in_vector"))
    both = b.join(v, ["query_id", "chunk_id"], "full_outer").fillna({"bm25_score": 0.0, "vector_score": 0.0, "in_bm25": False, "in_vector": False})
    if weights is None:
        both = both.withColumn("wb", F.lit(params.bm25_weight)).withColumn("wv", F.lit(params.vector_weight))
    else:
        both = both.join(weights.select("query_id", F.col("bm25_weight").alias("wb"), F.col("vector_weight").alias("wv")), "query_id")
    routed = F.max("in_bm25").over(Window.partitionBy("query_id"))
    over = ~routed & (F.col("wb") > 0) & F.lit(params.route_handover)
    both = both.withColumn("handover", over)
    score = F.when(over, F.col("vector_score")).otherwise(F.col("bm25_score") * F.col("wb") + F.col("vector_score") * F.col("wv"))
    return both.withColumn("score", F.round(score, 6)).drop("wb", "wv")


SUMMARY = ("summary", "summarize", "overview", "everything", "all")


def pieces(text: Column) -> Column:
    """Non-empty pieces between sentence marks and line ends."""
    return F.filter(F.split(text, "[。！？\n]"), lambda p: F.trim(p) != "")


def compress(rows: DataFrame, params: Params = Params(), summary_words: tuple[str, ...] = SUMMARY) -> DataFrame:
    """rows(query_id, query, chunk_id, rank, text) -> text within the query's budget of characters; chunks not reached are dropped."""
    bypass = F.exists(F.array(*map(F.lit, summary_words)), lambda w: F.contains(F.lower("query"), w))
    split = rows.withColumn("_bypass", bypass).withColumn("_p", pieces(F.col("text"))).withColumn("_whole", F.col("_bypass") | (F.size("_p") == 0))
    each = split.where("NOT _whole").select("query_id", "query", "chunk_id", "rank", F.posexplode("_p").alias("pos", "piece"))
    keep = (F.col("pos") < 2) | F.arrays_overlap(tokens(F.col("piece")), tokens(F.col("query")))
    before = Window.partitionBy("query_id").orderBy("rank", "pos").rowsBetween(Window.unboundedPreceding, -1)
    kept = each.where(keep).withColumn("used", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0))).where(F.col("used") < params.budget)
    joined = kept.groupBy("query_id", "chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "。").alias("compressed"))
    out = split.join(joined, ["query_id", "chunk_id"], "left")
    return out.withColumn("compressed", F.when(F.col("_whole"), F.col("text")).otherwise(F.col("compressed"))).where("compressed IS NOT NULL").drop("_bypass", "_p", "_whole")


#: Ids of chunks (about 50 bytes each) that are sent to the tasks which read the chunks.
BROADCAST_IDS = 200_000


def only(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks of ids(chunk_id); where these are few, the others' texts are not shuffled."""
    ids = kept(ids.select("chunk_id").distinct())
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return chunks.join(F.broadcast(ids) if few else ids, "chunk_id", "left_semi")


def stages(candidates: DataFrame, chunks: DataFrame, queries: DataFrame, params: Params = Params()) -> DataFrame:
    """G1 from fused candidates on: every candidate with the stages it passed, and its text where it was kept."""
    ranked = top(candidates, params.rerank_top_k if params.rerank_enabled else params.top_k, F.desc("score"), F.col("chunk_id"), rank="merged_rank")
    passed = ranked.withColumn("passed_threshold", F.col("score") >= params.similarity_threshold)
    texts = kept(only(chunks.select("chunk_id", "text"), passed.where("passed_threshold")))  # else pieces are looked for in all texts
    ahead = passed.where("passed_threshold").join(texts, "chunk_id").join(queries.select("query_id", "query"), "query_id").withColumnRenamed("merged_rank", "rank")
    packed = compress(ahead, params).select("query_id", "chunk_id", "compressed")
    out = passed.join(packed, ["query_id", "chunk_id"], "left").withColumn("passed_compression", F.col("compressed").isNotNull())
    w = Window.partitionBy("query_id").orderBy(F.desc("passed_compression"), F.desc("score"), "chunk_id")
    return out.withColumn("final_rank", F.when(F.col("passed_compression"), F.row_number().over(w))).withColumn("kept", F.coalesce(F.col("final_rank") <= params.top_k, F.lit(False)))


def funnel(staged: DataFrame, params: Params = Params()) -> DataFrame:
    """For every candidate the first stage it is missing from, and by how much."""
    stage = F.when(~F.col("passed_threshold"), "threshold").when(~F.col("passed_compression"), "compression").when(~F.col("kept"), "top_k").otherwise("kept")
    gap = F.when(~F.col("passed_threshold"), F.round(F.lit(params.similarity_threshold) - F.col("score"), 6))
    return staged.select("query_id", "chunk_id", "score", "in_bm25", "in_vector", stage.alias("stage"), gap.alias("gap"))


def funnel_counts(staged: DataFrame) -> DataFrame:
    """Counts by stage for each query."""
    flag = lambda c: F.count_if(F.col(c))
    return staged.groupBy("query_id").agg(F.count(F.lit(1)).alias("merged"), flag("passed_threshold").alias("after_threshold"), flag("passed_compression").alias("after_compression"), flag("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"))


def hit_reasons(kept: DataFrame, params: Params = Params()) -> DataFrame:
    """kept(query_id, query, chunk_id, text, file_name, scores) with why it was hit."""
    hits = F.slice(F.filter(F.array_distinct(F.filter(tokens(F.col("query")), lambda t: F.length(t) > 1)), lambda t: F.contains(F.lower("text"), t)), 1, 5)
    named = F.filter(key_terms(F.col("query")), lambda t: F.contains(F.lower("file_name"), t))

    def reason(kind: str, source: str, value: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(source).alias("source"), value.cast("string").alias("value")))

    found = F.array_compact(F.array(
        reason("keyword_match", "query", F.array_join(hits, ","), F.size(hits) > 0),
        reason("bm25_score", "bm25", F.col("bm25_score"), F.col("bm25_score") > 0),
        reason("semantic_similarity", "vector", F.col("vector_score"), F.col("vector_score") > 0),
        reason("score_contribution", "fusion", F.round(F.col("bm25_score") * params.bm25_weight, 4), (F.col("bm25_score") > 0) & (F.col("vector_score") > 0)),
        reason("metadata_match", "metadata", F.array_join(named, ","), F.size(named) > 0),
        reason("score_threshold", "threshold", F.col("score"), F.col("score") >= params.similarity_threshold),
    ))
    return kept.withColumn("reasons", F.when(F.size(found) == 0, F.array(F.struct(F.lit("unknown").alias("type"), F.lit("none").alias("source"), F.lit(None).cast("string").alias("value")))).otherwise(found)).withColumn("preview", preview(F.col("text"), 200))


def retrieve(queries: DataFrame, chunks: DataFrame, index: Index, params: Params = Params()) -> DataFrame:
    """G1: queries(query_id, kb_id, query, vec), chunks(kb_id, chunk_id, text, vec) -> staged candidates of all queries."""
    k = params.rerank_top_k if params.mode == "hybrid" else params.top_k
    b = bm25(queries, index, k)
    v = knn(queries.where("vec IS NOT NULL"), chunks.where("vec IS NOT NULL"), k, params.vector_floor)
    if params.mode == "bm25":
        v = v.limit(0)
        params = Params(**(asdict(params) | {"bm25_weight": 1.0, "vector_weight": 0.0}))
    elif params.mode == "vector":
        b = b.limit(0)
        params = Params(**(asdict(params) | {"bm25_weight": 0.0, "vector_weight": 1.0}))
    return stages(kept(fuse(b, v, params=params)), chunks, queries, params)
