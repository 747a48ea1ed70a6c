"""Near-duplicate vectors by spherical-cap filters.

Filter directions are structured: a random rotation cuts the space into two or three
stretches, each with its own list of random unit vectors, and a direction is one choice
from each list.  A vector is list-decoded: stretch by stretch, choices are kept as long
as the best ones of the remaining stretches could still lift the sum to the cap's
height, so that all directions above it are found without trying each.  Vectors that
share a direction (and the label) meet in its bucket.  Height, lists and the number of
such codes follow from the number of vectors and are calibrated on synthetic pairs
exactly at the threshold, not on the data: all of them must meet, and half as many codes
are added.

Equal vectors are one node with a weight.  A bucket is compared in cells of bounded
size: a large one is split into parts, each two of which make a cell.  Cells compare
sketches of 128 signs first; only vectors with a partner there are fetched and verified
by their cosine.  A pair counts in the first of the directions that both have, so links
are counted once however often a pair meets; of its pairs a cell returns, for each
vector, the number and one connection, and connections are joined to components.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components,
or has no label, links with nothing; vectors of different length link with nothing;
repeated rows are equal vectors and linked; a null vec_id counts as a vector and is
never a component's id unless no other is there; an empty table gives no rows; columns
other than vec_id, embedding and label do not matter.

A sketch misses a pair at 0.93 with a probability below 10^-10.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlens.llm.common import cut, drop
from answerlens.llm.graph import components

THRESHOLD = 0.93
RECALL = 1.0
#: Codes beyond those that the calibration needs, as a factor.
MARGIN = 1.5
#: Vectors that a bucket should get; of so many at most it is one cell, else it is split into parts of half as many.
IN_BUCKET = 256
CELL = 512
#: The largest share of all vectors that a cap may hold.
MOST_SHARE = 0.03
#: Directions that a vector should get from one code, and codes tried.
PER_CODE = 2
MOST_CODES = 64
SKETCH = 128
#: Large buckets are broadcast up to so many (about 40 bytes each); beyond, they are joined.
BROADCAST_BUCKETS = 200_000


@dataclass(frozen=True)
class Plan:
    dim: int
    codes: int
    words: int  # in each stretch's list
    stretches: int
    height: float

    @property
    def directions(self) -> int:
        return self.words**self.stretches


@lru_cache(maxsize=256)
def _code(dim: int, words: int, stretches: int, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A rotation and the lists of the k-th code."""
    rng = np.random.default_rng([dim, words, stretches, k])
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    lists = [rng.standard_normal((words, len(x))) for x in np.array_split(np.arange(dim), stretches)]
    return rotation, [x / np.linalg.norm(x, axis=1, keepdims=True) * math.sqrt(x.shape[1] / dim) for x in lists]


def decode(unit: np.ndarray, plan: Plan, codes: range | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All directions above the height, of all codes (or of some): the rows, ascending, and the directions."""
    rows, found = [], []
    for k in codes or range(plan.codes):
        rotation, lists = _code(plan.dim, plan.words, plan.stretches, k)
        turned = np.split(unit @ rotation, np.cumsum([x.shape[1] for x in lists])[:-1], axis=1)
        gains = [a @ b.T for a, b in zip(turned, lists, strict=True)]
        rest = np.cumsum([np.zeros(len(unit)), *[g.max(axis=1) for g in gains[:0:-1]]], axis=0)[::-1]
        row, total, which = np.arange(len(unit)), np.zeros(len(unit)), np.zeros(len(unit), dtype=np.int64)
        for gain, ahead in zip(gains, rest, strict=True):
            sums = total[:, None] + gain[row]
            at, word = np.nonzero(sums >= (plan.height - ahead[row])[:, None])
            row, total, which = row[at], sums[at, word], which[at] * plan.words + word
        keep = total >= plan.height
        rows.append(row[keep])
        found.append(which[keep] + k * plan.directions)
    row, which = np.concatenate(rows), np.concatenate(found)
    order = np.lexsort((which, row))
    return row[order], which[order]


def _height(dim: int, share: float) -> float:
    """The inner product that this share of all unit vectors has at least with one."""
    x = np.linspace(-1, 1, 200_001)
    density = (1 - x * x).clip(1e-12) ** max((dim - 3) / 2, 0)
    above = np.cumsum(density[::-1])[::-1] / density.sum()
    return float(x[np.searchsorted(-above, -share)])


def met(plan: Plan, threshold: float, pairs: int = 4000) -> Iterator[float]:
    """The share of random pairs exactly at the threshold that meet by the first code, the first two, ..."""
    rng = np.random.default_rng(7)
    a, z = rng.standard_normal((2, pairs, plan.dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True).clip(1e-12)
    b = threshold * a + math.sqrt(1 - threshold**2) * z
    done = np.zeros(pairs, dtype=bool)
    for k in range(plan.codes):
        (ra, fa), (rb, fb) = decode(a, plan, range(k, k + 1)), decode(b, plan, range(k, k + 1))
        size = plan.codes * plan.directions
        done[np.intersect1d(ra * size + fa, rb * size + fb) // size] = True
        yield done.mean()


@lru_cache(maxsize=64)
def make_plan(dim: int, n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Plan:
    """For n vectors that may all meet: caps that hold IN_BUCKET of them, and as many codes as the recall needs, with a margin."""
    share = min(MOST_SHARE, IN_BUCKET / max(n, 1))
    while True:
        size = max(4, round(PER_CODE / share))
        stretches = min(dim, 2 if size <= 1 << 16 else 3)
        words = max(2, round(size ** (1 / stretches)))
        plan = Plan(dim, MOST_CODES, words, stretches, _height(dim, share))
        for codes, share_met in enumerate(met(plan, threshold), 1):
            if share_met >= recall:
                return replace(plan, codes=math.ceil(codes * MARGIN))
        share *= 2
        if share > 1:  # one bucket for all
            return Plan(dim, 1, 2, 1, -2.0)


def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng([dim, SKETCH]).standard_normal((dim, SKETCH))


def sketch(unit: np.ndarray) -> np.ndarray:
    """128 signs as two whole numbers a row."""
    return np.packbits(unit @ _planes(unit.shape[1]) > 0, axis=1).view(np.int64)


def far(threshold: float) -> int:
    """More different signs than a pair at the threshold has, but for seven standard deviations."""
    p = math.acos(threshold) / math.pi
    return math.ceil(SKETCH * p + 7 * math.sqrt(SKETCH * p * (1 - p)))


def usable(vector: Column, label: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(label.isNotNull() & vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = (x.astype(np.float64) / np.abs(x).max() for x in (a, b))
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


CELLS = ["label", "dim", "direction", "p", "q"]


def _hits(nodes: DataFrame, plans: dict[int, Plan]) -> DataFrame:
    """nodes(node, label, dim, embedding) -> a row for each direction of each, with its sketch."""
    schema = T.StructType([nodes.schema["label"], *T._parse_datatype_string("dim int, direction long, node long, s0 long, s1 long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                some = batch.slice(a, 1024)
                dims = some["dim"].to_numpy(zero_copy_only=False)
                for dim in np.unique(dims):
                    mine = some.filter(pa.array(dims == dim))
                    unit = _unit(mine["embedding"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                    rows, found = decode(unit, plans[int(dim)])
                    signs = sketch(unit)[rows]
                    take = mine.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([take["label"], take["dim"], pa.array(found), take["node"], pa.array(signs[:, 0]), pa.array(signs[:, 1])], names=schema.names)

    return nodes.mapInArrow(run, schema)


def _dealt(hits: DataFrame) -> DataFrame:
    """hits with p and q: the cells of a bucket; each two of its parts meet in one, and so does each with itself."""
    bucket = ["label", "dim", "direction"]
    sizes = hits.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    large = cut(sizes.where(f"size > {CELL}").withColumn("n_parts", F.ceil(F.col("size") / (CELL // 2)).cast("int")).drop("size"))
    n = large.count()
    hits = hits.join(F.broadcast(large) if n <= BROADCAST_BUCKETS else large, bucket, "left") if n else hits.withColumn("n_parts", F.lit(None).cast("int"))
    part = F.coalesce(F.pmod(F.xxhash64("node", F.lit(11)), F.col("n_parts")), F.lit(0)).cast("int")
    other = F.explode(F.when(F.col("n_parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    dealt = hits.withColumn("part", part).withColumn("other", other)
    return dealt.withColumn("p", F.least("part", "other")).withColumn("q", F.greatest("part", "other")).drop("n_parts", "other")


def _each_cell(rows: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType) -> DataFrame:
    """work on every cell of two rows or more; cells are many and most are small, so a batch's cells share its overhead."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in pdfs:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            new = np.ones(len(pdf) + 1, dtype=bool)
            new[1:-1] = np.any([pdf[c].to_numpy()[1:] != pdf[c].to_numpy()[:-1] for c in CELLS], axis=0)
            bounds = np.flatnonzero(new)
            some = [x for a, b in zip(bounds[:-2], bounds[1:-1], strict=True) if b - a > 1 and len(x := work(pdf.iloc[a:b]))]
            if some:
                yield pd.concat(some)
            held = pdf.iloc[bounds[-2] :]
        if held is not None and len(held) > 1:
            yield work(held)

    return rows.repartition(*CELLS).sortWithinPartitions(*CELLS).mapInPandas(run, schema)


def _meeting(part: np.ndarray) -> np.ndarray:
    """Which pairs of a cell are its own: all, or those of different parts if there are two."""
    n = len(part)
    own = np.ones((n, n), dtype=bool) if part.min() == part.max() else part[:, None] != part[None, :]
    np.fill_diagonal(own, False)
    return own


def _screened(hits: DataFrame, limit: int) -> DataFrame:
    """The rows of each cell that have a partner by their sketches."""
    cells = _dealt(hits)
    schema = T.StructType([f for f in cells.schema.fields if f.name not in ("s0", "s1")])

    def screen(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf[["s0", "s1"]].to_numpy(np.int64).view(np.uint64)
        part = pdf["part"].to_numpy()
        if pdf["p"].iloc[0] != pdf["q"].iloc[0] and part.min() == part.max():
            return pdf.iloc[:0][schema.names]
        apart = np.bitwise_count(s[:, None, 0] ^ s[None, :, 0]).astype(np.int16) + np.bitwise_count(s[:, None, 1] ^ s[None, :, 1])
        return pdf[((apart <= limit) & _meeting(part)).any(axis=1)][schema.names]

    return _each_cell(cells, screen, schema)


def _verified(screened: DataFrame, nodes: DataFrame, plans: dict[int, Plan], threshold: float) -> DataFrame:
    """node, other (a node it is connected with in the cell, maybe itself), n_links: the rows linked with it by pairs that count in the cell."""
    kind = np.float32 if isinstance(nodes.schema["embedding"].dataType.elementType, T.FloatType) else np.float64

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        plan, direction = plans[int(pdf["dim"].iloc[0])], int(pdf["direction"].iloc[0])
        part = pdf["part"].to_numpy()
        none = pd.DataFrame({"node": [], "other": [], "n_links": []}, dtype=np.int64)
        if pdf["p"].iloc[0] != pdf["q"].iloc[0] and part.min() == part.max():
            return none
        own = _meeting(part)
        vectors = np.stack([np.asarray(x, dtype=kind) for x in pdf["embedding"]])
        unit = _unit(vectors)
        cos = unit @ unit.T
        linked = own & (cos >= threshold)
        for i, j in zip(*np.nonzero(own & (np.abs(cos - threshold) < 1e-12)), strict=True):
            linked[i, j] = _cosine(vectors[i], vectors[j]) >= threshold
        some = np.flatnonzero(linked.any(axis=1))
        if not len(some):
            return none
        linked = linked[np.ix_(some, some)]
        rows, found = decode(unit[some], plan)  # a pair counts here if no earlier direction has both
        rows, found = rows[found < direction], found[found < direction]
        _, found = np.unique(found, return_inverse=True)
        has = np.zeros((len(some), int(found.max(initial=-1)) + 1), dtype=np.float32)
        has[rows, found] = 1
        linked &= has @ has.T == 0
        node, weight = pdf["node"].to_numpy()[some], pdf["weight"].to_numpy()[some]
        label = np.arange(len(some))
        while True:
            low = np.minimum(label, np.where(linked, label[None, :], len(some)).min(axis=1))
            low = low[low]
            if (low == label).all():
                break
            label = low
        n_links = linked @ weight
        return pd.DataFrame({"node": node, "other": node[label], "n_links": n_links})[n_links > 0]

    full = screened.join(nodes.select("node", "embedding", "weight"), "node")
    return _each_cell(full, verify, T._parse_datatype_string("node long, other long, n_links long"))


def link(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vectors(vec_id, embedding, label) -> a row for each: vec_id, n_links, component_id, kept."""
    part = usable(F.col("embedding"), F.col("label"))
    rows = vectors.select("vec_id", "label", "embedding", part.alias("part"))
    equal = rows.where("part").groupBy("label", "embedding").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("weight"))
    nodes = cut(equal.withColumn("dim", F.size("embedding")).withColumn("node", F.monotonically_increasing_id()))
    most = nodes.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("n")).collect()  # a row for each length of vectors
    plans = {r["dim"]: make_plan(r["dim"], r["n"], threshold, recall) for r in most}
    hits = cut(_hits(nodes.select("node", "label", "dim", "embedding"), plans))
    found = cut(_verified(_screened(hits, far(threshold)), nodes, plans, threshold))
    drop(hits)
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    of = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = nodes.select("node", "label", "embedding", "first_id", "weight").join(counts, "node", "left").join(of, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = named.join(smallest, "component").select("label", "embedding", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    known = rows.where("part").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT part").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_spherical_caps(spark, sf_dir):
    """Every vector with the number of its near copies and the smallest id of its component."""
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), used AS (
  SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.r AS r, a.vec_id AS id, b.r AS s, b.vec_id AS other FROM used a JOIN used b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach AS (
  SELECT r, vec_id AS id FROM v
  UNION
  SELECT p.s, reach.id FROM reach JOIN pairs p ON p.r = reach.r
), least AS (
  SELECT r, min(id) AS component_id FROM reach GROUP BY r
), counts AS (
  SELECT r, count(*) AS n FROM pairs GROUP BY r
)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, l.component_id, v.vec_id = l.component_id AS kept
FROM v JOIN least l USING (r) LEFT JOIN counts c USING (r)
"""
