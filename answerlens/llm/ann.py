"""Nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

Largest inner product is nearest in Euclidean distance once every vector gets one
more component that fills its norm up to the largest norm.  The upper tree is fitted
on a bounded sample of such vectors.  Where the table is larger than the sample, each
of its leaves is split further in a task, from a sample of the leaf's own vectors, so
the number of leaves grows with the table (up to MOST_LEAVES, since the tree is
broadcast).  Every vector is put into the leaf it descends to.

A query takes the branches of the tree through a priority queue, nearest first, which
orders the leaves; the leaves of one branch come by their own distance.  The order is
computed for many queries together.  How many leaves a query visits is calibrated: for a
sample of the queries the exact neighbours are found by brute force over all vectors, and
visits are widened until the wanted share of them lies in the leaves visited.

Leaves are searched where they lie: neighbouring leaves make a shelf, and a task gets the
vectors of a shelf once and every query that visits it once, with a bit for each leaf.  So
what is sent grows with the queries times the shelves (ten, until these are too long for a
task) and not with the leaves visited.  A task gives a query's best k of its shelf in one
row, and those are merged.  Products in single precision choose candidates, with a margin
for their error; exact ones rank them.  Of equal vectors the k + 1 smallest ids can be
found, the others are not compared; a leaf longer than a shelf is dealt to several.

Defined cases: vectors that are null, zero or hold null or non-finite components take
no part, as queries or candidates; the same for a null id; a vector with fewer
components than the longest is taken to have zeros there; a query's own id is never its
neighbour, on whatever row; where an id has several vectors, the first in order asks,
and each may be found, listed once with its best score; ties go to the smaller id; with
fewer candidates than k all are returned; an empty table gives no rows; columns other
than the id and the vector do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlens.llm.common import cut, drop

K = 20
#: Vectors that the tree is fitted on, and queries that visits are calibrated on.
SAMPLE, CALIBRATION = 20_000, 200
BRANCHES, LEAF = 8, 150
RECALL = 0.97
#: Leaves at most (a centre has some 500 bytes and is broadcast), and sampled vectors for each leaf of a split one.
MOST_LEAVES, SAMPLED_IN_LEAF = 50_000, 20
#: Shelves, fewer for less than so many vectors each, more beyond so many.
SHELVES, SHELF_LEAST, SHELF_MOST = 10, 2000, 400_000
#: Queries and vectors of a product.
BLOCK_QUERIES, BLOCK_VECTORS = 256, 8192


@dataclass
class Tree:
    """children[i]: nodes below i, empty for a leaf; centres[i]: its centre; leaf[i]: the leaf's number."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]
    top: float

    @property
    def n_leaves(self) -> int:
        return sum(x >= 0 for x in self.leaf)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf to which each vector descends."""
        at = np.zeros(len(x), dtype=np.int64)
        moving = np.arange(len(x))
        while len(moving):
            for node in np.unique(at[moving]):
                below = self.children[node]
                mine = moving[at[moving] == node]
                if below:
                    at[mine] = np.array(below)[_distances(x[mine], self.centres[below]).argmin(axis=1)]
            moving = moving[[bool(self.children[n]) for n in at[moving]]]
        return np.array(self.leaf)[at]

    def reach(self, q: np.ndarray) -> np.ndarray:
        """For each query and leaf how far the queue has got when the leaf's turn comes: a branch waits for its own distance and for those of the branches it hangs from; the nearest child goes on without waiting."""
        near = _distances(q, self.centres) + (q**2).sum(axis=1)[:, None]
        wait = np.zeros_like(near)
        todo = [0]
        while todo:
            node = todo.pop()
            if below := self.children[node]:
                wait[:, below] = np.maximum(near[:, below], wait[:, [node]])
                first = np.array(below)[near[:, below].argmin(axis=1)]
                wait[np.arange(len(q)), first] = wait[:, node]
                todo += below
        at = np.flatnonzero(np.array(self.leaf) >= 0)
        at = at[np.argsort(np.array(self.leaf)[at])]
        return wait[:, at] + 1e-6 * near[:, at]  # of one branch, the nearer leaf first


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c**2).sum(axis=1)[None, :] - 2 * x @ c.T


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _distances(x, c).argmin(axis=1)
        for j in range(k):
            if (at == j).any():
                c[j] = x[at == j].mean(axis=0)
    return c


def fit_tree(x: np.ndarray, top: float, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 3) -> Tree:
    """A tree over the (extended) sample; splits stop at leaf size or where vectors don't differ."""
    rng = np.random.default_rng(seed)
    centres, children, leaves = [x.mean(axis=0) if len(x) else np.zeros(1)], [[]], [-1]
    todo, n = [(0, np.arange(len(x)))], 0
    while todo:
        node, rows = todo.pop()
        part = x[rows]
        distinct = len(rows) > leaf and np.ptp(part, axis=0).max() > 1e-9
        if distinct:
            c = _k_means(part, branches, rng)
            at = _distances(part, c).argmin(axis=1)
            groups = [(c[j], rows[at == j]) for j in range(branches) if (at == j).any()]
            distinct = len(groups) > 1
        if not distinct:
            leaves[node] = n
            n += 1
            continue
        for centre, mine in groups:
            children[node].append(len(centres))
            todo.append((len(centres), mine))
            centres.append(centre)
            children.append([])
            leaves.append(-1)
    return Tree(np.array(centres), children, leaves, top)


def extend(x: np.ndarray, top: float) -> np.ndarray:
    """With the component that fills the norm up to top."""
    return np.hstack([x, np.sqrt(np.maximum(top**2 - (x**2).sum(axis=1), 0))[:, None]])


def clean(rows: DataFrame, vec: str = "embedding", key: str = "vec_id") -> DataFrame:
    """rows -> (id, x array<double>) of those that take part."""
    single = rows.schema[vec].dataType == T.ArrayType(T.FloatType(), rows.schema[vec].dataType.containsNull)
    kind = "float" if single else "double"  # as given, since double takes twice the room
    good = rows.where(F.col(key).isNotNull() & F.col(vec).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vec).cast(f"array<{kind}>").alias("x"))
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))) & F.exists("x", lambda v: v != 0)
    good = good.where(fine)
    longest = good.agg(F.max(F.size("x")).alias("d")).first()["d"] or 0
    return good.withColumn("x", F.concat("x", F.array_repeat(F.lit(0.0).cast(kind), F.lit(longest) - F.size("x"))))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64) if len(column) else np.zeros((0, 0))


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up from the first component to the last."""
    return np.cumsum(q * x, axis=1)[:, -1]


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of these vectors for each query: block products choose, exact ones rank."""
    out = []
    unique = np.unique(ids)
    for a in range(0, len(q), 256):
        s = q[a : a + 256] @ x.T
        s[q_ids[a : a + 256, None] == ids[None, :]] = -np.inf
        n = min(k, s.shape[1])
        floor = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
        if len(unique) < len(ids):  # repeated ids take places: keep enough for k distinct ones
            floor = np.array([np.sort(pd.Series(r).groupby(ids).max().to_numpy())[::-1][: k][-1] for r in s])
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0)))
        i, j = np.nonzero((s >= (floor - slack)[:, None]) & np.isfinite(s))
        found = pd.DataFrame({"query_id": q_ids[a + i], "vec_id": ids[j], "score": exact(q[a + i], x[j])})
        found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).drop_duplicates(["query_id", "vec_id"])
        out.append(found.groupby("query_id", sort=False).head(k))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


FOUND = "query_id long, vec_id long, score double"


def top(found: DataFrame, k: int) -> DataFrame:
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def brute_force(vectors: DataFrame, queries: pd.DataFrame, k: int) -> DataFrame:
    """A bounded set of queries against all vectors."""
    q_ids, q = queries["id"].to_numpy(), matrix(queries["x"])
    shared = vectors.sparkSession.sparkContext.broadcast((q_ids, q))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            if len(pdf):
                yield best(*shared.value, pdf["id"].to_numpy(), matrix(pdf["x"]), k)

    return top(vectors.mapInPandas(run, FOUND), k)


def grow(vectors: DataFrame, tree: Tree, n: int) -> Tree:
    """The tree with its leaves split by tasks, until there are about n / LEAF of them or MOST_LEAVES."""
    wanted = min(MOST_LEAVES, n // LEAF)
    if wanted < 2 * tree.n_leaves:
        return tree
    placed = cut(place(vectors, tree))
    sizes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))  # one row a leaf of the upper tree
    share = F.least(F.ceil(F.col("n") / F.lit(n / wanted)), F.lit(8 * -(-wanted // tree.n_leaves)))  # leaves that a leaf is split into
    rates = sizes.select("leaf", (share * SAMPLED_IN_LEAF / F.col("n")).alias("rate"))
    draw = F.pmod(F.xxhash64("id", F.lit(13)), F.lit(1_000_000)) / F.lit(1e6)
    drawn = placed.join(F.broadcast(rates), "leaf").where(draw < F.col("rate"))
    top_norm = tree.top

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        below = fit_tree(extend(matrix(pdf["x"]), top_norm), top_norm, leaf=SAMPLED_IN_LEAF)
        parent = np.full(len(below.leaf), -1)
        for i, children in enumerate(below.children):
            parent[children] = i
        return pd.DataFrame({"leaf": pdf["leaf"].iloc[0], "node": np.arange(len(parent)), "parent": parent, "centre": list(below.centres)})

    rows = drawn.select("leaf", "id", "x").groupBy("leaf").applyInPandas(split, "leaf int, node int, parent int, centre array<double>").toPandas()  # bounded by MOST_LEAVES
    drop(placed)
    centres, children = list(tree.centres), [list(c) for c in tree.children]
    at = {leaf: i for i, leaf in enumerate(tree.leaf) if leaf >= 0}
    for leaf, part in rows.sort_values(["leaf", "node"]).groupby("leaf"):
        name = {0: at[leaf]}
        for node, parent, centre in zip(part["node"], part["parent"], part["centre"], strict=True):
            if parent >= 0:
                name[node] = len(centres)
                centres.append(np.asarray(centre))
                children.append([])
                children[name[parent]].append(name[node])
    leaves = np.cumsum([not c for c in children]) - 1
    return Tree(np.array(centres), children, [int(n) if not c else -1 for n, c in zip(leaves, children, strict=True)], tree.top)


def place(vectors: DataFrame, tree: Tree) -> DataFrame:
    """vectors(id, x) with their leaf."""
    shared = vectors.sparkSession.sparkContext.broadcast(tree)  # bounded by SAMPLE / LEAF centres

    @F.pandas_udf("int")
    def leaf(x: pd.Series) -> pd.Series:
        t = shared.value
        return pd.Series(t.assign(extend(matrix(x), t.top)).astype(np.int32)) if len(x) else pd.Series([], dtype=np.int32)

    return vectors.withColumn("leaf", leaf("x"))


def visits(queries: DataFrame, tree: Tree, most: int, sizes: np.ndarray, least: int) -> DataFrame:
    """queries(id, x) -> with a bit for each leaf among the query's first, which go on until the leaves hold so many ids at least."""
    shared = queries.sparkSession.sparkContext.broadcast((tree, sizes))

    @F.pandas_udf("binary")
    def walk(x: pd.Series) -> pd.Series:
        t, held = shared.value
        out = []
        for low in range(0, len(x), BLOCK_QUERIES):
            reach = t.reach(extend(matrix(x.iloc[low : low + BLOCK_QUERIES]), 0.0))
            order = np.argsort(reach, axis=1, kind="stable")
            before = np.cumsum(held[order], axis=1) - held[order]
            go = (np.arange(t.n_leaves) < most) | (before < least)
            flags = np.zeros(go.shape, dtype=bool)
            np.put_along_axis(flags, order, go, axis=1)
            out += [r.tobytes() for r in np.packbits(flags, axis=1)]
        return pd.Series(out, dtype=object)

    return queries.withColumn("visits", walk("x"))


def calibrate(placed: DataFrame, tree: Tree, sample: pd.DataFrame, k: int, recall: float) -> tuple[int, float]:
    """The smallest number of leaves whose visits hold the wanted share of the sample's exact neighbours, and the share they hold."""
    if not len(sample):
        return 1, 1.0
    near = brute_force(placed.select("id", "x"), sample, k).select("query_id", "vec_id")
    leaves = near.join(placed.select(F.col("id").alias("vec_id"), "leaf"), "vec_id").distinct().toPandas()  # CALIBRATION x k rows
    order = np.argsort(tree.reach(extend(matrix(sample["x"]), 0.0)), axis=1, kind="stable")
    turn = np.argsort(order, axis=1)
    row = {i: n for n, i in enumerate(sample["id"])}
    steps = np.array([turn[row[q], leaf] for q, leaf in zip(leaves["query_id"], leaves["leaf"], strict=True)])
    if not len(steps):
        return 1, 1.0
    most = int(np.quantile(steps, recall, method="higher")) + 1
    return most, float((steps < most).mean())


def shelve(rows: np.ndarray) -> pd.DataFrame:
    """rows of each leaf -> shelf, its first leaf and how many leaves it has: leaves in order, until a shelf is full; a leaf longer than a shelf has several of its own."""
    n = int(rows.sum())
    wanted = max(1, min(SHELVES, n // SHELF_LEAST), -(-n // SHELF_MOST))
    full = max(1, -(-n // wanted))
    out: list[tuple[int, int]] = []
    room = -1  # of the last shelf; none before the first one and after a leaf's own
    for leaf, size in enumerate(rows.tolist()):
        if size > full:
            out += [(leaf, 1)] * -(-size // full)
            room = -1
        elif size > room:
            out.append((leaf, 1))
            room = full - size
        else:
            out[-1] = out[-1][0], out[-1][1] + 1
            room -= size
    return pd.DataFrame({"shelf": range(len(out)), "first": [x[0] for x in out], "leaves": [x[1] for x in out]}).astype("int32")


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of equal lengths as a matrix."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


class Shelf:
    """The vectors of a shelf, leaf by leaf; of equal ones those with the k + 1 smallest ids, as no query finds more (one may be its own)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: np.ndarray, k: int):
        group = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1]
        order = np.lexsort((ids, group, leaf))
        group, at = group[order], ids[order]
        new = np.concatenate([[True], (group[1:] != group[:-1])])
        order, new = order[fresh := new | np.concatenate([[True], at[1:] != at[:-1]])], new[fresh]
        place = np.arange(len(order))
        order = order[place - np.maximum.accumulate(np.where(new, place, 0)) <= k]
        self.ids, self.x, self.leaf, self.k = ids[order], x[order], leaf[order], k
        self.repeats = len(np.unique(self.ids)) < len(self.ids)
        norms = np.concatenate([np.sqrt((self.x[a : a + BLOCK_VECTORS].astype(np.float64) ** 2).sum(axis=1)) for a in range(0, len(order), BLOCK_VECTORS)])
        self.kind = np.float32 if norms.max() <= 1e4 * np.median(norms) else np.float64  # else a margin for the longest takes in all the short ones
        self.scaled = np.concatenate([(self.x[a : a + BLOCK_VECTORS] / norms.max()).astype(self.kind) for a in range(0, len(order), BLOCK_VECTORS)])
        self.margin = 2 * (x.shape[1] + 8) * float(np.finfo(self.kind).eps)  # products of vectors no longer than one

    def best(self, q_ids: np.ndarray, q: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best for each of a block's queries in the leaves it has seen: query's place, vector's id, score, the best first."""
        unit = (q / np.sqrt((q**2).sum(axis=1))[:, None]).astype(self.kind)
        columns = np.flatnonzero(seen.any(axis=0)[self.leaf])
        least = np.full(len(q), -np.inf)
        i, j, s = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=self.kind)
        low, width = 0, 1024
        while low < len(columns):
            c = columns[low : low + width]
            product = unit @ self.scaled[c].T
            if not low and not self.repeats and len(c) >= self.k:
                product[~seen[:, self.leaf[c]] | (q_ids[:, None] == self.ids[c])] = -np.inf
                least = np.partition(product, len(c) - self.k, axis=1)[:, len(c) - self.k] - self.margin
            a, b = np.nonzero(product >= least[:, None].astype(self.kind))
            fine = seen[a, self.leaf[c[b]]] & (q_ids[a] != self.ids[c[b]])
            a, b = a[fine], b[fine]
            i, j, s = np.concatenate([i, a]), np.concatenate([j, c[b]]), np.concatenate([s, product[a, b]])
            i, j, s = (v[by] for by in [np.lexsort((-s, i))] for v in (i, j, s))
            kth = self._places(i, j) == self.k - 1
            least[i[kth]] = s[kth] - self.margin
            i, j, s = (v[good] for good in [s >= least[i]] for v in (i, j, s))
            low, width = low + width, BLOCK_VECTORS
        score = exact(q[i], self.x[j].astype(np.float64)) if len(i) else np.zeros(0)
        i, j, score = (v[by] for by in [np.lexsort((self.ids[j], -score, i))] for v in (i, j, score))
        place = self._places(i, j)
        first = (place >= 0) & (place < self.k)
        return i[first], self.ids[j[first]], score[first]

    def _places(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which each row is among its query's distinct ids, from 0, where an id comes first; -1 where it comes again."""
        first = ~pd.DataFrame({"i": i, "id": self.ids[j]}).duplicated().to_numpy() if self.repeats else np.ones(len(i), dtype=bool)
        n = np.cumsum(first)
        return np.where(first, n - 1 - (n - first)[np.searchsorted(i, i)], -1)


def search(vectors: DataFrame, is_query: Column, k: int = K, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """vectors(id, x) -> query_id, rank, vec_id, score for the rows that are queries (a condition on id); with the leaves visited, all leaves and the recall calibrated."""
    spark = vectors.sparkSession
    about = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v)).alias("t")).first()
    n, largest = about["n"], float(np.sqrt(about["t"] or 0.0))
    draw = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) / F.lit(1e6)
    fitted = vectors.where(draw < min(1.0, sample / max(n, 1))).orderBy("id").limit(2 * sample).toPandas()
    tree = fit_tree(extend(matrix(fitted["x"]), largest) if len(fitted) else np.zeros((0, 1)), largest)
    tree = grow(vectors, tree, n)
    placed = cut(place(vectors, tree))
    asking = cut(placed.where(is_query).groupBy("id").agg(F.min("x").alias("x")))
    n_queries = asking.count()
    again = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000)) / F.lit(1e6)
    tried = asking.where(again < min(1.0, CALIBRATION / max(n_queries, 1))).orderBy("id").limit(2 * CALIBRATION).toPandas()
    visited, share = calibrate(placed, tree, tried, k, recall)
    sizes, rows = np.zeros((2, tree.n_leaves), dtype=np.int64)
    for r in placed.groupBy("leaf").agg(F.count_distinct("id").alias("n"), F.count(F.lit(1)).alias("rows")).collect():  # one row a leaf
        sizes[r["leaf"]], rows[r["leaf"]] = r["n"], r["rows"]
    queries = cut(visits(asking, tree, visited, sizes, k + 1))
    drop(asking)

    shelves = shelve(rows)
    spread = F.broadcast(spark.createDataFrame(shelves, "shelf int, first int, leaves int"))
    of_leaf = shelves.loc[shelves.index.repeat(shelves["leaves"])]
    of_leaf = of_leaf.assign(leaf=of_leaf["first"] + of_leaf.groupby("shelf").cumcount()).groupby("leaf").agg(shelf=("shelf", "min"), first=("first", "min"), parts=("shelf", "size")).reset_index().astype("int32")
    of_leaf = F.broadcast(spark.createDataFrame(of_leaf, "leaf int, shelf int, first int, parts int"))  # one row a leaf, so bounded by the tree
    salt = F.xxhash64("id", F.monotonically_increasing_id())
    nothing = F.lit(None).cast("binary")
    have = placed.join(of_leaf, "leaf").select((F.col("shelf") + F.pmod(salt, F.col("parts"))).cast("int").alias("shelf"), "id", "x", (F.col("leaf") - F.col("first")).alias("at"), nothing.alias("visits"))
    low, high = F.floor(F.col("first") / 8).cast("int"), F.floor((F.col("first") + F.col("leaves") - 1) / 8).cast("int")
    part = F.substring("visits", low + 1, high - low + 1)
    ask = queries.crossJoin(spread).select("shelf", "id", "x", (F.col("first") - 8 * low).alias("at"), part.alias("visits"))
    kind = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_ids", T.ArrayType(T.LongType())), T.StructField("scores", T.ArrayType(T.DoubleType()))])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        asks = pc.is_valid(table["visits"])
        mine, theirs = table.filter(asks), table.filter(pc.invert(asks))
        del table
        if not len(mine) or not len(theirs):
            return
        leaf = theirs["at"].to_numpy()
        shelf = Shelf(theirs["id"].to_numpy(), _rows(theirs["x"]), leaf, k)
        del theirs
        q_ids, x, skip, n_leaves = mine["id"].to_numpy(), _rows(mine["x"]), mine["at"][0].as_py(), int(leaf.max()) + 1
        bits = np.frombuffer(b"".join(mine["visits"].to_pylist()), dtype=np.uint8).reshape(len(mine), -1)
        for a in range(0, len(mine), BLOCK_QUERIES):
            seen = np.unpackbits(bits[a : a + BLOCK_QUERIES], axis=1)[:, skip : skip + n_leaves].view(bool)
            i, ids, score = shelf.best(q_ids[a : a + BLOCK_QUERIES], x[a : a + BLOCK_QUERIES].astype(np.float64), seen)
            held, count = np.unique(i, return_counts=True)
            ends = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[a + held]), pa.ListArray.from_arrays(ends, pa.array(ids)), pa.ListArray.from_arrays(ends, pa.array(score))], names=kind.names)

    found = have.unionByName(ask).repartitionByRange(len(shelves) or 1, "shelf").groupBy("shelf").applyInArrow(meet, kind)
    found = found.repartition("query_id").select("query_id", F.inline(F.arrays_zip(F.col("vec_ids").alias("vec_id"), F.col("scores").alias("score"))))
    about_it = [F.lit(visited).alias("leaves_visited"), F.lit(tree.n_leaves).alias("leaves"), F.lit(share).alias("calibrated_recall")]
    return top(found, k).select("query_id", "rank", "vec_id", "score", *about_it)


def op1_kmeans_tree(spark, sf_dir):
    """The 20 nearest found of every twentieth vector, by inner product."""
    vectors = clean(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(vectors, F.pmod(F.col("id"), F.lit(20)) == 0)
