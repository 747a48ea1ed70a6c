"""Exact Jaccard self-join on word shingles: size-banded tiles and bitmap signatures.

A document is the set of its five-word shingles, as 64-bit hashes.  How many
documents have a shingle is counted over all blocks (see ``blocks``); documents
with too few shared shingles to reach the threshold with anything are out at once.
Of each other document's shingles, sorted from rare to frequent, a prefix is kept
that must meet the prefix of every document it can be linked with.  Documents that
share a prefix shingle and lie in one size band, or in it and the next, form a
tile; of tiles with the same members one is kept.

Equal sets are one node.  First every tile's leader is compared with the others of
its tile, so a group of near copies is connected by a number of comparisons in
proportion to its size.  Tiles that then still hold more than one component are
compared across components: what is not in the tile's largest component meets all
of the tile, in cells of bounded size.  Inside a cell a pair is first bounded from
above by bitmap signatures (each bit of one that the other lacks is at least one
shingle not shared), then decided by intersecting the sorted arrays; a pair whose
ends the cell has connected already is skipped.  So a cell gives fewer links than
it has members, and no pair that could add a connection is lost.

What is computed are the components: links between documents that are connected
anyway are neither looked for nor counted.

Defined cases: a document without words has an empty set and is linked with
nothing; with fewer than five words its whole sequence is its one shingle; the
number of shingles is that of distinct ones; repeated rows are linked as equal sets
(unless empty); a null doc_id takes part and is never the component's id unless
nothing else is there; an empty table gives no rows; columns other than doc_id and
text do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlens.llm import blocks as B
from answerlens.llm.common import cut, drop, parts
from answerlens.llm.graph import components

WIDTH = 5
PERCENT = 80
#: Members of a tile on one side of a cell, and their shingles.
CELL, CELL_SHINGLES = 500, 1_000_000
#: Shingles that one task compares; a task takes many cells, since most are tiny.
TASK_SHINGLES = 4_000_000
#: Bits of a signature for each shingle of the largest set in a cell, and the bounds of its width.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 512, 16384
#: Bytes of text in a block; half of what other operators take, since shingling needs some 40 bytes a byte.
BLOCK_BYTES = 4 << 20
_U = np.uint64


def shingles(texts, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all documents, sorted by shingle, then document, and the document of each."""
    w, n = B.words(texts)
    ends = np.cumsum(n)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(w)) - np.repeat(ends - n, n)
    h = np.zeros(len(w), dtype=np.uint64)
    for k in range(width):  # the k-th word from each place on, as far as its document goes
        inside = place + k < n[doc]
        nxt = np.concatenate([w[k:], np.zeros(min(k, len(w)), dtype=np.uint64)])
        h = np.where(inside, B.mix(h * _U(0x9E3779B97F4A7C15) + nxt + _U(1)), h)
    begins = (place + width <= n[doc]) | (place == 0)
    h, doc = h[begins], doc[begins]
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
    return h[new], doc[new]


def slot(h: np.ndarray) -> np.ndarray:
    """The 40 high bits, by which documents are counted; the count of a slot bounds those of its shingles."""
    return h >> _U(24) << _U(24)


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of n shares at least with any it is linked to."""
    return -(-n * percent // 100)


SETS = "doc_id long, n long, node long, tokens array<long>, items binary"


def sets(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text) -> a row for each: n; and for those that may be linked, node (equal for equal sets), prefix tokens, items."""
    blocks = B.pack(docs.select("doc_id", "text"), BLOCK_BYTES)
    n_parts = B.n_ranges(blocks)

    def ask(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for block, payload in zip(pdf["block"], pdf["payload"], strict=True):
                h, _ = shingles(B.unpack(payload)["text"], width)
                keys, times = np.unique(slot(h), return_counts=True)
                yield pd.DataFrame(B.requests(block, 1, keys, times, n_parts), columns=["block", "part", "kind", "keys", "counts"])
        B.give_back()

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        _, places, _, totals = B.add_up([B.unpack_keys(b) for b in pdf["keys"]], [B.unpack_counts(b) for b in pdf["counts"]])
        level = np.ceil(np.log2(np.maximum(totals, 1))).astype(np.int64)  # 0: one document
        return pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "kind": 1, "totals": [B.pack_counts(level[p]) for p in places]})

    replies = blocks.select("block", "payload").mapInPandas(ask, B.REQUEST).groupBy("part").applyInPandas(answer, B.REPLY)

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        t = B.unpack(pdf["payload"].dropna().iloc[0])
        h, doc = shingles(t["text"], width)
        keys = np.unique(slot(h))
        levels = B.collect_replies(pdf, 1, "totals", B.unpack_counts)
        level = levels[np.searchsorted(keys, slot(h))]
        order = np.argsort(doc, kind="stable")  # by document, within it by shingle
        h, level = h[order], level[order]
        size = np.bincount(doc, minlength=t.num_rows)
        shared = np.bincount(doc[order], weights=level > 0, minlength=t.num_rows)
        ends = np.cumsum(size)
        out = []
        for i, doc_id in enumerate(t["doc_id"].to_pylist()):
            n = int(size[i])
            least = int(need(np.int64(n), percent))
            if n == 0 or shared[i] < least:
                out.append((doc_id, n, None, None, None))
                continue
            x, y = h[ends[i] - n : ends[i]], level[ends[i] - n : ends[i]]
            prefix = np.lexsort((x, y))[: n - least + 1]
            tokens = x[prefix[y[prefix] > 0]].view(np.int64)
            node = int(B.mix(np.array([(B.mix(x) * (x | _U(1))).sum() + _U(n)], dtype=np.uint64)).view(np.int64)[0])
            out.append((doc_id, n, node, tokens, x.tobytes()))
        B.give_back()
        frame = pd.DataFrame(out, columns=["doc_id", "n", "node", "tokens", "items"])
        return frame.astype({"doc_id": "Int64", "node": "Int64"})

    both = blocks.select("block", "payload").withColumns({"part": F.lit(None).cast("int"), "kind": F.lit(None).cast("int"), "totals": F.lit(None).cast("binary")})
    both = both.unionByName(replies.withColumn("payload", F.lit(None).cast("binary")))
    out = cut(both.groupBy("block").applyInPandas(read, SETS))
    drop(blocks)
    return out


def bitmaps(items: list[np.ndarray], width: int) -> np.ndarray:
    """A row of 0 and 1 for each set: the bits that its shingles hash to."""
    out = np.zeros((len(items), width), dtype=np.float32)
    row = np.repeat(np.arange(len(items)), [len(x) for x in items])
    out[row, (np.concatenate(items) % _U(width)).astype(np.int64)] = 1
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted arrays are linked."""
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def connect(node: np.ndarray, component: np.ndarray, own: np.ndarray, rest: np.ndarray, left: np.ndarray, right: np.ndarray, items: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """One cell: links from its left members to its right ones that connect components, one of each two at least of the tile's own band; rest: those that meet all others, so that two of them would meet twice."""
    li, ri = np.flatnonzero(left), np.flatnonzero(right)
    if not len(li) or not len(ri):
        return []
    n = np.array([len(x) for x in items], dtype=np.int64)
    width = int(min(max(LEAST_BITS, 1 << int(BITS_EACH * n.max() - 1).bit_length()), MOST_BITS))
    label = np.unique(component, return_inverse=True)[1]
    if (label == label[0]).all():
        return []
    x, y = (bitmaps([items[i] for i in side], width) for side in (li, ri))
    ones_y, n_y = y.sum(axis=1).astype(np.int64), n[ri]
    common = (x @ y.T).astype(np.int64)  # bits that both have; a bit of one alone is a shingle not shared
    ones_x = x.sum(axis=1).astype(np.int64)
    out = []
    for k, i in enumerate(li):
        most = np.minimum(n[i] - (ones_x[k] - common[k]), n_y - (ones_y - common[k]))
        fit = (100 * most >= percent * (n[i] + n_y - most)) & (100 * np.minimum(n[i], n_y) >= percent * np.maximum(n[i], n_y))
        fit &= (own[i] | own[ri]) & (~rest[ri] | (node[i] < node[ri]))
        may = ri[fit]
        may = may[label[may] != label[i]]
        while len(may):
            j, may = may[0], may[1:]
            if linked(items[i], items[j], percent):
                out.append((int(node[i]), int(node[j])))
                label[label == label[j]] = label[i]
                may = may[label[may] != label[i]]
    return out


def compare(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """members(cell, node, n, component, own, rest, left, right) -> pairs (a, b) that are linked, enough to connect what a cell's links connect."""
    members = cut(members)
    tasks = max(parts(members.sparkSession), -(-(members.agg(F.sum("n")).first()[0] or 0) // TASK_SHINGLES))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell", "node"], kind="stable", ignore_index=True)
        cell = pdf["cell"].to_numpy()
        node, component = pdf["node"].to_numpy(), pdf["component"].to_numpy()
        own, rest, left, right = (pdf[c].to_numpy(dtype=bool) for c in ("own", "rest", "left", "right"))
        items = [np.frombuffer(b, dtype=np.uint64) for b in pdf["items"]]
        out = []
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        for a, b in zip(starts, [*starts[1:], len(cell)], strict=True):
            out += connect(node[a:b], component[a:b], own[a:b], rest[a:b], left[a:b], right[a:b], items[a:b], percent)
        return pd.DataFrame({"a": np.array([x for x, _ in out], dtype=np.int64), "b": np.array([y for _, y in out], dtype=np.int64)})

    whole = members.join(nodes.select("node", "items"), "node").withColumn("task", F.pmod(F.xxhash64("cell"), F.lit(tasks)).cast("int"))
    out = cut(whole.groupBy("task").applyInPandas(run, "a long, b long"))
    drop(members)
    return out


def _tiles(rows: DataFrame) -> DataFrame:
    """rows(token, band, own, node, n) -> the tiles with a leader and somebody else, one of those with the same members."""
    seen = rows.groupBy("token", "band").agg(
        F.count(F.lit(1)).alias("members"),
        F.min(F.when(F.col("own"), F.struct("n", "node"))).alias("leader"),
        F.bit_xor(F.xxhash64("node")).alias("h1"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2"),
    )
    alike = seen.where("members > 1 AND leader IS NOT NULL").groupBy("band", "members", "h1", "h2")
    return alike.agg(F.min(F.struct("token", "leader")).alias("one")).select("one.token", "band", F.col("one.leader.node").alias("leader"), F.col("one.leader.n").alias("leader_n"))


def links(nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """nodes(node, n, tokens, items) -> pairs (a, b) that are linked, enough to connect all that any links connect."""
    step = math.log(100 / percent) * (1 - 1e-9)
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int")
    rows = nodes.select(F.explode("tokens").alias("token"), "node", "n", band.alias("band"))
    rows = rows.select("token", "node", "n", F.explode(F.array(F.struct(F.col("band"), F.lit(True).alias("own")), F.struct((F.col("band") - 1).alias("band"), F.lit(False).alias("own")))).alias("tile"))
    rows = rows.select("token", "tile.band", "tile.own", "node", "n")
    rows = cut(rows.join(_tiles(rows), ["token", "band"]))

    # every leader with the others of its tiles, dealt out so that a leader of very many is no hot key
    def lit(**flags: bool) -> list[Column]:
        return [F.lit(v).alias(k) for k, v in flags.items()]

    stars = cut(rows.where("node <> leader").select("leader", "leader_n", "node", "n").distinct())
    leaders = stars.groupBy("leader", "leader_n").agg(_cells(F.count(F.lit(1)), F.sum("n")).alias("cells"))
    place = F.xxhash64("leader", "salt").alias("cell")
    arms = stars.join(leaders.drop("leader_n"), "leader").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
    arms = arms.select(place, "node", "n", F.col("node").alias("component"), *lit(own=True, rest=False, left=False, right=True))
    heads = leaders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    heads = heads.select(place, F.col("leader").alias("node"), F.col("leader_n").alias("n"), F.col("leader").alias("component"), *lit(own=True, rest=False, left=True, right=False))
    found = compare(arms.unionByName(heads), nodes, percent)
    drop(stars)

    # tiles that still hold more than one component: what is not in the largest meets all of the tile
    named = rows.join(components(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    shares = named.groupBy("token", "band", "component").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("n"))
    mixed = shares.groupBy("token", "band").agg(F.sum("members").alias("members"), F.sum("n").alias("n"), F.max(F.struct("members", "n", "component")).alias("most"))
    mixed = mixed.where("members > most.members").select(
        "token", "band", F.col("most.component").alias("main"), _cells(F.col("members"), F.col("n")).alias("nj"), _cells(F.col("members") - F.col("most.members"), F.col("n") - F.col("most.n")).alias("ni")
    )
    every = cut(named.join(mixed, ["token", "band"]).withColumn("rest", F.col("component") != F.col("main")).select("token", "band", "node", "n", "component", "own", "rest", "ni", "nj"))
    drop(rows)
    salt = F.xxhash64("node", F.lit(5))
    whole = F.col("ni") * F.col("nj") == 1
    asks = every.where(F.col("rest") & ~whole).select("*", F.pmod(salt, F.col("ni")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), *lit(left=True, right=False))
    told = every.where(~whole).select("*", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), F.pmod(salt, F.col("nj")).cast("int").alias("j"), *lit(left=False, right=True))
    alone = every.where(whole).select("*", F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("rest").alias("left"), F.lit(True).alias("right"))
    cells = alone.unionByName(asks).unionByName(told).select(F.xxhash64("token", "band", "i", "j").alias("cell"), "node", "n", "component", "own", "rest", "left", "right")
    more = compare(cells, nodes, percent)
    drop(every)
    return found.unionByName(more)


def _cells(members: Column, shingles: Column) -> Column:
    return F.ceil(F.greatest(members / F.lit(CELL), shingles / F.lit(CELL_SHINGLES))).cast("int")


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id."""
    every = sets(docs, width, percent)
    may = every.where("node IS NOT NULL")
    nodes = cut(may.groupBy("node").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("items").alias("items")))
    placed = cut(every.select("doc_id", "n", "node"))
    drop(every)
    label = components(links(nodes, percent))
    drop(nodes)
    may = placed.where("node IS NOT NULL").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = may.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    together = may.join(lowest, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = placed.where("node IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return together.unionByName(alone)


def op6_ngram_join(spark, sf_dir):
    """Every document with the smallest document reachable by links of 0.8 or more."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
