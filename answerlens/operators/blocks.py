"""The best chunks of a shard for many queries, by block bounds.

The postings of a term in a shard are a block with its peak.  A query's terms are put in
the order of what their blocks can give at most.  Those that together cannot reach the
k-th best score found so far need not bring up a chunk by themselves: their postings are
looked up only for chunks that the others have brought up and that can still get there.
If all together cannot reach it, the shard is passed by.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from answerlens.operators.index import K1, B

#: Scores are rounded to six digits: what is nearer to the k-th best than this is not passed by.
SLACK = 2e-6


def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each shard and base (sorted by them, the row of its chunks first), one batch for that row and one for its terms."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None

    def out() -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        return [x.to_batches()[0] for x in (table.slice(0, 1), table.slice(1)) if len(x)]

    for batch in batches:
        shard = batch["shard"].to_numpy()
        base = batch["kb_id"].dictionary_encode(null_encoding="encode").indices.to_numpy()
        cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(base) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            this = (batch["shard"][int(a)].as_py(), batch["kb_id"][int(a)].as_py()) if b > a else key
            if held and this != key:
                yield out()
                held = []
            key = this
            if b > a:
                held.append(batch.slice(int(a), int(b - a)))
    if held:
        yield out()


class QueryBlock:
    """Weighed terms of many queries: query_id, kb_id, term, weight (times of the query x idf), avgdl."""

    def __init__(self, rows: list, k: int):
        self.k = k
        ids = list(dict.fromkeys(r["query_id"] for r in rows))
        self.query_ids = pa.array(ids)
        number = {q: i for i, q in enumerate(ids)}
        self.by_base: dict = defaultdict(lambda: defaultdict(list))
        self.avgdl = {}
        for r in rows:
            self.by_base[r["kb_id"]][r["term"]].append((number[r["query_id"]], r["weight"]))
            self.avgdl[r["kb_id"]] = r["avgdl"]
        self.by_base = {kb: dict(terms) for kb, terms in self.by_base.items()}

    def start(self) -> list[np.ndarray]:
        """Of each query, the best k scores so far."""
        return [np.zeros(0)] * len(self.query_ids)

    def best_of(self, shard: list[pa.RecordBatch], best: list[np.ndarray], read: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query numbers, places and scores of the shard's chunks that may be among the best k; read counts the postings read and all of them."""
        kb = shard[0]["kb_id"][0].as_py()
        if len(shard) < 2 or kb not in self.by_base:
            return []
        dls = shard[0]["dls"].flatten().to_numpy()
        norm = K1 * (1 - B + B * dls / self.avgdl[kb])
        rows = shard[1]
        places, tfs, bounds = rows["places"].flatten().to_numpy(), rows["tfs"].flatten().to_numpy(), rows["places"].offsets.to_numpy()
        bounds = bounds - bounds[0]
        peaks = rows["peak"].to_numpy() * (K1 + 1) * np.maximum(1.0, self.avgdl[kb] / rows["mean"].to_numpy())  # a mean that has grown since lifts a share by no more than that
        asked = self.by_base[kb]
        of_query: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for row, term in enumerate(rows["term"].to_pylist()):
            for q, weight in asked.get(term, ()):
                of_query[q].append((row, weight))
        shares: dict[int, np.ndarray] = {}

        def share(row: int) -> np.ndarray:
            if row not in shares:
                tf = tfs[bounds[row] : bounds[row + 1]]
                shares[row] = tf * (K1 + 1) / (tf + norm[places[bounds[row] : bounds[row + 1]]])
            return shares[row]

        out = []
        total = np.zeros(len(dls))
        for q, parts in of_query.items():
            lines = np.array([r for r, _ in parts])
            weights = np.array([w for _, w in parts])
            most = np.maximum(weights * peaks[lines], 0.0)  # a negative idf, where most terms are in most chunks, only takes away
            order = np.argsort(most, kind="stable")
            below = np.cumsum(most[order])
            least = best[q][0] - SLACK if len(best[q]) == self.k else 0.0
            sizes = bounds[lines + 1] - bounds[lines]
            if read is not None:
                read[1] += int(sizes.sum())
            if below[-1] < least or below[-1] <= 0:
                continue
            split = int(np.searchsorted(below, least, side="left"))  # the first of these bring up no chunk by themselves
            total[:] = 0
            for i in order[split:]:
                total[places[bounds[lines[i]] : bounds[lines[i] + 1]]] += weights[i] * share(lines[i])
                if read is not None:
                    read[0] += int(sizes[i])
            alive = np.flatnonzero(total > 0)
            for j in range(split - 1, -1, -1):
                alive = alive[total[alive] + below[j] >= least]
                i = order[j]
                own = places[bounds[lines[i]] : bounds[lines[i] + 1]]
                at = np.minimum(np.searchsorted(own, alive), len(own) - 1)
                hit = own[at] == alive
                total[alive[hit]] += weights[i] * share(lines[i])[at[hit]]
                if read is not None:
                    read[0] += int(hit.sum())
            score = np.round(total[alive], 6)
            alive, score = alive[score > 0], score[score > 0]
            if len(alive) > self.k:  # ties of the k-th all go on
                kth = np.partition(score, len(score) - self.k)[len(score) - self.k]
                alive, score = alive[score >= kth], score[score >= kth]
            both = np.sort(np.concatenate([best[q], score]))
            best[q] = both[-self.k :]
            out.append((np.full(len(alive), q), alive, score))
        return out
