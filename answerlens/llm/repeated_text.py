"""Removal of long repeated byte strings by prefix-free parsing.

Rolling-hash triggers (windows of 8 bytes, one in 64 on average) cut every document
into phrases; where they fall depends on the bytes alone, so equal stretches are cut
alike.  A string of ``length`` bytes that starts at some place is then described by
the parse: the first and the last trigger inside it.  Places between two changes of
that pair form a segment, about two for each phrase, and each segment gives two
keys: the stretch between its triggers, which all equal strings share, and the
stretch that all its strings cover together.  Segments are brought into one order
over the corpus by key range (see ``blocks``), which puts equal stretches side by
side:

* the covered stretch occurs in two segments: all strings of the segment repeat;
* else, if all segments with its stretch between triggers cover the same: none does;
* else, near the edges of repeats, each string is keyed by itself and counted, and
  one segment of each covered stretch that repeats sends its strings along.

The order is that of 64-bit hashes and not lexicographic, since only equal strings
need to meet; the dictionary and the parse are never held in one place.

Passages of a little over 50 words are often shorter than ``length``.  A first pass of
the same kind over shorter strings (``passage`` bytes, about 50 words of four letters
and a blank) counts what they cover in each document; nothing is removed for them.

Defined cases: a null text has no bytes; a text shorter than ``length`` loses
nothing; a text that repeats itself loses what repeats; repeated rows lose all they
share if long enough; columns other than doc_id and text do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlens.llm import blocks as B
from answerlens.llm.common import cut, drop

LENGTH = 400
#: Bytes of the shorter strings that are counted and stay.
PASSAGE = 250
WINDOW = 8
MEAN_PHRASE_BITS = 6
_U = np.uint64
_SLAB = 1 << 20
#: Stands for different covered stretches in one block.
MIXED = _U(0)


def triggers(data: np.ndarray) -> np.ndarray:
    """Places whose next 8 bytes hash to a phrase boundary."""
    out = []
    for a in range(0, max(len(data) - WINDOW + 1, 0), _SLAB):
        x = data[a : a + _SLAB + WINDOW - 1].astype(np.uint64)
        n = len(x) - WINDOW + 1
        h = np.zeros(n, dtype=np.uint64)
        for k in range(WINDOW):
            h |= x[k : k + n] << _U(8 * k)
        out.append(a + np.flatnonzero(B.mix(h) >> _U(64 - MEAN_PHRASE_BITS) == 0))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def stretch_keys(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of data[start:stop], starts ascending; about a MB is summed at a time."""
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + _SLAB)))
        base, end = start[at], stop[at:to].max()
        out[at:to] = B.Hasher(data[base:end])(start[at:to] - base, stop[at:to] - base)
        at = to
    return out


@dataclass
class Segments:
    first: np.ndarray  # first and last place of each segment
    last: np.ndarray
    bare: np.ndarray  # no trigger inside
    core: np.ndarray  # key of the stretch between the triggers (0 where bare)
    whole: np.ndarray  # key of the stretch covered


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> Segments:
    """All places at which a string of the length starts inside one document, in segments."""
    begin, end = offsets[:-1], offsets[1:] - length  # last place of each document
    long = end >= begin
    begin, end = begin[long], end[long]
    if not len(begin):
        none = np.zeros(0, dtype=np.int64)
        return Segments(none, none, none.astype(bool), none.astype(np.uint64), none.astype(np.uint64))
    t = triggers(data)
    marks = np.concatenate([t + 1, t - length + WINDOW])
    doc = np.searchsorted(begin, marks, side="right") - 1
    marks = marks[(doc >= 0) & (marks <= end[np.maximum(doc, 0)])]
    first = np.unique(np.concatenate([begin, marks]))
    doc = np.searchsorted(begin, first, side="right") - 1
    last = np.minimum(np.concatenate([first[1:] - 1, [end[-1]]]), end[doc])
    lo = np.searchsorted(t, first)
    hi = np.searchsorted(t, first + length - WINDOW, side="right") - 1
    bare = lo > hi
    core = np.zeros(len(first), dtype=np.uint64)
    ok = ~bare
    core[ok] = stretch_keys(data, t[lo[ok]], t[hi[ok]] + WINDOW)
    return Segments(first, last, bare, core, stretch_keys(data, first, last + length))


def spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All places of the segments."""
    n = last - first + 1
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)


STATE = B.REQUEST + ", totals binary"


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _passes(blocks: DataFrame, n: int, length: int) -> tuple[DataFrame, DataFrame]:
    """Each block with all that tells which of its strings of the length repeat (see ``_covered``), and the checkpoint it reads."""

    def ask(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for block, payload in zip(pdf["block"], pdf["payload"], strict=True):
                s = segments(*B.bytes_of(B.unpack(payload)["text"]), length)
                core, whole = s.core[~s.bare], s.whole[~s.bare]
                keys, at = np.unique(core, return_inverse=True)
                low, high = np.full(len(keys), ~_U(0)), np.zeros(len(keys), dtype=np.uint64)
                np.minimum.at(low, at, whole)
                np.maximum.at(high, at, whole)
                rows = B.requests(block, 1, keys, np.where(low == high, low, MIXED), n, B.to_bytes)
                rows += B.requests(block, 2, *np.unique(s.whole, return_counts=True), n)
                yield pd.DataFrame(rows, columns=["block", "part", "kind", "keys", "counts"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind in sorted(pdf["kind"].unique()):
            mine = pdf[pdf["kind"] == kind]
            pieces = [B.unpack_keys(b) for b in mine["keys"]]
            if kind == 1:  # whether one stretch between triggers lies in different covered stretches
                keys, places, firsts, _ = B.add_up(pieces, [np.ones(len(x)) for x in pieces])
                covered, at = np.concatenate([B.from_bytes(b, np.uint64) for b in mine["counts"]]), np.concatenate(places)
                low, high = np.full(len(keys), ~_U(0)), np.zeros(len(keys), dtype=np.uint64)
                np.minimum.at(low, at, covered)
                np.maximum.at(high, at, covered)
                yes = (low != high) | (low == MIXED)
            else:
                _, places, firsts, totals = B.add_up(pieces, [B.unpack_counts(b) for b in mine["counts"]])
                yes = totals > 1
            out += [(b, p, kind, B.pack_counts(yes[x] * 2 + f)) for b, p, x, f in zip(mine["block"], mine["part"], places, firsts, strict=True)]
        return pd.DataFrame(out, columns=["block", "part", "kind", "totals"])

    def sort_out(pdf: pd.DataFrame) -> pd.DataFrame:
        """A block with its answers -> the keys of single strings still in question (kind 3), and its segments (kind 4)."""
        block = int(pdf["block"].iloc[0])
        data, offsets = B.bytes_of(B.unpack(pdf["payload"].dropna().iloc[0])["text"])
        s = segments(data, offsets, length)
        on_core, on_whole = (B.collect_replies(pdf, k, "totals", B.unpack_counts) for k in (1, 2))
        keys, at_first, at = np.unique(s.whole, return_index=True, return_inverse=True)
        whole = on_whole[at] > 1 if len(keys) else np.zeros(0, bool)
        sender = np.zeros(len(whole), dtype=bool)  # the one segment that speaks for a covered stretch
        sender[at_first[(on_whole & 1).astype(bool)]] = True
        mixed = s.bare.copy()
        if len(on_core):
            core = s.core[~s.bare]
            mixed[~s.bare] = on_core[np.searchsorted(np.unique(core), core)] > 1
        open_ = mixed & ~whole
        speaks = mixed & (~whole | sender)
        at = spread(s.first[speaks], s.last[speaks])
        rows = B.requests(block, 3, *np.unique(stretch_keys(data, at, at + length), return_counts=True), n) if len(at) else []
        ends = [B.to_bytes(np.stack([s.first[m], s.last[m]])) for m in (whole, open_, speaks)]
        return pd.DataFrame([(*r, None) for r in rows] + [(block, -1, 4, *ends)], columns=["block", "part", "kind", "keys", "counts", "totals"])

    text = blocks.select("block", "payload").withColumns({"part": _null("int"), "kind": _null("int"), "totals": _null("binary")})
    first = blocks.select("block", "payload").mapInPandas(ask, B.REQUEST).groupBy("part").applyInPandas(answer, B.REPLY)
    both = text.unionByName(first.withColumn("payload", _null("binary")))
    step = cut(both.groupBy("block").applyInPandas(sort_out, STATE))
    second = step.where("kind = 3").drop("totals").groupBy("part").applyInPandas(answer, B.REPLY)
    keys = {"keys": _null("binary"), "counts": _null("binary")}
    states = step.where("kind = 4").withColumn("payload", _null("binary"))
    return text.withColumns(keys).unionByName(second.withColumns(keys | {"payload": _null("binary")})).unionByName(states), step


def _covered(pdf: pd.DataFrame, length: int) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A block's rows, its bytes, where each text begins, and which bytes lie in a string of the length that repeats."""
    t = B.unpack(pdf["payload"].dropna().iloc[0])
    data, offsets = B.bytes_of(t["text"])
    own = pdf[pdf["kind"] == 4].iloc[0]
    whole, open_ = (B.from_bytes(own[c], np.int64).reshape(2, -1) for c in ("keys", "counts"))
    at = spread(*open_)
    if len(at):
        flags = B.collect_replies(pdf, 3, "totals", B.unpack_counts) > 1
        every = spread(*B.from_bytes(own["totals"], np.int64).reshape(2, -1))
        keys = stretch_keys(data, at, at + length)
        at = at[flags[np.searchsorted(np.unique(stretch_keys(data, every, every + length)), keys)]]
    rise = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(rise, whole[0], 1)
    np.add.at(rise, whole[1] + length, -1)
    np.add.at(rise, at, 1)
    np.add.at(rise, at + length, -1)
    return t, data, offsets, np.cumsum(rise)[:-1] > 0


def repeats(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, spans array<struct<start,stop>> removed, kept (the bytes that are left), n_shared (bytes in strings of passage bytes that start elsewhere too)."""
    blocks = B.pack(docs.select("doc_id", "text"))
    n = B.n_ranges(blocks)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, offsets, shared = _covered(pdf, passage)
        n_shared = np.diff(np.concatenate([[0], np.cumsum(shared)])[offsets])
        return pd.DataFrame([(int(pdf["block"].iloc[0]), -1, 5, None, None, B.pack_counts(n_shared))], columns=["block", "part", "kind", "keys", "counts", "totals"])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        t, data, offsets, gone = _covered(pdf, length)
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        starts = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]])))
        stops = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
        which = np.searchsorted(starts, offsets)
        left = data[~gone]
        cuts = np.concatenate([[0], np.cumsum(~gone)])[offsets]
        spans = [[{"start": int(x - offsets[i]), "stop": int(y - offsets[i])} for x, y in zip(starts[a:b], stops[a:b], strict=True)] for i, (a, b) in enumerate(zip(which, which[1:], strict=False))]
        kept = [left[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        n_shared = B.unpack_counts(pdf.loc[pdf["kind"] == 5, "totals"].iloc[0])
        return pd.DataFrame({"doc_id": pd.array(t["doc_id"].to_pylist(), dtype="Int64"), "n_bytes": np.diff(offsets), "spans": spans, "kept": kept, "n_shared": n_shared})

    every, step = _passes(blocks, n, passage)
    shared = cut(every.groupBy("block").applyInPandas(count, STATE))
    drop(step)
    every, _ = _passes(blocks, n, length)
    every = every.unionByName(shared.withColumn("payload", _null("binary")))
    return every.groupBy("block").applyInPandas(finish, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary, n_shared long")


def op4_repeated_text(spark, sf_dir):
    """Every document with what repeated strings of 400 bytes take from it."""
    out = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_shared")
