"""A Katz back-off n-gram model: counting, exact normalisation and recursive scoring.

Counts r up to 5 get Good-Turing discounts, larger ones lose half a count, so that
every seen history leaves something for what it was not seen with.  A word's
probability after a history of up to ``order - 1`` tokens is its discounted share if
the n-gram was seen; else the history's back-off weight times its probability after
the history without its first token, and so on down to the word's own probability;
what is left there goes to the one unknown word.  Back-off weights make the
probabilities after every history, unknown word included, add up to exactly 1.

Counting goes from order to order.  The n-grams of a block (see ``blocks``) whose
history and whose n-gram without its first token both occur in other blocks too are
sent to the task of their key range, which adds them up, answers every block with
the totals of its own and writes its part of the order's table.  All other n-grams
occur in one block only, so that block's count is the total and they are not sent.
The tables are Parquet, partitioned by order, one row a range with its sorted keys and
totals and how many n-grams have each small count; what only single blocks have is a
row without keys.  Discounts are read from these tables.

Back-off weights rest on whole numbers, namely how many successors of a history have each
small count and the sum of the larger ones, for the successors and for their shorter
n-grams; each n-gram is counted by one block.  They are added up by history where a
held-out text may ask for it, so they do not depend on how the corpus lies in blocks.

Defined cases: a null or empty text is the end token alone; with no training row
every token is unknown with probability 1; repeated rows count each; an empty table
gives no rows; a null doc_id counts as the empty text for the split; a document longer
than a block is a block of its own; columns other than doc_id and text do not matter.
64-bit keys stand for n-grams (see ``blocks``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlens.llm import blocks as B
from answerlens.llm.common import cut, drop, id_bucket, remove, shared_dir

ORDER = 3
K = 5
_U = np.uint64
END = B.mix(np.array([11], dtype=np.uint64))[0]
BEGIN = B.mix(np.array([12], dtype=np.uint64))[0]
#: Bits of a reply: the block is the n-gram's first, other blocks have it, a held-out text has it.
FIRST, SHARED, HELD = 1, 2, 4


@dataclass
class Grams:
    """One order's distinct n-grams of a block; places are tokens, each document's begin token included."""

    keys: np.ndarray
    at: np.ndarray  # place -> number of the n-gram that ends there, -1 for none
    history: np.ndarray  # n-gram -> number, one order below, of what it follows
    shorter: np.ndarray  # n-gram -> number, one order below, of it without its first token
    train: np.ndarray  # occurrences in training documents
    held: np.ndarray  # whether a held-out document has it


def tokens(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All documents' tokens between a begin and an end, the document of each, and its place there."""
    w, n = B.words(t["text"])
    size = n + 2
    starts = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(n), dtype=np.int32), size)
    seq = np.full(size.sum(), END, dtype=np.uint64)
    seq[starts] = BEGIN
    seq[np.arange(len(w)) + 2 * np.repeat(np.arange(len(n)), n) + 1] = w
    return seq, doc, (np.arange(len(seq)) - starts[doc]).astype(np.int32)


def grams(t: pa.Table, order: int) -> tuple[list[Grams], np.ndarray, np.ndarray]:
    """The n-grams of orders 1..order, with the document and the place of each token."""
    seq, doc, place = tokens(t)
    train = t["train"].to_numpy()[doc]
    out: list[Grams] = []
    key = seq
    for n in range(1, order + 1):
        if n > 1:
            key = B.mix(np.concatenate([key[:1], key[:-1]]) * _U(0x9E3779B97F4A7C15) ^ B.mix(seq))
        have = np.flatnonzero(place >= n - 1)
        keys, first, number = np.unique(key[have], return_index=True, return_inverse=True)
        at = np.full(len(seq), -1, dtype=np.int32)
        at[have] = number
        first = have[first] if len(have) else first
        history, shorter = (out[-1].at[first - 1], out[-1].at[first]) if n > 1 else (first, first)
        counts = np.bincount(number, weights=train[have], minlength=len(keys)).astype(np.int64)
        held = np.bincount(number, minlength=len(keys)) > counts
        out.append(Grams(keys, at, history, shorter, counts, held))
    return out, doc, place


def discounts(n: np.ndarray) -> np.ndarray:
    """n[r] n-grams have count r, r = 1..K+1 -> factor for each count 0..K; Katz's, where it lies between 0 and 1."""
    d = np.array([1.0] + [1 - 0.5 / r for r in range(1, K + 1)])
    if n[1] > 0:
        common = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            if n[r] > 0 and common < 1:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                if 0 < x < 1:
                    d[r] = x
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c <= K, c * d[np.minimum(c, K)], c - 0.5)


def spread(totals: np.ndarray) -> np.ndarray:
    """The sum of the totals, then how many are 0, 1, .. K + 1 and more."""
    return np.concatenate([[totals.sum()], np.bincount(np.minimum(totals, K + 2), minlength=K + 3)])


def summary(c: np.ndarray, group: np.ndarray, n_groups: int) -> np.ndarray:
    """For each group of counts: how many are 1, .. K, how many larger, and the sum of those."""
    kind = np.minimum(c, K + 1)
    many = np.bincount(group * (K + 2) + kind, minlength=n_groups * (K + 2)).reshape(n_groups, K + 2)[:, 1:]
    large = np.bincount(group, weights=np.where(c > K, c, 0), minlength=n_groups).astype(np.int64)
    return np.concatenate([many, large[:, None]], axis=1)


def mass(s: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What a summary's counts add up to after discounts."""
    return s[:, :K] @ (d[1 : K + 1] * np.arange(1, K + 1)) + s[:, K + 1] - 0.5 * s[:, K]


def known(pdf: pd.DataFrame, g: list[Grams], upto: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Totals and reply bits of a block's n-grams of orders 1..upto: from the replies, and from the block where it is the only one."""
    totals: list[np.ndarray] = []
    bits: list[np.ndarray] = []
    for n in range(1, upto + 1):
        sent = is_sent(g, bits, n)
        t, b = g[n - 1].train.copy(), np.full(len(sent), FIRST, dtype=np.int64)
        reply = B.collect_replies(pdf, n, "totals", B.unpack_counts)
        t[sent], b[sent] = reply >> 3, reply & 7
        totals.append(t)
        bits.append(b)
    return totals, bits


def is_sent(g: list[Grams], bits: list[np.ndarray], n: int) -> np.ndarray:
    """Whether other blocks may have an n-gram: they have its history and what it is without its first token."""
    if n == 1:
        return np.ones(len(g[0].keys), dtype=bool)
    shared = (bits[n - 2] & SHARED) > 0
    return shared[g[n - 1].history] & shared[g[n - 1].shorter]


ASKED = "block long, part int, kind int, keys binary, counts binary, totals binary"


def _with_replies(blocks: DataFrame, replies: list[DataFrame]) -> DataFrame:
    """Every block's text beside the replies it got."""
    rows = blocks.select("block", F.lit(None).cast("int").alias("part"), F.lit(None).cast("int").alias("kind"), "payload", F.lit(None).cast("binary").alias("totals"))
    for r in replies:
        rows = rows.unionByName(r.where("block >= 0").select("block", "part", "kind", F.lit(None).cast("binary").alias("payload"), "totals"))
    return rows


def count(blocks: DataFrame, replies: list[DataFrame], n: int, n_parts: int) -> DataFrame:
    """The n-grams of order n, added up: replies to the blocks, and the order's table (block -1)."""

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        g, _, _ = grams(B.unpack(pdf["payload"].dropna().iloc[0]), n)
        sent, own = is_sent(g, known(pdf, g, n - 1)[1], n), g[n - 1]
        rows = B.requests(block, n, own.keys[sent], own.train[sent] * 2 + own.held[sent], n_parts)
        if n > 1:
            rows.append((-1, block % n_parts, n, b"", B.pack_counts(spread(own.train[~sent]))))
        return pd.DataFrame(rows, columns=["block", "part", "kind", "keys", "counts"])

    def ask_first(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for i in range(len(pdf)):
                yield ask(pdf.iloc[i : i + 1])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        part, mine = int(pdf["part"].iloc[0]), pdf[pdf["block"] >= 0]
        alone = sum((B.unpack_counts(b) for b in pdf[pdf["block"] < 0]["counts"]), np.zeros(K + 4, dtype=np.int64))
        out = [(-1, part, n, None, None, B.pack_counts(alone))]
        if len(mine):
            counts = [B.unpack_counts(b) for b in mine["counts"]]
            keys, places, firsts, totals = B.add_up([B.unpack_keys(b) for b in mine["keys"]], [c >> 1 for c in counts])
            every = np.concatenate(places)
            bits = np.where(np.bincount(every) > 1, SHARED, 0) | np.where(np.bincount(every, weights=np.concatenate(counts) & 1) > 0, HELD, 0)
            out += [(b, part, n, None, None, B.pack_counts(totals[p] << 3 | bits[p] | f)) for b, p, f in zip(mine["block"], places, firsts, strict=True)]
            tell = spread(totals[keys != BEGIN]) if n == 1 else spread(totals)
            out.append((-1, part, n, B.pack_keys(keys), B.pack_counts(totals), B.pack_counts(tell)))
        return pd.DataFrame(out, columns=["block", "part", "kind", "keys", "counts", "totals"])

    asked = blocks.select("block", "payload").mapInPandas(ask_first, B.REQUEST) if n == 1 else _with_replies(blocks, replies).groupBy("block").applyInPandas(ask, B.REQUEST)
    return cut(asked.groupBy("part").applyInPandas(answer, ASKED))


def write_tables(replies: list[DataFrame], folder: str) -> dict[int, np.ndarray]:
    """The n-gram tables as Parquet in folder, by order; read back: order -> spread() of its totals."""
    for r in replies:
        table = r.where("block = -1").select(F.col("kind").alias("order"), "part", "keys", F.col("counts").alias("totals"), F.col("totals").alias("spread"))
        table.write.mode("append").partitionBy("order").parquet(folder)
    rows = replies[0].sparkSession.read.schema("part int, keys binary, totals binary, spread binary, order int").parquet(folder).select("order", "spread").toPandas()  # two short rows a range and order
    return {n: sum((B.unpack_counts(b) for b in rows[rows["order"] == n]["spread"]), np.zeros(K + 4, dtype=np.int64)) for n in range(1, len(replies) + 1)}


def score(docs: DataFrame, train: Column, order: int = ORDER, tables: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; the model's tables stay in the folder tables, if one is given."""
    blocks = B.pack(docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train")))
    n_parts = B.n_ranges(blocks)
    replies: list[DataFrame] = []
    for n in range(1, order + 1):
        replies.append(count(blocks, replies, n, n_parts))
    folder = tables or f"{shared_dir(docs.sparkSession)}/katz-{uuid4().hex}"
    stats = write_tables(replies, folder)
    if not tables:
        remove(docs.sparkSession, folder)
    total, vocabulary = int(stats[1][0]), int(stats[1][2:].sum())
    d = [np.zeros(0), *(discounts(stats[n][1 : K + 3]) for n in range(1, order + 1))]
    words = stats[1][1:]  # what the words' own probabilities leave to the unknown word
    small = (words[1 : K + 1] * np.arange(1, K + 1)).sum()
    unknown = 1 - ((d[1][1:] * np.arange(1, K + 1) * words[1 : K + 1]).sum() + total - small - 0.5 * words[K + 1 :].sum()) / total if total else 1.0

    def read(pdf: pd.DataFrame) -> pd.DataFrame:
        """A block with its counts -> what it adds to back-off weights (kind 10 + order of the history), the histories it asks for (20 + order), its documents (5)."""
        block = int(pdf["block"].iloc[0])
        t = B.unpack(pdf["payload"].dropna().iloc[0])
        g, doc, place = grams(t, order)
        c, bits = known(pdf, g, order)
        out, open_, value = [], place > 0, np.zeros(len(doc))
        lookups, at_lookup = [], []  # keys of back-off weights that other blocks hold a part of, and the places that need them
        held_doc = ~t["train"].to_numpy()
        for n in range(order, 1, -1):
            of, h = g[n - 1], g[n - 1].history
            ch = c[n - 2][h]
            with np.errstate(divide="ignore", invalid="ignore"):
                log_p = np.log10(discounted(c[n - 1], d[n]) / np.maximum(ch, 1))
            # what this block's n-grams add to their histories' back-off weights
            owned = (c[n - 1] > 0) & ((bits[n - 1] & FIRST) > 0)
            names, which = np.unique(h[owned], return_inverse=True)
            adds = np.concatenate([summary(c[n - 1][owned], which, len(names)), summary(c[n - 2][of.shorter[owned]], which, len(names))], axis=1)
            sends = ((bits[n - 2][names] & SHARED) > 0) & ((bits[n - 2][names] & HELD) > 0)
            if sends.any():
                out += B.requests(block, 10 + n, g[n - 2].keys[names[sends]], adds[sends], n_parts, pack_table)
            here = np.flatnonzero(open_ & (of.at >= 0))
            number = of.at[here]
            seen = c[n - 1][number] > 0
            value[here[seen]] += log_p[number[seen]]
            open_[here[seen]] = False
            # back off: histories that were seen have a weight, others the weight 1
            back = here[~seen & (ch[number] > 0)]
            hist = h[of.at[back]]
            local = (bits[n - 2][hist] & SHARED) == 0
            weight = np.zeros(len(g[n - 2].keys))
            below = _below(g, c, n, total)
            ours = names[~sends]
            weight[ours] = log_weight(adds[~sends], c[n - 2][ours], below[ours], d, n)
            value[back[local]] += weight[hist[local]]
            wanted, which = np.unique(hist[~local], return_inverse=True)
            lookups.append((n, wanted, below[wanted]))
            at_lookup.append((back[~local], which))
        own = np.where(c[0] > 0, discounted(c[0], d[1]) / max(total, 1), unknown)
        value[open_] += np.log10(own[g[0].at[open_]])
        real = place > 0
        n_docs = t.num_rows
        sums = np.bincount(doc, weights=np.where(real, value, 0.0), minlength=n_docs)
        cells, offset = [], 0
        for (n, wanted, under), (at, which) in zip(lookups, at_lookup, strict=True):
            out += B.requests(block, 20 + n, g[n - 2].keys[wanted], under, n_parts)  # numbers of keys ascend as keys do
            cells.append(np.stack([doc[at], which + offset]))
            offset += len(wanted)
        pairs, times = np.unique(np.concatenate(cells, axis=1), axis=1, return_counts=True) if cells else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
        c_real, d_real = c[0][g[0].at[real]], doc[real]
        body = pa.table({
            "doc_id": t["doc_id"], "train": t["train"], "n_tokens": np.bincount(d_real, minlength=n_docs), "n_known": np.bincount(d_real, weights=c_real > 0, minlength=n_docs).astype(np.int64),
            "base": np.bincount(d_real, weights=np.log10((c_real + 1) / (total + (vocabulary + 1))), minlength=n_docs), "sums": sums,
        })
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, body.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(body)
        rows = [(*r, None) for r in out]
        rows.append((block, -1, 5, B.to_bytes(pairs.astype(np.int64)), B.pack_counts(times), sink.getvalue().to_pybytes()))
        return pd.DataFrame(rows, columns=["block", "part", "kind", "keys", "counts", "totals"])

    step = cut(_with_replies(blocks, replies).groupBy("block").applyInPandas(read, ASKED))
    drop(blocks, *replies)

    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        """A range of histories: back-off weights from all blocks' parts, for the blocks that ask."""
        out = []
        for n in range(2, order + 1):
            asked, terms = pdf[pdf["kind"] == 20 + n], pdf[pdf["kind"] == 10 + n]
            if not len(asked):
                continue
            keys = np.concatenate([B.unpack_keys(b) for b in terms["keys"]] or [np.zeros(0, np.uint64)])
            adds = np.concatenate([unpack_table(b) for b in terms["counts"]] or [np.zeros((0, 2 * K + 4), np.int64)])
            every, at = np.unique(keys, return_inverse=True)
            sums = np.zeros((len(every), adds.shape[1]), dtype=np.int64)
            np.add.at(sums, at, adds)
            followed = sums[:, :K] @ np.arange(1, K + 1) + sums[:, K + 1]  # what a history was followed by, so how often it occurred
            for block, packed, under in zip(asked["block"], asked["keys"], asked["counts"], strict=True):
                place = np.searchsorted(every, B.unpack_keys(packed))  # all are there: a seen history has successors
                out.append((block, int(pdf["part"].iloc[0]), 20 + n, B.to_bytes(log_weight(sums[place], followed[place], B.unpack_counts(under), d, n))))
        return pd.DataFrame(out, columns=["block", "part", "kind", "weights"])

    weights = step.where("kind > 5").groupBy("part").applyInPandas(weigh, "block long, part int, kind int, weights binary")

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        body = pdf[pdf["kind"] == 5].iloc[0]
        t = pa.ipc.open_stream(body["totals"]).read_all()
        mine = pdf[pdf["kind"] != 5].sort_values(["kind", "part"], ascending=[False, True])
        alpha = np.concatenate([np.zeros(0), *(B.from_bytes(b, np.float64) for b in mine["weights"])])
        pairs, times = B.from_bytes(body["keys"], np.int64).reshape(2, -1), B.unpack_counts(body["counts"])
        extra = np.bincount(pairs[0], weights=times * alpha[pairs[1]], minlength=t.num_rows)
        out = t.select(["doc_id", "n_tokens", "n_known"]).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        out["held_out"] = ~t["train"].to_numpy()
        out["base_score"] = t["base"].to_numpy()
        out["score"] = t["sums"].to_numpy() + extra
        return out

    null = F.lit(None).cast("binary")
    state = step.where("kind = 5").withColumn("weights", null)
    replied = weights.withColumns({"keys": null, "counts": null, "totals": null})
    done = state.unionByName(replied).groupBy("block").applyInPandas(finish, "doc_id long, n_tokens long, n_known long, held_out boolean, base_score double, score double")
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def _below(g: list[Grams], c: list[np.ndarray], n: int, total: int) -> np.ndarray:
    """For the histories of order-n n-grams: how often the shorter history that their successors back off to occurred (all tokens for none)."""
    if n == 2:
        return np.full(len(g[0].keys), total, dtype=np.int64)
    of = g[n - 2]  # a history (h2, h1) of order n - 1 backs off to h1, the last tokens of it
    return c[n - 3][of.shorter]


def log_weight(adds: np.ndarray, times: np.ndarray, below: np.ndarray, d: list[np.ndarray], n: int) -> np.ndarray:
    """log10 of back-off weights of histories that occurred so many times, the shorter ones below times."""
    left = 1 - mass(adds[:, : K + 2], d[n]) / np.maximum(times, 1)
    free = 1 - mass(adds[:, K + 2 :], d[n - 1]) / np.maximum(below, 1)
    return np.log10(np.maximum(left, 1e-300) / np.maximum(free, 1e-300))


def pack_table(a: np.ndarray) -> bytes:
    """Rows of small numbers, column by column."""
    return B.pack_counts(np.ascontiguousarray(a.T).ravel())


def unpack_table(b: bytes) -> np.ndarray:
    return B.unpack_counts(b).reshape(2 * K + 4, -1).T


def op2_katz(spark, sf_dir):
    """Every document's log10 probability under a model of six sevenths of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, id_bucket("doc_id", 7) != 2)
