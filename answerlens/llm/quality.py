"""Quality scores learned from preference pairs (Bradley-Terry).

A document marked 1 is preferred to a document marked 0.  The score is linear in
features of the text (shares of byte values, of pairs of neighbouring byte classes,
the length and how often words repeat), fitted by logistic loss on the features' differences over pairs.
The cut between the classes is a quantile of the scores of sampled documents that
the fit did not see; scores are then scaled to 0..1 so that the cut lies at the
wanted probability.

Learning uses a bounded sample of labelled rows (``sample`` documents, chosen by a
hash of the id); scoring reads every text whole.

Defined cases: a null text counts as empty and gets a score like any other; labels
that are null or contradict one another for one document are not learned from;
with one class only, every score is that class's share; repeated rows get equal
scores, and where a labelled id has several texts the last in order is learned from; an
empty table gives no rows; a long text is counted in pieces; columns other than doc_id
and text are never inputs, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerlens.llm.common import id_bucket

SAMPLE = 8000
PAIRS = 30_000
CUT = 0.3
#: Bytes of text that are turned into features together.
CHUNK = 4 << 20
N_CLASSES = 8
SHORT = 100
N_FEATURES = 256 + N_CLASSES * N_CLASSES + 3


def _classes() -> np.ndarray:
    """Byte -> class: 0 blank, 1 line end, 2 digit, 3 capital, 4 small letter, 5 sentence mark, 6 other mark, 7 beyond ASCII."""
    c = np.full(256, 6, dtype=np.int64)
    c[[9, 11, 12, 32]] = 0
    c[[10, 13]] = 1
    c[48:58], c[65:91], c[97:123] = 2, 3, 4
    c[[ord(x) for x in ",.;:'\"?-"]] = 5
    c[128:] = 7
    return c


CLASS = _classes()


def features(texts: pa.Array) -> np.ndarray:
    """A row of features for each text; memory is bounded by the number of texts and CHUNK."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    n = len(texts)
    single = np.zeros((n, 256))
    double = np.zeros((n, N_CLASSES * N_CLASSES))
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + CHUNK, side="right")) - 1)
        for a in range(int(offsets[start]), int(offsets[stop]), CHUNK):  # one very long text is taken in pieces
            b = min(a + CHUNK, int(offsets[stop]))
            who = np.repeat(np.arange(stop - start), np.diff(np.clip(offsets[start : stop + 1], a, b)))
            x = data[a:b]
            single[start:stop] += np.bincount(who * 256 + x, minlength=(stop - start) * 256).reshape(-1, 256)
            k = CLASS[x]
            pair = who[1:] * (N_CLASSES * N_CLASSES) + k[:-1] * N_CLASSES + k[1:]
            double[start:stop] += np.bincount(pair[who[1:] == who[:-1]], minlength=(stop - start) * N_CLASSES * N_CLASSES).reshape(stop - start, -1)
        start = stop
    length = np.diff(offsets)[:, None]
    share = length + SHORT  # the shares of a short text say little: they are drawn towards 0
    words = [(len(w), len(set(w))) for w in (x.split() for x in texts.to_pylist())]
    total, distinct = np.array(words, dtype=np.float64).reshape(n, 2).T
    repeats = np.stack([1 - distinct / np.maximum(total, 1), np.log1p(total) - np.log1p(distinct)], axis=1)
    return np.hstack([np.sqrt(single / share), np.sqrt(double / share), np.log1p(length) / 10, repeats]).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    cut: float  # raw score at probability CUT
    slope: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self.slope * (x.astype(np.float64) @ self.weights - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-2, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Weights by Newton's method on the mean logistic loss of preferred minus other."""
    rng = np.random.default_rng(seed)
    up, down = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = x[rng.choice(up, pairs)] - x[rng.choice(down, pairs)]
    scale = d.std(axis=0) + 1e-3
    d = d / scale
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # probability of the wrong order
        gradient = -(d.T @ p) / len(d) + ridge * w
        h = (d * (p * (1 - p) + 1e-4)[:, None].astype(np.float32)).T @ d / len(d) + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, gradient)
    return w / scale


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Model:
    """Pairs from the rows not held back; the cut is the quantile of all sampled scores with the best balanced accuracy on those held back."""
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(N_FEATURES), 0.0, 1.0, float(y.mean()) if len(y) else 0.5)
    if min((y[~held] == 0).sum(), (y[~held] == 1).sum(), (y[held] == 0).sum(), (y[held] == 1).sum()) < 5:
        held = np.zeros(len(y), dtype=bool)
    w = fit_pairs(x[~held], y[~held])
    raw = x.astype(np.float64) @ w
    judged = held if held.any() else ~held
    cuts = np.quantile(raw, np.linspace(0.005, 0.995, 199))
    r, t = raw[judged], y[judged] == 1
    balance = [((r[t] >= c).mean() + (r[~t] < c).mean()) / 2 for c in cuts]
    best = np.flatnonzero(np.array(balance) >= max(balance) - 1e-9)
    cut = float(cuts[best[len(best) // 2]])
    base = np.log(CUT / (1 - CUT))
    slopes = np.geomspace(0.05, 20, 60)
    loss = [np.logaddexp(0, -(2 * t - 1) * (s * (r - cut) + base)).mean() for s in slopes]
    return Model(w, cut, float(slopes[int(np.argmin(loss))]))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs(doc_id, text), labels(doc_id, quality) -> model, from about so many labelled documents."""
    clean = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("_y")).where("y = _y")
    rate = min(1.0, sample / max(1, clean.count()))
    place = F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1_000_000)) / F.lit(1e6)
    chosen = clean.where(place < rate).select("doc_id", "y")  # about `sample` rows, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(b.schema.get_field_index("text")).cast(pa.large_string()))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("y")).cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    got = rows.mapInArrow(run, "doc_id long, y int, x binary").toPandas().sort_values("doc_id")
    x = np.frombuffer(b"".join(got["x"]), dtype=np.float32).reshape(len(got), N_FEATURES) if len(got) else np.zeros((0, N_FEATURES), np.float32)
    held = np.array([hash((int(i), 43)) % 5 == 0 for i in got["doc_id"]], dtype=bool)
    return fit(x, got["y"].to_numpy(), held)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                b = batch.slice(a, 2000)
                s = shared.value.score(features(b.column(b.schema.get_field_index("text")).cast(pa.large_string())))
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def held_out() -> Column:
    return id_bucket("doc_id", 5) == 0


def op3_quality(spark, sf_dir):
    """Every document's quality score, learned from the labels of four fifths of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    out = score_documents(docs, learn(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
