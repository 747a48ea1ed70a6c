"""Language identification with interpolated Kneser-Ney character models.

Training takes a bounded sample of the labelled rows (``sample_per_language``
documents of each language, chosen by a hash of the id) and counts words there.
Each language gets a character model over words padded with blanks: highest-order
counts discounted, lower orders by the number of distinct continuations, all
interpolated down to a uniform distribution.  All models lie in one sorted array
of n-gram hashes with a column of discounted probabilities and one of back-off
weights for each language.

A text is scored whole.  Within a batch every distinct stretch of characters is
scored once, by binary search in the sorted array; a document's cross-entropy is
the sum over its stretches by the number of characters.  The language with the
lowest one is chosen.  The choice is rejected when its cross-entropy lies above
what held-back training documents of that language show, with an allowance that
shrinks with length.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and is
rejected; with nothing to learn from, every text is ``und``; ties go to the
language first in code-point order; an empty table gives no rows; repeated rows are
judged alike; a long text is scored in one piece with others of its chunk; other
columns do not matter, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlens.llm.blocks import give_back
from answerlens.llm.common import id_bucket

ORDER = 4
SAMPLE_PER_LANGUAGE = 400
#: Rows with letters that must remain for learning where a fifth of a language is held back.
LEAST = 10
#: Characters of a batch that are scored together.
CHUNK = 500_000
MADE = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


@dataclass
class Models:
    """keys: sorted hashes of n-grams; own, back: a row for each key, a column for each language."""

    languages: list[str]
    keys: np.ndarray
    own: np.ndarray
    back: np.ndarray
    alphabet: int
    limits: np.ndarray  # cross-entropy, in nats a character, above which a choice is rejected


def codes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of the tokens, each token between blanks, as one array; and the token of every place."""
    text = "\n".join(tokens).lower()
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    seen = np.flatnonzero(np.bincount(a))
    letter = np.zeros(0x110000, dtype=bool)
    letter[seen] = [unicodedata.category(chr(c))[0] == "L" for c in seen]
    newline = a == 10
    owner = np.cumsum(newline) - newline
    kept = letter[a]
    out = np.where(kept, a, 32).astype(np.uint32)
    # one blank between runs of letters: drop a blank after a blank
    drop = ~kept & np.concatenate([[True], ~kept[:-1]]) & ~newline
    out[newline] = 10
    return out[~drop], owner[~drop]


def stretches(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the padded tokens: characters, their token, and how many characters of history each has (0 for the first blank)."""
    a, owner = codes(tokens)
    newline = a == 10
    # " ab " : the separator becomes the closing blank of one token, and an opening blank is put before the next
    n = len(a) + int(newline.sum()) + 2
    place = np.arange(len(a)) + np.cumsum(newline) - newline + 1
    out = np.full(n, 32, dtype=np.uint32)
    who = np.zeros(n, dtype=np.int64)
    out[place] = np.where(newline, 32, a)
    who[place] = owner
    start = place[newline] + 1  # opening blanks
    who[start] = owner[newline] + 1
    who[-1] = owner[-1] if len(owner) else 0
    first = np.concatenate([[True], who[1:] != who[:-1]])
    begins = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    return out, who, np.arange(n) - begins


def gram_keys(chars: np.ndarray, history: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order, the hash of the n characters that end at each place; 0 where they reach beyond the token."""
    keys, h = [], np.zeros(len(chars), dtype=np.uint64)
    for n in range(1, order + 1):
        shifted = np.concatenate([np.zeros(n - 1, dtype=np.uint64), chars[: len(chars) - n + 1].astype(np.uint64)])
        h = _scramble(h * _STEP + shifted + _U(1))
        keys.append(np.where(history >= n - 1, h | _U(1), _U(0)))
    return keys


def fit(words: pd.DataFrame, order: int = ORDER) -> Models:
    """words(lang, word, n) -> models; limits are still infinite."""
    languages = sorted(words["lang"].unique())
    grams: list[dict[int, Counter]] = []
    contexts: dict[int, int] = {}
    alphabet: set[int] = set()
    tables = []
    for lang in languages:
        part = words[words["lang"] == lang]
        chars, who, history = stretches(part["word"].tolist())
        weight = part["n"].to_numpy(np.int64)[who]
        real = history > 0  # the opening blank is given, not predicted
        alphabet.update(np.unique(chars).tolist())
        keys = gram_keys(chars, history, order)
        # counts by order: the highest from occurrences, and where the history is shorter; the rest from distinct longer n-grams
        table = {}
        above: tuple[np.ndarray, np.ndarray] | None = None
        for n in range(order, 0, -1):
            k = keys[n - 1]
            ok = (k != 0) & real
            longer = keys[n] if n < order else np.zeros_like(k)
            whole = ok & (longer == 0) if n < order else ok
            uniq, first, inverse = np.unique(k[ok], return_index=True, return_inverse=True)
            count = np.zeros(len(uniq))
            np.add.at(count, inverse, np.where(whole[ok], weight[ok], 0))
            if n < order:
                pairs = np.unique(np.stack([longer[ok & (longer != 0)], k[ok & (longer != 0)]]), axis=1)
                at = np.searchsorted(uniq, pairs[1])
                np.add.at(count, at, 1)
            at = np.flatnonzero(ok)[first]
            context = np.where(at > 0, keys[n - 2][at - 1], 0) if n > 1 else np.zeros(len(uniq), dtype=np.uint64)
            table[n] = (uniq, count, context)
        tables.append(table)
    every = np.unique(np.concatenate([np.concatenate([t[n][0] for n in t] + [t[n][2] for n in t]) for t in tables] or [np.zeros(0, np.uint64)]))
    own = np.zeros((len(every), len(languages)), dtype=np.float32)
    back = np.ones((len(every), len(languages)), dtype=np.float32)
    root = np.ones(len(languages))
    for j, table in enumerate(tables):
        for n, (uniq, count, context) in table.items():
            n1, n2 = (count == 1).sum(), (count == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            left = np.maximum(count - discount, 0)
            ctx, at = np.unique(context, return_inverse=True)
            total = np.bincount(at, weights=count)
            kept = np.bincount(at, weights=left)
            own[np.searchsorted(every, uniq), j] = left / total[at]
            if n > 1:
                back[np.searchsorted(every, ctx), j] = (total - kept) / total
            else:
                root[j] = (total - kept)[0] / total[0]
    models = Models(languages, every, own, back, len(alphabet) + 1, np.full(len(languages), np.inf))
    models.root = root
    return models


def cross_entropies(models: Models, tokens: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each token: -log probability by language, and the number of characters predicted."""
    n_lang = len(models.languages)
    chars, who, history = stretches(tokens)
    keys = gram_keys(chars, history, order)
    # a row of zeros and one of ones at the end serve the places without an entry
    own = np.concatenate([models.own, np.zeros((1, n_lang), np.float32)])
    back = np.concatenate([models.back, np.ones((1, n_lang), np.float32)])
    none = len(models.keys)
    p = np.broadcast_to((models.root / models.alphabet).astype(np.float32), (len(chars), n_lang))
    last = np.full(len(chars), none, dtype=np.int64)
    for n in range(1, order + 1):
        k = keys[n - 1]
        at = np.minimum(np.searchsorted(models.keys, k), max(none - 1, 0))
        at[(models.keys[at] != k) | (k == 0)] = none
        if n > 1:  # the context: the shorter n-gram that ends one place earlier
            before = np.concatenate([[none], last[:-1]])
            before[k == 0] = none
            p = p * back[before]
        p = p + own[at]
        last = at
    lp = -np.log(np.maximum(p, np.float32(1e-12)))
    lp[history == 0] = 0
    blank_only = np.bincount(who, weights=(chars != 32), minlength=len(tokens)) == 0
    total = np.stack([np.bincount(who, weights=lp[:, j], minlength=len(tokens)) for j in range(n_lang)], axis=1)
    size = np.bincount(who, weights=history > 0, minlength=len(tokens))
    total[blank_only] = 0
    size[blank_only] = 0
    return total, size


def score(models: Models, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text: mean cross-entropy by language and the number of characters predicted."""
    texts = pc.fill_null(texts, "")
    pieces = pc.utf8_split_whitespace(texts)
    flat = pc.dictionary_encode(pieces.flatten())
    lengths = np.diff(pieces.offsets.to_numpy())
    total, size = cross_entropies(models, flat.dictionary.to_pylist()) if len(flat.dictionary) else (np.zeros((0, len(models.languages))), np.zeros(0))
    ids = flat.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), lengths)
    n = np.bincount(doc, weights=size[ids], minlength=len(texts))
    mean = np.stack([np.bincount(doc, weights=total[ids, j], minlength=len(texts)) for j in range(len(models.languages))], axis=1)
    return mean / np.maximum(n, 1)[:, None], n


def allowance(n: np.ndarray) -> np.ndarray:
    """Nats a character by which a short text may exceed its language's limit."""
    return 6.0 / np.sqrt(np.maximum(n, 1))


def decide(models: Models, ce: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """lang_pred, score (posterior of the choice, evidence bounded to 40 characters), cross_entropy, rejected."""
    if not models.languages:
        return pd.DataFrame({"lang_pred": ["und"] * len(n), "score": 0.0, "cross_entropy": 0.0, "rejected": True})
    best = ce.argmin(axis=1)
    low = ce[np.arange(len(n)), best]
    score_ = 1.0 / np.exp(-(ce - low[:, None]) * np.minimum(n, 40)[:, None]).sum(axis=1)
    none = n == 0
    names = np.array([*models.languages, "und"], dtype=object)
    return pd.DataFrame({
        "lang_pred": names[np.where(none, len(models.languages), best)],
        "score": np.where(none, 0.0, score_),
        "cross_entropy": np.where(none, 0.0, low),
        "rejected": none | (low > models.limits[best] + allowance(n)),
    })


def train(labelled: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Models:
    """labelled(doc_id, text, lang) -> models, from about so many documents of each language; a fifth of them calibrates the rejection.

    A language with fewer than LEAST other rows learns from all of its rows; its limit
    is that of a first model, which leaves out every second one.  Where nothing can be
    left out, the highest limit of the other languages holds.
    """
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = counts.select(F.col("lang").alias("_l"), F.least(F.lit(1.0), F.lit(float(sample_per_language)) / F.col("n")).alias("_share"))  # one number a language
    h = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(29)), F.lit(1_000_000)) / F.lit(1e6)
    fifth = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(31)), F.lit(5)) == 0
    sample = labelled.join(F.broadcast(share), F.col("lang") == F.col("_l")).where(h < F.col("_share")).select("lang", "text", fifth.alias("held_back")).toPandas()
    if not len(sample):
        return Models([], np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros((0, 0)), 1, np.zeros(0))
    sample["text"] = sample["text"].fillna("")
    sample = sample.sort_values(["lang", "text"], ignore_index=True)
    lettered = sample["text"].map(lambda text: any(unicodedata.category(c)[0] == "L" for c in text))
    few = (lettered & ~sample["held_back"]).groupby(sample["lang"]).transform("sum") < LEAST
    second = lettered & (lettered.groupby(sample["lang"]).cumsum() % 2 == 0)
    held = sample["held_back"].where(~few, second)
    models = fit(_counted(sample[~held]))
    texts = sample[held]
    ce, n = score(models, pa.array(texts["text"], type=pa.string()))
    for j, lang in enumerate(models.languages):
        mine = (texts["lang"] == lang).to_numpy() & (n > 0)
        if mine.any():
            models.limits[j] = np.quantile(ce[mine, j] - allowance(n[mine]), 0.99) + 0.5
    limits = models.limits
    if (held & few).any():
        models = fit(_counted(sample[~held | few]))
    known = limits[np.isfinite(limits)]
    models.limits = np.where(np.isfinite(limits), limits, known.max() if len(known) else np.inf)
    return models


def _counted(rows: pd.DataFrame) -> pd.DataFrame:
    """rows(lang, text) -> lang, word, n."""
    counted: dict[str, Counter] = defaultdict(Counter)
    for lang, text in zip(rows["lang"], rows["text"], strict=True):
        counted[lang].update(text.split())
    return pd.DataFrame([(lang, w, n) for lang in sorted(counted) for w, n in sorted(counted[lang].items())], columns=["lang", "word", "n"])


def classify(docs: DataFrame, models: Models) -> DataFrame:
    """docs(text, ...) -> row (a struct of all columns of docs, so that no names can clash), lang_pred, score, cross_entropy, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the training sample
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(0).field(at).cast(pa.large_string())
            sizes = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < len(texts):
                before = sizes[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, before + CHUNK)))
                d = decide(m, *(score(m, texts[start:stop]) if m.languages else (np.zeros((stop - start, 0)), np.zeros(stop - start))))
                columns = [batch.column(0).slice(start, stop - start), pa.array(d["lang_pred"], pa.string()), pa.array(d["score"], pa.float64()), pa.array(d["cross_entropy"], pa.float64()), pa.array(d["rejected"], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "lang_pred", "score", "cross_entropy", "rejected"])
                start = stop
            give_back()

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *MADE]))


def held_out() -> Column:
    return id_bucket("doc_id", 3) == 1


def learned(docs: DataFrame) -> Models:
    return train(docs.where(~held_out() & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))


def op9_language_id(spark, sf_dir):
    """Every document's language by character models of the other two thirds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = classify(docs.select("doc_id", "text"), learned(docs)).withColumn("doc_id", F.col("row.doc_id"))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")
