"""Phrase collocations by FM-indexes over word ids, one for each shard.

Texts are split into pieces and words; words of different languages are different
symbols.  A shard (a block of texts, see ``blocks``) holds its words as numbers with a
0 after each piece, in an index of the text and one of the text reversed.  Both are
sorted by as many words as a phrase may have, which is all that intervals of such
phrases need.  From the interval of every word, intervals are extended by one word to
the left in the first index and to the right in the second, and each step keeps the
interval in the other index as well; so a phrase of n + 1 words is found from its last
n words and from its first n words, which are its parents.

Shards send the counts of their distinct phrases by key range, where they are summed,
and get the sums of their own phrases back.  The parts of a phrase occur wherever it
occurs, so each shard can cut its phrases with sums at hand; of the shards that have a
phrase one reports it.  A phrase that a longer one contains is reported as covered by
the shard that reports the longer one.

Defined cases: a null or empty text has no words; a null language counts as ``und``;
repeated rows count each; a very long text is a shard of its own; an empty table gives
no rows; columns other than text and lang do not matter.  Words and phrases are told
apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from answerlens.llm import blocks as B
from answerlens.llm.common import cut

#: Bytes of text in a shard.
SHARD_BYTES = 4 << 20
MAX_WORDS = 3
MIN_COUNT = 10
#: A phrase goes if one that contains it occurs at least so many times per hundred of its own.
COVERED_PERCENT = 50
TOP = 2000
_U = np.uint64
_STEP = _U(0x9FB21C651E98DF25)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 32]] = True
_END = np.zeros(256, dtype=bool)
_END[list(b".,;:!?\n\v\f\r")] = True


@dataclass
class Level:
    """Phrases of one length, by their intervals: in the text's index, ascending, and in the reversed text's."""

    start: np.ndarray
    size: np.ndarray
    back: np.ndarray
    head: np.ndarray  # the phrase without its last word, as a place in the level before
    tail: np.ndarray  # the phrase without its first word


class PhraseIndex:
    """A two-way FM-index of symbols from 1 up, 0 between pieces and at the end, for patterns of up to depth symbols."""

    def __init__(self, text: np.ndarray, depth: int):
        self.counts = np.bincount(text)
        self.order, self.before, self.step = _index(text, depth)
        _, self.after, self.step_back = _index(text[::-1], depth)

    def words(self) -> Level:
        first = np.cumsum(self.counts) - self.counts
        none = np.zeros(len(first) - 1, dtype=np.int64)
        return Level(first[1:], self.counts[1:], first[1:], none, none)

    def longer(self, level: Level) -> Level:
        """All phrases of one word more."""
        left, lead, size, row = _extend(level.start, level.size, self.before, len(self.counts))
        start, back = self.step[row], level.back[left] + lead
        right, lead, _, row = _extend(level.back, level.size, self.after, len(self.counts))
        other = level.start[right] + lead
        by_start, by_other = np.argsort(start), np.argsort(other)
        if len(start) != len(other) or (start[by_start] != other[by_other]).any():
            raise AssertionError("extensions to the left and to the right find different phrases")
        return Level(start[by_start], size[by_start], back[by_start], right[by_other], left[by_start])


def _index(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the order of their next depth symbols, the symbol before each, and for each row the row of the place before."""
    text = text.astype(np.int64)
    base = int(text.max(initial=0)) + 1
    key = text.copy()
    for k in range(1, depth):
        top = int(key.max(initial=0)) + 1
        if top * base >= 1 << 63:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key *= base
        key[:-k] += text[k:]
    order = np.argsort(key, kind="stable")
    before = text[order - 1]
    step = np.empty(len(text), dtype=np.int64)
    step[np.argsort(before, kind="stable")] = np.arange(len(text))
    return order, before, step


def _extend(start: np.ndarray, size: np.ndarray, symbols: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each interval and symbol in it, but 0: the interval, how many of its symbols are smaller, how many are this one, and the first row with it."""
    ends = np.cumsum(size)
    which = np.repeat(np.arange(len(start)), size)
    rows = np.repeat(start - (ends - size), size) + np.arange(len(which))
    key = which * base + symbols[rows]
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    which, symbol = key[at] // base, key[at] % base
    n = np.diff(at, append=len(key))
    lead = at - (ends - size)[which]
    real = symbol > 0
    return which[real], lead[real], n[real], rows[order[at[real]]]


@dataclass
class Shard:
    text: np.ndarray  # word numbers, 0 after each piece
    places: np.ndarray  # of each place in text, which word it is
    keys: np.ndarray  # of each word number, its hash; that of 0 is not used
    starts: np.ndarray  # of each word, its first byte and the one after
    stops: np.ndarray
    data: np.ndarray
    langs: list[str]
    of_doc: np.ndarray  # language of each document
    docs: np.ndarray  # document of each word

    def phrase(self, place: int, n: int) -> str:
        words = range(self.places[place], self.places[place] + n)
        return " ".join(bytes(self.data[self.starts[w] : self.stops[w]]).decode() for w in words)

    def lang(self, place: int) -> str:
        return self.langs[self.of_doc[self.docs[self.places[place]]]]


def read_shard(t: pa.Table) -> Shard:
    data, offsets = B.bytes_of(t["text"])
    data = B._LOWER[data]
    langs = pc.fill_null(t["lang"].cast(pa.string()), "und").combine_chunks().dictionary_encode()
    langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
    names, of_doc = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = _END[data]
    full = ~(ends | _BLANK[data])
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(full & (edge[:-1] | ~np.concatenate([[False], full[:-1]])))
    stops = np.flatnonzero(full & (edge[1:] | ~np.concatenate([full[1:], [False]]))) + 1
    docs = np.searchsorted(offsets, starts, side="right") - 1
    hashes = np.empty(len(starts), dtype=_U)
    at = 0
    while at < len(starts):  # sums of powers over about a MB at a time
        to = max(at + 1, int(np.searchsorted(stops, starts[at] + (1 << 20), side="right")))
        base = starts[at]
        hashes[at:to] = B.Hasher(data[base : stops[to - 1]])(starts[at:to] - base, stops[at:to] - base)
        at = to
    salts = np.array([B.Hasher(np.frombuffer(x.encode(), np.uint8))(np.array([0]), np.array([len(x.encode())]))[0] for x in names] or [0], dtype=_U)
    hashes = B.mix(hashes * _STEP + salts[of_doc[docs]]) if len(docs) else hashes
    keys, number = np.unique(hashes, return_inverse=True)
    piece = np.cumsum(ends)[starts] if len(starts) else starts
    last = np.ones(len(starts), dtype=bool)
    last[:-1] = (piece[1:] != piece[:-1]) | (docs[1:] != docs[:-1])
    place = np.arange(len(starts)) + np.cumsum(last) - last
    text = np.zeros(len(starts) + int(last.sum()) or 1, dtype=np.int64)
    text[place] = number + 1
    places = np.zeros(len(text), dtype=np.int64)
    places[place] = np.arange(len(starts))
    return Shard(text, places, np.concatenate([[_U(0)], keys]).astype(_U), starts, stops, data, names, of_doc, docs)


def _levels(s: Shard, max_words: int) -> tuple[PhraseIndex, list[Level], list[np.ndarray]]:
    """The phrases of 1, 2, ... words and their hashes."""
    index = PhraseIndex(s.text, max_words)
    levels, keys = [index.words()], [s.keys[1:]]
    for n in range(2, max_words + 1):
        levels.append(index.longer(levels[-1]))
        at = index.order[levels[-1].start] if len(levels[-1].start) else np.zeros(0, dtype=np.int64)
        h = np.full(len(at), n, dtype=_U)
        for k in range(n):
            h = B.mix(h * _STEP + s.keys[s.text[at + k]])
        keys.append(h)
    return index, levels, keys


def _inner(levels: list[Level], rows: np.ndarray, n: int, skip: int, keep: int) -> np.ndarray:
    """Of phrases of n words (rows of that level), the stretch of keep words after the first skip ones, as rows of its level."""
    for k in range(skip):
        rows = levels[n - 1 - k].tail[rows]
    for k in range(n - skip - keep):
        rows = levels[n - skip - 1 - k].head[rows]
    return rows


FOUND = "key long, lang string, phrase string, a long, cuts array<struct<k:int,l:long,r:long>>, n long"


def _found(pdf: pd.DataFrame, max_words: int, min_count: int, covered: int) -> pd.DataFrame:
    """A shard with the sums of its phrases -> the phrases it reports, keys of those covered (no phrase), words by language (no key)."""
    s = read_shard(B.unpack(pdf["payload"].dropna().iloc[0]))
    index, levels, keys = _levels(s, max_words)
    totals, reports = [], []
    for n, key in enumerate(keys, 1):
        sums = B.collect_replies(pdf, n, "totals", B.unpack_counts)
        own = np.empty(len(key), dtype=np.int64)
        own[np.argsort(key)] = sums
        totals.append(own >> 1)
        reports.append(own & 1 > 0)
    out: list[tuple] = []
    for n in range(2, max_words + 1):
        rows = np.flatnonzero(reports[n - 1] & (totals[n - 1] >= min_count))
        a = totals[n - 1][rows]
        sides = [[totals[m - 1][_inner(levels, rows, n, skip, m)] for skip, m in ((0, k), (k, n - k))] for k in range(1, n)]
        for i, row in enumerate(rows):
            place = index.order[levels[n - 1].start[row]]
            cuts = [{"k": k, "l": int(left[i]), "r": int(right[i])} for k, (left, right) in enumerate(sides, 1)]
            out.append((int(keys[n - 1][row].view(np.int64)), s.lang(place), s.phrase(place, n), int(a[i]), cuts, None))
        for m in range(2, n):
            for skip in range(n - m + 1):
                inner = _inner(levels, rows, n, skip, m)
                gone = np.unique(inner[100 * a >= covered * totals[m - 1][inner]])
                out += [(int(k), None, None, None, None, None) for k in keys[m - 1][gone].view(np.int64)]
    if len(s.docs):
        out += [(None, s.langs[i], None, None, None, int(c)) for i, c in enumerate(np.bincount(s.of_doc[s.docs], minlength=len(s.langs))) if c]
    B.give_back()
    frame = pd.DataFrame(out, columns=["key", "lang", "phrase", "a", "cuts", "n"])
    return frame.astype({"key": "Int64", "a": "Int64", "n": "Int64"})


def mine(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, covered: int = COVERED_PERCENT) -> tuple[DataFrame, DataFrame]:
    """docs(text, lang) -> (lang, phrase, a, cuts, key) of all phrases that no longer one covers, and (lang, n)."""
    blocks = B.pack(docs.select("text", "lang"), SHARD_BYTES)
    ranges = B.n_ranges(blocks)

    def ask(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for block, payload in zip(pdf["block"], pdf["payload"], strict=True):
                index, levels, keys = _levels(read_shard(B.unpack(payload)), max_words)
                rows = []
                for n, (level, key) in enumerate(zip(levels, keys, strict=True), 1):
                    order = np.argsort(key)
                    rows += B.requests(block, n, key[order], level.size[order], ranges)
                yield pd.DataFrame(rows, columns=["block", "part", "kind", "keys", "counts"])
        B.give_back()

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind in sorted(pdf["kind"].unique()):
            some = pdf[pdf["kind"] == kind]
            _, places, firsts, totals = B.add_up([B.unpack_keys(b) for b in some["keys"]], [B.unpack_counts(b) for b in some["counts"]])
            out += [(b, p, kind, B.pack_counts(totals[x] * 2 + f)) for b, p, x, f in zip(some["block"], some["part"], places, firsts, strict=True)]
        B.give_back()
        return pd.DataFrame(out, columns=["block", "part", "kind", "totals"])

    def null(kind: str) -> Column:
        return F.lit(None).cast(kind)

    text = blocks.select("block", "payload").withColumns({"part": null("int"), "kind": null("int"), "totals": null("binary")})
    sums = blocks.select("block", "payload").mapInPandas(ask, B.REQUEST).groupBy("part").applyInPandas(answer, B.REPLY)
    both = text.unionByName(sums.withColumn("payload", null("binary")))
    found = cut(both.groupBy("block").applyInPandas(lambda pdf: _found(pdf, max_words, min_count, covered), FOUND))
    phrases = found.where("phrase IS NOT NULL").select("lang", "phrase", "a", "cuts", "key")
    gone = found.where("phrase IS NULL AND key IS NOT NULL").select("key").distinct()
    return phrases.join(gone, "key", "left_anti"), found.where("key IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))


def scored(phrases: DataFrame) -> DataFrame:
    """With l, r and score of the lowest-scoring cut; whole numbers in decimals of 38 digits, enough for counts below 10^14."""
    times = "decimal(14,0)"
    score = f"(CAST(1000000 AS decimal(7,0)) * CAST(a AS {times}) * CAST(a AS {times})) div (CAST(c.l AS {times}) * CAST(c.r AS {times}))"
    lowest = F.array_min(F.expr(f"transform(cuts, c -> struct({score} AS score, c.k AS k, c.l AS l, c.r AS r))"))
    return phrases.withColumn("low", lowest).select("lang", "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), F.col("low.score").alias("score"), "key")


def best(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first rows; ranked in slices and slices of slices first, so that no task gets more than 32 times top rows from them."""
    by = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for slices in (1024, 32, 1):
        rank = F.row_number().over(Window.partitionBy("lang", F.pmod("key", F.lit(slices))).orderBy(*by))
        phrases = phrases.withColumn("rank", rank).where(F.col("rank") <= top)
    return phrases


def op12_phrases(spark, sf_dir):
    """The first 2000 phrases of each language by how much more often their parts meet than apart."""
    phrases, sizes = mine(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))
    ranked = best(scored(phrases)).join(sizes, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


OP12_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, p FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents)
), lists AS (
  SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
), places AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists
), counts AS (
  SELECT lang, 1 AS size, ws[i] AS phrase, NULL AS h1, NULL AS t1, NULL AS h2, NULL AS t2, count(*)::HUGEINT AS c FROM places GROUP BY lang, phrase
  UNION ALL
  SELECT lang, 2, ws[i] || ' ' || ws[i + 1] AS phrase, any_value(ws[i]), any_value(ws[i + 1]), NULL, NULL, count(*)::HUGEINT FROM places WHERE i + 1 <= len(ws) GROUP BY lang, phrase
  UNION ALL
  SELECT lang, 3, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS phrase, any_value(ws[i]), any_value(ws[i + 1] || ' ' || ws[i + 2]),
         any_value(ws[i] || ' ' || ws[i + 1]), any_value(ws[i + 2]), count(*)::HUGEINT FROM places WHERE i + 2 <= len(ws) GROUP BY lang, phrase
), cand AS (
  SELECT * FROM counts WHERE size > 1 AND c >= 10
), cuts AS (
  SELECT d.lang, d.phrase, d.size, d.c AS a, 1 AS k, x.c AS l, y.c AS r
  FROM cand d JOIN counts x ON x.lang = d.lang AND x.phrase = d.h1 AND x.size = 1 JOIN counts y ON y.lang = d.lang AND y.phrase = d.t1 AND y.size = d.size - 1
  UNION ALL
  SELECT d.lang, d.phrase, d.size, d.c, 2, x.c, y.c
  FROM cand d JOIN counts x ON x.lang = d.lang AND x.phrase = d.h2 AND x.size = 2 JOIN counts y ON y.lang = d.lang AND y.phrase = d.t2 AND y.size = 1
  WHERE d.size = 3
), scores AS (
  SELECT *, (1000000::HUGEINT * a * a) // (l * r) AS score FROM cuts
), low AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scores
), covered AS (
  SELECT d.lang, d.phrase FROM cand d JOIN (SELECT lang, h2 AS inner_phrase, c FROM cand WHERE size = 3 UNION ALL SELECT lang, t1, c FROM cand WHERE size = 3) t
  ON t.lang = d.lang AND t.inner_phrase = d.phrase AND d.size = 2 WHERE 100 * t.c >= 50 * d.c
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low
  WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM covered v WHERE v.lang = low.lang AND v.phrase = low.phrase)
), sizes AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM lists GROUP BY lang
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
