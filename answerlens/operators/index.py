"""BM25 indexes of knowledge bases: stored in segments, added to batch by batch, searched by blocks.

An index is a folder.  Every batch of chunks is one segment, cut into shards of bounded
size; a shard holds one row for each base and term in it (the places of the chunks, the
counts, and ``peak``, the largest share of a term's weight that any of them can give)
and one row without a term for its chunks (ids and lengths).  Beside the postings a
segment has its deltas: chunks and tokens by base, chunks by base and term.  Adding a
batch writes these and nothing else, so its work is that of the batch; statistics are
sums of deltas, and inverse frequencies follow from the sums when they are read first.

A manifest names the segments that count.  A batch is published by a new version of it,
so a write that fails leaves the last version as it was, and a batch that is written
again takes its own place.  ``compact`` sums the deltas of many segments into one.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from hashlib import sha256
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlens.functions.text import key_terms, tokens
from answerlens.session import arrow_rows, shared_folder

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Statistics of knowledge bases (about 50 bytes each) are broadcast up to so many.
BROADCAST_BASES = 100_000
#: Chunks and tokens in a shard at most; a longer chunk is a shard of its own.
SHARD_CHUNKS = 4096
SHARD_TOKENS = 2_000_000
#: Chunks that go to a task at a time; tokens that it numbers, and rows that it gives back, at a time. A task holds these and the numbers of a shard.
BATCH_CHUNKS = 512
PIECE_TOKENS = 1 << 16
PART_ROWS = 1 << 15
#: Files of fewer bytes for each core are dealt out before they are split, as they may be too few for all cores.
SPREAD_BYTES = 32 << 20
#: Deltas of a level that are read before they are summed into one of the next.
MOST_DELTAS = 8


def small(corpus: DataFrame) -> DataFrame:
    """A table with a row a knowledge base, to be broadcast if there are not too many."""
    return F.broadcast(corpus) if corpus.limit(BROADCAST_BASES + 1).count() <= BROADCAST_BASES else corpus


def _own(column: pa.Array) -> pa.Array:
    """A copy, as a slice keeps the whole batch that it was read with."""
    return column.take(pa.array(np.arange(len(column))))


@dataclass
class _Held:
    """What a shard keeps of its chunks: bases, ids and lengths; of each term of a chunk its number, the chunk's place in the shard and the count."""

    kbs: list[pa.Array] = field(default_factory=list)
    ids: list[pa.Array] = field(default_factory=list)
    lengths: list[np.ndarray] = field(default_factory=list)
    terms: list[pa.Array] = field(default_factory=list)
    rows: list[np.ndarray] = field(default_factory=list)
    tfs: list[np.ndarray] = field(default_factory=list)
    n: int = 0
    tokens: int = 0

    def take(self, batch: pa.RecordBatch) -> None:
        """Tokens become numbers piece by piece, and nothing refers to the batch afterwards."""
        ends = np.cumsum(np.diff(batch["t"].offsets.to_numpy()))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PIECE_TOKENS, side="right"))
            stop = max(stop, start + 1)
            self._piece(batch["t"].slice(start, stop - start))
            start = stop
        self.kbs.append(_own(batch["kb_id"]))
        self.ids.append(_own(batch["chunk_id"]))

    def _piece(self, lists: pa.ListArray) -> None:
        n, length, terms = len(lists), np.diff(lists.offsets.to_numpy()), lists.flatten().dictionary_encode()
        key = np.repeat(np.arange(n), length)  # of each token in turn its term and its chunk
        key += terms.indices.to_numpy().astype(np.int64) * n
        key.sort()
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        term, row = np.divmod(key[starts], n)
        self.terms.append(pa.DictionaryArray.from_arrays(pa.array(term.astype(np.int32)), terms.dictionary))
        self.rows.append((row + self.n).astype(np.int32))
        self.tfs.append(np.diff(starts, append=len(key)).astype(np.int32))
        self.lengths.append(length)
        self.n, self.tokens = self.n + n, self.tokens + len(key)

    def shard(self, shard: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The rows of the shard: of each base one with the chunks, then those of its terms, in batches of at most PART_ROWS."""
        base = pa.chunked_array(self.kbs).combine_chunks().dictionary_encode(null_encoding="encode")
        kb, length = base.indices.to_numpy(), np.concatenate(self.lengths)
        n, n_bases = self.n, len(base.dictionary)
        order = np.argsort(kb, kind="stable")
        first = np.searchsorted(kb[order], np.arange(n_bases + 1))
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n) - first[kb[order]]
        means = np.maximum(np.bincount(kb, weights=length, minlength=n_bases) / np.maximum(np.diff(first), 1), 1.0)
        terms = pa.chunked_array(self.terms).unify_dictionaries()
        words, n_terms = terms.chunk(0).dictionary, len(terms.chunk(0).dictionary)
        row, tf = np.concatenate(self.rows), np.concatenate(self.tfs)
        key = kb.astype(np.int64)[row]  # of each term of a chunk its base, term and place
        key *= n_terms
        key += np.concatenate([x.indices.to_numpy() for x in terms.chunks])
        key *= n
        key += place[row]
        ids = pa.chunked_array(self.ids).combine_chunks()
        for pieces in (self.kbs, self.ids, self.lengths, self.terms, self.rows, self.tfs):  # what follows needs them no more
            pieces.clear()
        self.n = self.tokens = 0
        terms = row = None
        by_key = np.argsort(key)
        key, tf = key[by_key], tf[by_key]
        by_key = None
        places = (key % n).astype(np.int32)
        key //= n
        at = np.flatnonzero(np.diff(key, prepend=-1))
        pair, at = key[at], np.append(at, len(key))
        key = None
        length = length[order]

        def rows(bases: np.ndarray, term: pa.Array, peak: np.ndarray, bounds: np.ndarray, chunks: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
            mine = slice(bounds[0], bounds[-1])
            bounds, chunks = (pa.array((x - x[0]).astype(np.int32)) for x in (bounds, chunks))
            columns = {
                "kb_id": base.dictionary.take(pa.array(bases)),
                "shard": pa.array(np.full(len(bases), shard)),
                "term": term,
                "n": pa.array(np.diff(bounds.to_numpy()) + np.diff(chunks.to_numpy())),
                "peak": pa.array(peak),
                "mean": pa.array(means[bases]),
                "places": pa.ListArray.from_arrays(bounds, pa.array(places[mine])),
                "tfs": pa.ListArray.from_arrays(bounds, pa.array(tf[mine])),
                "chunk_ids": pa.ListArray.from_arrays(chunks, ids),
                "dls": pa.ListArray.from_arrays(chunks, pa.array(length[: len(ids)].astype(np.int32))),
            }
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)

        none = np.zeros(n_bases + 1, dtype=np.int64)
        yield rows(np.arange(n_bases), pa.nulls(n_bases, pa.string()), np.zeros(n_bases), none, first, ids.take(pa.array(order)))
        for i in range(0, len(pair), PART_ROWS):
            some, bounds = pair[i : i + PART_ROWS], at[i : i + PART_ROWS + 1]
            bases, mine = some // n_terms, slice(bounds[0], bounds[-1])
            of = np.repeat(bases, np.diff(bounds))
            share = tf[mine] / (tf[mine] + K1 * (1 - B + B * length[first[of] + places[mine]] / means[of]))
            yield rows(bases, words.take(pa.array(some % n_terms)).cast(pa.string()), np.maximum.reduceat(share, bounds[:-1] - bounds[0]), bounds, np.zeros(len(bounds), dtype=np.int64), ids.slice(0, 0))


def _shards(split: DataFrame, segment: int) -> DataFrame:
    """split(kb_id, chunk_id, t) -> the rows of the segment's shards."""
    kb, chunk = split.schema["kb_id"].dataType, split.schema["chunk_id"].dataType
    inner = T._parse_datatype_string("shard long, term string, n int, peak double, mean double, places array<int>, tfs array<int>")
    schema = T.StructType([T.StructField("kb_id", kb), *inner.fields, T.StructField("chunk_ids", T.ArrayType(chunk)), T.StructField("dls", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (segment << 44) + (TaskContext.get().partitionId() << 20)
        held = _Held()
        out: pa.Schema | None = None
        for batch in batches:
            if out is None:
                kinds = {"kb_id": batch.schema.field("kb_id").type, "shard": pa.int64(), "term": pa.string(), "n": pa.int32(), "peak": pa.float64(), "mean": pa.float64(), "places": pa.list_(pa.int32()), "tfs": pa.list_(pa.int32()), "chunk_ids": pa.list_(batch.schema.field("chunk_id").type), "dls": pa.list_(pa.int32())}
                out = pa.schema(list(kinds.items()))
            ends = np.cumsum(np.diff(batch["t"].offsets.to_numpy()))
            start = 0
            while start < batch.num_rows:
                before = ends[start - 1] if start else 0
                stop = min(start + SHARD_CHUNKS - held.n, int(np.searchsorted(ends, before + SHARD_TOKENS - held.tokens, side="right")))
                stop = max(stop, start + (not held.n))
                if stop > start:
                    held.take(batch.slice(start, stop - start))
                if stop < batch.num_rows or held.n >= SHARD_CHUNKS:
                    yield from held.shard(number, out)
                    number += 1
                    pa.default_memory_pool().release_unused()
                start = stop
            batch = None  # before the next one is read
        if held.n:
            yield from held.shard(number, out)

    return split.mapInArrow(run, schema)


def term_blocks(split: DataFrame, segment: int) -> DataFrame:
    """split(kb_id, chunk_id, t) -> a segment's rows, shard by shard as the tasks make them: a search brings the rows it asks for together itself."""
    return _shards(split, segment)


def write_blocks(rows: DataFrame, path: str) -> None:
    """The rows of ``term_blocks`` as files; chunks go to the tasks by few, whose tokens are far larger than they are."""
    with arrow_rows(rows.sparkSession, BATCH_CHUNKS):
        rows.write.parquet(path)


def corpus_of(chunks: DataFrame, tokenizer=tokens) -> DataFrame:
    """A1: kb_id, n, avgdl as ``Index.corpus`` has them, from one pass over chunks(kb_id, text) and without postings."""
    each = chunks.select("kb_id", F.size(tokenizer(F.col("text"))).alias("dl"))
    return each.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n"), (F.sum("dl") / F.count(F.lit(1))).alias("avgdl"))


def statistics(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A segment's deltas: chunks and tokens by base, chunks by base and term."""
    total = F.aggregate("dls", F.lit(0).cast("long"), lambda a, x: a + x)
    by_base = blocks.where("term IS NULL").groupBy("kb_id").agg(F.sum("n").alias("n"), F.sum(total).alias("length"))
    return by_base, blocks.where("term IS NOT NULL").groupBy("kb_id", "term").agg(F.sum("n").alias("df"))


@dataclass
class Index:
    """A version of a stored index: blocks (see above) and the deltas that count; ``folder`` keeps what is derived from them."""

    blocks: DataFrame
    by_base: DataFrame
    by_term: DataFrame
    folder: str
    sums: bool = False  # whether the deltas are sums already

    @cached_property
    def corpus(self) -> DataFrame:
        """A1: kb_id, n, avgdl; chunks without a token count in both."""
        return self.by_base.groupBy("kb_id").agg(F.sum("n").alias("n"), (F.sum("length") / F.sum("n")).alias("avgdl"))

    @cached_property
    def terms(self) -> DataFrame:
        """A1: kb_id, term, df, idf, avgdl; a negative idf becomes a share of its base's mean.  Computed once for a version."""
        spark = self.blocks.sparkSession
        if not _written(spark, f"{self.folder}/terms"):
            df = self.by_term if self.sums else self.by_term.groupBy("kb_id", "term").agg(F.sum("df").alias("df"))
            raw = df.join(small(self.corpus.withColumnRenamed("kb_id", "_kb")), F.col("kb_id").eqNullSafe(F.col("_kb"))).drop("_kb")
            raw = raw.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
            floor = raw.groupBy(F.col("kb_id").alias("_kb")).agg((F.avg("raw") * EPSILON).alias("floor"))
            rows = raw.join(small(floor), F.col("kb_id").eqNullSafe(F.col("_kb"))).select("kb_id", "term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"), "avgdl")
            rows.write.mode("overwrite").parquet(f"{self.folder}/terms")
        return spark.read.parquet(f"{self.folder}/terms")

    @cached_property
    def postings(self) -> DataFrame:
        """kb_id, term, chunk_id, tf, dl: a row for each term of a chunk."""
        each = self.blocks.where("term IS NOT NULL").select("kb_id", "shard", "term", F.inline(F.arrays_zip("places", "tfs"))).withColumnsRenamed({"places": "place", "tfs": "tf"})
        who = self.blocks.where("term IS NULL").select(F.col("kb_id").alias("_kb"), F.col("shard").alias("_shard"), F.posexplode(F.arrays_zip("chunk_ids", "dls")).alias("_place", "x"))
        joined = each.join(who, F.col("kb_id").eqNullSafe(F.col("_kb")) & (F.col("shard") == F.col("_shard")) & (F.col("place") == F.col("_place")))
        return joined.select("kb_id", "term", F.col("x.chunk_ids").alias("chunk_id"), "tf", F.col("x.dls").cast("long").alias("dl"))


def stored(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _written(spark: SparkSession, folder: str) -> bool:
    return stored(spark, f"{folder}/_SUCCESS")


def _level(delta: str) -> int:
    """0 for a segment's own delta, else how often its parts were summed."""
    return int(delta[3 : delta.index("-")]) if delta.startswith("sum") else 0


class Store:
    """An index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, tokenizer=tokens):
        self.spark, self.folder, self.tokenizer = spark, folder, tokenizer

    def _now(self) -> tuple[int, dict[int, str], list[str]]:
        """The newest whole version: its number, the folders of its segments, and those of the deltas to sum."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        path = fs.Path(f"{self.folder}/manifest")
        disk = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [x.getPath() for x in (disk.listStatus(path) if disk.exists(path) else [])]
        whole = [int(p.getName()) for p in found if p.getName().isdigit() and disk.exists(fs.Path(p, "_SUCCESS"))]
        if not whole:
            return 0, {}, []
        rows = self.spark.read.schema("segment long, name string").json(f"{self.folder}/manifest/{max(whole)}").collect()  # a row for each segment and delta
        return max(whole), {r["segment"]: r["name"] for r in rows if r["segment"] is not None}, [r["name"] for r in rows if r["segment"] is None]

    def _publish(self, version: int, segments: dict[int, str], deltas: list[str]) -> None:
        rows = [{"segment": s, "name": x} for s, x in [*segments.items(), *((None, name) for name in deltas)]]
        written = F.from_json(F.lit(json.dumps(rows)), "array<struct<segment: long, name: string>>")
        self.spark.range(0, 1, 1, 1).select(F.inline(written)).write.mode("overwrite").json(f"{self.folder}/manifest/{version + 1}")

    def append(self, chunks: DataFrame, segment: int, spread: bool = False) -> None:
        """A1: chunks(kb_id, chunk_id, text) as a segment; one of the same number gives way.  spread deals chunks of a few large files out to all cores first."""
        if spread:
            chunks = chunks.repartition(self.spark.sparkContext.defaultParallelism, "chunk_id")
        split = chunks.select("kb_id", "chunk_id", self.tokenizer(F.col("text")).alias("t"))
        self._add(term_blocks(split, segment), segment)

    def _add(self, rows: DataFrame, segment: int) -> None:
        name = f"{segment}-{uuid4().hex[:8]}"  # what an earlier version reads is not written over
        write_blocks(rows, f"{self.folder}/blocks/{name}")
        rows = self.spark.read.parquet(f"{self.folder}/blocks/{name}")
        by_base, by_term = statistics(rows)
        by_base.write.parquet(f"{self.folder}/by_base/{name}")
        by_term.write.parquet(f"{self.folder}/by_term/{name}")
        version, segments, deltas = self._now()
        old = segments.get(segment)
        summed = old is not None and old not in deltas  # its deltas went into a sum: take all segments' own again
        segments = segments | {segment: name}
        deltas = list(segments.values()) if summed else [*(d for d in deltas if d != old), name]
        self._publish(version, segments, deltas)
        level = 0
        while len(like := [d for d in self._now()[2] if _level(d) == level]) > MOST_DELTAS:
            self._sum(like, level := level + 1)

    def compact(self) -> None:
        """A1: one sum in the place of all deltas; the segments' own stay for a batch that is written again."""
        deltas = self._now()[2]
        self._sum(deltas, max(map(_level, deltas)) + 1)

    def _sum(self, deltas: list[str], level: int) -> None:
        """A sum in the place of these deltas: sums of like levels are summed again, so a delta is read once a level and not with every later sum."""
        version, segments, every = self._now()
        name = f"sum{level}-{uuid4().hex[:8]}"
        self._read("by_base", deltas).groupBy("kb_id").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).write.parquet(f"{self.folder}/by_base/{name}")
        self._read("by_term", deltas).groupBy("kb_id", "term").agg(F.sum("df").alias("df")).write.parquet(f"{self.folder}/by_term/{name}")
        self._publish(version, segments, [*(d for d in every if d not in deltas), name])

    def _read(self, table: str, names: Iterable[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/{table}/{name}" for name in names])

    def exists(self) -> bool:
        return self._now()[0] > 0

    def index(self) -> Index:
        """The newest version; later batches don't change what it names."""
        version, segments, deltas = self._now()
        return Index(self._read("blocks", segments.values()), self._read("by_base", deltas), self._read("by_term", deltas), f"{self.folder}/derived/{version}", len(deltas) == 1)


def build_index(chunks: DataFrame, tokenizer=tokens, folder: str | None = None) -> Index:
    """A1: chunks(kb_id, chunk_id, text) -> an index of one segment, in a folder of its own unless one is given."""
    spark = chunks.sparkSession
    store = Store(spark, folder or f"{shared_folder(spark)}/index-{uuid4().hex}", tokenizer)
    store.append(chunks, 0)
    return store.index()


def save(index: Index, folder: str) -> None:
    """A1: all blocks of an index as the one segment of another folder."""
    Store(index.blocks.sparkSession, folder)._add(index.blocks, 0)


def load(spark: SparkSession, folder: str) -> Index:
    return Store(spark, folder).index()


def stored_index(chunks: DataFrame, what: str) -> Index:
    """The index of chunks that are read from files, built once for these files; ``what`` names how chunks were made of them."""
    spark = chunks.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    seen, size = [what], 0
    for name in sorted(chunks.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        seen.append(f"{name} {status.getLen()} {status.getModificationTime()}")
        size += status.getLen()
    store = Store(spark, f"{shared_folder(spark)}/index-{sha256(chr(10).join(seen).encode()).hexdigest()}")
    if not store.exists():
        store.append(chunks, 0, spread=size < SPREAD_BYTES * spark.sparkContext.defaultParallelism)
    return store.index()


def vocabulary(chunks: DataFrame) -> DataFrame:
    """Distinct key terms of each knowledge base."""
    return chunks.select("kb_id", F.explode(key_terms(F.col("text"))).alias("term")).distinct()


def term_score(k1: float = K1, b: float = B) -> Column:
    tf, dl = F.col("tf"), F.col("dl")
    return F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))
