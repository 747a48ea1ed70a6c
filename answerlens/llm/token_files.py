"""Token ids in length-delimited binary records, with an index of offsets.

A record is a length (8 bytes), the masked checksum of the length (4), the payload
and the masked checksum of the payload (4), all little-endian; the checksum is
CRC-32, masked by rotation and addition so that records may hold records.  A payload
is the document's id (8 bytes, with a flag byte for null), the width of an id in
bytes (1) and the ids.  Each shard has a second file of the records' offsets (8
bytes each), by which a shuffled reader finds any record without reading others.

Documents are range-partitioned by id, so a shard is one task's ascending range and
the shards follow one another.  A task writes its shard under a name of its own and
renames it when it is complete; a task that runs again writes the same bytes.
Shards are read back through Spark's binary files and checked record by record.

Encoding uses the tokenizers library.  A text is cut before single blanks, where the
vocabulary's pre-tokenizer cuts anyway, and the pieces' ids are kept in a bounded
cache; what is not there is encoded together.

Defined cases: a null or empty text is the end id alone; repeated ids follow one
another by a hash of their text; a null id comes last; an empty table writes no
records; columns other than doc_id and text do not matter.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerlens.llm.common import cut, parts, shared_dir

END_ID = 0
#: Bytes of text in a shard, about.
SHARD_BYTES = 24 << 20
CACHE = 1_200_000
_PIECE = re.compile("[\t-\r \x85\xa0  -     　]*[^\t-\r \x85\xa0  -     　]+|.+", re.DOTALL)


class Encoder:
    """A byte-level vocabulary file; ids as bytes, little-endian, of ``width`` each."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size()
        self.code = "H" if size <= 1 << 16 else "I"
        self.width = 2 if self.code == "H" else 4
        self.kind = f"<u{self.width}"
        self.blank = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.cache: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if len(self.cache) > CACHE:
            self.cache.clear()
        first, *rest = text.split(" ")
        found = list(map(self.cache.get, rest))
        if None in found:
            missing, i = [], -1
            for _ in range(found.count(None)):
                i = found.index(None, i + 1)
                missing.append(i)
            new = {rest[i] for i in missing}
            # white space beside a blank joins it in the pre-tokenizer, so such pieces are never kept without it
            if any(not p or p[0].isspace() or p[-1].isspace() or "<|" in p for p in new):
                return b"".join([self._piece(p) for p in _PIECE.findall(text)])
            self._learn(list(new))
            for i in missing:
                found[i] = self.cache[rest[i]]
        if first[-1:].isspace():
            return b"".join([self._piece(p) for p in _PIECE.findall(text)])
        return self._piece("\0" + first) + b"".join(found)

    def _piece(self, piece: str) -> bytes:
        """A piece with its own leading white space, kept under that; a zero byte marks the first piece of a text."""
        found = self.cache.get(key := piece if piece[:1] == "\0" else "\0" + piece)
        if found is None:
            found = self.cache[key] = self._ids(key[1:])
        return found

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces with a blank before each as one text, and cut the ids where a token begins with a blank."""
        for a in range(0, len(pieces), 200):
            part = pieces[a : a + 200]
            packed = array(self.code, self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids).tobytes()
            starts = (np.flatnonzero(self.blank[np.frombuffer(packed, dtype=self.kind)]) * self.width).tolist()
            if len(starts) == len(part):
                self.cache.update({p: packed[x:y] for p, x, y in zip(part, starts, [*starts[1:], len(packed)], strict=True)})
            else:
                self.cache.update({p: self._ids(" " + p) for p in part})


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, width: int, ids: bytes) -> bytes:
    payload = struct.pack("<?qB", doc_id is None, doc_id or 0, width) + ids
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def parse(data: bytes, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """The record at an offset: id, token ids as unsigned 32-bit integers, and the next record's offset."""
    length = data[at : at + 8]
    (n,) = struct.unpack("<Q", length)
    payload = data[at + 12 : at + 12 + n]
    if struct.unpack_from("<I", data, at + 8)[0] != masked(length) or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
        raise ValueError(f"a record at {at} is damaged")
    null, doc_id, width = struct.unpack_from("<?qB", payload)
    return None if null else doc_id, np.frombuffer(payload, dtype=f"<u{width}", offset=10).astype("<u4"), at + n + 16


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, n_shards: int | None = None) -> DataFrame:
    """docs(doc_id, text) -> shard-<n>.rec and shard-<n>.idx in the folder; a row for each shard: shard, n_records, n_tokens."""
    path = path or byte_vocabulary()
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    if n_shards is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n_shards = max(parts(spark), -(-size // SHARD_BYTES))
    tie = F.xxhash64("text").alias("tie")
    ranged = rows.select("doc_id", "text", tie).repartitionByRange(n_shards, F.col("doc_id").asc_nulls_last(), F.col("tie"))
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "tie").drop("tie")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        store, base = _open(folder)
        name = f"{base}/shard-{context.partitionId():06d}"
        own = f"{base}/_{uuid.uuid4().hex}"
        e, end = encoder(path), None
        offsets, at, n_tokens = array("Q"), 0, 0
        store.create_dir(base, recursive=True)
        with store.open_output_stream(own) as out:
            end = array(e.code, [end_id]).tobytes()
            for pdf in pdfs:
                for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                    ids = e.encode(text or "") + end
                    record = frame(None if pd.isna(doc_id) else int(doc_id), e.width, ids)
                    out.write(record)
                    offsets.append(at)
                    at += len(record)
                    n_tokens += len(ids) // e.width
        if not len(offsets):
            store.delete_file(own)
            return
        with store.open_output_stream(own + ".idx") as out:
            out.write(offsets.tobytes())
        store.move(own + ".idx", name + ".idx")
        store.move(own, name + ".rec")
        yield pd.DataFrame({"shard": [context.partitionId()], "n_records": [len(offsets)], "n_tokens": [n_tokens]})

    return cut(ordered.mapInPandas(run, "shard int, n_records long, n_tokens long"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all shards: shard, position in it, offset_in_shard in tokens, doc_id, n_tokens, ids_crc32."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                shard, at, before, out = int(name.rsplit("-", 1)[1].split(".")[0]), 0, 0, []
                while at < len(data):
                    doc_id, ids, at = parse(data, at)
                    out.append((shard, len(out), before, doc_id, len(ids), zlib.crc32(ids.tobytes())))
                    before += len(ids)
                frame_ = pd.DataFrame(out, columns=["shard", "position", "before", "doc_id", "n_tokens", "ids_crc32"])
                yield frame_.astype({"doc_id": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rec").load(folder).select("path", "content")
    return files.mapInPandas(run, "shard int, position long, before long, doc_id long, n_tokens long, ids_crc32 long")


def records(shards: DataFrame) -> DataFrame:
    """write()'s rows -> a row for each record: shard, position."""
    return shards.select("shard", F.explode(F.sequence(F.lit(0), F.col("n_records") - 1)).alias("position"))


def read_at(wanted: DataFrame, folder: str) -> DataFrame:
    """wanted(shard, position) in any order -> with doc_id and ids, each record found by the offset index, no other is read."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _open(folder)
        for pdf in pdfs:
            out: list = [None] * len(pdf)
            shards, positions = pdf["shard"].to_numpy(), pdf["position"].to_numpy()
            for shard in np.unique(shards):
                name = f"{base}/shard-{shard:06d}"
                with store.open_input_file(name + ".idx") as index, store.open_input_file(name + ".rec") as data:
                    for i in np.flatnonzero(shards == shard):
                        (at,) = struct.unpack("<Q", index.read_at(8, 8 * int(positions[i])))
                        (n,) = struct.unpack("<Q", data.read_at(8, at))
                        doc_id, ids, _ = parse(data.read_at(n + 16, at))
                        out[i] = (doc_id, ids.astype(np.int64))
            yield pdf.assign(doc_id=pd.array([x for x, _ in out], dtype="Int64"), ids=[x for _, x in out])

    return wanted.select("shard", "position").mapInPandas(run, "shard int, position long, doc_id long, ids array<long>")


def shuffled(shards: DataFrame, folder: str, seed: int = 0) -> DataFrame:
    """All records in an order drawn by the seed: place, doc_id, ids.  Only the records' numbers are shuffled."""
    drawn = records(shards).withColumn("key", F.xxhash64("shard", "position", F.lit(seed)))
    return read_at(drawn.repartitionByRange("key").sortWithinPartitions("key"), folder).select(F.monotonically_increasing_id().alias("place"), "doc_id", "ids")


def round_trip(docs: DataFrame, folder: str | None = None, path: str | None = None) -> DataFrame:
    """Write all documents, read the files back: doc_id, start (tokens before it in the whole), n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    shards = write(docs, folder, path)
    if not shards.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    by = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one short row a shard
    begins = shards.select("shard", F.coalesce(F.sum("n_tokens").over(by), F.lit(0)).alias("shard_start"))
    return read(spark, folder).join(begins, "shard").select("doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_files(spark, sf_dir):
    """Every document's place, length and checksum in the token files."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
