"""Documents in blocks, and counting keys over all blocks.

Work on every n-gram or every window of a corpus is done on blocks of a few MB of
text with numpy.  What the blocks need to know of one another goes through one
shuffle: each block sends its distinct 64-bit keys, sorted and packed, in pieces
by key range; the task of a range adds up all blocks' counts and sends every block
the totals of its own keys.  A key is sent at most once by a block, however often
it occurs there, so frequent keys cost no more than others and no task gets more
than its range of the distinct keys of each block.

Blocks are checkpointed in the shared folder, so their numbering is fixed when
tasks are run again.  64-bit keys stand for strings: among n distinct strings some
two share a key with a probability of about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlens.llm.common import cut, parts

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20
#: Bytes of text for one key range; it bounds what one task counts.
RANGE_BYTES = 12 << 20
_U = np.uint64
_rng = np.random.default_rng(20240)
_LETTER = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xFF51AFD7ED558CCD)
    return h ^ (h >> _U(32))


class Hasher:
    """Hashes of stretches of a byte array, from sums of letters times powers of an odd base modulo 2^64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_LETTER[data] * _powers(_BASE, n), out=self.sums[1:])
        self.down = _powers(_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F))


_kept: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _kept.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20) + 1, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if n <= 2 << 20:
            _kept[int(base)] = have
    return have[:n]


def to_bytes(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def from_bytes(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=dtype)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, byte by byte."""
    return to_bytes(np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T)


def unpack_keys(b: bytes) -> np.ndarray:
    planes = from_bytes(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(a: np.ndarray) -> bytes:
    """Non-negative integers, in as few bytes each as the largest needs, byte by byte."""
    kind = np.min_scalar_type(int(a.max()) if len(a) else 0)
    return bytes([kind.itemsize]) + to_bytes(a.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T)


def unpack_counts(b: bytes) -> np.ndarray:
    planes = from_bytes(b[1:], np.uint8).reshape(b[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{b[0]}").ravel().astype(np.int64)


def give_back() -> None:
    """Memory that Arrow keeps for later goes back to the system: workers live on, and the next task may be another operator's."""
    pa.default_memory_pool().release_unused()


def pack(docs: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """docs(text, ...) -> block, n_bytes, payload: the rows as compressed Arrow, in blocks of about block_bytes of text (BLOCK_BYTES if not given)."""
    block_bytes = block_bytes or BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as w:
                for h in held:
                    w.write_batch(h)
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "n_bytes", "payload"])

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            start = 0
            while start < batch.num_rows:
                before = ends[start - 1] if start else 0
                stop = max(int(np.searchsorted(ends, before + block_bytes - size, side="right")), start + (size == 0))
                if stop > start:
                    held.append(batch.slice(start, stop - start))
                    size += int(ends[stop - 1] - before)
                if stop < batch.num_rows or size >= block_bytes:
                    yield out()
                    block += 1
                    held, size = [], 0
                start = stop
        if held:
            yield out()
        give_back()

    return cut(docs.mapInArrow(run, "block long, n_bytes long, payload binary"))


def unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def bytes_of(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes (null: none) in a row, and where each begins, with the end."""
    flat = pc.fill_null(texts, "").cast(pa.large_binary())
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    offsets = np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    data = np.frombuffer(flat.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def n_ranges(blocks: DataFrame) -> int:
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    return max(parts(blocks.sparkSession), -(-total // RANGE_BYTES))


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lowered, and the number of words of each text."""
    data, offsets = bytes_of(texts)
    data = _LOWER[data]
    full = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(full & (edge[:-1] | ~np.concatenate([[False], full[:-1]])))
    stops = np.flatnonzero(full & (edge[1:] | ~np.concatenate([full[1:], [False]]))) + 1
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):  # sums of powers over about a MB at a time
        to = max(at + 1, int(np.searchsorted(stops, starts[at] + (1 << 20), side="right")))
        base = starts[at]
        out[at:to] = Hasher(data[base : stops[to - 1]])(starts[at:to] - base, stops[at:to] - base)
        at = to
    return out, np.diff(np.searchsorted(starts, offsets))


REQUEST = "block long, part int, kind int, keys binary, counts binary"
REPLY = "block long, part int, kind int, totals binary"


def requests(block: int, kind: int, keys: np.ndarray, counts: np.ndarray, n: int, packer: Callable[[np.ndarray], bytes] = pack_counts) -> list[tuple]:
    """The pieces, by key range, of one block's sorted distinct keys with their counts (or what else packer packs)."""
    high = np.array([-(-(i << 64) // n) for i in range(1, n)], dtype=np.uint64)
    cuts = [0, *np.searchsorted(keys, high).tolist(), len(keys)]
    return [(block, p, kind, pack_keys(keys[a:b]), packer(counts[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]


def add_up(pieces: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Distinct keys of all pieces; for each piece its keys' places there and whether it is the first to have them; the totals."""
    keys = np.concatenate(pieces)
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    first = np.zeros(len(keys), dtype=bool)
    first[order[new]] = True
    totals = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)
    ends = np.cumsum([len(p) for p in pieces])[:-1]
    return keys[order[new]], np.split(place, ends), np.split(first, ends), totals


def collect_replies(pdf: pd.DataFrame, kind: int, column: str, unpacker: Callable[[bytes], np.ndarray]) -> np.ndarray:
    """One block's replies of one kind, joined in key order."""
    mine = pdf[pdf["kind"] == kind].sort_values("part")
    return np.concatenate([unpacker(b) for b in mine[column]]) if len(mine) else np.zeros(0, dtype=np.int64)
