"""Corpus analysis."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlens.functions.text import keywords, tokens
from answerlens.session import kept


def term_counts(docs: DataFrame, min_chars: int = 100, vocabulary: int | None = 1000) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) -> doc_id, numbers, tfs of a document's terms, and number, term, idf (smooth) of the most frequent terms; both stored."""
    long = docs.where(F.length("text") > min_chars)
    every = long.select("doc_id", F.explode(tokens(F.col("text"))).alias("term"))
    total = every.groupBy("term").agg(F.count(F.lit(1)).alias("total"))
    if vocabulary:
        total = total.orderBy(F.desc("total"), "term").limit(vocabulary)
    terms = kept(total.select("term", F.monotonically_increasing_id().alias("number")))
    if vocabulary:
        rows = _counted(long, terms)
    else:
        tf = every.join(terms, "term").groupBy("doc_id", "number").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        rows = tf.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", "tf"))).alias("x"))
        rows = rows.select("doc_id", F.col("x.number").alias("numbers"), F.col("x.tf").alias("tfs"))
    rows = kept(rows)
    df = rows.select(F.explode("numbers").alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(long.count()) + 1) / (F.col("df") + 1)) + 1
    return rows, kept(df.join(terms, "number").select("number", "term", idf.alias("idf")))


def _counted(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The terms of a bounded vocabulary in each document, counted where its text is read: one row a document is shuffled, for ids of several rows."""
    held = terms.toArrow()  # as many rows as the vocabulary has
    known, numbers = held["term"].combine_chunks(), held["number"].to_numpy()
    schema = T.StructType([docs.schema["doc_id"], T.StructField("numbers", T.ArrayType(T.LongType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = np.argsort(numbers)
        for batch in batches:
            lists = batch["terms"]
            at = pc.index_in(lists.flatten(), pa.array(known.take(pa.array(by)))).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            found = ~np.isnan(at)
            each, n = np.unique(doc[found] * len(by) + at[found].astype(np.int64), return_counts=True)
            ends = np.searchsorted(each, np.arange(batch.num_rows + 1) * len(by))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(offsets, pa.array(numbers[by][each % max(len(by), 1)])), pa.ListArray.from_arrays(offsets, pa.array(n, pa.int32()))], names=schema.names)

    each = docs.select("doc_id", tokens(F.col("text")).alias("terms")).mapInArrow(count, schema).where(F.size("numbers") > 0)
    lists = each.groupBy("doc_id").agg(F.collect_list(F.struct("numbers", "tfs")).alias("x"))
    flat = F.flatten(F.transform("x", lambda y: F.arrays_zip(y["numbers"].alias("number"), y["tfs"].alias("tf"))))
    every = F.array_sort(F.array_distinct(F.flatten(F.col("x.numbers"))))
    total = lambda number: F.aggregate(F.filter(flat, lambda y: y["number"] == number), F.lit(0), lambda n, y: n + y["tf"])
    once = F.size("x") == 1
    return lists.select("doc_id", F.when(once, F.col("x")[0]["numbers"]).otherwise(every).alias("numbers"), F.when(once, F.col("x")[0]["tfs"]).otherwise(F.transform(every, total)).alias("tfs"))


def tf_idf(docs: DataFrame, min_chars: int = 100, vocabulary: int | None = 1000) -> DataFrame:
    """docs(doc_id, text) -> doc_id, term, w of unit length."""
    rows, terms = term_counts(docs, min_chars, vocabulary)
    raw = rows.select("doc_id", F.inline(F.arrays_zip("numbers", "tfs"))).withColumnRenamed("numbers", "number").join(terms, "number")
    raw = raw.select("doc_id", "term", (F.col("tfs") * F.col("idf")).alias("w"))
    norm = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "doc_id").select("doc_id", "term", (F.col("w") / F.col("norm")).alias("w"))


#: Documents of a strip and of a block in it: two strips meet in one task, two blocks in one product of matrices.
STRIP, BLOCK = 8192, 256
#: Strips beyond which they become longer, up to sixteen times, since every strip is sent to all others.
STRIPS = 8
#: Columns of a product at most.
COLUMNS = 4096
#: Directions of the screen before a product, the sample they are taken from, and groups that documents are put in order by.
DIRECTIONS, SCREENED, GROUPS = 192, 2048, 16


class Vectors:
    """The documents of one strip as sparse rows of unit length, sides of products of matrices."""

    def __init__(self, rows: pa.Table, known: np.ndarray, idf: np.ndarray):
        lists = rows["numbers"].combine_chunks()
        self.bounds, self.numbers = lists.offsets.to_numpy(), lists.flatten().to_numpy()
        self.bounds = self.bounds - self.bounds[0]
        self.columns = np.searchsorted(known, self.numbers)
        raw = rows["tfs"].combine_chunks().flatten().to_numpy() * idf[self.columns]
        self.weights = raw / np.repeat(np.sqrt(np.add.reduceat(raw * raw, self.bounds[:-1])), np.diff(self.bounds))  # every row has a term

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Row, column and weight of each entry of these rows, and how many rows they are."""
        n = np.diff(self.bounds)[rows]
        at = np.repeat(self.bounds[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(np.arange(len(rows)), n), self.columns[at], self.weights[at], len(rows)

    def dense(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        return _dense(self.entries(rows), columns)


def _dense(entries: tuple, columns: np.ndarray) -> np.ndarray:
    """A matrix of the entries in these columns, which are in order."""
    row, column, weight, n = entries
    at = np.minimum(np.searchsorted(columns, column), len(columns) - 1)
    own = columns[at] == column
    m = np.zeros((n, len(columns)))
    m[row[own], at[own]] = weight[own]
    return m


def _product(a: tuple, b: tuple) -> np.ndarray:
    """Scalar products of all rows of two blocks, over the terms that both have."""
    out = np.zeros((a[3], b[3]))
    shared = np.intersect1d(a[1], b[1])
    for low in range(0, len(shared), COLUMNS):
        out += _dense(a, shared[low : low + COLUMNS]) @ _dense(b, shared[low : low + COLUMNS]).T
    return out


class Screen:
    """No product of two unit vectors is more than that of their parts in some directions plus the product of the lengths of what is left of them.

    Directions are the main ones of a sample, over the terms that weigh most in it; any others would be right, but let more through.
    """

    def __init__(self, sides: list[Vectors]):
        rng = np.random.default_rng(11)
        some = [x.entries(np.sort(rng.choice(len(x), min(len(x), SCREENED // len(sides)), replace=False))) for x in sides]
        column, weight = (np.concatenate([x[i] for x in some]) for i in (1, 2))
        heavy = np.bincount(column, weight * weight)
        self.columns = np.sort(np.argsort(-heavy)[: min(COLUMNS, int(np.count_nonzero(heavy)))])
        sample = np.concatenate([_dense(x, self.columns) for x in some])
        if len(self.columns) <= len(sample):
            around = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
        else:
            around = np.linalg.qr(sample.T @ np.linalg.eigh(sample @ sample.T)[1][:, ::-1])[0]
        self.directions = around[:, :DIRECTIONS]
        parts = sample @ self.directions
        self.centres = parts[rng.choice(len(parts), min(GROUPS, len(parts)), replace=False)]
        for _ in range(5):
            at = self.group(parts)
            self.centres = np.array([parts[at == g].mean(axis=0) if (at == g).any() else c for g, c in enumerate(self.centres)])

    def group(self, parts: np.ndarray) -> np.ndarray:
        return ((self.centres**2).sum(axis=1) - 2 * parts @ self.centres.T).argmin(axis=1)

    def side(self, x: Vectors) -> tuple[np.ndarray, np.ndarray]:
        """The order in which similar rows are neighbours, and in that order the parts in the directions with the length of the rest."""
        parts = np.concatenate([x.dense(np.arange(low, min(low + BLOCK, len(x))), self.columns) @ self.directions for low in range(0, len(x), BLOCK)])
        rest = np.sqrt(np.maximum(1 - (parts**2).sum(axis=1), 0) + 1e-9)
        order = np.lexsort((rest, self.group(parts)))
        return order, np.column_stack([parts, rest])[order].astype(np.float32)


def _near(rows: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the one or two strips in a tile's rows: places a and b (in rows) and products of at least ``least``, each pair of documents once, the smaller id first."""
    strip = rows["strip"].to_numpy()
    terms = rows.filter(pa.array(strip < 0))
    known, idf = (np.concatenate([x.values.to_numpy() for x in terms[c]]) for c in ("numbers", "idf"))
    known, idf = known[by := np.argsort(known)], idf[by]
    places = [np.flatnonzero(strip == s) for s in np.unique(strip[strip >= 0])]
    if not places:
        return
    order = np.zeros(len(strip), dtype=np.int64)
    order[strip >= 0] = np.unique(rows["doc_id"].filter(pa.array(strip >= 0)).to_numpy(), return_inverse=True)[1]
    sparse = rows.select(["numbers", "tfs"])
    sides = [Vectors(sparse.take(pa.array(p)), known, idf) for p in places]
    del sparse, rows, terms
    screen = Screen(sides)
    sorts, parts = zip(*map(screen.side, sides), strict=True)
    one = len(sides) == 1
    whole = np.arange(len(known)) if len(known) <= COLUMNS else None
    for low_b in range(0, len(places[-1]), BLOCK):
        of_b = sorts[-1][low_b : low_b + BLOCK]
        right = sides[-1].dense(of_b, whole) if whole is not None else None
        for low_a in range(0, low_b + 1 if one else len(places[0]), BLOCK):
            may = parts[0][low_a : low_a + BLOCK] @ parts[-1][low_b : low_b + BLOCK].T >= least - 1e-4  # single precision
            if one and low_a == low_b:
                may = np.triu(may, 1)
            i, j = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
            if not len(i):
                continue
            of_a = sorts[0][low_a : low_a + BLOCK]
            if right is not None:
                product = sides[0].dense(of_a[i], whole) @ right[j].T
            else:
                product = _product(sides[0].entries(of_a[i]), sides[-1].entries(of_b[j]))
            x, y = np.nonzero((product >= least) & may[np.ix_(i, j)])
            a, b, score = places[0][of_a[i[x]]], places[-1][of_b[j[y]]], product[x, y]
            turned = order[a] > order[b]
            yield np.where(turned, b, a), np.where(turned, a, b), score


def _tiles(docs: DataFrame, vocabulary: int | None, along: DataFrame | None = None, strips: int | None = None) -> DataFrame:
    """Every two strips of documents side by side: tile, strip, payload; each tile has the terms' idf as well, in rows of the strip -1.

    doc_id, numbers, tfs and what along(doc_id, ...) has travel as compressed Arrow (payload) of some blocks, which ``_unpacked`` turns back.
    """
    rows, terms = term_counts(docs, vocabulary=vocabulary)
    rows = rows.where("doc_id IS NOT NULL")
    count = rows.count()
    n = max(1, min(strips or STRIPS, -(-count // STRIP)), -(-count // ((4 if along else 16) * STRIP)))  # those with texts stay shorter
    own, other = F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tile = lambda a, b: F.least(a, b) * n + F.greatest(a, b)
    some = (rows.join(along, "doc_id", "left") if along else rows).withColumn("strip", own).groupBy("strip").applyInArrow(_packed, "strip int, payload binary")
    some = some if along else kept(some)
    dealt = some.select("*", other.alias("other")).select(tile("strip", "other").alias("tile"), *some.columns)
    packed = terms.groupBy(F.floor(F.col("number") / 4096)).agg(F.collect_list(F.struct("number", "idf")).alias("x"))
    pairs = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.transform(F.sequence(i, F.lit(n - 1)), lambda j: i * n + j))))
    of_terms = packed.select(pairs.alias("tile"), F.lit(-1).alias("strip"), F.col("x.number").alias("numbers"), F.col("x.idf").alias("idf"))
    return dealt.unionByName(of_terms, allowMissingColumns=True).repartitionByRange(n * (n + 1) // 2, "tile")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A strip's rows as compressed Arrow."""
    for batch in batches:
        for low in range(0, batch.num_rows, 4 * BLOCK):
            part = batch.slice(low, 4 * BLOCK).drop_columns(["strip"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays([batch["strip"].slice(low, 1), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["strip", "payload"])


def _unpacked(batches: Iterator[pa.RecordBatch], take: Callable[[pa.Table], pa.Table] = lambda part: part) -> pa.Table:
    """A tile's rows as ``_near`` takes them; take() gets each part of the documents, in order, and says what of it is held."""
    tables = []
    for batch in batches:
        for strip, payload, numbers, idf in zip(*(batch[c].to_pylist() for c in ("strip", "payload", "numbers", "idf")), strict=True):
            part = take(pa.ipc.open_stream(payload).read_all()) if payload is not None else pa.table({"numbers": [numbers], "idf": [idf]}, pa.schema([("numbers", pa.list_(pa.int64())), ("idf", pa.list_(pa.float64()))]))
            tables.append(part.append_column("strip", pa.array(np.full(len(part), strip), pa.int32())))
    return pa.concat_tables(tables, promote_options="default").combine_chunks()


def relations(docs: DataFrame, related: float = 0.4, duplicate: float = 0.8, vocabulary: int | None = 1000) -> DataFrame:
    """Pairs i < j of similar documents.

    Documents are dealt into strips of ``STRIP`` to sixteen times that; a task takes two strips, leaves
    out what a bound on the cosine excludes, and multiplies the rest block by block, so what is held and sent does not grow with the number
    of pairs.  Work and result are those of all pairs.
    """
    schema = T.StructType([T.StructField(x, docs.schema["doc_id"].dataType) for x in "ab"] + [T.StructField("similarity", T.DoubleType())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _unpacked(batches)
        ids = rows["doc_id"].combine_chunks() if "doc_id" in rows.column_names else None
        for a, b, score in _near(rows, related - 1e-6):
            similarity = np.floor(score * 1e6 + 0.5) / 1e6  # as SQL rounds
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(similarity)], names=schema.names)

    found = _tiles(docs, vocabulary).groupBy("tile").applyInArrow(meet, schema).where(F.col("similarity") > related)
    return found.withColumn("relation", F.when(F.col("similarity") > duplicate, "duplicate").otherwise("related")).select("a", "b", "similarity", "relation")


#: Pairs of keywords' set and keyword that tasks take along: a number of four bytes each, and each distinct keyword once.
BROADCAST_KEYWORDS = 64_000_000


def coverage(queries: DataFrame, docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each document the share of queries with a keyword that occurs in it as a substring, and how many keywords do.

    All distinct keywords make one Aho-Corasick automaton, which reads each text once;
    no text is shuffled.  Queries with the same keywords are one set, which counts as many
    times; a text's sets come from the bits of common words and the lists of rare ones.  A row is a document; a null text has no keywords.  Of more
    keywords than tasks can take along, the tokens' substrings are joined instead.  The
    columns in keep come along.
    """
    pairs = queries.select("query_id", F.explode(F.array_distinct(keywords(F.col("query")))).alias("word"))  # read again where wanted, as rows of words take more room than the queries
    total = queries.count()
    words = kept(pairs.select("word").distinct().select("word", F.monotonically_increasing_id().alias("number")))
    numbered = pairs.join(words, "word").groupBy("query_id").agg(F.array_sort(F.collect_set("number")).alias("words"))
    sets = kept(numbered.groupBy("words").agg(F.count(F.lit(1)).alias("n")))
    if (sets.agg(F.sum(F.size("words"))).first()[0] or 0) > BROADCAST_KEYWORDS:
        return _coverage_by_join(kept(pairs), total, docs, keep)
    rows, known = sets.toArrow(), words.toArrow()  # counted above
    lists, weights = rows["words"].combine_chunks(), rows["n"].to_numpy()
    at = known["number"].to_numpy()
    of_word = np.argsort(at)[np.searchsorted(at, lists.flatten().to_numpy(), sorter=np.argsort(at))]
    numbers = np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy())[np.argsort(of_word, kind="stable")]
    ends = np.cumsum(np.bincount(of_word, minlength=len(at)))
    shared = docs.sparkSession.sparkContext.broadcast((known["word"].to_pylist(), ends, numbers, weights))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("covered", T.LongType()), T.StructField("words", T.LongType()), *(docs.schema[c] for c in keep)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ends, numbers, weights = shared.value
        bounds = np.concatenate([[0], ends])
        size = np.diff(bounds)
        machine = ahocorasick.Automaton()
        for i, word in enumerate(words):
            machine.add_word(word, i)
        machine.make_automaton()
        # a word of many sets has a bit for each set, which takes no more than eight bytes for each of its pairs
        common = np.flatnonzero(size * 64 >= len(weights)).tolist() if words else []
        row_of = dict(zip(common, range(len(common)), strict=True))
        bits = np.zeros((len(common), -(-len(weights) // 8)), dtype=np.uint8)
        for i, row in row_of.items():
            flags = np.zeros(len(weights), dtype=bool)
            flags[numbers[bounds[i] : bounds[i + 1]]] = True
            bits[row] = np.packbits(flags)
        each_once = bool((weights == 1).all())
        for batch in batches:
            counts = np.zeros((2, batch.num_rows), dtype=np.int64)
            for i, text in enumerate(batch["_low"]):
                found = {v for _, v in machine.iter(text.as_py() or "")} if words else ()
                if found:
                    rows = [row_of[v] for v in found if v in row_of]
                    seen = np.unpackbits(np.bitwise_or.reduce(bits[rows], axis=0), count=len(weights)).view(bool) if rows else np.zeros(len(weights), dtype=bool)
                    for v in found:
                        if v not in row_of:
                            seen[numbers[bounds[v] : bounds[v + 1]]] = True
                    counts[:, i] = np.count_nonzero(seen) if each_once else weights[seen].sum(), len(found)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts[0]), pa.array(counts[1]), *(batch[c] for c in keep)], names=schema.names)

    found = docs.select("doc_id", F.lower("text").alias("_low"), *keep).mapInArrow(scan, schema)
    return found.select("doc_id", F.round(F.col("covered") / F.lit(total), 6).alias("coverage"), "words", *keep)


def _coverage_by_join(q: DataFrame, total: int, docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The distinct tokens of all documents are cut into the substrings that are as long as some keyword and joined with the keywords, then with the documents by token."""
    row = docs.select(*dict.fromkeys(("doc_id", "text", *keep)), F.monotonically_increasing_id().alias("_row"))
    row = kept(row)
    lengths = F.array(*[F.lit(r["n"]) for r in q.select(F.length("word").alias("n")).distinct().orderBy("n").collect()]).cast("array<int>")  # as many as words have lengths
    held = row.select("_row", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    fitting = F.filter(lengths, lambda n: n <= F.length("token"))
    inside = F.flatten(F.transform(fitting, lambda n: F.transform(F.sequence(F.lit(1), F.length("token") - n + 1), lambda i: F.substring("token", i, n))))
    found = held.select("token").distinct().select("token", F.explode(F.array_distinct(inside)).alias("word")).join(q.select("word").distinct(), "word")
    words = held.join(found, "token").select("_row", "word").distinct()
    hit = words.join(q, "word").groupBy("_row").agg(F.count_distinct("query_id").alias("covered"), F.count_distinct("word").alias("words"))
    every = row.select("doc_id", "_row", *keep).join(hit, "_row", "left")
    return every.select("doc_id", F.round(F.coalesce("covered", F.lit(0)) / F.lit(total), 6).alias("coverage"), F.coalesce("words", F.lit(0)).alias("words"), *keep)


def merged(docs: DataFrame, pairs: DataFrame, most: int = 100) -> DataFrame:
    """For each pair the sorted union of distinct non-blank lines, the first hundred."""
    each = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("doc_id")).join(docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")), "doc_id")
    lines = each.where(F.trim("line") != "").select("a", "b", "line").distinct()
    first = lines.withColumn("_r", F.row_number().over(Window.partitionBy("a", "b").orderBy("line"))).where(F.col("_r") <= most)
    return first.groupBy("a", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "line"))), lambda x: x["line"]), "\n").alias("text"))


#: Strips that carry texts along: fewer, as each is sent to all others.
STRIPS_OF_TEXTS = 4


def merged_duplicates(docs: DataFrame, duplicate: float = 0.8, vocabulary: int | None = 1000, most: int = 100, digest: bool = False) -> DataFrame:
    """U3 over J10's duplicates: a, b and the text of ``merged`` (with digest its MD5 instead, so that no text leaves the task).

    Lines are merged where a pair is found: the first hundred lines of a union are among
    the first hundred of either side, which travel with the documents.  No row is made
    for a line of a pair; documents of the same lines are merged once with those of another
    block's.  Every other pair's text is put together and read whole, which is most of the work.
    """
    lines = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")))))
    along = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.slice(lines, 1, most).alias("lines"))
    name = "digest" if digest else "text"
    schema = T.StructType([T.StructField(x, docs.schema["doc_id"].dataType) for x in "ab"] + [T.StructField("similarity", T.DoubleType()), T.StructField(name, T.StringType())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}  # each distinct line once
        of: list = []

        def light(part: pa.Table) -> pa.Table:
            lists = part["lines"].combine_chunks()
            numbers = np.array([number.setdefault(x, len(number)) for x in lists.flatten().cast(pa.binary()).to_pylist()], dtype=np.int64)
            of.extend(np.split(numbers, np.cumsum(lists.value_lengths().fill_null(0).to_numpy())[:-1]))
            return part.drop_columns(["lines"])

        rows = _unpacked(batches, light)
        place = np.full(len(rows), -1)  # of a row among the documents
        place[rows["strip"].to_numpy() >= 0] = np.arange(len(of))
        ids = rows["doc_id"].combine_chunks() if of else None
        held = sorted(number)
        rank = np.empty(len(held), dtype=np.int64)
        rank[[number[x] for x in held]] = np.arange(len(held))
        del number
        kinds: dict[bytes, int] = {}  # documents of the same lines
        kind = np.array([kinds.setdefault(np.sort(rank[x]).tobytes(), len(kinds)) for x in of], dtype=np.int64)
        of = [frozenset(np.frombuffer(x, dtype=np.int64).tolist()) for x in kinds]
        del kinds

        def union(a: int, b: int) -> str:
            text = b"\n".join([held[i] for i in sorted(of[a] | of[b])[:most]])
            return md5(text).hexdigest() if digest else text.decode()

        for a, b, score in _near(rows, duplicate - 1e-6):
            for low in range(0, len(a), 4096):
                x, y = a[low : low + 4096], b[low : low + 4096]
                x_kind, y_kind = np.sort([kind[place[x]], kind[place[y]]], axis=0)
                each, which = np.unique(x_kind * len(of) + y_kind, return_inverse=True)
                texts = pa.array([union(*divmod(c, len(of))) for c in each.tolist()], pa.string()).take(pa.array(which))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(score[low : low + 4096]), texts], names=schema.names)

    found = _tiles(docs, vocabulary, along, STRIPS_OF_TEXTS).groupBy("tile").applyInArrow(meet, schema)
    return found.where(F.round("similarity", 6) > duplicate).select("a", "b", name)


def distinct_pairs(qa: DataFrame) -> DataFrame:
    """U4: qa(doc_id, pos, question, answer), each pair at its first place."""
    return qa.groupBy("doc_id", "question", "answer").agg(F.min("pos").alias("pos"))


def new_lines(before: DataFrame, after: DataFrame, most: int = 5, width: int = 80) -> DataFrame:
    """Lines that only the later text has."""
    cut = lambda df: df.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    fresh = cut(after).join(cut(before).select("doc_id", "line").distinct(), ["doc_id", "line"], "left_anti")
    w = Window.partitionBy("doc_id").orderBy("pos")
    return fresh.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("doc_id", "rank", F.substring("line", 1, width).alias("line"))


def issues_of(text: Column, script: str = r"\p{L}", least: int = 50) -> Column:
    """What is wrong with a text, as array<struct<issue,severity>>."""
    n, own = F.length(text), F.length(F.regexp_replace(text, f"[^{script}]", ""))
    issue = lambda name, level, when: F.when(when, F.struct(F.lit(name).alias("issue"), F.lit(level).alias("severity")))
    return F.array_compact(F.array(
        issue("too_short", "critical", n < 100),
        issue("too_long", "warning", n > 5000),
        issue("little_text", "warning", (own < least) & (own > 0)),
        issue("page_marks", "medium", text.rlike(r"\[Page [0-9]+\]|\bPage [0-9]+ of [0-9]+\b")),
        issue("other_script", "critical", own == 0),
    ))


def issues(docs: DataFrame, script: str = r"\p{L}", least: int = 50) -> DataFrame:
    """One row for each issue of a document."""
    return docs.select("doc_id", F.inline(issues_of(F.col("text"), script, least)))


def pairs_of(title: Column, items: Column) -> Column:
    """The questions and answers of a section, as array<struct<question,answer>>."""
    split = lambda i: F.split(i, "[:：]", 2)
    item = lambda i: F.when(F.size(split(i)) == 2, F.array(
        F.struct(F.concat(F.lit("What is "), F.trim(split(i)[0]), F.lit("?")).alias("question"), F.trim(split(i)[1]).alias("answer")),
        F.struct(F.concat(F.lit("What does "), title, F.lit(" say about "), F.trim(split(i)[0]), F.lit("?")).alias("question"), i.alias("answer")),
    )).otherwise(F.array(F.struct(F.concat(F.lit("Does "), title, F.lit(" include "), i, F.lit("?")).alias("question"), F.concat(F.lit("Yes: "), i).alias("answer"))))
    summary = F.array(F.struct(F.concat(F.lit("What does "), title, F.lit(" cover?")).alias("question"), F.array_join(items, "; ").alias("answer")))
    return F.concat(summary, F.flatten(F.transform(items, item)))


def section_pairs(sections: DataFrame) -> DataFrame:
    """sections(doc_id, title, items) -> question, answer in order."""
    return sections.select("doc_id", F.posexplode(pairs_of(F.col("title"), F.col("items"))).alias("pos", "qa")).select("doc_id", "pos", "qa.question", "qa.answer")


def feedback_pairs(feedback: DataFrame) -> DataFrame:
    """A question and answer for each kind of feedback, without repeats."""
    kind = F.col("feedback_type")
    answer = F.when(kind == "recall_missing", F.concat(F.lit("Covered under: "), F.col("query"))).when(kind == "intent_wrong", F.concat(F.lit("Meant: "), F.coalesce("intent_correction", F.lit("unknown")))).otherwise(F.lit("Under review"))
    return distinct_pairs(feedback.select("doc_id", "pos", F.col("query").alias("question"), answer.alias("answer")))


def render(docs: DataFrame, qa: DataFrame) -> DataFrame:
    """Original text with its questions and answers ("suggestion"), and these alone ("opt")."""
    packed = qa.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "question", "answer"))), lambda x: F.concat(F.lit("Q: "), x["question"], F.lit("\nA: "), x["answer"])), "\n").alias("qa"))
    both = docs.join(packed, "doc_id", "left").withColumn("qa", F.coalesce("qa", F.lit("")))
    texts = F.array(F.struct(F.lit("opt").alias("variant"), F.col("qa").alias("content")), F.struct(F.lit("suggestion").alias("variant"), F.concat_ws("\n\n", "qa", "text").alias("content")))
    return both.select("doc_id", F.inline(texts))


def structure_pairs(s: Column, nested: bool = True) -> Column:
    """P17 over P16's structure: of each section with all its items, then (nested) of each of its subsections; each pair once (U4)."""
    below = lambda x: F.filter(x["subsections"], lambda y: F.size(y["items"]) > 0)
    own = lambda x: F.concat(x["items"], F.flatten(F.transform(x["subsections"], lambda y: y["items"])))
    groups = lambda x: F.concat(F.array(F.struct(x["title"].alias("title"), own(x).alias("items"))), F.transform(below(x), lambda y: F.struct(y["title"].alias("title"), y["items"].alias("items"))) if nested else F.array())
    every = F.filter(F.flatten(F.transform(s["sections"], groups)), lambda g: F.size(g["items"]) > 0)
    return F.array_distinct(F.flatten(F.transform(every, lambda g: pairs_of(g["title"], g["items"]))))


def rendered(text: Column, s: Column, coverage: Column, summary: dict) -> Column:
    """P18 whole, as array<struct<variant,content>>: "opt" (outline, then questions), "suggestion" (summary of the analysis, frequent keywords, questions, the original text) and "enriched" (the original text, questions, keywords with their counts).

    summary has queries, intents [(name, count)] and keywords [(word, count)], the most frequent first.
    """
    bullets = lambda items: F.concat(F.lit(""), F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), i, F.lit("\n"))), ""))
    sub = lambda y: F.concat(F.lit("### "), y["title"], F.lit("\n"), bullets(y["items"]))
    section = lambda x: F.concat(F.lit("## "), x["title"], F.lit("\n"), bullets(x["items"]), F.array_join(F.transform(x["subsections"], sub), ""))
    asked = lambda qa: F.array_join(F.transform(qa, lambda x, i: F.concat(F.lit("### Q"), (i + 1).cast("string"), F.lit(": "), x["question"], F.lit("\n"), x["answer"], F.lit("\n"))), "")
    text = F.coalesce(text, F.lit(""))
    counted = "".join(f"- {word}: {n}\n" for word, n in summary["keywords"])
    first = "".join(f"- {word}: {n}\n" for word, n in summary["keywords"][:10])
    intents = ", ".join(f"{name} ({n})" for name, n in summary["intents"][:3])
    title = F.when(s["title"] != "", s["title"]).otherwise("Optimised document")
    opt = F.concat(F.lit("# "), title, F.lit("\n"), F.array_join(F.transform(s["sections"], section), ""), F.lit("## Common questions\n"), asked(structure_pairs(s)))
    head = F.concat(F.lit("# Suggestions\n- Coverage: "), F.round(coverage * 100, 1).cast("string"), F.lit(f"%\n- Queries: {summary['queries']}\n- Intents: {intents}\n## Frequent keywords\n{first}## Questions\n"))
    suggestion = F.concat(head, asked(structure_pairs(s, nested=False)), F.lit("## Original\n"), text)
    enriched = F.concat(text, F.lit("\n## Questions\n"), asked(structure_pairs(s)), F.lit(f"## Keywords\n{counted}"))
    content = lambda name, c: F.struct(F.lit(name).alias("variant"), c.alias("content"))
    return F.array(content("opt", opt), content("suggestion", suggestion), content("enriched", enriched))


def cross_questions(summaries: DataFrame, pairs: DataFrame) -> DataFrame:
    """summaries(doc_id, title, points) of related pairs -> one question each."""
    s = lambda x: summaries.select(F.col("doc_id").alias(x), F.concat_ws(": ", "title", F.array_join(F.slice("points", 1, 10), "; ")).alias(f"s_{x}"), F.col("title").alias(f"t_{x}"))
    return pairs.select("a", "b").join(s("a"), "a").join(s("b"), "b").select("a", "b", F.format_string("How do %s and %s relate?", "t_a", "t_b").alias("question"), F.concat_ws("\n", "s_a", "s_b").alias("answer"))


def full_analysis(docs: DataFrame, logs: DataFrame, feedback: DataFrame, folder: str, related: float | None = 0.4, duplicate: float = 0.8) -> dict[str, DataFrame]:
    """Every table of the nightly report, written under folder and read back: docs(doc_id, text), logs(query_id, query, score, is_passing and, if there is one, intent).

    One pass over the texts gives a document's coverage (J15), issues (G10) and rendered
    texts (P18): the automaton's scan carries the text along and the rest are columns of
    the same row, so nothing is shuffled.  The summary that the texts quote is bounded:
    twenty keywords and three intents.  Relations are the one table that can be quadratic
    (J10), so its similarities are stored as whole millionths; with related None it is left out.  A table that was written before is replaced.
    """
    from answerlens.functions.text_udf import structure
    from answerlens.operators.rules import histogram, query_effectiveness, top_keywords

    spark = docs.sparkSession

    def stored(name: str, table: DataFrame) -> DataFrame:
        table.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.schema(table.schema).parquet(f"{folder}/{name}")

    effectiveness = stored("effectiveness", query_effectiveness(logs))
    words = stored("keywords", top_keywords(logs))
    often = logs.where("intent IS NOT NULL").groupBy("intent").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "intent").limit(3).collect() if "intent" in logs.columns else []
    summary = {
        "queries": effectiveness.first()["queries"],
        "intents": [(r["intent"], r["n"]) for r in often],
        "keywords": [(r["word"], r["n"]) for r in words.orderBy(F.desc("n"), "word").collect()],
    }
    text, s = F.col("text"), F.col("s")
    read = coverage(logs, docs.select("doc_id", "text"), keep=("text",)).withColumn("s", structure(text))
    each = stored("documents", read.select("doc_id", "coverage", "words", issues_of(text).alias("issues"), rendered(text, s, F.col("coverage"), summary).alias("texts")))
    tables = {
        "coverage": each.select("doc_id", "coverage", "words"),
        "effectiveness": effectiveness,
        "keywords": words,
        "issues": each.select("doc_id", F.inline("issues")),
        "feedback": stored("feedback", histogram(feedback)),
        "texts": each.select("doc_id", F.inline("texts")),
    }
    if related is None:
        return tables
    millionths = F.rint(F.col("similarity") * 1e6).cast("int").alias("millionths")  # all that a rounded similarity says, in a third of the room
    found = stored("relations", relations(docs, related, duplicate).select("a", "b", millionths, "relation"))
    return tables | {"relations": found.select("a", "b", (F.col("millionths") / 1e6).alias("similarity"), "relation")}
