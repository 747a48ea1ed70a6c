"""Exact duplicates against an immutable snapshot, screened by static binary-fuse filters.

A snapshot is a table of groups, one row per distinct normalised text: its digest,
how many rows have it and the best row (most code points, then smallest doc_id).
For each bucket of digests a binary-fuse filter is built once.  A new batch is
first grouped by itself (map-side combined, so a text with any number of copies is
one row a task).  Its distinct digests pass the filter of their bucket; negatives
are new for certain, positives are joined with the exact bucket by digest.

Digests decide only together with the bytes: the rows of every group of two or
more are screened by a filter over those groups' digests, and their normalised
texts are grouped by (digest, text).  A digest with two different texts is a
collision; its rows are told apart by their text.

Defined cases: a null text counts as empty and empty texts equal one another; ties
in length go to the smaller doc_id, a null doc_id comes last; repeated rows with
one doc_id are counted each and kept or dropped together; an empty table gives no
rows; columns other than doc_id and text do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerlens.llm import fuse
from answerlens.llm.common import SPACE, cut

#: Digests in one bucket, on average; one bucket is one task's filter (about 9 bits a digest).
PER_BUCKET = 100_000
#: Filters are broadcast up to so many bytes together; beyond, rows are screened by a join with the digests.
BROADCAST_BYTES = 64 << 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def _key(digest: Column) -> Column:
    """The first 8 bytes of a digest as a number."""
    return F.conv(F.hex(F.substring(digest, 1, 8)), 16, -10).cast("long")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _order() -> Column:
    """Larger is better: more code points, then a smaller doc_id, a null one last."""
    return F.struct("n_chars", (F.lit(-1) - F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))).alias("low"), F.col("doc_id"))


def group(rows: DataFrame) -> DataFrame:
    """rows(digest, doc_id, n_chars) -> one row per digest: group_size, best."""
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max(_order()).alias("best"))


def build_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """groups(digest) -> (bucket, filter): one immutable filter for each bucket that has digests."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "filter": [fuse.build(pdf["key"].to_numpy(np.int64).view(np.uint64))]})

    keyed = groups.select(_key(F.col("digest")).alias("key")).withColumn("bucket", _bucket(F.col("key"), buckets))
    return keyed.groupBy("bucket").applyInPandas(make, "bucket int, filter binary")


def screen(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """groups with may_be_old: false means that the snapshot doesn't have the digest."""
    fields = T.StructType([*groups.schema.fields, T.StructField("may_be_old", T.BooleanType())])

    def test(new: pd.DataFrame, blobs: pd.DataFrame) -> pd.DataFrame:
        hit = fuse.probe(blobs["filter"].iloc[0], new["key"].to_numpy(np.int64).view(np.uint64)) if len(blobs) else np.zeros(len(new), dtype=bool)
        return new.drop(columns=["key", "bucket"]).assign(may_be_old=hit)

    keyed = groups.withColumn("key", _key(F.col("digest"))).withColumn("bucket", _bucket(F.col("key"), buckets))
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(test, fields)


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """The groups of a snapshot and of a batch -> the groups of both: digest, group_size, best."""
    n = max(1, -(-old.count() // PER_BUCKET))
    screened = cut(screen(new.select("digest", "group_size", "best.n_chars", "best.doc_id"), build_filters(old, n), n))
    fresh = screened.where(~F.col("may_be_old")).select("digest", "group_size", _order().alias("best"))
    positive = screened.where("may_be_old").select("digest", F.col("group_size").alias("more"), _order().alias("other"))
    both = old.join(positive, "digest", "full")
    size = F.coalesce("group_size", F.lit(0)) + F.coalesce("more", F.lit(0))
    return fresh.unionByName(both.select("digest", size.alias("group_size"), F.greatest("best", "other").alias("best")))


def _candidates(docs: DataFrame, repeated: DataFrame, n: int) -> DataFrame:
    """The rows of docs(digest, ...) whose digest is in repeated(digest), n of them."""
    if n * 1.3 > BROADCAST_BYTES:
        return docs.join(repeated, "digest", "left_semi")
    buckets = max(1, -(-n // PER_BUCKET))
    blobs = {r["bucket"]: r["filter"] for r in build_filters(repeated, buckets).collect()}  # checked above: at most BROADCAST_BYTES
    shared = docs.sparkSession.sparkContext.broadcast(blobs)

    @F.pandas_udf("boolean")
    def may_repeat(key: pd.Series, bucket: pd.Series) -> pd.Series:
        out = np.zeros(len(key), dtype=bool)
        ks, bs = key.to_numpy(np.int64).view(np.uint64), bucket.to_numpy()
        for b in np.unique(bs):
            if b in shared.value:
                at = bs == b
                out[at] = fuse.probe(shared.value[b], ks[at])
        return pd.Series(out)

    key = _key(F.col("digest"))
    return docs.where(may_repeat(key, _bucket(key, buckets)))


def check_bytes(docs: DataFrame, groups: DataFrame, digest: Callable[[Column], Column]) -> tuple[DataFrame, int]:
    """The digests that stand for more than one text, as (digest, norm), and how many there are."""
    repeated = cut(groups.where("group_size > 1").select("digest"))
    n = repeated.count()
    rows = docs.select(normalised(F.col("text")).alias("norm")).withColumn("digest", digest(F.col("norm")))
    texts = _candidates(rows, repeated, n).groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("copies"))
    clashing = cut(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"))
    return clashing, clashing.count()


def dedup(docs: DataFrame, is_old: Column, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """docs(doc_id, text) -> doc_id, keep_id, group_size, kept, digest; is_old marks the snapshot's rows, the rest is the batch."""
    base = docs.select("doc_id", normalised(F.col("text")).alias("norm"), F.coalesce(F.char_length("text"), F.lit(0)).alias("n_chars"), F.coalesce(is_old, F.lit(False)).alias("is_old"))
    rows = cut(base.select("doc_id", "n_chars", "is_old", digest(F.col("norm")).alias("digest")))
    groups = cut(merge(group(rows.where("is_old")), group(rows.where("NOT is_old"))))
    clashing, n = check_bytes(docs, groups, digest)
    if n:  # tell the texts of those digests apart by a longer key
        names = base.withColumn("digest", digest(F.col("norm"))).join(clashing, "digest", "left_semi")
        apart = names.select("doc_id", "n_chars", "is_old", F.concat("digest", F.lit(b"+"), F.col("norm").cast("binary")).alias("digest"))
        rows = cut(rows.join(clashing, "digest", "left_anti").unionByName(apart.select(rows.columns)))
        groups = group(rows)
    best = groups.select("digest", "group_size", F.col("best.doc_id").alias("keep_id"))
    return rows.join(best, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def earlier_half(docs: DataFrame) -> Column:
    """Ids up to the middle of their range came first: they are the snapshot, later ids the new batch."""
    ends = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    return F.col("doc_id") <= F.lit(((ends["a"] or 0) + (ends["b"] or 0)) // 2)


def op7_exact_dedup(spark, sf_dir):
    """Every document with the document that stays for it, by its text without white space."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup(docs, earlier_half(docs))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(length(text), 0) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
