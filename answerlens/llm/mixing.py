"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document gets an exponential key -ln(u) / weight, u drawn from a hash of the
document, weight from its quality.  A source's budget is first spent on complete
epochs; what is left is spent on the documents with the smallest keys, in key
order, until the running sum of their sizes reaches it.

The running sum is never taken over a whole source.  Sizes are first added up by
source and key bucket (map-side combined); a window over the buckets of a source
finds the one in which the budget ends; only that bucket's rows are sorted.  The
outcome is one cut key per source, so documents are selected by comparing their
key with the cut and the texts are not shuffled.

Defined cases: a null text has size 0; a null source is a source of its own, last
in order; equal keys are ordered by doc_id, then by a hash of the text, and rows
equal in all three fall on the same side of the cut; an empty table gives no rows;
columns of the input come back inside one struct, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerlens.llm.common import WORD, cut

WEIGHTS = (3.0, 1.0, 2.0)
BUCKETS = 1024
#: A table of sources is broadcast up to so many rows (about 100 bytes each); beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.25 to 1.25: more for running prose, less for texts full of marks and digits."""
    text = F.coalesce(text, F.lit(""))
    marks = F.length(F.regexp_replace(text, r"[^!-@\[-`{-~]+", ""))
    return F.lit(1.25) - F.least(F.lit(1.0), F.lit(4.0) * marks / F.greatest(F.length(text), F.lit(1)))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], total_share: float, most: float) -> DataFrame:
    """sizes(source, source_size) -> with target: shares by weight, none above most x its size.

    Sources are capped in order of size over weight; a source is capped exactly if
    the budget left, shared by weight among it and those after it, exceeds its cap.
    One row per source; the window over them holds that many rows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(most))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("_total", F.sum("source_size").over(everything) * F.lit(total_share))
        .withColumn("_spent", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_wleft", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_spent")) / F.col("_wleft"))
        .withColumn("_full", F.col("_cap") <= F.col("_w") * F.col("_level"))
    )
    first_free = F.first(F.when(~F.col("_full"), F.col("_level")), ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return level.withColumn("_lambda", first_free).select("source", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * F.col("_lambda")).alias("target"))


def keyed(docs: DataFrame, seed: int, buckets: int) -> DataFrame:
    """docs(doc_id, text, source, ...) -> row (a struct of all its columns), doc_id, source, tie, key, bucket."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text, doc_id = F.col("row.text"), F.col("row.doc_id")
    return (
        rows.withColumns({"doc_id": doc_id, "source": F.col("row.source"), "tie": F.xxhash64(text, F.lit(seed))})
        .withColumn("u", (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "tie"), 11) + F.lit(0.5)) / F.lit(float(2**53)))
        .withColumn("key", -F.log("u") / quality_weight(text))
        .withColumn("bucket", F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * F.lit(buckets)).cast("int"))
    )


def cuts(base: DataFrame, weights: tuple[float, ...], total_share: float, most: float) -> DataFrame:
    """base(doc_id, source, size, tie, key, bucket) -> a row a source: source, source_size, target, whole, rest, and where what is taken beside whole epochs ends."""
    sums = base.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = (
        source_targets(sizes, weights, total_share, most)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-9))).otherwise(F.lit(0)).cast("int"))
        .withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    )
    targets = cut(targets)
    hint = F.broadcast if targets.count() <= BROADCAST_SOURCES else (lambda df: df)

    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("before", F.coalesce(F.sum("sum").over(by_bucket), F.lit(0)))
    t = targets.select(F.col("source").alias("s"), "rest")
    ends = (
        offsets.join(hint(t), F.col("source").eqNullSafe(F.col("s")))
        .where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("sum") > F.col("rest")) & (F.col("rest") > 0))
        .select("s", F.col("bucket").alias("end_bucket"), "before", "rest")
    )
    rows = base.join(hint(ends), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("end_bucket")))
    within = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_first(), "tie").rowsBetween(Window.unboundedPreceding, -1)
    # a document is taken if at least half of it fits what is left
    taken = rows.withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))).where(F.col("at") + F.col("size") / 2 <= F.col("rest"))
    last = taken.groupBy("source").agg(F.max(_place()).alias("last"))
    out = (
        targets.join(ends.select("s", "end_bucket"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        .join(last.select(F.col("source").alias("s"), "last"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        .withColumnRenamed("source", "cut_source")
    )
    return cut(out)


def _place() -> Column:
    return F.struct("key", F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("i"), "tie")


def _taken(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """rows(doc_id, source, tie, key, bucket, ...) with source_size, target and epochs."""
    hint = F.broadcast if ends.count() <= BROADCAST_SOURCES else (lambda df: df)
    inside = (
        F.when(F.col("rest") <= 0, F.lit(False)).when(F.col("end_bucket").isNull(), F.lit(True))
        .when(F.col("bucket") != F.col("end_bucket"), F.col("bucket") < F.col("end_bucket")).otherwise(F.coalesce(_place() <= F.col("last"), F.lit(False)))
    )
    return rows.join(hint(ends), F.col("source").eqNullSafe(F.col("cut_source"))).withColumn("epochs", (F.col("whole") + inside.cast("int")).cast("int"))


def _base(docs: DataFrame, seed: int, buckets: int) -> DataFrame:
    rows = keyed(docs.select("doc_id", "text", "source"), seed, buckets).withColumn("size", word_count(F.col("row.text")))
    return cut(rows.select("doc_id", "source", "size", "tie", "key", "bucket"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = 1.5, most: float = 2.0, seed: int = 17, buckets: int = BUCKETS) -> DataFrame:
    """docs(doc_id, text, source, ...) -> row (a struct of all its columns), source_size, target, epochs (times taken)."""
    ends = cuts(_base(docs, seed, buckets), weights, total_share, most)
    return _taken(keyed(docs, seed, buckets), ends).select("row", "source_size", "target", "epochs")


def shares(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = 1.5, most: float = 2.0, seed: int = 17, buckets: int = BUCKETS) -> DataFrame:
    """mix() without the texts, which are read once: doc_id, source, size, source_size, target, epochs."""
    base = _base(docs, seed, buckets)
    return _taken(base, cuts(base, weights, total_share, most)).select("doc_id", "source", "size", "source_size", "target", "epochs")


def op10_mix_sources(spark, sf_dir):
    """Every document with its size, its source's size and target, and the words taken from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shares(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken"))
