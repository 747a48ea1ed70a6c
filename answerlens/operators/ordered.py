"""Places in an order, and windows over it, for groups of any size.

A window function orders each group in one task.  Here rows are sorted by range, so a
large group spreads over many tasks, and get their place in the group from the sizes of
the stretches before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerlens.session import kept

#: Stretches (a task's rows of one group) are broadcast up to so many.
BROADCAST_STRETCHES = 100_000
#: Rows of a group that one window of ``in_blocks`` covers beside those it looks back on.
BLOCK = 8192


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with pos, the place in its group from 0, and n, the group's rows; equal rows in any order."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(tasks, *by, *order, F.monotonically_increasing_id()).sortWithinPartitions(*by, *order)
    ranged = kept(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33)))
    key = F.struct(*by)
    sizes = ranged.groupBy(key.alias("_key"), "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy("_key").orderBy("_task")) - F.col("_size")
    sizes = kept(sizes.select("_key", F.col("_task").alias("_of"), (before - F.col("_first")).alias("_shift"), F.sum("_size").over(Window.partitionBy("_key")).alias("n")))
    if sizes.count() <= BROADCAST_STRETCHES:
        sizes = F.broadcast(sizes)
    joined = ranged.withColumn("_mine", key).join(sizes, (F.col("_task") == F.col("_of")) & (F.col("_mine") == F.col("_key")))
    return joined.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n")


def in_blocks(rows: DataFrame, by: list[str], order: list[str], back: int, what: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """rows with the aggregates ``what`` over each row and the ``back`` rows before it in its group.

    Groups are cut into blocks; the last rows of a block are copied to the next one,
    where others look back on them.
    """
    block = max(block, back)
    own = F.expr(f"pos div {block}")
    copied = F.when(F.col("pos") % block >= block - back, F.struct((own + 1).alias("_block"), F.lit(True).alias("_copy")))
    each = numbered(rows, by, order).withColumn("_in", F.explode(F.array_compact(F.array(F.struct(own.alias("_block"), F.lit(False).alias("_copy")), copied))))
    w = Window.partitionBy(*by, "_in._block").orderBy("pos").rowsBetween(-back, 0)
    return each.withColumns({name: c.over(w) for name, c in what.items()}).where("NOT _in._copy").drop("_in", "pos", "n")


def lower_before(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """rows with lower and seen: how many values up to the row are lower than its own, and how many there are (nulls are none).

    Counted by merging: stretches of 1, 2, 4, ... rows are put together with the next
    one, and each row of the right half counts what is lower in the left half.  A row is
    in one pair of halves a round, so nothing that grows is kept for it.
    """
    placed = kept(numbered(rows, [by], [order]))
    longest = placed.agg(F.max("n")).first()[0] or 0
    seen = F.count(value).over(Window.partitionBy(by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    out, lower = placed.withColumn("seen", seen), F.lit(0).cast("long")
    for k in range(max(longest - 1, 0).bit_length()):
        left = F.expr(f"(pos div {1 << k}) % 2 = 0")
        halves = Window.partitionBy(by, F.expr(f"pos div {2 << k}")).orderBy(value, left).rowsBetween(Window.unboundedPreceding, 0)
        smaller = F.count_if(left & F.col(value).isNotNull()).over(halves)
        out = out.withColumn(f"_lower{k}", F.when(left, 0).otherwise(smaller))
        lower = lower + F.col(f"_lower{k}")
    return out.withColumn("lower", F.when(F.col(value).isNotNull(), lower)).select(*rows.columns, "lower", "seen")
