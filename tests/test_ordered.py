"""Places, windows in blocks and counts by merging, against plain loops."""

import random
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F

from answerlens.operators import history, ordered


def some(spark, n=500, seed=1, groups=("hot", "hot", "hot", "b", None)):
    rng = random.Random(seed)
    rows = [(rng.choice(groups), i, rng.choice([None, round(rng.random(), 1), round(rng.random(), 1)])) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g string, i long, v double").repartition(3), rows


def by_group(rows):
    out = {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        out.setdefault(g, []).append((i, v))
    return out


def test_numbered_gives_places_in_every_group(spark, monkeypatch):
    df, rows = some(spark)
    for bound in (ordered.BROADCAST_STRETCHES, 0):
        monkeypatch.setattr(ordered, "BROADCAST_STRETCHES", bound)
        got = {(r["g"], r["i"]): (r["pos"], r["n"]) for r in ordered.numbered(df, ["g"], ["i"]).collect()}
        want = {(g, i): (k, len(x)) for g, x in by_group(rows).items() for k, (i, _) in enumerate(x)}
        assert got == {k: v for k, v in want.items() if k[0] is not None} | {k: v for k, v in got.items() if k[0] is None}
        assert {k: v for k, v in got.items() if k[0] is None} == {k: v for k, v in want.items() if k[0] is None}


@pytest.mark.parametrize(("back", "block"), [(0, 10), (7, 10), (10, 10), (30, 10), (1000, 10)])
def test_windows_in_blocks_equal_one_window(spark, back, block):
    df, rows = some(spark, 200)
    got = {(r["g"], r["i"]): r["s"] for r in ordered.in_blocks(df, ["g"], ["i"], back, {"s": F.sum("v")}, block).collect()}
    for g, x in by_group(rows).items():
        for k, (i, _) in enumerate(x):
            values = [v for _, v in x[max(0, k - back) : k + 1] if v is not None]
            assert got[(g, i)] == (pytest.approx(sum(values)) if values else None)


def test_lower_values_are_counted_with_ties_and_nulls(spark):
    df, rows = some(spark, 300, 2)
    got = {(r["g"], r["i"]): (r["lower"], r["seen"]) for r in ordered.lower_before(df, "g", "i", "v").collect()}
    assert len(got) == 300
    for g, x in by_group(rows).items():
        values = []
        for i, v in x:
            if v is not None:
                values.insert(bisect_left(values, v), v)
            assert got[(g, i)] == (None if v is None else bisect_left(values, v), len(values))


def test_a_hot_group_is_no_single_task(spark):
    calls = spark.range(40_000).select(F.lit("/all").alias("endpoint"), F.col("id").alias("event_id"), F.col("id").alias("ts"), F.lit(1.0).alias("duration"))
    plan = ordered.in_blocks(calls, ["endpoint"], ["ts"], 999, {"m": F.avg("duration")}, 8192)
    assert plan.groupBy(F.expr("ts div 8192")).count().count() == 5
    ranged = ordered.numbered(calls, ["endpoint"], ["ts"]).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert max(r["count"] for r in ranged) < 20_000


def test_empty_tables(spark):
    none = spark.createDataFrame([], "g string, i long, v double")
    assert ordered.numbered(none, ["g"], ["i"]).count() == ordered.lower_before(none, "g", "i", "v").count() == ordered.in_blocks(none, ["g"], ["i"], 3, {"s": F.sum("v")}).count() == 0


def test_pages_and_lookup(spark, tmp_path):
    chunks = spark.range(1050).select((F.col("id") % 2).cast("string").alias("kb_id"), F.col("id").alias("chunk_id"))
    got = {(r["kb_id"], r["page"]): r["n"] for r in history.pages(chunks, 100).groupBy("kb_id", "page").agg(F.count("*").alias("n")).collect()}
    assert got == {(b, p): 100 if p < 5 else 25 for b in "01" for p in range(6)}
    history.store_for_lookup(chunks, str(tmp_path / "s"))
    assert [tuple(r) for r in history.lookup(spark, str(tmp_path / "s"), [7, 5000]).collect()] == [("1", 7)]
