"""Stored bases: what a change touches, counts, versions."""

import pytest
from pyspark.sql import functions as F

from answerlens.operators import retrieve
from answerlens.operators.bases import Bases

CHUNKS = "kb_id string, file_id string, chunk_id long, text string, vec array<double>"


def chunks(spark, *rows):
    return spark.createDataFrame([(*r, [float(r[2]), 1.0]) for r in rows], CHUNKS)


def held(bases, version=None):
    return sorted((r["kb_id"], r["file_id"], r["chunk_id"]) for r in bases.table("chunks", version).collect())


def test_files_are_replaced_and_counted_and_the_index_goes_along(spark, tmp_path):
    bases = Bases(spark, str(tmp_path / "b"))
    assert bases.replace(chunks(spark, ("a", "f", 1, "red wine"), ("a", "f", 2, "red"), ("a", "g", 3, "blue"), ("b", "f", 4, "red"))).agg(F.sum("deleted")).first()[0] == 0
    counts = bases.replace(chunks(spark, ("a", "f", 5, "green wine"), ("c", "h", 6, "red")))
    assert {(r["kb_id"], r["file_id"], r["deleted"]) for r in counts.collect()} == {("a", "f", 2), ("c", "h", 0)}
    assert held(bases) == [("a", "f", 5), ("a", "g", 3), ("b", "f", 4), ("c", "h", 6)]
    assert held(bases, 1) == [("a", "f", 1), ("a", "f", 2), ("a", "g", 3), ("b", "f", 4)]
    assert {r["chunk_id"] for r in bases.index().postings.collect()} == {3, 4, 5, 6}
    assert {(r["kb_id"], r["n"]) for r in bases.index().corpus.collect()} == {("a", 2), ("b", 1), ("c", 1)}
    assert sorted(r["vec"][0] for r in bases.table("chunks").collect()) == [3.0, 4.0, 5.0, 6.0]
    queries = spark.createDataFrame([(1, "a", "green")], "query_id long, kb_id string, query string")
    assert retrieve.bm25(queries, bases.index(), None).count() == retrieve.bm25(queries, bases.index()).count()


def test_only_touched_bases_are_written(spark, tmp_path):
    bases = Bases(spark, str(tmp_path / "b"))
    bases.replace(chunks(spark, ("a", "f", 1, "x"), ("b", "f", 2, "y")))
    before = {r["kb_id"]: r["change"] for r in bases.manifest().collect()}
    bases.replace(chunks(spark, ("a", "g", 3, "z")))
    after = {r["kb_id"]: r["change"] for r in bases.manifest().collect()}
    assert after["b"] == before["b"] and after["a"] != before["a"]
    assert {r["kb_id"] for r in spark.read.parquet(f"{tmp_path}/b/chunks/change={after['a']}").collect()} == {"a"}


def test_a_change_that_fails_leaves_the_version_before(spark, tmp_path):
    bases = Bases(spark, str(tmp_path / "b"))
    bases.replace(chunks(spark, ("a", "f", 1, "x")))
    broken = Bases(spark, str(tmp_path / "b"), lambda text: F.raise_error(F.lit("no")).cast("array<string>"))
    with pytest.raises(Exception, match="no"):
        broken.replace(chunks(spark, ("a", "f", 2, "y")))
    assert held(bases) == [("a", "f", 1)] and bases.version() == 1


def test_bases_are_created_and_dropped(spark, tmp_path):
    bases = Bases(spark, str(tmp_path / "b"))
    names = lambda *x: spark.createDataFrame([(i,) for i in x], "kb_id string")
    assert bases.table("chunks") is None
    bases.create(names("a", "b"))
    assert bases.create(names("b", "c")).collect()[0]["kb_id"] == "c"
    bases.replace(chunks(spark, ("a", "f", 1, "x"), ("d", "f", 2, "x")))
    assert {tuple(r) for r in bases.drop(names("a", "b", "zz")).collect()} == {("a", 1), ("b", 0)}
    assert {r["kb_id"] for r in bases.manifest().collect()} == {"c", "d"} and held(bases) == [("d", "f", 2)]
    assert {r["kb_id"] for r in bases.index().corpus.collect()} == {"d"}
