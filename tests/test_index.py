"""The stored index: batches against a rebuild, block search against a join, versions."""

import random
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from answerlens.operators import blocks, index, retrieve
from answerlens.session import arrow_rows

WORDS = [f"w{i}" for i in range(60)]


def corpus(spark, n, seed, bases=("a", "b", None), first=0):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(rng.choice(bases), first + i, None if rng.random() < 0.05 else " ".join(rng.choices(WORDS, weights, k=rng.randint(0, 40)))) for i in range(n)]
    return spark.createDataFrame(rows, "kb_id string, chunk_id long, text string")


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


@pytest.fixture()
def small_shards(monkeypatch):
    monkeypatch.setattr(index, "SHARD_CHUNKS", 16)


def plain(queries, chunks):
    """Scores of all chunks, from the definition."""
    import math
    import re
    from collections import Counter

    texts = {(r["kb_id"], r["chunk_id"]): Counter(re.findall(r"\w+", (r["text"] or "").lower())) for r in chunks.collect()}
    out = []
    for q in queries.collect():
        mine = {c: t for (kb, c), t in texts.items() if kb == q["kb_id"]}
        if not mine:
            continue
        df = Counter(t for x in mine.values() for t in x)
        raw = {t: math.log(len(mine) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
        floor = 0.25 * sum(raw.values()) / len(raw)
        mean = sum(x.total() for x in mine.values()) / len(mine)
        for c, x in mine.items():
            s = sum(k * (floor if raw[t] < 0 else raw[t]) * x[t] * 2.5 / (x[t] + 1.5 * (0.25 + 0.75 * x.total() / mean)) for t, k in Counter(q["query"].split()).items() if x[t])
            if round(s, 6) > 0:
                out.append((q["query_id"], c, round(s, 6)))
    return out


def test_block_search_equals_the_definition(spark, small_shards):
    c = corpus(spark, 300, 1)
    q = spark.createDataFrame([(i, kb, " ".join(random.Random(i).choices(WORDS, k=6))) for i, kb in enumerate(["a", "b", None, "a", "b", None, "zz"])], "query_id long, kb_id string, query string")
    want = {}
    for query, chunk, score in plain(q, c):
        want.setdefault(query, []).append((-score, chunk))
    got = {}
    for r in retrieve.bm25(q, index.build_index(c), 5).collect():
        got.setdefault(r["query_id"], []).append((-r["bm25_score"], r["chunk_id"]))
    assert set(got) == set(want)
    for query, found in got.items():
        best = sorted(want[query])[:5]
        assert [x[0] for x in sorted(found)] == pytest.approx([x[0] for x in best], abs=2e-6)
        assert all(abs(dict((c, s) for s, c in want[query])[c] - s) < 2e-6 for s, c in found)


def test_scores_with_negative_frequencies_equal_the_definition(spark, small_shards):
    """Where most terms are in most chunks, their mean inverse frequency is negative, and so is the floor."""
    rng = random.Random(8)
    rows_ = [("k", i, " ".join(["a", "b", "c"] * rng.randint(1, 3) + ["d"] * rng.randint(0, 1) + [f"u{i}"] * (i % 20 == 0) * rng.randint(1, 4))) for i in range(100)]
    c = spark.createDataFrame(rows_, "kb_id string, chunk_id long, text string").coalesce(1)
    q = spark.createDataFrame([(1, "k", "a b u0 u20 u40"), (2, "k", "a d"), (3, "k", "u60 a a a u80 u0 u20")], "query_id long, kb_id string, query string")
    want = {}
    for query, chunk, score in plain(q, c):
        want.setdefault(query, []).append((-score, chunk))
    got = {}
    for r in retrieve.bm25(q, index.build_index(c), 2).collect():
        got.setdefault(r["query_id"], []).append((-r["bm25_score"], r["chunk_id"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: [(pytest.approx(s, abs=2e-6), c) for s, c in sorted(v)[:2]] for k, v in want.items()}


def test_most_postings_of_frequent_terms_stay_unread(spark, tmp_path):
    """One rare term decides; the frequent ones are looked up for the chunks that it brings up."""
    rows_ = [(f"the of and {'rare ' * 3 if i < 5 else ''}{'x ' * (i % 7)}",) for i in range(4000)]
    c = spark.createDataFrame(rows_, "text string").coalesce(1).select(F.lit("k").alias("kb_id"), F.monotonically_increasing_id().alias("chunk_id"), "text")
    ix = index.build_index(c)
    terms = spark.createDataFrame([(1, "k", t, 1.0) for t in ("the", "of", "and", "rare")], "query_id long, kb_id string, term string, qtf double")
    weighed = terms.join(ix.terms, ["kb_id", "term"]).withColumn("weight", F.when(F.col("term") == "rare", 6.0).otherwise(0.2))
    table = pa.Table.from_pandas(ix.blocks.orderBy("shard", F.col("term").asc_nulls_first()).toPandas(), preserve_index=False)
    asked = set("the of and rare".split())
    shard = [table.slice(0, 1).to_batches()[0], table.filter(pa.array([t in asked for t in table["term"].to_pylist()])).combine_chunks().to_batches()[0]]
    shard = [b.set_column(b.schema.get_field_index("chunk_ids"), "chunk_ids", b["chunk_ids"]) for b in shard]
    block = blocks.QueryBlock(weighed.collect(), 5)
    best, read = block.start(), [0, 0]
    first = block.best_of(shard, best, read)
    assert len(first[0][1]) == 5 and read[0] == read[1] > 12_000
    read = [0, 0]
    block.best_of(shard, best, read)  # now the k-th score is known
    assert read[0] < read[1] / 100


def test_three_batches_equal_one_rebuild(spark, tmp_path, small_shards):
    parts = [corpus(spark, 80, s, first=1000 * s) for s in (1, 2, 3)]
    store = index.Store(spark, str(tmp_path / "i"))
    for number, part in enumerate(parts):
        store.append(part, number)
    whole = index.build_index(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert rows(store.index().corpus) == rows(whole.corpus)
    assert rows(store.index().terms) == rows(whole.terms)
    assert rows(store.index().postings) == rows(whole.postings)
    q = spark.createDataFrame([(1, "a", "w3 w7 w20"), (2, None, "w0 w30")], "query_id long, kb_id string, query string")
    assert rows(retrieve.bm25(q, store.index())) == rows(retrieve.bm25(q, whole))


def test_a_batch_written_again_takes_its_own_place_also_after_a_sum(spark, tmp_path):
    a, b, c = (corpus(spark, 30, s, first=100 * s) for s in (1, 2, 3))
    store = index.Store(spark, str(tmp_path / "i"))
    store.append(a, 0)
    store.append(b, 1)
    store.append(a, 0)
    want = index.build_index(a.unionByName(b))
    assert rows(store.index().terms) == rows(want.terms)
    store.compact()
    assert len(store._now()[2]) == 1 and rows(store.index().terms) == rows(want.terms)
    store.append(c, 1)
    assert rows(store.index().terms) == rows(index.build_index(a.unionByName(c)).terms)
    assert rows(store.index().corpus) == rows(index.build_index(a.unionByName(c)).corpus)


def test_many_batches_are_summed_and_an_old_version_stays_readable(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "MOST_DELTAS", 2)
    store = index.Store(spark, str(tmp_path / "i"))
    store.append(corpus(spark, 10, 0), 0)
    old = store.index()
    before = rows(old.terms)
    for s in (1, 2, 3):
        store.append(corpus(spark, 10, s, first=100 * s), s)
    assert len(store._now()[2]) <= 2
    assert rows(old.terms) == before
    broken = corpus(spark, 10, 9).withColumn("text", F.raise_error(F.lit("no")).cast("string"))
    now = rows(store.index().terms)
    with pytest.raises(Exception, match="no"):
        store.append(broken, 4)
    assert rows(store.index().terms) == now


def test_empty_and_odd_chunks(spark):
    none = spark.createDataFrame([], "kb_id string, chunk_id long, text string")
    q = spark.createDataFrame([(1, "k", "a b")], "query_id long, kb_id string, query string")
    assert retrieve.bm25(q, index.build_index(none)).count() == 0
    odd = spark.createDataFrame([("k", 1, ""), ("k", None, "a a"), ("k", 2, "a " * 3000), ("k", 2, "b"), ("k", 4, None), ("k", 5, " "), (None, 3, "a b")], none.schema)
    ix = index.build_index(odd)
    assert {(r["kb_id"], r["n"]) for r in ix.corpus.collect()} == {("k", 6), (None, 1)}
    assert {r["chunk_id"] for r in retrieve.bm25(q, ix).collect()} == {None, 2}


def test_queries_in_several_passes_give_the_same(spark, monkeypatch, small_shards):
    c = corpus(spark, 100, 4)
    q = spark.createDataFrame([(i, "a", f"w{i} w{i + 1} w2") for i in range(20)], "query_id long, kb_id string, query string")
    ix = index.build_index(c)
    one = rows(retrieve.bm25(q, ix))
    monkeypatch.setattr(retrieve, "PASS_TERMS", 15)
    assert rows(retrieve.bm25(q, ix)) == one


def test_corpus_needs_no_postings(spark, small_shards):
    c = corpus(spark, 100, 6)
    assert rows(index.corpus_of(c)) == rows(index.build_index(c).corpus.withColumn("n", F.col("n").cast("long")))


def test_blocks_are_made_without_a_shuffle(spark):
    split = corpus(spark, 20, 7).select("kb_id", "chunk_id", index.tokens(F.col("text")).alias("t"))
    assert "Exchange" not in index.term_blocks(split, 0)._jdf.queryExecution().executedPlan().toString()


def test_sums_are_summed_by_level(spark, tmp_path, monkeypatch):
    """A sum is read again only with sums of its own level."""
    monkeypatch.setattr(index, "MOST_DELTAS", 1)
    store = index.Store(spark, str(tmp_path / "i"))
    levels = []
    for s in range(4):
        store.append(corpus(spark, 10, s, first=100 * s), s)
        levels.append(sorted(map(index._level, store._now()[2])))
    assert levels == [[0], [1], [0, 1], [2]]
    assert sum(r["n"] for r in store.index().corpus.collect()) == 40


SPLIT = pa.schema([("kb_id", pa.string()), ("chunk_id", pa.int64()), ("t", pa.list_(pa.string()))])


def test_few_chunks_at_a_time_go_to_the_tasks_of_an_index(spark, tmp_path, monkeypatch):
    """Two batches are held in Python, and their tokens are large."""
    monkeypatch.setattr(index, "BATCH_CHUNKS", 16)

    @F.pandas_udf("array<string>")
    def words(text: pd.Series) -> pd.Series:
        if len(text) > 16:
            raise ValueError(f"a batch of {len(text)}")
        return text.fillna("").str.split()

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, c = spark.conf.get(key), corpus(spark, 200, 9).coalesce(1)
    assert sum(r["n"] for r in index.build_index(c, words, str(tmp_path / "i")).corpus.collect()) == 200
    assert spark.conf.get(key) == before
    with arrow_rows(spark, 7), arrow_rows(spark, 50):
        sizes = spark.range(0, 20, 1, 1).mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n long").collect()
    assert [r["n"] for r in sizes] == [7, 7, 6]
    with pytest.raises(ZeroDivisionError), arrow_rows(spark, 7):
        raise ZeroDivisionError
    assert spark.conf.get(key) == before


def test_a_shard_keeps_numbers_and_no_batch():
    batch = pa.RecordBatch.from_pylist([{"kb_id": "k", "chunk_id": i, "t": [f"a_rather_long_word_{j % 50}" for j in range(400)]} for i in range(500)], SPLIT)
    before, size = pa.total_allocated_bytes(), batch.nbytes
    held = index._Held()
    held.take(batch.slice(0, 400))
    del batch
    kept = sum(x.nbytes for part in (held.kbs, held.ids, held.lengths, held.terms, held.rows, held.tfs) for x in part)
    assert held.n == 400 and held.tokens == 160_000 and kept < size / 10
    assert pa.total_allocated_bytes() - before < 0  # the batch is gone


def test_a_shard_of_small_pieces_and_parts_equals_counts(monkeypatch):
    """A chunk longer than a piece, chunks without tokens, bases that are null, lists cut between parts."""
    monkeypatch.setattr(index, "PIECE_TOKENS", 30)
    monkeypatch.setattr(index, "PART_ROWS", 7)
    rng = random.Random(3)
    chunks = [{"kb_id": rng.choice(["a", "b", None]), "chunk_id": i if i % 9 else None, "t": rng.choices(WORDS[:20], k=rng.choice([0, 3, 12, 80]))} for i in range(60)]
    held = index._Held()
    for i in range(0, 60, 25):
        held.take(pa.RecordBatch.from_pylist(chunks[i : i + 25], SPLIT))
    kinds = [("kb_id", pa.string()), ("shard", pa.int64()), ("term", pa.string()), ("n", pa.int32()), ("peak", pa.float64()), ("mean", pa.float64()), ("places", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("chunk_ids", pa.list_(pa.int64())), ("dls", pa.list_(pa.int32()))]
    parts = list(held.shard(5, pa.schema(kinds)))
    assert len(parts) > 3 and max(p.num_rows for p in parts) <= 7 and held.n == 0
    got = pa.Table.from_batches(parts).to_pylist()
    for kb in ("a", "b", None):
        mine = [c for c in chunks if c["kb_id"] == kb]
        head, *terms = [r for r in got if r["kb_id"] == kb]
        assert head["term"] is None and head["n"] == len(mine) and head["chunk_ids"] == [c["chunk_id"] for c in mine] and head["dls"] == [len(c["t"]) for c in mine]
        mean = sum(head["dls"]) / len(mine)
        counts = [Counter(c["t"]) for c in mine]
        assert sorted(r["term"] for r in terms) == sorted(set().union(*counts))
        for r in terms:
            want = [(i, c[r["term"]]) for i, c in enumerate(counts) if c[r["term"]]]
            assert list(zip(r["places"], r["tfs"], strict=True)) == want and r["n"] == len(want) and r["shard"] == 5 and r["chunk_ids"] == r["dls"] == []
            assert r["mean"] == pytest.approx(mean) and r["peak"] == pytest.approx(max(tf / (tf + 1.5 * (0.25 + 0.75 * head["dls"][i] / mean)) for i, tf in want))
