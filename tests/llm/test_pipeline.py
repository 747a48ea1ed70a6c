"""The corpus pipeline as a whole, against what its stages promise."""

import random
import re

import brute
import pytest
from test_operators import prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rng = random.Random(12)
    texts = [(prose(rng, rng.randint(40, 160)), "en", "ab"[i % 2]) for i in range(60)]
    long = prose(rng, 200)
    texts += [(long, "en", "a"), (long.replace(" ", "\n"), None, "a"), (long + " tail", "en", "b"), (None, "en", "a"), ("", None, "b"), ("123 ...", "en", None), (long + " more", "en", None)]
    rows = [(i, t, lang, s, 0, "x", 1.5) for i, (t, lang, s) in enumerate(texts)] + [(0, texts[0][0], "en", "a", 0, "x", 1.5)]
    folder = tmp_path_factory.mktemp("tables")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, rejected string, key double")
    df.write.parquet(f"{folder}/documents.parquet")
    df.limit(0).write.parquet(f"{folder}/empty/documents.parquet")
    return str(folder), rows


def test_stages_do_what_they_say(spark, table):
    folder, rows = table
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    known = corpus_pipeline.known_language(spark, docs, folder)
    assert known.columns == docs.columns
    lettered = [r for r in rows if re.search("[A-Za-z]", r[1] or "")]
    assert sorted(r["doc_id"] for r in known.collect()) == sorted(r[0] for r in lettered)
    single = corpus_pipeline.without_copies(spark, known, folder)
    assert single.columns == docs.columns
    groups = {}
    for r in lettered:
        groups.setdefault(re.sub(brute.WS, "", r[1]), []).append((-len(r[1]), r[0]))
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(min(g)[1] for g in groups.values())
    left = [(r["doc_id"], r["text"]) for r in single.collect()]
    apart = corpus_pipeline.without_near_copies(spark, single, folder)
    assert apart.columns == docs.columns
    want = brute.jaccard_components(left)
    assert sorted(r["doc_id"] for r in apart.collect()) == sorted(d for d, (_, c) in want.items() if c == d)
    assert len(want) > len({c for _, c in want.values()})  # near copies were there


def test_run_encodes_what_the_stages_leave(spark, table):
    from tokenizers import Tokenizer

    from answerlens.llm import bpe_automaton

    folder, rows = table
    lib = Tokenizer.from_file(bpe_automaton.word_vocabulary())
    text = {r[0]: r[1] for r in rows}
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and max(sum(r["doc_id"] == x["doc_id"] for x in out) for r in out) <= 2
    for r in out:
        ids = lib.encode(text[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)


def test_empty_table(spark, table):
    assert corpus_pipeline.run(spark, f"{table[0]}/empty").count() == 0


def test_near_copies_go_also_where_an_id_has_several_texts(spark, table):
    rng = random.Random(5)
    one, other = prose(rng, 100), prose(rng, 100)
    rows = [(1, one), (2, one + " tail"), (2, other), (3, other + " end"), (None, one + " last"), (4, prose(rng, 50)), (5, ""), (6, None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, key double")
    left = corpus_pipeline.without_near_copies(spark, df, table[0])
    assert left.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(1, one), (2, other), (4, rows[5][1]), (5, ""), (6, None)], key=str)
