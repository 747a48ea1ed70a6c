"""Phrases, spherical-cap links and Merkle proofs against brute force, and their odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from answerlens.llm import caps, merkle, phrases

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def some_docs(n=60, seed=1):
    rng = random.Random(seed)
    words = ["New", "York", "red", "Wine", "of", "the", "näive", "中文", "x-y", "a"]
    out = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\v", ": "]) for _ in range(rng.randint(0, 120)))
        out.append((i, rng.choice([text, text, text, None, ""]), rng.choice(["en", "de", None, "und"]), rng.choice(["s1", "s2", "ß", None]), len(text)))
    return [*out, (3, "new york " * 3000, "en", "s1", 5), (4, "New York", "en", None, None), (4, "New York", "en", None, None)]


def clashing(df):
    """With columns named like those that the operators make."""
    extra = ["block", "part", "kind", "keys", "totals", "payload", "node", "hash", "tree", "pos", "n", "up", "slot", "run", "rank", "key", "phrase", "a", "l", "r", "score", "label_", "weight", "dim", "first_id", "component"]
    return df.withColumns({c: F.lit(1) for c in extra if c not in df.columns})


# phrases


def brute_phrases(rows, max_words, least, covered):
    counts, sizes = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for n in range(1, max_words + 1):
                for i in range(len(words) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + n])] += 1
    out = {}
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in cand.items():
            longer = [q for q in cand if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * f[q] >= covered * a for q in longer):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            out[(lang, " ".join(p))] = (a, f[p[:k]], f[p[k:]], score)
    return out, dict(sizes)


@pytest.mark.parametrize(("max_words", "least"), [(3, 10), (2, 3), (4, 5)])
def test_phrases_equal_brute_force(spark, monkeypatch, max_words, least):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 2000)
    rows = [(r[1], r[2]) for r in some_docs()]
    df = clashing(spark.createDataFrame(some_docs(), DOCS).repartition(3))
    found, sizes = phrases.mine(df, max_words, least)
    got = {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["score"]) for r in phrases.scored(found).collect()}
    want, n = brute_phrases(rows, max_words, least, 50)
    assert got == want and got
    assert {r["lang"]: r["n"] for r in sizes.collect()} == {k: v for k, v in n.items() if v}


def test_the_first_phrases_are_ranked_with_ties_by_bytes(spark):
    rows = [(f"{a} {b}. " * 12, lang) for lang in ("en", None) for a, b in (("b", "c"), ("ä", "z"), ("a", "z2"), ("Z", "y"))]
    found, _ = phrases.mine(spark.createDataFrame(rows, "text string, lang string"))
    got = sorted((r["lang"], r["rank"], r["phrase"]) for r in phrases.best(phrases.scored(found), 3).collect())
    assert got == [(lang, i, p) for lang in ("en", "und") for i, p in enumerate(["a z2", "b c", "z y"], 1)]


def test_a_word_like_its_language_is_a_word_of_its_own(spark):
    found, _ = phrases.mine(spark.createDataFrame([("en x. es x. " * 10, "en"), ("es y. en y. " * 10, "es")], "text string, lang string"))
    assert {(r["lang"], r["phrase"], r["l"], r["r"]) for r in phrases.scored(found).collect()} == {(a, f"{b} {c}", 10, 20) for a, c in (("en", "x"), ("es", "y")) for b in ("en", "es")}


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_007, 4_000_000_000_123, 5_000_000_000_777
    df = spark.createDataFrame([("en", "p q", a, [(1, left, right)], 1)], "lang string, phrase string, a long, cuts array<struct<k:int,l:long,r:long>>, key long")
    assert phrases.scored(df).first()["score"] == 1_000_000 * a * a // (left * right)


def test_index_extends_both_ways_alike():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(0, 5, 400), 0)
    index = phrases.PhraseIndex(text, 4)
    level = index.words()
    for n in range(2, 5):
        level = index.longer(level)
        want = Counter(tuple(text[i : i + n]) for i in range(len(text) - n + 1) if (text[i : i + n] > 0).all())
        got = {tuple(text[index.order[s] : index.order[s] + n]): c for s, c in zip(level.start, level.size, strict=True)}
        assert got == dict(want)


def test_phrases_of_an_empty_table(spark):
    found, sizes = phrases.mine(spark.createDataFrame([], DOCS))
    assert phrases.best(phrases.scored(found)).count() == 0 and sizes.count() == 0


# spherical caps


def brute_links(rows, threshold=0.93):
    n = len(rows)
    ok = [lab is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    linked = np.zeros((n, n), dtype=bool)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                linked[i, j] = linked[j, i] = a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= threshold
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in np.flatnonzero(linked[i]):
                label[i] = label[j] = min(label[i], label[j])
    ids = {}
    for i in range(n):
        known = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        ids[i] = min(known) if known else None
    return sorted(((rows[i][0], int(linked[i].sum()), ids[i], rows[i][0] == ids[i]) for i in range(n)), key=str)


def odd_vectors(seed=2, n=60, dim=16):
    rng = np.random.default_rng(seed)
    rows, base = [], rng.standard_normal((6, dim))
    for i in range(n):
        v = base[i % 6] + rng.standard_normal(dim) * 0.12 * (i % 4)
        rows.append((i + 10, [float(x) for x in v], int(i % 6) if i % 5 else 0))
    v = rows[0][1]
    rows += [(200, v, 0), (201, v, 0), (202, [2 * x for x in v], 0), (200, v, 0), (203, v, None), (204, None, 0), (205, [], 0), (206, [0.0] * dim, 0), (207, [float("nan"), *v[1:]], 0), (208, [float("inf"), *v[1:]], 0), (209, [None, *v[1:]], 0), (210, v[:-1], 0), (211, v[:-1], 0), (None, v, 0), (5, [1e-30 * x for x in v], 0)]
    return rows


def links(spark, rows, **more):
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3))
    return sorted((tuple(r) for r in caps.link(df, **more).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def test_links_equal_brute_force(spark):
    assert links(spark, odd_vectors()) == brute_links(odd_vectors())


def test_large_buckets_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(caps, "CELL", 8)
    rows = odd_vectors(4, 120)
    assert links(spark, rows) == brute_links(rows)
    monkeypatch.setattr(caps, "BROADCAST_BUCKETS", 0)
    assert links(spark, rows) == brute_links(rows)


def test_vectors_of_few_dimensions_and_an_empty_table(spark):
    rng = np.random.default_rng(1)
    for dim in (1, 3):
        rows = [(i, [float(x) for x in rng.standard_normal(dim)], 1) for i in range(25)]
        assert links(spark, rows) == brute_links(rows)
    assert links(spark, []) == []


def test_filters_find_pairs_at_the_threshold_and_decode_all_directions():
    plan = caps.make_plan(64, 2000)
    assert list(caps.met(plan, 0.93))[-1] >= caps.RECALL
    small = caps.Plan(12, 2, 5, 3, 0.35)
    rng = np.random.default_rng(0)
    unit = rng.standard_normal((40, 12))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    rows, found = caps.decode(unit, small)
    want = set()
    for k in range(2):
        rotation, lists = caps._code(12, 5, 3, k)
        turned = unit @ rotation
        for w in range(125):
            direction = np.concatenate([lists[0][w // 25], lists[1][w // 5 % 5], lists[2][w % 5]])
            want |= {(int(i), k * 125 + w) for i in np.flatnonzero(turned @ direction >= 0.35)}
    assert set(zip(rows.tolist(), found.tolist(), strict=True)) == want


def test_no_pair_below_the_threshold_at_its_edge(spark):
    """Vectors whose cosine is the threshold up to rounding."""
    t = 0.93
    rows = [(1, [1.0, 0.0], 1)] + [(i + 2, [t + d, math.sqrt(1 - (t + d) ** 2)], 1) for i, d in enumerate((0.0, 1e-9, -1e-9, 1e-6, -1e-6))]
    got = {r[0]: r[1] for r in links(spark, rows)}
    assert got[3] >= 1 and got[1] in (2, 3)  # the one on the edge may go either way


# Merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """Levels of a tree, the lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def brute_merkle(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    ordered = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for s in sources}
    trees = {s: climb([leaf(*r) for r in ordered[s]]) for s in sources}
    top = climb([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(ordered[s]):
            number = "" if r[0] is None else str(r[0])
            text = r[1]
            if zlib.crc32(number.encode()) % 5 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
            folded, proof = leaf(r[0], text, *r[2:]), ""
            for levels, place in ((trees[s], i), (top, k)):
                for level in levels[:-1]:
                    run = level[place // 16 * 16 : place // 16 * 16 + 16]
                    before, after = run[: place % 16], run[place % 16 + 1 :]
                    proof += "".join(before + after)
                    folded = h(*before, folded, *after)
                    place //= 16
            out.append((r[0], leaf(*r), trees[s][-1][0], top[-1][0], h(proof), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def proofs(spark, tmp_path, rows):
    folder = str(tmp_path / "in")
    clashing(spark.createDataFrame(rows, DOCS).repartition(3)).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return sorted(map(tuple, merkle.op13_merkle(spark, folder).collect()), key=str)


def test_proofs_equal_brute_force(spark, tmp_path):
    rng = random.Random(1)
    many = [(i, rng.choice(["Text", "text", None, "É " * 50]), "en", f"source {i % 37}" if i % 3 else "hot", i) for i in range(900)]
    for rows in (some_docs(), [*many, (None, "A", None, None, None), (None, "b", None, "hot", 1)]):
        got = proofs(spark, tmp_path, rows)
        assert got == brute_merkle(rows)
        assert {r[-1] for r in got} == {True, False}


def test_one_row_one_source_and_no_rows(spark, tmp_path):
    for rows in ([(1, "A", "en", "s", 1)], [(i, "a", "en", "s", 1) for i in range(17)], [(0, "A", "en", f"s{i}", 1) for i in range(17)], []):
        assert proofs(spark, tmp_path, rows) == brute_merkle(rows)


def test_places_are_those_of_the_order(spark):
    df = spark.createDataFrame([("s" + str(i % 3 * (i % 2)), (i * 7919) % 500) for i in range(2000)], "tree string, x long")
    got = merkle.place(df, "x").collect()
    for tree in {r["tree"] for r in got}:
        mine = sorted((r["pos"], r["x"], r["n"]) for r in got if r["tree"] == tree)
        assert [m[0] for m in mine] == list(range(len(mine))) and {m[2] for m in mine} == {len(mine)}
        assert [m[1] for m in mine] == sorted(m[1] for m in mine)
