"""The corpus operators against plain versions, on small tables with the awkward cases."""

import hashlib
import json
import random
import zlib
from pathlib import Path

import brute
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from answerlens.llm import ann, blocks, bpe_automaton, exact_dedup, fuse, katz, language_id, mixing, ngram_join, quality, repeated_text, token_files
from answerlens.llm.graph import components

WORDS = "the of and to in bank river stone über señor maison chien rapide langsam casa perro".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, source): copies, near copies, shared passages, nulls, blanks, a long text, a text of one repeated word."""
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    texts += [texts[0], texts[0] + " ", " ".join(texts[1].split()), None, "", " \n\t", "One", "a\tb\x0bc", prose(rng, 4000), "spam " * 300]
    for base in texts[2:8]:
        w = (base + " " + prose(rng, 150)).split()
        texts.append(" ".join(w))
        w[10] = "changed"
        texts.append(" ".join(w))
    passage = prose(rng, 90)
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, 20) for _ in range(4)]
    return [(i, t, ["a", "b", None, "c"][i % 4]) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, 2.0) for i, t, s in rows], "doc_id long, text string, source string, lang string, size int, score double").repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def two(rows):
    return [(i, t) for i, t, _ in rows]


@pytest.mark.parametrize(("order", "block_bytes"), [(3, 2000), (1, 2000), (4, 1 << 20)])
def test_katz_equals_brute_force_and_sums_to_one(docs, rows, order, block_bytes, monkeypatch, tmp_path):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block_bytes)
    train = [i % 5 != 0 for i, *_ in rows]
    got = {r["doc_id"]: r for r in katz.score(docs, F.col("doc_id") % 5 != 0, order, f"file://{tmp_path}/tables").collect()}
    want, p, vocabulary, histories = brute.katz(two(rows), train, order)
    assert len(got) == len(rows)
    for d, (n, known, total, base, s) in want.items():
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(s, rel=1e-9)
    for h in histories[:300] + histories[-2:]:
        if len(h) < order:
            assert sum(p(h, w) for w in vocabulary) == pytest.approx(1, abs=1e-9)
    stored = docs.sparkSession.read.parquet(f"{tmp_path}/tables").where("order = 1 AND keys IS NOT NULL").collect()
    words = {k: c for r in stored for k, c in zip(blocks.unpack_keys(r["keys"]).tolist(), blocks.unpack_counts(r["totals"]).tolist(), strict=True)}
    assert sum(words.values()) == want[0][2] + sum(train)  # every training document's begin is counted beside its tokens


def test_katz_without_rows_or_training(none, docs):
    assert katz.score(none, F.lit(True)).count() == 0
    assert {r["score"] for r in katz.score(docs.limit(3), F.lit(False)).collect()} == {0.0}


def test_ngram_join_equals_brute_force(docs, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs).collect()}
    assert got == brute.jaccard_components(two(rows))


def test_ngram_join_of_a_large_group(spark):
    rng = random.Random(9)
    base = prose(rng, 60).split()
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(60)] = f"x{rng.randrange(9)}"
        texts.append(" ".join(w))
    data = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == brute.jaccard_components(data)


def test_repeated_text_equals_brute_force(docs, rows):
    for length, passage in ((40, 25), (400, 250)):
        got = {r["doc_id"]: (r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), bytes(r["kept"]), r["n_shared"]) for r in repeated_text.repeats(docs, length, passage).collect()}
        shared = {d: removed for d, _, removed, _, _ in brute.repeated(two(rows), passage)}
        assert got == {d: (*rest, shared[d]) for d, *rest in brute.repeated(two(rows), length)}


def test_exact_dedup(docs, rows):
    import re

    norm = {i: re.sub(brute.WS, "", t or "") for i, t in two(rows)}
    groups = {}
    for i, t in two(rows):
        groups.setdefault(norm[i], []).append((-len(t or ""), i))
    for weak in (None, lambda c: F.substring(exact_dedup.sha256(c), 1, 1)):  # one byte of digest: collisions are told apart by bytes
        out = exact_dedup.dedup(docs, F.col("doc_id") < 30, *([weak] if weak else [])).collect()
        assert len(out) == len(rows)
        for r in out:
            g = groups[norm[r["doc_id"]]]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (min(g)[1], len(g), min(g)[1] == r["doc_id"])


def test_fuse_filter_has_all_keys_and_few_others():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 1000, 30_000):
        keys = rng.integers(0, 2**64, n, dtype=np.uint64)
        f = fuse.build(np.concatenate([keys, keys[:3]]))
        assert fuse.probe(f, keys).all()
        assert fuse.probe(f, rng.integers(0, 2**64, 20_000, dtype=np.uint64)).mean() < 0.01


def test_bpe_automaton_equals_the_library(docs, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe_automaton.word_vocabulary())
    e = bpe_automaton.encoder(bpe_automaton.word_vocabulary())
    rng = random.Random(2)
    odd = "aAbeétÉ 's'tI' 12\n\t.,!?$<|endoftext|>ß中文é́ΣσςİIıﬁ①²½\x85\xa0\x1c👍👨‍👩‍👧ñ्हि"
    texts = [t or "" for _, t in two(rows)] + ["".join(rng.choice(odd) for _ in range(rng.randint(0, 16))) for _ in range(1500)] + ["x <|endoftext|>y", "y" * 300_000]
    plain = [t for t in texts if not bpe_automaton._ODD.search(t)]
    for some in (texts, plain, plain[:1]):
        want = [lib.encode(t, add_special_tokens=False).ids for t in some]
        assert [e.encode(t) for t in some] == want
        got = [x for chunk in e.batch(pa.array(some)) for x in zip(*(c.tolist() if isinstance(c, np.ndarray) else c.to_pylist() for c in chunk), strict=True)]
        assert got == [(len(ids), " ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False)) for ids in want]
    got = {r["doc_id"]: r for r in bpe_automaton.digest_documents(docs).collect()}
    for i, t in two(rows):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_bpe_automaton_encodes_the_words_of_a_chunk_together(monkeypatch):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe_automaton.word_vocabulary())
    e = bpe_automaton.Encoder(bpe_automaton.word_vocabulary())
    rng, alone = random.Random(3), []
    monkeypatch.setattr(bpe_automaton.Encoder, "_encode", lambda self, word, one=bpe_automaton.Encoder._encode: alone.append(word) or one(self, word))
    words = ["".join(rng.choice("eéñtaionsrhld") for _ in range(rng.randint(1, 20))) + rng.choice(["", "", ".", "$$$", "'s", "<|endoftext|>", "—", "_"]) for _ in range(5000)]
    long = [c * n for c, n in (("x", 48), ("x", 49), ("é", 24), ("é", 25))]  # words of up to 48 bytes go together
    texts = ["", " ".join(words), None, " ".join(reversed(words)), " ".join(long), " \t"]
    got = [x for n, ids, text in e.batch(pa.array(texts)) for x in zip(n.tolist(), ids.to_pylist(), text.to_pylist(), strict=True)]
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert got == [(len(ids), " ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False)) for ids in want]
    assert sorted(alone) == ["x" * 49, "é" * 25]
    assert [n.tolist() for n, *_ in e.batch(pa.array(["", None], pa.string()))] == [[0, 0]]
    states, labels = (np.array([rng.randrange(n) for _ in range(3000)]) for n in (len(e.automaton.copied), len(e.automaton.target)))
    states[:1000] = e.automaton.targets[labels[:1000]]
    for _ in range(2):  # looked up, and remembered
        assert e.automaton.has(states, labels).tolist() == [e.automaton._has(s, x) for s, x in zip(states.tolist(), labels.tolist(), strict=True)]


def test_bpe_automaton_keeps_little_and_takes_one_kind_of_file(tmp_path, none, monkeypatch):
    assert bpe_automaton.digest_documents(none).count() == 0
    monkeypatch.setattr(bpe_automaton, "CACHE_BYTES", 5000)
    kept = bpe_automaton.Recent()
    for i in range(1000):
        kept.keep(f"k{i}", i, i)
    assert kept.size <= 5000 and len(kept) < 25 and "k999" not in kept
    spec = json.loads(Path(bpe_automaton.word_vocabulary()).read_text())
    spec["normalizer"] = {"type": "NFKC"}
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="normalizer"):
        bpe_automaton.Encoder(str(other))


def test_token_files_round_trip(docs, rows, none, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(token_files.byte_vocabulary())
    got = {r["doc_id"]: r for r in token_files.round_trip(docs, f"file://{tmp_path}/r").collect()}
    start = 0
    for i, t in two(rows):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    shard = next((tmp_path / "r").glob("*.rec"))
    offsets = np.fromfile(shard.with_suffix(".idx"), dtype="<u8")
    data = shard.read_bytes()
    assert len([token_files.parse(data, int(o))[0] for o in offsets[::-1]]) == len(offsets)
    damaged = bytearray(data)
    damaged[30] ^= 1
    with pytest.raises(ValueError):
        token_files.parse(bytes(damaged))
    assert token_files.round_trip(none, f"file://{tmp_path}/n").count() == 0


def test_shuffled_reads_find_every_record_by_its_offset(docs, rows, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(token_files.byte_vocabulary())
    folder = f"file://{tmp_path}/s"
    shards = token_files.write(docs, folder, n_shards=3)
    orders = []
    for seed in (1, 2):
        got = token_files.shuffled(shards, folder, seed).orderBy("place").collect()
        assert {r["doc_id"]: r["ids"] for r in got} == {i: lib.encode(t or "", add_special_tokens=False).ids + [0] for i, t in two(rows)}
        orders.append([r["doc_id"] for r in got])
    assert orders[0] != orders[1] and orders[0] != sorted(orders[0])


def plain_kneser_ney(words, order):
    """words: {word: n} -> the probability of a character after a history, by counting strings."""
    from collections import Counter, defaultdict

    count = {n: Counter() for n in range(1, order + 1)}
    left = defaultdict(set)
    for w, times in words.items():
        s = f" {w} "
        for i in range(1, len(s)):
            for n in range(1, order + 1):
                if i - n + 1 >= 0:
                    g = s[i - n + 1 : i + 1]
                    if n == order or i - n + 1 == 0:
                        count[n][g] += times
                    else:
                        left[g].add(s[i - n : i + 1])
    for g, longer in left.items():
        count[len(g)][g] += len(longer)
    discount = {}
    for n, c in count.items():
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[n] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    total, kept = Counter(), Counter()
    for n, c in count.items():
        for g, v in c.items():
            total[n, g[:-1]] += v
            kept[n, g[:-1]] += max(v - discount[n], 0)
    return count, discount, total, kept


def test_character_counts_equal_a_plain_count():
    words = {"abab": 3, "abc": 2, "cab": 1, "ba": 5, "b": 1, "été": 2}
    alphabet = len(set(" ".join(words))) + 1
    m = language_id.fit(pd.DataFrame([("x", w, n) for w, n in words.items()], columns=["lang", "word", "n"]))
    count, discount, total, kept = plain_kneser_ney(words, language_id.ORDER)
    assert m.alphabet == alphabet

    def p(history, c):
        q = (total[1, ""] - kept[1, ""]) / total[1, ""] / alphabet
        for n in range(1, language_id.ORDER + 1):
            h = history[len(history) - n + 1 :] if n > 1 else ""
            if len(h) < n - 1:
                break
            if total[n, h]:
                q = (q if n == 1 else q * (total[n, h] - kept[n, h]) / total[n, h]) + max(count[n][h + c] - discount[n], 0) / total[n, h]
        return q

    for word in ("abab", "bac", "cé", "zzz", "ababab"):
        s = f" {word} "
        want = -sum(np.log(p(s[:i], s[i])) for i in range(1, len(s)))
        got, n = language_id.cross_entropies(m, [word])
        assert got[0][0] == pytest.approx(want, rel=1e-4) and n[0] == len(word) + 1


def test_language_decision_is_the_lowest_cross_entropy():
    m = language_id.Models(["a", "b"], np.zeros(0, np.uint64), np.zeros((0, 2)), np.zeros((0, 2)), 1, np.array([1.0, 2.0]))
    d = language_id.decide(m, np.array([[0.5, 0.6], [9.0, 1.0], [9.0, 9.0], [0.0, 0.0], [0.7, 0.7]]), np.array([100, 100, 100, 0, 4]))
    assert list(d["lang_pred"]) == ["a", "b", "a", "und", "a"] and list(d["rejected"]) == [False, False, True, True, False]
    assert d["score"].between(0, 1).all() and d["score"][4] == pytest.approx(0.5)


def test_quality_features_equal_a_plain_count():
    texts = [None, "", "Ab, c 12!\n", "word word other", "é" * 3, "x" * 200]
    got = quality.features(pa.array(texts, pa.large_string()))
    for t, row in zip(texts, got, strict=True):
        b = (t or "").encode()
        single, double = np.zeros(256), np.zeros((quality.N_CLASSES, quality.N_CLASSES))
        for x in b:
            single[x] += 1
        for x, y in zip(b, b[1:], strict=False):
            double[quality.CLASS[x], quality.CLASS[y]] += 1
        w = b.split()
        tail = [np.log1p(len(b)) / 10, 1 - len(set(w)) / max(len(w), 1), np.log1p(len(w)) - np.log1p(len(set(w)))]
        assert row == pytest.approx(np.concatenate([np.sqrt(single / (len(b) + quality.SHORT)), np.sqrt(double.ravel() / (len(b) + quality.SHORT)), tail]), abs=1e-6)


def test_pairwise_fit_minimises_the_logistic_loss():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)).astype(np.float32)
    y = (x @ [2.0, -1.0, 0.0] + rng.normal(size=400) > 0).astype(int)
    w = quality.fit_pairs(x, y, pairs=4000, seed=5)
    draw = np.random.default_rng(5)
    up, down = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = (x[draw.choice(up, 4000)] - x[draw.choice(down, 4000)]).astype(np.float64)
    scale = d.std(axis=0) + 1e-3
    d /= scale
    v = np.zeros(3)
    for _ in range(20_000):  # plain gradient descent on the same loss
        v -= 0.5 * (-(d * (1 / (1 + np.exp(d @ v)))[:, None]).mean(axis=0) + 1e-2 * v)
    assert w * scale == pytest.approx(v, abs=2e-3) and w[0] > -w[1] > 0


def test_quality_with_repeated_rows_and_clashing_names(spark):
    data = [(i, "good words here " * 5 if i % 2 else "@@ ## " * 9) for i in range(40)] + [(3, "another text of three")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    scores = []
    for n in (2, 5):
        df = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("y", "_y", "score", "x", "quality", "a.b")}).repartition(n)
        scores.append(sorted((r["doc_id"], r["score"]) for r in quality.score_documents(df, quality.learn(df, labels)).collect()))
    assert scores[0] == scores[1] and len(scores[0]) == 41
    long = spark.createDataFrame([(1, "good words here " * 700_000)], "doc_id long, text string")
    assert 0 <= quality.score_documents(long, quality.learn(df, labels)).first()["score"] <= 1


def test_token_encoder_on_odd_text():
    from tokenizers import Tokenizer

    lib, e, rng = Tokenizer.from_file(token_files.byte_vocabulary()), token_files.encoder(token_files.byte_vocabulary()), random.Random(3)
    odd = "aAbé 's'tI' 12\n\t.,!?<|endoftext|>ß中é́\x85\xa0\x1c👍ñ्हि   \n"
    for _ in range(3000):
        t = "".join(rng.choice(odd) for _ in range(rng.randint(0, 14)))
        assert e.encode(t) == np.array(lib.encode(t, add_special_tokens=False).ids, dtype="<u2").tobytes()


def test_mixing_meets_targets(docs, rows, none):
    import re

    out = mixing.shares(docs).collect()
    assert len(out) == len(rows) and mixing.mix(none).count() == 0
    sizes = {i: len([w for w in re.split(brute.WS, t or "") if w]) for i, t in two(rows)}
    names = ["a", "b", "c", None]
    total = {s: sum(sizes[i] for i, _, x in rows if x == s) for s in names}
    weight = dict(zip(names, [3, 1, 2, 3], strict=True))
    left, free, target = 1.5 * sum(total.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * total[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2.0 * total[s] for s in over}
        left, free = left - sum(2 * total[s] for s in over), free - over
    longest = max(sizes.values())
    for s in names:
        mine = [r for r in out if r["source"] == s]
        assert mine[0]["target"] == pytest.approx(target[s]) and mine[0]["source_size"] == total[s]
        assert abs(sum(r["size"] * r["epochs"] for r in mine) - target[s]) <= longest / 2 + 1
        assert len({r["epochs"] for r in mine}) <= 2 or any(r["size"] == 0 for r in mine)
    clash = docs.repartition(5).withColumns({c: F.lit("x") for c in ("row", "_size", "_s", "key", "target", "bucket", "epochs", "rest", "a.b")})
    again = mixing.mix(clash)
    assert again.select("row.*").columns == clash.columns
    assert sorted((r["row"]["doc_id"], r["epochs"]) for r in again.collect()) == sorted((r["doc_id"], r["epochs"]) for r in out)


def test_sampling_follows_the_keys(spark):
    """Of one source, what is taken is a prefix in key order, computed here row by row."""
    data = [(i, "w " * (i % 9 + 1), "s" if i % 3 else "t") for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    out = mixing.shares(df.withColumn("text", F.col("text")), weights=(1.0,), buckets=7).join(df.select("doc_id", "text"), "doc_id")
    seed = 17
    tie = F.xxhash64(F.col("text"), F.lit(seed))
    key = -F.log((F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), tie), 11) + 0.5) / float(2**53)) / mixing.quality_weight(F.col("text"))
    for s in "st":
        mine = out.where(F.col("source") == s).withColumn("k", key).orderBy("k", "doc_id").collect()
        whole, rest = divmod(mine[0]["target"], mine[0]["source_size"])
        at = 0
        for r in mine:
            assert r["epochs"] == whole + (at + r["size"] / 2 <= rest)
            at += r["size"]


def test_language_id(spark, none):
    rng = random.Random(5)
    kinds = {"en": ["the", "and", "thing", "with", "other"], "fr": ["été", "que", "vous", "leur", "oiseau"], "de": ["und", "nicht", "schön", "über", "zwei"]}
    data = [(i, " ".join(rng.choice(kinds[k]) for _ in range(60_000 if i == 5 else rng.randint(3, 40))), k) for i, k in enumerate(list(kinds) * 60)]
    extra = [(1000, None, "en"), (1001, "12 !! ..", "fr"), (1002, "", None), (1003, "жжж щщщ ыыы " * 9, "de"), (0, data[0][1], "en")]
    df = spark.createDataFrame(data + extra, "doc_id long, text string, lang string")
    models = language_id.learned(df.where("doc_id < 1000"))
    clash = df.withColumns({c: F.lit(1) for c in ("row", "lang_pred", "rejected", "_lang_pred", "score", "a.b")})
    assert language_id.classify(clash, models).select("row.*").columns == clash.columns
    out = {r["row"]["doc_id"]: r for r in language_id.classify(clash, models).collect()}
    right = [out[i]["lang_pred"] == k for i, _, k in data]
    assert sum(right) >= 0.98 * len(right) and not any(out[i]["rejected"] for i, _, _ in data)
    assert [out[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and out[1003]["rejected"]
    assert language_id.classify(none.select("doc_id", "text"), models).count() == 0
    empty = language_id.learned(df.limit(0))
    assert {r["lang_pred"] for r in language_id.classify(df.limit(5), empty).collect()} == {"und"}


def test_no_language_is_lost_in_training(spark):
    many = spark.range(1005).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"), F.format_string("l%04d", "id").alias("lang"))
    assert language_id.train(many).languages == [f"l{i:04d}" for i in range(1005)]
    held = [r["id"] for r in spark.range(100, 1000).where(F.pmod(F.xxhash64("id", F.lit(31)), F.lit(5)) == 0).limit(3).collect()]
    rng = random.Random(7)
    kinds = {"en": ["the", "and", "thing", "with", "other"], "xx": ["żółw", "gęś", "jaźń", "łódź", "ćma"]}
    text = {k: lambda k=k: " ".join(rng.choice(kinds[k]) for _ in range(20)) for k in kinds}
    new = spark.createDataFrame([(i, text[k]()) for i, k in enumerate(["en", "xx"] * 10)], "doc_id long, text string")
    for rare in (held[:1], held):
        df = spark.createDataFrame([(i, text["en"](), "en") for i in range(60)] + [(i, text["xx"](), "xx") for i in rare], "doc_id long, text string, lang string")
        out = {r["row"]["doc_id"]: (r["lang_pred"], r["rejected"]) for r in language_id.classify(new, language_id.train(df)).collect()}
        assert out == {i: (["en", "xx"][i % 2], False) for i in range(20)}


def test_character_models_are_normalised():
    words = pd.DataFrame([("x", "ab", 3), ("x", "abc", 2), ("x", "cab", 1), ("y", "ba", 4)], columns=["lang", "word", "n"])
    m = language_id.fit(words)
    letters = "abc "
    for prefix in ("", "a", "ab", "ca"):
        total = np.zeros(2)
        for c in letters + "z":  # z stands for the one unseen character
            if c == " ":
                full, _ = language_id.cross_entropies(m, [prefix]) if prefix else (np.full((1, 2), np.inf), 0)
                last = full[0]
            else:
                full, _ = language_id.cross_entropies(m, [prefix + c])
                tail = _closing(m, prefix + c)
                last = full[0] - tail
            head = _prefix(m, prefix)
            total += np.exp(-(last - head))
        if prefix:
            assert total == pytest.approx([1, 1], abs=2e-3)


def _closing(m, word):
    chars, who, history = language_id.stretches([word])
    return _per_char(m, word)[-1]


def _prefix(m, word):
    return _per_char(m, word)[: len(word)].sum(axis=0) if word else 0.0


def _per_char(m, word):
    full = [language_id.cross_entropies(m, [word])[0][0]]
    n = len(word) + 1
    out = np.zeros((n, len(m.languages)))
    chars, who, history = language_id.stretches([word])
    keys = language_id.gram_keys(chars, history, language_id.ORDER)
    p = np.broadcast_to(m.root / m.alphabet, (len(chars), len(m.languages))).copy()
    table = {k: i for i, k in enumerate(m.keys.tolist())}
    for i in range(len(chars)):
        q = m.root / m.alphabet
        for o in range(1, language_id.ORDER + 1):
            if keys[o - 1][i] == 0:
                break
            if o > 1 and (c := table.get(int(keys[o - 2][i - 1]))) is not None:
                q = q * m.back[c]
            if (g := table.get(int(keys[o - 1][i]))) is not None:
                q = q + m.own[g]
        p[i] = q
    out[:] = -np.log(p[1 : n + 1])
    assert out.sum(axis=0) == pytest.approx(full[0], rel=1e-3)
    return out


def test_quality_on_held_out_rows(spark, none):
    rng = random.Random(6)
    good = [(i, prose(rng, rng.randint(20, 80)), 1) for i in range(150)]
    bad = [(i, " ".join(w + rng.choice(["###", "$$$", "!!"]) for w in prose(rng, rng.randint(20, 80)).split()), 0) for i in range(150, 220)]
    data = good + bad
    df = spark.createDataFrame([(i, t) for i, t, _ in data] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in data] + [(0, None), (None, 1)], "doc_id long, quality int")
    model = quality.learn(df, labels.where("doc_id % 5 <> 0"))
    out = {r["doc_id"]: r for r in quality.score_documents(df, model).collect()}
    held = [(i, q) for i, _, q in data if i % 5 == 0]
    assert sum(out[i]["predicted"] == q for i, q in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out.values()) and len(out) == 222
    assert quality.score_documents(none, model).count() == 0
    assert quality.learn(df, labels.limit(0)).constant == 0.5


@pytest.mark.parametrize("sample", [20_000, 300])
def test_nearest_neighbours(spark, sample, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 150 if sample > 1000 else 10)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 900)] + 0.3 * rng.normal(size=(900, 16))).astype(np.float32)
    x[500:800] = x[500]  # many equal vectors
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (920, [0.0] * 16), (940, [float("nan")] * 16), (960, [None] * 16), (980, [1.0]), (None, [1.0] * 16), (7, [float(v) for v in x[7]])]
    vectors = ann.clean(spark.createDataFrame(data, "vec_id long, embedding array<float>"))
    assert vectors.count() == 902
    out = ann.search(vectors, F.col("id") % 20 == 0, sample=sample).toPandas()
    assert out["leaves"].iloc[0] > (4 if sample > 1000 else 40) and out["calibrated_recall"].iloc[0] >= 0.97
    short = out[out["query_id"] == 980].sort_values("rank")
    assert len(short) == 20 and np.array_equal(short["score"], x[short["vec_id"].to_numpy(), 0].astype(np.float64))
    out = out[(out["query_id"] != 980)]
    x64, ids, hit = np.vstack([x.astype(np.float64), [1.0] + [0.0] * 15]), np.array([*range(900), 980]), 0
    row = {int(d): i for i, d in enumerate(ids)}
    for q, mine in out.groupby("query_id"):
        s = np.cumsum(x64 * x64[q], axis=1)[:, -1]
        s[q] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        mine = mine.sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 21)) and q not in set(mine["vec_id"]) and mine["vec_id"].is_unique
        assert np.array_equal(mine["score"].to_numpy(), s[[row[d] for d in mine["vec_id"]]])
        assert list(zip(-mine["score"], mine["vec_id"], strict=True)) == sorted(zip(-mine["score"], mine["vec_id"], strict=True))
        hit += len(set(want) & set(mine["vec_id"]))
    assert out["query_id"].nunique() == 45 and hit >= 0.9 * 45 * 20
    assert ann.search(vectors.limit(0), F.lit(True)).count() == 0
    few = ann.search(vectors.where("id < 5"), F.col("id") == 0).collect()
    assert len(few) == 4


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 1), (7, 7)] + [(100 + i, 101 + i) for i in range(40)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4} | {100 + i: 100 for i in range(41)}


def test_packed_keys_and_counts():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    assert np.array_equal(blocks.unpack_keys(blocks.pack_keys(keys)), keys)
    for c in (np.zeros(0, np.int64), np.array([0, 255]), np.array([70000, 3])):
        assert np.array_equal(blocks.unpack_counts(blocks.pack_counts(c)), c)


def test_blocks_hold_every_row_once(docs, rows):
    packed = blocks.pack(docs.select("doc_id", "text"), 2000).toPandas()
    assert sorted(i for p in packed["payload"] for i in blocks.unpack(p)["doc_id"].to_pylist()) == [i for i, *_ in rows]
    assert packed["block"].is_unique


def test_queries_are_sent_once_a_shelf(spark, monkeypatch):
    """No row for a leaf that a query visits; leaves longer than a shelf, repeated ids and equal vectors are found as brute force finds them."""
    monkeypatch.setattr(ann, "LEAF", 10)
    monkeypatch.setattr(ann, "SHELF_LEAST", 50)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 40)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 6)) * rng.choice([1e-9, 1.0, 1e6], size=(700, 1))
    x[300:500] = x[300]
    ids = np.where(np.arange(700) < 650, np.arange(700), np.arange(700) - 640)  # 50 ids with two vectors
    vectors = ann.clean(spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>"))
    out = ann.search(vectors, F.col("id") % 20 == 0, recall=1.0)
    assert "explode" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.toPandas()
    assert got["leaves"].iloc[0] > 30 and got["calibrated_recall"].iloc[0] == 1.0
    first = {int(i): min(list(map(tuple, x[ids == i]))) for i in np.unique(ids) if i % 20 == 0}
    hit = 0
    for q, v in first.items():
        best = {}
        for i, s in zip(ids.tolist(), ann.exact(np.array(v)[None], x).tolist(), strict=True):
            if i != q:
                best[i] = max(best.get(i, -np.inf), s)
        want = sorted(best.items(), key=lambda p: (-p[1], p[0]))[:20]
        mine = list(got[got["query_id"] == q].sort_values("rank")[["vec_id", "score"]].itertuples(index=False, name=None))
        assert len(mine) == 20 and all(best[i] == s for i, s in mine) and mine == sorted(mine, key=lambda p: (-p[1], p[0]))
        hit += len(set(want) & set(mine))
    assert len(first) == got["query_id"].nunique() and hit >= 0.99 * 20 * len(first)
    monkeypatch.setattr(ann, "SHELVES", 3)
    shelves = ann.shelve(np.array([5, 5, 200, 0, 3, 100, 0, 40]))
    assert list(zip(shelves["first"], shelves["leaves"], strict=True)) == [(0, 2), (2, 1), (2, 1), (3, 4), (7, 1)]
