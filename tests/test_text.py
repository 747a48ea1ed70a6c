"""Text preparation, spans, chunks and claims."""

import random

import pytest
from pyspark.sql import functions as F

from answerlens.functions import text as X
from answerlens.functions import text_udf as U


def test_spans_are_slices_of_the_text():
    rng = random.Random(1)
    parts = ["Dr. Who", "it costs 3.5 dollars", "e.g. this", "`a. b`", "yes!", "no?", "\n\n", "\n- item", "[1]", "\"Quote.\"", "et al. said", "…", "好。", " "]
    for _ in range(500):
        t = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        spans = U.sentence_spans(t)
        assert all(t[a:b] == s for s, a, b, _ in spans)
        assert all(x[2] <= y[1] for x, y in zip(spans, spans[1:], strict=False))
        assert "".join("".join(s.split()) for s, *_ in spans) == "".join(t.split())


@pytest.mark.parametrize("text,want", [
    ("It is 3.5 m. Next one.", ["It is 3.5 m.", "Next one."]),
    ("Dr. Jones came. He left.", ["Dr. Jones came.", "He left."]),
    ("See Kim et al. for more. Done.", ["See Kim et al. for more.", "Done."]),
    ("Really?! Yes.", ["Really?!", "Yes."]),
    ("A claim. [1] [doc 2] More.", ["A claim. [1] [doc 2]", "More."]),
    ("One\n\nTwo", ["One", "Two"]),
    ("好。坏。", ["好。", "坏。"]),
    ("", []),
])
def test_sentences(text, want):
    assert [s for s, *_ in U.sentence_spans(text)] == want


def test_chunks_keep_sizes_and_overlap():
    assert U.split_chunks("", 10, 2) == []
    assert U.split_chunks("a" * 25, 10, 2) == ["a" * 10, "a" * 10, "a" * 9, "a"]
    got = U.split_chunks("one two.\nthree four.\nfive six", 20, 8)
    assert got == ["one two.\nthree four.", "\nfive six"]  # the tail ends with its full stop: nothing of it is left, but the line end is
    assert "".join(got).count("five six") == 1


@pytest.mark.parametrize("text,want", [
    ("It costs $1,200.", [("money:USD", 1200.0)]),
    ("3 万 yuan", [("money:CNY", 30000.0)]),
    ("20% in 2 weeks", [("percent", 20.0), ("duration", 1209600.0)]),
    ("5 km or 300 g", [("length", 5000.0), ("weight", 300.0)]),
    ("支持7天退款", [("duration", 604800.0)]),
    ("价格100元", [("money:CNY", 100.0)]),
    ("价格100美元或90欧元", [("money:USD", 100.0), ("money:EUR", 90.0)]),
    ("费用为50%，即百分之20", [("percent", 50.0), ("percent", 20.0)]),
    ("长度为3千米，重5斤", [("length", 3000.0), ("weight", 2500.0)]),
    ("需要5个工作日", [("duration", 432000.0)]),
    ("takes 5 h, 10 feet", [("duration", 18000.0), ("length", 3.048)]),
    ("abc12 x", []),
    ("3-5 days", []),
    ("version 2.1", []),
    ("[3]", []),
])
def test_claims(text, want):
    assert [(c["family"], c["value"]) for c in U.find_claims(text)] == want


def test_dates_without_a_year_are_marked():
    a, b = U.find_claims("On 2024-03-05 and March 7 it rained")
    assert a["year_known"] and not b["year_known"]


def test_polarity_and_negation():
    assert U.find_polarity("This is not refundable")[0]["polarity"] == -1
    assert U.find_polarity("It is refundable")[0]["polarity"] == 1
    assert U.find_polarity("Plain words") == []


@pytest.mark.parametrize("text,concept,want", [
    ("A full refund is given", "refund scope", 1),
    ("Only a partial refund is given", "refund scope", -1),
    ("全额退款", "refund scope", 1),
    ("部分退款", "refund scope", -1),
    ("Storage is unlimited", "availability", 1),
    ("Storage is limited to 5 GB", "availability", -1),
    ("不限流量", "availability", 1),
])
def test_concepts(text, concept, want):
    assert {c["concept"]: c["polarity"] for c in U.find_polarity(text)}[concept] == want


def _chunks_by_rule(text, size, overlap):
    """Chunks as lists of lines, by the rules of packing: each state is what was put down since the last chunk."""
    chunks, lines, room = [], [], size
    for line in filter(None, map(str.strip, text.split("\n"))):
        if len(line) <= room:
            lines.append(line)
            room -= len(line) + 1
            continue
        if not lines:
            pieces = range(0, len(line), size - overlap)
            chunks.extend(line[p : p + size] for p in pieces)
            continue
        whole = "\n".join(lines)
        chunks.append(whole)
        if overlap and len(whole) > overlap:
            end = whole[len(whole) - overlap :]
            for mark in "。.":
                if mark in end:
                    left, _, right = end.rpartition(mark)
                    end = right if left else end
                    break
            lines = [end, line]
            room = size - len(end) - 1 - len(line)
        else:
            lines = [line]
            room = size - len(line)
    if lines:
        chunks.append("\n".join(lines))
    return chunks


def test_chunks_follow_the_rules():
    rng = random.Random(3)
    for _ in range(2000):
        text = "\n".join("".join(rng.choice("ab .。") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6)))
        assert U.split_chunks(text, 12, 4) == _chunks_by_rule(text, 12, 4)
        assert U.split_chunks(text, 12, 0) == _chunks_by_rule(text, 12, 0)


def test_a_short_chunk_is_not_repeated_and_tails_are_kept_as_they_are():
    assert U.split_chunks("abc\n" + "x" * 600) == ["abc", "x" * 600]
    long = "a" * 400
    assert U.split_chunks(f"{long}. tail\n" + "b" * 300) == [f"{long}. tail", " tail\n" + "b" * 300]
    assert U.split_chunks("。" + "a" * 127 + "\n" + "b" * 500)[1] == "b" * 500
    assert U.split_chunks("ab。" + "c.d" * 42 + "\n" + "b" * 500)[1] == "c.d" * 42 + "\n" + "b" * 500


@pytest.mark.parametrize(("text", "kind", "value"), [("重5毫克", "weight", 0.005), ("10 lbs", "weight", 4535.92), ("3 t", "weight", 3e6), ("5百元", "money", 500.0), ("共3份", "count", 3.0), ("3项", "count", 3.0), ("2笔", "count", 2.0), ("3 weekdays", "duration", 259200.0), ("6月", "duration", 15552000.0)])
def test_units_and_counters(text, kind, value):
    (claim,) = U.find_claims(text)
    assert claim["kind"] == kind and claim["value"] == pytest.approx(value)


def test_typos_are_fixed_once_longest_first(spark):
    fix = U.corrector({"ab": "ba", "abc": "x", "ba": "zz"})
    row = spark.createDataFrame([("abc ab",), (None,)], "t string").select(fix(F.col("t")).alias("f")).collect()
    assert row[0].f.corrected == "x ba" and [c.position for c in row[0].f.corrections] == [0, 4] and row[1].f.corrected is None


def test_structure():
    s = U.structure_of("Guide\n1. Fees\n- price: 5\n1.1 More\n- extra\n\n2. End")
    assert s["title"] == "Guide" and [x["title"] for x in s["sections"]] == ["Fees", "End"]
    assert s["sections"][0]["items"] == ["price: 5"] and s["sections"][0]["subsections"][0]["items"] == ["extra"]


@pytest.mark.parametrize(("text", "title", "sections"), [
    ("", "", []),
    ("7 First\nGuide\nplain", "Guide", [("First", ["plain"], [])]),  # the title may come after a section
    ("- a\n\n•b\nGuide", "Guide", [("Guide", ["a", "b"], [])]),  # bullets alone: one section, and a blank line changes nothing
    ("- a", "", [("Overview", ["a"], [])]),
    ("T\n1 A\n- x\n\n- y\n\n", "T", [("A", ["y"], [])]),  # later items of a section take the place of earlier ones
    ("T\n1. A\n1.1 B\nplain\n- x\n\nplain\n", "T", [("A", ["plain"], [("B", ["x"])])]),  # a plain line is none of a subsection's items
    ("T\n1.1 B\n- x\n2. C", "T", [("C", [], [])]),  # a subsection of no section is nothing
    ("T\n1. A\n1.1 B\n1.2 C\n2. D", "T", [("A", [], [("C", [])]), ("D", [], [])]),
    ("T\n1.A\n1.1\n2、B", "T", []),  # a number without a blank behind it is no heading
])
def test_structure_by_its_rules(text, title, sections):
    s = U.structure_of(text)
    assert s["title"] == title
    assert [(x["title"], x["items"], [(y["title"], y["items"]) for y in x["subsections"]]) for x in s["sections"]] == sections


def test_columns(spark):
    df = spark.createDataFrame([("a\r\n\r\n\r\n\r\nb  c\x00",)], "t string")
    r = df.select(X.clean_text(F.col("t")).alias("c"), X.citations(F.lit("x [1] [doc 2] [Document 3] [chunk_4] [y]")).alias("m"), X.tokens_cjk(F.lit("价格高 OK")).alias("k"), X.number(F.lit("1,234.5")).alias("n")).first()
    assert (r.c, r.m, r.k, r.n) == ("a\n\nb c", [1, 2, 3, 4], ["价格", "格高", "ok"], 1234.5)
    v = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [1.0, 1.0])], "a array<double>, b array<double>").select(X.cosine(F.col("a"), F.col("b"))).collect()
    assert [round(x[0], 6) for x in v] == [0.0, 1.0]


def test_results_of_a_batch_are_made_slice_by_slice(spark, monkeypatch, tmp_path):
    """The Python objects of one slice are gone when the next is read; results don't depend on where slices end."""
    monkeypatch.setattr(X, "SLICE", 3)
    alive = str(tmp_path / "alive")

    class Kept(list):
        count = 0

        def __init__(self, *x):
            super().__init__(*x)
            type(self).count += 1
            with open(alive, "a") as f:
                f.write(f"{type(self).count}\n")

        def __del__(self):
            type(self).count -= 1

    rows = spark.range(0, 20, 1, 1).select("id", F.when(F.col("id") != 7, F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    got = rows.select("id", X.by_slices("array<string>", lambda t: None if t is None else Kept([t]))(F.col("text")).alias("x")).collect()
    assert [(r.id, r.x) for r in got] == [(i, None if i == 7 else [f"t{i}"]) for i in range(20)]
    assert max(map(int, open(alive).read().split())) <= 3 + 1
