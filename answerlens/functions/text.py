"""Text preparation as column expressions: everything here stays in the JVM."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

TOKEN = r"[\p{L}\p{N}_]+"
_TOKEN = re.compile(r"\w+")
CITATION = r"\[(?i:(?:doc(?:ument)?\s*|chunk_|文档\s*)?(\d+))\]"
#: English function words; a parameter of the functions that use it.
STOP_WORDS = ("a an and are as at be by for from has have in is it its of on or that the this to was were will with").split()


def clean_text(text: Column) -> Column:
    """Line ends to LF, at most one empty line, single blanks, no control characters, trimmed."""
    text = F.regexp_replace(text, r"\r\n|\r", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"[ \t]{2,}", " ")
    text = F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F]", "")
    return F.regexp_replace(text, r"^[ \t\n]+|[ \t\n]+$", "")


def parse_warnings(text: Column, extension: Column) -> Column:
    """What looks wrong with a parsed file."""
    pages = F.size(F.regexp_extract_all(text, F.lit(r"\[Page \d+\]"), F.lit(0)))
    body = F.length(F.regexp_replace(text, r"\[Page \d+\]|[ \t\r\n]+", ""))
    n, pdf = F.length(text), extension == "pdf"
    return F.array_compact(F.array(
        F.when(n == 0, F.lit("empty")),
        F.when(pdf & (n < 50), F.lit("pdf_too_short")),
        F.when(pdf & (pages > 1) & (n < 200), F.lit("pdf_sparse")),
        F.when(pdf & (pages > 0) & (body == 0), F.lit("pdf_only_page_marks")),
        F.when((n > 0) & (n < 100), F.lit("short")),
    ))


def sentence_key(text: Column) -> Column:
    """P5"""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0B]+", " "))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def cjk_bigrams(token: Column) -> Column:
    """Overlapping pairs of a run of CJK characters; one character stays alone."""
    n = F.length(token)
    return F.when(n < 2, F.array(token)).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(token, i, F.lit(2))))


def tokens_cjk(text: Column) -> Column:
    """P6 with CJK runs expanded to bigrams."""
    pieces = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[一-鿿]+|[\p{L}\p{N}_&&[^一-鿿]]+"), F.lit(0))
    return F.flatten(F.transform(pieces, lambda t: F.when(t.rlike(r"^[一-鿿]"), cjk_bigrams(t)).otherwise(F.array(t))))


def long_tokens(text: Column) -> Column:
    """P6, for overlaps: distinct tokens of two characters or more."""
    return F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) > 1))


def key_terms(text: Column, stop: list[str] | None = None, keep: list[str] | None = None) -> Column:
    """Tokens without stop words and pure digits; words in keep always stay."""
    stop_, keep_ = F.array(*map(F.lit, stop or STOP_WORDS)), F.array(*map(F.lit, keep or [""]))
    return F.filter(tokens(text), lambda t: F.array_contains(keep_, t) | (~F.array_contains(stop_, t) & ~t.rlike("^[0-9]+$")))


def keywords(text: Column, stop: list[str] | None = None) -> Column:
    """Key terms of two characters or more."""
    return F.filter(key_terms(text, stop), lambda t: F.length(t) >= 2)


def citations(text: Column) -> Column:
    """The numbers of [n], [doc n], [document n], [chunk_n], in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)), lambda x: x.cast("int"))


def topic_tokens(text: Column, stop: list[str] | None = None) -> Column:
    """CJK bigrams and words of two characters or more, without stop words."""
    stop_ = F.array(*map(F.lit, stop or STOP_WORDS))
    return F.array_distinct(F.filter(tokens_cjk(text), lambda t: ~F.array_contains(stop_, t) & ((F.length(t) > 1) | t.rlike(r"^[一-鿿]"))))


def preview(text: Column, n: int) -> Column:
    """C2"""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def number(text: Column) -> Column:
    """A number with thousands separators."""
    return F.regexp_replace(text, ",", "").try_cast("double")


def timestamp(text: Column) -> Column:
    """ISO-8601 with Z or an offset."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def json_object(text: Column, schema: str) -> Column:
    """The JSON object from the first brace to the last, null if there is none."""
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)


def bround(x: Column, n: int = 4) -> Column:
    """Half to even."""
    return F.bround(x, n)


def severity(kind: Column, delta: Column, relative: Column) -> Column:
    """Of a mismatch; dates by days, percentages also by points."""
    size = F.when(kind == "percent", F.greatest(relative, delta / 50)).otherwise(relative)
    by_size = F.when(size >= 0.5, "high").when(size >= 0.2, "medium").otherwise("low")
    return F.when(kind == "date", F.when(delta >= 7, "high").when(delta >= 2, "medium").otherwise("low")).otherwise(by_size)


def level_rank(level: Column) -> Column:
    """C6"""
    order = F.create_map(*[x for i, name in enumerate(("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")) for x in (F.lit(name), F.lit(i))])
    return F.coalesce(order[F.upper(level)], F.lit(1))


def rule_status(used: Column, rate: Column) -> Column:
    """C4"""
    return F.when(used == 0, "unused").when(rate >= 0.7, "effective").when(rate >= 0.4, "partial").otherwise("ineffective")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; null where a vector is."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def vector_profile(v: Column) -> Column:
    """P24"""
    d = v.cast("array<double>")
    mean = F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(d)
    return F.struct(F.size(d).alias("dim"), F.slice(d, 1, 5).alias("first5"), F.array_min(d).alias("low"), F.array_max(d).alias("high"), mean.alias("mean"))


#: Texts whose results are Python objects at the same time.
SLICE = 64


def by_slices(kind: str, f: Callable) -> Callable[[Column], Column]:
    """A function of a text column: f of each text, as kind.

    A batch has up to 10,000 texts, and their results as Python objects take many times
    their size: a slice of them is turned into Arrow before the next is read.
    """

    def of(text: Column) -> Column:
        arrow = to_arrow_type(T._parse_datatype_string(kind))

        @F.arrow_udf(kind)
        def run(texts: pa.Array) -> pa.Array:
            parts = [pa.array([f(t) for t in texts.slice(i, SLICE).to_pylist()], arrow) for i in range(0, len(texts), SLICE)]
            return pa.concat_arrays(parts) if parts else pa.array([], arrow)

        return run(text)

    return of


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """An offline embedding, hashed term frequencies of length 1; null for a null text.

    Counting n terms into slots with column expressions costs n x dim, so this one goes through Arrow.
    """

    def one(t: str | None) -> np.ndarray | None:
        if t is None:
            return None
        slots = [zlib.crc32(w.encode()) % dim for w in _TOKEN.findall(t.lower())]
        counts = np.bincount(slots, minlength=dim).astype(float) if slots else np.zeros(dim)
        norm = np.sqrt((counts * counts).sum())
        return counts / norm if norm else counts

    return by_slices("array<double>", one)(text)
