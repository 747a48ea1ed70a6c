"""Text work that needs a scan with state: Arrow-backed functions, parallel over rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column

from answerlens.functions.text import by_slices

CHUNK = "array<struct<chunk_index:int,text:string,char_count:int>>"
SPAN = "array<struct<text:string,start:int,end:int,closed:boolean>>"
CLAIM = "array<struct<kind:string,value:double,raw:string,start:int,end:int,unit:string,family:string,year_known:boolean>>"


def split_chunks(text: str, size: int = 512, overlap: int = 128) -> list[str]:
    """Lines packed greedily up to size; after a chunk longer than overlap the next starts with its tail, cut after the last full stop.

    Room is counted with one character for each line's end, but for the first line after
    a chunk that left no tail.  A line that is too long for an empty chunk is cut into
    overlapping pieces; one that follows a chunk stays whole.
    """
    out: list[str] = []
    buffer, used = "", 0
    for line in (x.strip() for x in text.split("\n")):
        if not line:
            continue
        if used + len(line) <= size:
            buffer = f"{buffer}\n{line}" if buffer else line
            used += len(line) + 1
        elif buffer:
            out.append(buffer)
            if 0 < overlap < len(buffer):
                tail = buffer[-overlap:]
                stop = tail.rfind("。") if "。" in tail else tail.rfind(".")
                buffer = f"{tail[stop + 1 :] if stop > 0 else tail}\n{line}"
                used = len(buffer)
            else:
                buffer, used = line, len(line)
        else:
            out += [line[i : i + size] for i in range(0, len(line), max(1, size - overlap))]
    return out + [buffer] if buffer else out


def chunks(text: Column, size: int = 512, overlap: int = 128) -> Column:
    return by_slices(CHUNK, lambda t: [{"chunk_index": i, "text": c, "char_count": len(c)} for i, c in enumerate(split_chunks(t or "", size, overlap))])(text)


_STOPS = "。！？!?…"
_MARKS = re.compile("[。！？!?….`\n]")
_CLOSERS = "\"'”’»)]}）】」』"
_SHORT = frozenset("mr mrs ms dr prof st vs etc fig no approx inc ltd co e.g i.e cf".split())
_MARK = re.compile(r"\s*\[(?:doc(?:ument)?\s*|chunk_|文档\s*)?\d+\]", re.IGNORECASE)
_BLOCK = re.compile(r"[ \t]*(?:#{1,6} |[-*•] |\d+[.)、] ?)")


def _code_end(text: str, i: int) -> int:
    """Where the code that begins at i ends, or i."""
    for fence in ("```", "`"):
        if text.startswith(fence, i):
            stop = text.find(fence, i + len(fence))
            return stop + len(fence) if stop >= 0 else i
    return i


def _ends(text: str, i: int, begin: int) -> bool:
    """Whether the full stop at i ends a sentence."""
    before, after = text[i - 1 : i], text[i + 1 : i + 2]
    if before.isalnum() and after.isalnum():
        return False
    j = i
    while j > begin and (text[j - 1].isalnum() or text[j - 1] in "._"):
        j -= 1
    word = text[j:i].lower().strip(".")
    line = text.rfind("\n", 0, i) + 1
    if text[line:i].strip().isdigit():  # the number of a list item
        return False
    if word == "al":
        return not text[:i].lower().endswith("et al")
    return not (word in _SHORT or (len(word) == 1 and word.isalpha() and text[i - 1].isupper()))


def sentence_spans(text: str, final: bool = True) -> list[tuple[str, int, int, bool]]:
    """(text, start, end, closed) with text == source[start:end]; the last one is open if nothing after it shows that it ended."""
    out, begin, i, n = [], 0, 0, len(text)

    def take(end: int, closed: bool) -> None:
        a, b = begin, end
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((text[a:b], a, b, closed))

    while m := _MARKS.search(text, i):  # nothing happens between these
        i = m.start()
        c = text[i]
        if c == "`" and (j := _code_end(text, i)) > i:
            i = j
            continue
        if c == "\n" and (text[i + 1 : i + 2] == "\n" or (i + 1 < n and _BLOCK.match(text, i + 1))):
            take(i, True)
            begin = i = i + 1
            continue
        if c in _STOPS or (c == "." and _ends(text, i, begin)):
            j = i + 1
            while j < n and (text[j] in _STOPS or text[j] == "." or text[j] in _CLOSERS):
                j += 1
            while m := _MARK.match(text, j):
                j = m.end()
            if j >= n:
                break
            take(j, True)
            begin = i = j
            continue
        i += 1
    if final:
        take(n, False)
    elif begin < n:
        out.append((text[begin:], begin, n, False))
    return out


def sentences(text: Column) -> Column:
    return by_slices(SPAN, lambda t: [dict(zip(("text", "start", "end", "closed"), x, strict=True)) for x in sentence_spans(t or "")])(text)


def corrector(typos: dict[str, str]) -> Callable[[Column], Column]:
    """A function of a text column: one pass from left to right, the longest key first; a bounded dictionary."""
    schema = "struct<corrected:string,corrections:array<struct<original:string,corrected:string,position:int>>>"
    pattern = re.compile("|".join(map(re.escape, sorted(typos, key=lambda k: (-len(k), k))))) if typos else re.compile("(?!)")

    def corrected(t: str | None) -> dict:
        found = [{"original": m.group(), "corrected": typos[m.group()], "position": m.start()} for m in pattern.finditer(t or "")]
        return {"corrected": None if t is None else pattern.sub(lambda m: typos[m.group()], t), "corrections": found}

    return by_slices(schema, corrected)


# fixed values: factors to the base unit of each kind
SCALES = {"": 1, "k": 1e3, "thousand": 1e3, "million": 1e6, "billion": 1e9, "百": 1e2, "千": 1e3, "万": 1e4, "亿": 1e8}
SECONDS = {"second": 1, "sec": 1, "minute": 60, "min": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000, "h": 3600, "s": 1, "秒": 1, "分钟": 60, "小时": 3600, "个小时": 3600, "天": 86400, "日": 86400, "工作日": 86400, "个工作日": 86400, "weekday": 86400, "周": 604800, "星期": 604800, "个星期": 604800, "个月": 2592000, "月": 2592000, "年": 31536000}
METRES = {"mm": 1e-3, "cm": 1e-2, "m": 1, "km": 1e3, "meter": 1, "metre": 1, "kilometer": 1e3, "inch": 0.0254, "inches": 0.0254, "foot": 0.3048, "feet": 0.3048, "米": 1, "公里": 1e3, "千米": 1e3, "厘米": 1e-2, "毫米": 1e-3, "英寸": 0.0254, "英尺": 0.3048}
GRAMS = {"mg": 1e-3, "g": 1, "kg": 1e3, "gram": 1, "kilogram": 1e3, "t": 1e6, "ton": 1e6, "tonne": 1e6, "lb": 453.592, "毫克": 1e-3, "克": 1, "千克": 1e3, "公斤": 1e3, "斤": 500, "磅": 453.592, "吨": 1e6}
COUNTERS = ("times", "people", "items", "users", "files", "pages", "个", "件", "次", "份", "条", "项", "人", "名", "台", "套", "页", "张", "只", "位", "款", "种", "遍", "轮", "笔", "单")
CURRENCIES = {"$": "USD", "usd": "USD", "dollar": "USD", "€": "EUR", "eur": "EUR", "euro": "EUR", "£": "GBP", "gbp": "GBP", "pound": "GBP", "¥": "CNY", "cny": "CNY", "rmb": "CNY", "yuan": "CNY", "元": "CNY", "块": "CNY", "人民币": "CNY", "美元": "USD", "美金": "USD", "欧元": "EUR", "日元": "JPY"}
MONTHS = {m: i + 1 for i, m in enumerate("january february march april may june july august september october november december".split())}


def _of(table: dict) -> str:
    return "|".join(map(re.escape, sorted((k for k in table if k), key=len, reverse=True)))


_N = r"(?<![A-Za-z0-9_.])[-+]?\d+(?:,\d{3})*(?:\.\d+)?"
_PLURAL = r"s?(?![A-Za-z])"
PATTERNS = [
    ("date", re.compile(r"(?P<y>(?:19|20)\d{2})[-/.年](?P<m>\d{1,2})[-/.月](?P<d>\d{1,2})日?")),
    ("date", re.compile(rf"(?P<name>{_of(MONTHS)})\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(?P<y>(?:19|20)\d{{2}}))?", re.IGNORECASE)),
    ("date", re.compile(r"(?P<m>\d{1,2})月(?P<d>\d{1,2})日")),
    ("money", re.compile(rf"(?P<n>{_N})\s*(?P<s>{_of(SCALES)})?\s*(?P<u>{_of({k: 0 for k in CURRENCIES if k not in '$€£¥'})}){_PLURAL}", re.IGNORECASE)),
    ("money", re.compile(rf"(?P<u>[$€£¥])\s*(?P<n>\d+(?:,\d{{3}})*(?:\.\d+)?)(?:\s*(?P<s>{_of(SCALES)})(?![A-Za-z]))?", re.IGNORECASE)),
    ("percent", re.compile(rf"百分之\s*(?P<n>\d+(?:\.\d+)?)|(?P<n2>{_N})\s*(?:%|percent\b|个百分点)", re.IGNORECASE)),
    ("duration", re.compile(rf"(?P<n>{_N})[\s-]*(?P<u>{_of(SECONDS)}){_PLURAL}", re.IGNORECASE)),
    ("length", re.compile(rf"(?P<n>{_N})\s*(?P<u>{_of(METRES)}){_PLURAL}", re.IGNORECASE)),
    ("weight", re.compile(rf"(?P<n>{_N})\s*(?P<u>{_of(GRAMS)}){_PLURAL}", re.IGNORECASE)),
    ("count", re.compile(rf"(?P<n>{_N})\s*(?P<u>{'|'.join(COUNTERS)})")),
    ("number", re.compile(rf"(?P<n>{_N})(?P<s>{_of({k: 0 for k in SCALES if k not in ('', 'k')})})?(?![A-Za-z0-9_%])", re.IGNORECASE)),
]
FACTORS = {"duration": SECONDS, "length": METRES, "weight": GRAMS}
BASE_UNIT = {"duration": "s", "length": "m", "weight": "g", "percent": "%", "date": "day"}
_RANGE_BEFORE = re.compile(r"\d\s*(?:-|–|—|~|～|to|至|到)\s*$")
_POINT = re.compile(r"[.:/]\d")
_RANGE_AFTER = re.compile(r"\s*(?:-|–|—|~|～|to|至|到)\s*\d")
_NOISE_BEFORE = re.compile(r"(?:\bv|version\s*|[.:/]|第)$", re.IGNORECASE)
_NOISE_AFTER = re.compile(r"[.:/]\d|[)、]|\.(?:\s|$)")


def find_claims(text: str) -> list[dict]:
    """Quantities in order of priority; a stretch of text makes one claim; members of ranges make none."""
    masked = list(_MARK.sub(lambda m: " " * len(m.group()), text))
    out = []
    for kind, pattern in PATTERNS:
        now = "".join(masked)
        for m in pattern.finditer(now):
            a, b = m.span()
            before = text[max(0, a - 16) : a]
            line_start = now[now.rfind("\n", 0, a) + 1 : a].strip() == ""
            masked[a:b] = " " * (b - a) if kind != "number" else masked[a:b]
            if kind != "date" and (_RANGE_BEFORE.search(before) or _RANGE_AFTER.match(text, b)):
                continue
            if kind == "number" and (_NOISE_BEFORE.search(before) or (_NOISE_AFTER.match(text, b) and line_start) or _POINT.match(text, b)):
                continue
            got = m.groupdict()
            unit, year_known = BASE_UNIT.get(kind, ""), True
            if kind == "date":
                month = MONTHS[got["name"].lower()] if got.get("name") else int(got["m"])
                year_known = bool(got.get("y"))
                try:
                    value = float(date(int(got["y"]) if year_known else 2000, month, int(got["d"])).toordinal())
                except ValueError:
                    continue
            else:
                value = float((got["n"] or got["n2"]).replace(",", "")) * SCALES[(got.get("s") or "").lower()]
                if kind in FACTORS:
                    value *= FACTORS[kind][got["u"].lower()]
                elif kind == "money":
                    unit = CURRENCIES[got["u"].lower()]
                elif kind == "count":
                    unit = got["u"]
            out.append({"kind": kind, "value": value, "raw": text[a:b], "start": a, "end": b, "unit": unit, "family": f"money:{unit}" if kind == "money" else kind, "year_known": year_known})
    return sorted(out, key=lambda c: (c["start"], c["end"]))


def claims(text: Column) -> Column:
    return by_slices(CLAIM, lambda t: find_claims(t or ""))(text)


#: concept -> (phrases that say no, phrases that say yes); a parameter.
CONCEPTS = {
    "support": (("does not support", "not supported", "unsupported", "不支持"), ("supports", "supported", "支持")),
    "refund": (("non-refundable", "no refund", "cannot be refunded", "不可退"), ("refundable", "可退")),
    "refund scope": (("partial refund", "partially refunded", "refunded in part", "部分退款"), ("full refund", "fully refunded", "refunded in full", "全额退款")),
    "cost": (("costs", "is charged", "收费"), ("free of charge", "for free", "免费")),
    "completion": (("not completed", "incomplete", "unfinished", "未完成"), ("completed", "finished", "已完成")),
    "availability": (("is limited", "are limited", "limited to", "limited number", "limited time", "限时", "限量", "有限制"), ("unlimited", "without limit", "no limit", "不限", "无限制")),
    "access": (("unavailable", "not available", "不可用"), ("available", "可用")),
}
_NEGATION = re.compile(r"(?:\bnot|\bno|\bnever|n't|\bcannot|不|未|没有)\s*(?:\w+\s+)?$", re.IGNORECASE)


def find_polarity(text: str, concepts: dict = CONCEPTS) -> list[dict]:
    """Each concept's polarity; phrases that say no are looked for first, and a yes inside one or after a negation is none."""
    low, out = text.lower(), []
    for concept, (no, yes) in concepts.items():
        spans = [(low.find(p), low.find(p) + len(p), p) for p in no if p in low]
        if spans:
            out.append({"concept": concept, "polarity": -1, "phrase": min(spans)[2]})
            continue
        for p in yes:
            at = low.find(p)
            if at >= 0:
                out.append({"concept": concept, "polarity": -1 if _NEGATION.search(low[max(0, at - 40) : at]) else 1, "phrase": p})
                break
    return out


def polarity(text: Column, concepts: dict = CONCEPTS) -> Column:
    return by_slices("array<struct<concept:string,polarity:int,phrase:string>>", lambda t: find_polarity(t or "", concepts))(text)


STRUCTURE = "struct<title:string,sections:array<struct<number:string,title:string,items:array<string>,subsections:array<struct<number:string,title:string,items:array<string>>>>>>"
_SECTION = re.compile(r"(\d+)\.?\s+(.+)")
_SUBSECTION = re.compile(r"(\d+\.\d+)\.?\s+(.+)")
_BULLET = re.compile(r"[-*•·]\s*(.*)")


def structure_of(text: str) -> dict:
    """Title, numbered sections with subsections, bullets as items.

    The title is the first line that begins with neither a digit nor a bullet.  A blank
    line, a section or a subsection gives what was gathered to the open subsection, or
    else to the section in the place of its earlier items.  Plain lines count in a
    section only, not in a subsection.  Bullets of a text without sections make one
    named after the title.
    """
    title, sections, items, sub = None, [], [], None

    def settle() -> None:
        if sub is not None:
            sections[-1]["subsections"].append({**sub, "items": items})
        elif items:
            sections[-1]["items"] = items

    for line in (x.strip() for x in text.split("\n")):
        bullet = _BULLET.fullmatch(line)
        if not line:
            if sections and items:
                settle()
                sub, items = None, []
        elif title is None and not bullet and not line[0].isdecimal():
            title = line
        elif m := _SECTION.fullmatch(line):
            if sections:
                settle()
            sections.append({"number": m[1], "title": m[2], "items": [], "subsections": []})
            sub, items = None, []
        elif m := _SUBSECTION.fullmatch(line):
            if sections and items:
                settle()
            sub, items = {"number": m[1], "title": m[2]}, []
        elif bullet:
            items.append(bullet[1])
        elif sections and sub is None:
            items.append(line)
    if sections:
        settle()
    elif items:
        sections.append({"number": "1", "title": title or "Overview", "items": items, "subsections": []})
    return {"title": title or "", "sections": sections}


def structure(text: Column) -> Column:
    return by_slices(STRUCTURE, lambda t: structure_of(t or ""))(text)
