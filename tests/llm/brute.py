"""Plain single-process versions that operators are held against."""

import math
import re
import zlib
from collections import Counter, defaultdict

WS = r"[\x20\x09-\x0D]+"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def tokens(text):
    return [w for w in re.split(WS, lower(text)) if w]


def katz(rows, train, order=3, k=5):
    """rows (doc_id, text) -> doc_id: (n_tokens, n_known, N, base, score); the probability of a word after a history; the words; the histories."""
    docs = [(d, (None, *tokens(t), "\n"), tr) for (d, t), tr in zip(rows, train, strict=True)]
    count = {n: Counter(s[i : i + n] for _, s, tr in docs if tr for i in range(n == 1, len(s) - n + 1)) for n in range(1, order + 1)}
    total, v = sum(count[1].values()), len(count[1])
    followed = Counter()
    for n in range(2, order + 1):
        for g, c in count[n].items():
            followed[g[:-1]] += c

    def disc(counts):
        n = Counter(counts.values())
        d = {r: 1 - 0.5 / r for r in range(1, k + 1)}
        if n[1]:
            common = (k + 1) * n[k + 1] / n[1]
            for r in range(1, k + 1):
                if n[r] and common < 1:
                    x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                    if 0 < x < 1:
                        d[r] = x
        return lambda c: c * d[c] if c <= k else c - 0.5

    f = {n: disc(count[n]) for n in count}
    unknown = 1 - sum(f[1](c) / total for c in count[1].values()) if total else 1.0
    after = defaultdict(list)
    for n in range(2, order + 1):
        for g in count[n]:
            after[g[:-1]].append(g[-1])
    weights = {}

    def p(h, w):
        if not h:
            return f[1](count[1][w,]) / total if (w,) in count[1] else unknown
        if (*h, w) in count[len(h) + 1]:
            return f[len(h) + 1](count[len(h) + 1][*h, w]) / followed[h]
        return weight(h) * p(h[1:], w)

    def weight(h):
        if h not in weights:
            weights[h] = (1 - sum(p(h, w) for w in after[h])) / (1 - sum(p(h[1:], w) for w in after[h])) if followed[h] else 1.0
        return weights[h]

    out = {}
    for d, s, _ in docs:
        words = s[1:]
        score = sum(math.log10(p(s[max(0, i + 2 - order) : i + 1], w)) for i, w in enumerate(words))
        out[d] = (len(words), sum((w,) in count[1] for w in words), total, sum(math.log10((count[1][w,] + 1) / (total + v + 1)) for w in words), score)
    return out, p, [*(w for (w,) in count[1]), object()], [*followed, ("never seen",), ("never seen", "bank")]


def bucket(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def shingle_sets(rows, width=5):
    out = []
    for _, t in rows:
        w = tokens(t)
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def jaccard_components(rows, percent=80):
    """rows (doc_id, text) -> doc_id: (set size, smallest doc_id of its component)."""
    s = shingle_sets(rows)
    having = defaultdict(list)
    for i, x in enumerate(s):
        for g in x:
            having[g].append(i)
    parent = list(range(len(s)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, x in enumerate(s):
        shared = Counter(j for g in x for j in having[g] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(x) + len(s[j]) - n):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: (len(s[i]), low[find(i)]) for i, (d, _) in enumerate(rows)}


def repeated(rows, length=400):
    """rows (doc_id, text) -> list of (doc_id, n_bytes, n_removed, n_spans, kept bytes)."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(hash(x[i : i + length]) for x in texts for i in range(len(x) - length + 1))
    out = []
    for (d, _), x in zip(rows, texts, strict=True):
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[hash(x[i : i + length])] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(x), sum(gone), spans, bytes(b for b, g in zip(x, gone, strict=True) if not g)))
    return out
