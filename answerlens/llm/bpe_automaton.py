"""BPE encoding with a tokenization automaton, and decoding by its arc labels.

The merges are compiled into a deterministic automaton over tokens that accepts
exactly the token sequences BPE produces.  It starts with one state in which every
base symbol loops.  The merge (a, b) -> c adds one gadget: the state reached by a
is copied without its b-arc, a-arcs lead to the copy, and c-arcs, set beside the
a-arcs, lead to where b led.  A state is therefore described by the state it was
copied from, the label it lost and when; a label by the label it was set beside
and when.  An arc is looked up along these chains once and then kept in the
transition table.

A pre-split word is encoded from left to right: every prefix of a word has exactly
one accepted tokenization, so each position holds one state, and the transitions
of the tokens that spell the next symbols lead on to later positions.  The distinct words
of a chunk take these steps together, as columns of numbers; a long word takes them alone.
For columns, an arc is found without walking: the states form a tree by what they were
copied from, so whether one lies above another is a question of intervals.

Pre-splitting follows the vocabulary file of the "word" kind: special tokens are
cut out of the raw text; then NFC, lower case; then contractions, runs of letters,
single digits and runs of other marks, white space dropped.

Defined cases: a null text counts as empty; an empty text has no tokens and
decodes to an empty text; an empty table gives no rows; repeated rows give repeated
results; columns other than doc_id and text do not matter; a vocabulary file of
another kind is an error.  What a worker keeps of words met before is bounded in
bytes, so memory grows with the longest text and not with the corpus.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerlens.llm.blocks import give_back

#: About the bytes of long words that one Python worker keeps.
CACHE_BYTES = 48 << 20
#: Words of more bytes are encoded one by one.
LONG = 48
#: Words that take a step together.
TOGETHER = 1 << 14
#: Arcs that a worker remembers for columns, eight bytes each, as a power of two.
REMEMBERED = 20
#: Bytes of text whose distinct pieces are encoded together.
CHUNK = 4 << 20
#: Transitions that one worker keeps, of about 100 bytes each.
TRANSITIONS = 500_000
#: Labels are smaller than this, so a state and a label make one number.
LABELS = 1 << 24


class Recent(dict):
    """What was met lately, of bounded size: when it is full, the half that came first is let go."""

    size = 0

    def keep(self, key, value, size: int):
        """size: bytes that the value holds beside the key; an entry of more than a tenth of the whole isn't kept."""
        size += len(key) + 200
        if 10 * size <= CACHE_BYTES:
            if self.size + size > CACHE_BYTES:
                for old in list(islice(self, len(self) // 2)):
                    del self[old]
                self.size //= 2
            self[key] = value
            self.size += size
        return value


class Automaton:
    """States and labels of the compiled merges; ``target[label]`` is the state after a label."""

    def __init__(self, base: list[int], merges: list[tuple[int, int, int]]):
        self.target = dict.fromkeys(base, 0)
        self.beside: dict[int, tuple[int, int]] = dict.fromkeys(base, (-1, -1))  # label -> (label it was set beside, time)
        self.copied: list[tuple[int, int, int]] = [(-1, -1, -1)]  # state -> (state copied, label lost, time)
        self.table: dict[int, int] = {}
        for time, (a, b, c) in enumerate(merges):
            if c in self.target or a not in self.target or b not in self.target or not self._has(self.target[a], b):
                continue
            after_b = self.target[b]
            self.copied.append((self.target[a], b, time))
            self.target[a] = len(self.copied) - 1
            self.target[c] = after_b
            self.beside[c] = (a, time)
        self._tabulate()

    def _tabulate(self) -> None:
        """The same as arrays: for labels what they were set beside, for states their interval in the tree of copies."""
        top = max(self.target) + 1
        self.targets, self.besides, self.born = (np.full(top, -1, dtype=np.int64) for _ in range(3))
        labels = np.fromiter(self.target, np.int64, len(self.target))
        self.targets[labels] = np.fromiter(self.target.values(), np.int64, len(labels))
        self.besides[labels], self.born[labels] = np.array([self.beside[x] for x in self.target], dtype=np.int64).reshape(-1, 2).T
        origin, lost, made = np.array(self.copied, dtype=np.int64).T
        below = [1] * len(origin)
        for state in range(len(origin) - 1, 0, -1):
            below[origin[state]] += below[state]
        first, free = [0] * len(origin), [1] * len(origin)
        for state, copied in enumerate(origin[1:].tolist(), 1):
            first[state] = free[copied]
            free[copied] += below[state]
            free[state] = first[state] + 1
        self.first = np.array(first, dtype=np.int64)
        # states that lost a label, by label and place in the tree; no state below one of them loses that label again
        keys = lost * LABELS + self.first
        order = np.argsort(keys)
        self.lost, self.lost_end, self.made = keys[order], (keys + below)[order], made[order]
        self.memory = np.full(1 << REMEMBERED, -1, dtype=np.int64)

    def has(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Whether each state has its arc; a place of the memory holds the arc that was asked for last, twice its number, and the answer."""
        keys = states * LABELS + labels
        places = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - REMEMBERED)).view(np.int64)
        known = self.memory[places]
        if (new := np.flatnonzero(known >> 1 != keys)).size:
            known[new] = 2 * keys[new] + self._look(states[new], labels[new])
            self.memory[places[new]] = known[new]
        return known & 1 == 1

    def _look(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """_has() for columns: an arc is gone if a state above lost the label, or while there was none yet, what it was set beside."""
        out, at, before, places = np.ones(len(states), dtype=bool), np.arange(len(states)), np.full(len(states), LABELS), self.first[states]
        while at.size:
            keys, born = labels * LABELS + places, self.born[labels]
            k = np.searchsorted(self.lost, keys, side="right") - 1  # the root lost -1, so there is always one before
            out[at[(self.lost[k] >= labels * LABELS) & (keys < self.lost_end[k]) & (born < self.made[k]) & (self.made[k] <= before)]] = False
            labels = self.besides[labels]
            rest = np.flatnonzero((labels >= 0) & out[at])
            at, labels, places, before = at[rest], labels[rest], places[rest], born[rest]
        return out

    def _has(self, state: int, label: int) -> bool:
        """Whether the state has the arc: the younger of the two is traced back, to what it was made from."""
        while state:
            origin, lost, made = self.copied[state]
            a, born = self.beside[label]
            if born >= made:
                label = a
            elif label == lost:
                return False
            else:
                state = origin
        return True

    def step(self, state: int, label: int) -> int:
        """The next state, or -1."""
        nxt = self.table.get(state * LABELS + label)
        if nxt is None:
            if len(self.table) >= TRANSITIONS:
                self.table.clear()
            nxt = self.table[state * LABELS + label] = self.target[label] if self._has(state, label) else -1
        return nxt


class Trie:
    """The spellings of labels in bytes; the arcs of all nodes share one array, each node's shifted to where they meet no other's."""

    def __init__(self, spelled: dict[bytes, int], closing: dict[bytes, int]):
        nodes: dict[bytes, int] = {b"": 0}
        for word in (*spelled, *closing):
            for k in range(1, len(word) + 1):
                nodes.setdefault(word[:k], len(nodes))
        arcs: dict[int, list[int]] = {}
        for word in islice(nodes, 1, None):
            arcs.setdefault(nodes[word[:-1]], []).append(word[-1])
        self.shift = np.zeros(len(nodes), dtype=np.int64)
        several, window, at = sorted((x for x in arcs if len(arcs[x]) > 1), key=lambda x: -len(arcs[x])), np.arange(1024)[:, None], 0
        single = np.array([x for x in arcs if len(arcs[x]) == 1], dtype=np.int64)
        taken = np.zeros(256 * len(several) + len(single) + 2048, dtype=bool)
        for node in several:
            while (clash := taken[at + window + np.array(arcs[node])].any(axis=1)).all():
                at += len(window)
            at += int(np.argmin(clash))
            self.shift[node] = at
            taken[at + np.array(arcs[node])] = True
        free = np.flatnonzero(~taken[256:])[: len(single)] + 256  # what is left is for nodes of one arc
        self.shift[single] = free - np.array([arcs[x][0] for x in single.tolist()], dtype=np.int64)
        size = int(self.shift.max()) + 256
        self.owner, self.child = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for word, node in islice(nodes.items(), 1, None):
            place = self.shift[nodes[word[:-1]]] + word[-1]
            self.owner[place], self.child[place] = nodes[word[:-1]], node
        self.label = np.full((2, len(nodes)), -1, dtype=np.int64)  # inside a word, and at its end
        for row, found in enumerate((spelled, closing)):
            for word, label in found.items():
                self.label[row, nodes[word]] = label


class Encoder:
    """A vocabulary file of the tokenizers library, of the kind with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        expected_kind(spec)
        model = spec["model"]
        vocab = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        made = {c for *_, c in merges}
        self.names = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.automaton = Automaton([i for i in vocab.values() if i not in made], merges)
        self.vocab = {t: i for t, i in vocab.items() if i in self.automaton.target}
        self.longest = max(map(len, self.vocab)) - len(self.end)
        self.prefixes = {t[:k] for t in self.vocab for k in range(1, len(t) + 1)}
        self.letters = _byte_letters()
        byte = {x: i for i, x in enumerate(self.letters)}
        spelled: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})
        for t, i in self.vocab.items():
            closing = t.endswith(self.end)
            spelled[closing][bytes(map(byte.__getitem__, t.removesuffix(self.end)))] = i
        self.trie = Trie(*spelled)
        names = [self.names.get(i, "") for i in range(max(self.names) + 1)]
        self.written = pa.array(map(str, range(len(names))), pa.large_string()), pa.array(names, pa.large_string())
        self.kept = Recent()

    def word(self, word: str) -> list[int]:
        """Token ids of one pre-split word, or of a special token behind a space."""
        if word[0] == " ":
            return [self.special[word[1:]]]
        ids = self.kept.get(word)
        if ids is None:
            ids = self._encode(word)
            self.kept.keep(word, ids, 8 * len(ids))
        return ids

    def _encode(self, word: str) -> list[int]:
        s = word if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode("utf-8")))
        n, vocab, prefixes = len(s), self.vocab, self.prefixes
        table, step = self.automaton.table, self.automaton.step
        closing = n - self.longest
        dead, path, i, state = set(), [], 0, 0
        options = None
        while True:
            if options is None:  # labels that spell what comes next, the longest last
                options = []
                if i >= closing and (label := vocab.get(s[i:] + self.end)) is not None:
                    nxt = table.get(state * LABELS + label)
                    if (step(state, label) if nxt is None else nxt) >= 0:
                        return [x[2] for x in path] + [label]
                j = i + 1
                while j < n and (part := s[i:j]) in prefixes:
                    if part in vocab:
                        options.append((j, vocab[part]))
                    j += 1
            while options:
                j, label = options.pop()
                if j in dead:
                    continue
                nxt = table.get(state * LABELS + label)
                if nxt is None:
                    nxt = step(state, label)
                if nxt >= 0:
                    path.append((i, state, label, options))
                    i, state, options = j, nxt, None
                    break
            else:
                dead.add(i)  # a position has one accepted state, so it need not be tried again
                i, state, _, options = path.pop()

    def words(self, words: pa.Array) -> pa.Array:
        """Token ids of each of many words, as lists."""
        sizes = pc.binary_length(words).to_numpy()
        alone = (sizes > LONG) | pc.starts_with(words, " ").to_numpy(zero_copy_only=False)
        order = np.argsort(np.where(alone, LONG + 1, sizes), kind="stable")
        short = int((~alone).sum())
        letters = np.frombuffer(words.buffers()[2], dtype=np.uint8)
        starts = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset :][order[:short]]
        parts = [self._together(letters, starts[k : k + TOGETHER], sizes[order[k : min(k + TOGETHER, short)]]) for k in range(0, short, TOGETHER)]
        if short < len(words):
            rest = [self.word(w) for w in words.take(pa.array(order[short:])).to_pylist()]
            parts.append((np.array([len(x) for x in rest], dtype=np.int64), np.array([i for x in rest for i in x], dtype=np.int64)))
        upto = np.concatenate([[0], np.cumsum(np.concatenate([n for n, _ in parts]))]) if parts else np.zeros(1, dtype=np.int64)
        ids = np.concatenate([x for _, x in parts]) if parts else np.zeros(0, dtype=np.int64)
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return pa.LargeListArray.from_arrays(pa.array(upto, pa.int64()), pa.array(ids)).take(pa.array(back))

    def _together(self, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words in ascending order of length: the number of ids of each, and all ids."""
        trie, automaton, longest = self.trie, self.automaton, int(sizes[-1])
        state, label, came = (np.full((longest + 1, len(sizes)), -1, dtype=np.int64) for _ in range(3))
        state[0] = 0
        for i in range(longest):
            at = np.arange(np.searchsorted(sizes, i, side="right"), len(sizes))
            node, j = np.zeros(len(at), dtype=np.int64), i
            while at.size:  # one symbol further in all words that labels may still spell
                places = trie.shift[node] + letters[starts[at] + j]
                on = np.flatnonzero(trie.owner[places] == node)
                at, node, j = at[on], trie.child[places[on]], j + 1
                ended = sizes[at] == j
                new = np.where(ended, trie.label[1, node], trie.label[0, node])
                spelled = np.flatnonzero(new >= 0)
                some, new = at[spelled], new[spelled]
                taken = np.flatnonzero(automaton.has(state[i, some], new))
                some, new = some[taken], new[taken]
                state[j, some], label[j, some], came[j, some] = automaton.targets[new], new, i
                on = np.flatnonzero(~ended)
                at, node = at[on], node[on]
        j, at, n, steps = sizes, np.arange(len(sizes)), np.zeros(len(sizes), dtype=np.int64), []
        if (label[j, at] < 0).any():
            raise ValueError("the vocabulary has no tokens for some word")
        while at.size:
            n[at] += 1
            steps.append((at, label[j, at]))
            j = came[j, at]
            on = np.flatnonzero(j)
            at, j = at[on], j[on]
        ends, ids = np.cumsum(n), np.empty(int(n.sum()), dtype=np.int64)
        for k, (at, new) in enumerate(steps):
            ids[ends[at] - 1 - k] = new
        return n, ids

    def _plain(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text) if not text.isascii() else text
        return self.pattern.findall(text.replace("Σ", "σ").lower())

    def split(self, piece: str) -> list[str]:
        """The words of a piece; a special token stands behind a space."""
        if "<|" not in piece or not self.cut:
            return self._plain(piece)
        return [w for part in self.cut.split(piece) if part for w in ([" " + part] if part in self.special else self._plain(part))]

    def pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and where those of each begin; every distinct word is encoded once."""
        core = pc.utf8_rtrim(pieces, _MARKS)
        easy = pc.match_substring_regex(core, f"^{_LETTERS}$")  # a word, or a word and a run of marks
        is_easy = easy.to_numpy(zero_copy_only=False)
        core, whole = core.filter(easy), pieces.filter(easy)
        marked = pc.not_equal(pc.binary_length(core), pc.binary_length(whole))
        tails = pc.replace_substring_regex(whole.filter(marked), f"^{_LETTERS}", "")
        others = [self.split(p) for p in pieces.filter(pc.invert(easy)).to_pylist()]
        n = np.zeros(len(pieces), dtype=np.int64)
        n[is_easy] = 1 + marked.to_numpy(zero_copy_only=False)
        n[~is_easy] = [len(x) for x in others]
        offsets = np.concatenate([[0], np.cumsum(n)])
        words = pc.dictionary_encode(pa.concat_arrays([pc.utf8_lower(core), tails, pa.array([w for x in others for w in x], pa.large_string())]))
        found, order = words.indices.to_numpy(), np.empty(int(offsets[-1]), dtype=np.int64)
        begin, last = offsets[:-1], np.flatnonzero(is_easy & (n == 2))
        order[begin[is_easy]] = found[: len(core)]
        order[begin[last] + 1] = found[len(core) : len(core) + len(tails)]
        order[np.repeat(~is_easy, n)] = found[len(core) + len(tails) :]
        ids = self.words(words.dictionary).take(pa.array(order))
        return ids.flatten().to_numpy(), ids.offsets.to_numpy()[offsets] - ids.offsets[0].as_py()

    def encode(self, text: str) -> list[int]:
        return [i for p in _split(text) for w in self.split(p) for i in self.word(w)]

    def texts(self, texts: pa.Array, odd: bool = False) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """For each text: the number of ids, the ids joined by spaces, the decoded text.  Every distinct piece is encoded once; odd: whether a text has what only str.split takes for white space."""
        pieces = pc.split_pattern_regex(texts, _WHITE.pattern) if odd else pc.utf8_split_whitespace(texts)
        flat = pc.dictionary_encode(pieces.flatten())
        at, offsets = flat.indices, pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        ids, begin = self.pieces(flat.dictionary)
        n = np.diff(begin)[at.to_numpy()]
        if not n.all():  # a piece without a token leaves no gap
            gone = np.concatenate([[0], np.cumsum(n == 0)])
            at, n, offsets = at.filter(pa.array(n > 0)), n[n > 0], offsets - gone[offsets]
        upto = np.concatenate([[0], np.cumsum(n)])

        def joined(strings: pa.Array) -> pa.Array:
            """What is written for ids, joined in every distinct piece and then in every text."""
            for where, taken in ((begin, pa.array(ids)), (offsets, at)):
                strings = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(where, pa.int64()), strings.take(taken)), pa.scalar(" ", pa.large_string()))
            return strings

        return np.diff(upto[offsets]), *map(joined, self.written)

    def batch(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array]]:
        """texts() for a column of any size, null as empty, a chunk after the other."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        odd = pc.match_substring_regex(texts, _ODD.pattern).to_numpy(zero_copy_only=False)
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK, side="right")))
            yield self.texts(texts.slice(start, stop - start), bool(odd[start:stop].any()))
            start = stop


_ODD = regex.compile("[\x1c-\x1f]")
#: Marks that a word may end with; no special token ends with them, and none of them begins a contraction by itself.
_MARKS = '.,;:!?)]}"$%&#*+-=_~/'
#: Letters that NFC leaves as they are and of which each has one lower-case letter.
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
#: White space as the vocabulary's patterns know it, which is not str.split's.
_WHITE = regex.compile("[\t-\r \x85\xa0  -     　]+")


def _split(text: str) -> list[str]:
    return [p for p in _WHITE.split(text) if p] if _ODD.search(text) else text.split()


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def expected_kind(spec: dict) -> None:
    """Raise unless the file asks for what this module does: NFC, lower case, this splitting, byte letters, suffixed words."""
    model, normaliser, split = spec["model"], spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    kinds = [x["type"] for x in normaliser.get("normalizers", [normaliser])]
    # what a vocabulary of white-space runs made one does not change here, since white space is dropped
    kinds = [k for k in kinds if k != "Replace"]
    steps = [x["type"] for x in split.get("pretokenizers", [])]
    wanted = {
        "model": model.get("type") == "BPE" and bool(model.get("end_of_word_suffix")) and not model.get("continuing_subword_prefix") and not model.get("dropout") and not model.get("byte_fallback") and not model.get("ignore_merges"),
        "normalizer": kinds == ["NFC", "Lowercase"],
        "pre_tokenizer": steps == ["Split", "ByteLevel"],
        "decoder": spec.get("decoder") is None,
    }
    if wrong := [k for k, fine in wanted.items() if not fine]:
        raise ValueError(f"this vocabulary file is of another kind: its {', '.join(wrong)} is not supported")


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One compiled automaton for each vocabulary and Python worker."""
    return Encoder(path)


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _with(docs: DataFrame, path: str | None, schema: str, made: Callable[[np.ndarray, pa.Array, pa.Array], list[pa.Array]]) -> DataFrame:
    """doc_id and what made() gives for the numbers of ids, ids and decoded texts of a chunk."""
    path = path or word_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            ids, start = batch.column(0), 0
            for got in e.batch(batch.column(1)):
                columns = [ids.slice(start, len(got[0])), *made(*got)]
                start += len(got[0])
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *[x.split()[0] for x in schema.split(", ")]])
            give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + schema)


def encode_documents(docs: DataFrame, path: str | None = None, decoded: bool = True) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids (decimal, joined by a space) and, if wanted, the decoded text."""
    return _with(docs, path, "ids string" + ", decoded string" * decoded, lambda n, ids, text: [x.cast(pa.string()) for x in (ids, text)[: 1 + decoded]])


def digest_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def sha(strings: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in strings.cast(pa.large_binary())], pa.string())

    return _with(docs, path, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda n, ids, text: [pa.array(n, pa.int64()), sha(ids), sha(text)])


def op5_bpe_automaton(spark, sf_dir):
    """Every document's token count and the digests of its ids and of the decoded text."""
    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
