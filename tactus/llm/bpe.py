"""BPE encoding and decoding by a tokenization automaton.

The merges of a vocabulary are compiled, in order, into a deterministic automaton over tokens: it starts as one state that
loops on every base symbol, and each merge (u, v) -> w is a gadget that splits the state reached by u into a copy without
its v arc and adds an arc labelled w that ends where v ended. What the finished automaton accepts are exactly the
token sequences that the merges produce, so every start of a word has one accepted path whose labels spell it. That makes an
automaton over symbols: a transition gives the last token of what has been read. A word is encoded by one table look-up a symbol;
decoding emits the labels of the arcs.

A state differs from the one it was copied from only by the arc it lost, and every arc labelled t ends in one state. So the tables
are small: `target[t]`, `parent[state]`, `lost[(state, t)]` and, for each token, the arc it was made from.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import pickle
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tactus.llm.common import hold, map_texts

WORD_END = "</w>"
#: Words (distinct) that a Python worker remembers; the memory is emptied when full, so its size is bounded.
REMEMBERED = 130_000
#: A word longer than this many symbols isn't remembered.
LONGEST_REMEMBERED = 64
#: States of the automaton over symbols, and arcs of tokens, that a Python worker keeps; the tables are emptied when full.
STATES, TRANSITIONS = 60_000, 200_000
BLOCK_BYTES = 2 << 20

SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class TokenAutomaton:
    """The deterministic tokenization automaton of a merge list."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.labels = {i: s for s, i in vocab.items()}
        self.vocab = vocab
        self.most_steps = TRANSITIONS
        self.steps: dict[tuple[int, int], bool] = {}  # (token before, token) -> whether the arc exists; filled as used
        target: dict[int, int] = {}  # state after an arc labelled t
        parent = [-1]  # the state that this one was copied from
        left: dict[int, int] = {}  # w = uv: u
        rank: dict[int, int] = {}
        made_by = {u + v for u, v in merges}
        for s, i in vocab.items():
            if s not in made_by:
                target[i] = 0
        gone: dict[tuple[int, int], int] = {}  # (state, token) -> rank of the gadget that removed the arc
        self.target, self.parent, self.gone, self.left, self.rank = target, parent, gone, left, rank
        for r, (a, b) in enumerate(merges):
            u, v, w = vocab.get(a), vocab.get(b), vocab.get(a + b)
            if u is None or v is None or w is None or u not in target or v not in target or w in target:
                continue
            q, end = target[u], target[v]
            if not self.arc(q, v):
                continue  # u is never followed by v
            # the gadget: u now leads to a copy of q without its v arc; w leads to where v led from q
            parent.append(q)
            new = len(parent) - 1
            target[u] = new
            gone[(new, v)] = r
            target[w] = end if u != v else q
            left[w] = u
            rank[w] = r
        self._index()

    def _index(self) -> None:
        """Where each state lies in the tree of copies, and the subtrees that lack each token's arc: few, where the way up the tree is long."""
        parent, n = self.parent, len(self.parent)
        size, depth, self.at, free = [1] * n, [0] * n, [0] * n, [1] * n
        for i in range(n - 1, 0, -1):
            size[parent[i]] += size[i]
        for i in range(1, n):  # a state is copied after its parent
            p = parent[i]
            depth[i], self.at[i] = depth[p] + 1, free[p]
            free[p] += size[i]
            free[i] = self.at[i] + 1
        self.depth = depth
        self.lacking: dict[int, list[tuple[int, int, int]]] = {}
        for (state, token), r in self.gone.items():
            self.lacking.setdefault(token, []).append((self.at[state], self.at[state] + size[state], r))

    def _gone(self, state: int, token: int, made: int) -> bool:
        """Whether a gadget of rank `made` or less took the arc from the state or one that it was copied from."""
        where = self.lacking.get(token, ())
        if len(where) <= self.depth[state]:
            at = self.at[state]
            return any(a <= at < b and r <= made for a, b, r in where)
        gone, parent = self.gone, self.parent
        while state >= 0:
            r = gone.get((state, token))
            if r is not None and r <= made:
                return True
            state = parent[state]
        return False

    def arc_of(self, state: int, token: int) -> bool:
        """arc() of the finished automaton."""
        made, u = 1 << 60, token
        while u is not None:
            if self._gone(state, u, made):
                return False
            made, u = self.rank.get(u, -1), self.left.get(u)
        return True

    def arc(self, state: int, token: int) -> bool:
        """Whether the automaton has an arc labelled token out of state."""
        gone, parent, left, rank = self.gone, self.parent, self.left, self.rank
        made = 1 << 60  # arcs of u that were gone when the next label was made of it; for the token itself: gone at any time
        u: int | None = token
        while u is not None:
            s = state
            while s >= 0:  # the gadgets that made this state, latest first
                r = gone.get((s, u))
                if r is not None and r <= made:
                    return False
                s = parent[s]
            made = rank.get(u, -1)
            u = left.get(u)
        return True

    def has_arc(self, before: int, token: int) -> bool:
        """arc_of() after the token `before` (-1: at the start of a word), remembered."""
        ok = self.steps.get((before, token))
        if ok is None:
            if len(self.steps) >= self.most_steps:
                self.steps.clear()
            ok = self.steps[before, token] = self.arc_of(self.target[before] if before >= 0 else 0, token)
        return ok


class State(dict):
    """Symbol -> (next state, last token of what has been read, symbols of that token); missing ones are worked out."""

    __slots__ = ("ends", "node", "step")

    def __missing__(self, symbol: str) -> tuple[State, int, int]:
        return self.step(self, symbol)


class Transitions:
    """The automaton over symbols: what has been read is encoded in one way, so its last token follows from the state and the symbol.

    A state is the longest part of a vocabulary entry that what has been read ends in, and the last tokens of its prefixes within that
    part. Its transitions are worked out once: of the entries that end with the symbol, the one whose arc the token automaton has. A word
    is encoded by one look-up a symbol, and its tokens are picked from its end.
    """

    def __init__(self, automaton: TokenAutomaton, word_end: str, room: float = 1.0):
        self.automaton = automaton
        automaton.most_steps = int(room * TRANSITIONS)
        self.most = int(room * STATES)
        self.word_end = word_end
        leaf: dict[str, int] = {}
        self.next, self.fail, self.depth, self.found = [{}], [0], [0], [()]
        for label, token in automaton.vocab.items():
            node = 0
            for c in self.symbols(label) if token in automaton.target else ():
                to = self.next[node].get(c)
                if to is None:
                    if self.next[node] is leaf:
                        self.next[node] = {}
                    to = self.next[node][c] = len(self.next)
                    self.next.append(leaf)
                    self.fail.append(0)
                    self.depth.append(self.depth[node] + 1)
                    self.found.append(())
                node = to
            if node:
                self.found[node] = ((token, self.depth[node]),)
        queue = [0]
        for node in queue:  # shorter parts first
            for c, to in self.next[node].items():
                if node:
                    self.fail[to] = self.follow(self.fail[node], c) or 0
                self.found[to] += self.found[self.fail[to]]
                queue.append(to)
        self.clear()

    def clear(self) -> None:
        for state in getattr(self, "states", {}).values():
            state.clear()  # no cycles are left for the collector to find
        self.states: dict[tuple, State] = {}
        self.start = self.state(0, (-1,))

    def symbols(self, label: str) -> list[str]:
        """Characters; the end of a word belongs to its last one."""
        n = len(self.word_end)
        if not n or not label.endswith(self.word_end) or len(label) == n:
            return list(label)
        return [*label[: -n - 1], label[-n - 1 :]]

    def follow(self, node: int, symbol: str) -> int | None:
        to = self.next[node].get(symbol)
        while to is None and node:
            node = self.fail[node]
            to = self.next[node].get(symbol)
        return to

    def state(self, node: int, ends: tuple[int, ...]) -> State:
        got = self.states.get((node, ends))
        if got is None:
            got = self.states[node, ends] = State()
            got.node, got.ends, got.step = node, ends, self.step
        return got

    def step(self, state: State, symbol: str) -> tuple[State, int, int]:
        node = self.follow(state.node, symbol)
        for token, size in self.found[node] if node is not None else ():
            if self.automaton.has_arc(state.ends[-size], token):
                break
        else:
            raise ValueError(f"the vocabulary has no token for {symbol!r}")
        got = state[symbol] = self.state(node, (*state.ends, token)[-self.depth[node] - 1 :]), token, size
        return got

    def encode(self, symbols: list[str]) -> list[int]:
        if len(self.states) > self.most:
            self.clear()
        state, read = self.start, []
        for c in symbols:
            got = state[c]
            read.append(got)
            state = got[0]
        at, out = len(read), []
        while at:
            _, token, size = read[at - 1]
            out.append(token)
            at -= size
        out.reverse()
        return out


#: White_Space of the Unicode standard.
_SPACE = r"[\t-\r \x85\xa0  -     　]"


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@cache
def _plane(kind: str) -> str:
    """The code points below U+10000 of a property, as ranges of a character class: re is faster than regex but has no properties."""
    inside = np.array([regex.match(kind, chr(i)) is not None for i in range(1 << 16)])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))).reshape(-1, 2)
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in edges.tolist())


@contextmanager
def _uncollected() -> Iterator[None]:
    """No cyclic collections for a block of texts: encoding makes many lasting objects and no cycles, which the collector would walk over and over."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class _Words(dict):
    """Pre-split word -> (ids in decimal, labels, number of ids); missing words are encoded."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode = encode
        self.most = most

    def __missing__(self, word: str) -> tuple[str, str, int]:
        got = self.encode(word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= self.most:
                self.clear()
            self[word] = got
        return got


@dataclass
class Codec:
    """An automaton with what surrounds it: special tokens, normalisation and the split into words."""

    automaton: TokenAutomaton
    specials: dict[str, int]
    pattern: str
    word_end: str
    low_pattern: str = ""  # pattern for texts without code points from U+10000
    room: float = 1.0  # part of REMEMBERED, STATES and TRANSITIONS that is kept

    def __post_init__(self):
        self.low_pattern = self.low_pattern or regex.sub(r"\\p\{\w+\}", lambda m: _plane(m[0]), self.pattern)
        self._find, self._find_low = regex.compile(self.pattern), re.compile(self.low_pattern)
        self._cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self._hint = os.path.commonprefix(list(self.specials))
        self._bytes = byte_symbols()
        self.furnish(self.room)

    def furnish(self, room: float) -> None:
        """Empty tables of words and transitions, with room for this part of the most that may be kept."""
        self.room = room
        self._known = _Words(self.word, int(room * REMEMBERED))
        self._table = Transitions(self.automaton, self.word_end, room)

    def __getstate__(self):
        return {"automaton": self.automaton, "specials": self.specials, "pattern": self.pattern, "word_end": self.word_end, "low_pattern": self.low_pattern, "room": self.room}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def word(self, word: str) -> tuple[str, str, int]:
        """(ids in decimal, labels, number of ids) of a pre-split word, each joined by spaces."""
        plain = word.isascii() and word.isprintable()
        text = word if plain else "".join([self._bytes[b] for b in word.encode("utf-8")])
        ids = self._table.encode([*text[:-1], text[-1] + self.word_end])
        labels = self.automaton.labels
        return (" ".join(map(str, ids)), " ".join([labels[i] for i in ids]), len(ids))

    def _split(self, text: str) -> list[str]:
        import unicodedata

        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # lower case letter by letter: no final sigma
        text = text.replace("Σ", "σ").lower()
        return (self._find if _ASTRAL.search(text) else self._find_low).findall(text)

    def pieces(self, text: str) -> list[tuple[str, str, int]]:
        """word() of every word and special token of text."""
        known = self._known.__getitem__
        if self._cut is None or self._hint not in text or not self._cut.search(text):
            return list(map(known, self._split(text)))
        out, at = [], 0
        for m in self._cut.finditer(text):
            out += map(known, self._split(text[at : m.start()]))
            i = self.specials[m[0]]
            out.append((str(i), m[0], 1))
            at = m.end()
        out += map(known, self._split(text[at:]))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.pieces(text) for i in p[0].split()]

    def decode(self, ids: list[int]) -> str:
        special = {i: s for s, i in self.specials.items()}
        labels = self.automaton.labels
        return " ".join(special.get(i) or labels[i] for i in ids)


#: What load_codec() knows how to apply: the steps around the model, without the pattern that splits words.
_NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": "", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def _check(spec: dict) -> None:
    """ValueError if the file asks for something that the codec doesn't do: it never encodes in another way than the file says."""
    model = spec["model"]
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    split, *rest = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    asked = {
        "normaliser": steps == _NORMALISERS,  # blanks only part words
        "decoder": spec.get("decoder") is None and spec.get("post_processor") is None,
        "split": split.get("type") == "Split" and "Regex" in split.get("pattern", {}) and split.get("behavior") == "Removed" and bool(split.get("invert")),
        "bytes": [r["type"] for r in rest] == ["ByteLevel"] and not rest[0].get("add_prefix_space") and not rest[0].get("use_regex", True),
        "model": all((model.get(k) or None) == (v or None) for k, v in _MODEL.items()) and bool(model.get("end_of_word_suffix")),
        "special tokens": not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")),
        "symbols": all(x in model["vocab"] for c in byte_symbols() for x in (c, c + model["end_of_word_suffix"])),
    }
    wrong = [k for k, ok in asked.items() if not ok]
    if wrong:
        raise ValueError(f"unsupported tokenizer file: {', '.join(wrong)}")


def load_codec(path: str) -> Codec:
    """Compile the tokenizer file at path: BPE with an end-of-word suffix, byte-level symbols, NFC and lower case."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    _check(spec)
    model = spec["model"]
    split = spec["pre_tokenizer"]["pretokenizers"][0]
    pattern = split["pattern"]["Regex"].replace(r"\s", _SPACE[1:-1])
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return Codec(TokenAutomaton(model["vocab"], merges), specials, pattern, model["end_of_word_suffix"] or "")


def encode_documents(docs: DataFrame, tokenizer: str, with_ids: bool = False, keep: list[str] | None = None, lasting: bool = True, room: float = 1.0) -> DataFrame:
    """Encode and decode every whole text of docs.

    lasting: a Python worker keeps its tables for its next task; otherwise only tasks that run have tables, so idle workers take no memory.
    room: part of REMEMBERED, STATES and TRANSITIONS that a worker keeps: less takes less memory and more time. Neither changes results.

    tokenizer: path of the vocabulary file on the driver; its compiled automaton, whose size is bounded by the vocabulary, is
    broadcast; a file that asks for other steps than the codec's is an error. Very long texts are encoded whole. Returns the columns named in keep (doc_id by default), n_tokens, ids_sha256 and decoded_sha256, and with with_ids also ids
    (array<int>) and decoded. Null and empty texts have no tokens. Repeated rows give repeated rows; an empty table
    gives an empty result. Other columns are dropped.
    """
    compiled = load_codec(tokenizer)
    compiled.furnish(room)
    raw = pickle.dumps(compiled, pickle.HIGHEST_PROTOCOL)
    packed = docs.sparkSession.sparkContext.broadcast(hashlib.md5(raw).digest() + raw)

    def block():
        raw = packed.value
        codec = hold(f"bpe {raw[:16].hex()}", lambda: pickle.loads(raw[16:])) if lasting else pickle.loads(raw[16:])  # with the words that it remembers

        def code(texts: pa.Array) -> dict:
            counts, ids, decoded, lists, shown = [], [], [], [], []
            with _uncollected():
                for text in texts.to_pylist():
                    pieces = codec.pieces(text) if text else []
                    pieces, labels, sizes = zip(*pieces, strict=True) if pieces else ((), (), ())
                    joined, back = " ".join(pieces), " ".join(labels)
                    counts.append(sum(sizes))
                    ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded.append(hashlib.sha256(back.encode()).hexdigest())
                    if with_ids:
                        lists.append(np.array(joined.split(), np.int32))
                        shown.append(back)
            out = {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            return out | ({"ids": pa.array(lists, pa.list_(pa.int32())), "decoded": pa.array(shown, pa.string())} if with_ids else {})

        return code

    return map_texts(docs, keep or ["doc_id"], block, SCHEMA + (", ids array<int>, decoded string" if with_ids else ""), BLOCK_BYTES, holds=lasting)
