"""N-gram Jaccard join with several global token orders.

A text is the set of its distinct word k-grams. Two sets of Jaccard similarity t or more share a token within their first
n - ceil(t n) + 1 tokens under any fixed order of all tokens. Candidates come from an inverted index of those prefixes under a
first order that puts rare tokens first. Prefixes under two more orders, as short keys, filter the candidates: a pair must
share a prefix token under these too, and where both prefixes are complete they may not differ by more tokens than
sets of that similarity can. Only pairs that pass all filters are verified on the whole sets.

The first order is by document frequency. It is counted exactly, but only for the tokens in a fixed part of the hash space, some
times as large as a prefix: those come first, then the tokens outside that part by hash, then the few that are in very
many texts. A prefix almost always lies among the counted tokens, and most prefixes only have tokens of a single text, which meet no one.

Equal sets are one class, so copies never multiply. Prefix tokens of up to GROUP classes give pairs. Under a more frequent
token all classes are compared with one of them, the leader h, whole, so that a group of any size costs a row for each member. If x is not
linked with h, then a set y can only be linked with x if both miss the same token of h or both have the same
token outside it: otherwise their intersection lies within x's and h's, and their union holds x's and h's. How many they must share follows
from the sizes, so x and y must share a prefix token of their differences from h, where tokens outside h come first. Those tokens form
the next groups: those of up to DIFFERENCE_GROUP give pairs, larger ones go through a leader again. Leaders go down a fixed order, so this ends; links
between classes that are both linked with a leader add nothing to a component and aren't searched for.

Shingles are 64-bit hashes of their words. Equal sets are told by 96 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tactus.llm.common import ROW, drop, forget, ids_are_keys, map_arrow, materialise, row_blocks, text_bytes, with_rows
from tactus.llm.components import connected_components
from tactus.llm.words import find_words, hash_words, mix, windows

BLOCK_BYTES = 2 << 20
#: Blocks in which heavy tokens are looked for; tokens under FREQUENT of a block's texts aren't reported.
COUNT_BYTES = 4 << 20
FREQUENT = 0.004
#: A token in this share of all classes, or more, comes last in the first order. At most 2 * (mean set size) / FREQUENT tokens are.
HEAVY = 0.002
#: Part of the hash space in which frequencies are counted, in prefixes.
COUNTED = 2
#: Counted tokens that one task compares.
RANGE_TOKENS = 200_000
#: Classes under one token of the first order that are paired directly, and such under one difference from a leader, where few pairs pass.
GROUP, DIFFERENCE_GROUP = 8, 2048
#: Pairs tested at once.
PAIRS_AT_ONCE = 1 << 20
#: The map of texts that are compared whole has about so many bits for each of them, and 2 ** MAP_LIMIT at most; beyond that it prunes less, not wrongly.
MAP_LOAD, MAP_LIMIT = 8, 26

_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89, 0x452821E638D01377], np.uint64)
#: Seeds of the further orders.
_FURTHER = (1, 4)
_LOW = np.uint64(0xFFFFFFFF)


def shingle_sets(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct shingles of each text of a block; fewer words than k: all of them as one."""
    data, at = text_bytes(b.column(b.schema.get_field_index("text")))
    n = b.num_rows
    doc, first, end = find_words(data, at, "space")
    h = hash_words(data, first, end, lower=True)
    i, w = windows(doc, h, k)
    d = doc[i]
    words = np.bincount(doc, minlength=n)
    for j in range(1, k):  # texts of j words
        short = np.flatnonzero(words == j)
        if len(short):
            start = np.searchsorted(doc, short)
            got = h[start]
            for m in range(1, j):
                got = mix(got * np.uint64(j + 2) + h[start + m])
            d, w = np.concatenate([d, short]), np.concatenate([w, mix(got + np.uint64(j))])
    if len(d) and np.any(d[1:] < d[:-1]):
        o = np.argsort(d, kind="stable")
        d, w = d[o], w[o]
    bounds = np.searchsorted(d, np.arange(n + 1))
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        w[s:e].sort()
    keep = np.ones(len(w), bool)
    keep[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    at = np.concatenate([[0], np.cumsum(keep)])[bounds]
    return w[keep], at


def _prints(w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of 64 and 32 bits of each set."""
    out = []
    for seed in _SEEDS[2:4]:
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(w ^ seed))])
        out.append(mix(c[at[1:]] - c[at[:-1]]).view(np.int64))
    return out[0], (out[1] >> 32).astype(np.int32)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def prefix_lengths(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


def _contains(ordered: np.ndarray, w: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(w), bool)
    i = np.searchsorted(ordered, w)
    i[i == len(ordered)] = 0
    return ordered[i] == w


# --- classes and heavy tokens ---------------------------------------------------------------------

_SLIM = "doc_id long, n long, p1 long, p2 int, token long, df long"


def _scan(k: int):
    """Of each text its set's size and fingerprints; of each block the tokens in many of its texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for b in row_blocks(whole, "text", COUNT_BYTES):
                w, at = shingle_sets(b, k)
                p1, p2 = _prints(w, at)
                _, lead = np.unique(p1, return_index=True)  # copies within a block count once
                sets = [w[at[i] : at[i + 1]] for i in lead.tolist()]
                u, c = np.unique(np.concatenate(sets), return_counts=True) if sets else (w, w)
                often = c >= max(4, FREQUENT * len(lead))
                n, m = b.num_rows, int(often.sum())
                own = {"doc_id": b.column("doc_id"), "n": pa.array(np.diff(at)), "p1": pa.array(p1), "p2": pa.array(p2)}
                counts = {"token": pa.array(u[often].view(np.int64)), "df": pa.array(c[often].astype(np.int64))}
                columns = [pa.concat_arrays([v, pa.nulls(m, v.type)]) for v in own.values()] + [pa.concat_arrays([pa.nulls(n, v.type), v]) for v in counts.values()]
                yield pa.RecordBatch.from_arrays(columns, names=[*own, *counts])

    return scan


# --- the first order ----------------------------------------------------------------------

#: A class as it is posted: fingerprints, counted tokens beyond its prefix, tokens that follow.
_CLASS = np.dtype([("p1", "<i8"), ("p2", "<i4"), ("spare", "<i4"), ("tokens", "<i4")])
_POSTED = "range long, classes binary, tokens binary"


def counted_below(percent: int) -> np.uint64:
    """Tokens whose key's low 32 bits are below it are counted."""
    return np.uint64(min(1 << 32, (1 << 32) * COUNTED * (100 - percent) // 100))


def _names(key: np.ndarray, ranges: int) -> np.ndarray:
    """Tokens as a range and 32 bits within it, so that few tokens share a name however many there are."""
    return ((key >> np.uint64(32)) % np.uint64(ranges) << np.uint64(32)) | (key & _LOW)


def _by_owner(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sorted by owner and value, each value of an owner once."""
    o = np.lexsort((values, owner))
    owner, values = owner[o], values[o]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return owner[fresh], values[fresh]


def _postings(k: int, percent: int, ranges: int, packed):
    """The counted tokens of each class that this task meets first, packed by token range; classes whose prefix reaches further also
    post its other tokens, in ranges below zero."""
    limit = counted_below(percent)

    def beyond(w: np.ndarray, need: int, heavy: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Names of the first `need` tokens of a set that follow the counted ones: those outside that part by hash, then heavy ones by frequency."""
        loud = _contains(heavy, w)
        key = mix(w ^ _SEEDS[0])
        outside = np.unique(_names(key[~loud & (key & _LOW >= limit)], ranges))[:need]
        last = w[loud][np.argsort(rank[np.searchsorted(heavy, w[loud])])]
        return np.concatenate([outside, _names(mix(last[: need - len(outside)] ^ _SEEDS[0]), ranges)])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, rank = packed.value
        seen: set[tuple[int, int]] = set()
        for whole in batches:
            for b in row_blocks(whole, "text", BLOCK_BYTES):
                w, at = shingle_sets(b, k)
                size = np.diff(at)
                made = np.zeros(len(size), _CLASS)
                made["p1"], made["p2"] = _prints(w, at)
                new = np.zeros(len(size), bool)
                for i, (n, c) in enumerate(zip(size.tolist(), made[["p1", "p2"]].tolist(), strict=True)):
                    if n and c not in seen:
                        seen.add(c)
                        new[i] = True
                owner = np.repeat(np.arange(len(size)), size)
                key = mix(w ^ _SEEDS[0])
                use = new[owner] & (key & _LOW < limit)
                use[use] = ~_contains(heavy, w[use])
                owner, name = _by_owner(owner[use], _names(key[use], ranges))
                made["spare"] = np.bincount(owner, minlength=len(size)) - prefix_lengths(size, percent)
                at_range = (name >> np.uint64(32)).astype(np.int64)
                o = np.argsort(at_range, kind="stable")
                cuts = np.searchsorted(at_range[o], np.arange(ranges + 1))
                rows = []
                for r in np.flatnonzero(np.diff(cuts)).tolist():
                    i = o[cuts[r] : cuts[r + 1]]
                    docs, count = np.unique(owner[i], return_counts=True)
                    head = made[docs]
                    head["tokens"] = count
                    rows.append((r, head.tobytes(), (name[i] & _LOW).astype("<u4").tobytes()))
                for i in np.flatnonzero(new & (made["spare"] < 0)).tolist():
                    more = beyond(w[at[i] : at[i + 1]], -int(made["spare"][i]), heavy, rank)
                    head = made[i : i + 1].copy()
                    head["tokens"] = len(more)
                    rows.append((-1 - int(made["p1"][i]) % (64 * ranges), head.tobytes(), more.astype("<u8").tobytes()))
                if rows:
                    numbers, heads, tokens = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(heads, pa.binary()), pa.array(tokens, pa.binary())], names=["range", "classes", "tokens"])

    return post


_REPEATED = "token long, p1 long, p2 int, spare int, df int"


def _repeated(t: pa.Table) -> pa.Table:
    """Of one token range the postings of tokens of several classes, with the number of classes; of a range below zero all, without it."""
    number = t.column("range")[0].as_py()
    head = np.concatenate([np.frombuffer(v.as_buffer(), _CLASS) for v in t.column("classes")])
    tokens = np.concatenate([np.frombuffer(v.as_buffer(), "<u8" if number < 0 else "<u4") for v in t.column("tokens")])
    row = np.repeat(np.arange(len(head)), head["tokens"])
    if number < 0:
        df = np.full(len(tokens), -1, np.int32)
    else:
        o = np.argsort(tokens)
        tokens, row = tokens[o], row[o]
        several = np.zeros(len(tokens), bool)
        several[1:] = tokens[1:] == tokens[:-1]
        several[:-1] |= several[1:]
        tokens, row = tokens[several], row[several]
        o = np.lexsort((head["p2"][row], head["p1"][row], tokens))
        tokens, row = tokens[o], row[o]
        fresh = np.ones(len(tokens), bool)  # tasks may repeat a class
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (head["p1"][row[1:]] != head["p1"][row[:-1]]) | (head["p2"][row[1:]] != head["p2"][row[:-1]])
        tokens, row = tokens[fresh], row[fresh]
        start = np.flatnonzero(np.concatenate([np.ones(min(1, len(tokens)), bool), tokens[1:] != tokens[:-1]]))
        count = np.diff(np.append(start, len(tokens)))
        df = np.repeat(np.minimum(count, 1 << 30), count).astype(np.int32)
        keep = df > 1
        tokens, row, df = (tokens[keep].astype(np.int64) | number << 32), row[keep], df[keep]
    return pa.table({"token": tokens.astype(np.int64), "p1": head["p1"][row], "p2": head["p2"][row], "spare": head["spare"][row], "df": df})


def prefix_postings(texts: DataFrame, classes: DataFrame, heavy: np.ndarray, rank: np.ndarray, total: int, k: int, percent: int) -> DataFrame:
    """Members of groups, and df: the tokens of each class's prefix under the first order that other classes have; df is -1 outside the
    counted part. n, d and place aren't set. The more of them, the larger weight: the class is less unlike others."""
    packed = texts.sparkSession.sparkContext.broadcast((heavy, rank))  # bounded through HEAVY
    ranges = int(max(1, total * COUNTED * (100 - percent) / 100 / RANGE_TOKENS))
    repeated = map_arrow(texts, _postings(k, percent, ranges, packed), _POSTED).groupBy("range").applyInArrow(_repeated, _REPEATED)
    # tokens of one class come before all others; of the rest, the `spare` most frequent ones are not in the prefix
    of_class = Window.partitionBy("p1", "p2")
    kept = repeated.withColumn("_place", F.row_number().over(of_class.orderBy(F.desc("df"), F.desc("token")))).where("_place > spare")
    kept = kept.withColumn("weight", F.count("*").over(of_class)).distinct()
    role, zero = F.lit(ALIKE).cast("byte").alias("role"), F.lit(0)
    return kept.join(classes.select("p1", "p2", "rep"), ["p1", "p2"]).select("token", "rep", "weight", role, zero.alias("n"), zero.alias("d"), zero.alias("place"), "df")


# --- whole sets of candidates ------------------------------------------------------------------


def signatures(w: np.ndarray, at: np.ndarray, percent: int) -> list[bytes]:
    """For each set its prefixes under the further orders, as sorted 32-bit keys, one list after the other."""
    m = prefix_lengths(np.diff(at), percent).tolist()
    keys = [(mix(w ^ _SEEDS[o]) >> np.uint64(32)).astype(np.uint32) for o in _FURTHER]
    out = []
    for s, e, k in zip(at[:-1].tolist(), at[1:].tolist(), m, strict=True):
        made = []
        for key in keys:
            own = key[s:e]
            own = np.sort(np.partition(own, k - 1)[:k]) if k < e - s else np.sort(own)
            made.append(own.tobytes())
        out.append(b"".join(made))
    return out


def _slot(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _id_map(ids: DataFrame, n: int) -> tuple[bytes, int]:
    """A bit for the hash of each of n ids, and the number of bits as a power of two: partial maps of each task are joined by word."""
    bits = int(min(MAP_LIMIT, max(12, int(MAP_LOAD * n).bit_length())))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(1 << bits - 6, np.uint64)
        for b in batches:
            slot = _slot(b.column(0).to_numpy(zero_copy_only=False), bits)
            np.bitwise_or.at(words, slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64))
        full = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(words[full].view(np.int64))], names=["word", "bits"])

    out = np.zeros(1 << bits - 6, np.int64)
    for r in map_arrow(ids, mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow().to_batches():
        out[r.column("word").to_numpy()] = r.column("bits").to_numpy()
    return out.tobytes(), bits


def _sets(k: int, percent: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in row_blocks(whole, "text", BLOCK_BYTES):
                w, at = shingle_sets(b, k)
                tokens = pa.array([w[s:e].tobytes() for s, e in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at)), pa.array(signatures(w, at, percent), pa.binary()), tokens], names=["rep", "n", "sig", "tokens"])

    return sets


def sets_of(texts: DataFrame, wanted: DataFrame, k: int, percent: int) -> DataFrame:
    """(rep, n, sig, tokens): the whole sets, and the prefixes under the further orders, of the texts whose doc_id is a rep in wanted."""
    wanted = materialise(wanted, "wanted")
    marks, bits = _id_map(wanted, wanted.count())
    packed = texts.sparkSession.sparkContext.broadcast(marks)  # 2 ** MAP_LIMIT bits at most

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(packed.value, np.uint64)
        for b in batches:
            slot = _slot(b.column("doc_id").to_numpy(zero_copy_only=False), bits)
            yield b.filter(pa.array((words[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))

    # a merge join parts both steps, so a core has one Python worker at a time
    of = map_arrow(texts, marked, texts.schema).join(wanted.hint("merge"), F.col("doc_id") == F.col("rep"), "left_semi")
    out = materialise(map_arrow(of, _sets(k, percent), "rep long, n long, sig binary, tokens binary"), "sets")
    drop(wanted)
    packed.destroy()
    return out


# --- filters and verification -------------------------------------------------------------------


class Filters:
    """Tests of pairs of sets by their sizes and signatures."""

    def __init__(self, percent: int):
        self.percent = percent

    def lists(self, n: int, sig: np.ndarray) -> list[np.ndarray]:
        """The prefixes of a signature, each key once."""
        m = prefix_length(n, self.percent)
        return [np.unique(sig[i * m : (i + 1) * m]) for i in range(len(_FURTHER))]

    def limit(self, n: int, prefix: np.ndarray) -> int:
        """Keys below it that a set of n tokens has are all in its prefix."""
        return int(prefix[-1]) if prefix_length(n, self.percent) < n else 1 << 33

    def pair(self, n1: int, a: list[np.ndarray], n2: int, b: list[np.ndarray]) -> bool:
        if min(n1, n2) * 100 < self.percent * max(n1, n2):
            return False
        most = most_apart(n1, n2, self.percent)
        for x, y in zip(a, b, strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            if not both:
                return False
            to = min(self.limit(n1, x), self.limit(n2, y))
            if np.searchsorted(x, to) + np.searchsorted(y, to) - 2 * both > most:
                return False
        return True


def _filter_pairs(percent: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = Filters(percent)
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for i, (n1, n2, x, y) in enumerate(zip(b.column("n1").to_pylist(), b.column("n2").to_pylist(), b.column("x"), b.column("y"), strict=True)):
                ok[i] = filters.pair(n1, filters.lists(n1, np.frombuffer(x.as_buffer(), np.uint32)), n2, filters.lists(n2, np.frombuffer(y.as_buffer(), np.uint32)))
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return keep


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = int(_contains(a, b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("x"), b.column("y"), strict=True)):
                ok[i] = _similar(*(np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y)), percent)
            yield b.select(["src", "dst"]).filter(pa.array(ok))

    return verify


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (src, dst) among pairs (a, b) of classes: filters of the further orders first, then whole sets."""
    sig = lambda s, n, x: sets.select(F.col("rep").alias(s), F.col("n").alias(n), F.col("sig").alias(x))
    alike = F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent
    sizes = pairs.join(sig("a", "n1", "x").drop("x"), "a").join(sig("b", "n2", "y").drop("y"), "b").where(alike).select("a", "b")
    left = materialise(map_arrow(sizes.join(sig("a", "n1", "x"), "a").join(sig("b", "n2", "y"), "b"), _filter_pairs(percent), "a long, b long"), "survivors")
    x, y = (sets.select(F.col("rep").alias(r), F.col("tokens").alias(t)) for r, t in (("src", "x"), ("dst", "y")))
    links = left.select(F.col("a").alias("src"), F.col("b").alias("dst")).join(x, "src").join(y, "dst")
    out = materialise(map_arrow(links, _verify(percent), "src long, dst long"), "links")
    drop(left)
    return out


# --- groups of any size: leaders and differences from them -----------------------------------------

#: Parts that rows of a group play: any two ALIKE ones may be linked; of the others, a PROBE with a LINKED one.
ALIKE, PROBE, LINKED = 0, 1, 2
_JUDGED = "leader long, rep long, weight long, linked boolean, n int, d int, differences binary"
_MEMBERS = "token long, rep long, weight long, role byte, n int, d int, place int"


def most_apart(n1, n2, percent: int):
    """Most tokens in which similar sets of these sizes differ."""
    return n1 + n2 - 2 * -(-percent * (n1 + n2) // (100 + percent))


def shared_at_least(n: int, d: int, n_leader: int, percent: int) -> int:
    """Fewest differences from a leader that a set of n tokens and d differences shares with a similar set, if one of both isn't linked with the leader.

    Sets x, y share (dx + dy - |x - y|) / 2 of them, |x - y| is at most c (nx + ny) with c = (1 - t) / (1 + t), and of
    one that isn't linked d is over c (n + n_leader) - 2.
    """
    return max(1, -(-((d - 1) * (100 + percent) + (100 - percent) * (n_leader - n)) // (2 * (100 + percent))))


def differences(leader: np.ndarray, own: np.ndarray, percent: int) -> tuple[bool, int, np.ndarray]:
    """Whether two sets are similar, the size of their difference, and the prefix of it that own posts: own's tokens that leader misses, then leader's that own misses, each by hash."""
    inside = _contains(leader, own)
    both = int(inside.sum())
    d = len(leader) + len(own) - 2 * both
    linked = d <= most_apart(len(leader), len(own), percent)
    length = d - shared_at_least(len(own), d, len(leader), percent) + 1
    if not linked:  # it may meet linked sets of few differences
        length = max(length, (100 - percent) * len(own) // percent + 1)
    more = own[~inside]
    more = more[np.argsort(mix(more))][:length]
    if len(more) < length:
        lost = leader[~_contains(own, leader)]
        more = np.concatenate([more, lost[np.argsort(mix(lost))][: length - len(more)]])
    return linked, d, more


def _against(percent: int):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked, n, apart, found = [], [], [], []
            leaders = mix(b.column("leader").to_numpy().view(np.uint64))
            for i, (h, x) in enumerate(zip(b.column("h"), b.column("x"), strict=True)):
                own = np.frombuffer(x.as_buffer(), np.uint64)
                near, d, more = differences(np.frombuffer(h.as_buffer(), np.uint64), own, percent)
                linked.append(near)
                n.append(len(own))
                apart.append(d)
                found.append(mix(more + leaders[i]).tobytes())
            made = [pa.array(linked, pa.bool_()), pa.array(n, pa.int32()), pa.array(apart, pa.int32()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("leader", "rep", "weight")), *made], names=["leader", "rep", "weight", "linked", "n", "d", "differences"])

    return judge


def _opened(percent: int):
    """Members of groups: a row for each difference, of sets that aren't linked once as ALIKE, as far as that reaches, and once as PROBE."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [np.frombuffer(v.as_buffer(), np.uint64) for v in b.column("differences")]
            n, d, linked = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n", "d", "linked"))
            short = np.array([x - shared_at_least(y, x, h, percent) + 1 for y, x, h in zip(n.tolist(), d.tolist(), b.column("n_leader").to_pylist(), strict=True)], np.int64)
            sizes = np.array([len(v) for v in lists], np.int64)
            row = np.repeat(np.arange(b.num_rows), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            token = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
            alike = np.flatnonzero(~linked[row] & (place < short[row]))
            role = np.concatenate([np.full(len(alike), ALIKE), np.where(linked[row], LINKED, PROBE)]).astype(np.int8)
            token, row, place = np.concatenate([mix(token[alike]), token]), np.concatenate([row[alike], row]), np.concatenate([place[alike], place])
            take = lambda c: b.column(c).take(pa.array(row))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), take("rep"), take("weight"), pa.array(role), take("n"), take("d"), pa.array(place.astype(np.int32))], names=["token", "rep", "weight", "role", "n", "d", "place"])

    return opened


def _pairs(percent: int):
    """Pairs (a, b) of the members of each token that may be linked, from rows sorted by token; holds a batch and one group.

    The differences from the shared one on must be enough to make two members similar; if it isn't the first one that they share,
    the first one's group finds the pair. Members without n, d and place always pass.
    """

    def fits(role, n, d, place, i, j) -> np.ndarray:
        roles = role[i] + role[j]
        both = 2 * np.minimum(d[i] - place[i], d[j] - place[j]) >= d[i] + d[j] - most_apart(n[i], n[j], percent)
        return both & ((roles == PROBE + LINKED) | (roles == 2 * ALIKE))

    def settle(token, rep, *rest) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(start, len(token)))
        for s in np.unique(size[size > 1]).tolist():
            i, j = np.triu_indices(s, 1)
            firsts = start[size == s]
            for f in np.array_split(firsts, -(-len(firsts) * len(i) // PAIRS_AT_ONCE)):
                x, y = (f[:, None] + i).ravel(), (f[:, None] + j).ravel()
                ok = fits(*rest, x, y)
                x, y = rep[x[ok]], rep[y[ok]]
                yield np.minimum(x, y), np.maximum(x, y)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def rows(columns):
            for x, y in settle(*columns):
                apart = x != y  # a row may be there twice
                x, y = np.unique(np.stack([x[apart], y[apart]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

        for b in batches:
            columns = [b.column(c).to_numpy().astype(np.int64) for c in ("token", "rep", "role", "n", "d", "place")]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            if not len(columns[0]):
                continue
            last = int(np.searchsorted(columns[0], columns[0][-1], "left"))
            held = [x[last:] for x in columns]
            if last:
                yield from rows([x[:last] for x in columns])
        if held is not None and len(held[0]):
            yield from rows(held)

    return pairs


def pairs_within(members: DataFrame, percent: int) -> DataFrame:
    """Pairs a < b that may be linked among the members of each token, all groups of which are small."""
    dealt = members.select("token", "rep", "role", "n", "d", "place").repartition("token").sortWithinPartitions("token")
    return map_arrow(dealt, _pairs(percent), "a long, b long").distinct()


def _groups(members: DataFrame) -> DataFrame:
    """Of each token whose members may be linked: their number, and the leader: of the greatest weight, of those the smallest."""
    top = F.max(F.struct("weight", (-F.col("rep")).alias("other"))).alias("top")
    of = lambda role: F.count_if(F.col("role") == role).alias(f"r{role}")
    counted = members.groupBy("token").agg(of(ALIKE), of(PROBE), of(LINKED), top)
    return counted.where("r0 > 1 or r1 > 0 and r2 > 0").select("token", F.expr("r0 + r1 + r2").alias("members"), "top")


def _led(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(leader, rep, weight): members of groups with those that lead them."""
    tops = groups.select("token", (-F.col("top.other")).alias("leader"))
    return members.join(tops, "token").where("rep <> leader").select("leader", "rep", "weight").distinct()


def _through_leaders(led: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Of (leader, rep, weight): the links (src, dst), pairs (a, b) that are still to be verified, and what the leaders of the next groups lead."""
    h = sets.select(F.col("rep").alias("leader"), F.col("tokens").alias("h"))
    x = sets.select("rep", F.col("tokens").alias("x"))
    judged = materialise(map_arrow(led.join(x, "rep").join(h, "leader"), _against(percent), _JUDGED), "judged")
    links = materialise(judged.where("linked").select(F.col("leader").alias("src"), F.col("rep").alias("dst")), "links")
    open_ = judged.where("not linked").select("leader").distinct().join(sets.select(F.col("rep").alias("leader"), F.col("n").alias("n_leader")), "leader")
    rows = materialise(map_arrow(judged.join(open_, "leader").drop("leader"), _opened(percent), _MEMBERS), "members")
    groups = materialise(_groups(rows), "groups")
    pairs = materialise(pairs_within(rows.join(groups.where(F.col("members") <= DIFFERENCE_GROUP).select("token"), "token"), percent), "pairs")
    led = materialise(_led(rows, groups.where(F.col("members") > DIFFERENCE_GROUP)), "led")
    drop(judged, rows, groups)
    if led.isEmpty():
        drop(led)
        return links, pairs, None
    return links, pairs, led


# --- the join -------------------------------------------------------------------------------


def jaccard_join(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, class_id, component_id.

    Words are runs of other than blank and 0x09-0x0D, A-Z lowered. Sets link when 100 * intersection >= percent * union;
    class_id is the smallest doc_id with the same set, component_id the smallest doc_id that links reach. Without words
    (null, empty or blank text) a text has an empty set, links with nothing and is its own component. Very long texts are read whole, in
    blocks. Repeated rows fall into one class; a row without doc_id links like any other and takes the ids of its class and component, null
    if no row there has one. An empty table gives an empty result. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    if ids_are_keys(texts):
        return _joined(texts, k, percent)
    keyed = with_rows(texts)
    joined = _joined(keyed.select(F.col(ROW).alias("doc_id"), "text"), k, percent).withColumnRenamed("doc_id", ROW)
    found = materialise(joined.join(keyed.select(ROW, "doc_id"), ROW), "numbered")
    drop(keyed)
    for c in ("class_id", "component_id"):
        least = found.where("n_shingles > 0").groupBy(c).agg(F.min("doc_id").alias("_least"))
        found = found.join(least, c, "left").withColumn(c, F.when(F.col("n_shingles") > 0, F.col("_least")).otherwise(F.col("doc_id"))).drop("_least")
    return found.select("doc_id", "n_shingles", "class_id", "component_id")


def _joined(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """jaccard_join() of texts (doc_id, text) whose doc_ids are keys."""
    scanned = materialise(map_arrow(texts, _scan(k), _SLIM), "shingle_counts")
    slim = scanned.where("token is null").select("doc_id", "n", "p1", "p2")
    total = slim.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    heavy = scanned.where("token is not null").groupBy("token").agg(F.sum("df").alias("df")).where(F.col("df") >= max(16, HEAVY * total[0])).toArrow()  # bounded through HEAVY
    hashes, frequency = heavy.column("token").to_numpy().view(np.uint64), heavy.column("df").to_numpy()
    o = np.argsort(hashes)
    hashes, frequency = hashes[o], frequency[o]
    rank = np.empty(len(hashes), np.int64)
    rank[np.lexsort((hashes, frequency))] = np.arange(len(hashes))

    classes = materialise(slim.where("n > 0").groupBy("p1", "p2").agg(F.min("doc_id").alias("rep")), "classes")
    postings = materialise(prefix_postings(texts, classes, hashes, rank, total[1], k, percent), "prefixes")
    rare = F.col("df").between(2, GROUP)
    pairs = [materialise(pairs_within(postings.where(rare), percent), "pairs")]
    often = postings.where(~rare)
    led = materialise(_led(often, _groups(often)), "led")
    drop(postings)

    wanted = pairs[0].select(F.explode(F.array("a", "b")).alias("rep")).unionAll(led.select(F.explode(F.array("leader", "rep")).alias("rep"))).distinct()
    sets = sets_of(texts, wanted, k, percent)
    links = []
    while led is not None:
        found, more, after = _through_leaders(led, sets, percent)
        drop(led)
        links.append(found)
        pairs.append(more)
        led = after
    links.append(verified(reduce(DataFrame.unionAll, pairs).distinct(), sets, percent))
    drop(sets, *pairs)
    components = connected_components(reduce(DataFrame.unionAll, links))
    drop(*links)
    named = classes.join(components.withColumnRenamed("node", "rep"), "rep", "left").select("p1", "p2", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
    full = slim.join(named, ["p1", "p2"], "left")
    return full.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce(F.when(F.col("n") > 0, F.col("class_id")), F.col("doc_id")).alias("class_id"),
        F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id")).alias("component_id"),
    )
