"""Removal of long passages that an earlier document holds too, by suffix trees over words.

A suffix starts at every word that has a window of WINDOW words before its text ends. Suffixes are split by prefixes of variable length: a
suffix's prefix runs to the end of its anchor, the run of ANCHOR words with the least hash among its window's, and suffixes whose prefixes end in the same words form a
group. Neighbouring suffixes mostly share an anchor, so a stretch of text goes to its group once, with all of its suffixes. Equal windows have equal
anchors: an anchor of one document alone can't lie in a repeat, and its suffixes never move. Where an anchor has more than LARGE stretches, its suffixes' prefixes are longer,
whole windows: such a prefix is a deep node of the tree by itself, and takes the least document with a minimum before the shuffle.

Every other group's subtree is a sorted array of its suffixes with the common prefix of neighbours: a run of neighbours that share WINDOW words or more is the subtree below one deep internal
node, a repeat that can't be made longer to the right without losing an occurrence; stretches of such starts that follow one another, joined, are maximal to both sides. Groups are worked through in
blocks of about BLOCK_BYTES, so a task's memory is bounded by a block, a group of LARGE stretches or one text.

Rows and values:
  * null texts have no words; texts of fewer than WINDOW words have no window and lose nothing;
  * a null doc_id is neither smaller nor larger than another: such rows keep all words, and remove nothing elsewhere;
  * rows that share a doc_id are told apart, and none of them is earlier than another; of equal texts with other ids only the smallest id's keep their words;
  * an empty table gives an empty one; other columns are ignored; texts are read whole.

Words are compared by 64-bit hashes within a group. Windows of large groups are told by 128 bits beside the anchor's 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm.common import ROW, drop, ids_are_keys, map_arrow, materialise, row_blocks, settled, text_bytes, with_rows
from tactus.llm.words import find_words, hash_words, mix

WINDOW, ANCHOR = 50, 25
#: Windows of one stretch at most, so that repeated words don't make records large.
STRETCH = 256
#: Stretches under an anchor from which its suffixes go by whole windows.
LARGE = 1000
#: Text of a block.
BLOCK_BYTES = 4 << 20
#: An odd multiplier and its inverse modulo 2^64.
_M = 0x9E3779B97F4A7C15
_INVERSE = pow(_M, -1, 1 << 64)


@cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k values: sums of values times powers, modulo 2^64."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    size = 1 << len(h).bit_length()
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(_INVERSE, size)[: len(h)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _powers(_M, size)[:n])


def _least(x: np.ndarray, k: int) -> np.ndarray:
    """The least of each k values in a row."""
    size = 1
    while 2 * size <= k:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (k - size)], x[k - size :]) if k > size else x


def _starts(doc: np.ndarray, window: int) -> np.ndarray:
    """Numbers of the words at which a window of one document starts."""
    n = len(doc) - window + 1
    return np.flatnonzero(doc[:n] == doc[window - 1 :]) if n > 0 else np.zeros(0, np.int64)


def stretches(doc: np.ndarray, h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's hash, number of the first word, windows) of each run of neighbouring windows with one anchor."""
    s = _starts(doc, window)
    if not len(s):
        return np.zeros(0, np.int64), s, s
    least = _least(run_hashes(h, anchor), window - anchor + 1)[s]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1] + 1) | (least[1:] != least[:-1]) | (doc[s[1:]] != doc[s[:-1]])
    at = np.flatnonzero(new)
    within = np.arange(len(s)) - np.repeat(at, np.diff(np.r_[at, len(s)]))
    at = np.flatnonzero(within % STRETCH == 0)
    return least[at].view(np.int64), s[at], np.diff(np.r_[at, len(s)])


def _find_stretches(window: int, anchor: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in row_blocks(whole, "text", BLOCK_BYTES):
                data, at = text_bytes(b["text"])
                doc, first, end = find_words(data, at, "space")
                a, word, n = stretches(doc, hash_words(data, first, end, lower=False), window, anchor)
                base = np.searchsorted(doc, np.arange(b.num_rows))
                of = pa.array(doc[word])
                yield pa.RecordBatch.from_arrays([pa.array(a), b[ROW].take(of), b["doc_id"].take(of), pa.array((word - base[doc[word]]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["anchor", ROW, "doc_id", "first", "n"])

    return run


def _cut_pieces(window: int) -> Callable:
    """Of texts with their shared stretches: the stretch's text, and for stretches of large groups a row for each of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in row_blocks(whole, "text", BLOCK_BYTES):
                data, at = text_bytes(b["text"])
                doc, first, end = find_words(data, at, "space")
                found = b["found"]
                flat, of = found.flatten(), np.repeat(np.arange(b.num_rows), np.diff(found.offsets.to_numpy()))
                a, start, n, large = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("anchor", "first", "n", "large"))
                word = np.searchsorted(doc, of) + start
                raw = memoryview(data)
                small = np.flatnonzero(~large)
                text = [str(raw[i:j], "utf-8") for i, j in zip(first[word[small]].tolist(), end[word[small] + n[small] + window - 2].tolist(), strict=True)]
                yield _pieces(b, of[small], a[small], start[small], n[small], None, None, text)
                if large.any():
                    h = hash_words(data, first, end, lower=False)
                    big = np.flatnonzero(large)
                    one, two = run_hashes(h, window), run_hashes(mix(h ^ np.uint64(_INVERSE)), window)
                    each = np.repeat(big, n[big])
                    on = np.arange(len(each)) - np.repeat(np.cumsum(n[big]) - n[big], n[big])
                    at_word = word[each] + on
                    # a document's repeated windows are alike: each row stands for one start all the same
                    yield _pieces(b, of[each], a[each], start[each] + on, np.ones(len(each), np.int32), one[at_word].view(np.int64), two[at_word].view(np.int64), None)

    return run


def _pieces(b: pa.RecordBatch, of: np.ndarray, a: np.ndarray, first: np.ndarray, n: np.ndarray, one, two, text) -> pa.RecordBatch:
    none = pa.nulls(len(of), pa.int64())
    take = pa.array(of)
    columns = [pa.array(a), b[ROW].take(take), b["doc_id"].take(take), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))]
    columns += [none if one is None else pa.array(one), none if two is None else pa.array(two), pa.nulls(len(of), pa.string()) if text is None else pa.array(text, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["anchor", ROW, "doc_id", "first", "n", "one", "two", "piece"])


def suffix_array(h: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes at starts by their first `window` words, words that each shares with the one before in that order).

    Runs of 1, 2, 4, ... words are ranked; a window is a few of them in a row. Common prefixes are found from the longest runs down.
    """
    ranks = [np.unique(h, return_inverse=True)[1]]
    size = 1
    while 2 * size <= window and len(ranks[-1]) > size:
        low = ranks[-1]
        ranks.append(np.unique(low[:-size].astype(np.int64) * (int(low.max()) + 1) + low[size:], return_inverse=True)[1])
        size *= 2
    parts, at = [], 0
    for level in range(len(ranks) - 1, -1, -1):
        while window - at >= 1 << level:
            parts.append(ranks[level][starts + at])
            at += 1 << level
    order = np.lexsort(parts[::-1])
    i, j = starts[order[:-1]], starts[order[1:]]
    shared = np.zeros(len(i), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        rank, step = ranks[level], 1 << level
        for _ in range(2 if level == len(ranks) - 1 else 1):
            fits = shared + step <= window
            same = fits.copy()
            same[fits] = rank[(i + shared)[fits]] == rank[(j + shared)[fits]]
            shared += step * same
    return order, np.r_[0, shared][: len(order)]


def _repeats(rows: pa.Table, window: int) -> pa.RecordBatch:
    """(row, from, to) of the stretches of words that an earlier document holds too, in whole groups."""
    data, at = text_bytes(rows["piece"])
    piece, first, end = find_words(data, at, "space")
    h = hash_words(data, first, end, lower=False)
    n, doc, start = (rows[k].to_numpy() for k in ("n", "doc_id", "first"))
    of = np.repeat(np.arange(len(n)), n)
    on = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    order, shared = suffix_array(h, np.searchsorted(piece, of) + on, window)
    deep = np.flatnonzero(shared < window)  # the first suffix below each node
    least = np.minimum.reduceat(doc[of[order]], deep) if len(order) else doc[:0]
    gone = np.zeros(len(of), bool)
    gone[order] = doc[of[order]] > np.repeat(least, np.diff(np.r_[deep, len(order)]))
    at = np.flatnonzero(gone)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (of[at[1:]] != of[at[:-1]])
    lo = at[new]
    hi = at[np.r_[new[1:], True]] if len(at) else at
    return pa.RecordBatch.from_arrays([rows[ROW].combine_chunks().take(pa.array(of[lo])), pa.array((start[of[lo]] + on[lo]).astype(np.int32)), pa.array((start[of[hi]] + on[hi] + window).astype(np.int32))], names=[ROW, "from", "to"])


def _subtrees(window: int) -> Callable:
    """Blocks of whole groups of rows that come sorted by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b["piece"].nbytes
            if size < BLOCK_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            anchors = rows["anchor"].to_numpy()
            cut = int(np.searchsorted(anchors, anchors[-1]))  # the last group may go on
            if cut:
                yield from _blocks(rows.slice(0, cut), window)
            held = rows.slice(cut).to_batches()
            size = sum(x["piece"].nbytes for x in held) if cut else 0
        if held:
            yield from _blocks(pa.Table.from_batches(held), window)

    return run


def _blocks(rows: pa.Table, window: int) -> Iterator[pa.RecordBatch]:
    """Blocks of about BLOCK_BYTES between the ends of groups."""
    anchors = rows["anchor"].to_numpy()
    ends = np.flatnonzero(np.r_[anchors[1:] != anchors[:-1], True]) + 1
    sizes = np.cumsum(np.diff(text_bytes(rows["piece"])[1]))[ends - 1]
    at, done = 0, 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK_BYTES, "right")))
        yield _repeats(rows.slice(done, int(ends[to - 1]) - done), window)
        at, done = to, int(ends[to - 1])


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """_row, from, to: stretches of words (numbers from 0, `to` not included) of `docs` that lie in windows which a smaller doc_id holds too. Stretches of a text may overlap.

    docs: _row (a key), doc_id, text.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    anchor = (window + 1) // 2
    docs = docs.select(ROW, "doc_id", "text").where("doc_id is not null")
    found = materialise(map_arrow(docs, _find_stretches(window, anchor), f"anchor long, {ROW} long, doc_id long, first int, n int"), "stretches", "zstd")
    groups = found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("rows"))
    groups = materialise(groups.where("low < high").select("anchor", (F.col("rows") > LARGE).alias("large")), "anchors", "zstd")
    shared = found.join(groups, "anchor").groupBy(ROW).agg(F.collect_list(F.struct("anchor", "first", "n", "large")).alias("found"))
    pieces = docs.join(shared, ROW)
    pieces = materialise(map_arrow(pieces, _cut_pieces(window), f"anchor long, {ROW} long, doc_id long, first int, n int, one long, two long, piece string"), "pieces", "zstd")
    drop(found, groups)
    spans = f"{ROW} long, from int, to int"
    small = pieces.where("piece is not null").select("anchor", ROW, "doc_id", "first", "n", "piece")
    small = map_arrow(small.repartition("anchor").sortWithinPartitions("anchor"), _subtrees(window), spans)
    large = pieces.where("piece is null").select("anchor", "one", "two", ROW, "doc_id", "first")
    key = ["anchor", "one", "two"]
    least = materialise(large.groupBy(*key).agg(F.min("doc_id").alias("least")), "nodes", "zstd")
    large = large.join(least, key).where("doc_id > least").select(ROW, F.col("first").alias("from"), (F.col("first") + window).cast("int").alias("to"))
    return small.unionAll(large)


def _remove() -> Callable[[pa.Array, pa.Array], dict]:
    """Of texts with their spans: number of words, of removed ones, and the kept words joined by one space."""

    def block(texts: pa.Array, spans: pa.Array) -> dict:
        data, at = text_bytes(texts)
        n = len(at) - 1
        doc, first, end = find_words(data, at, "space")
        base = np.searchsorted(doc, np.arange(n + 1))
        flat, of = spans.flatten(), np.repeat(np.arange(n), np.diff(spans.offsets.to_numpy()) if spans.null_count == 0 else [len(x) if x.is_valid else 0 for x in spans])
        marks = np.zeros(len(doc) + 1, np.int64)
        np.add.at(marks, base[of] + flat.field("from").to_numpy(), 1)
        np.add.at(marks, base[of] + flat.field("to").to_numpy(), -1)
        gone = np.cumsum(marks[:-1]) > 0
        kept = np.flatnonzero(~gone)
        goes_on = np.r_[doc[kept[1:]] == doc[kept[:-1]], False][: len(kept)]
        out, edge = np.array(data), np.zeros(len(data) + 1, np.int8)
        out[end[kept[goes_on]]] = 0x20  # the byte after a word is a space, or else no word follows it in the text
        np.add.at(edge, first[kept], 1)
        np.add.at(edge, end[kept] + goes_on, -1)
        mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
        to = np.r_[0, np.cumsum(mask)][at].tolist()
        out = out[mask].tobytes()
        texts = pa.array([out[i:j] for i, j in zip(to[:-1], to[1:], strict=True)], pa.binary())
        return {"n_words": np.diff(base).astype(np.int64), "n_removed": np.bincount(doc[gone], minlength=n).astype(np.int64), "kept": texts}

    return block


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, and the kept words (`kept`) if asked: all but those in windows that a smaller doc_id holds too."""
    slim = docs.select("doc_id", "text")
    keyed = slim.withColumn(ROW, F.col("doc_id")) if ids_are_keys(slim) else with_rows(slim)

    def gather() -> DataFrame:
        return repeated_spans(keyed, window).groupBy(ROW).agg(F.collect_list(F.struct("from", "to")).alias("spans"))

    spans = settled(gather, "spans")
    rows = keyed.join(spans, ROW, "left").select("doc_id", "text", F.coalesce("spans", F.array().cast("array<struct<from:int,to:int>>")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _remove()
        for whole in batches:
            for b in row_blocks(whole, "text", BLOCK_BYTES):
                made = work(b["text"], b["spans"])
                kept = made["kept"]
                digests = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in kept], pa.string())
                columns = [b["doc_id"], pa.array(made["n_words"]), pa.array(made["n_removed"]), digests, *([kept.cast(pa.string())] if with_text else [])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else [])])

    return map_arrow(rows, run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else ""))
