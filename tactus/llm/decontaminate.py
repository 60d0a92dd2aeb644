"""Benchmark decontamination with a positional inverted index.

Training texts are indexed in segments of bounded size: for each token of a segment, the sorted positions of its
postings, where positions number the words of the segment's texts one after the other with a gap between texts. The
index is a table in the shared folder. Items are cut into phrases by Spark too, and a phrase visits only the segments that hold its rarest term, found by a join with the terms' counts. A segment's
postings of searched terms and the phrases that visit it meet in one task, which holds the postings and lets the phrases stream by; a
phrase starts from its rarest term there and intersects the other terms' lists, shifted by their offsets, until no start is left.
Tokens are stored and looked up as text, so matches are exact. Nothing of the items passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm.common import forget, map_arrow, materialise, new_table_path, row_blocks, text_bytes
from tactus.llm.words import find_words, hash_words, lower_table

WINDOW = 10
#: Text bytes of one segment; a longer text is a segment of its own.
SEGMENT_BYTES = 4 << 20
#: Positions between two texts of a segment, so that no phrase crosses from one to the next.
GAP = 1 << 10

INDEX_SCHEMA = "segment long, token string, n long, doc_ids array<long>, data binary"


def _unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, "<u4"), dtype=np.int64)


def _slices(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    """values[at[i]:at[i+1]] as strings or binaries, without a Python object for each."""
    offsets = (at * values.itemsize).astype(np.int64)
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows of each segment; the row without a token is the segment's directory: ids and word counts of its texts."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    forget()
    for whole in batches:
        for b in row_blocks(whole, "text", SEGMENT_BYTES):
            data, at = text_bytes(b.column("text"))
            doc, first, end = find_words(data, at, "alnum")
            h = hash_words(data, first, end, lower=True)
            counts = np.bincount(doc, minlength=b.num_rows).astype(np.int64)
            # words are numbered through the segment, GAP more at each new text
            position = np.arange(len(doc)) + doc * GAP
            order = np.argsort(h, kind="stable")
            sorted_h, sorted_p = h[order], position[order]
            new = np.flatnonzero(np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]])) if len(h) else np.zeros(0, np.int64)
            # each list as differences, its first one from zero
            step = np.diff(sorted_p, prepend=0)
            step[new] = sorted_p[new]
            lists = _slices(step.astype("<u4"), np.append(new, len(h)), pa.large_binary())
            lead = order[new]
            size = end[lead] - first[lead]
            at_token = np.concatenate([[0], np.cumsum(size)])
            letters = lower_table()[data[np.repeat(first[lead] - at_token[:-1], size) + np.arange(at_token[-1])]]
            tokens = _slices(letters, at_token, pa.large_string())
            ids = b.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(tokens) + 1, number)),
                    pa.concat_arrays([pa.nulls(1, pa.string()), tokens.cast(pa.string())]),
                    pa.array(np.concatenate([[0], np.diff(np.append(new, len(h)))]).astype(np.int64)),
                    pa.array([ids, *[None] * len(tokens)], pa.list_(pa.int64())),
                    pa.concat_arrays([pa.array([counts.astype("<i8").tobytes()], pa.binary()), lists.cast(pa.binary())]),
                ],
                names=["segment", "token", "n", "doc_ids", "data"],
            )
            number += 1


def build_index(docs: DataFrame) -> DataFrame:
    """The positional inverted index of docs (doc_id, text), written as a table in the shared folder."""
    spark = docs.sparkSession
    path = new_table_path(spark, "postings")
    rows = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _segments, INDEX_SCHEMA)
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(INDEX_SCHEMA).parquet(path)


def item_words(text: str | None) -> list[str]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    _, first, end = find_words(data, np.array([0, len(data)]), "alnum")
    low = lower_table()[data].tobytes()
    return [low[s:e].decode("utf-8", "replace") for s, e in zip(first.tolist(), end.tolist(), strict=True)]


class Postings:
    """The postings of one segment for the searched terms."""

    def __init__(self, ids: list, counts: np.ndarray, lists: dict[str, bytes]):
        self.ids, self.counts, self.raw = ids, counts, lists
        self.start = np.cumsum(counts) - counts + np.arange(len(counts)) * GAP
        self.open: dict[str, np.ndarray] = {}

    def list_of(self, token: str) -> np.ndarray:
        got = self.open.get(token)
        if got is None:
            got = self.open[token] = _unpack(self.raw[token])
        return got

    def phrase(self, terms: tuple[str, ...]) -> np.ndarray:
        """Positions where the terms start to stand one after the other."""
        if not all(t in self.raw for t in terms):
            return np.zeros(0, np.int64)
        order = sorted(range(len(terms)), key=lambda i: len(self.raw[terms[i]]))  # the rarest first
        starts = self.list_of(terms[order[0]]) - order[0]
        for i in order[1:]:
            if not len(starts):
                break
            starts = starts[_within(starts + i, self.list_of(terms[i]))]
        return starts

    def near(self, terms: tuple[str, ...], span: int) -> np.ndarray:
        """Positions of the rarest term that have all terms within `span` words on either side, in any order."""
        if not all(t in self.raw for t in terms):
            return np.zeros(0, np.int64)
        rare, *more = sorted(set(terms), key=lambda t: len(self.raw[t]))
        hits = self.list_of(rare)
        doc = self.doc_of(hits)
        low = np.maximum(hits - span, self.start[doc])  # a span of any length stays within its text
        high = np.minimum(hits + span, self.start[doc] + self.counts[doc] - 1)
        for t in more:
            other = self.list_of(t)
            ok = np.searchsorted(other, low, "left") < np.searchsorted(other, high, "right")
            hits, low, high = hits[ok], low[ok], high[ok]
        return hits

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, positions, "right") - 1


def _within(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    i = np.searchsorted(ordered, x)
    i[i == len(ordered)] = 0
    return ordered[i] == x


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Postings]]:
    """Segments from rows sorted by segment, directory first. Only one segment is held at a time."""
    now, ids, counts, lists = None, [], np.zeros(0, np.int64), {}
    for b in batches:
        for segment, token, got, raw in zip(b.column("segment").to_pylist(), b.column("token").to_pylist(), b.column("doc_ids"), b.column("data"), strict=True):
            if segment != now:
                if now is not None:
                    yield now, Postings(ids, counts, lists)
                now, ids, counts, lists = segment, [], np.zeros(0, np.int64), {}
            if token is None:
                ids, counts = got.as_py(), np.frombuffer(raw.as_py(), "<i8")
            else:
                lists[token] = raw.as_py()
    if now is not None:
        yield now, Postings(ids, counts, lists)


def _by_segment(index: DataFrame, terms: DataFrame) -> DataFrame:
    """Directories and the postings of the given terms (a table that has each once), each segment whole and sorted in one partition."""
    wanted = index.where("token is not null").join(terms.select("token"), "token", "left_semi")
    rows = index.where("token is null").unionByName(wanted)
    return rows.repartition("segment").sortWithinPartitions("segment", F.col("token").asc_nulls_first())


MATCH_SCHEMA = "doc_id long, term_set int, first_word long"
FOUND_SCHEMA = "segment long, ordinal int, doc_id long, n_words long, spans array<struct<first:long,end:long>>, phrases array<long>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
#: Kinds of rows that a segment's task sees, in this order.
DIRECTORY, POSTING, PHRASE = 0, 1, 2


def _runs(hit: np.ndarray) -> list[dict[str, int]]:
    """Maximal runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"first": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()]


class _Search:
    """What the phrases that have passed by found in one segment."""

    def __init__(self, number: int, ids: list, counts: np.ndarray):
        self.number, self.seg = number, Postings(ids, counts, {})
        self.hit = np.zeros(int(counts.sum()) + len(ids) * GAP, bool)
        self.found: dict[int, list[int]] = {}

    def visit(self, phrase: int, words: list[str]) -> None:
        starts = self.seg.phrase(tuple(words))
        for i in range(len(words) if len(starts) else 0):
            self.hit[starts + i] = True
        for d in np.unique(self.seg.doc_of(starts)).tolist():
            self.found.setdefault(d, []).append(phrase)

    def rows(self) -> pa.RecordBatch:
        seg, n = self.seg, len(self.seg.ids)
        spans: list = [[]] * n
        for d in self.found:
            s = int(seg.start[d])
            spans[d] = _runs(self.hit[s : s + int(seg.counts[d])])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, self.number)), pa.array(np.arange(n, dtype=np.int32)), pa.array(seg.ids, pa.int64()), pa.array(seg.counts), pa.array(spans, _SPANS), pa.array([self.found.get(d, []) for d in range(n)], pa.list_(pa.int64()))],
            names=["segment", "ordinal", "doc_id", "n_words", "spans", "phrases"],
        )


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with their phrases, from rows sorted by segment and kind."""
    now = None
    for b in batches:
        columns = [b.column(c) for c in ("segment", "kind", "token", "doc_ids", "data", "phrase", "words")]
        for segment, kind, token, ids, raw, phrase, words in zip(*[c.to_pylist() for c in columns[:3]], *columns[3:], strict=True):
            if kind == DIRECTORY:
                if now is not None:
                    yield now.rows()
                now = _Search(segment, ids.as_py(), np.frombuffer(raw.as_py(), "<i8"))
            elif kind == POSTING:
                now.seg.raw[token] = raw.as_py()
            else:
                now.visit(phrase.as_py(), words.as_py())
    if now is not None:
        yield now.rows()


def _windows(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = item_words(text.as_py())
                cut = [words[i : i + window] for i in range(max(1, len(words) - window + 1))] if words else []
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(cut), pa.string()), pa.array(cut, pa.list_(pa.string()))], names=["item", "words"])

    return run


def _near_searcher(term_sets: list[tuple[str, ...]], span: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, seg in _grouped(batches):
            for k, terms in enumerate(term_sets):
                at = seg.near(terms, span)
                d = seg.doc_of(at)
                ids = [seg.ids[i] for i in d.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.full(len(d), k, np.int32)), pa.array(at - seg.start[d])], names=["doc_id", "term_set", "first_word"])

    return search


def find_near(index: DataFrame, term_sets: list[str], span: int) -> DataFrame:
    """Proximity matches: (doc_id, term_set number, word number of its rarest term) where all words of a term set lie within `span` words of that term."""
    sets = [tuple(item_words(t)) for t in term_sets]
    terms = index.sparkSession.createDataFrame([(t,) for t in sorted({t for terms in sets for t in terms})], "token string")
    rows = _by_segment(index, terms)
    return map_arrow(rows, _near_searcher(sets, span), MATCH_SCHEMA)


def find_phrases(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """FOUND_SCHEMA: a row for every text of the index, with the runs of its words that lie in occurrences of phrases (phrase, words), and the numbers of those phrases.

    phrases: a table that can be read again; each phrase once.
    """
    each = phrases.select("phrase", F.explode("words").alias("token"))
    terms = materialise(each.select("token").distinct(), "terms")
    postings = index.where("token is not null")
    counts = materialise(postings.select("token", "n").join(terms, "token", "left_semi").groupBy("token").agg(F.sum("n").alias("n")), "counts")
    # the term with the fewest postings; a phrase with a term that has none is done with
    rarest = each.join(counts, "token", "left").groupBy("phrase").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("r")).where("r.n > 0")
    rarest = materialise(rarest.select("phrase", F.col("r.token").alias("token")), "rarest")
    held = postings.select("segment", "token").join(rarest.select("token").distinct(), "token", "left_semi")
    visits = held.join(rarest, "token").join(phrases, "phrase")
    columns = ["segment", "kind", "token", "doc_ids", "data", "phrase", "words"]

    def of(rows: DataFrame, kind: int) -> DataFrame:
        kinds = {"token": "string", "doc_ids": "array<long>", "data": "binary", "phrase": "long", "words": "array<string>"}
        return rows.withColumn("kind", F.lit(kind)).withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in rows.columns}).select(*columns)

    wanted = postings.join(terms, "token", "left_semi")
    rows = of(index.where("token is null"), DIRECTORY).unionAll(of(wanted, POSTING)).unionAll(of(visits.select("segment", "phrase", "words"), PHRASE))
    return map_arrow(rows.repartition("segment").sortWithinPartitions("segment", "kind"), _search, FOUND_SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items (sorted item ids as strings), spans, contaminated.

    A document word is hit if it lies in an occurrence of `window` consecutive words of an item (of all words, if the item
    has fewer). spans: the runs of hit words [first, end). Null and empty texts have no words; items without words match
    nothing; a null item_id counts as ''. Repeated rows each give a row, a very long text is a segment of its own, and an empty table gives an empty
    result; with an empty benchmark nothing is hit. Both sides may be of any size: a task holds one segment's postings, or one item's words. Other columns are ignored.
    """
    if window > GAP:
        raise ValueError(f"a window has {GAP} words at most")
    index = build_index(docs)
    items = benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    windows = materialise(items.mapInArrow(_windows(window), "item string, words array<string>"), "windows")
    phrases = materialise(windows.select("words").distinct().withColumn("phrase", F.monotonically_increasing_id()), "phrases")
    names = materialise(windows.join(phrases, "words").select("phrase", "item").distinct(), "names")
    found = materialise(find_phrases(index, phrases), "found", "zstd")
    hits = found.where(F.size("phrases") > 0).select("segment", "ordinal", F.explode("phrases").alias("phrase")).join(names, "phrase")
    named = hits.groupBy("segment", "ordinal").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = found.join(named, ["segment", "ordinal"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])  # runs don't overlap
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans").withColumn("contaminated", F.col("n_hit") > 0)
