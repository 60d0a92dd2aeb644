"""Sharding by histogram sort.

Rows are ordered by a 64-bit key whose upper part is a hash of the text and whose lower part is a hash
of the id, so equal texts are neighbours and a large group of them can still be cut anywhere. The key of each splitter is
found by counting the exact bytes below candidate keys in every partition, and narrowing the candidates round by round;
the driver sees only the counts of at most `probes` candidates for each splitter. Rows then move once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.llm.common import materialise

SHARDS = 40
#: Bytes that each row is charged besides its text.
ROW_OVERHEAD = 16
#: Keys that one counting task reads, at least: fewer tasks send fewer partial counts.
ROWS_A_TASK = 2_000_000
#: Texts of a cell, which one task numbers.
CELL_BYTES = 64 << 20
TOP = (1 << 63) - 1


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_OVERHEAD


def _crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")


def sort_key(text: Column, doc_id: Column) -> Column:
    """39 bits of md5(text), then 24 bits of md5(doc_id as text): a non-negative long. Nulls hash as ''."""
    hex10 = F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 10)
    hex6 = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 6)
    high = F.conv(hex10, 16, 10).cast("long").bitwiseAND(F.lit((1 << 39) - 1))
    return F.shiftleft(high, 24) + F.conv(hex6, 16, 10).cast("long")


def _cells(key: str, weights: list[str], bounds: np.ndarray) -> object:
    """A partition function: the sum of each weight between consecutive bounds (bounds[i] <= key)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(weights), len(bounds) + 1), np.int64)
        for b in batches:
            at = np.searchsorted(bounds, b.column(key).to_numpy(zero_copy_only=False), "right")
            for row, w in zip(total, weights, strict=True):
                np.add.at(row, at, b.column(w).to_numpy(zero_copy_only=False))
        full = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_pydict({"cell": full.astype(np.int64)} | {w: row[full] for w, row in zip(weights, total, strict=True)})

    return count


def histogram(rows: DataFrame, key: str, weights: list[str], bounds: np.ndarray) -> np.ndarray:
    """weights x (bounds + 1) exact sums; partitions send one row for each cell they touch."""
    schema = "cell long, " + ", ".join(f"{w} long" for w in weights)
    part = rows.select(key, *weights).mapInArrow(_cells(key, weights, bounds), schema)
    out = np.zeros((len(weights), len(bounds) + 1), np.int64)
    for r in part.groupBy("cell").agg(*[F.sum(w).alias(w) for w in weights]).collect():
        out[:, r["cell"]] = [r[w] for w in weights]
    return out


def targets(total: int, parts: int) -> np.ndarray:
    return np.array([-(-total * k // parts) for k in range(1, parts)], np.int64)


def splitters(rows: DataFrame, key: str, weight: str, parts: int, tolerance: float = 0.0, probes: int = 48, most_rounds: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """parts-1 keys s[k]: the weight of keys below s[k] is the nearest to total*k/parts that a key gives, within tolerance; equally near ones: the larger.

    Also the keys of several rows each, across which a boundary lies by more than the tolerance.

    tolerance: share of one part by which a splitter may be off; 0 refines until the splitter is the exact key,
    which makes the result independent of how the rows are partitioned.
    """
    # for splitter k: below(lo) < target <= below(hi), where below(x) is the weight of keys < x
    lo, hi = np.zeros(parts - 1, np.int64), np.full(parts - 1, TOP, np.int64)
    at_lo, at_hi = np.zeros(parts - 1, np.int64), np.zeros(parts - 1, np.int64)
    target, off = None, 0.0
    done, alike = np.zeros(parts - 1, bool), np.zeros(parts - 1, bool)
    for _ in range(most_rounds):
        open_ = np.flatnonzero((hi - lo > 1) & ~done)
        if not len(open_):
            break
        fine = probes if target is not None else max(probes, 2 * parts)  # all start with the same interval
        grid = [lo[k] + ((hi[k] - lo[k]) // (fine + 1) + 1) * np.arange(1, fine + 1, dtype=np.int64) for k in (open_ if target is not None else open_[:1])]
        bounds = np.unique(np.concatenate([g[(g > lo.min()) & (g < TOP)] for g in grid] + [lo[open_], hi[open_]]))
        sums, counts = histogram(rows, key, [weight, "one"], bounds) if weight != "one" else np.repeat(histogram(rows, key, ["one"], bounds), 2, axis=0)
        below = np.cumsum(sums)[:-1]  # weight of keys < bounds[i]
        if target is None:
            total = int(sums.sum())
            target = targets(total, parts)
            off = tolerance * total / parts
            at_hi[:] = total
        for k in open_:
            i = int(np.searchsorted(below, target[k], "left"))  # the last bound is above every key
            lo[k], at_lo[k] = (bounds[i - 1], below[i - 1]) if i else (0, 0)
            hi[k], at_hi[k] = bounds[i], below[i]
            done[k] = at_hi[k] - target[k] <= off or counts[i] <= 1  # one row alone lies across the boundary
            alike[k] = not done[k] and hi[k] - lo[k] == 1
    if target is None:
        return hi, hi[:0]
    return np.where(at_hi - target <= target - at_lo, hi, lo), np.unique(lo[alike])


def cell_of(key: Column, bounds: np.ndarray) -> Column:
    """Number of bounds at or below key: first among every so many, then among those between two of these."""
    if not len(bounds):
        return F.lit(0).cast("long")
    width = max(1, int(len(bounds) ** 0.5))
    runs = F.from_json(F.lit(json.dumps([bounds[i : i + width].tolist() for i in range(0, len(bounds), width)])), "array<array<bigint>>")
    heads = F.from_json(F.lit(json.dumps(bounds[::width].tolist())), "array<bigint>")
    run = F.size(F.filter(heads, lambda b: b <= key))
    within = F.size(F.filter(F.get(runs, run - 1), lambda b: b <= key))
    # never null, or else a filter on the result would work the key out once more for each bound
    return F.coalesce(F.when(run == 0, 0).otherwise((run - 1) * width + within).cast("long"), F.lit(0).cast("long"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, tolerance: float = 0.0, keep: list[str] | None = None) -> DataFrame:
    """Put every row of docs (doc_id, text, ...) into shards 0..shards-1 of near-equal bytes.

    Returns doc_id, size, text_crc32, shard, slot and the columns named in `keep` (for example text). Law `bytes`: in key order, the boundary of two shards
    is that between rows which lies nearest to its share of all bytes, so a row goes where its middle lies, and no shard is further than the largest row from
    the mean. Equal texts are neighbours in the order, and a group of copies is cut only where a boundary falls into it. slot is gapless from 0 within a shard, in key order, then by doc_id.
    Null or empty text: size 16, crc32 of nothing. Rows that repeat an id and its text, ids null or not, share a key and are interchangeable: where a boundary falls among them they are numbered in their
    parts of the table, and the number says on which side each lies. Very long texts move as a row. An empty table gives an empty result. Extra columns are ignored unless named in `keep`.
    With text in `keep` the whole text moves once to its shard, and size and text_crc32 are those of the text that arrived.
    """
    keep = keep or []
    size = row_size(F.col("text")).alias("size")
    key = sort_key(F.col("text"), F.col("doc_id")).alias("sort_key")
    kept = [F.col(c).alias(f"_keep_{c}") for c in keep]
    moved = "text" in keep
    if moved:
        rows = docs.select("doc_id", key, *kept)
        slim = docs.select(size, key)
    else:
        rows = docs.select("doc_id", size, _crc(F.col("text")), key, *kept)
        slim = rows.drop(*[f"_keep_{c}" for c in keep])
    slim = materialise(slim.withColumn("one", F.lit(1).cast("long")), "shard_keys")
    rows = rows if keep else slim.drop("one")
    count, total = slim.agg(F.count("*"), F.sum("size")).first()
    if not count:
        return docs.select("doc_id", size, _crc(F.col("text")), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), *keep)
    slim = slim.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, count // ROWS_A_TASK))
    cut, alike = splitters(slim, "sort_key", "size", shards, tolerance)
    # cells: about equal bytes, and never across a shard boundary; they give each slot its offset
    n_cells = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // CELL_BYTES)
    even, heavy = splitters(slim, "sort_key", "size", n_cells, tolerance=0.5, probes=4)
    alike = np.unique(np.concatenate([alike, heavy]))
    bounds = np.unique(np.concatenate([cut, even, alike, alike + 1]))
    sizes, counts = histogram(slim, "sort_key", ["size", "one"], bounds)
    first = np.concatenate([[np.iinfo(np.int64).min], bounds])  # first key of each cell
    rank, before = np.cumsum(counts) - counts, np.cumsum(sizes) - sizes
    # the rank at which each shard starts; within cells of interchangeable rows, by the rows' middles
    start = np.zeros(shards, np.int64)
    start[1:] = rank[np.searchsorted(first, cut, "left").clip(max=len(first) - 1)]
    start[1:][cut > first[-1]] = count
    one = np.where(counts > 0, sizes // np.maximum(counts, 1), 0)
    for c in np.flatnonzero(np.isin(first, alike)):
        inside = np.flatnonzero((targets(total, shards) > before[c]) & (targets(total, shards) < before[c] + sizes[c]))
        start[inside + 1] = rank[c] + (2 * (targets(total, shards)[inside] - before[c]) + one[c]) // (2 * one[c])
    where = docs.sparkSession.createDataFrame([(i, int(r), bool(a)) for i, (r, a) in enumerate(zip(rank, np.isin(first, alike), strict=True))], "cell long, rank long, alike boolean")
    placed = rows.withColumn("cell", cell_of(F.col("sort_key"), bounds)).join(F.broadcast(where), "cell")
    if len(alike):
        special = materialise(placed.where("alike").withColumn("sub", F.spark_partition_id()), "alike", "zstd")
        placed = placed.where("not alike").withColumn("sub", F.lit(0)).unionByName(special)
        parts = special.groupBy("cell", "sub").agg(F.count("*").alias("n"))
        ahead = F.coalesce(F.sum("n").over(Window.partitionBy("cell").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = materialise(parts.select("cell", "sub", ahead.alias("ahead")), "parts")  # a row for each task that has such rows
    else:
        placed = placed.withColumn("sub", F.lit(0))
    if moved:
        text = F.col("_keep_text")
        placed = placed.repartition("cell", "sub").select("*", row_size(text).alias("size"), _crc(text))
    number = F.row_number().over(Window.partitionBy("cell", "sub").orderBy("sort_key", "doc_id", "text_crc32")) - 1
    placed = placed.withColumn("number", number)
    if len(alike):
        placed = placed.join(parts, ["cell", "sub"], "left").withColumn("number", F.col("number") + F.coalesce("ahead", F.lit(0)))
    at = (F.col("rank") + F.col("number")).cast("long")
    starts = F.lit(start.tolist()).cast("array<bigint>")
    shard = F.size(F.filter(starts, lambda s: s <= at)) - 1
    placed = placed.withColumn("shard", shard)
    return placed.select("doc_id", "size", "text_crc32", "shard", (at - F.get(starts, F.col("shard"))).alias("slot"), *[F.col(f"_keep_{c}").alias(c) for c in keep])
