"""Histogram sort against the law row by row, repeated rows included."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tactus.llm.sharding import cell_of, shard_documents, sort_key


def by_middles(spark, rows, shards):
    """(shard, slot) of every row in key order: by the middle of the bytes that it takes. Rows of one key are interchangeable."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = sorted((r["k"], -1 if r["doc_id"] is None else r["doc_id"], len((r["text"] or "").encode()) + 16) for r in df.select("doc_id", "text", sort_key(F.col("text"), F.col("doc_id")).alias("k")).collect())
    total, at, slots, out = sum(x[2] for x in keyed), 0, [0] * shards, []
    targets = [-(-total * k // shards) for k in range(1, shards)]
    for _, i, size in keyed:
        s = sum(2 * at + size > 2 * t for t in targets)
        out.append((i, size, s, slots[s]))
        slots[s] += 1
        at += size
    return sorted(out)


def shard_rows(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["shard"], r["slot"]) for r in df.collect())


def fixtures():
    r = random.Random(3)
    mixed = [(i, "word " * r.choice([0, 1, 5, 200, 3000])) for i in range(300)] + [(7, "same"), (7, "same"), (None, None), (None, ""), (500, "x" * 200_000)]
    probe = [(None, "the same text " * 20)] * 2000 + [(i, f"text {i} " * r.randint(1, 40)) for i in range(2000)]
    alike = [(5, "one row")] * 999
    return {"mixed": mixed, "probe": probe, "alike": alike, "one": [(1, "x")]}


@pytest.mark.parametrize("name", ["mixed", "probe", "alike", "one"])
@pytest.mark.parametrize("keep", [None, ["text"]])
def test_every_row_lies_where_its_middle_does(spark, name, keep):
    rows = fixtures()[name]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = shard_documents(df, shards=8, keep=keep)
    assert shard_rows(out) == by_middles(spark, rows, 8)
    sizes = {}
    for x in out.collect():
        sizes[x["shard"]] = sizes.get(x["shard"], 0) + x["size"]
    mean, largest = sum(sizes.values()) / 8, max(len((t or "").encode()) + 16 for _, t in rows)
    assert all(abs(sizes.get(s, 0) - mean) <= largest for s in range(8))
    if keep:
        assert sorted((x["text_crc32"], x["text"] or "") for x in out.collect()) == sorted((zlib.crc32((t or "").encode()), t or "") for _, t in rows)


def test_cells_by_bounds(spark):
    import numpy as np

    for n in (0, 1, 2, 10, 101):
        bounds = np.arange(n, dtype=np.int64) * 10
        got = spark.range(-5, 10 * n + 5).select("id", cell_of(F.col("id"), bounds).alias("c")).collect()
        assert all(x["c"] == int(np.searchsorted(bounds, x["id"], "right")) for x in got)
