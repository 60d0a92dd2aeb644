"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.llm.common import drop, materialise


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that edges reach.

    Alternates large-star and small-star steps until the edges no longer change. Each step is a
    min() with map-side combine and one join; nothing is gathered per node, so a hub with any number of
    edges is safe. Null ends, loops and repeated edges are ignored. No edges give no rows.
    """
    e = (
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = materialise(e, "edges")
    state = _state(e)
    while state[0]:
        of = e
        # large star: every larger neighbour of u, and u itself, points to the least of u's neighbourhood
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "m", "u")
        e = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        old, e = of, materialise(e.where("u <> v").distinct(), "edges")
        drop(old)
        before, state = state, _state(e)
        if before == state:
            break
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(e: DataFrame) -> tuple:
    """Row count and an order-free digest of the edges."""
    h = F.xxhash64("u", "v")
    got = e.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftrightunsigned(h, 32))).first()
    return tuple(got)
