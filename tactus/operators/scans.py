"""Order-dependent scans that no window expresses: each state depends on earlier decisions.

Where a scan can be cut exactly (gap collapse, suppression within a distance) the cuts are found first and every piece is
walked on its own. Greedy choices (suppression, top windows) are made in rounds, which settle every place at once where a choice is certain. Steps that compose (best paths,
averages with memory) are in block_scans. Only tempo tracking is walked in order by one task for a series, as a stream.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.operators.block_scans import ema, stream_sorted, viterbi  # noqa: F401  scans of this module's kind
from tactus.operators.series import sessions
from tactus.operators.walks import TempoWalk
from tactus.sources.materialise import cut


def collapse_gaps(peaks: DataFrame, keys: list[str], at: str, value: str, gap: float, bucket: Column) -> DataFrame:
    """Of peaks closer than `gap` to the kept one before, only the strongest stays: keys, at, value.

    A stronger peak (strictly) replaces the kept one's time and value, so the anchor moves. Two neighbouring peaks at least `gap` apart are
    never compared, which gives exact cuts.
    """
    named = peaks.select(*keys, F.col(at).cast("double").alias("_t"), F.col(value).cast("double").alias("_v")).where("_t is not null")
    cut = sessions(named, keys, ["_t", "_v"], bucket, F.col("_t"), gap)
    lists = cut.groupBy(*keys, "session").agg(F.array_sort(F.collect_list(F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")))).alias("p"))
    none = F.array().cast("array<struct<t:double,v:double>>")

    def step(kept: Column, p: Column) -> Column:
        last = F.element_at(kept, -1)
        near = (F.size(kept) > 0) & (p["t"] - F.when(F.size(kept) > 0, last["t"]) < gap)
        head = F.slice(kept, 1, F.greatest(F.lit(0), F.size(kept) - 1))
        return F.when(~near, F.concat(kept, F.array(p))).when(p["v"] > F.when(F.size(kept) > 0, last["v"]), F.concat(head, F.array(p))).otherwise(kept)

    kept = lists.withColumn("_kept", F.explode(F.aggregate("p", none, step)))
    return kept.select(*keys, F.col("_kept.t").alias(at), F.col("_kept.v").alias(value))


#: Rounds of suppress() after which what is left open is walked session by session.
ROUNDS = 12


def suppress(peaks: DataFrame, keys: list[str], at: str, value: str, distance: float, bucket: Column, rounds: int = ROUNDS) -> DataFrame:
    """Non-maximum suppression: peaks by falling value (ties: the earlier first), kept if at least `distance` from all kept ones. Nulls and NaN are no peaks.

    In each round the best open peak of every cell of width `distance` is kept unless a better open one of the next cells lies within reach of it; kept peaks then close all peaks
    within reach. A peak meets the best of its two neighbour cells and the kept ones of three, so a round is linear in the open peaks however many lie close together. Long staircases of peaks, each
    barely in reach of a better one, take a round a step: what is open after `rounds` is walked in sessions, which no distance links.
    """
    t, v = F.col(at).cast("double"), F.col(value).cast("double")
    left = peaks.select(*keys, t.alias("_t"), v.alias("_v")).where("_t is not null and not isnan(_t) and _v is not null and not isnan(_v)").distinct()
    left = cut(left.withColumn("_c", F.floor(F.col("_t") / distance)), "open")
    by, done = [*keys, "_c"], []
    near = lambda c: F.abs(F.col("_t") - c) < distance
    for _ in range(rounds):
        if left.isEmpty():
            break
        top = left.groupBy(*by).agg(F.max(F.struct("_v", (-F.col("_t")).alias("n"))).alias("_top"))
        tops = top.select(*by, (-F.col("_top.n")).alias("_tt"), F.col("_top._v").alias("_tv"))
        beside = tops.select(*keys, F.explode(F.array(F.col("_c") - 1, F.col("_c") + 1)).alias("_c"), F.col("_c").alias("_of"), "_tt", "_tv")
        better = (F.col("_v") > F.col("_tv")) | ((F.col("_v") == F.col("_tv")) & (F.col("_t") < F.col("_tt")))
        beaten = left.join(beside, by).where(near(F.col("_tt")) & better).select(*keys, F.col("_of").alias("_c")).distinct()
        kept = cut(tops.join(beaten, by, "left_anti"), "kept")
        done.append(kept)
        reach = kept.select(*keys, F.explode(F.array(F.col("_c") - 1, F.col("_c"), F.col("_c") + 1)).alias("_c"), "_tt").groupBy(*by).agg(F.collect_list("_tt").alias("_near"))
        left = cut(left.join(reach, by, "left").where(F.col("_near").isNull() | ~F.exists("_near", near)).drop("_near"), "open")
    out = [k.select(*keys, F.col("_tt").alias(at), F.col("_tv").alias(value)) for k in done]
    if not left.isEmpty():
        out.append(_suppress_sessions(left, keys, at, value, distance, bucket))
    first, *rest = out or [left.select(*keys, F.col("_t").alias(at), F.col("_v").alias(value))]
    for x in rest:
        first = first.unionAll(x)
    return first


def _suppress_sessions(left: DataFrame, keys: list[str], at: str, value: str, distance: float, bucket: Column) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in left.schema.fields}

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_v", "_t"], ascending=[False, True])
        kept: dict[int, float] = {}  # a cell has one kept peak at most
        rows = []
        for i, (c, t) in enumerate(zip(pdf["_c"], pdf["_t"], strict=True)):
            if all(abs(t - kept.get(x, np.inf)) >= distance for x in (c - 1, c, c + 1)):
                kept[c] = t
                rows.append(i)
        return pdf.iloc[rows][[*keys, "_t", "_v"]]

    cut_ = sessions(left, keys, ["_t", "_v"], bucket, F.col("_t"), distance)
    found = cut_.groupBy(*keys, "session").applyInPandas(walk, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "_t double", "_v double"]))
    return found.select(*keys, F.col("_t").alias(at), F.col("_v").alias(value))


def follow_tempo(peaks: DataFrame, keys: list[str], at: str, value: str, period: str, share: float = 0.35, least: float = 0.02) -> DataFrame:
    """Peaks that a steady beat of `period` (a column, constant for each key) picks: keys, at.

    The first expectation is the first peak's time. The strongest peak nearer than max(share * period, least) to it (below it: up to that far; ties: the first) is
    taken, sets the next expectation a period later, and all peaks of its window are done with; without one the expectation moves on by a period, again and again
    until its window ends after the next peak, in a long gap (over walks.STEPS periods) at once. A series of one peak, or without a positive finite period, keeps all its peaks. Peaks stream by in order: a window is the only state.
    """
    kinds = {f.name: f.dataType.simpleString() for f in peaks.schema.fields}

    def start():
        walk, own = TempoWalk(share, least), {}

        def step(row: dict | None, new: bool) -> list[dict]:
            nonlocal walk, own
            if row is None:
                return [{**own, at: t} for t in walk.close()]
            if new:
                walk, own = TempoWalk(share, least), {k: row[k] for k in keys}
            return [{**own, at: t} for t in walk.peak(float(row[at]), float(row[value]), row[period])]

        return step

    rows = peaks.select(*keys, at, value, period).where(F.col(at).isNotNull() & F.col(value).isNotNull())
    out = stream_sorted(rows, keys, [at], start, ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"{at} double"]))
    return out.withColumn(at, F.col(at).cast(kinds[at]))


def top_windows(windows: DataFrame, keys: list[str], start: str, score: Column, length: float, most: int = 4) -> DataFrame:
    """Greedy choice of at most `most` windows of one length that don't overlap, by falling score, then start.

    One round for each place: the best open window of every key, a maximum with map-side combine, closes those it overlaps. Windows without a score are left out.
    """
    left = windows.select(*keys, F.col(start).cast("double").alias("_t"), score.cast("double").alias("_v")).where("_t is not null and _v is not null and not isnan(_v)")
    left, out = cut(left, "open"), None
    for place in range(most):
        best = left.groupBy(*keys).agg(F.max(F.struct("_v", (-F.col("_t")).alias("n"))).alias("_b"))
        best = cut(best.select(*keys, F.lit(place).alias("place"), (-F.col("_b.n")).alias(start), F.col("_b._v").alias("score")), "best")
        out = best if out is None else out.unionAll(best)
        left = left.join(best.select(*keys, F.col(start).alias("_s")), keys).where(F.abs(F.col("_t") - F.col("_s")) >= length).drop("_s")
    return out


def novelty(pairs: DataFrame, keys: list[str], half: int) -> DataFrame:
    """Checkerboard novelty along the diagonal of a self-similarity band: keys, idx, novelty.

    pairs: keys, i, j >= i, similarity with j - i < 2 * half. The kernel is a Gaussian of half the half-width, positive where both frames lie on the same side of
    idx, negative across; places whose kernel leaves the series have 0.
    """
    n = pairs.groupBy(*keys).agg(F.max("j").alias("_last"))
    sigma = half / 2.0
    # frames c-half .. c+half-1 lie in the kernel of c
    reach = F.sequence(F.greatest(F.lit(half).cast("long"), F.col("j") - half + 1), F.col("i") + half)
    both = pairs.where(F.col("j") - F.col("i") < 2 * half).withColumn("c", F.explode(reach))
    u, v = F.col("i") - F.col("c") + 0.5, F.col("j") - F.col("c") + 0.5
    weight = F.signum(u) * F.signum(v) * F.exp(-(u * u + v * v) / (2 * sigma * sigma)) * F.when(F.col("i") == F.col("j"), 1).otherwise(2)
    sums = both.groupBy(*keys, F.col("c").alias("idx")).agg(F.sum(weight * F.col("similarity")).alias("_s"))
    inside = F.col("idx") + half - 1 <= F.col("_last")
    return sums.join(n, keys).where(F.col("idx") <= F.col("_last")).select(*keys, "idx", F.when(inside, F.col("_s")).otherwise(0.0).alias("novelty"))
