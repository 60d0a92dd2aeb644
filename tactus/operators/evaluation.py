"""Comparing signals and estimates: decomposition on sources, alignment, chunk stitching, losses and detection scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.operators import joins as J
from tactus.operators import series as R


def least_squares(df: DataFrame, keys: list[str], y: Column, xs: list[Column]) -> DataFrame:
    """Coefficients of y on xs without a constant: keys, coefficients, explained (share of the energy of y). One pass of sums of products; the small systems are solved in batches. Sources without energy have 0."""
    x = [c.cast("double") for c in [*xs, y]]
    n = len(x)
    sums = df.groupBy(*keys).agg(F.array(*[F.coalesce(F.sum(x[a] * x[b]), F.lit(0.0)) for a in range(n) for b in range(n)]).alias("_g"))

    @F.pandas_udf("array<double>")
    def solved(g: pd.Series) -> pd.Series:
        out = []
        for row in g:
            m = np.asarray(row).reshape(n, n)
            c = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=1e-12)[0]
            out.append([*c, float(c @ m[:-1, -1] / m[-1, -1]) if m[-1, -1] > 0 else 0.0])
        return pd.Series(out, dtype=object)

    return sums.withColumn("_c", solved("_g")).select(*keys, F.slice("_c", 1, n - 1).alias("coefficients"), F.get("_c", F.lit(n - 1)).alias("explained"))


def best_lag(a: DataFrame, b: DataFrame, keys: list[str], idx: str, value: str, reach: int, block: int = 65_536) -> DataFrame:
    """The lag within reach at which b, moved back by it, agrees most with a (ties: the smallest): keys, lag, product.

    Blocks of a meet the part of b within reach; their correlations, by Fourier transform, are summed by lag.
    """
    i = F.col(idx).cast("long")
    held = lambda d, name: F.array_sort(F.collect_list(F.struct(i.alias("i"), F.col(value).cast("double").alias("v")))).alias(name)
    left = a.withColumn("_block", F.floor(i / block)).groupBy(*keys, "_block").agg(held(a, "_a"))
    right = R.with_halo(b, keys, reach, reach, idx, block).groupBy(*keys, "_block").agg(held(b, "_b"))

    @F.pandas_udf("array<double>")
    def products(at: pd.Series, ai: pd.Series, av: pd.Series, bi: pd.Series, bv: pd.Series) -> pd.Series:
        out = []
        for k, p, x, q, y in zip(at, ai, av, bi, bv):
            p, q = np.asarray(p) - k * block, np.asarray(q) - k * block + reach
            # what the block holds, not what it could: a sum of places up to the last of a, and those within reach
            size = 1 << int(np.ceil(np.log2(max(int(p.max()) + 2 * reach, int(q.max())) + 2)))
            u, w = np.zeros(size), np.zeros(size)
            u[p], w[q] = x, y
            c = np.fft.irfft(np.fft.rfft(w) * np.fft.rfft(u).conj(), size)
            out.append(c[: 2 * reach + 1])
        return pd.Series(out, dtype=object)

    both = left.join(right, [*keys, "_block"])
    part = lambda c, f: F.transform(c, lambda s: s[f])
    lags = both.select(*keys, F.posexplode(products("_block", part("_a", "i"), part("_a", "v"), part("_b", "i"), part("_b", "v"))).alias("_k", "_p"))
    total = lags.groupBy(*keys, (F.col("_k") - reach).cast("long").alias("lag")).agg(F.sum("_p").alias("product"))
    # rounding first, so that equal products tie
    best = F.max_by(F.struct("lag", "product"), F.struct(F.round("product", 6), -F.col("lag")))
    return total.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.lag", "_b.product")


def chunk_of(pos: Column, n: Column, size: int, border: int) -> Column:
    """struct(chunk, place): which chunk of `size` frames gives the value of frame pos of n, and where in it.

    Chunks begin `border` before the signal and every size - 2 * border; the last ends `border` behind it. Of two that cover a frame inside their borders the first gives it.
    """
    stride = size - 2 * border
    chunk = F.floor(pos / stride)
    last = (n > stride) & (chunk == F.ceil(n / stride) - 1)
    start = F.when(last, n - (size - border)).otherwise(chunk * stride - border)
    return F.struct(chunk.alias("chunk"), (pos - start).alias("place"))


def chunks_over(pos: Column, n: Column, size: int, step: int) -> Column:
    """Starts of all chunks that cover frame pos of n: every `step`, the last one moved to end with the signal."""
    last = F.greatest(F.lit(0).cast("long"), n - size)
    regular = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((pos - size) / step) + 1), F.floor(pos / step))
    starts = F.transform(F.filter(regular, lambda k: k * step < last), lambda k: k * step)
    return F.when(pos >= last, F.array_append(starts, last)).otherwise(starts)


def cross_faded(parts: DataFrame, keys: list[str], idx: str, place: Column, size: Column, value: Column) -> DataFrame:
    """Overlapping estimates weighed by sin² of their place in the chunk: keys, idx, value."""
    w = F.pow(F.sin(F.pi() * (place + 0.5) / size), 2)
    s = parts.groupBy(*keys, idx).agg(F.sum(w * value).alias("_s"), F.sum(w).alias("_w"))
    return s.select(*keys, idx, (F.col("_s") / F.greatest(F.col("_w"), F.lit(1e-8))).alias("value"))


def separation_loss(df: DataFrame, keys: list[str], source: str, target: Column, estimate: Column, silent: float = 1.0, present: float = 1.0, floor: float = 1e-8) -> DataFrame:
    """Mean absolute error of each key over its sources, each weighed by whether the source sounds: keys, l1, normal (by the mean size of the sounding target), sources. Weights don't change the divisor."""
    s = df.groupBy(*keys, source).agg(F.avg(F.abs(estimate - target)).alias("_e"), F.avg(F.abs(target)).alias("_t"))
    sounds = F.col("_t") > floor
    w = F.when(sounds, present).otherwise(silent)
    return s.groupBy(*keys).agg(
        F.avg(w * F.col("_e")).alias("l1"), F.avg(w * F.col("_e") / F.when(sounds, F.col("_t")).otherwise(1.0)).alias("normal"), F.count("*").alias("sources")
    )


def detection_score(ref: DataFrame, est: DataFrame, keys: list[str], at: str, tolerance: float, bucket: Column) -> DataFrame:
    """One-to-one matches within tolerance: keys, found, refs, ests, precision, recall, f. Keys on one side only count."""
    hit = J.match_within(ref, est, keys, at, tolerance, bucket).groupBy(*keys).agg(F.count("*").alias("found"))
    n = ref.select(*keys, F.lit(1).alias("_r"), F.lit(0).alias("_e")).unionAll(est.select(*keys, F.lit(0), F.lit(1))).groupBy(*keys).agg(F.sum("_r").alias("refs"), F.sum("_e").alias("ests"))
    out = n.join(hit, keys, "left").withColumn("found", F.coalesce("found", F.lit(0).cast("long")))
    share = lambda d: F.col("found") / F.greatest(F.col(d), F.lit(1))
    return out.withColumn("precision", share("ests")).withColumn("recall", share("refs")).withColumn("f", 2 * F.col("found") / F.greatest(F.col("refs") + F.col("ests"), F.lit(1)))
