"""Ordered series at scale: row numbers, running sums, carried values and row windows.

A series is the rows of one key in a given order. Spark's window functions put a whole key into one task, which a hot key
outgrows. Here each series is cut into buckets that follow its order (days of a time stamp, ranges of
an index); rows are ranked, summed or carried within (key, bucket), and one summary row per bucket links the buckets. The
summary join uses the partitioning of the first window, so every operator moves the rows once.

Rows whose key is null belong to no series and are dropped. Orders must be total (end in a unique column) for repeatable results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one block of a row window, without its halo.
BLOCK_ROWS = 65_536


def day_of(ts: str) -> Column:
    return F.to_date(F.col(ts))


def _bucketed(df: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    return df.where(" and ".join(f"`{k}` is not null" for k in keys)).withColumn("_bucket", bucket).where("_bucket is not null")


def _summaries_joined(rows: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(summary, [*keys, "_bucket"])


def index_rows(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "idx") -> DataFrame:
    """Adds the 0-based place of each row in its series."""
    rows = _bucketed(df, keys, bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    counts = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    out = _summaries_joined(ranked, counts, keys)
    return out.withColumn(name, (F.col("_before") + F.col("_rn") - 1).cast("long")).drop("_bucket", "_rn", "_before")


def running_sum(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: Column, name: str) -> DataFrame:
    """Adds the sum of value over the row and all rows before it in its series; null counts as 0."""
    rows = _bucketed(df, keys, bucket).withColumn("_v", F.coalesce(value, F.lit(0)))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("_v").alias("_s"))
    sums = sums.select(*keys, "_bucket", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    so_far = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = _summaries_joined(rows.withColumn("_rs", F.sum("_v").over(so_far)), sums, keys)
    return out.withColumn(name, F.col("_before") + F.col("_rs")).drop("_bucket", "_v", "_rs", "_before")


def carry(df: DataFrame, keys: list[str], order: list[str], bucket: Column, values: dict[str, Column], ahead: bool = False, own: bool = False) -> DataFrame:
    """Adds for each name in values the nearest earlier (ahead: later) value of the series that is not null; own: the row itself counts.

    With a value that is never null this is lag or lead by one row; with one that is null except on marked rows it is
    an as-of join of a series with itself.
    """
    rows = _bucketed(df, keys, bucket)
    for name, v in values.items():
        rows = rows.withColumn(f"_v_{name}", v)
    across = Window.partitionBy(*keys).orderBy(F.col("_bucket").desc() if ahead else F.col("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*[F.col(c).desc() if ahead else F.col(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    place = F.struct(*order)
    pick = F.min_by if ahead else F.max_by
    # max_by skips null places, so rows without a value don't count
    ends = rows.groupBy(*keys, "_bucket").agg(*[pick(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), place)).alias(f"_e_{n}") for n in values])
    ends = ends.select(*keys, "_bucket", *[F.last(f"_e_{n}", ignorenulls=True).over(across).alias(f"_b_{n}") for n in values])
    near = rows.withColumns({f"_i_{n}": F.last(f"_v_{n}", ignorenulls=True).over(inside) for n in values})
    out = _summaries_joined(near, ends, keys)
    out = out.withColumns({n: F.coalesce(f"_i_{n}", f"_b_{n}") for n in values})
    return out.drop("_bucket", *[f"_{x}_{n}" for n in values for x in "vib"])


def with_halo(df: DataFrame, keys: list[str], before: int, after: int, idx: str = "idx", block: int = BLOCK_ROWS) -> DataFrame:
    """Deals an indexed series into blocks, each with `before` rows ahead of it and `after` behind: adds _block and _own.

    Row windows partitioned by the keys and _block and ordered by idx are then exact on the rows where _own holds.
    """
    i = F.col(idx)
    reach = F.sequence(F.greatest(F.lit(0), F.floor((i - after) / block)).cast("long"), F.floor((i + before) / block).cast("long"))
    return df.withColumn("_block", F.explode(reach)).withColumn("_own", F.col("_block") == F.floor(i / block))


def over_rows(df: DataFrame, keys: list[str], before: int, after: int, made: dict, idx: str = "idx", block: int = BLOCK_ROWS) -> DataFrame:
    """Adds columns made from row windows: made[name] is called with a window of `before` rows back to `after` rows on."""
    dealt = with_halo(df, keys, before, after, idx, block)
    by = Window.partitionBy(*keys, "_block").orderBy(idx)
    frame = by.rowsBetween(-before, after)
    return dealt.withColumns({n: f(by, frame) for n, f in made.items()}).where("_own").drop("_block", "_own")


def moving_average(df: DataFrame, keys: list[str], value: str, radius: int, name: str = "smooth", idx: str = "idx", block: int = BLOCK_ROWS) -> DataFrame:
    """Centred mean of 2*radius+1 rows, cut off at the ends of the series."""
    return over_rows(df, keys, radius, radius, {name: lambda by, frame: F.avg(value).over(frame)}, idx, block)


def moving_median(df: DataFrame, keys: list[str], value: str, before: int, after: int, name: str = "smooth", idx: str = "idx", block: int = BLOCK_ROWS) -> DataFrame:
    """Median of the rows from `before` back to `after` on; nulls are left out."""

    def median(by, frame) -> Column:
        s = F.array_sort(F.collect_list(value).over(frame))
        n = F.size(s)
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)

    return over_rows(df, keys, before, after, {name: median}, idx, block)


def z_score(df: DataFrame, keys: list[str], value: str, name: str = "z", least_sd: float = 1e-6) -> DataFrame:
    """(x - mean) / population standard deviation of the series; 0 where that is tiny; a single row keeps its value."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_sd"), F.count(value).alias("_n"))
    z = F.when(F.col("_n") < 2, F.col(value)).when(F.col("_sd") <= least_sd, F.lit(0.0)).otherwise(F.try_divide(F.col(value) - F.col("_m"), F.col("_sd")))
    return df.join(stats, keys).withColumn(name, z).drop("_m", "_sd", "_n")


def peaks(df: DataFrame, keys: list[str], value: str, threshold: float, idx: str = "idx", block: int = BLOCK_ROWS) -> DataFrame:
    """Rows whose value is at least threshold, above the row before and not below the row after; ends of a series count as lower.

    Adds `shift`: the place of the vertex of the parabola through the three rows, within half a row.
    """
    seen = over_rows(df, keys, 1, 1, {"_l": lambda by, frame: F.lag(value).over(by), "_r": lambda by, frame: F.lead(value).over(by)}, idx, block)
    v, left, right = F.col(value), F.col("_l"), F.col("_r")
    found = seen.where((v >= threshold) & (left.isNull() | (v > left)) & (right.isNull() | (v >= right)))
    bend = left - 2 * v + right
    shift = F.when(left.isNull() | right.isNull() | (F.abs(bend) < 1e-12), F.lit(0.0)).otherwise(F.least(F.lit(0.5), F.greatest(F.lit(-0.5), F.try_divide((left - right) / 2, bend))))
    return found.withColumn("shift", shift).drop("_l", "_r")


def islands(df: DataFrame, keys: list[str], order: list[str], bucket: Column, state: Column, extra: list[Column] | None = None) -> DataFrame:
    """Runs of rows with equal state: keys, state, first and last place (struct of the order columns), n and the extra aggregates."""
    seen = carry(df.withColumn("_s", F.struct(state.alias("state"))), keys, order, bucket, {"_p": F.col("_s")})
    start = F.when(F.col("_p").isNull() | ~F.col("_p.state").eqNullSafe(F.col("_s.state")), F.struct(*order))
    runs = carry(seen, keys, order, bucket, {"_start": start}, own=True)
    place = F.struct(*order)
    return runs.groupBy(*keys, "_start").agg(F.min_by("_s.state", place).alias("state"), F.max(place).alias("last"), F.count("*").alias("n"), *(extra or [])).withColumnRenamed("_start", "first")


def sessions(df: DataFrame, keys: list[str], order: list[str], bucket: Column, at: Column, gap: float, name: str = "session") -> DataFrame:
    """Adds the start of the session of each row: a new one begins where `at` is `gap` or more after the row before."""
    seen = carry(df.withColumn("_at", at), keys, order, bucket, {"_p": F.col("_at")})
    start = F.when(F.col("_p").isNull() | (F.col("_at") - F.col("_p") >= gap), F.struct(*order))
    return carry(seen, keys, order, bucket, {name: start}, own=True).drop("_p", "_at")
