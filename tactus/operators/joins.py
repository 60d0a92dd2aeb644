"""Join shapes of ordered data: as-of, nearest, interval and tolerance joins, without a range join over skewed keys.

As-of joins are unions: both sides go into one series, and the value of the grid side is carried along. Interval joins cut the
intervals into cells of a fixed width and join on (key, cell), so the work is in proportion to rows plus matches.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.operators.block_scans import stream_sorted
from tactus.operators.series import carry, sessions

GRID, ROW = 0, 1


def _together(rows: DataFrame, grid: DataFrame, keys: list[str], at: str, grid_at: str, grid_id: str) -> DataFrame:
    """Rows and grid points as one series with the columns _t, _kind (grid points first at equal times) and _g."""
    g = grid.select(*keys, F.col(grid_at).alias("_t"), F.lit(GRID).alias("_kind"), F.col(grid_id).alias("_tie"), F.struct(F.col(grid_at).alias("t"), F.col(grid_id).alias("id")).alias("_g"))
    r = rows.select(*keys, F.col(at).alias("_t"), F.lit(ROW).alias("_kind"), F.monotonically_increasing_id().alias("_tie"), F.struct(*[F.col(c) for c in rows.columns]).alias("_row"))
    return r.unionByName(g, allowMissingColumns=True)


_ORDER = ["_t", "_kind", "_tie"]


def as_of(rows: DataFrame, grid: DataFrame, keys: list[str], at: str, grid_at: str, grid_id: str, bucket: Column) -> DataFrame:
    """Every row with `grid`: struct(t, id) of the last grid point of its key at or before it, or null. bucket is an expression of _t."""
    both = _together(rows, grid, keys, at, grid_at, grid_id)
    out = carry(both, keys, _ORDER, bucket, {"grid": F.col("_g")}, own=True)
    return out.where(F.col("_kind") == ROW).select("_row.*", "grid")


def nearest(rows: DataFrame, grid: DataFrame, keys: list[str], at: str, grid_at: str, grid_id: str, bucket: Column, distance, later: bool = False) -> DataFrame:
    """Every row with `grid`: the nearest grid point of its key; equally near ones: the earlier, or the later if asked. distance(a, b) is a number >= 0."""
    both = _together(rows, grid, keys, at, grid_at, grid_id)
    back = carry(both, keys, _ORDER, bucket, {"_b": F.col("_g")}, own=True)
    out = carry(back, keys, _ORDER, bucket, {"_f": F.col("_g")}, ahead=True, own=True).where(F.col("_kind") == ROW)
    b, f, t = F.col("_b"), F.col("_f"), F.col("_t")
    pick = F.when(b.isNull(), f).when(f.isNull(), b).when(distance(t, b["t"]) < distance(t, f["t"]) if later else distance(t, b["t"]) <= distance(t, f["t"]), b).otherwise(f)
    return out.select("_row.*", pick.alias("grid"))


def interval_mean(rows: DataFrame, grid: DataFrame, keys: list[str], at: str, grid_at: str, grid_id: str, value: str, bucket: Column) -> DataFrame:
    """For each grid point the mean of the rows from it up to the next one; without rows 0. Rows before the first point are dropped, the last one owns the tail."""
    found = as_of(rows, grid, keys, at, grid_at, grid_id, bucket).where("grid is not null")
    means = found.groupBy(*keys, F.col("grid.id").alias(grid_id)).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return grid.select(*keys, grid_at, grid_id).join(means, [*keys, grid_id], "left").withColumns({"mean": F.coalesce("mean", F.lit(0.0)), "n": F.coalesce("n", F.lit(0))})


def cells(first: Column, end: Column, width: float) -> Column:
    """Numbers of the cells of `width` that [first, end] touches."""
    return F.sequence(F.floor(first / width).cast("long"), F.floor(end / width).cast("long"))


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, first: str, end: str, width: float) -> DataFrame:
    """Pairs of points and intervals of the same key with first <= at < end, as struct columns `point` and `interval`."""
    p = points.select(*keys, F.floor(F.col(at) / width).cast("long").alias("_cell"), F.struct(*points.columns).alias("point"))
    i = intervals.where(F.col(first) < F.col(end)).select(*keys, F.explode(cells(F.col(first), F.col(end), width)).alias("_cell"), F.struct(*intervals.columns).alias("interval"))
    t = F.col(f"point.{at}")
    return p.join(i, [*keys, "_cell"]).where((F.col(f"interval.{first}") <= t) & (t < F.col(f"interval.{end}"))).select("point", "interval")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], first: str, end: str, width: float, least: float = 0.0) -> DataFrame:
    """Pairs of intervals of the same key that share more than nothing and at least `least`: a, b, and the shared part (lo, hi)."""
    x = a.where(F.col(first) < F.col(end)).select(*keys, F.explode(cells(F.col(first), F.col(end), width)).alias("_cell"), F.struct(*a.columns).alias("a"))
    y = b.where(F.col(first) < F.col(end)).select(*keys, F.explode(cells(F.col(first), F.col(end), width)).alias("_cell"), F.struct(*b.columns).alias("b"))
    lo, hi = F.greatest(f"a.{first}", f"b.{first}"), F.least(f"a.{end}", f"b.{end}")
    both = x.join(y, [*keys, "_cell"]).where((lo < hi) & (hi - lo >= least) & (F.col("_cell") == F.floor(lo / width)))  # once, in the cell where they meet
    return both.select("a", "b", lo.alias("lo"), hi.alias("hi"))


def match_within(ref: DataFrame, est: DataFrame, keys: list[str], at: str, tolerance: float, bucket: Column) -> DataFrame:
    """Greedy one-to-one matches of two lists of times: keys, ref_at, est_at.

    Both lists are walked in order; the two front times match if they are within tolerance, else the smaller is passed over.
    The merged times stream by: those of one list that wait for a match are a queue, from whose front the times out of reach are dropped. Where two neighbouring times lie more than the tolerance apart
    nothing can match across, so such sessions are walked by themselves.
    """
    kinds = {f.name: f.dataType.simpleString() for f in ref.schema.fields}
    side = lambda df, kind: df.select(*keys, F.col(at).cast("double").alias("_t"), F.lit(kind).alias("_kind"))
    both = side(ref, 0).unionAll(side(est, 1)).where("_t is not null").withColumn("_tie", F.monotonically_increasing_id())
    # a hair above the tolerance: equal to it still matches
    dealt = sessions(both, keys, ["_t", "_kind", "_tie"], bucket, F.col("_t"), tolerance * (1 + 1e-9) + 1e-12)

    def start():
        queue: deque = deque()
        kind = 0

        def step(row: dict | None, new: bool) -> list[dict]:
            nonlocal kind
            if row is None or new:
                queue.clear()
            if row is None:
                return []
            t = row["_t"]
            while queue and queue[0] < t and abs(queue[0] - t) > tolerance:
                queue.popleft()
            if queue and kind != row["_kind"]:
                other = queue.popleft()
                r, e = (other, t) if kind == 0 else (t, other)
                return [{**{k: row[k] for k in keys}, "ref_at": r, "est_at": e}]
            kind = row["_kind"]
            queue.append(t)
            return []

        return step

    rows = dealt.select(*keys, F.col("session._tie").alias("_session"), "_t", "_kind")
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "ref_at double", "est_at double"])
    return stream_sorted(rows, [*keys, "_session"], ["_t", "_kind"], start, schema)


def gather(rows: DataFrame, curve: DataFrame, keys: list[str], at: Column, idx: str, value: str) -> DataFrame:
    """Every row with the curve's value at the rounded index `at`, clamped to the curve; 0 without a curve."""
    last = curve.groupBy(*keys).agg(F.max(idx).alias("_last"))
    want = rows.join(last, keys, "left").withColumn("_at", F.least(F.greatest(F.lit(0), F.round(at)), F.col("_last")).cast("long"))
    c = curve.select(*keys, F.col(idx).alias("_at"), F.col(value).alias("sample"))
    return want.join(c, [*keys, "_at"], "left").withColumn("sample", F.coalesce("sample", F.lit(0.0))).drop("_at", "_last")


def with_fallback(rows: DataFrame, lookup: DataFrame, on: list[str], value: str, fallback: Column) -> DataFrame:
    """Left lookup with a fallback for missing keys."""
    return rows.join(lookup.select(*on, F.col(value).alias("_v")), on, "left").withColumn(value, F.coalesce("_v", fallback)).drop("_v")


def cosine_pairs(vectors: DataFrame, keys: list[str], idx: str, vector: str, reach: int, block: int = 256) -> DataFrame:
    """Cosine similarity of the vectors of one key whose places differ by at most `reach`: keys, i, j (i <= j), similarity.

    Banded self join: block numbers meet only in neighbouring blocks, so n rows give n * (reach + 1) pairs, never n * n. A zero vector has
    similarity 0 with everything, itself included.
    """
    block = max(block, reach, 1)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    v = vectors.select(*keys, F.col(idx).alias("_i"), F.col(vector).alias("_v"), norm.alias("_n"), F.floor(F.col(idx) / block).cast("long").alias("_b"))
    left = v.select(*keys, F.col("_i").alias("i"), F.col("_v").alias("x"), F.col("_n").alias("nx"), F.explode(F.array(F.col("_b"), F.col("_b") + 1)).alias("_b"))
    right = v.select(*keys, F.col("_i").alias("j"), F.col("_v").alias("y"), F.col("_n").alias("ny"), "_b")
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, p: s + p)
    den = F.col("nx") * F.col("ny")
    sim = F.when(den <= 1e-12, 0.0).when(F.col("i") == F.col("j"), 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot, den))))
    near = left.join(right, [*keys, "_b"]).where((F.col("j") >= F.col("i")) & (F.col("j") - F.col("i") <= reach))
    return near.select(*keys, "i", "j", sim.alias("similarity"))
