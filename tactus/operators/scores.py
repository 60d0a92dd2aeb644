"""Whole scores of beats, structure and onsets, composed of matches, nearest points and label counts.

Times are seconds, distinct within a key. Every score is one row for a key of the reference; keys that only the estimate has are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.operators import aggregates as A
from tactus.operators import joins as J
from tactus.operators import series as R
from tactus.operators.evaluation import detection_score
from tactus.sources.materialise import cut

#: Names of the metrical levels, best first where scores tie.
LEVELS = ["same", "double", "half (odd)", "half (even)", "off-beat"]


def _bucket(c: str, width: float) -> Column:
    return F.floor(F.col(c) / width)


def _gap(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def _beats(df: DataFrame, keys: list[str], at: str, width: float) -> DataFrame:
    """keys, t, idx, before, after of beats."""
    x = R.index_rows(df.select(*keys, F.col(at).cast("double").alias("t")), keys, ["t"], _bucket("t", width))
    x = R.carry(x, keys, ["t"], _bucket("t", width), {"before": F.col("t")})
    return R.carry(x, keys, ["t"], _bucket("t", width), {"after": F.col("t")}, ahead=True)


def metrical_levels(beats: DataFrame, keys: list[str]) -> DataFrame:
    """keys, level, t of beats (t, idx, after): as they are, with the middles between them, every other one, and the middles alone."""
    mid = (F.col("t") + F.col("after")) / 2
    one = lambda name, t: F.struct(F.lit(name).alias("level"), t.alias("t"))
    half = F.when(F.col("idx") % 2 == 0, LEVELS[2]).otherwise(LEVELS[3])
    levels = F.array(one(LEVELS[0], F.col("t")), one(LEVELS[1], F.col("t")), one(LEVELS[1], mid), F.struct(half.alias("level"), F.col("t").alias("t")), one(LEVELS[4], mid))
    return beats.select(*keys, F.inline(levels)).where("t is not null")


def continuity(ref: DataFrame, est: DataFrame, keys: list[str], width: float, share: float = 0.175) -> DataFrame:
    """keys, cmlt: the share of reference beats that are tracked on from the one before: both are matched, to neighbours, within `share` of the interval, and their intervals agree as well.

    ref, est: beats of _beats(). Keys with fewer than two beats on either side have 0.
    """
    grid = est.select(*keys, F.col("t").alias("_g"), F.col("idx").alias("_q"))
    interval = F.coalesce(F.col("after") - F.col("t"), F.col("t") - F.col("before"))
    near = J.nearest(ref.withColumn("_tol", share * interval), grid, keys, "t", "_g", "_q", _bucket("_t", width), _gap)
    match = F.when(_gap(F.col("grid.t"), F.col("t")) <= F.col("_tol"), F.col("grid"))
    # each beat with the match of the one before, null ones included
    seen = R.carry(near.withColumn("_m", match), keys, ["t"], _bucket("t", width), {"_was": F.struct("t", "_m")})
    was = F.col("_was._m")
    good = (F.col("_m.id") == was["id"] + 1) & (F.abs(F.col("_m.t") - was["t"] - (F.col("t") - F.col("_was.t"))) <= F.col("_tol"))
    ok = seen.groupBy(*keys).agg(F.count_if(F.coalesce(good, F.lit(False))).alias("_ok"), F.count("*").alias("_n"))
    ests = est.groupBy(*keys).agg(F.count("*").alias("_e"))
    enough = (F.col("_n") > 1) & (F.col("_e") > 1)
    return ok.join(ests, keys, "left").select(*keys, F.when(enough, F.col("_ok") / F.col("_n")).otherwise(0.0).alias("cmlt"))


def beat_score(ref: DataFrame, est: DataFrame, keys: list[str], at: str, down: str, width: float, tolerance: float = 0.07, share: float = 0.175) -> DataFrame:
    """keys, f, offset, f_shifted, f_any_level, best_level, cmlt, down_f of estimated beats.

    f: of one-to-one matches within tolerance. offset: the median error of the nearest estimates (of equally near ones the later), where one lies within half a beat, else 0; all that
    follows is of estimates moved back by it. f_any_level: the best over metrical levels of the reference. down_f: of the rows where `down` holds. width: seconds of a bucket.
    """
    r = cut(_beats(ref, keys, at, width), "reference")
    e = est.select(*keys, F.col(at).cast("double").alias("t"), F.coalesce(F.col(down), F.lit(False)).alias("_down"))
    half = (F.coalesce("after", "t") - F.coalesce("before", "t")) / 4
    near = J.nearest(r.withColumn("_half", half), e.select(*keys, F.col("t").alias("_g"), F.lit(0).alias("_q")), keys, "t", "_g", "_q", _bucket("_t", width), _gap, later=True)
    error = F.col("grid.t") - F.col("t")
    offsets = near.groupBy(*keys).agg(F.coalesce(F.median(F.when(F.abs(error) <= F.col("_half"), error)), F.lit(0.0)).alias("offset"))
    offsets = cut(offsets, "offsets")
    moved = cut(e.join(offsets, keys).select(*keys, (F.col("t") - F.col("offset")).alias("t"), "_down"), "estimates")
    bucket = _bucket("_t", width)
    score = lambda a, b, k: detection_score(a, b, k, "t", tolerance, bucket)
    plain = score(r.select(*keys, "t"), e.join(offsets.select(*keys), keys, "left_semi").select(*keys, "t"), keys).select(*keys, "f")
    names = F.explode(F.array(*[F.lit(x) for x in LEVELS])).alias("level")
    by_level = score(metrical_levels(r, keys), moved.select(*keys, "t", names), [*keys, "level"])
    place = F.array_position(F.lit(LEVELS), F.col("level"))
    best = by_level.groupBy(*keys).agg(F.max(F.when(F.col("level") == LEVELS[0], F.col("f"))).alias("f_shifted"), F.max("f").alias("f_any_level"), F.max_by("level", F.struct("f", (-place).alias("p"))).alias("best_level"))
    tracked = continuity(r, _beats(moved, keys, "t", width), keys, width, share)
    downs = score(ref.where(F.col(down)).select(*keys, F.col(at).cast("double").alias("t")), moved.where("_down").select(*keys, "t"), keys).select(*keys, F.col("f").alias("down_f"))
    out = offsets.join(plain, keys).join(best, keys).join(tracked, keys, "left").join(downs, keys, "left")
    return out.select(*keys, "f", "offset", "f_shifted", "f_any_level", "best_level", F.coalesce("cmlt", F.lit(0.0)).alias("cmlt"), F.coalesce("down_f", F.lit(0.0)).alias("down_f"))


def structure_score(ref: DataFrame, est: DataFrame, keys: list[str], width: float, frame: float, narrow: float = 0.5, wide: float = 3.0) -> DataFrame:
    """keys, f_narrow, f_wide, pair_f, ratio of two lists of sections (start, end, label; the sections of a key follow one another from 0).

    Boundaries are the starts but the first; pair_f compares the labels of frames every `frame` seconds up to the reference's end, no label being one too; ratio: sections for each of the reference.
    """
    first = {name: R.index_rows(df.select(*keys, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "label"), keys, ["start"], _bucket("start", width)) for name, df in (("r", ref), ("e", est))}
    r, e = (cut(first[k], "sections") for k in "re")
    inner = lambda x: x.where("idx > 0").select(*keys, F.col("start").alias("t"))
    bucket = _bucket("_t", width)
    scores = [detection_score(inner(r), inner(e), keys, "t", tol, bucket).select(*keys, F.col("f").alias(name)) for name, tol in (("f_narrow", narrow), ("f_wide", wide))]
    count = lambda x, n: x.groupBy(*keys).agg(F.count("*").alias(n))
    ends = r.groupBy(*keys).agg(F.max("end").alias("_end"))
    frames = ends.where(F.col("_end") >= frame).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_end") / frame).cast("long") - 1)).alias("_i"))
    frames = frames.select(*keys, (F.col("_i") * frame).alias("t"))
    for name, x in (("_r", r), ("_e", e)):
        frames = J.as_of(frames, x.select(*keys, F.col("start").alias("_s"), "idx"), keys, "t", "_s", "idx", bucket).withColumn("idx", F.col("grid.id")).drop("grid")
        frames = frames.join(x.select(*keys, "idx", F.col("end").alias("_to"), F.col("label").alias("_label")), [*keys, "idx"], "left")
        frames = frames.withColumn(name, F.when(F.col("t") < F.col("_to"), F.col("_label"))).drop("idx", "_to", "_label")
    pair = A.pair_agreement(frames, keys, "_r", "_e").select(*keys, F.col("f1").alias("pair_f"))
    out = count(r, "_n").join(count(e, "_m"), keys, "left")
    for x in (*scores, pair):
        out = out.join(x, keys, "left")
    zero = F.lit(0.0)
    return out.select(*keys, *[F.coalesce(c, zero).alias(c) for c in ("f_narrow", "f_wide", "pair_f")], (F.coalesce("_m", F.lit(0)) / F.col("_n")).alias("ratio"))


def onset_scores(ref: DataFrame, est: DataFrame, stem: list[str], label: str, at: str, tolerance: float, width: float, least: int = 10) -> DataFrame:
    """label, refs, ests, precision, recall, f, offset (median error, s) by class, and of all as label ALL. Stems with fewer than `least` reference onsets are left out.

    ref: stem, label, at; est: stem, at. A stem has one label.
    """
    size = ref.groupBy(*stem, label).agg(F.count("*").alias("refs")).where(F.col("refs") >= least)
    size = cut(size, "stems")
    known = size.select(*stem)
    r, e = (x.join(known, stem, "left_semi").select(*stem, F.col(at).cast("double").alias("t")) for x in (ref, est))
    hits = J.match_within(r, e, stem, "t", tolerance, _bucket("_t", width)).join(size.select(*stem, label), stem)
    # a name for no label, so that the total is told apart
    shown = F.when(F.grouping(label) == 1, "ALL").otherwise(F.col(label))
    found = hits.rollup(label).agg(shown.alias("_name"), F.count("*").alias("_hits"), F.median(F.col("est_at") - F.col("ref_at")).alias("offset")).select("_name", "_hits", "offset")
    n = e.groupBy(*stem).agg(F.count("*").alias("ests"))
    sums = size.join(n, stem, "left").rollup(label).agg(shown.alias("_name"), F.sum("refs").alias("refs"), F.sum(F.coalesce("ests", F.lit(0))).alias("ests")).where("refs is not null")
    out = sums.select("_name", "refs", "ests").join(found, "_name", "left")
    p, q = F.coalesce("_hits", F.lit(0)) / F.greatest("ests", F.lit(1)), F.coalesce("_hits", F.lit(0)) / F.col("refs")
    out = out.withColumns({"precision": p, "recall": q})
    f = 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9))
    return out.select(F.col("_name").alias(label), "refs", "ests", "precision", "recall", f.alias("f"), "offset")
