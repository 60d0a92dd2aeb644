"""Aggregates: robust statistics, regression, scores of detections and labels, tempo and meter, contingency, budgets.

All are groupings with partial aggregation. Exact medians and percentiles of a hot group collect distinct values with counts
(Spark's percentile), whose size the value's precision bounds; ranks over a whole table are counted per distinct value first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactus.operators.series import carry, index_rows, running_sum
from tactus.sources.materialise import cut


def probe(df: DataFrame, keys: list[str], value: Column, clip: float = 0.999) -> DataFrame:
    """Root mean square, peak, clipped count and share of each key's samples."""
    x = value.cast("double")
    out = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x * x).alias("_ms"), F.max(F.abs(x)).alias("peak"), F.count_if(F.abs(x) >= clip).alias("clipped"))
    return out.select(*keys, "n", F.coalesce(F.sqrt("_ms"), F.lit(0.0)).alias("rms"), F.coalesce("peak", F.lit(0.0)).alias("peak"), "clipped", F.coalesce(F.try_divide(F.col("clipped"), F.col("n")), F.lit(0.0)).alias("clipped_share"))


def regression(df: DataFrame, keys: list[str], y: Column, x: Column) -> DataFrame:
    """Least-squares slope and R2: (0, 0) without spread in x, R2 1 without spread in y."""
    s = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("_k"), F.regr_r2(y, x).alias("_r"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"))
    flat = F.coalesce(F.col("_sxx"), F.lit(0.0)) <= 1e-12
    return s.select(*keys, F.when(flat, 0.0).otherwise(F.col("_k")).alias("slope"), F.when(flat, 0.0).when(F.col("_syy") <= 1e-12, 1.0).otherwise(F.col("_r")).alias("r2"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate; 0 without spread."""
    return F.coalesce(F.corr(a, b), F.lit(0.0))


def tempo_stats(beats: DataFrame, keys: list[str], at: str, tie: str, bucket: Column) -> DataFrame:
    """Of each key's beat times in seconds: n, median interval, BPM, spread (MAD, ms), drift (BPM a minute), its R2 and a stability class.

    Keys with fewer than two beats or an interval of 0 or less give no row.
    """
    t = F.col(at).cast("double")
    seen = carry(beats, keys, [at, tie], bucket, {"_p": t}).where("_p is not null").withColumn("ibi", t - F.col("_p"))
    med = seen.groupBy(*keys).agg(F.median("ibi").alias("median_ibi"), F.count("*").alias("_n"), F.min("ibi").alias("_least")).where("_least > 0")
    near = seen.join(med, keys)
    mad = near.groupBy(*keys).agg(F.median(F.abs(F.col("ibi") - F.col("median_ibi"))).alias("_mad"), F.first("median_ibi").alias("median_ibi"), F.first("_n").alias("_n"))
    fit = regression(near, keys, 60.0 / F.col("ibi"), F.col("_p") / 60.0)
    drift, spread = F.col("slope"), F.col("_mad") * 1000
    kind = F.when((F.abs(drift) >= 1) & (F.col("r2") >= 0.5), "Drifting").when(spread <= 5, "Programmed").when(spread <= 40, "Human").otherwise("Variable")
    return mad.join(fit, keys).select(*keys, (F.col("_n") + 1).alias("beats"), "median_ibi", (60.0 / F.col("median_ibi")).alias("bpm"), spread.alias("mad_ms"), drift.alias("drift"), "r2", kind.alias("stability"))


#: Candidate meters and their priors.
METER_PRIORS = {2: 0.8, 3: 0.9, 4: 1.0, 5: 0.65, 6: 0.75, 7: 0.6}


def meter(beats: DataFrame, keys: list[str], idx: str, strength: str) -> DataFrame:
    """Beats in a bar: the candidate whose strongest phase stands out most, by its prior; short series: 4 with confidence 0."""
    priors = F.create_map(*[F.lit(x) for kv in METER_PRIORS.items() for x in kv])
    n_of = beats.groupBy(*keys).agg(F.count("*").alias("_n"))
    each = beats.withColumn("meter", F.explode(F.array(*[F.lit(m) for m in METER_PRIORS]))).withColumn("_phase", F.pmod(F.col(idx), F.col("meter")))
    phases = each.groupBy(*keys, "meter", "_phase").agg(F.avg(strength).alias("_a"))
    scores = phases.groupBy(*keys, "meter").agg(((F.max("_a") - F.avg("_a")) * F.first(F.element_at(priors, F.col("meter")))).alias("score"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("meter").alias("m"))))
    top = scores.groupBy(*keys).agg(ranked.alias("r")).join(n_of, keys)
    s1, s2 = -F.get("r", 0)["s"], -F.get("r", 1)["s"]
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(s1 - s2, s1 + F.greatest(s2, F.lit(0.0)) + 1e-9)))
    short = F.col("_n") < 2 * max(METER_PRIORS)
    return top.select(*keys, F.when(short, 4).otherwise(F.get("r", 0)["m"]).alias("meter"), F.when(short, 0.0).otherwise(sure).alias("confidence"))


def downbeat_phase(beats: DataFrame, keys: list[str], idx: str, strength: str, n: str) -> DataFrame:
    """The phase (idx mod n) with the largest sum of strength; ties: the lowest."""
    sums = beats.groupBy(*keys, F.pmod(F.col(idx), F.col(n)).alias("phase")).agg(F.sum(strength).alias("_s"))
    return sums.groupBy(*keys).agg(F.min_by("phase", F.struct(-F.col("_s"), F.col("phase"))).alias("phase"))


def precision_recall(df: DataFrame, keys: list[str], predicted: Column, target: Column, weight: Column | None = None) -> DataFrame:
    """Precision, recall and F1 of 0/1 predictions; masked rows have weight 0; denominators are 1 at least."""
    w = weight if weight is not None else F.lit(1.0)
    p, t = predicted.cast("double"), target.cast("double")
    s = df.groupBy(*keys).agg(F.sum(p * t * w).alias("tp"), F.sum(p * w).alias("_p"), F.sum(t * w).alias("_t"), F.sum(w).alias("weight"))
    pr, rc = F.col("tp") / F.greatest("_p", F.lit(1.0)), F.col("tp") / F.greatest("_t", F.lit(1.0))
    out = s.select(*keys, "weight", (F.col("_t") / F.greatest("weight", F.lit(1.0))).alias("share"), pr.alias("precision"), rc.alias("recall"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumn("f1", f1)


def auc(df: DataFrame, keys: list[str], score: Column, positive: Column) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half; null if a class is empty.

    Counts per distinct score first, so ranks are running sums over distinct values only.
    """
    per = df.groupBy(*keys, score.alias("_x")).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n")).where("_x is not null")
    below = Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    ranked = per.withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0)))
    s = ranked.groupBy(*keys).agg(F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2.0)).alias("_u"), F.sum("_p").alias("positives"), F.sum("_n").alias("negatives"))
    return s.select(*keys, "positives", "negatives", F.try_divide(F.col("_u"), F.col("positives").cast("double") * F.col("negatives")).alias("auc"))


def found_at(df: DataFrame, keys: list[str], score: Column, positive: Column, budget: float) -> DataFrame:
    """Share of negatives strictly below the `budget` quantile of the positives' scores."""
    q = df.where(positive).groupBy(*keys).agg(F.percentile(score, F.lit(budget)).alias("cut"))
    return df.where(~positive).join(q, keys).groupBy(*keys).agg(F.first("cut").alias("cut"), F.avg((score < F.col("cut")).cast("double")).alias("found"))


def pair_agreement(df: DataFrame, keys: list[str], ref: str, est: str) -> DataFrame:
    """Pairwise precision, recall and F1 of two labellings from contingency counts; null is a label like any other."""
    sets = [[*keys, ref, est], [*keys, ref], [*keys, est]]
    # one pass over the cells, then the marginals of the cells
    cells = df.groupBy(*keys, ref, est).agg(F.count("*").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    counted = cells.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in [*keys, ref, est]]).agg(F.sum("n").alias("n"), F.grouping(ref).alias("gr"), F.grouping(est).alias("ge"))
    of = lambda r, e: F.sum(F.when((F.col("gr") == r) & (F.col("ge") == e), pairs(F.col("n"))).otherwise(0.0))
    s = counted.groupBy(*keys).agg(of(0, 0).alias("_b"), of(0, 1).alias("_r"), of(1, 0).alias("_e"))
    out = s.select(*keys, F.coalesce(F.try_divide(F.col("_b"), F.col("_e")), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(F.col("_b"), F.col("_r")), F.lit(0.0)).alias("recall"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def si_sdr(df: DataFrame, keys: list[str], ref: Column, est: Column, eps: float = 1e-8) -> DataFrame:
    """Scale-invariant signal-to-distortion ratio in dB of zero-mean signals, from their moments alone."""
    r, e = ref.cast("double"), est.cast("double")
    m = df.groupBy(*keys).agg(F.count(r * e).alias("n"), F.covar_pop(r, e).alias("_re"), F.var_pop(r).alias("_rr"), F.var_pop(e).alias("_ee"))
    n = F.col("n")
    a = F.try_divide(F.col("_re"), F.greatest(F.col("_rr"), F.lit(1e-300)))
    target = a * a * F.col("_rr") * n
    rest = F.greatest(F.lit(0.0), (F.col("_ee") - 2 * a * F.col("_re") + a * a * F.col("_rr")) * n)
    return m.select(*keys, "n", (10 * F.log10((target + eps) / (rest + eps))).alias("si_sdr"))


def window_stats(df: DataFrame, keys: list[str], p: Column) -> DataFrame:
    """Shares at .5 and .2, mean, lower median, linear 90th percentile and maximum of each key's window scores."""
    return df.groupBy(*keys).agg(
        F.avg((p >= 0.5).cast("double")).alias("share_50"),
        F.avg((p >= 0.2).cast("double")).alias("share_20"),
        F.avg(p).alias("mean"),
        F.percentile(p, F.lit(0.9)).alias("p90"),
        F.max(p).alias("top"),
        F.count(p).alias("n"),
    )


def lower_median(df: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column) -> DataFrame:
    """The lower of the two middle values of each key."""
    placed = index_rows(df.where(F.col(value).isNotNull()), keys, order, bucket)
    n = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n"))
    return placed.join(n, keys).where(F.col("idx") == F.floor((F.col("_n") - 1) / 2)).select(*keys, F.col(value).alias("lower_median"))


def prune_oldest(items: DataFrame, order: list[str], size: str, bucket: Column, budget: float) -> DataFrame:
    """Items to evict, oldest first, until the rest fits the budget; adds `before`: the size of all older ones."""
    one = items.withColumn("_all", F.lit(0))
    summed = running_sum(one, ["_all"], order, bucket, F.col(size).cast("double"), "_to")
    total = one.groupBy("_all").agg(F.sum(F.col(size).cast("double")).alias("_total"))
    before = F.col("_to") - F.col(size).cast("double")
    return summed.join(F.broadcast(total), "_all").withColumn("before", before).where(F.col("_total") - F.col("before") > budget).drop("_all", "_to", "_total")


#: Steps that a draw is compared with one by one; every table of steps has more.
FIRST_STEPS = 8


def poisson_steps(rate: Column) -> Column:
    """Cumulated Poisson probabilities of 0, 1, 2, ... up to where a draw of 32 bits can't lie."""
    start = F.array(F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("sum")))

    def step(s: Column, k: Column) -> Column:
        p = F.element_at(s, -1)["p"] * rate / k
        return F.concat(s, F.array(F.struct(p.alias("p"), (F.element_at(s, -1)["sum"] + p).alias("sum"))))

    return F.transform(F.aggregate(F.sequence(F.lit(1), 12 + 3 * F.ceil(rate).cast("int")), start, step), lambda x: x["sum"])


def bootstrap(df: DataFrame, group: str, item: str, value: str, draws: int, seed: str, bucket: Column) -> DataFrame:
    """Means of `draws` resamples, first of groups, then of items within them, with their 95 % interval from sorted places.

    Draws are hashes, so results repeat. How often a draw takes each group is counted from as many slots as there are groups (a multinomial count); how often it takes an item of a
    group that it took c times is a Poisson count of rate c of its own, so items are never gathered, numbered or written once a draw: each adds to the draws' sums where it is read.
    bucket: an expression of the group that follows its order, for numbering groups.
    """
    from tactus.functions.scalar import uniform

    groups = df.where(F.col(group).isNotNull()).select(group).distinct().withColumn("_all", F.lit(0))
    placed = cut(index_rows(groups, ["_all"], [group], bucket, "_g").drop("_all"), "places")
    n = placed.count()
    draw = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")
    slots = df.sparkSession.range(n).select(F.col("id").alias("slot"), draw)
    taken = slots.groupBy("draw", F.floor(uniform(F.concat_ws("/", "draw", "slot"), seed) * n).alias("_g")).agg(F.count("*").alias("c"))
    taken = taken.join(placed, "_g").groupBy(group).agg(F.collect_list(F.struct("draw", poisson_steps(F.col("c").cast("double")).alias("steps"))).alias("_taken"))
    each = df.select(group, F.col(item).alias("_item"), F.col(value).cast("double").alias("_v")).where("_v is not null").join(taken, group).select(group, "_item", "_v", F.inline("_taken"))
    u = uniform(F.concat_ws("/", "draw", group, "_item"), seed, 1)
    # u is named twice, so that it stays a column of its own and isn't worked out again for each step; nearly all draws lie below one of the first steps, which are compared in compiled code
    times = F.when(F.col("_u").isNull(), 0)
    for k in range(FIRST_STEPS):
        times = times.when(F.col("_u") < F.get("steps", F.lit(k)), k)
    times = times.otherwise(F.size(F.filter("steps", lambda x: (x <= F.col("_u")) & (F.col("_u") >= 0))))
    means = each.withColumn("_u", u).withColumn("_w", times).groupBy("draw").agg(F.try_divide(F.sum(F.col("_w") * F.col("_v")), F.sum("_w")).alias("mean"))
    s = F.array_sort(F.collect_list("mean"))
    return means.agg(F.avg("mean").alias("mean"), F.get(s, F.lit(int(0.025 * draws))).alias("low"), F.get(s, F.lit(int(0.975 * draws) - 1)).alias("high"))
