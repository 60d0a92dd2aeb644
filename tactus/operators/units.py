"""Scores of separated sources and of presence, where some sources are only known as a sum.

A sample or an item has an array with a value for each source. Sources of a group can be folded into one unit, which is scored like a source of its own: its
signal is the sum of their signals, it is present if any of them is, and its probability is that of at least one (noisy or).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Number of the unit that stands for the group.
GROUP = -1
#: Levels in dB above which a source sounds, and below which it is silent.
ACTIVE_DB, SILENT_DB = -50.0, -60.0


def _at(x: Column, k: int) -> Column:
    return F.get(x, F.lit(k)).cast("double")


def _rest(n: int, group: list[int]) -> list[int]:
    return [k for k in range(n) if k not in group]


def fold(x: Column, n: int, group: list[int] | None) -> Column:
    """Values of the units: those of the other sources in order, then the group's sum. Without a group the sources are the units."""
    if group is None:
        return x
    return F.array(*[_at(x, k) for k in _rest(n, group)], reduce(lambda a, b: a + b, [_at(x, k) for k in group]))


def unit_presence(x: Column, n: int, group: list[int] | None) -> Column:
    """Presence of the units: the group's is the largest of its sources'."""
    if group is None:
        return x
    return F.array(*[_at(x, k) for k in _rest(n, group)], F.greatest(*[_at(x, k) for k in group]) if len(group) > 1 else _at(x, group[0]))


def expand(units: Column, n: int, group: list[int] | None) -> Column:
    """Values of the sources: each source of the group has the value of the last unit."""
    if group is None:
        return units
    rest = _rest(n, group)
    return F.array(*[_at(units, len(rest) if k in group else rest.index(k)) for k in range(n)])


def _at_least_one(p: list[Column]) -> Column:
    return 1 - reduce(lambda a, b: a * b, [1 - x for x in p])


def _decibel(power: Column) -> Column:
    return 10 * F.log10(power + 1e-12)


def _si_sdr(re: Column, rr: Column, ee: Column, eps: float = 1e-8) -> Column:
    """From sums of products of zero-mean signals."""
    a = re / F.greatest(rr, F.lit(eps))
    return 10 * F.log10((a * a * rr + eps) / (F.greatest(F.lit(0.0), ee - 2 * a * re + a * a * rr) + eps))


def unit_stats(samples: DataFrame, keys: list[str], n: int, est: str, ref: str, mix: str, known: str, group_mask: str | None = None, group_ref: str | None = None) -> DataFrame:
    """A row for each item (keys) and source, and for the group as unit GROUP: l1, power, si_sdr, baseline (the mix as the estimate), mix_power, known.

    est, ref: arrays of n values in each sample row; known: array of n, 1 where the source's own signal is known; group_mask: array of n, 1 for sources whose sum alone is known, with group_ref as
    that sum. Masks are the same in all rows of an item. Sums are taken where rows are read; items are never gathered.
    """
    parts = [F.struct(F.lit(k).alias("unit"), _at(F.col(est), k).alias("e"), _at(F.col(ref), k).alias("r"), (_at(F.col(known), k) > 0).alias("known")) for k in range(n)]
    if group_mask is not None:
        masked = reduce(lambda a, b: a + b, [_at(F.col(est), k) * _at(F.col(group_mask), k) for k in range(n)])
        parts.append(F.struct(F.lit(GROUP).alias("unit"), masked.alias("e"), F.col(group_ref).cast("double").alias("r"), (F.array_max(group_mask) > 0).alias("known")))
    x = samples.select(*keys, F.col(mix).cast("double").alias("m"), F.inline(F.array(*parts)))
    r, e, m, c = F.col("r"), F.col("e"), F.col("m"), F.count("*")
    s = x.groupBy(*keys, "unit").agg(
        F.avg(F.abs(e - r)).alias("l1"), F.avg(r * r).alias("power"), F.avg(m * m).alias("mix_power"), F.bool_or("known").alias("known"), (F.covar_pop(e, r) * c).alias("_re"), (F.var_pop(r) * c).alias("_rr"),
        (F.var_pop(e) * c).alias("_ee"), (F.covar_pop(m, r) * c).alias("_rm"), (F.var_pop(m) * c).alias("_mm"),
    )
    sdr, base = _si_sdr(F.col("_re"), F.col("_rr"), F.col("_ee")), _si_sdr(F.col("_rm"), F.col("_rr"), F.col("_mm"))
    return s.select(*keys, "unit", "l1", "power", "mix_power", sdr.alias("si_sdr"), base.alias("baseline"), "known")


def separation_scores(stats: DataFrame, by: list[str], active_db: float = ACTIVE_DB) -> DataFrame:
    """For each unit the mean SI-SDR, the improvement over the mix and the number of items where it is known and sounds; means of nothing are 0."""
    valid = F.col("known") & (_decibel(F.col("power")) > active_db)
    n = F.count_if(valid)
    mean = lambda c: F.sum(F.when(valid, c).otherwise(0.0)) / F.greatest(n, F.lit(1))
    out = stats.groupBy(*by, "unit").agg(mean(F.col("si_sdr")).alias("si_sdr"), mean(F.col("si_sdr") - F.col("baseline")).alias("improvement"), n.alias("examples"))
    return out.where((F.col("unit") != GROUP) | (F.col("examples") > 0))


def separation_loss(stats: DataFrame, by: list[str], kind: str = "l1", silent_weight: float = 1.0, present_weights: list[float] | None = None) -> DataFrame:
    """by, loss, targets: the mean error over known targets, the group's sum as one more.

    kind: `l1`; `norm_l1`: a tenth of it by the target's level plus a tenth of the mix's and 1e-4; `sisdr`: for sources that sound the negative SI-SDR within 30 dB, in hundredths, for others
    `l1`. The group is always `l1`. Targets below SILENT_DB weigh silent_weight, sounding ones of source k present_weights[k]; weights don't change the divisor.
    """
    if kind not in ("l1", "norm_l1", "sisdr"):
        raise ValueError(f"no loss named {kind!r}")
    group, level = F.col("unit") == GROUP, _decibel(F.col("power"))
    error = {
        "l1": F.col("l1"),
        "norm_l1": 0.1 * F.col("l1") / (F.sqrt("power") + 0.1 * F.sqrt("mix_power") + 1e-4),
        "sisdr": F.when(level > ACTIVE_DB, -0.01 * F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("si_sdr")))).otherwise(F.col("l1")),
    }[kind]
    weight = F.when(level < SILENT_DB, silent_weight).otherwise(1.0)
    if present_weights is not None:
        weight = weight * F.when(level > ACTIVE_DB, F.get(F.lit(present_weights), F.col("unit"))).otherwise(1.0)
    each = F.when(group, F.col("l1")).otherwise(error * weight)
    known = F.col("known").cast("long")
    return stats.groupBy(*by).agg((F.sum(each * known) / F.greatest(F.sum(known), F.lit(1))).alias("loss"), F.sum(known).alias("targets"))


def presence_scores(items: DataFrame, by: list[str], n: int, prob: str, target: str, weight: str, group: list[int] | None = None, group_known: str | None = None, group_target: str | None = None, threshold: float = 0.5) -> DataFrame:
    """by, unit, precision, recall, f1, share (of weight that is present). The group, as unit GROUP, is scored by noisy or.

    prob, target, weight: arrays of n for each item. Where group_known (an array of n) marks a source, only group_target says whether any is present; elsewhere the group is present if
    one of its sources is, with their least weight.
    """
    parts = [F.struct(F.lit(k).alias("unit"), (_at(F.col(prob), k) > threshold).alias("p"), _at(F.col(target), k).alias("t"), _at(F.col(weight), k).alias("w")) for k in range(n)]
    if group is not None:
        unknown = F.array_max(group_known) > 0
        most = lambda c, f: f(*[_at(F.col(c), k) for k in group]) if len(group) > 1 else _at(F.col(c), group[0])
        t, w = F.when(unknown, F.col(group_target).cast("double")).otherwise(most(target, F.greatest)), F.when(unknown, F.lit(1.0)).otherwise(most(weight, F.least))
        parts.append(F.struct(F.lit(GROUP).alias("unit"), (_at_least_one([_at(F.col(prob), k) for k in group]) > threshold).alias("p"), t.alias("t"), w.alias("w")))
    x = items.select(*by, F.inline(F.array(*parts)))
    p, t, w = F.col("p").cast("double"), F.col("t"), F.col("w")
    s = x.groupBy(*by, "unit").agg(F.sum(p * t * w).alias("_tp"), F.sum(p * (1 - t) * w).alias("_fp"), F.sum((1 - p) * t * w).alias("_fn"), F.sum(t * w).alias("_t"), F.sum(w).alias("_w"))
    share = lambda a, b: F.col("_tp") / F.greatest(F.col(a) + F.col(b), F.lit(1.0))
    s = s.withColumns({"precision": share("_tp", "_fp"), "recall": share("_tp", "_fn")})
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9))
    return s.select(*by, "unit", "precision", "recall", f1.alias("f1"), (F.col("_t") / F.greatest(F.col("_w"), F.lit(1.0))).alias("share"))


def mean_f1(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, mean_f1 over the sources, the group left out."""
    return scores.where(F.col("unit") != GROUP).groupBy(*by).agg(F.avg("f1").alias("mean_f1"))


def presence_loss(items: DataFrame, by: list[str], n: int, logits: str, target: str, weight: str, group: list[int] | None = None, group_weight: str | None = None) -> DataFrame:
    """by, loss: weighted binary cross entropy of logits, and for items with group_weight the log of the chance that at least one source of the group is present."""
    each = []
    for k in range(n):
        x, t, w = _at(F.col(logits), k), _at(F.col(target), k), _at(F.col(weight), k)
        each.append(F.struct(((F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))) * w).alias("sum"), w.alias("w")))
    if group is not None:
        one = _at_least_one([1 / (1 + F.exp(-_at(F.col(logits), k))) for k in group])
        w = F.col(group_weight).cast("double")
        each.append(F.struct((-F.log(F.greatest(one, F.lit(1e-6))) * w).alias("sum"), w.alias("w")))
    x = items.select(*by, F.inline(F.array(*each)))
    return x.groupBy(*by).agg((F.sum("sum") / F.greatest(F.sum("w"), F.lit(1.0))).alias("loss"))

