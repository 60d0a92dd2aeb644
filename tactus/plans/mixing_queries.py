"""Queries of separation and presence scores with a group as one unit, and of training mixes.

A supplier's orders are samples; lines one to seven are four sources. Suppliers divisible by three know the sum of the last two sources only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tactus.functions import scalar as S
from tactus.operators import mixing as X
from tactus.operators import units as U
from tactus.plans.series_queries import r6
from tactus.plans.table_queries import tb

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
N, GROUP = 4, [2, 3]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def signals(spark, d):
    """item, idx, ref and est (arrays by source), mix, known, group_mask, group_ref."""
    l = tb(spark, d, "lineitem")
    line, item = F.col("l_linenumber"), F.col("l_suppkey")
    k = F.when(line <= 2, line - 1).when(line <= 4, 2).otherwise(3)
    ref = F.col("l_quantity") * F.when((item % 5 == 0) & (line == 2), 0.00001).otherwise(1.0)
    x = l.select(item.alias("item"), F.col("l_orderkey").alias("idx"), k.alias("k"), ref.alias("r"), (ref * (1 + F.col("l_discount")) - 10 * F.col("l_tax")).alias("e"))
    arrays = {c: F.array(*[F.sum(F.when(F.col("k") == i, F.col(c)).otherwise(0.0)) for i in range(N)]) for c in ("r", "e")}
    s = x.groupBy("item", "idx").agg(arrays["r"].alias("ref"), arrays["e"].alias("est"), F.sum("r").alias("mix"))
    some = F.col("item") % 3 == 0
    mask = lambda a, b: F.when(some, F.lit(a)).otherwise(F.lit(b))
    return s.withColumns({"known": mask([1, 1, 0, 0], [1, 1, 1, 1]), "group_mask": mask([0, 0, 1, 1], [0, 0, 0, 0]), "group_ref": F.get("ref", F.lit(2)) + F.get("ref", F.lit(3))})


def stats(spark, d):
    return U.unit_stats(signals(spark, d), ["item"], N, "est", "ref", "mix", "known", "group_mask", "group_ref")


_STATS = """with l as (select l_suppkey as item, l_orderkey as idx, case when l_linenumber <= 2 then l_linenumber - 1 when l_linenumber <= 4 then 2 else 3 end as k,
        l_quantity * (case when l_suppkey % 5 = 0 and l_linenumber = 2 then 0.00001::double else 1.0::double end) as r, l_discount as dd, l_tax as tx from lineitem),
    a as (select item, idx, k, sum(r) as r, sum(r * (1 + dd) - 10 * tx) as e from l group by all), m as (select item, idx, sum(r) as m from l group by all),
    s as (select m.item, m.idx, u.k, m.m, coalesce(a.r, 0) as r, coalesce(a.e, 0) as e from m cross join (select unnest(range(4)) as k) u left join a on a.item = m.item and a.idx = m.idx and a.k = u.k),
    w as (select item, idx, k as unit, m, r, e, item % 3 <> 0 or k < 2 as known from s union all
        select item, idx, -1, any_value(m), sum(r) filter (k >= 2), coalesce(sum(e) filter (k >= 2 and item % 3 = 0), 0), item % 3 = 0 from s group by item, idx),
    c as (select item, unit, bool_or(known) as known, avg(abs(e - r)) as l1, avg(r * r) as power, avg(m * m) as mix_power, covar_pop(e, r) * count(*) as re, var_pop(r) * count(*) as rr, var_pop(e) * count(*) as ee,
        covar_pop(m, r) * count(*) as rm, var_pop(m) * count(*) as mm from w group by item, unit),
    f as (select *, re / greatest(rr, 1e-8) as a, rm / greatest(rr, 1e-8) as b, 10 * log10(power + 1e-12) as level from c),
    t as (select *, 10 * log10((a * a * rr + 1e-8) / (greatest(0, ee - 2 * a * re + a * a * rr) + 1e-8)) as sdr, 10 * log10((b * b * rr + 1e-8) / (greatest(0, mm - 2 * b * rm + b * b * rr) + 1e-8)) as base from f)"""


@query(f"""{_STATS}, g as (select unit, count(*) filter (known and level > -50) as examples, coalesce(sum(sdr) filter (known and level > -50), 0) as x, coalesce(sum(sdr - base) filter (known and level > -50), 0) as y from t group by unit)
    select unit, round(x / greatest(examples, 1), 5) as si_sdr, round(y / greatest(examples, 1), 5) as improvement, examples from g where unit <> -1 or examples > 0""")
def a14_source_scores(spark, d):
    s = U.separation_scores(stats(spark, d), [])
    return s.select("unit", r6("si_sdr", 5).alias("si_sdr"), r6("improvement", 5).alias("improvement"), "examples")


def _loss_sql(error: str) -> str:
    w = "(case when level < -60 then 2.0 else 1.0 end) * (case when level > -50 then [1.0, 3.0, 1.0, 0.5][unit + 1] else 1.0 end)"
    return f"sum((case when unit = -1 then l1 else {error} * {w} end) * known::int) / greatest(sum(known::int), 1)"


_NORM, _SDR = "0.1 * l1 / (sqrt(power) + 0.1 * sqrt(mix_power) + 1e-4)", "case when level > -50 then -0.01 * greatest(-30, least(30, sdr)) else l1 end"


@query(f"""{_STATS} select item, round({_loss_sql('l1')}, 6) as l1, round({_loss_sql(_NORM)}, 8) as norm_l1, round({_loss_sql('(' + _SDR + ')')}, 6) as hybrid, sum(known::int)::bigint as targets from t group by item""")
def a16_group_loss(spark, d):
    """Three losses of each item: absolute, normal, and by SI-SDR where a source sounds; the group's sum is one more target."""
    s = stats(spark, d)
    losses = [U.separation_loss(s, ["item"], k, 2.0, [1.0, 3.0, 1.0, 0.5]).withColumnRenamed("loss", n) for k, n in (("l1", "l1"), ("norm_l1", "norm_l1"), ("sisdr", "hybrid"))]
    out = losses[0].join(losses[1].drop("targets"), "item").join(losses[2].drop("targets"), "item")
    return out.select("item", r6("l1").alias("l1"), r6("norm_l1", 8).alias("norm_l1"), r6("hybrid").alias("hybrid"), "targets")


@query("""with x as (select o_custkey as c, l_orderkey, list(l_quantity order by l_linenumber, l_quantity, l_discount) as q, list(l_discount order by l_linenumber, l_quantity, l_discount) as p from orders join lineitem on o_orderkey = l_orderkey where l_linenumber <= 4 group by all having count(*) = 4)
    select l_orderkey, [q[1], q[3] + q[4] + q[2]] as units, round(greatest(p[2], p[3], p[4]), 6) as presence, [q[1], q[2] + q[3] + q[4], q[2] + q[3] + q[4], q[2] + q[3] + q[4]] as expanded from x""")
def f27_units(spark, d):
    """Orders of four lines and more: the first line alone, the next three as one unit."""
    l = tb(spark, d, "lineitem").where("l_linenumber <= 4").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_discount"))).alias("x")).where("size(x) = 4")
    of = lambda c: F.transform("x", lambda s: s[c].cast("double"))
    q, p = of("l_quantity"), of("l_discount")
    units = U.fold(q, 4, [1, 2, 3])
    return l.select("l_orderkey", units.alias("units"), r6(F.get(U.unit_presence(p, 4, [1, 2, 3]), F.lit(1))).alias("presence"), U.expand(units, 4, [1, 2, 3]).alias("expanded"))


def presence_items(spark, d):
    """An item for each order: four probabilities, targets and weights from its lines; orders divisible by four know only whether any of the last two is present."""
    l = tb(spark, d, "lineitem").where("l_linenumber <= 4").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag"))).alias("x")).where("size(x) = 4")
    some = F.col("l_orderkey") % 4 == 0
    of = lambda f: F.transform("x", f)
    known = F.when(some, F.lit([1.0, 1.0, 0.0, 0.0])).otherwise(F.lit([1.0, 1.0, 1.0, 1.0]))
    return l.select(
        "l_orderkey", of(lambda s: s["l_quantity"].cast("double") / 50).alias("prob"), of(lambda s: s["l_quantity"].cast("double") / 10 - 2.5).alias("logits"), of(lambda s: (s["l_discount"] > 0.05).cast("double")).alias("target"),
        F.zip_with(known, "x", lambda w, s: w * (1 + s["l_tax"].cast("double"))).alias("weight"), F.when(some, F.lit([0, 0, 1, 1])).otherwise(F.lit([0, 0, 0, 0])).alias("group_known"),
        (F.get("x", F.lit(2))["l_discount"] + F.get("x", F.lit(3))["l_discount"] > 0.08).cast("double").alias("group_target"), some.cast("double").alias("group_weight"),
        F.get("x", F.lit(0))["l_returnflag"].alias("flag"),
    )


_PRESENCE = """with x as (select l_orderkey, list(l_quantity order by l_linenumber, l_quantity, l_discount, l_tax, l_returnflag) as q, list(l_discount order by l_linenumber, l_quantity, l_discount, l_tax, l_returnflag) as dd, list(l_tax order by l_linenumber, l_quantity, l_discount, l_tax, l_returnflag) as tx, list(l_returnflag order by l_linenumber, l_quantity, l_discount, l_tax, l_returnflag) as f from lineitem where l_linenumber <= 4 group by l_orderkey having count(*) = 4),
    e as (select l_orderkey, f[1] as flag, unnest(range(4)) as k, l_orderkey % 4 = 0 as part, q, dd, tx from x),
    r as (select *, q[k + 1] / 50 as p, q[k + 1] / 10 - 2.5 as z, (dd[k + 1] > 0.05)::int as t, (case when part and k >= 2 then 0 else 1 end) * (1 + tx[k + 1]) as w from e),
    g as (select l_orderkey, any_value(flag) as flag, any_value(part) as part, 1 - product(1 - p) filter (k >= 2) as p, 1 - product(1 - 1 / (1 + exp(-z))) filter (k >= 2) as one,
        case when any_value(part) then (any_value(dd[3] + dd[4]) > 0.08)::int else max(t) filter (k >= 2) end as t, case when any_value(part) then 1.0 else min(w) filter (k >= 2) end as w from r group by l_orderkey)"""


@query(f"""{_PRESENCE}, a as (select flag, k as unit, (p > 0.5)::int as p, t, w from r union all select flag, -1, (p > 0.5)::int, t, w from g),
    s as (select flag, unit, sum(p * t * w) as tp, sum(p * (1 - t) * w) as fp, sum((1 - p) * t * w) as fn, sum(t * w) as t, sum(w) as w from a group by all),
    v as (select *, tp / greatest(tp + fp, 1) as pr, tp / greatest(tp + fn, 1) as re from s)
    select flag, unit, round(pr, 6) as precision, round(re, 6) as recall, round(2 * pr * re / greatest(pr + re, 1e-9), 6) as f1, round(t / greatest(w, 1), 6) as share from v""")
def a13_presence_scores(spark, d):
    s = U.presence_scores(presence_items(spark, d), ["flag"], N, "prob", "target", "weight", GROUP, "group_known", "group_target")
    return s.select("flag", "unit", *[r6(c).alias(c) for c in ("precision", "recall", "f1", "share")])


@query(f"""{_PRESENCE}, a as (select flag, (greatest(z, 0) - z * t + ln(1 + exp(-abs(z)))) * w as s, w from r union all select flag, -ln(greatest(one, 1e-6)) * part::int, part::int from g)
    select flag, round(sum(s) / greatest(sum(w), 1), 6) as loss from a group by flag""")
def a17_group_loss(spark, d):
    s = U.presence_loss(presence_items(spark, d), ["flag"], N, "logits", "target", "weight", GROUP, "group_weight")
    return s.select("flag", r6("loss").alias("loss"))


# --- mixes ---


def song_signals(spark, d):
    """track (supplier), idx (quarter of a year), sources: mean quantities of lines one to four."""
    l = tb(spark, d, "lineitem")
    s = [F.coalesce(F.avg(F.when(F.col("l_linenumber") == k + 1, F.col("l_quantity"))), F.lit(0.0)) for k in range(N)]
    return l.groupBy(F.col("l_suppkey").alias("track"), F.quarter("l_shipdate").alias("idx")).agg(F.array(*s).alias("sources"))


def mix_items(spark, d):
    return tb(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_partkey").alias("part")).join(tb(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.min("l_suppkey").alias("track")), "part").drop("part")


def donors(spark, d):
    return X.remix_donors(mix_items(spark, d), tb(spark, d, "supplier").select(F.col("s_suppkey").alias("track")), "item", "track", F.floor(F.col("track") / 4096), N, 0.5, seed=20, epoch=3, own=False)


_MIX = """with n as (select s_suppkey as track, row_number() over (order by s_suppkey) - 1 as number, count(*) over () as n from supplier),
    i as (select l_partkey as item, min(l_suppkey) as track from lineitem group by 1), b as (select i.item, n.number as own, n.n, '20/' || i.item || '/3' as base, unnest(range(4)) as source from i join n using (track)),
    u as (select *, ('0x' || md5(base || '|remix|0')[1:8])::bigint / 4294967296.0::double < 0.5 as remix, floor(('0x' || md5(base || '/' || source || '|donor|0')[1:8])::bigint / 4294967296.0::double * (n - 1))::bigint as drawn,
        floor(('0x' || md5(base || '/' || source || '|seed|0')[1:8])::bigint / 4294967296.0::double * 2147483647)::bigint as seed from b),
    o as (select item, source::int as source, case when remix then drawn + (drawn >= own)::int else own end as number, case when remix then seed end as seed from u),
    dn as (select o.item, o.source, n.track, o.seed from o join n using (number))"""


@query(f"{_MIX} select item, source, track, seed from dn")
def g08_donors(spark, d):
    """Half of the parts are remixes: each of four sources from another supplier than the part's own."""
    return donors(spark, d)


_SIGNALS = "s as (select l_suppkey as track, quarter(l_shipdate) as idx, [coalesce(avg(l_quantity) filter (l_linenumber = 1), 0), coalesce(avg(l_quantity) filter (l_linenumber = 2), 0), coalesce(avg(l_quantity) filter (l_linenumber = 3), 0), coalesce(avg(l_quantity) filter (l_linenumber = 4), 0)] as v from lineitem group by all)"


@query(f"""{_MIX}, {_SIGNALS}, m as (select item, idx, sum(v[source + 1]) as mix, coalesce(sum(case when source = 1 then v[2] end), 0) as second from dn join s using (track) group by item, idx), c as (select item, least(1, 90 / greatest(max(abs(mix)), 1e-9)) as scale from m group by item)
    select item, idx, round(mix * scale, 6) as mix, round(second * scale, 6) as second, round(scale, 6) as scale from m join c using (item)""")
def g08_remix(spark, d):
    """The mixes: each part's sources from its donors, limited to a peak of 90."""
    x = X.remix(donors(spark, d), song_signals(spark, d), "item", "track", "idx", N, 90.0)
    return x.select("item", F.col("idx").cast("long").alias("idx"), r6("mix").alias("mix"), r6(F.get("sources", F.lit(1))).alias("second"), r6("scale").alias("scale"))


@query(f"""with {_SIGNALS}, a as (select track as item, idx, list_sum(v) as mix, v[3] as third, ('0x' || md5('7/' || track || '/0|voice|0')[1:8])::bigint / 4294967296.0::double < 0.4 as added, power(10, (-6 + 12 * (('0x' || md5('7/' || track || '/0|gain|0')[1:8])::bigint / 4294967296.0::double)) / 20) as gain from s),
    v as (select l_suppkey as item, quarter(l_shipdate) as idx, avg(l_discount) * 400 as voice from lineitem where l_returnflag <> 'A' group by all),
    j as (select a.*, case when added then coalesce(voice, 0) * gain else 0 end as x from a left join v using (item, idx)), c as (select item, least(1, 100 / greatest(max(abs(mix + x)), 1e-9)) as scale from j where added group by item)
    select item, idx, round((mix + x) * coalesce(scale, 1), 6) as mix, round((third + x) * coalesce(scale, 1), 6) as third, added, round(coalesce(scale, 1), 6) as scale from j left join c using (item)""")
def g07_voices(spark, d):
    """A voice on the third source of two fifths of the suppliers, at a drawn gain, limited to a peak of 100."""
    s = song_signals(spark, d).withColumnRenamed("track", "item").withColumn("mix", F.aggregate("sources", F.lit(0.0), lambda a, x: a + x))
    v = tb(spark, d, "lineitem").where("l_returnflag <> 'A'").groupBy(F.col("l_suppkey").alias("item"), F.quarter("l_shipdate").alias("idx")).agg((F.avg("l_discount") * 400).alias("voice"))
    x = X.add_voice(s, v, "item", "idx", 2, 0.4, seed=7, peak=100.0)
    return x.select("item", F.col("idx").cast("long").alias("idx"), r6("mix").alias("mix"), r6(F.get("sources", F.lit(2))).alias("third"), "added", r6("scale").alias("scale"))


@query("""select c_custkey, case when c_acctbal < 0 then 'no' else 'yes' end as effects, c_mktsegment as name, case when c_nationkey % 2 = 0 then c_nationkey::varchar end as crop from customer""")
def g14_overridden_settings(spark, d):
    """Settings of customers with others on top; an entry that is null on top is null."""
    s = F.create_map(F.lit("effects"), F.lit("yes"), F.lit("name"), F.col("c_mktsegment"), F.lit("crop"), F.col("c_nationkey").cast("string"))
    nothing = F.create_map().cast("map<string,string>")
    over = F.map_concat(F.when(F.col("c_acctbal") < 0, F.create_map(F.lit("effects"), F.lit("no"))).otherwise(nothing), F.when(F.col("c_nationkey") % 2 > 0, F.create_map(F.lit("crop"), F.lit(None).cast("string"))).otherwise(nothing))
    m = X.overridden(s, over)
    return tb(spark, d, "customer").select("c_custkey", *[m[k].alias(k) for k in ("effects", "name", "crop")])


_DRAW = "('0x' || md5('5/' || s_suppkey || '|subset|0')[1:8])::bigint / 4294967296.0::double"


@query(f"""with o as (select s_suppkey, row_number() over (order by case s_suppkey when 3 then 0 when 1 then 1 else 2 end, {_DRAW}, s_suppkey) as k from supplier) select size, s_suppkey from o, (values (1), (3), (8)) t(size) where k <= size""")
def k24_nested_subsets(spark, d):
    """Subsets of suppliers, each in the next: two named ones, then others by a seeded order."""
    return X.nested_subsets(tb(spark, d, "supplier"), "s_suppkey", [1, 3, 8], F.floor(F.col("_draw") * 64), ["3", "1"], 5)


@query("select event_id, round_even(value / 8 * 10000.0::double, 0) / 10000 as label_time, round_even(value / 8 * 100.0::double, 0) / 100 as score from events")
def f29_rounded(spark, d):
    v = F.col("value") / 8
    return tb(spark, d, "events").select("event_id", S.rounded(v).alias("label_time"), S.rounded(v, 2).alias("score"))
