"""Queries on plain tables: lookups, scores, contingency, budgets, rankings, set operations, scalar functions and derived draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tactus.functions import scalar as S
from tactus.operators import aggregates as A
from tactus.operators import series as R

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def tb(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c, n: int = 6):
    return F.round(c, n)


# --- lookups and set operations ---


@query("""select s_suppkey, case r_name when 'ASIA' then 'east' when 'EUROPE' then 'west' when 'AMERICA' then 'west' else 'other' end as side from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey""")
def j13_dimension_lookup(spark, d):
    """Two dimension joins and a source map with a default; Spark broadcasts a dimension only below its size threshold."""
    s, n, r = tb(spark, d, "supplier"), tb(spark, d, "nation"), tb(spark, d, "region")
    sides = spark.createDataFrame([("ASIA", "east"), ("EUROPE", "west"), ("AMERICA", "west")], "r_name string, side string")
    out = s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").join(sides, "r_name", "left")
    return out.select("s_suppkey", F.coalesce("side", F.lit("other")).alias("side"))


@query("""select c.c_custkey, count(o.o_orderkey) as orders, case when count(o.o_orderkey) = 0 then 'ERROR: no orders' else 'ok' end as status from customer c left join orders o on o.o_custkey = c.c_custkey group by c.c_custkey""")
def j15_error_rows(spark, d):
    n = tb(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    out = tb(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left")
    return out.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.when(F.col("orders").isNull(), "ERROR: no orders").otherwise("ok").alias("status"))


@query("select d.doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def j16_only_missing(spark, d):
    return tb(spark, d, "documents").select("doc_id").join(tb(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""with m as (select l_suppkey, year(l_shipdate) as y, avg(l_discount) as v from lineitem group by all) select a.l_suppkey, round(avg(b.v - a.v), 6) as change, count(*) as years from m a join m b on a.l_suppkey = b.l_suppkey and b.y = a.y + 1 group by a.l_suppkey""")
def j19_paired_change(spark, d):
    m = tb(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("y")).agg(F.avg("l_discount").alias("v"))
    b = m.select("l_suppkey", (F.col("y") - 1).alias("y"), F.col("v").alias("w"))
    return m.join(b, ["l_suppkey", "y"]).groupBy("l_suppkey").agg(r6(F.avg(F.col("w") - F.col("v"))).alias("change"), F.count("*").alias("years"))


_GRID = "g as (select q.q::double as q, x.x::double as x from (values (10), (20), (30), (40)) q(q) cross join (values (0.02), (0.05), (0.08)) x(x))"


@query(f"""with {_GRID}, s as (select l_returnflag, l_quantity, l_discount, count(*) as n, sum(l_extendedprice) as p from lineitem group by all),
    k as (select q, x, l_returnflag, sum(p) / sum(n) as v from g join s on l_quantity >= q and l_discount <= x + 1e-9 group by all), m as (select q, x, avg(v) as score from k group by q, x)
    select q, x, round(score, 2) as score from (select *, row_number() over (order by score desc, q, x) as k from m) where k <= 5""")
def r04_sweep(spark, d):
    """Parameter grid against pre-aggregated groups (few hundred value pairs for each flag), ranked by mean score."""
    s = tb(spark, d, "lineitem").groupBy("l_returnflag", "l_quantity", "l_discount").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("p"))
    grid = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.lit(x).alias("x")) for q in (10, 20, 30, 40) for x in (0.02, 0.05, 0.08)])
    k = s.withColumn("g", F.explode(grid)).where((F.col("l_quantity") >= F.col("g.q")) & (F.col("l_discount") <= F.col("g.x") + 1e-9))
    m = k.groupBy("g.q", "g.x", "l_returnflag").agg((F.sum("p") / F.sum("n")).alias("v")).groupBy("q", "x").agg(F.avg("v").alias("score"))
    return m.orderBy(F.desc("score"), "q", "x").limit(5).select("q", "x", r6("score", 2).alias("score"))


@query("""select p_brand as name, 'only parts' as side from (select distinct p_brand from part where p_size > 45 except select distinct p_brand from part where p_type = 'SMALL' and p_size < 10) union all
    select * from (select p_brand, 'both' from part where p_size > 45 intersect select p_brand, 'both' from part where p_type = 'SMALL' and p_size < 10)""")
def u04_difference_and_intersection(spark, d):
    p = tb(spark, d, "part")
    a, b = p.where("p_size > 45").select(F.col("p_brand").alias("name")), p.where("p_type = 'SMALL' and p_size < 10").select(F.col("p_brand").alias("name"))
    return a.subtract(b).withColumn("side", F.lit("only parts")).unionAll(a.intersect(b).withColumn("side", F.lit("both")))


@query("""select 'event' as kind, event_id as id, value as size, null::varchar as error from events where value > 20 union all select 'event', event_id, null, 'too small' from events where value <= 20 union all select 'order', o_orderkey, o_totalprice, null from orders""")
def u05_results_and_errors(spark, d):
    e, o = tb(spark, d, "events"), tb(spark, d, "orders")
    ok = e.where("value > 20").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("value").alias("size"))
    bad = e.where("value <= 20").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.lit("too small").alias("error"))
    return ok.unionByName(bad, allowMissingColumns=True).unionByName(o.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("size")), allowMissingColumns=True)


# --- statistics and scores ---


@query("""select event_type, count(*) as n, round(sqrt(avg(value * value)), 6) as rms, max(abs(value)) as peak, count(*) filter (abs(value) >= 200) as clipped, round(count(*) filter (abs(value) >= 200) / count(*), 6) as clipped_share from events group by event_type""")
def a01_probe(spark, d):
    p = A.probe(tb(spark, d, "events"), ["event_type"], F.col("value"), 200)
    return p.select("event_type", "n", r6("rms").alias("rms"), "peak", "clipped", r6("clipped_share").alias("clipped_share"))


_MEANS = "m as (select label, k, avg(embedding[k]::double) as x from embeddings, range(1, 13) k(k) group by all), l as (select label, list(x order by k) as v, sqrt(sum(x * x)) as n from m group by label)"


def profiles(spark, d):
    """Mean of the first twelve dimensions of each label, scaled to length 1."""
    v = tb(spark, d, "embeddings").select("label", F.posexplode(F.slice("embedding", 1, 12)).alias("k", "x"))
    m = v.groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # twelve rows for each label
    m = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("v"))
    return m.withColumn("v", S.l2_normal(F.col("v")))


@query(f"with {_MEANS} select label, k, round(v[k] / n, 5) as x from l, range(1, 13) k(k)")
def a02_mean_profile(spark, d):
    return profiles(spark, d).select("label", F.posexplode("v").alias("k", "x")).select("label", (F.col("k") + 1).cast("long").alias("k"), r6("x", 5).alias("x"))


@query(f"""with {_MEANS}, p(minor, base) as (values (false, {list(S.MAJOR_PROFILE)}::double[]), (true, {list(S.MINOR_PROFILE)}::double[])),
    c as (select label, t.t as tonic, minor, corr(v[k.k + 1], base[((k.k - t.t + 12) % 12) + 1]) as r from l, p, range(0, 12) t(t), range(0, 12) k(k) group by all),
    o as (select *, row_number() over (partition by label order by r desc, tonic, minor) as place from c)
    select label, place, tonic::int as tonic, minor, round((r + 1) / 2, 5) as confidence from o where place <= 3""")
def r02_top_keys(spark, d):
    """Best three of 24 rotated key profiles for each label, by correlation."""
    p = profiles(spark, d)
    keys = F.array(*[F.struct(F.lit(t).alias("tonic"), F.lit(m).alias("minor")) for t in range(12) for m in (False, True)])
    each = p.select("label", "v", F.explode(keys).alias("key"))
    shape = F.when(F.col("key.minor"), S.rotated(S.MINOR_PROFILE, F.col("key.tonic"))).otherwise(S.rotated(S.MAJOR_PROFILE, F.col("key.tonic")))
    pairs = each.select("label", "key", F.explode(F.arrays_zip(F.col("v").alias("a"), shape.alias("b"))).alias("z"))
    r = pairs.groupBy("label", "key").agg(A.correlation(F.col("z.a"), F.col("z.b")).alias("r"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("r"), "key.tonic", "key.minor"))
    return r.withColumn("place", place).where("place <= 3").select("label", F.col("place").cast("long").alias("place"), "key.tonic", "key.minor", r6((F.col("r") + 1) / 2, 5).alias("confidence"))


@query("""select event_type, round(coalesce(corr(value, (props->>'k')::double), 0), 6) as r, count(*) as n from events group by event_type""")
def a03_correlation(spark, d):
    k = F.get_json_object("props", "$.k").cast("double")
    return tb(spark, d, "events").groupBy("event_type").agg(r6(A.correlation(F.col("value"), k)).alias("r"), F.count("*").alias("n"))


@query("""select o_orderpriority, round(regr_slope(o_totalprice, date_diff('day', date '1992-01-01', o_orderdate::date)), 5) as slope, round(regr_r2(o_totalprice, date_diff('day', date '1992-01-01', o_orderdate::date)), 8) as r2 from orders group by o_orderpriority""")
def a06_regression(spark, d):
    o = tb(spark, d, "orders")
    f = A.regression(o, ["o_orderpriority"], F.col("o_totalprice"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")))
    return f.select("o_orderpriority", r6("slope", 5).alias("slope"), r6("r2", 8).alias("r2"))


_LABELLED = "x as (select d.lang, d.n_chars, l.quality, l.toxic, least(1, d.n_chars / 2000) as score from documents d join labels l using (doc_id))"


def labelled(spark, d):
    out = tb(spark, d, "documents").select("doc_id", "lang", "n_chars").join(tb(spark, d, "labels"), "doc_id")
    return out.withColumn("score", F.least(F.lit(1.0), F.col("n_chars") / 2000))


@query(f"""with {_LABELLED}, s as (select lang, sum((score >= 0.5)::int * quality * (1 - toxic)) as tp, sum((score >= 0.5)::int * (1 - toxic)) as p, sum(quality * (1 - toxic)) as t, sum(1 - toxic) as w from x group by lang)
    select lang, w::double as weight, round(tp / greatest(p, 1), 6) as precision, round(tp / greatest(t, 1), 6) as recall, round(coalesce(2 * (tp / greatest(p, 1)) * (tp / greatest(t, 1)) / nullif(tp / greatest(p, 1) + tp / greatest(t, 1), 0), 0), 6) as f1 from s""")
def a12_masked_scores(spark, d):
    out = A.precision_recall(labelled(spark, d), ["lang"], F.col("score") >= 0.5, F.col("quality"), (1 - F.col("toxic")).cast("double"))
    return out.select("lang", "weight", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


@query("""with m as (select l_returnflag as flag, count(*) as n, covar_pop(l_quantity, l_extendedprice) as re, var_pop(l_quantity) as rr, var_pop(l_extendedprice) as ee from lineitem group by all)
    select flag, n, round(10 * log10(((re / rr) ** 2 * rr * n + 1e-8) / ((ee - re * re / rr) * n + 1e-8)), 5) as si_sdr from m""")
def a15_si_sdr(spark, d):
    out = A.si_sdr(tb(spark, d, "lineitem"), ["l_returnflag"], F.col("l_quantity"), F.col("l_extendedprice"))
    return out.select(F.col("l_returnflag").alias("flag"), "n", r6("si_sdr", 5).alias("si_sdr"))


@query(f"""with {_LABELLED} select lang, round(avg(-(quality * ln(greatest(p, 1e-7)) + (1 - quality) * ln(greatest(1 - p, 1e-7))) * w) / avg(w), 6) as loss from (select *, 0.05 + 0.9 * score as p, 1.0 - 0.5 * toxic as w from x) group by lang""")
def a17_weighted_loss(spark, d):
    x = labelled(spark, d)
    p, w = 0.05 + 0.9 * F.col("score"), 1.0 - 0.5 * F.col("toxic")
    bce = -(F.col("quality") * F.log(F.greatest(p, F.lit(1e-7))) + (1 - F.col("quality")) * F.log(F.greatest(1 - p, F.lit(1e-7))))
    return x.groupBy("lang").agg(r6(F.avg(bce * w) / F.avg(w)).alias("loss"))


@query("""with w as (select user_id, value / 100 as p from events) select user_id, round(avg((p >= 0.5)::int), 6) as share_50, round(avg((p >= 0.2)::int), 6) as share_20, round(avg(p), 6) as mean, round(quantile_cont(p, 0.9), 6) as p90, max(p) as top, count(*) as n,
    avg((p >= 0.5)::int) >= 0.1 as present from w group by user_id""")
def a18_song_presence(spark, d):
    w = A.window_stats(tb(spark, d, "events"), ["user_id"], F.col("value") / 100)
    return w.select("user_id", *[r6(c).alias(c) for c in ("share_50", "share_20", "mean", "p90")], "top", "n", (F.col("share_50") >= 0.1).alias("present"))


@query(f"""with {_LABELLED}, k as (select lang, quality, (rank() over w + (count(*) over (partition by lang, score) - 1) / 2) as r from x window w as (partition by lang order by score)),
    s as (select lang, sum(r) filter (quality = 1) as rp, count(*) filter (quality = 1) as p, count(*) filter (quality = 0) as n from k group by lang)
    select lang, p as positives, n as negatives, round((rp - p * (p + 1) / 2) / nullif(p * n, 0), 6) as auc from s""")
def a20_auc(spark, d):
    return A.auc(labelled(spark, d), ["lang"], F.col("score"), F.col("quality") == 1).select("lang", "positives", "negatives", r6("auc").alias("auc"))


@query(f"""with {_LABELLED}, q as (select lang, quantile_cont(score, 0.1) as cut from x where quality = 1 group by lang) select lang, round(any_value(cut), 6) as cut, round(avg((score < cut)::int), 6) as found from x join q using (lang) where quality = 0 group by lang""")
def a21_found_at_budget(spark, d):
    return A.found_at(labelled(spark, d), ["lang"], F.col("score"), F.col("quality") == 1, 0.1).select("lang", r6("cut").alias("cut"), r6("found").alias("found"))


@query("""with c as (select o_orderstatus as s, o_orderpriority as r, quarter(o_orderdate) as e, count(*) as n from orders group by all), p as (select s, sum(n * (n - 1) / 2) as b from c group by s),
    r as (select s, sum(n * (n - 1) / 2) as v from (select s, r, sum(n) as n from c group by s, r) group by s), e as (select s, sum(n * (n - 1) / 2) as v from (select s, e, sum(n) as n from c group by s, e) group by s)
    select s, round(b / e.v, 6) as precision, round(b / r.v, 6) as recall, round(2 * b / (r.v + e.v), 6) as f1 from p join r using (s) join e using (s)""")
def a22_pair_agreement(spark, d):
    o = tb(spark, d, "orders").select(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("r"), F.quarter("o_orderdate").alias("e"))
    return A.pair_agreement(o, ["s"], "r", "e").select("s", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


@query("""select coalesce(event_type, 'ALL') as label, count(*) as n, round(avg(value), 6) as mean, count(distinct user_id) as users from events group by rollup(event_type)""")
def a25_totals(spark, d):
    e = tb(spark, d, "events").where("event_type is not null")
    return e.rollup("event_type").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), F.count_distinct("user_id").alias("users")).select(F.coalesce("event_type", F.lit("ALL")).alias("label"), "n", "mean", "users")


@query("""with a as (select p_brand as brand, count(*) as parts, count(*) filter (p_type = 'SMALL') as small, count(*) filter (p_type = 'ECONOMY') as economy from part where p_size < 25 group by 1), b as (select p_brand as brand, round(sum(l_quantity), 2) as moved from lineitem join part on l_partkey = p_partkey where p_size >= 25 group by 1)
    select coalesce(a.brand, b.brand) as brand, coalesce(parts, 0) as parts, coalesce(small, 0) as small, coalesce(economy, 0) as economy, coalesce(moved, 0) as moved from a full join b on a.brand = b.brand""")
def a26_inventory(spark, d):
    p = tb(spark, d, "part").withColumnRenamed("p_brand", "brand")
    a = p.where("p_size < 25").groupBy("brand").pivot("p_type", ["SMALL", "ECONOMY"]).agg(F.count("p_partkey")).withColumnsRenamed({"SMALL": "small", "ECONOMY": "economy"})
    a = p.where("p_size < 25").groupBy("brand").agg(F.count("*").alias("parts")).join(a, "brand")
    b = tb(spark, d, "lineitem").join(p.where("p_size >= 25"), F.col("l_partkey") == F.col("p_partkey")).groupBy("brand").agg(r6(F.sum("l_quantity"), 2).alias("moved"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(b, "brand", "full").select("brand", n("parts"), n("small"), n("economy"), F.coalesce("moved", F.lit(0.0)).alias("moved"))


@query("""with recursive u(kind) as (select 0), g as (select user_id, row_number() over (order by user_id) - 1 as g, count(*) over () as n from (select distinct user_id from events where user_id is not null)),
    s as (select d.d, g.g as slot, n from g, (select unnest(range(100)) as d) d),
    c as (select d, floor(('0x' || md5(d || '/' || slot || '|boot|0')[1:8])::bigint / 4294967296.0::double * n)::bigint as g, count(*) as c from s group by all),
    w as (select c.d, e.value, c.c::double as c, ('0x' || md5(c.d || '/' || e.user_id || '/' || e.event_id || '|boot|1')[1:8])::bigint / 4294967296.0::double as q from c join g using (g) join events e using (user_id)),
    k as (select d, value, list_reduce(list_prepend({'n': 0, 'p': exp(-c), 's': exp(-c)}, list_transform(range(1, 14 + 3 * ceil(c)::bigint), lambda k: {'n': 0, 'p': k::double, 's': 0.0::double})),
        lambda x, y: {'n': x.n + (q >= x.s)::int, 'p': x.p * c / y.p, 's': x.s + x.p * c / y.p}).n as k from w),
    m as (select d, sum(k * value) / sum(k) as mean from k group by d), l as (select list(mean order by mean) as l, avg(mean) as a from m)
    select round(a, 6) as mean, round(l[3], 6) as low, round(l[97], 6) as high from l""")
def a27_bootstrap(spark, d):
    e = tb(spark, d, "events").select("user_id", "event_id", "value")
    out = A.bootstrap(e, "user_id", "event_id", "value", 100, "boot", F.floor(F.col("user_id") / 1024))
    return out.select(*[r6(c).alias(c) for c in ("mean", "low", "high")])


@query("""with s as (select l_returnflag as f, l_suppkey, avg(l_extendedprice - 1000 * l_quantity) as gain, sum(case when l_discount < 0.02 then 1 else 0 end) as removed, count(*) as n from lineitem group by all)
    select f, round(avg(gain), 4) as improvement, round(100 * sum(removed) / sum(n), 6) as removed_per_100 from s group by f""")
def a28_gating_scores(spark, d):
    s = tb(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("f"), "l_suppkey").agg(F.avg(F.col("l_extendedprice") - 1000 * F.col("l_quantity")).alias("gain"), F.count_if(F.col("l_discount") < 0.02).alias("removed"), F.count("*").alias("n"))
    return s.groupBy("f").agg(r6(F.avg("gain"), 4).alias("improvement"), r6(100 * F.sum("removed") / F.sum("n")).alias("removed_per_100"))


@query("""select o_orderpriority as g, round(avg(x), 5) as mean, round(median(x), 5) as median, round(avg((x > -6)::int), 6) as over_6, round(avg((x > -3)::int), 6) as over_3 from (select o_orderpriority, 10 * log10(o_totalprice / 400000) as x from orders) group by 1""")
def a29_leakage(spark, d):
    x = tb(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), (10 * F.log10(F.col("o_totalprice") / 400_000)).alias("x"))
    share = lambda t: r6(F.avg((F.col("x") > t).cast("double")))
    return x.groupBy("g").agg(r6(F.avg("x"), 5).alias("mean"), r6(F.median("x"), 5).alias("median"), share(-6).alias("over_6"), share(-3).alias("over_3"))


@query("""with p as (select l_returnflag as f, l_linestatus as s, sum(l_quantity * l_discount) as qd, sum(l_quantity * l_tax) as qt, sum(l_quantity * l_quantity) as qq, sum(l_discount * l_discount) as dd, sum(l_tax * l_tax) as tt from lineitem group by all)
    select f, s, round(qd * qd / (qq * dd), 6) as to_discount, round(qt * qt / (qq * tt), 6) as to_tax from p""")
def a31_projection_shares(spark, d):
    q, x, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    p = tb(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s")).agg(F.sum(q * x).alias("qd"), F.sum(q * t).alias("qt"), F.sum(q * q).alias("qq"), F.sum(x * x).alias("dd"), F.sum(t * t).alias("tt"))
    return p.select("f", "s", r6(F.col("qd") * F.col("qd") / (F.col("qq") * F.col("dd"))).alias("to_discount"), r6(F.col("qt") * F.col("qt") / (F.col("qq") * F.col("tt"))).alias("to_tax"))


@query("""with k as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders) select o_custkey, round(avg(o_totalprice), 4) as mean, count(*) as n, min(o_orderdate::date) as since from k where k <= 3 group by o_custkey""")
def a33_last_n(spark, d):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    o = tb(spark, d, "orders").withColumn("k", k).where("k <= 3")
    return o.groupBy("o_custkey").agg(r6(F.avg("o_totalprice"), 4).alias("mean"), F.count("*").alias("n"), F.min(F.col("o_orderdate").cast("date")).alias("since"))


@query("select count(*) as entries, round(sum(o_totalprice), 2) as bytes, sum(o_totalprice) > 1e8 as full from orders")
def a34_cache_stats(spark, d):
    return tb(spark, d, "orders").agg(F.count("*").alias("entries"), r6(F.sum("o_totalprice"), 2).alias("bytes"), (F.sum("o_totalprice") > 1e8).alias("full"))


@query("""with r as (select o_orderkey, sum(o_totalprice::decimal(18, 2)) over (order by o_orderdate, o_orderkey) - o_totalprice::decimal(18, 2) as before, sum(o_totalprice::decimal(18, 2)) over () as total from orders) select o_orderkey from r where total - before > 100000000""")
def a35_prune_oldest(spark, d):
    o = tb(spark, d, "orders").select("o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").cast("double").alias("size"))
    return A.prune_oldest(o, ["o_orderdate", "o_orderkey"], "size", F.year("o_orderdate") * 12 + F.month("o_orderdate"), 100_000_000.0).select("o_orderkey")


@query("""select user_id, string_agg(distinct event_type, ',' order by event_type) as classes, bool_or(value > 100) as any_loud, bool_and(value > 1) as all_heard from events group by user_id""")
def a36_label_sets(spark, d):
    return tb(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("classes"), F.bool_or(F.col("value") > 100).alias("any_loud"), F.bool_and(F.col("value") > 1).alias("all_heard"))


@query("""with f as (select user_id, event_type, min(event_id) as first from events group by all) select user_id, string_agg(event_type, ' ' order by first) as vocabulary from f group by user_id""")
def a37_ordered_vocabulary(spark, d):
    f = tb(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    words = F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda s: s["event_type"])
    return f.groupBy("user_id").agg(F.array_join(words, " ").alias("vocabulary"))


@query("""select coalesce(lang, 'ALL') as lang, bool_or(source = 'src7') as restricted, round(sum(n_chars * n_chars) / sum(n_chars), 4) as weighted, count(*) as n, round(avg(n_chars) filter (n_chars > 500), 4) as mean_ok from documents where lang is not null group by rollup(lang)""")
def a41_report(spark, d):
    x = tb(spark, d, "documents").where("lang is not null").select("lang", "source", "n_chars")
    n = F.col("n_chars")
    out = x.rollup("lang").agg(F.bool_or(F.col("source") == "src7").alias("restricted"), r6(F.sum(n * n) / F.sum(n), 4).alias("weighted"), F.count("*").alias("n"), r6(F.avg(F.when(n > 500, n)), 4).alias("mean_ok"))
    return out.withColumn("lang", F.coalesce("lang", F.lit("ALL")))


@query("""with m as (select l_suppkey, l_returnflag, avg(l_discount) as v from lineitem group by all), x as (select *, max(v) over w as hi, min(v) over w as lo from m window w as (partition by l_suppkey))
    select l_suppkey, l_returnflag, case when hi = lo then '' when v = hi then 'best' when v = lo then 'worst' else '' end as mark from x""")
def w44_best_worst(spark, d):
    # summed as decimals: equal means stay equal in whatever order rows are added
    x = F.col("l_discount").cast("decimal(20,12)")
    m = tb(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.try_divide(F.sum(x), F.count(x)).alias("v"))
    w = Window.partitionBy("l_suppkey")
    x = m.withColumns({"hi": F.max("v").over(w), "lo": F.min("v").over(w)})
    return x.select("l_suppkey", "l_returnflag", F.when(F.col("hi") == F.col("lo"), "").when(F.col("v") == F.col("hi"), "best").when(F.col("v") == F.col("lo"), "worst").otherwise("").alias("mark"))


@query("""with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place from orders) select o_custkey, o_orderkey, place from r where place <= 3""")
def r01_ranked(spark, d):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return tb(spark, d, "orders").withColumn("place", place).where("place <= 3").select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))


@query("select o_orderkey from orders order by o_orderdate, o_orderkey limit 100")
def r05_least_recent(spark, d):
    return tb(spark, d, "orders").orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey")


@query("""select p_partkey, case when 10 * log10(p_retailprice / 1000) >= 1 then 1 else 0 end as label, case when 10 * log10(p_retailprice / 1000) >= 1 or 10 * log10(p_retailprice / 1000) < 0 then 1.0 else 0.0 end::double as weight from part""")
def p08_three_zones(spark, d):
    label, weight = S.three_zone(10 * F.log10(F.col("p_retailprice") / 1000), 1.0, 0.0)
    return tb(spark, d, "part").select("p_partkey", label.alias("label"), weight.alias("weight"))


@query("""select doc_id, [(lang = l)::int for l in ['en', 'de', 'fr', 'es']] as hot from documents where lang is not null""")
def p12_multi_hot(spark, d):
    return tb(spark, d, "documents").where("lang is not null").select("doc_id", S.multi_hot(["en", "de", "fr", "es"], F.array("lang")).alias("hot"))


# --- scalar functions ---


@query("""select p_partkey, round(2595 * log10(1 + f / 700), 6) as htk, round(case when f < 1000 then f * 3 / 200 else 15 + 27 * ln(f / 1000) / ln(6.4) end, 6) as slaney, round(f, 6) as back, round(pow(10, -f / 2000), 6) as gain, round(p_partkey * 512.0 / 22050, 6) as t from (select p_partkey, p_retailprice as f from part)""")
def f01_scales(spark, d):
    f = F.col("p_retailprice")
    return tb(spark, d, "part").select(
        "p_partkey", r6(S.hz_to_mel_htk(f)).alias("htk"), r6(S.hz_to_mel_slaney(f)).alias("slaney"), r6(S.mel_to_hz_slaney(S.hz_to_mel_slaney(f))).alias("back"),
        r6(S.db_to_gain(-f / 100)).alias("gain"), r6(S.frame_time(F.col("p_partkey"), 512, 22050)).alias("t"),
    )


@query(f"""with k as (select p_partkey, (p_partkey % 12)::int as i, p_partkey % 5 = 0 as minor, {list(S.NOTES)} as notes, {list(S.CAMELOT_MAJOR)} as maj, {list(S.CAMELOT_MINOR)} as mi from part), c as (select *, case when minor then mi[i + 1] else maj[i + 1] end as n from k)
    select p_partkey, notes[i + 1] || case when minor then ' minor' else ' major' end as key, n || case when minor then 'A' else 'B' end as camelot, ((n - 8 + 12) % 12 + 1) || case when minor then 'm' else 'd' end as open_key, notes[i + 1] || case when minor then ':min' else ':maj' end as chord, chr((65 + p_partkey % 26)::int) as letter from c""")
def f09_key_names(spark, d):
    i, minor = F.pmod("p_partkey", F.lit(12)), F.pmod("p_partkey", F.lit(5)) == 0
    return tb(spark, d, "part").select("p_partkey", S.key_name(i, minor).alias("key"), S.camelot(i, minor).alias("camelot"), S.open_key(i, minor).alias("open_key"), S.harte(i, minor).alias("chord"), S.section_letter(F.col("p_partkey")).alias("letter"))


@query("""select o_orderkey, (c // 6000) || ':' || lpad((c % 6000 // 100)::varchar, 2, '0') || ':' || lpad((c % 100)::varchar, 2, '0') as clock, (s // 60) || ':' || lpad((s % 60)::varchar, 2, '0') as short,
    case when s >= 3600 then (s // 3600) || 'h ' else '' end || case when s >= 60 then (s % 3600 // 60) || 'm ' else '' end || (s % 60) || 's' as elapsed, (s // 384 + 1) || ':' || (s % 384 // 96 + 1) || ':' || lpad((s % 96 * 100 // 96)::varchar, 2, '0') as bar from (select o_orderkey, round(o_totalprice)::bigint as c, o_orderkey as s from orders)""")
def f13_clocks(spark, d):
    s = F.col("o_orderkey")
    return tb(spark, d, "orders").select("o_orderkey", S.clock(F.round("o_totalprice").cast("long")).alias("clock"), S.clock_short(s).alias("short"), S.elapsed(s).alias("elapsed"), S.bar_position(s, 96).alias("bar"))


@query(r"""select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(x), '\([^)]*\)', '', 'g'), '[0-9]', '', 'g'), '\s+', ' ', 'g')) as label, case when length(x) <= 12 then x else substr(x, 1, 11) || '…' end as short, list_filter([lower(trim(t)) for t in string_split(y, '+')], lambda t: t <> '') as tags
    from (select p_partkey, p_brand || ' (' || p_type || ')  ' || p_name as x, p_name || ' + ' || p_type || '+' as y from part)""")
def f17_labels(spark, d):
    x = F.concat("p_brand", F.lit(" ("), "p_type", F.lit(")  "), "p_name")
    y = F.concat("p_name", F.lit(" + "), "p_type", F.lit("+"))
    return tb(spark, d, "part").select("p_partkey", S.normal_label(x).alias("label"), S.truncated(x, 12).alias("short"), S.split_tags(y).alias("tags"))


@query("""with e as (select vec_id, embedding::double[] as x from embeddings), m as (select *, list_max(x) as m, list_sum([abs(v) for v in x]) as a, sqrt(list_dot_product(x, x)) as n from e), z as (select *, list_sum([exp((v - m) / 0.15) for v in x]) as z from m)
    select vec_id, round(abs(x[1]) / a, 5) as l1, round(x[2] / n, 5) as l2, round((x[3] - m) / 0.15 - ln(z), 4) as logp, round(greatest(0, x[8] - 0.6 * x[1] - 0.3 * x[4]), 5) as less, round(1 - (1 - abs(x[1])) * (1 - abs(x[2])) * (1 - abs(x[3])), 5) as either from z""")
def f05_vectors(spark, d):
    x = F.col("embedding")
    mag = F.transform(x, lambda v: F.abs(v.cast("double")))
    return tb(spark, d, "embeddings").select(
        "vec_id", r6(S.l1_normal(mag)[0], 5).alias("l1"), r6(S.l2_normal(x)[1], 5).alias("l2"), r6(S.log_softmax(x, 0.15)[2], 4).alias("logp"),
        r6(S.less_harmonics(F.slice(x, 1, 12))[7], 5).alias("less"), r6(S.noisy_or(F.slice(mag, 1, 3)), 5).alias("either"),
    )


@query("""with m as (select vec_id, [abs(v) for v in embedding[1:4]::double[]] as a, [(i + vec_id) % 3 > 0 for i in range(4)] as p from embeddings), g as (select vec_id, [a[i] * p[i]::int for i in range(1, 5)] as k, a from m)
    select vec_id, [round(v / greatest(list_sum(k), 1e-8), 5) for v in k] as gated, [round(v * v / list_sum([w * w for w in a]), 5) for v in a] as ideal from g""")
def f26_masks(spark, d):
    a = F.transform(F.slice("embedding", 1, 4), lambda v: F.abs(v.cast("double")))
    present = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(i + F.col("vec_id"), F.lit(3)) > 0).cast("int"))
    power = F.transform(a, lambda v: v * v)
    return tb(spark, d, "embeddings").select("vec_id", F.transform(S.gated(a, present), lambda v: F.round(v, 5)).alias("gated"), F.transform(S.l1_normal(power), lambda v: F.round(v, 5)).alias("ideal"))


@query("""with recursive s as (select p_partkey, p_name as s, 2166136261::bigint as h, 0 as i from part union all select p_partkey, s, (xor(h, ascii(s[i + 1])) * 16777619) & 4294967295, i + 1 from s where i < length(s))
    select p_partkey, max_by(h, i) as fnv, sha256('v1|0||' || length(any_value(s)) || ':' || any_value(s) || '|' || length(p_partkey::varchar) || ':' || p_partkey) as chained from s group by p_partkey""")
def f22_hashes(spark, d):
    return tb(spark, d, "part").select("p_partkey", S.fnv1a(F.col("p_name")).alias("fnv"), S.chained_key(F.lit(None).cast("string"), F.col("p_name"), F.col("p_partkey")).alias("chained"))


@query("""select o_orderkey, case when abs(e - r) <= 0.04 * r then 'exact' when abs(e * 0.5 - r) <= 0.04 * r then 'x0.5' when abs(e * 2 - r) <= 0.04 * r then 'x2' when abs(e * (2.0 / 3) - r) <= 0.04 * r then 'x0.67' when abs(e * 1.5 - r) <= 0.04 * r then 'x1.5' else 'none' end as badge from (select o_orderkey, o_orderkey % 173 + 0.5 as e, 100 as r from orders)""")
def f15_octave_badge(spark, d):
    return tb(spark, d, "orders").select("o_orderkey", S.octave_badge(F.pmod("o_orderkey", F.lit(173)) + 0.5, F.lit(100)).alias("badge"))


@query("""select page_id, coalesce(nullif(string_split(url, '/')[-1], ''), 'model.bin') as file, case when regexp_extract(url, '\\.([^./]+)$', 1) = '' then 'unknown' else lower(regexp_extract(url, '\\.([^./]+)$', 1)) end as ext, 'l' || (page_id % 4) || ':' || 'stage' as stage from pages""".replace("\\\\", "\\"))
def f31_names(spark, d):
    return tb(spark, d, "pages").select("page_id", S.file_name(F.col("url")).alias("file"), S.extension(F.col("url")).alias("ext"), S.stage_id(F.pmod("page_id", F.lit(4)), F.lit("stage")).alias("stage"))


@query("""select n_nationkey, greatest(1, round_even(n_nationkey * 0.5, 0)::bigint) as share, round(case when n_nationkey < 5 then 0.001 * (n_nationkey + 1) / 5 else 0.001 * 0.5 * (1 + cos(pi() * least(1, (n_nationkey - 5) / 20))) end, 9) as rate from nation""")
def w45_schedules(spark, d):
    return tb(spark, d, "nation").select("n_nationkey", S.split_sizes(F.col("n_nationkey"), F.lit(0.5)).alias("share"), r6(S.learning_rate(F.col("n_nationkey"), 0.001, 5, 25, 0.0), 9).alias("rate"))


# --- derived draws ---

_U = "('0x' || substr(md5({seed} || '|{stream}|0'), 1, 8))::bigint / 4294967296.0"


@query(f"""with s as (select o_orderkey, {_U.format(seed="o_orderkey", stream="crop")} as crop, {_U.format(seed="o_orderkey", stream="gain")} as gain from orders),
    l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {_U.format(seed="(l_orderkey || '/' || l_linenumber)", stream="drop")} as u from lineitem),
    k as (select l_orderkey, count(*) as stems, count(*) filter (u >= 0.15) as kept, sum(case when u >= 0.15 then l_extendedprice end) as level from l group by l_orderkey)
    select o_orderkey, round(crop * 8, 6) as start, round(-12 + 18 * gain, 6) as gain_db, stems, kept, round(case when level > 95000 then 95000 / level else 1 end, 6) as scale from s join k on o_orderkey = l_orderkey""")
def g01_snippets(spark, d):
    """Seeded snippets of an order's lines: crop and gain draws, dropped stems, sum and peak limit."""
    u = lambda seed, stream: S.uniform(seed, stream)
    l = tb(spark, d, "lineitem").withColumn("u", u(F.concat_ws("/", "l_orderkey", "l_linenumber"), "drop"))
    kept = F.col("u") >= 0.15
    k = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("stems"), F.count_if(kept).alias("kept"), F.sum(F.when(kept, F.col("l_extendedprice"))).alias("level"))
    o = tb(spark, d, "orders").select("o_orderkey", u(F.col("o_orderkey"), "crop").alias("crop"), u(F.col("o_orderkey"), "gain").alias("gain"))
    scale = F.when(F.col("level") > 95_000, F.try_divide(F.lit(95_000.0), F.col("level"))).otherwise(1.0)
    return o.join(k, "o_orderkey").select("o_orderkey", r6(F.col("crop") * 8).alias("start"), r6(-12 + 18 * F.col("gain")).alias("gain_db"), "stems", "kept", r6(scale).alias("scale"))


@query("""select i, i % 25 as n_nationkey, n_name, 7 + i + 3 * 500 as seed from range(0, 500) r(i) join nation on n_nationkey = i % 25""")
def g06_items(spark, d):
    """Item i of an epoch takes track i mod n and its own seed."""
    n = tb(spark, d, "nation")
    return spark.range(500).withColumn("n_nationkey", F.pmod("id", F.lit(25)).cast("int")).join(n, "n_nationkey").select(F.col("id").alias("i"), F.pmod("id", F.lit(25)).alias("n_nationkey"), "n_name", (F.col("id") + 7 + 1500).alias("seed"))


@query("""select l_orderkey, case l_returnflag when 'A' then 'drums' when 'N' then 'bass' else 'other' end as source, round(sum(l_extendedprice), 2) as level, bool_and(l_returnflag <> 'R') as known from lineitem group by all""")
def g09_sources(spark, d):
    source = F.when(F.col("l_returnflag") == "A", "drums").when(F.col("l_returnflag") == "N", "bass").otherwise("other")
    return tb(spark, d, "lineitem").groupBy("l_orderkey", source.alias("source")).agg(r6(F.sum("l_extendedprice"), 2).alias("level"), F.bool_and(F.col("l_returnflag") != "R").alias("known"))


# --- text sinks and JSON ---


@query("""select event_id, printf('%.6f %.6f %s', value, value + 1, event_type) as lab, printf('%.6f', value) as mirex, (props->>'k')::int as k from events""")
def k01_label_lines(spark, d):
    v = F.col("value")
    return tb(spark, d, "events").select("event_id", F.format_string("%.6f %.6f %s", v, v + 1, "event_type").alias("lab"), F.format_string("%.6f", v).alias("mirex"), F.get_json_object("props", "$.k").cast("int").alias("k"))
