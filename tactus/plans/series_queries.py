"""Queries on ordered series: joins in time, row windows, scans, tempo. Each has a Spark form and, where SQL can say it, an oracle.

Series are the events of a user in the order of (us, event_id); us is the time in microseconds. Buckets are days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.functions import scalar as S
from tactus.operators import aggregates as A
from tactus.operators import joins as J
from tactus.operators import scans as C
from tactus.operators import series as R

DAY_US = 86_400_000_000
ORDER = ["us", "event_id"]
KEY = ["user_id"]
QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: events with their time in microseconds and seconds
_E = "e as (select *, epoch_us(ts) as us, epoch_us(ts) / 1e6 as t from events)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.replace("$E", _E)
        return f

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return e.withColumn("us", us).withColumn("t", F.col("us") / 1e6)


def day(c: str = "us"):
    return F.floor(F.col(c) / DAY_US)


def kind(e: DataFrame, name: str) -> DataFrame:
    return e.where(F.col("event_type") == name)


def r6(c, n: int = 6):
    return F.round(c, n)


def indexed(e: DataFrame) -> DataFrame:
    return R.index_rows(e, KEY, ORDER, day())


# --- joins in time ---


@query("""with $E, g as (select user_id, event_id, us, lead(us) over (partition by user_id order by us, event_id) as nx from e where event_type = 'purchase')
    select g.user_id, g.event_id, round(coalesce(avg(e.value), 0), 6) as mean, count(e.event_id) as n
    from g left join e on e.user_id = g.user_id and e.us >= g.us and (g.nx is null or e.us < g.nx) group by g.user_id, g.event_id""")
def j01_interval_mean(spark, d):
    e = events(spark, d).select("user_id", "event_id", "us", "value", "event_type")
    out = J.interval_mean(e, kind(e, "purchase"), KEY, "us", "us", "event_id", "value", day("_t"))
    return out.select("user_id", "event_id", r6("mean").alias("mean"), "n")


@query("""with $E, m as (select e.event_id, g.event_id as nearest_id, row_number() over (partition by e.event_id order by abs(e.us - g.us), g.us) as k
    from e join e g on g.user_id = e.user_id and g.event_type = 'purchase')
    select e.event_id, m.nearest_id from e left join m on m.event_id = e.event_id and m.k = 1""")
def j02_nearest(spark, d):
    e = events(spark, d).select("user_id", "event_id", "us", "event_type")
    out = J.nearest(e, kind(e, "purchase"), KEY, "us", "us", "event_id", day("_t"), lambda a, b: F.abs(a - b))
    return out.select("event_id", F.col("grid.id").alias("nearest_id"))


@query("""with $E, i as (select *, row_number() over (partition by user_id order by us, event_id) - 1 as idx from e),
    m as (select i.event_id, g.idx as nearest, row_number() over (partition by i.event_id order by abs(i.idx - g.idx), g.idx) as k from i join i g on g.user_id = i.user_id and g.event_type = 'signup')
    select i.event_id, coalesce(m.nearest, i.idx) as nearest from i left join m on m.event_id = i.event_id and m.k = 1""")
def j03_nearest_by_index(spark, d):
    i = indexed(events(spark, d).select("user_id", "event_id", "us", "event_type"))
    out = J.nearest(i, kind(i, "signup"), KEY, "idx", "idx", "idx", F.floor(F.col("_t") / 4096), lambda a, b: F.abs(a - b))
    return out.select("event_id", F.coalesce("grid.id", "idx").alias("nearest"))


@query("""with $E, i as (select *, row_number() over (partition by user_id order by us, event_id) - 1 as idx, max(us) over (partition by user_id) as last_us from e)
    select i.event_id, coalesce(k.us, i.last_us) as end_us from i left join i k on k.user_id = i.user_id and k.idx = i.idx + 3""")
def j04_lookup_or_last(spark, d):
    i = indexed(events(spark, d).select("user_id", "event_id", "us"))
    last = i.groupBy("user_id").agg(F.max("us").alias("last_us"))
    want = i.join(last, "user_id").select("user_id", "event_id", (F.col("idx") + 3).alias("idx"), "last_us")
    return J.with_fallback(want, i.select("user_id", "idx", F.col("us").alias("end_us")), ["user_id", "idx"], "end_us", F.col("last_us")).select("event_id", "end_us")


@query("""with $E, i as (select *, row_number() over (partition by user_id order by us, event_id) - 1 as idx, count(*) over (partition by user_id) as n from e)
    select i.event_id, c.value as sample from i join i c on c.user_id = i.user_id and c.idx = least(greatest(0, round(i.value / 7)), i.n - 1)""")
def j05_gather(spark, d):
    i = indexed(events(spark, d).select("user_id", "event_id", "us", "value"))
    return J.gather(i.select("user_id", "event_id", "value"), i.select("user_id", "idx", F.col("value").alias("v")), KEY, F.col("value") / 7, "idx", "v").select("event_id", "sample")


@query("""with recursive $E, l as (select user_id, coalesce(list(t order by t) filter (event_type = 'view'), []) as a, coalesce(list(t order by t) filter (event_type = 'click'), []) as b from e group by user_id),
    r(user_id, i, j, ref_at, est_at) as (select user_id, 1, 1, null::double, null::double from l union all
        select user_id, case when hit or x < y then i + 1 else i end, case when hit or x >= y then j + 1 else j end, case when hit then x end, case when hit then y end
        from (select r.user_id, i, j, a[i] as x, b[j] as y, abs(a[i] - b[j]) <= 21600 as hit from r join l using (user_id) where i <= len(a) and j <= len(b)))
    select user_id, ref_at, est_at from r where ref_at is not null""")
def j06_match_within(spark, d):
    e = events(spark, d).select("user_id", "t", "event_type")
    return J.match_within(kind(e, "view"), kind(e, "click"), KEY, "t", 21_600.0, F.floor(F.col("_t") / 86_400))


@query("""with $E, p as (select user_id, event_id, us, lag(us) over w as a, lead(us) over w as b from e where event_type = 'purchase' window w as (partition by user_id order by us, event_id)),
    m as (select p.event_id, c.event_id as found, abs(c.us - p.us) as gap, row_number() over (partition by p.event_id order by abs(c.us - p.us), c.us) as k from p join e c on c.user_id = p.user_id and c.event_type = 'click')
    select p.event_id, case when m.gap <= (coalesce(p.b, p.us) - coalesce(p.a, p.us)) / 4 then m.found end as found from p left join m on m.event_id = p.event_id and m.k = 1""")
def j07_nearest_within_beat(spark, d):
    e = events(spark, d).select("user_id", "event_id", "us", "event_type")
    p = R.carry(kind(e, "purchase"), KEY, ORDER, day(), {"a": F.col("us")})
    p = R.carry(p, KEY, ORDER, day(), {"b": F.col("us")}, ahead=True)
    out = J.nearest(p, kind(e, "click"), KEY, "us", "us", "event_id", day("_t"), lambda x, y: F.abs(x - y))
    room = (F.coalesce("b", "us") - F.coalesce("a", "us")) / 4
    return out.select("event_id", F.when(F.abs(F.col("grid.t") - F.col("us")) <= room, F.col("grid.id")).alias("found"))


@query("""with $E, i as (select *, row_number() over (partition by user_id order by us) - 1 as p from e where event_type = 'purchase'), c as (select *, row_number() over (partition by user_id order by us) - 1 as q from e where event_type = 'click'),
    m as (select i.user_id, i.event_id, i.us, i.p, c.q, c.us as cus, row_number() over (partition by i.event_id order by abs(c.us - i.us), c.us) as k from i join c on c.user_id = i.user_id),
    s as (select *, lag(q) over w as pq, lag(us) over w as pus, lag(cus) over w as pcus from m where k = 1 window w as (partition by user_id order by p))
    select event_id, coalesce(q = pq + 1 and abs((cus - pcus) - (us - pus)) <= 0.175 * (us - pus), false) as continues from s""")
def j08_continuity(spark, d):
    e = events(spark, d).select("user_id", "event_id", "us", "event_type")
    c = indexed(kind(e, "click")).select("user_id", "us", F.col("idx").alias("q"))
    m = J.nearest(kind(e, "purchase"), c, KEY, "us", "us", "q", day("_t"), lambda x, y: F.abs(x - y)).where("grid is not null")
    m = R.carry(m, KEY, ORDER, day(), {"before": F.struct("us", F.col("grid.id").alias("q"), F.col("grid.t").alias("t"))})
    step = F.col("us") - F.col("before.us")
    ok = (F.col("grid.id") == F.col("before.q") + 1) & (F.abs(F.col("grid.t") - F.col("before.t") - step) <= 0.175 * step)
    return m.select("event_id", F.coalesce(ok, F.lit(False)).alias("continues"))


@query("""with $E select e.event_id, arg_max(g.event_id, g.us) as segment, max(g.us) as since from e left join e g on g.user_id = e.user_id and g.event_type = 'signup' and g.us <= e.us group by e.event_id""")
def j09_as_of(spark, d):
    e = events(spark, d).select("user_id", "event_id", "us", "event_type")
    return J.as_of(e, kind(e, "signup"), KEY, "us", "us", "event_id", day("_t")).select("event_id", F.col("grid.id").alias("segment"), F.col("grid.t").alias("since"))


@query("""with $E, s as (select user_id, event_id as span, us as lo, us + 43200000000 as hi from e where event_type = 'signup')
    select e.event_id, arg_min(s.span, (s.lo, s.span)) as span, count(s.span) as n from e left join s on s.user_id = e.user_id and s.lo <= e.us and e.us < s.hi group by e.event_id""")
def j10_point_in_interval(spark, d):
    e = events(spark, d).select("user_id", "event_id", "us", "event_type")
    s = kind(e, "signup").select("user_id", F.col("event_id").alias("span"), F.col("us").alias("lo"), (F.col("us") + 43_200_000_000).alias("hi"))
    m = J.points_in_intervals(e, s, KEY, "us", "lo", "hi", 43_200_000_000)
    m = m.groupBy(F.col("point.event_id").alias("event_id")).agg(F.min_by("interval.span", F.struct("interval.lo", "interval.span")).alias("span"), F.count("*").alias("n"))
    return e.select("event_id").join(m, "event_id", "left").select("event_id", "span", F.coalesce("n", F.lit(0)).alias("n"))


@query("""with $E, a as (select user_id, event_id, us as lo, us + 14400000000 as hi from e where event_type = 'purchase'), b as (select user_id, event_id, us as lo, us + 28800000000 as hi from e where event_type = 'error')
    select a.event_id as a, b.event_id as b, greatest(a.lo, b.lo) as lo, least(a.hi, b.hi) as hi from a join b on a.user_id = b.user_id and least(a.hi, b.hi) - greatest(a.lo, b.lo) >= 3600000000""")
def j11_overlaps(spark, d):
    e = events(spark, d).select("user_id", "event_id", "us", "event_type")
    span = lambda name, h: kind(e, name).select("user_id", "event_id", F.col("us").alias("lo"), (F.col("us") + h * 3_600_000_000).alias("hi"))
    out = J.overlaps(span("purchase", 4), span("error", 8), KEY, "lo", "hi", 28_800_000_000, 3_600_000_000)
    return out.select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b"), "lo", "hi")


@query("""with $E select c.event_id from e c where c.event_type = 'click' and not exists (select 1 from e x where x.user_id = c.user_id and x.event_type = 'error' and x.us <= c.us and c.us < x.us + 86400000000)""")
def j12_outside_gaps(spark, d):
    e = events(spark, d).select("user_id", "event_id", "us", "event_type")
    gaps = kind(e, "error").select("user_id", F.col("us").alias("lo"), (F.col("us") + DAY_US).alias("hi"))
    hit = J.points_in_intervals(kind(e, "click"), gaps, KEY, "us", "lo", "hi", DAY_US).select(F.col("point.event_id").alias("event_id")).distinct()
    return kind(e, "click").select("event_id").join(hit, "event_id", "left_anti")


# --- row windows ---


@query("""with $E select event_id, round(avg(value) over (partition by user_id order by us, event_id rows between 3 preceding and 3 following), 6) as smooth from e""")
def w07_moving_average(spark, d):
    return R.moving_average(indexed(events(spark, d).select("user_id", "event_id", "us", "value")), KEY, "value", 3).select("event_id", r6("smooth").alias("smooth"))


@query("""with $E, s as (select event_type, avg(value) as m, stddev_pop(value) as sd from events group by event_type) select event_id, round((value - m) / sd, 6) as z from events join s using (event_type)""")
def w11_z_score(spark, d):
    return R.z_score(events(spark, d).select("event_type", "event_id", "value"), ["event_type"], "value").select("event_id", r6("z").alias("z"))


@query("""with $E, s as (select event_id, value as v, lag(value) over w as l, lead(value) over w as r from e window w as (partition by user_id order by us, event_id))
    select event_id, round(case when l is null or r is null or abs(l - 2 * v + r) < 1e-12 then 0 else least(0.5, greatest(-0.5, (l - r) / 2 / (l - 2 * v + r))) end, 6) as shift
    from s where v >= 60 and (l is null or v > l) and (r is null or v >= r)""")
def w13_peaks(spark, d):
    return R.peaks(indexed(events(spark, d).select("user_id", "event_id", "us", "value")), KEY, "value", 60.0).select("event_id", r6("shift").alias("shift"))


#: peaks of each user's values: at least 60, above the row before, not below the row after
_PEAKS = """$E, pk as (select user_id, t, value from (select *, lag(value) over w as l, lead(value) over w as r from e window w as (partition by user_id order by us, event_id)) where value >= 60 and (l is null or value > l) and (r is null or value >= r))"""


@query(f"""with recursive {_PEAKS}, o as (select *, row_number() over (partition by user_id order by t, value) as k from pk),
    r(user_id, k, kept) as (select user_id, k, [{{'t': t, 'v': value}}] from o where k = 1 union all
        select o.user_id, o.k, case when o.t - kept[-1].t >= 86400 then list_append(kept, {{'t': o.t, 'v': o.value}}) when o.value > kept[-1].v then list_append(kept[:-2], {{'t': o.t, 'v': o.value}}) else kept end
        from r join o on o.user_id = r.user_id and o.k = r.k + 1)
    select user_id, x.t as t, x.v as value from (select user_id, unnest(kept) as x from r qualify k = max(k) over (partition by user_id))""")
def w18_collapse_gaps(spark, d):
    p = R.peaks(indexed(events(spark, d).select("user_id", "event_id", "us", "t", "value")), KEY, "value", 60.0)
    return C.collapse_gaps(p, KEY, "t", "value", 86_400.0, F.floor(F.col("_t") / 86_400))


@query("""with recursive $E, p as (select user_id, t, value, lag(t) over (partition by user_id order by t, event_id) as b from e where event_type = 'purchase'),
    m as (select user_id, median(t - b) as step from p where b is not null group by user_id having min(t - b) > 0),
    l as (select user_id, step, greatest(0.35 * step, 0.02) as half, list(t order by t) as ts, list(value order by t) as vs from p join m using (user_id) group by user_id, step),
    r(user_id, want, i, got) as (select user_id, ts[1], 0, null::double from l union all
        select user_id, case when hi > lo then ts[pick] + step else want + step end, case when hi > lo then hi else greatest(i, len(list_filter(ts, lambda x: x < want + step - half))) end, case when hi > lo then ts[pick] end
        from (select *, lo + list_position(vs[lo + 1 : hi], list_max(vs[lo + 1 : hi])) as pick from (select r.user_id, want, i, step, half, ts, vs, greatest(i, len(list_filter(ts, lambda x: x < want - half))) as lo, len(list_filter(ts, lambda x: x < want + half)) as hi
            from r join l using (user_id) where r.i < len(ts))))
    select user_id, got as t from r where got is not null""")
def w19_follow_tempo(spark, d):
    e = kind(events(spark, d), "purchase").select("user_id", "event_id", "us", "t", "value")
    stats = A.tempo_stats(e, KEY, "t", "event_id", day()).select("user_id", "median_ibi")
    return C.follow_tempo(e.join(stats, "user_id"), KEY, "t", "value", "median_ibi")


@query("""with recursive $E, i as (select user_id, row_number() over (partition by user_id order by us, event_id) - 1 as idx, value from e),
    x as (select user_id, idx, list_transform([1.0, 2.5, 4.0, 5.5], lambda c: -abs(ln(1 + value) - c)) as l from i),
    q as (select user_id, idx, l, list_transform(l, lambda v: round((v - list_max(l)) * 268435456)::bigint) as q from x),
    f(user_id, idx, sc, back) as (select user_id, idx, q, [0::bigint] from q where idx = 0 union all
        select user_id, idx, list_transform(range(1, 5), lambda s: list_max(c[s]) + q[s]), list_transform(range(1, 5), lambda s: list_position(c[s], list_max(c[s]))::bigint) from
        (select q.user_id, q.idx, q.q, list_transform(range(1, 5), lambda s: list_transform(range(1, 5), lambda r: f.sc[r] + (case when r = s then round(ln(0.8) * 268435456) else round(ln((1 - 0.8) / 3) * 268435456) end)::bigint)) as c
            from f join q on q.user_id = f.user_id and q.idx = f.idx + 1)),
    b(user_id, idx, s) as (select user_id, idx, 5 - list_position(list_reverse(sc), list_max(sc)) from f qualify idx = max(idx) over (partition by user_id) union all
        select f.user_id, f.idx - 1, f.back[b.s] from b join f on f.user_id = b.user_id and f.idx = b.idx where f.idx > 0)
    select b.user_id, b.idx, (b.s - 1)::int as state, round(x.l[b.s], 6) as score from b join x on x.user_id = b.user_id and x.idx = b.idx""")
def w22_viterbi(spark, d):
    i = indexed(events(spark, d).select("user_id", "event_id", "us", "value"))
    logs = F.array(*[-F.abs(F.log1p("value") - c) for c in (1.0, 2.5, 4.0, 5.5)])
    return C.viterbi(i.withColumn("logs", logs), KEY, "idx", "logs", 0.8).select("user_id", "idx", "state", r6("score").alias("score"))


@query("""with $E, s as (select *, case when event_type = lag(event_type) over (partition by user_id order by us, event_id) then 0 else 1 end as f from e),
    g as (select *, sum(f) over (partition by user_id order by us, event_id) as run from s)
    select user_id, min(us) as first_us, max(us) as last_us, any_value(event_type) as state, count(*) as n from g group by user_id, run""")
def w23_runs(spark, d):
    out = R.islands(events(spark, d).select("user_id", "event_id", "us", "event_type"), KEY, ORDER, day(), F.col("event_type"))
    return out.select("user_id", F.col("first.us").alias("first_us"), F.col("last.us").alias("last_us"), "state", "n")


@query("""with $E select event_id, lead(us) over (partition by user_id order by us, event_id) - us as gap from e""")
def w24_next_gap(spark, d):
    return R.carry(events(spark, d).select("user_id", "event_id", "us"), KEY, ORDER, day(), {"nx": F.col("us")}, ahead=True).select("event_id", (F.col("nx") - F.col("us")).alias("gap"))


@query(f"""with recursive {_PEAKS}, o as (select *, row_number() over (partition by user_id order by value desc, t) as k from pk),
    r(user_id, k, kept) as (select user_id, k, [{{'t': t, 'v': value}}] from o where k = 1 union all
        select o.user_id, o.k, case when len(list_filter(kept, lambda x: abs(x.t - o.t) < 172800)) > 0 then kept else list_append(kept, {{'t': o.t, 'v': o.value}}) end from r join o on o.user_id = r.user_id and o.k = r.k + 1)
    select user_id, x.t as t, x.v as value from (select user_id, unnest(kept) as x from r qualify k = max(k) over (partition by user_id))""")
def w26_suppress(spark, d):
    p = R.peaks(indexed(events(spark, d).select("user_id", "event_id", "us", "t", "value")), KEY, "value", 60.0)
    return C.suppress(p, KEY, "t", "value", 172_800.0, F.floor(F.col("_t") / 86_400))


@query("""with $E, b as (select distinct user_id, us from (select user_id, us from e where event_type = 'error' union all select user_id, min(us) from e group by user_id union all select user_id, max(us) from e group by user_id)),
    p as (select user_id, us as first_us, lead(us) over (partition by user_id order by us) as end_us, row_number() over (partition by user_id order by us) - 1 as i from b)
    select user_id, first_us, end_us, chr(65 + (i % 26)::int) as label from p where end_us is not null""")
def w27_segments(spark, d):
    e = events(spark, d).select("user_id", "us", "event_type")
    ends = e.groupBy("user_id").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    b = kind(e, "error").select("user_id", "us").unionAll(ends.select("user_id", F.explode(F.array("a", "b")).alias("us"))).distinct()
    p = R.carry(R.index_rows(b, KEY, ["us"], day()), KEY, ["us"], day(), {"end_us": F.col("us")}, ahead=True)
    return p.where("end_us is not null").select("user_id", F.col("us").alias("first_us"), "end_us", S.section_letter(F.col("idx")).alias("label"))


@query("""with $E select event_id, round(sum(value) over (partition by user_id order by us, event_id), 4) as so_far from e""")
def w28_running_sum(spark, d):
    return R.running_sum(events(spark, d).select("user_id", "event_id", "us", "value"), KEY, ORDER, day(), F.col("value"), "s").select("event_id", r6("s", 4).alias("so_far"))


@query("""with l as (select l_orderkey, l_linenumber, l_quantity as ticks, l_extendedprice / 100 as tempo, sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as tick from lineitem),
    s as (select l_orderkey, tick, arg_max(tempo, l_linenumber) as tempo from l group by l_orderkey, tick),
    n as (select *, lead(tick) over (partition by l_orderkey order by tick) as nx from s)
    select l_orderkey, tick, round(coalesce(sum((nx - tick) * tempo) over (partition by l_orderkey order by tick rows between unbounded preceding and 1 preceding), 0), 4) as elapsed from n""")
def w29_tempo_map(spark, d):
    l = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (F.col("l_extendedprice") / 100).alias("tempo"), "l_extendedprice")
    key, bucket = ["l_orderkey"], F.floor(F.col("l_linenumber") / 1024)
    l = R.running_sum(l, key, ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], bucket, F.col("l_quantity"), "tick")
    s = l.groupBy("l_orderkey", "tick").agg(F.max_by("tempo", "l_linenumber").alias("tempo"))
    b = F.floor(F.col("tick") / 65_536)
    n = R.carry(s, key, ["tick"], b, {"last": F.struct("tick", "tempo")})
    spent = (F.col("tick") - F.col("last.tick")) * F.col("last.tempo")
    return R.running_sum(n, key, ["tick"], b, spent, "elapsed").select("l_orderkey", "tick", r6("elapsed", 4).alias("elapsed"))


@query("""with $E, i as (select *, us - lag(us) over (partition by user_id order by us, event_id) as ibi from e),
    s as (select event_id, list_sort(list(ibi) filter (ibi is not null) over (partition by user_id order by us, event_id rows between 2 preceding and 1 following)) as x from i)
    select event_id, case when len(x) > 0 then (x[(len(x) + 1) // 2] + x[len(x) // 2 + 1]) / 2 end as local from s""")
def w32_local_median(spark, d):
    e = R.carry(events(spark, d).select("user_id", "event_id", "us"), KEY, ORDER, day(), {"p": F.col("us")}).withColumn("ibi", F.col("us") - F.col("p"))
    return R.moving_median(indexed(e), KEY, "ibi", 2, 1, "local").select("event_id", "local")


@query("""with $E, q as (select user_id, quantile_cont(value, 0.9) as p90, max(value) as top from e group by user_id),
    s as (select e.*, max(value) over (partition by user_id order by us, event_id rows between 2 preceding and 2 following) as m,
        list_sort(list(value) over (partition by user_id order by us, event_id rows between 3 preceding and 3 following)) as x from e)
    select event_id, us from s join q using (user_id) where value = m and value > greatest((x[(len(x) + 1) // 2] + x[len(x) // 2 + 1]) / 2 + 0.1 * p90, 0.05 * top)""")
def w35_adaptive_onsets(spark, d):
    i = indexed(events(spark, d).select("user_id", "event_id", "us", "value"))
    i = R.moving_median(i, KEY, "value", 3, 3, "floor")
    i = R.over_rows(i, KEY, 2, 2, {"m": lambda by, frame: F.max("value").over(frame)})
    q = i.groupBy("user_id").agg(F.percentile("value", F.lit(0.9)).alias("p90"), F.max("value").alias("top"))
    hit = (F.col("value") == F.col("m")) & (F.col("value") > F.greatest(F.col("floor") + 0.1 * F.col("p90"), 0.05 * F.col("top")))
    return i.join(q, "user_id").where(hit).select("event_id", "us")


@query("""with $E, i as (select user_id, us, row_number() over (partition by user_id order by us, event_id) - 1 as idx, lead(us) over (partition by user_id order by us, event_id) as nx from e where event_type = 'purchase')
    select user_id, 'double' as level, us from i union all select user_id, 'double', us + (nx - us) // 2 from i where nx is not null
    union all select user_id, case when idx % 2 = 0 then 'even' else 'odd' end, us from i union all select user_id, 'offbeat', us + (nx - us) // 2 from i where nx is not null""")
def w36_metrical_levels(spark, d):
    p = indexed(kind(events(spark, d), "purchase").select("user_id", "event_id", "us"))
    p = R.carry(p, KEY, ORDER, day(), {"nx": F.col("us")}, ahead=True)
    mid = F.expr("us + (nx - us) div 2")
    levels = F.array(
        F.struct(F.lit("double").alias("level"), F.col("us").alias("at")),
        F.struct(F.lit("double").alias("level"), mid.alias("at")),
        F.struct(F.when(F.pmod("idx", F.lit(2)) == 0, "even").otherwise("odd").alias("level"), F.col("us").alias("at")),
        F.struct(F.lit("offbeat").alias("level"), mid.alias("at")),
    )
    return p.select("user_id", F.explode(levels).alias("x")).where("x.at is not null").select("user_id", "x.level", F.col("x.at").alias("us"))


@query("""with n as (select user_id, count(*) as n from events group by user_id)
    select distinct user_id, least(s, greatest(0, n - 16)) as start, least(n, 16) as real from (select user_id, n, unnest(range(0, greatest(1, n), 12)) as s from n) where s < greatest(1, n - 4) or s = 0""")
def w37_right_aligned_windows(spark, d):
    """Windows of 16 rows every 12; the last one is moved back to end with the series."""
    n = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.count("*").alias("n"))
    s = n.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.col("n")) - 1, F.lit(12).cast("long")))).where((F.col("s") < F.greatest(F.lit(1), F.col("n") - 4)) | (F.col("s") == 0))
    return s.select("user_id", F.least("s", F.greatest(F.lit(0).cast("long"), F.col("n") - 16)).alias("start"), F.least("n", F.lit(16)).alias("real")).distinct()


@query("""with $E, i as (select *, row_number() over (partition by user_id order by us, event_id) - 1 as idx from e),
    c as (select i.*, k.k as chunk, idx - 8 * k.k as p from i join range(0, 4096) k(k) on idx >= 8 * k.k and idx < 8 * k.k + 16),
    m as (select *, avg(value) over (partition by user_id, chunk) as est from c)
    select event_id, round(sum(est * (0.5 - 0.5 * cos(2 * pi() * (p + 0.5) / 16) + 0.001)) / sum(0.5 - 0.5 * cos(2 * pi() * (p + 0.5) / 16) + 0.001), 6) as mixed from m group by event_id""")
def w40_overlap_add(spark, d):
    """Chunks of 16 rows every 8, an estimate for each (its mean), and their weighted overlap-add."""
    i = indexed(events(spark, d).select("user_id", "event_id", "us", "value"))
    last = F.floor(F.col("idx") / 8)
    c = i.withColumn("chunk", F.explode(F.sequence(F.greatest(F.lit(0), last - 1), last)))
    est = c.groupBy("user_id", "chunk").agg(F.avg("value").alias("est"))
    w = 0.5 - 0.5 * F.cos(2 * F.pi() * (F.col("idx") - 8 * F.col("chunk") + 0.5) / 16) + 0.001
    return c.join(est, ["user_id", "chunk"]).groupBy("event_id").agg(r6(F.sum(F.col("est") * w) / F.sum(w)).alias("mixed"))


@query("""with $E, o as (select distinct user_id, least((us - 1704067200000000) // 3600000000, 719) as frame from e where event_type = 'purchase'), f as (select distinct user_id, unnest(range(0, 720)) as frame from events)
    select f.user_id, sum(case when o.frame is null then 0 else 1 end)::bigint as active, count(*) as frames from f left join o using (user_id, frame) group by f.user_id""")
def w43_frame_target(spark, d):
    e = events(spark, d)
    o = kind(e, "purchase").select("user_id", F.least(F.expr("(us - 1704067200000000) div 3600000000"), F.lit(719)).alias("frame")).distinct()
    f = e.select("user_id").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(719).cast("long"))))
    hit = o.withColumn("hit", F.lit(1))
    return f.join(hit, ["user_id", "frame"], "left").groupBy("user_id").agg(F.sum(F.coalesce("hit", F.lit(0))).cast("long").alias("active"), F.count("*").alias("frames"))


@query("""with recursive $E, i as (select user_id, value, row_number() over (partition by user_id order by us, event_id) - 1 as u from e),
    r(user_id, u, m) as (select user_id, u, value from i where u = 0 union all
        select i.user_id, i.u, least(0.9::double, (1.0::double + i.u) / (10 + i.u)) * m + (1 - least(0.9::double, (1.0::double + i.u) / (10 + i.u))) * i.value from r join i on i.user_id = r.user_id and i.u = r.u + 1)
    select user_id, round(m, 6) as ema from r qualify u = max(u) over (partition by user_id)""")
def w46_ema(spark, d):
    return C.ema(events(spark, d).select("user_id", "event_id", "us", "value"), KEY, ORDER, "value", 0.9, day()).select("user_id", r6("ema").alias("ema"))


# --- vectors in sequence ---


def vectors(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").where("label is not null")
    return R.index_rows(v.select("label", "vec_id", "embedding"), ["label"], ["vec_id"], F.floor(F.col("vec_id") / 4096))


_V = "v as (select label, vec_id, embedding::double[] as x, row_number() over (partition by label order by vec_id) - 1 as idx from embeddings)"
_BAND = f"""{_V}, b as (select a.label, a.idx as i, c.idx as j, case when a.idx = c.idx then 1.0 else greatest(-1, least(1, list_dot_product(a.x, c.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(c.x, c.x))))) end as s
    from v a join v c on a.label = c.label and c.idx >= a.idx and c.idx - a.idx < 16)"""


@query(f"with {_BAND} select label, i, j, round(s, 5) as similarity from b")
def j17_self_similarity(spark, d):
    return J.cosine_pairs(vectors(spark, d), ["label"], "idx", "embedding", 15).select("label", "i", "j", r6("similarity", 5).alias("similarity"))


@query(f"with {_BAND} select label, i, j, round(0.7 * s + 0.3 / (1 + j - i), 5) as blend from b")
def j18_blend(spark, d):
    band = J.cosine_pairs(vectors(spark, d), ["label"], "idx", "embedding", 15)
    return band.select("label", "i", "j", r6(0.7 * F.col("similarity") + 0.3 / (1 + F.col("j") - F.col("i")), 5).alias("blend"))


@query(f"""with {_BAND}, n as (select label, max(j) as last from b group by label),
    k as (select b.label, c.c as idx, sum(sign(i - c.c + 0.5) * sign(j - c.c + 0.5) * exp(-((i - c.c + 0.5) ** 2 + (j - c.c + 0.5) ** 2) / 32) * (case when i = j then 1 else 2 end) * s) as novelty
        from b join range(8, 100000) c(c) on i >= c.c - 8 and j <= c.c + 7 group by b.label, c.c)
    select label, idx, round(case when idx + 7 <= last then novelty else 0 end, 5) as novelty from k join n using (label) where idx <= last""")
def w25_novelty(spark, d):
    band = J.cosine_pairs(vectors(spark, d), ["label"], "idx", "embedding", 15)
    return C.novelty(band, ["label"], 8).select("label", "idx", r6("novelty", 5).alias("novelty"))


@query(f"""with {_V}, p as (select *, lag(x) over (partition by label order by idx) as y from v)
    select vec_id, round(coalesce(list_sum(list_transform(range(1, 65), lambda k: greatest(0, x[k] - y[k]))), 0), 5) as flux from p""")
def w12_flux(spark, d):
    v = R.carry(vectors(spark, d), ["label"], ["idx"], F.floor(F.col("idx") / 4096), {"y": F.col("embedding")})
    rise = F.aggregate(F.zip_with("embedding", "y", lambda a, b: F.greatest(F.lit(0.0), a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return v.select("vec_id", r6(F.coalesce(rise, F.lit(0.0)), 5).alias("flux"))


# --- tempo and meter ---


@query("""with $E, s as (select user_id, t, lag(t) over (partition by user_id order by t, event_id) as p from e where event_type = 'purchase'), i as (select user_id, p, t - p as ibi from s where p is not null),
    m as (select user_id, median(ibi) as med, count(*) as n, regr_slope(60 / ibi, p / 60) as k, regr_r2(60 / ibi, p / 60) as r2, regr_sxx(60 / ibi, p / 60) as sxx, regr_syy(60 / ibi, p / 60) as syy from i group by user_id having min(ibi) > 0),
    a as (select user_id, median(abs(ibi - med)) * 1000 as mad from i join m using (user_id) group by user_id)
    select user_id, n + 1 as beats, round(med, 5) as median_ibi, round(mad, 3) as mad_ms, round(case when sxx <= 1e-12 then 0 when syy <= 1e-12 then 1 else r2 end, 6) as r2,
        case when mad <= 5 then 'Programmed' when mad <= 40 then 'Human' else 'Variable' end as stability from m join a using (user_id)""")
def a05_tempo_stats(spark, d):
    s = A.tempo_stats(kind(events(spark, d), "purchase").select("user_id", "event_id", "us", "t"), KEY, "t", "event_id", day())
    return s.select("user_id", "beats", r6("median_ibi", 5).alias("median_ibi"), r6("mad_ms", 3).alias("mad_ms"), r6("r2").alias("r2"), "stability")


@query("""with $E, d as (select user_id, event_id, event_type, t / 86400 as t from e), s as (select user_id, t, lag(t) over (partition by user_id order by t, event_id) as p from d where event_type = 'purchase'), i as (select user_id, p, t - p as ibi from s where p is not null),
    m as (select user_id, median(ibi) as med, count(*) as n, regr_slope(60 / ibi, p / 60) as k, regr_r2(60 / ibi, p / 60) as r2, regr_sxx(60 / ibi, p / 60) as sxx, regr_syy(60 / ibi, p / 60) as syy from i group by user_id having min(ibi) > 0),
    a as (select user_id, median(abs(ibi - med)) * 1000 as mad from i join m using (user_id) group by user_id)
    select user_id, n + 1 as beats, round(med, 5) as median_ibi, round(mad, 3) as mad_ms, round(case when sxx <= 1e-12 then 0 else k end, 4) as drift, round(case when sxx <= 1e-12 then 0 when syy <= 1e-12 then 1 else r2 end, 6) as r2,
        case when sxx > 1e-12 and abs(k) >= 1 and (syy <= 1e-12 or r2 >= 0.5) then 'Drifting' when mad <= 5 then 'Programmed' when mad <= 40 then 'Human' else 'Variable' end as stability from m join a using (user_id)""")
def a07_stability(spark, d):
    """The same with a day played as a second: tempos drift."""
    e = kind(events(spark, d), "purchase").select("user_id", "event_id", "us", (F.col("t") / 86_400).alias("t"))
    s = A.tempo_stats(e, KEY, "t", "event_id", F.floor("t"))
    return s.select("user_id", "beats", r6("median_ibi", 5).alias("median_ibi"), r6("mad_ms", 3).alias("mad_ms"), r6("drift", 4).alias("drift"), r6("r2").alias("r2"), "stability")


@query("""with $E, i as (select user_id, value, row_number() over (partition by user_id order by us, event_id) - 1 as idx, count(*) over (partition by user_id) as n from e),
    m(meter, prior) as (values (2, 0.8::double), (3, 0.9), (4, 1.0), (5, 0.65), (6, 0.75), (7, 0.6)), p as (select user_id, meter, prior, idx % meter as ph, avg(value) as a from i cross join m group by all),
    s as (select user_id, meter, (max(a) - avg(a)) * any_value(prior) as score from p group by user_id, meter), r as (select *, row_number() over (partition by user_id order by score desc, meter) as k from s),
    t as (select user_id, max(case when k = 1 then meter end) as meter, max(case when k = 1 then score end) as s1, max(case when k = 2 then score end) as s2 from r group by user_id), n as (select distinct user_id, n from i)
    select user_id, case when n < 14 then 4 else meter end::int as meter, round(case when n < 14 then 0 else least(1, greatest(0, (s1 - s2) / (s1 + greatest(s2, 0) + 1e-9))) end, 6) as confidence from t join n using (user_id)""")
def a09_meter(spark, d):
    return A.meter(indexed(events(spark, d).select("user_id", "event_id", "us", "value")), KEY, "idx", "value").select("user_id", "meter", r6("confidence").alias("confidence"))


@query("""with $E, i as (select user_id, value, (row_number() over (partition by user_id order by us, event_id) - 1) % 4 as ph from e), s as (select user_id, ph, sum(value) as v from i group by user_id, ph)
    select user_id, arg_max(ph, v)::bigint as phase from s group by user_id""")
def a10_downbeat_phase(spark, d):
    i = indexed(events(spark, d).select("user_id", "event_id", "us", "value")).withColumn("n", F.lit(4).cast("long"))
    return A.downbeat_phase(i, KEY, "idx", "value", "n")


@query("""with $E, i as (select *, row_number() over (partition by user_id order by us, event_id) - 1 as idx, count(*) over (partition by user_id) as n from e) select user_id, value as lower_median from (select user_id, value, row_number() over (partition by user_id order by value, event_id) - 1 as k, count(*) over (partition by user_id) as n from e) where k = (n - 1) // 2""")
def a19_lower_median(spark, d):
    return A.lower_median(events(spark, d).select("user_id", "event_id", "value"), KEY, ["value", "event_id"], "value", F.floor(F.col("value") / 50))


@query("""with recursive $E, w as (select user_id, floor(t / 86400) as s, sum(value) as v from e group by all), o as (select *, row_number() over (partition by user_id order by v desc, s) as k from w),
    r(user_id, k, kept) as (select user_id, k, [{'s': s, 'v': v}] from o where k = 1 union all
        select o.user_id, o.k, case when len(kept) >= 4 or len(list_filter(kept, lambda x: abs(x.s - o.s) < 3)) > 0 then kept else list_append(kept, {'s': o.s, 'v': o.v}) end from r join o on o.user_id = r.user_id and o.k = r.k + 1)
    select user_id, place, kept[place + 1].s as s, round(kept[place + 1].v, 6) as score from (select user_id, kept, unnest(range(0, len(kept)))::int as place from r qualify k = max(k) over (partition by user_id))""")
def r03_top_windows(spark, d):
    e = events(spark, d)
    w = e.select("user_id", F.floor(F.col("t") / 86_400).alias("s"), "value").groupBy("user_id", "s").agg(F.sum("value").alias("v"))
    return C.top_windows(w, KEY, "s", F.col("v"), 3.0).select("user_id", "place", "s", r6("score").alias("score"))


@query("""with $E, h as (select user_id, us // 86400000000 as day, avg(value * value) as p, count(*) as n from e group by all)
    select user_id, day, round(10 * log10(p + 1e-12), 6) as level, 10 * log10(p + 1e-12) > 30 as active from h where n >= 2""")
def p07_block_activity(spark, d):
    h = events(spark, d).groupBy("user_id", F.expr("us div 86400000000").alias("day")).agg(F.avg(F.col("value") * F.col("value")).alias("p"), F.count("*").alias("n")).where("n >= 2")
    level = S.power_db(F.col("p"))
    return h.select("user_id", "day", r6(level).alias("level"), (level > 30).alias("active"))
