"""Queries that compare signals, estimates and runs, and the lookups and filters around them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tactus.functions import scalar as S
from tactus.operators import evaluation as V
from tactus.operators import joins as J
from tactus.operators import series as R
from tactus.plans.series_queries import _E, KEY, ORDER, day, events, indexed, kind, r6
from tactus.plans.table_queries import tb
from tactus.sources.materialise import cut

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_I = f"{_E}, i as (select *, row_number() over (partition by user_id order by us, event_id) - 1 as idx, count(*) over (partition by user_id) as n from e)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def sized(spark, d):
    """Events with their place and the length of their series."""
    i = indexed(events(spark, d).select("user_id", "event_id", "us", "value"))
    return i.join(i.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")


# --- signals against signals ---


@query("""with s as (select l_returnflag, sum(l_quantity * l_quantity) as aa, sum(l_quantity * l_tax) as ab, sum(l_tax * l_tax) as bb, sum(l_extendedprice * l_quantity) as ya, sum(l_extendedprice * l_tax) as yb, sum(l_extendedprice * l_extendedprice) as yy from lineitem group by all),
    c as (select *, (ya * bb - yb * ab) / (aa * bb - ab * ab) as k1, (yb * aa - ya * ab) / (aa * bb - ab * ab) as k2 from s)
    select l_returnflag, round(k1, 3) as quantity, round(k2, 2) as tax, round((k1 * ya + k2 * yb) / yy, 5) as explained from c""")
def a30_least_squares(spark, d):
    x = V.least_squares(tb(spark, d, "lineitem"), ["l_returnflag"], F.col("l_extendedprice"), [F.col("l_quantity"), F.col("l_tax")])
    c = lambda k: F.get("coefficients", F.lit(k))
    return x.select("l_returnflag", r6(c(0), 3).alias("quantity"), r6(c(1), 2).alias("tax"), r6("explained", 5).alias("explained"))


@query(f"""with {_I}, l as (select a.user_id, k.k as lag, sum(a.value * (b.us // 1000000 % 86400)) as p from i a cross join range(-12, 13) k(k) join i b on b.user_id = a.user_id and b.idx = a.idx + k.k group by all),
    r as (select *, row_number() over (partition by user_id order by round(p, 6) desc, lag) as o from l) select user_id, lag::bigint as lag, round(p, 2) as product from r where o = 1""")
def a32_best_lag(spark, d):
    """Values of events against their times of day."""
    i = indexed(events(spark, d).select("user_id", "event_id", "us", "value"))
    day_time = i.select("user_id", "idx", (F.expr("us div 1000000") % 86_400).alias("value"))
    return V.best_lag(i, day_time, KEY, "idx", "value", 12).select("user_id", "lag", r6("product", 2).alias("product"))


@query("""with s as (select l_orderkey, l_returnflag, avg(abs(l_discount * l_quantity)) as e, avg(abs(case when l_linestatus = 'F' then l_quantity else 0 end)) as t from lineitem group by all)
    select l_orderkey, round(avg(case when t > 1e-8 then 1 else 0.5 end * e), 9) as l1, round(avg(case when t > 1e-8 then e / t else 0.5 * e end), 9) as normal, count(*) as sources from s group by l_orderkey""")
def a16_separation_loss(spark, d):
    target = F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(0.0)
    x = V.separation_loss(tb(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag", target, target + F.col("l_discount") * F.col("l_quantity"), silent=0.5)
    return x.select("l_orderkey", r6("l1", 9).alias("l1"), r6("normal", 9).alias("normal"), "sources")


#: one-to-one matches within tol of the lists a and b of l(user_id, tol, a, b)
_HITS = """r(user_id, tol, i, j, hit) as (select user_id, tol, 1, 1, false from l union all
        select user_id, tol, case when near or x < y then i + 1 else i end, case when near or x >= y then j + 1 else j end, near
        from (select r.user_id, r.tol, i, j, a[i] as x, b[j] as y, abs(a[i] - b[j]) <= r.tol as near from r join l on l.user_id = r.user_id and l.tol = r.tol where i <= len(a) and j <= len(b))),
    h as (select l.user_id, l.tol, count(*) filter (r.hit) as hits, any_value(len(l.a)) as refs, any_value(len(l.b)) as ests from l join r on r.user_id = l.user_id and r.tol = l.tol group by all)"""


@query(f"""with recursive $E, l as (select user_id, 21600 as tol, coalesce(list(t order by t) filter (event_type = 'view'), []) as a, coalesce(list(t order by t) filter (event_type = 'click'), []) as b from e where event_type in ('view', 'click') group by user_id),
    {_HITS}
    select user_id, hits as found, refs::bigint as refs, ests::bigint as ests, round(hits / greatest(ests, 1), 6) as precision, round(hits / greatest(refs, 1), 6) as recall, round(2 * hits / greatest(refs + ests, 1), 6) as f from h""".replace("$E", _E))
def a23_beat_score(spark, d):
    """Clicks as estimates of views: one-to-one matches within six hours."""
    e = events(spark, d).select("user_id", "t", "event_type")
    x = V.detection_score(kind(e, "view"), kind(e, "click"), KEY, "t", 21_600.0, F.floor(F.col("_t") / 86_400))
    return x.select("user_id", "found", "refs", "ests", *[r6(c).alias(c) for c in ("precision", "recall", "f")])


@query(f"""with recursive $E, x as (select user_id, event_type, t, row_number() over (partition by user_id, event_type order by us, event_id) as k from e where event_type in ('purchase', 'signup')),
    l as (select user_id, unnest([10800, 64800]) as tol, coalesce(list(t order by t) filter (event_type = 'purchase'), []) as a, coalesce(list(t order by t) filter (event_type = 'signup'), []) as b from x where k > 1 group by user_id),
    {_HITS}
    select n.user_id, round(2 * n.hits / greatest(n.refs + n.ests, 1), 6) as f_narrow, round(n.ests / nullif(n.refs, 0), 6) as count_ratio, round(2 * w.hits / greatest(w.refs + w.ests, 1), 6) as f_wide
    from h n join h w on w.user_id = n.user_id and n.tol = 10800 and w.tol = 64800""".replace("$E", _E))
def a24_boundary_score(spark, d):
    """Boundary scores at a narrow and a wide tolerance, and how many estimates there are for a reference; the first boundary of each list is left out."""
    e = events(spark, d).select("user_id", "event_id", "us", "t", "event_type")
    later = lambda k: indexed(kind(e, k)).where("idx > 0").select("user_id", "t")
    ref, est = cut(later("purchase"), "reference"), cut(later("signup"), "estimate")
    narrow, wide = (V.detection_score(ref, est, KEY, "t", s, F.floor(F.col("_t") / 86_400)) for s in (10_800.0, 64_800.0))
    out = narrow.select("user_id", r6("f").alias("f_narrow"), r6(F.try_divide("ests", "refs")).alias("count_ratio"))
    return out.join(wide.select("user_id", r6("f").alias("f_wide")), "user_id")


@query(f"""with {_I}, k as (select distinct user_id, n, unnest(range(0, (greatest(1, (n + 15) // 16))::bigint)) as c from i), s as (select *, case when n > 16 and c = (n + 15) // 16 - 1 then n - 20 else c * 16 - 4 end as start from k),
    m as (select i.event_id, s.c, i.idx - s.start as place, row_number() over (partition by i.event_id order by s.c) as o from i join s on s.user_id = i.user_id and i.idx >= s.start + 4 and i.idx < s.start + 20)
    select event_id, c as chunk, place from m where o = 1""")
def w39_chunks(spark, d):
    x = sized(spark, d).withColumn("c", V.chunk_of(F.col("idx"), F.col("n"), 24, 4))
    return x.select("event_id", "c.chunk", "c.place")


@query(f"""with {_I}, c as (select distinct user_id, n, unnest(range(0, n, 12)) as k from i), s as (select distinct user_id, n, least(k, greatest(0, n - 16)) as start from c where k < greatest(0, n - 16) union select distinct user_id, n, greatest(0, n - 16) from i),
    p as (select i.event_id, s.start, i.value, least(16, i.n) as size, i.idx - s.start as place from i join s on s.user_id = i.user_id and i.idx >= s.start and i.idx < s.start + 16), m as (select *, avg(value) over (partition by start, u) as est from (select p.*, e.user_id as u from p join e using (event_id)))
    select event_id, round(sum(pow(sin(pi() * (place + 0.5) / size), 2) * est) / greatest(1e-8, sum(pow(sin(pi() * (place + 0.5) / size), 2))), 8) as value from m group by event_id""")
def w41_cross_fade(spark, d):
    """Chunks of 16 every 12, the last right-aligned; each estimates its mean, and the estimates cross-fade."""
    x = sized(spark, d).withColumn("start", F.explode(V.chunks_over(F.col("idx"), F.col("n"), 16, 12)))
    est = x.groupBy("user_id", "start").agg(F.avg("value").alias("est"))
    out = V.cross_faded(x.join(est, ["user_id", "start"]), ["user_id"], "event_id", F.col("idx") - F.col("start"), F.least(F.lit(16), F.col("n")), F.col("est"))
    return out.select("event_id", r6("value", 8).alias("value"))


@query(f"""with {_I}, p as (select i.user_id, i.idx, k.k, x.value from i cross join range(-2, 3) k(k) join i x on x.user_id = i.user_id and x.idx = least(greatest(0, i.idx + k.k), i.n - 1)) select user_id, idx, median(value) as level from p group by all""")
def w33_edge_median(spark, d):
    """Moving median of five whose window repeats the first and last value beyond the ends."""
    i = sized(spark, d)
    w = {"x": lambda by, frame: F.collect_list(F.struct("idx", "value", "n")).over(frame)}
    at = R.over_rows(i, KEY, 2, 2, w)
    copies = lambda s: F.when((s["idx"] == 0) & (s["n"] == 1), 5).when((s["idx"] == 0), 1 + F.greatest(F.lit(0), 2 - F.col("idx"))).when(s["idx"] == s["n"] - 1, 1 + F.greatest(F.lit(0), F.col("idx") + 3 - s["n"])).otherwise(1)
    full = F.array_sort(F.flatten(F.transform("x", lambda s: F.array_repeat(s["value"], copies(s).cast("int")))))
    return at.select("user_id", "idx", F.get(full, F.lit(2)).alias("level"))


@query(f"""with {_I}, l as (select *, lag(us) over (partition by user_id order by us, event_id) as p, lag(value) over (partition by user_id order by us, event_id) as q from i) select user_id, event_id, round(coalesce(sum((us - p) / 1e6 * q / 100) over (partition by user_id order by us, event_id), 0), 3) as seconds from l""")
def w30_tempo_seconds(spark, d):
    """Seconds up to each event where the event before sets the tempo."""
    e = events(spark, d).select("user_id", "event_id", "us", "value")
    seen = R.carry(e, KEY, ORDER, day(), {"p": F.struct("us", "value")})
    x = R.running_sum(seen, KEY, ORDER, day(), (F.col("us") - F.col("p.us")) / 1e6 * F.col("p.value") / 100, "s")
    return x.select("user_id", "event_id", r6("s", 3).alias("seconds"))


@query("""with m as (select o_orderkey, o_custkey, o_orderdate, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as seg, lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as nx, 2 + o_orderkey % 3 as beats from orders),
    b as (select *, unnest(range(0, greatest(0, date_diff('day', o_orderdate, nx)), 30)) as day from m where nx is not null) select o_custkey, seg, day, (day // 30) % beats + 1 as beat from b""")
def w31_reference_beats(spark, d):
    """Beats every 30 days from each order to the next; the bar counter restarts at each order, whose key sets the meter."""
    o = tb(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    o = R.index_rows(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.year("o_orderdate"), "seg")
    o = R.carry(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.year("o_orderdate"), {"nx": F.col("o_orderdate")}, ahead=True)
    days = F.datediff("nx", "o_orderdate")
    b = o.where(days > 0).withColumn("day", F.explode(F.sequence(F.lit(0).cast("long"), days.cast("long") - 1, F.lit(30).cast("long"))))
    return b.select("o_custkey", "seg", "day", (F.expr("day div 30") % (2 + F.col("o_orderkey") % 3) + 1).alias("beat"))


@query("""with n as (select user_id, count(*) as n from events group by user_id) select user_id, unnest(range(0, greatest(1, n - 9), 5)) as start from n""")
def w38_plain_windows(spark, d):
    """Windows of ten every five, none moved to the end; a short series has one."""
    n = tb(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("n") - 10), F.lit(5).cast("long"))).alias("start"))


# --- filters, verdicts and unions ---


@query(f"with {_E}, s as (select user_id, min(t) as a, max(t) as b from e group by user_id) select e.user_id, count(*) as n, round(sum(value), 4) as total from e join s using (user_id) where b - a <= 864000 or (t - a >= 432000 and t - a < 864000) group by e.user_id")
def p01_quick_window(spark, d):
    """Short series whole, of longer ones days 5 to 10."""
    e = events(spark, d)
    s = e.groupBy("user_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    at = F.col("t") - F.col("a")
    return e.join(s, "user_id").where((F.col("b") - F.col("a") <= 864_000) | ((at >= 432_000) & (at < 864_000))).groupBy("user_id").agg(F.count("*").alias("n"), r6(F.sum("value"), 4).alias("total"))


@query(f"with {_E}, o as (select user_id, event_id, us from e where event_type = 'purchase') select o.event_id from o join e on e.user_id = o.user_id and e.us >= o.us and e.us < o.us + 172800000000 group by o.event_id having 10 * log10(avg(e.value * e.value) + 1e-12) > 35")
def p06_audible_onsets(spark, d):
    """Purchases followed by two loud days."""
    e = events(spark, d).select("user_id", "event_id", "us", "value", "event_type")
    spans = kind(e, "purchase").select("user_id", "event_id", F.col("us").alias("first"), (F.col("us") + 172_800_000_000).alias("end"))
    near = J.points_in_intervals(e, spans, KEY, "us", "first", "end", 172_800_000_000)
    level = near.groupBy(F.col("interval.event_id").alias("event_id")).agg(F.avg(F.col("point.value") * F.col("point.value")).alias("p"))
    return level.where(S.power_db(F.col("p")) > 35).select("event_id")


@query("select p_partkey from part where (contains(lower(p_type), 'brass') and not contains(lower(p_type), 'small')) or contains(lower(p_type), 'tin')")
def p09_tag_filter(spark, d):
    t = F.lower("p_type")
    return tb(spark, d, "part").where((t.contains("brass") & ~t.contains("small")) | t.contains("tin")).select("p_partkey")


@query("select o_custkey, case when count(distinct o_orderstatus) = 1 then 'ok' else 'conflict' end as verdict, case when count(distinct o_orderstatus) = 1 then max(o_orderstatus) end as source from orders where o_orderpriority in ('1-URGENT', '2-HIGH') group by o_custkey")
def p10_verdicts(spark, d):
    o = tb(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).groupBy("o_custkey").agg(F.min("o_orderstatus").alias("a"), F.max("o_orderstatus").alias("b"))
    one = F.col("a").eqNullSafe(F.col("b"))
    return o.select("o_custkey", F.when(one, "ok").otherwise("conflict").alias("verdict"), F.when(one, F.col("b")).alias("source"))


@query("select o_orderkey, case when o_totalprice is null then 1 when o_totalprice < 0 then 2 when o_totalprice < 50000 then 3 else 0 end as code from orders")
def p13_guard_codes(spark, d):
    """Status codes in place of exits: missing 1, invalid 2, below the strict threshold 3, else 0."""
    p = F.col("o_totalprice")
    return tb(spark, d, "orders").select("o_orderkey", F.when(p.isNull(), 1).when(p < 0, 2).when(p < 50_000, 3).otherwise(0).alias("code"))


@query(f"""with {_I}, r as (select user_id, value, row_number() over (partition by user_id order by value, event_id) - 1 as k, count(*) over (partition by user_id) as n from e), q as (select user_id, value as p90 from r where k = floor(0.9 * n))
    select i.event_id, case when i.value < 20 then 'quiet' when i.value >= greatest(50, 0.6 * p90) then 'clean' when i.value >= 40 then 'mixed' else 'other' end as class from i join q using (user_id)""")
def p17_window_classes(spark, d):
    e = events(spark, d).select("user_id", "event_id", "us", "value")
    r = R.index_rows(e, KEY, ["value", "event_id"], F.floor(F.col("value") / 50), "k")
    n = e.groupBy("user_id").agg(F.count("*").alias("n"))
    q = r.join(n, "user_id").where(F.col("k") == F.floor(0.9 * F.col("n"))).select("user_id", F.col("value").alias("p90"))
    v = F.col("value")
    kind_ = F.when(v < 20, "quiet").when(v >= F.greatest(F.lit(50.0), 0.6 * F.col("p90")), "clean").when(v >= 40, "mixed").otherwise("other")
    return e.join(q, "user_id").select("event_id", kind_.alias("class"))


@query("select c.c_custkey, g.rate, g.lag, round(c.c_acctbal * g.rate + g.lag, 4) as score from customer c cross join (select r.r / 4.0 as rate, l.l as lag from range(1, 4) r(r) cross join range(0, 4) l(l)) g")
def j22_parameter_grid(spark, d):
    """Every customer with every one of twelve settings: a fixed grid, exploded, not joined."""
    grid = F.array(*[F.struct(F.lit(r / 4.0).alias("rate"), F.lit(k).cast("long").alias("lag")) for r in (1, 2, 3) for k in range(4)])
    return tb(spark, d, "customer").select("c_custkey", "c_acctbal", F.explode(grid).alias("g")).select("c_custkey", "g.rate", "g.lag", r6(F.col("c_acctbal") * F.col("g.rate") + F.col("g.lag"), 4).alias("score"))


@query("""with a(name, alias) as (values ('BUILDING', 'keys'), ('MACHINERY', 'bass')) select coalesce(alias, 'other') as source, count(*) as n, round(sum(c_acctbal), 2) as total from customer left join a on name = c_mktsegment group by all""")
def j20_alias_sum(spark, d):
    alias = F.create_map(F.lit("BUILDING"), F.lit("keys"), F.lit("MACHINERY"), F.lit("bass"))
    return tb(spark, d, "customer").groupBy(F.coalesce(F.try_element_at(alias, F.col("c_mktsegment")), F.lit("other")).alias("source")).agg(F.count("*").alias("n"), r6(F.sum("c_acctbal"), 2).alias("total"))


@query("""select o_orderkey, coalesce(l.flag, c.c_mktsegment, 'unknown') as tag from orders left join (select l_orderkey, max(l_returnflag) as flag from lineitem where l_returnflag <> 'N' group by l_orderkey) l on l.l_orderkey = o_orderkey left join customer c on c.c_custkey = o_custkey""")
def j21_tag_precedence(spark, d):
    """Tags of the parts before the tag of the customer before unknown."""
    flags = tb(spark, d, "lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_returnflag").alias("flag"))
    c = tb(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    o = tb(spark, d, "orders").select("o_orderkey", "o_custkey").join(flags, "o_orderkey", "left").join(c, "o_custkey", "left")
    return o.select("o_orderkey", F.coalesce("flag", "c_mktsegment", F.lit("unknown")).alias("tag"))


@query("select o_orderstatus as status, count(*) as total, sum((o_totalprice >= 100000)::int)::bigint as done, round(avg(case when o_totalprice >= 100000 then o_totalprice end), 2) as mean_done from orders group by o_orderstatus")
def a40_success_means(spark, d):
    done = F.col("o_totalprice") >= 100_000
    return tb(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("total"), F.count_if(done).alias("done"), r6(F.avg(F.when(done, F.col("o_totalprice"))), 2).alias("mean_done"))


@query("""select 'order' as kind, o_orderkey as id, o_totalprice as size from orders where o_totalprice > 300000 union all select 'part', p_partkey, p_retailprice from part where p_retailprice > 1500""")
def u01_shared_timeline(spark, d):
    o = tb(spark, d, "orders").where("o_totalprice > 300000").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("size"))
    return o.unionByName(tb(spark, d, "part").where("p_retailprice > 1500").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("size")))


@query("select distinct boundary from (select o_orderdate as boundary from orders union select l_shipdate from lineitem)")
def u03_distinct_boundaries(spark, d):
    return tb(spark, d, "orders").select(F.col("o_orderdate").alias("boundary")).union(tb(spark, d, "lineitem").select("l_shipdate")).distinct()


@query("select c_nationkey, c_custkey, c_acctbal from (select *, row_number() over (partition by c_nationkey order by c_custkey) as k from customer) where k <= 3")
def r06_first_of_each(spark, d):
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    return tb(spark, d, "customer").withColumn("k", place).where("k <= 3").select("c_nationkey", "c_custkey", "c_acctbal")


@query("select p_partkey, greatest(1, round_even(p_retailprice * 0.15, 0))::bigint as n from part")
def w47_split_sizes(spark, d):
    return tb(spark, d, "part").select("p_partkey", S.split_sizes(F.col("p_retailprice"), F.lit(0.15)).cast("long").alias("n"))
