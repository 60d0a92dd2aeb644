"""Queries of whole scores: clicks as estimates of views, sign-ups as estimates of purchases."""

from __future__ import annotations

from pyspark.sql import functions as F

from tactus.operators import scores as Z
from tactus.operators import series as R
from tactus.plans.series_queries import _E, KEY, events, kind, r6

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
DAY, HOUR = 86_400.0, 3_600.0


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql.replace("$E", _E)
        return f

    return add


#: one-to-one matches of the lists a and b of l(user_id, name, tol, a, b), counted in h(user_id, name, hits)
_MATCHES = """r(user_id, name, i, j, hit) as (select user_id, name, 1, 1, false from l union all
        select user_id, name, case when near or x < y then i + 1 else i end, case when near or x >= y then j + 1 else j end, near
        from (select r.user_id, r.name, i, j, a[i] as x, b[j] as y, abs(a[i] - b[j]) <= tol as near from r join l on l.user_id = r.user_id and l.name = r.name where i <= len(a) and j <= len(b))),
    h as (select l.user_id, l.name, count(*) filter (r.hit) as hits, any_value(len(l.a)) as refs, any_value(len(l.b)) as ests from l join r on r.user_id = l.user_id and r.name = l.name group by all)"""


@query(f"""with recursive $E, v as (select user_id, t, value > 60 as down, row_number() over w - 1 as idx, lag(t) over w as p, lead(t) over w as n from e where event_type = 'view' window w as (partition by user_id order by t)),
    c as (select user_id, t, value > 60 as down from e where event_type = 'click'),
    ne as (select v.user_id, v.idx, c.t - v.t as d, (coalesce(n, v.t) - coalesce(p, v.t)) / 4 as half, row_number() over (partition by v.user_id, v.idx order by abs(c.t - v.t), c.t desc) as k from v join c using (user_id)),
    o as (select user_id, coalesce(median(d) filter (k = 1 and abs(d) <= half), 0) as off from (select distinct user_id from v) left join ne using (user_id) group by user_id),
    s as (select c.user_id, c.t - o.off as t, down, row_number() over (partition by c.user_id order by c.t) - 1 as q from c join o using (user_id)),
    ref as (select user_id, 'raw' as name, t from v union all select user_id, 'same', t from v union all select user_id, 'double', t from v union all select user_id, 'double', (t + n) / 2 from v where n is not null
        union all select user_id, case when idx % 2 = 0 then 'half (odd)' else 'half (even)' end, t from v union all select user_id, 'off-beat', (t + n) / 2 from v where n is not null union all select user_id, 'down', t from v where down),
    est as (select c.user_id, 'raw' as name, t from c join o using (user_id) union all select user_id, unnest(['same', 'double', 'half (odd)', 'half (even)', 'off-beat']), t from s union all select user_id, 'down', t from s where down),
    x as (select user_id, name, list(t order by t) as a from ref group by all), y as (select user_id, name, list(t order by t) as b from est group by all),
    l as (select coalesce(x.user_id, y.user_id) as user_id, coalesce(x.name, y.name) as name, 21600 as tol, coalesce(a, []) as a, coalesce(b, []) as b from x full join y on x.user_id = y.user_id and x.name = y.name),
    {_MATCHES},
    f as (select user_id, name, 2.0::double * hits / greatest(1, refs + ests) as f from h),
    m as (select v.user_id, v.idx, v.t, s.q, s.t as st, 0.175::double * coalesce(v.n - v.t, v.t - v.p) as tol, row_number() over (partition by v.user_id, v.idx order by abs(s.t - v.t), s.t) as k from v left join s using (user_id)),
    g as (select user_id, idx, t, tol, case when abs(st - t) <= tol then q end as q, case when abs(st - t) <= tol then st end as st from m where k = 1),
    w as (select *, lag(q) over z as pq, lag(st) over z as pst, lag(t) over z as pt from g window z as (partition by user_id order by idx)),
    u as (select user_id, count(*) filter (q = pq + 1 and abs((st - pst) - (t - pt)) <= tol) / count(*)::double as share, count(*) as n from w group by user_id),
    k as (select user_id, case when n > 1 and (select count(*) from s where s.user_id = u.user_id) > 1 then share else 0 end as cmlt from u),
    b as (select user_id, max(f) as best, arg_max(name, f * 1000 - list_position(['same', 'double', 'half (odd)', 'half (even)', 'off-beat'], name) * 1e-9) as level, max(f) filter (name = 'same') as same from f where name not in ('raw', 'down') group by user_id)
    select o.user_id, round(f.f, 6) as f, round(o.off, 4) as offset, round(b.same, 6) as f_shifted, round(b.best, 6) as f_any_level, b.level as best_level, round(k.cmlt, 6) as cmlt, round(coalesce(d.f, 0), 6) as down_f
    from o join f on f.user_id = o.user_id and f.name = 'raw' join b on b.user_id = o.user_id join k on k.user_id = o.user_id left join f d on d.user_id = o.user_id and d.name = 'down'""")
def a23_run_score(spark, d):
    """Beats: matches, median offset, the best metrical level, continuity and downbeats, within six hours."""
    e = events(spark, d).select("user_id", "t", "event_type", (F.col("value") > 60).alias("down"))
    s = Z.beat_score(kind(e, "view"), kind(e, "click"), KEY, "t", "down", DAY, 6 * HOUR)
    return s.select("user_id", r6("f").alias("f"), r6("offset", 4).alias("offset"), *[r6(c).alias(c) for c in ("f_shifted", "f_any_level", "cmlt", "down_f")], "best_level")


def sections(e, name):
    """Sections from each event of a kind to the next, labelled by the event's value; times from the user's first event on."""
    x = kind(e, name)
    x = R.carry(x, KEY, ["us", "event_id"], F.floor(F.col("us") / 86_400_000_000), {"next": F.col("s")}, ahead=True)
    return x.select("user_id", F.col("s").alias("start"), F.coalesce("next", F.col("last")).alias("end"), F.floor(F.col("value") / 50).cast("string").alias("label"))


@query(f"""with recursive $E, z as (select user_id, min(us) as a, (max(us) - min(us)) / 1e6 as last from e group by user_id), s as (select e.user_id, event_type, event_id, us, (us - a) / 1e6 as s, value, last from e join z using (user_id)),
    x as (select user_id, event_type, s as first, coalesce(lead(s) over w, last) as fin, floor(value / 50)::bigint::varchar as label, row_number() over w - 1 as idx from s where event_type in ('purchase', 'signup') window w as (partition by user_id, event_type order by us, event_id)),
    p as (select * from x where event_type = 'purchase'), q as (select * from x where event_type = 'signup'),
    n as (select user_id, count(*) as n, max(fin) as fin from p group by user_id), m as (select user_id, count(*) as m from q group by user_id),
    l as (select n.user_id, t.name, t.tol, coalesce((select list(first order by first) from p where p.user_id = n.user_id and idx > 0), []) as a, coalesce((select list(first order by first) from q where q.user_id = n.user_id and idx > 0), []) as b from n cross join (values ('n', 10800), ('w', 64800)) t(name, tol)),
    {_MATCHES},
    f as (select user_id, name, 2.0::double * hits / greatest(1, refs + ests) as f from h),
    fr as (select user_id, unnest(range(0, floor(fin / 43200)::bigint)) * 43200.0 as t from n),
    lb as (select fr.user_id, fr.t, p.label as r, q.label as e from fr left join p on p.user_id = fr.user_id and p.first <= fr.t and fr.t < p.fin left join q on q.user_id = fr.user_id and q.first <= fr.t and fr.t < q.fin),
    cb as (select user_id, sum(k * (k - 1) / 2) as v from (select user_id, count(*) as k from lb group by user_id, r, e) group by user_id), cr as (select user_id, sum(k * (k - 1) / 2) as v from (select user_id, count(*) as k from lb group by user_id, r) group by user_id),
    ce as (select user_id, sum(k * (k - 1) / 2) as v from (select user_id, count(*) as k from lb group by user_id, e) group by user_id)
    select n.user_id, round(fn.f, 6) as f_narrow, round(fw.f, 6) as f_wide, round(coalesce(2 * cb.v / nullif(cr.v + ce.v, 0), 0), 6) as pair_f, round(coalesce(m.m, 0) / n.n, 6) as ratio
    from n left join m using (user_id) join f fn on fn.user_id = n.user_id and fn.name = 'n' join f fw on fw.user_id = n.user_id and fw.name = 'w' left join cb on cb.user_id = n.user_id left join cr on cr.user_id = n.user_id left join ce on ce.user_id = n.user_id""")
def a24_structure_score(spark, d):
    """Sections: boundaries within three and eighteen hours, labels of half days in pairs, and their number."""
    e = events(spark, d).select("user_id", "event_id", "us", "event_type", "value")
    z = e.groupBy("user_id").agg(F.min("us").alias("_a"), ((F.max("us") - F.min("us")) / 1e6).alias("last"))
    e = e.join(z, "user_id").withColumn("s", (F.col("us") - F.col("_a")) / 1e6)
    s = Z.structure_score(sections(e, "purchase"), sections(e, "signup"), KEY, DAY, DAY / 2, 3 * HOUR, 18 * HOUR)
    return s.select("user_id", *[r6(c).alias(c) for c in ("f_narrow", "f_wide", "pair_f", "ratio")])


@query(f"""with recursive $E, v as (select user_id, list(t order by t) as a from e where event_type = 'view' group by user_id having count(*) >= 10), c as (select user_id, list(t order by t) as b from e where event_type = 'click' group by user_id),
    l as (select v.user_id, 'x' as name, 21600 as tol, a, coalesce(b, []) as b from v left join c using (user_id)),
    r(user_id, i, j, d) as (select user_id, 1, 1, null::double from l union all
        select user_id, case when near or x < y then i + 1 else i end, case when near or x >= y then j + 1 else j end, case when near then y - x end
        from (select r.user_id, i, j, a[i] as x, b[j] as y, abs(a[i] - b[j]) <= tol as near from r join l using (user_id) where i <= len(a) and j <= len(b))),
    g as (select user_id, 'class ' || (user_id % 3) as label, len(a) as refs, len(b) as ests from l), q as (select label, d from r join g using (user_id) where d is not null),
    n as (select coalesce(label, 'ALL') as label, sum(refs) as refs, sum(ests) as ests from g group by rollup (label) having sum(refs) is not null), h as (select coalesce(label, 'ALL') as label, count(*) as hits, median(d) as off from q group by rollup (label)),
    s as (select label, refs, ests, coalesce(hits, 0) / greatest(ests, 1) as p, coalesce(hits, 0) / refs as r, off from n left join h using (label))
    select label, refs::bigint as refs, ests::bigint as ests, round(p, 6) as precision, round(r, 6) as recall, round(2 * p * r / greatest(p + r, 1e-9), 6) as f, round(off, 3) as offset from s""")
def a25_onset_scores(spark, d):
    """Onsets by class of user, and of all: users with ten views and more."""
    e = events(spark, d).select("user_id", "t", "event_type", F.concat(F.lit("class "), F.col("user_id") % 3).alias("label"))
    s = Z.onset_scores(kind(e, "view"), kind(e, "click"), KEY, "label", "t", 6 * HOUR, DAY)
    return s.select("label", "refs", "ests", *[r6(c).alias(c) for c in ("precision", "recall", "f")], r6("offset", 3).alias("offset"))
