"""Queries of reference beats and sections from MIDI files, of written tempo maps, and of training histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tactus.plans.series_queries import r6
from tactus.plans.table_queries import tb
from tactus.sources import midi as M
from tactus.sources import runs as H
from tactus.sources.materialise import cut

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def song_files(spark, d):
    """(file, content): a MIDI file for each customer, with 24 ticks to a quarter. Each order sets meter, tempo and marker, 60 ticks later a note."""
    byte = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    o = tb(spark, d, "orders")
    delta, kind = 24 + F.col("o_orderkey") % 97, F.col("o_orderkey") % 4
    meter = F.concat(byte(delta), F.lit("FF5804"), byte(F.get(F.array(F.lit(3), F.lit(4), F.lit(6), F.lit(12)), kind)), byte(F.when(kind < 2, 2).otherwise(3)), F.lit("1808"))
    tempo = F.concat(F.lit("00FF5103"), F.lpad(F.hex(300_000 + F.col("o_orderkey") % 400_000), 6, "0"))
    marker = F.concat(F.lit("00FF06"), byte(F.octet_length("o_orderpriority")), F.hex("o_orderpriority"))
    code = F.concat(meter, tempo, marker, F.lit("3C903C40"))
    lines = o.select("o_custkey", "o_orderdate", "o_orderkey", code.alias("code"))
    body = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "code"))), lambda s: s["code"]), ""), F.lit("00FF2F00"))
    files = lines.groupBy("o_custkey").agg(body.alias("body"))
    size = F.lpad(F.hex(F.expr("length(body) div 2")), 8, "0")
    return files.select(F.col("o_custkey").cast("string").alias("file"), F.unhex(F.concat(F.lit("4D546864000000060000000100184D54726B"), size, F.col("body"))).alias("content"))


_SONGS = """with recursive o as (select o_custkey as c, row_number() over w as k, sum(84 + o_orderkey % 97) over w - 60 as tick, 300000 + o_orderkey % 400000 as tempo, o_orderpriority as name,
        [3, 4, 2, 4][1 + o_orderkey % 4] as per_bar, case when o_orderkey % 4 < 2 then 24 else 36 end as step from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding)),
    g(c, k, start, per_bar, step) as (select c, 1::bigint, 0::bigint, per_bar, step from o where k = 1 union all
        select o.c, o.k, (g.start + greatest(0, ceil((o.tick - g.start) / g.step::double)) * g.step)::bigint, o.per_bar, o.step from g join o on o.c = g.c and o.k = g.k + 1),
    l as (select c, max(tick) + 60 as last from o group by c),
    r as (select g.*, least(coalesce(lead(start) over (partition by c order by k), last + 1), last + 1)::bigint as fin from g join l using (c)),
    b as (select c, k, unnest(range(start, fin, step::bigint)) as tick, start, step, per_bar from r where start < fin),
    i as (select c, row_number() over (partition by c order by tick) - 1 as beat, tick::bigint as tick, ((tick - start) // step) % per_bar + 1 as bar_beat from b),
    t as (select c, tick, tempo, sum((tick - was) * held) over (partition by c order by k rows unbounded preceding) as scaled from (select *, lag(tick, 1, 0) over (partition by c order by k) as was, lag(tempo, 1, 500000) over (partition by c order by k) as held from o)
        union all select distinct c, 0, 500000, 0 from o),
    s as (select i.*, ((t.scaled + (i.tick - t.tick) * t.tempo) // 24)::bigint as micros, t.tempo from i asof join t on i.c = t.c and i.tick >= t.tick)"""


@query(f"{_SONGS} select c as o_custkey, beat, tick, bar_beat::bigint as bar_beat, micros, round(60e6 / tempo, 6) as bpm from s")
def w31_midi_beats(spark, d):
    """Beats of the customers' files: compound meters, changes between beats, tempos that change."""
    b = M.reference_beats(M.midi_events(song_files(spark, d), kinds=["note_on", "time_signature", "tempo"]))
    return b.select(F.col("file").cast("long").alias("o_custkey"), "beat", "tick", "bar_beat", "micros", r6("bpm").alias("bpm"))


@query(f"""{_SONGS}, e as (select c, list(micros order by beat) as g from s group by c having count(*) > 1),
    m as (select o.c, o.k, o.name, (t.scaled // 24)::bigint as start from o join t on t.c = o.c and t.tick = o.tick union all select distinct c, 0, 'Intro', 0 from o),
    x as (select c, name, start, lead(start) over (partition by c order by k) as nx from m)
    select x.c as o_custkey, name, start, coalesce(nx, 2 * g[-1] - g[-2])::bigint as end from x join e using (c) where len(list_filter(g, lambda b: start <= b and b < coalesce(nx, 2 * g[-1] - g[-2]))) > 0""")
def w31_sections(spark, d):
    e = M.midi_events(song_files(spark, d), kinds=["note_on", "time_signature", "tempo", "marker"])
    e = cut(e.select("file", "division", "track", "place", "tick", "kind", "values", "text"), "events")
    return M.marked_sections(e, M.reference_beats(e)).select(F.col("file").cast("long").alias("o_custkey"), "name", "start", "end")


@query("""with o as (select o_custkey, o_orderkey, date_diff('day', date '1992-01-01', o_orderdate)::double as t, (30 + o_totalprice / 1000)::double as b from orders),
    g as (select *, round(greatest(0, t - lag(t, 1, 0) over w) * coalesce(lag(b) over w, b) * 480 / 60)::bigint as n, greatest(1, least(16777215, round(60000000 / b)))::bigint as m from o window w as (partition by o_custkey order by t, b)),
    c as (select o_custkey, t, b, (case when n >= 2097152 then lpad(hex((n >> 21) & 127 | 128), 2, '0') else '' end) || (case when n >= 16384 then lpad(hex((n >> 14) & 127 | 128), 2, '0') else '' end)
        || (case when n >= 128 then lpad(hex((n >> 7) & 127 | 128), 2, '0') else '' end) || lpad(hex(n & 127), 2, '0') || 'FF5103' || lpad(hex(m), 6, '0') as code from g),
    f as (select o_custkey, string_agg(code, '' order by t, b) || '00FF2F00' as body from c group by o_custkey)
    select o_custkey, '4D54686400000006' || '0000000101E0' || '4D54726B' || lpad(hex(len(body) // 2), 8, '0') || body as content from f""")
def k05_tempo_tracks(spark, d):
    """A tempo map of each customer's orders: days are seconds, prices set the tempo."""
    o = tb(spark, d, "orders").select("o_custkey", F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).alias("t"), (30 + F.col("o_totalprice") / 1000).alias("b"))
    return M.tempo_tracks(o, "o_custkey", "t", "b").select("o_custkey", F.hex("content").alias("content"))


# --- histories ---


def run_files(spark, d):
    """(file, content): a training history for each customer with an epoch for each order; even customers name data sets, of every tenth the text is broken off."""
    o = tb(spark, d, "orders")
    score = lambda sign: F.struct(
        F.struct((sign * F.col("o_totalprice") / 1000).alias("drums"), (F.col("o_orderkey") % 3).cast("double").alias("bass")).alias("si_sdr_improvement"),
        F.when(F.col("o_custkey") % 2 == 0, F.struct((F.col("o_orderkey") % 5).alias("drums"))).alias("examples"), (sign * F.col("o_totalprice")).alias("mean_si_sdr_improvement"),
        F.when(F.col("o_orderkey") % 7 > 0, F.struct((F.col("o_totalprice") / 10).alias("si_sdr_improvement"))).alias("group"),
    )
    plain = F.struct(F.col("o_orderkey").alias("epoch"), F.lit(0.5).alias("train_loss"), *[score(1)[c].alias(c) for c in ("si_sdr_improvement", "examples", "mean_si_sdr_improvement", "group")])
    named = F.struct(F.col("o_orderkey").alias("epoch"), F.lit(0.5).alias("train_loss"), F.struct(score(1).alias("a"), score(-1).alias("b")).alias("validation"))
    o = o.select("o_custkey", "o_orderdate", "o_orderkey", F.when(F.col("o_custkey") % 2 == 0, F.to_json(named)).otherwise(F.to_json(plain)).alias("h"))
    history = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "h"))), lambda x: x["h"]), ",")
    text = F.concat(F.lit('{"finished": true, "history": ['), F.col("_h"), F.when(F.col("o_custkey") % 10 == 7, "").otherwise("]}"))
    return o.groupBy("o_custkey").agg(history.alias("_h")).select(F.col("o_custkey").cast("string").alias("file"), text.alias("content"))


_RUNS = """with o as (select o_custkey as c, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as place, count(*) over (partition by o_custkey) as epochs, * from orders),
    x as (select *, unnest(case when c % 2 = 0 then ['a', 'b'] else ['val'] end) as dataset from o where c % 10 <> 7), y as (select *, unnest(['drums', 'bass']) as source from x),
    r as (select c, place, epochs, o_orderkey::int as epoch, dataset, source, case when source = 'bass' then (o_orderkey % 3)::double else (case when dataset = 'b' then -1 else 1 end) * o_totalprice / 1000 end as improvement,
        case when c % 2 = 0 and source = 'drums' then (o_orderkey % 5)::double else 1.0 end as examples, case when o_orderkey % 7 > 0 then o_totalprice / 10 end as grp from y)"""


@query(f"""{_RUNS} select c::varchar as file, place::int as place, epoch, dataset, source, round(improvement, 6) as improvement, examples, round(grp, 6) as "group", null::varchar as error from r
    union all select distinct o_custkey::varchar, null::int, null::int, null, null, null::double, null::double, null::double, 'not JSON' from orders where o_custkey % 10 = 7""")
def s29_run_history(spark, d):
    """Scores by epoch, data set and source of histories of two shapes; broken files as errors."""
    h = H.run_history(run_files(spark, d))
    return h.select("file", "place", "epoch", "dataset", "source", r6("improvement").alias("improvement"), "examples", r6("group").alias("group"), "error")


@query(f"""{_RUNS} select c::varchar as file, dataset, source, round(avg(improvement), 6) as improvement, min(examples) as examples, round(case when count(grp) = count(*) then avg(grp) end, 6) as "group" from r where place >= epochs - 3 group by all""")
def s29_last_epochs(spark, d):
    """The mean of the last three epochs of each history."""
    x = H.last_epochs(H.run_history(run_files(spark, d)))
    return x.select("file", "dataset", "source", r6("improvement").alias("improvement"), "examples", r6("group").alias("group"))


# --- descriptions ---


@query(f"""{_SONGS}, n as (select o_custkey as c, row_number() over w as k, o_orderkey, o_orderpriority as name, sum(84 + o_orderkey % 97) over w - 60 as tick from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding)),
    x as (select c, 4 * (k - 1) as place, (24 + o_orderkey % 97)::varchar || ' - TimeSignature(' || [3, 4, 6, 12][1 + o_orderkey % 4] || '/' || (case when o_orderkey % 4 < 2 then 4 else 8 end) || ')' as line from n
        union all select c, 4 * (k - 1) + 1, '0 - SetTempo(b=' || regexp_replace(printf('%.2f', 60000000.0::double / (300000 + o_orderkey % 400000)), '\\.?0+$', '') || ')' from n
        union all select c, 4 * (k - 1) + 2, '0 - marker(' || name || ')' from n union all select c, 4 * (k - 1) + 3, '60 - note_on(0, 60, 64)' from n
        union all select c, 4 * max(k), '0 - end_of_track()' from n group by c)
    select c as o_custkey, place::int as place, line from x""")
def k12_dump(spark, d):
    """The events of the customers' files as lines: ticks from one to the next, and what each says."""
    return M.dump_lines(M.midi_events(song_files(spark, d))).select(F.col("file").cast("long").alias("o_custkey"), "place", "line")
