"""Queries of rules and predicates, and of MIDI events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tactus.functions import rules as R
from tactus.plans.series_queries import r6
from tactus.plans.table_queries import tb
from tactus.sources import midi as M

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


@query("select event_id, value as l, case when event_type = 'purchase' then value else value / 2 end as r from events")
def p03_two_channels(spark, d):
    """Purchases have one channel, others two."""
    v = F.col("value")
    frames = F.array(F.when(F.col("event_type") == "purchase", F.array(v)).otherwise(F.array(v, v / 2)))
    x = F.get(R.two_channels(frames), F.lit(0))
    return tb(spark, d, "events").select("event_id", F.get(x, F.lit(0)).alias("l"), F.get(x, F.lit(1)).alias("r"))


@query("select user_id, count(*) as n from events where value >= 20 and value < 40 group by user_id")
def p05_half_open(spark, d):
    return tb(spark, d, "events").where(R.half_open(F.col("value"), 20, 40)).groupBy("user_id").agg(F.count("*").alias("n"))


@query("select c_custkey, case when c_acctbal < 0 then (c_mktsegment in ('BUILDING', 'MACHINERY'))::int else 1 end as known from customer")
def p11_known_targets(spark, d):
    known = R.known_target(F.col("c_mktsegment"), F.col("c_acctbal") < 0, ["BUILDING", "MACHINERY"])
    return tb(spark, d, "customer").select("c_custkey", known.cast("int").alias("known"))


@query("select c_custkey, case when c_mktsegment in ('BUILDING', 'MACHINERY') then c_mktsegment end as label from customer")
def p15_checked_labels(spark, d):
    names = ["BUILDING", "MACHINERY"]
    label = F.when(F.col("c_mktsegment").isin(*names), F.col("c_mktsegment"))
    return tb(spark, d, "customer").select("c_custkey", R.checked_label(label, names).alias("label"))


@query("select l_returnflag, count(*) as n from lineitem where l_discount >= 0.05 group by l_returnflag")
def p16_candidates(spark, d):
    return tb(spark, d, "lineitem").where(R.candidate(F.col("l_discount"))).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("select event_id, value > 0 and value between 40 and 70 as usable from events")
def p18_usable_tempos(spark, d):
    return tb(spark, d, "events").select("event_id", R.usable_tempo(F.col("value"), 40, 70).alias("usable"))


@query("""with f as (select c_nationkey, min(c_custkey) as file from customer where c_acctbal > 9000 group by c_nationkey), m as (select s_nationkey, min(s_suppkey) as midi from supplier group by s_nationkey)
    select n_nationkey, n_name, file, midi from nation join m on s_nationkey = n_nationkey left join f on c_nationkey = n_nationkey""")
def j14_entries(spark, d):
    """Nations that have a supplier, with one if there is a customer of a large balance."""
    files = tb(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_custkey").alias("file"))
    midi = tb(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_suppkey").alias("midi"))
    return tb(spark, d, "nation").select("n_nationkey", "n_name").join(midi, "n_nationkey").join(files, "n_nationkey", "left").select("n_nationkey", "n_name", "file", "midi")


@query("select s_suppkey, v.version, r.rule, round(case r.rule when 'hard' then case when s_acctbal > 1000 * v.version then s_acctbal else 0 end else s_acctbal / v.version end, 4) as level from supplier, (values (1), (2), (3), (4)) v(version), (values ('hard'), ('soft')) r(rule)")
def j23_versions_by_rules(spark, d):
    s = R.with_settings(tb(spark, d, "supplier").select("s_suppkey", "s_acctbal"), version=[1, 2, 3, 4], rule=["hard", "soft"])
    a, v = F.col("s_acctbal"), F.col("version")
    level = F.when(F.col("rule") == "hard", F.when(a > 1000 * v, a).otherwise(0.0)).otherwise(a / v)
    return s.select("s_suppkey", "version", "rule", r6(level, 4).alias("level"))


@query("select p_partkey, case when starts_with(lower(p_type), 'standard') then 'Plain' when contains(lower(p_type), 'brass') then 'Brass' when starts_with(lower(p_type), 'promo') then 'Promo' end as class from part")
def f18_class_by_name(spark, d):
    rules = (("Plain", "start", "standard"), ("Brass", "part", "brass"), ("Promo", "start", "promo"))
    return tb(spark, d, "part").select("p_partkey", R.class_by_name(F.col("p_type"), rules).alias("class"))


@query("""with w as (select p_partkey, regexp_extract(lower('Mix_no_' || p_type), '(?:^|[_ ])no[_ ]([a-z]+)', 1) as w from part),
    x as (select p_partkey, unnest(['Standard 1', 'Standard 2', 'Promotion', 'Large', 'economy']) as part, generate_subscripts(['Standard 1', 'Standard 2', 'Promotion', 'Large', 'economy'], 1) as k, w from w)
    select w.p_partkey, string_agg(part, ',' order by k) as missing from w left join x on x.p_partkey = w.p_partkey and contains(lower(part), left(w.w, 4)) group by w.p_partkey""")
def f19_missing_parts(spark, d):
    parts = F.array(*[F.lit(x) for x in ("Standard 1", "Standard 2", "Promotion", "Large", "economy")])
    found = R.missing_by_name(F.concat(F.lit("Mix_no_"), F.col("p_type")), parts)
    return tb(spark, d, "part").select("p_partkey", F.array_join(found, ",").alias("missing"))


@query("""with s as (select l_orderkey, l_returnflag as name, case when sum(l_quantity) > 60 then 'present' when sum(l_quantity) > 20 then 'maybe' else 'absent' end as state from lineitem group by all)
    select l_orderkey, case when count(*) filter (state = 'present') = 1 and count(*) filter (state = 'maybe') = 0 then max(name) filter (state = 'present') end as source from s group by l_orderkey""")
def f21_single_source(spark, d):
    """The returnflag of an order's large amount, if its others are small. An order has three flags at most."""
    q = F.sum("l_quantity")
    s = tb(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("name")).agg(F.when(q > 60, "present").when(q > 20, "maybe").otherwise("absent").alias("state"))
    return s.groupBy("l_orderkey").agg(R.single_source(F.collect_list(F.struct("name", "state"))).alias("source"))


@query("select case when c_acctbal < 0 then c_custkey || '|ERROR' else c_custkey || '|' || c_mktsegment || '|' || floor(c_acctbal)::bigint end as line from customer")
def k19_comparison_lines(spark, d):
    fields = [F.col("c_custkey"), F.col("c_mktsegment"), F.floor("c_acctbal")]
    return tb(spark, d, "customer").select(R.comparison_line(fields, F.col("c_acctbal") < 0).alias("line"))


#: Order of an order's lines, and their bytes: a meter and a tempo, 100 ticks later a note.
_LINES = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def order_files(spark, d):
    """(file, content): a MIDI file for each order, with 24 ticks to a quarter. A line's amount is the time since the last note."""
    byte = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    meter = F.concat(byte(F.col("l_quantity")), F.lit("FF5804"), byte(2 + F.col("l_linenumber") % 3), byte(2 + F.col("l_linenumber") % 2), F.lit("1808"))
    tempo = F.concat(F.lit("00FF5103"), F.lpad(F.hex(F.col("l_extendedprice").cast("long")), 6, "0"))
    note = F.concat(F.lit("6490"), byte(60 + F.col("l_linenumber")), F.lit("40"))
    lines = tb(spark, d, "lineitem").select("l_orderkey", *_LINES, F.concat(meter, tempo, note).alias("code"))
    body = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*_LINES, "code"))), lambda s: s["code"]), ""), F.lit("00FF2F00"))
    files = lines.groupBy("l_orderkey").agg(body.alias("body"))
    size = F.lpad(F.hex(F.expr("length(body) div 2")), 8, "0")
    return files.select(F.col("l_orderkey").cast("string").alias("file"), F.unhex(F.concat(F.lit("4D546864000000060000000100184D54726B"), size, F.col("body"))).alias("content"))


_NOTES = """with l as (select l_orderkey, l_linenumber, l_quantity::bigint as q, floor(l_extendedprice)::bigint as tempo, 2 + l_linenumber % 3 as nn, 2 + l_linenumber % 2 as dd, row_number() over w as k, sum(l_quantity::bigint + 100) over w as tick
        from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity rows unbounded preceding)),
    p as (select *, lag(tick - 100, 1, 0) over w as was, lag(nn, 1, 4) over w as wn, lag(dd, 1, 2) over w as wd, lag(tempo, 1, 500000) over w as wt from l window w as (partition by l_orderkey order by k)),
    b as (select *, sum(ceil(((tick - 100 - was) * (1 << wd)) / (wn * 96.0))::bigint) over w as bar0, sum((tick - 100 - was) * wt) over w as scaled from p window w as (partition by l_orderkey order by k rows unbounded preceding))"""


@query(f"{_NOTES} select l_orderkey, (60 + l_linenumber)::bigint as note, tick::bigint as tick, ((scaled + 100 * tempo) // 24)::bigint as micros from b")
def s10_midi_notes(spark, d):
    """Notes of the orders' files with the times that the tempo map gives."""
    e = M.with_times(M.midi_events(order_files(spark, d), kinds=["note_on", "tempo"])).where("kind = 'note_on'")
    return e.select(F.col("file").cast("long").alias("l_orderkey"), F.get("values", F.lit(0)).cast("long").alias("note"), "tick", "micros")


@query(f"{_NOTES} select l_orderkey, tick::bigint as tick, (bar0 + (100 << dd) // (nn * 96) + 1)::bigint || ':' || ((100 << dd) % (nn * 96) // 96 + 1)::bigint || ':' || lpad(((100 << dd) % (nn * 96) % 96 * 100 // 96)::bigint::varchar, 2, '0') as bar from b")
def w29_meter_bars(spark, d):
    """Bars of the notes: a meter that changes inside a bar starts a new one."""
    e = M.with_bars(M.midi_events(order_files(spark, d), kinds=["note_on", "time_signature"])).where("kind = 'note_on'")
    return e.select(F.col("file").cast("long").alias("l_orderkey"), "tick", "bar")
