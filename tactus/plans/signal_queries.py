"""Queries on sampled signals: the events of a user, in order, are the samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tactus.functions import scalar as S
from tactus.operators import aggregates as A
from tactus.operators import scans as C
from tactus.operators import series as R
from tactus.operators import signal as G
from tactus.plans.series_queries import _E, KEY, events, indexed, r6
from tactus.sources.materialise import cut

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
HOP, WIN = 8, 16
#: A constant-Q of two octaves from 8 Hz at 64 samples a second.
RATE, LOW, OCTAVES, CQ_HOP = 64.0, 8.0, 2, 16
FPS, TEMPO_WIN, TEMPO_HOP, TEMPI = 10.0, 32, 8, G.tempo_grid(40.0, 240.0, 21)

_S = f"{_E}, s as (select user_id, event_id, us, value, row_number() over (partition by user_id order by us, event_id) - 1 as i, count(*) over (partition by user_id) as n from e)"
_FRAMES = f"{_S}, p as (select *, unnest(range((greatest(0, i - 7 + 7) // 8)::bigint, (i + 8) // 8 + 1)) as k from s), f as (select user_id, k, i + 8 - 8 * k as j, value from p where 8 * k < n and i + 8 - 8 * k between 0 and 15)"
_DFT = f"""{_FRAMES}, m as (select user_id, k as frame, b.b as bin, sqrt(pow(sum(value * (0.5 - 0.5 * cos(2 * pi() * j / 16)) * cos(2 * pi() * b.b * j / 16)), 2)
    + pow(sum(value * (0.5 - 0.5 * cos(2 * pi() * j / 16)) * sin(2 * pi() * b.b * j / 16)), 2)) as mag from f cross join range(0, 9) b(b) group by all)"""
_CQT = f"""{_S}, t as (select b, 8 * pow(2, b / 12.0) as hz, greatest(4, round(64 / (pow(2, 1 / 12.0) - 1) / (8 * pow(2, b / 12.0))))::bigint as w from range(0, 24) r(b)),
    c as (select distinct user_id, unnest(range(0, (n + 15) // 16)) as frame from s),
    q as (select c.user_id, c.frame, t.b, t.w, t.hz, s.value, s.i - c.frame * 16 + t.w // 2 as j from c cross join t join s on s.user_id = c.user_id and s.i between c.frame * 16 - t.w // 2 and c.frame * 16 - t.w // 2 + t.w - 1),
    m as (select user_id, frame, b, sqrt(pow(sum(value * (0.5 - 0.5 * cos(2 * pi() * j / w)) * cos(2 * pi() * hz * j / 64)), 2) + pow(sum(value * (0.5 - 0.5 * cos(2 * pi() * j / w)) * sin(2 * pi() * hz * j / 64)), 2)) / (any_value(w) / 4.0) as mag
        from q group by all),
    pc as (select user_id, frame, b % 12 as pc, sum(mag) as v from m group by all)"""
_RATIO = "v / case when sum(v) over (partition by user_id, frame) > 1e-9 then sum(v) over (partition by user_id, frame) else 1 end"
_KEYCHROMA = f"{_CQT}, sm as (select user_id, frame, pc, avg(v) over (partition by user_id, pc order by frame rows between 2 preceding and 2 following) as v from pc), ch as (select user_id, frame, pc, {_RATIO} as v from sm)"
_MEL = "mf as (select b, 700 * (pow(10, (2595 * log10(1 + 1 / 700.0) + (2595 * log10(1 + 32 / 700.0) - 2595 * log10(1 + 1 / 700.0)) * b / 7) / 2595) - 1) as hz from range(0, 8) r(b)), tri as (select x.b, k.k as bin, greatest(0, least((k.k * 4 - x.hz) / (y.hz - x.hz), (z.hz - k.k * 4) / (z.hz - y.hz))) as w from mf x join mf y on y.b = x.b + 1 join mf z on z.b = x.b + 2 cross join range(0, 9) k(k))"
_FLUX = f"{_DFT}, d as (select *, lag(mag) over (partition by user_id, bin order by frame) as p from m), fl as (select user_id, frame, coalesce(sum(greatest(0, mag - p)), 0) as v from d group by all)"
_GRAM = f"""{_S}, w as (select distinct user_id, unnest(range(0, n, 8)) as s0, n from s), v as (select user_id, s0, s0 // 8 as frame, least(32, n - s0) as c from w where n - s0 >= 4 and (s0 = 0 or s0 - 8 + 32 < n)),
    x as (select v.user_id, frame, c, s.i - s0 as i, s.value - avg(s.value) over (partition by v.user_id, frame) as y from v join s on s.user_id = v.user_id and s.i >= s0 and s.i < s0 + c),
    ac as (select a.user_id, a.frame, b.i - a.i as lag, sum(a.y * b.y) as r from x a join x b on a.user_id = b.user_id and a.frame = b.frame and b.i >= a.i and b.i - a.i <= 16 group by all),
    z as (select user_id, frame, r as r0 from ac where lag = 0), g as (select 40 + 10 * k as bpm, k, 600.0::double / (40 + 10 * k) as lag from range(0, 21) r(k)),
    tg as (select v.user_id, v.frame, g.k, g.bpm, case when floor(g.lag) + 2 <= v.c and z.r0 > 1e-12 then (coalesce(lo.r, 0) * (1 - (g.lag - floor(g.lag))) + coalesce(hi.r, 0) * (g.lag - floor(g.lag))) / z.r0 else 0 end as e
        from v cross join g join z using (user_id, frame) left join ac lo on lo.user_id = v.user_id and lo.frame = v.frame and lo.lag = floor(g.lag) left join ac hi on hi.user_id = v.user_id and hi.frame = v.frame and hi.lag = floor(g.lag) + 1)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def signal(spark, d):
    return indexed(events(spark, d).select("user_id", "event_id", "us", "t", "value"))


def spectra(spark, d):
    return G.over_frames(G.blocks(signal(spark, d), KEY, "value", HOP, WIN), KEY, HOP, WIN, G.magnitudes(WIN), "mag")


@query(f"with {_FRAMES} select user_id, k as frame, round(sum(value), 4) as total, round(sum(value * (j + 1)), 4) as moment from f group by all")
def w02_frames(spark, d):
    f = G.frames(G.blocks(signal(spark, d), KEY, "value", HOP, WIN), KEY, HOP, WIN)
    moment = F.aggregate(F.transform("x", lambda v, k: v * (k + 1)), F.lit(0.0), lambda s, v: s + v)
    return f.select("user_id", "frame", r6(S.total(F.col("x")), 4).alias("total"), r6(moment, 4).alias("moment"))


@query(f"with {_DFT} select user_id, frame, bin, round(mag, 4) as mag from m")
def w03_spectrum(spark, d):
    return spectra(spark, d).select("user_id", "frame", F.posexplode("mag").alias("b", "m")).select("user_id", "frame", F.col("b").cast("long").alias("bin"), r6("m", 4).alias("mag"))


@query(f"with {_CQT}, g as (select c.user_id, c.frame, r.b from c cross join range(0, 24) r(b)) select g.user_id, g.frame, g.b as tone, round(coalesce(m.mag, 0), 4) as mag from g left join m using (user_id, frame, b)")
def w04_constant_q(spark, d):
    win, made = G.constant_q(RATE, LOW, OCTAVES)
    q = G.over_frames(G.blocks(signal(spark, d), KEY, "value", CQ_HOP, win), KEY, CQ_HOP, win, made, "q")
    return q.select("user_id", "frame", F.posexplode("q").alias("b", "m")).select("user_id", "frame", F.col("b").cast("long").alias("tone"), r6("m", 4).alias("mag"))


@query(f"with {_KEYCHROMA} select user_id, frame, pc, round(v, 5) as v from ch")
def w09_key_chroma(spark, d):
    c = G.chroma(signal(spark, d), KEY, "value", RATE, CQ_HOP, OCTAVES, LOW, radius=2, pad="zero")
    return c.select("user_id", "frame", F.posexplode("chroma").alias("p", "x")).select("user_id", "frame", F.col("p").cast("long").alias("pc"), r6("x", 5).alias("v"))


@query(f"""with {_CQT}, x as (select a.user_id, a.frame, a.pc, greatest(0, a.v - 0.6 * f.v - 0.3 * t.v) as v from pc a join pc f on f.user_id = a.user_id and f.frame = a.frame and f.pc = (a.pc + 5) % 12
    join pc t on t.user_id = a.user_id and t.frame = a.frame and t.pc = (a.pc + 8) % 12) select user_id, frame, pc, round({_RATIO}, 5) as v from x""")
def w06_chord_chroma(spark, d):
    c = G.chroma(signal(spark, d), KEY, "value", RATE, CQ_HOP, OCTAVES, LOW, suppressed=True, pad="zero")
    return c.select("user_id", "frame", F.posexplode("chroma").alias("p", "x")).select("user_id", "frame", F.col("p").cast("long").alias("pc"), r6("x", 5).alias("v"))


@query(f"with {_DFT}, {_MEL} select user_id, frame, b as band, round(ln(1 + sum(mag * w)), 4) as energy from m join tri using (bin) group by all")
def w10_mel_bands(spark, d):
    made = G.bands(WIN, G.triangles(G.htk_edges(6, 1.0, 32.0), RATE, WIN))
    e = G.over_frames(G.blocks(signal(spark, d), KEY, "value", HOP, WIN), KEY, HOP, WIN, made, "e")
    return e.select("user_id", "frame", F.posexplode("e").alias("b", "x")).select("user_id", "frame", F.col("b").cast("long").alias("band"), r6("x", 4).alias("energy"))


@query()
def w10_timbre(spark, d):
    t = G.timbre(signal(spark, d), KEY, "value", RATE, HOP, WIN, 6, 1.0, 32.0, 2)
    return t.select("user_id", "frame", F.transform("timbre", lambda x: F.round(x, 5)).alias("timbre"))


@query(f"with {_FLUX} select user_id, frame, round(v / case when max(v) over (partition by user_id) > 1e-9 then max(v) over (partition by user_id) else 1 end, 5) as activation from fl")
def w16_activation(spark, d):
    return G.relative_to_top(G.flux(spectra(spark, d), KEY, "mag"), KEY, "flux").select("user_id", "frame", r6("flux", 5).alias("activation"))


@query(f"""with {_DFT}, d as (select *, lag(mag) over (partition by user_id, bin order by frame) as p from m), q as (select *, greatest(p, coalesce(lag(p) over (partition by user_id, frame order by bin), 0), coalesce(lead(p) over (partition by user_id, frame order by bin), 0)) as top from d)
    select user_id, frame, round(coalesce(sum(case when p is not null then greatest(0, mag - top) end), 0), 4) as flux from q group by all""")
def w34_wide_flux(spark, d):
    return G.flux(spectra(spark, d), KEY, "mag", wide=True).select("user_id", "frame", r6("flux", 4).alias("flux"))


@query(f"with {_GRAM} select user_id, frame, bpm::double as bpm, round(e, 5) as energy from tg")
def w20_tempogram(spark, d):
    g = G.tempogram(signal(spark, d), KEY, "value", FPS, TEMPO_WIN, TEMPO_HOP, TEMPI, "idx")
    bpm = F.get(F.array(*[F.lit(t) for t in TEMPI]), F.col("k"))
    return g.select("user_id", "frame", F.posexplode("energy").alias("k", "e")).select("user_id", "frame", bpm.alias("bpm"), r6("e", 5).alias("energy"))


@query(f"""with {_GRAM}, en as (select user_id, k, bpm::double as bpm, avg(greatest(e, 0)) as e, exp(-0.5 * pow(ln(bpm / 120.0) / 0.7, 2)) as prior from tg group by all),
    best as (select * from (select *, row_number() over (partition by user_id order by e * prior desc, bpm desc) as o from en) where o = 1),
    near as (select b.user_id, m.m, en.bpm, en.e, en.prior, row_number() over (partition by b.user_id, m.m order by en.e desc, en.bpm) as o from best b cross join (values (2.0::double), (0.5)) m(m)
        join en on en.user_id = b.user_id and abs(en.bpm - b.bpm * m.m) <= greatest(b.bpm * m.m * 0.08, 1) where b.bpm * m.m between 40 and 240),
    fd as (select user_id, bpm, e, prior from best union all select user_id, bpm, e, prior from near where o = 1), wt as (select user_id, bpm, greatest(e, 1e-6) * prior as w from fd)
    select user_id, row_number() over (partition by user_id order by w desc, bpm) as place, bpm, round(w / sum(w) over (partition by user_id), 4) as weight from wt""")
def a08_tempo_candidates(spark, d):
    g = G.tempogram(signal(spark, d), KEY, "value", FPS, TEMPO_WIN, TEMPO_HOP, TEMPI, "idx")
    return G.tempo_candidates(g, KEY, TEMPI).select("user_id", "place", "bpm", r6("weight", 4).alias("weight"))


@query(f"""with {_KEYCHROMA}, mc as (select user_id, pc, avg(v) as v from ch group by all), pr(minor, base) as (values (false, {list(S.MAJOR_PROFILE)}::double[]), (true, {list(S.MINOR_PROFILE)}::double[])),
    co as (select user_id, t.t as tonic, minor, coalesce(corr(v, base[((pc - t.t + 12) % 12) + 1]), 0) as r from mc cross join pr cross join range(0, 12) t(t) group by all), o as (select *, row_number() over (partition by user_id order by r desc, tonic, minor) as place from co)
    select user_id, place, tonic::int as tonic, minor, round((r + 1) / 2, 4) as confidence from o where place <= 3""")
def m04_key(spark, d):
    """Samples to chroma to the best three keys."""
    c = G.chroma(signal(spark, d), KEY, "value", RATE, CQ_HOP, OCTAVES, LOW, radius=2, pad="zero")
    return G.top_keys(c, KEY).select("user_id", "place", "tonic", "minor", r6("confidence", 4).alias("confidence"))


@query()
def m05_chords(spark, d):
    """Samples to chroma, beats of every second frame, chord events."""
    c = cut(G.chroma(signal(spark, d), KEY, "value", RATE, HOP, OCTAVES, LOW, suppressed=True, pad="reflect"), "chroma")
    beats = c.where("frame % 2 = 0").select("user_id", "frame", (F.col("frame") / 2).cast("long").alias("beat"))
    return G.chords(c, beats, KEY, "frame", "frame", "beat", F.floor(F.col("_t") / 4096), 0.9).select("user_id", "first", "last", "chord", r6("confidence", 5).alias("confidence"))


@query()
def m06_structure(spark, d):
    """Samples to chroma and timbre, novelty of both, sections from boundary to boundary."""
    s = cut(signal(spark, d), "signal")
    c = cut(G.chroma(s, KEY, "value", RATE, 2, OCTAVES, LOW, radius=1), "chroma")
    t = G.timbre(s, KEY, "value", RATE, 2, WIN, 6, 1.0, 32.0, 1).withColumnRenamed("timbre", "chroma")
    cuts = cut(G.boundaries(c, KEY, "chroma", half=4, rise=0.5, distance=4, also=t).select("user_id", "frame"), "boundaries")
    ends = c.groupBy("user_id").agg(F.max("frame").alias("b")).select("user_id", F.explode(F.array(F.lit(0).cast("long"), "b")).alias("frame"))
    places = R.index_rows(cuts.unionByName(ends).distinct(), KEY, ["frame"], F.floor(F.col("frame") / 4096))
    tiles = R.carry(places, KEY, ["frame"], F.floor(F.col("frame") / 4096), {"end": F.col("frame")}, ahead=True).where("end is not null")
    return tiles.select("user_id", F.col("frame").alias("first"), "end", S.section_letter(F.col("idx")).alias("label"))


@query()
def m03_beats(spark, d):
    """Samples to activation, collapsed peaks, a beat that follows the best tempo, and its statistics."""
    act = cut(G.relative_to_top(G.flux(spectra(spark, d), KEY, "mag"), KEY, "flux"), "activation")
    peaks = R.peaks(act, KEY, "flux", 0.15, "frame").select("user_id", ((F.col("frame") + F.col("shift")) / FPS).alias("t"), "flux")
    kept = C.collapse_gaps(peaks, KEY, "t", "flux", 0.15, F.floor(F.col("_t") / 60))
    best = G.tempo_candidates(G.tempogram(act, KEY, "flux", FPS, TEMPO_WIN, TEMPO_HOP, TEMPI), KEY, TEMPI).where("place = 1")
    beats = C.follow_tempo(kept.join(best.select("user_id", (60.0 / F.col("bpm")).alias("period")), "user_id"), KEY, "t", "flux", "period").withColumn("tie", F.lit(0))
    stats = A.tempo_stats(cut(beats, "beats"), KEY, "t", "tie", F.floor(F.col("t") / 60))
    return stats.select("user_id", "beats", r6("bpm", 4).alias("bpm"), r6("mad_ms", 3).alias("mad_ms"), "stability")


@query(f"with {_S} select user_id, (any_value(n) * 3 // 4)::bigint as samples from s group by user_id")
def w42_resampled_lengths(spark, d):
    return G.resampled(signal(spark, d), KEY, "value", 4, 3, 4).groupBy("user_id").agg(F.count("*").alias("samples"))


@query(f"""with {_S}, x as (select user_id, i, n, value, unnest(range(greatest(0, ceil((i - 8) / 2.0))::bigint, floor((i + 8) / 2.0)::bigint + 1)) as k from s), o as (select user_id, k, value, k * 2.0 - i as u from x where k < n // 2),
    w as (select user_id, k, value, (case when abs(u) < 1e-12 then 1 else sin(pi() * 0.5 * u) / (pi() * 0.5 * u) end) * (0.5 + 0.5 * cos(pi() * u / 8)) as w from o)
    select user_id, k as idx, round(sum(w * value) / sum(w), 5) as value from w group by all""")
def w42_resample(spark, d):
    return G.resampled(signal(spark, d), KEY, "value", 2, 1, 4).select("user_id", "idx", r6("value", 5).alias("value"))
