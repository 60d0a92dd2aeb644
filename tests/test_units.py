"""Scores with a group as one unit by hand, mixes by their rules, reference beats and written tempo maps by plain walks."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tactus.operators import mixing as X
from tactus.operators import units as U
from tactus.sources import midi as M


def test_fold_and_expand(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [0.0, 0.0, 1.0, 0.0])], "x array<double>, p array<double>")
    units = U.fold(F.col("x"), 4, [1, 3])
    r = df.select(units.alias("u"), U.unit_presence(F.col("p"), 4, [1, 2]).alias("p"), U.expand(units, 4, [1, 3]).alias("e"), U.fold(F.col("x"), 4, None).alias("same")).first()
    assert r["u"] == [1.0, 3.0, 6.0] and r["p"] == [0.0, 0.0, 1.0] and r["e"] == [1.0, 6.0, 3.0, 6.0] and r["same"] == [1.0, 2.0, 3.0, 4.0]


def sdr(e, r, eps=1e-8):
    me, mr = sum(e) / len(e), sum(r) / len(r)
    e, r = [x - me for x in e], [x - mr for x in r]
    rr = max(sum(x * x for x in r), eps)
    a = sum(x * y for x, y in zip(e, r)) / rr
    t = sum((a * y) ** 2 for y in r)
    n = sum((x - a * y) ** 2 for x, y in zip(e, r))
    return 10 * math.log10((t + eps) / (n + eps))


def test_separation_with_a_group(spark):
    r = random.Random(1)
    ref = {i: [[r.uniform(-1, 1) * (1e-4 if (i, k) == (0, 1) else 0 if (i, k) == (1, 0) else 1) for _ in range(50)] for k in range(3)] for i in range(3)}
    est = {i: [[x + r.uniform(-0.3, 0.3) for x in ref[i][k]] for k in range(3)] for i in ref}
    rows = []
    for i in ref:
        known, mask = ([1, 1, 1], [0, 0, 0]) if i < 2 else ([1, 0, 0], [0, 1, 1])
        for t in range(50):
            rows.append((i, [est[i][k][t] for k in range(3)], [ref[i][k][t] for k in range(3)], sum(ref[i][k][t] for k in range(3)), known, mask, ref[i][1][t] + ref[i][2][t]))
    df = spark.createDataFrame(rows, "i int, est array<double>, ref array<double>, mix double, known array<int>, mask array<int>, both double").repartition(4)
    stats = U.unit_stats(df, ["i"], 3, "est", "ref", "mix", "known", "mask", "both")
    got = {x["unit"]: (x["si_sdr"], x["improvement"], x["examples"]) for x in U.separation_scores(stats, []).collect()}
    mix = {i: [sum(ref[i][k][t] for k in range(3)) for t in range(50)] for i in ref}
    want = {}
    for unit, items in ((0, [0, 2]), (1, [1]), (2, [0, 1])):  # item 0's second source and item 1's first are inaudible
        s = [sdr(est[i][unit], ref[i][unit]) for i in items]
        b = [sdr(mix[i], ref[i][unit]) for i in items]
        want[unit] = (sum(s) / len(s), sum(x - y for x, y in zip(s, b)) / len(s), len(s))
    e, g = ([sum(x) for x in zip(v[2][1], v[2][2])] for v in (est, ref))
    want[U.GROUP] = (sdr(e, g), sdr(e, g) - sdr(mix[2], g), 1)
    assert got.keys() == want.keys()
    for unit in want:
        assert got[unit] == pytest.approx(want[unit], abs=1e-6)
    loss = U.separation_loss(stats, [], "l1").first()
    l1 = lambda a, b: sum(abs(x - y) for x, y in zip(a, b)) / len(a)
    parts = [l1(est[i][k], ref[i][k]) for i in (0, 1) for k in range(3)] + [l1(est[2][0], ref[2][0]), l1(e, g)]
    assert loss["targets"] == 8 and loss["loss"] == pytest.approx(sum(parts) / 8)
    weighed = U.separation_loss(stats, [], "l1", 2.0, [1.0, 1.0, 3.0]).first()["loss"]  # silent: item 0's second source at -80 dB, item 1's first
    w = [1, 2, 3, 2, 1, 3, 1, 1]
    assert weighed == pytest.approx(sum(a * b for a, b in zip(w, parts)) / 8)
    with pytest.raises(ValueError):
        U.separation_loss(stats, [], "l2")
    empty = U.separation_scores(U.unit_stats(df.limit(0), ["i"], 3, "est", "ref", "mix", "known"), []).collect()
    assert empty == []


def test_presence_of_a_group(spark):
    rows = [([0.9, 0.4, 0.4], [1.0, 0.0, 1.0], [1.0, 1.0, 1.0], [0, 0, 0], None, 0.0), ([0.2, 0.3, 0.2], [1.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0, 1, 1], 1.0, 1.0)]
    df = spark.createDataFrame(rows, "p array<double>, t array<double>, w array<double>, g array<int>, gt double, gw double")
    s = {x["unit"]: x for x in U.presence_scores(df, [], 3, "p", "t", "w", [1, 2], "g", "gt").collect()}
    assert (s[0]["precision"], s[0]["recall"], s[0]["share"]) == (1.0, 0.5, 1.0)
    assert (s[2]["recall"], s[2]["f1"]) == (0.0, 0.0)
    assert (s[-1]["precision"], s[-1]["recall"]) == (1.0, 0.5)  # 1 - .6 * .6 > .5, 1 - .7 * .8 < .5
    assert U.mean_f1(U.presence_scores(df, [], 3, "p", "t", "w", [1, 2], "g", "gt"), []).first()["mean_f1"] == pytest.approx((2 / 3 + 0 + 0) / 3)
    z = lambda p: math.log(p / (1 - p))
    logits = df.withColumn("z", F.transform("p", lambda p: F.log(p / (1 - p))))
    got = U.presence_loss(logits, [], 3, "z", "t", "w", [1, 2], "gw").first()["loss"]
    bce = lambda p, t: -math.log(p if t else 1 - p)
    assert z(0.5) == 0 and got == pytest.approx((bce(0.9, 1) + bce(0.4, 0) + bce(0.4, 1) + bce(0.2, 1) - math.log(1 - 0.7 * 0.8)) / 5)


def test_donors_are_never_the_own_track_and_even(spark):
    items = spark.range(6000).selectExpr("id as item", "id % 5 as track")
    tracks = spark.range(5).selectExpr("id as track")
    make = lambda p, own: X.remix_donors(items, tracks, "item", "track", F.lit(0), 3, p, seed=1, own=own)
    rows = make(0.5, False).collect()
    assert sorted(rows) == sorted(make(0.5, False).collect()) and len(rows) == 18_000
    mixed = [r for r in rows if r["seed"] is not None]
    assert all(r["track"] == r["item"] % 5 for r in rows if r["seed"] is None)
    assert 0.47 < len(mixed) / len(rows) < 0.53 and all(r["track"] != r["item"] % 5 for r in mixed)
    for k in range(5):  # four others, each as often
        of = [r["track"] for r in mixed if r["item"] % 5 == k]
        assert all(abs(of.count(t) / len(of) - 0.25) < 0.03 for t in range(5) if t != k)
    everyone = [r["track"] for r in make(1.0, True).collect()]
    assert all(abs(everyone.count(t) / len(everyone) - 0.2) < 0.02 for t in range(5))
    # the probability moves no other draw
    some = {(r["item"], r["source"]): r["track"] for r in mixed}
    assert all(some.get((r["item"], r["source"]), r["track"]) == r["track"] for r in make(1.0, False).collect())
    one = X.remix_donors(items.where("track = 0"), tracks.where("track = 0"), "item", "track", F.lit(0), 2, 1.0, own=False)
    assert {r["track"] for r in one.collect()} == {0}


def song(meters, notes, tempos=(), markers=(), division=24):
    """A file's events as rows of the reader."""
    rows = [(t, 0, "time_signature", [n, p, 24, 8], None) for t, n, p in meters] + [(t, 1, "tempo", [u], None) for t, u in tempos] + [(t, 2, "marker", None, m) for t, m in markers] + [(t, 3, "note_on", [60, 64], None) for t in notes]
    return [("f", 0, division, 0, i, *x) for i, x in enumerate(sorted(rows, key=lambda x: (x[0], x[1])))]


def events_of(spark, rows):
    df = spark.createDataFrame([(f, fmt, d, tr, i, t, k, v, x) for f, fmt, d, tr, i, t, _, k, v, x in rows], "file string, format int, division int, track int, place int, tick long, kind string, values array<int>, text string")
    return df


def test_reference_beats_against_a_walk(spark):
    r = random.Random(2)
    for case in range(6):
        meters = sorted((r.randrange(0, 2000, r.choice([1, 24])), r.choice([2, 3, 4, 6, 7, 12]), r.choice([1, 2, 3])) for _ in range(r.randint(0, 6)))
        meters = list({t: (t, n, p) for t, n, p in meters}.values())
        notes = [r.randint(0, 2500) for _ in range(5)]
        want, tick, k, at = [], 0, 0, 0
        sigs = meters or [(0, 4, 2)]
        _, n, p = sigs[0]
        while tick <= max(notes):
            while k + 1 < len(sigs) and sigs[k + 1][0] <= tick:
                k, at = k + 1, 0
                _, n, p = sigs[k]
            per, step = (n // 3, 36) if p == 3 and n > 3 and n % 3 == 0 else (n, 24 * 4 // 2**p)
            want.append((tick, at + 1))
            at = (at + 1) % per
            tick += step
        got = M.reference_beats(events_of(spark, song(meters, notes))).orderBy("beat").collect()
        assert [(x["tick"], x["bar_beat"]) for x in got] == want, case
        assert [x["beat"] for x in got] == list(range(len(want))) and all(x["micros"] == x["tick"] * 500_000 // 24 and x["bpm"] == 120.0 for x in got)
    assert M.reference_beats(events_of(spark, song([(0, 4, 2)], [], [(0, 5)]))).count() == 0


def test_sections_and_the_intro(spark):
    e = events_of(spark, song([(0, 4, 2)], [24 * 20], [(0, 1_000_000)], [(48, "A"), (49, "sliver"), (50, "B"), (24 * 40, "late")]))
    got = [(x["name"], x["start"], x["end"]) for x in M.marked_sections(e, M.reference_beats(e)).orderBy("start").collect()]
    us = lambda t: t * 1_000_000 // 24
    assert got == [("Intro", 0, us(48)), ("A", us(48), us(49)), ("B", us(50), us(24 * 40))]
    e = events_of(spark, song([], [24 * 4]))
    assert [(x["name"], x["start"], x["end"]) for x in M.marked_sections(e, M.reference_beats(e)).collect()] == [("Intro", 0, 2_500_000)]


def test_tempo_tracks_are_read_back(spark):
    points = {"a": [(0.0, 120.0), (1.0, 90.0), (1.0, 100.0), (300.0, 33.333)], "b": [(2.0, 1.0)], "c": [(0.0, 1e9)], "d": [(-3.0, 60.0)]}
    df = spark.createDataFrame([(k, *p) for k, v in points.items() for p in v], "k string, t double, b double").repartition(3)
    files = M.tempo_tracks(df, "k", "t", "b").collect()
    for r in files:
        raw = bytes(r["content"])
        assert raw[:14] == b"MThd" + struct.pack(">IHHH", 6, 0, 1, 480) and struct.unpack(">I", raw[18:22])[0] == len(raw) - 22
    back = M.midi_events(spark.createDataFrame([(r["k"], bytes(r["content"])) for r in files], "file string, content binary"))
    got = {}
    for x in M.with_times(back).where("kind = 'tempo'").orderBy("tick", "place").collect():
        got.setdefault(x["file"], []).append((x["tick"], x["values"][0]))
    assert got["a"] == [(0, 500_000), (960, 666_667), (960, 600_000), (960 + 239_200, 1_800_018)]
    assert got["b"] == [(16, (1 << 24) - 1)] and got["c"][0][1] == 1 and got["d"] == [(0, 1_000_000)]
    for bad in (0.0, -1.0, float("nan"), None):
        with pytest.raises(Exception, match="no tempo"):
            M.tempo_tracks(spark.createDataFrame([("x", 0.0, bad)], "k string, t double, b double"), "k", "t", "b").collect()
    assert M.tempo_tracks(df.limit(0), "k", "t", "b").collect() == []
