"""Signal operators against numpy: frames over block edges, reflection, bands, chords and boundaries of made signals."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tactus.operators import signal as G

N, HOP, WIN = 203, 5, 16


def wave(n=N):
    return np.sin(np.arange(n) * 0.7) + np.arange(n) % 7


def table(spark, x):
    return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k int, idx long, value double")


@pytest.mark.parametrize("block", [20, 65_536])
@pytest.mark.parametrize("pad", ["zero", "reflect", "none", "open"])
def test_frames_equal_numpy(spark, monkeypatch, block, pad):
    monkeypatch.setattr(G, "BLOCK_SAMPLES", block)
    x = wave()
    got = {r.frame: r.x for r in G.frames(G.blocks(table(spark, x), ["k"], "value", HOP, WIN, pad), ["k"], HOP, WIN).collect()}
    if pad == "none":
        full, n = x, 1 + (N - WIN) // HOP
    elif pad == "open":
        full, n = np.pad(x, (0, WIN), constant_values=np.nan), -(-N // HOP)
    else:
        full, n = np.pad(x, WIN // 2, "reflect" if pad == "reflect" else "constant"), -(-N // HOP)
    assert sorted(got) == list(range(n))
    for k in range(n):
        np.testing.assert_allclose(got[k], full[k * HOP : k * HOP + WIN])


def test_short_and_empty_signals(spark):
    short = G.blocks(table(spark, [1.0, 2.0]), ["k"], "value", HOP, WIN, "reflect")
    assert [len(r.x) for r in G.frames(short, ["k"], HOP, WIN).collect()] == [WIN]
    assert G.frames(G.blocks(table(spark, [1.0]), ["k"], "value", HOP, WIN, "none"), ["k"], HOP, WIN).count() == 0
    empty = table(spark, [0.0]).where("k = 2")
    assert G.over_frames(G.blocks(empty, ["k"], "value", HOP, WIN), ["k"], HOP, WIN, G.magnitudes(WIN), "m").count() == 0


def test_timbre_equals_numpy(spark):
    x = wave()
    got = np.array([r.timbre for r in G.timbre(table(spark, x), ["k"], "value", 100.0, HOP, WIN, 4, 5.0, 50.0, 1).orderBy("frame").collect()])
    v = np.lib.stride_tricks.sliding_window_view(np.pad(x, WIN // 2, "reflect"), WIN)[::HOP][: len(got)]
    e = np.log(np.abs(np.fft.rfft(v * G.hann(WIN), axis=1)) @ G.triangles(G.htk_edges(4, 5.0, 50.0), 100.0, WIN) + 1e-6)
    smooth = np.array([e[max(0, k - 1) : k + 2].mean(axis=0) for k in range(len(e))])
    sd = smooth.std(axis=0)
    np.testing.assert_allclose(got, np.where(sd <= 1e-6, 0, (smooth - smooth.mean(axis=0)) / np.where(sd > 0, sd, 1)), atol=1e-6)


def test_constant_q_finds_a_tone(spark):
    rate, tone = 400.0, 12 + 7
    x = np.sin(2 * np.pi * 20 * 2 ** (tone / 12) * np.arange(800) / rate)
    win, made = G.constant_q(rate, 20.0, 3)
    rows = G.over_frames(G.blocks(table(spark, x), ["k"], "value", 100, win), ["k"], 100, win, made, "q").where("frame = 4").collect()
    assert int(np.argmax(rows[0].q)) == tone and abs(max(rows[0].q) - 1) < 0.05


def test_slaney_edges_are_linear_then_logarithmic():
    e = G.slaney_edges(128, 30.0, 11000.0)
    assert np.allclose(e[[0, -1]], [30, 11000]) and np.allclose(np.diff(e[e < 1000]), np.diff(e)[0])


def test_chords_of_clear_beats(spark):
    t = G.chord_templates()
    c, g = np.array(t[0]), np.array(t[14])
    rows = [(1, i, v.tolist()) for i, v in enumerate([c, c, c, (c + g) / 2, g, g, g, g])]
    pcs = spark.createDataFrame(rows, "k int, frame long, chroma array<double>")
    beats = spark.createDataFrame([(1, i, i) for i in range(8)], "k int, frame long, beat long")
    found = G.chords(pcs, beats, ["k"], "frame", "frame", "beat", F.floor(F.col("_t") / 4), 0.9).orderBy("first").collect()
    assert [r.chord for r in found] == ["C:maj", "G:maj"]
    assert found[0]["first"] == 0 and found[-1]["last"] == 7


def test_silence_has_no_chord(spark):
    pcs = spark.createDataFrame([(1, i, [0.0] * 12) for i in range(4)], "k int, frame long, chroma array<double>")
    beats = spark.createDataFrame([(1, i, i) for i in range(4)], "k int, frame long, beat long")
    found = G.chords(pcs, beats, ["k"], "frame", "frame", "beat", F.floor(F.col("_t") / 4), 0.9).collect()
    assert [(r.chord, r["first"], r["last"]) for r in found] == [("N", 0, 3)]


def test_boundaries_of_three_parts(spark):
    rows = [(1, i, [1.0 if p == (i // 60) * 4 else 0.01 for p in range(12)]) for i in range(180)]
    pcs = spark.createDataFrame(rows, "k int, frame long, chroma array<double>")
    at = sorted(r.frame for r in G.boundaries(pcs, ["k"], "chroma", 16, 0.5, 24).collect())
    assert len(at) == 2 and abs(at[0] - 60) <= 1 and abs(at[1] - 120) <= 1


def test_a_steady_pulse_has_its_tempo(spark):
    x = [1.0 if i % 20 == 0 else 0.0 for i in range(800)]
    tempi = G.tempo_grid()
    best = G.tempo_candidates(G.tempogram(table(spark, x), ["k"], "value", 40.0, tempi=tempi, idx="idx"), ["k"], tempi).where("place = 1").collect()[0]
    assert abs(best.bpm - 120) < 2
