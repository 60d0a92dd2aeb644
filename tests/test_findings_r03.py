"""Small tests of what failed, or would have, on larger tables."""

from tactus.plans.catalog import QUERIES


def test_best_worst_of_equal_means(spark, tmp_path):
    """0.1 + 0.2 + 0.3 differs from 0.3 + 0.2 + 0.1 in doubles; the means are equal all the same."""
    rows = [(1, f, x) for f, xs in (("A", (0.1, 0.2, 0.3)), ("N", (0.3, 0.2, 0.1)), ("R", (0.0, 0.1, 0.2))) for x in xs]
    rows += [(2, f, x) for f, xs in (("A", (0.1, 0.2, 0.3)), ("N", (0.3, 0.2, 0.1))) for x in xs] + [(3, "A", None)]
    spark.createDataFrame(rows, "l_suppkey long, l_returnflag string, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r[0], r[1]): r[2] for r in QUERIES["w44_best_worst"](spark, str(tmp_path)).collect()}
    assert got == {(1, "A"): "best", (1, "N"): "best", (1, "R"): "worst", (2, "A"): "", (2, "N"): "", (3, "A"): ""}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bars_take_files_apart_once(spark):
    assert plan_of(QUERIES["w29_meter_bars"](spark, "/root/testdata/sf0.001")).count("MapInArrow") == 1


def test_beats_take_files_apart_once(spark):
    assert plan_of(QUERIES["w31_midi_beats"](spark, "/root/testdata/sf0.001")).count("MapInArrow") == 1
    assert plan_of(QUERIES["w31_sections"](spark, "/root/testdata/sf0.001")).count("MapInArrow") == 0  # read back, written once


def test_bootstrap_compares_first_steps_in_compiled_code(spark):
    plan = plan_of(QUERIES["a27_bootstrap"](spark, "/root/testdata/sf0.001"))
    assert plan.count("THEN 7 ") == 1


def test_viterbi_of_keys_with_other_numbers_of_states(spark):
    from tactus.operators.block_scans import viterbi

    logs = {1: [[-1.0, -2.0], [-3.0, -0.5], [-0.1, -4.0], [-0.2, -4.0], [-9.0, -0.1]], 2: [[-1.0, -2.0, -0.3], [-0.1, -3.0, -3.0], [-2.0, -0.1, -7.0]], 3: [[-0.5]]}
    df = spark.createDataFrame([(k, i, x) for k, xs in logs.items() for i, x in enumerate(xs)], "k long, i long, logs array<double>").coalesce(1)
    whole = sorted(viterbi(df, ["k"], "i", "logs", 0.6).collect())
    for k, xs in logs.items():  # each key by itself gives the same
        alone = viterbi(df.where(f"k = {k}"), ["k"], "i", "logs", 0.6, block=2).collect()
        assert sorted(alone) == [r for r in whole if r.k == k] and len(alone) == len(xs)


def test_blocks_side_by_side_as_one_by_one():
    import numpy as np

    from tactus.operators import block_scans as B

    r = np.random.default_rng(1)
    sizes = np.array([7, 7, 4, 1])
    x = r.integers(-50, 0, (sizes.sum(), 3))
    score, at = r.integers(-9, 0, (4, 3)), np.cumsum(sizes) - sizes
    got = B._together(score, x, sizes, 1, -1, -5)
    assert got.tolist() == [B._forward(score[k : k + 1], x[a : a + n], -1, -5)[0].tolist() for k, (a, n) in enumerate(zip(at, sizes))]


def test_frames_are_handed_on_in_bounded_batches(spark, monkeypatch):
    from tactus.operators import signal as G

    assert plan_of(QUERIES["w03_spectrum"](spark, "/root/testdata/sf0.001")).count("ArrowEvalPython") == 0  # no row of all frames of a block
    monkeypatch.setattr(G, "BATCH_FRAMES", 3)
    df = spark.createDataFrame([(k, i, float(k * 7 + i)) for k, n in ((1, 11), (2, 1), (3, 4)) for i in range(n)], "k long, idx long, value double")
    seen = G.over_frames(G.blocks(df, ["k"], "value", 2, 2, "none"), ["k"], 2, 2, lambda x: x, "x").collect()
    assert sorted((r.k, r.frame, r.x) for r in seen) == [(k, f, [k * 7.0 + 2 * f, k * 7.0 + 2 * f + 1]) for k, n in ((1, 5), (3, 2)) for f in range(n)]


def tempi_of(rows, tempi):
    """Plain Python: the tempi of one key and their weights."""
    import math

    e = [sum(max(x, 0.0) for x in xs) / len(rows) for xs in zip(*rows, strict=True)]
    prior = [math.exp(-0.5 * (math.log(b / 120.0) / 0.7) ** 2) for b in tempi]
    best = max(range(len(e)), key=lambda k: (e[k] * prior[k], k))
    found = [best]
    for target in (tempi[best] * 2, tempi[best] / 2):
        close = [k for k, b in enumerate(tempi) if abs(b - target) <= max(target * 0.08, 1.0)]
        if tempi[0] <= target <= tempi[-1] and close:
            top = min(close, key=lambda k: (-e[k], k))
            if all(abs(tempi[k] - tempi[top]) >= 1 for k in found):
                found.append(top)
    ranked = sorted((-max(e[k], 1e-6) * prior[k], tempi[k]) for k in found)
    return [(b, round(w / sum(w for w, _ in ranked), 9)) for w, b in ranked]


def test_tempo_candidates_write_no_expression_out_again(spark):
    """Energies of silence, with ties and at random, as plain Python; a scan of a key's energies stands three times in the plan, not 73 times."""
    import random

    from tactus.operators import signal as G

    r = random.Random(3)
    tempi = G.tempo_grid(40.0, 240.0, 21)
    rows = {0: [[0.0] * 21], 1: [[0.5] * 21, [0.5] * 21], 2: [[-0.2] * 21], 3: [[float(b in (60.0, 120.0, 240.0)) for b in tempi]]}
    rows |= {k: [[r.uniform(-1, 1) for _ in tempi] for _ in range(r.randint(1, 4))] for k in range(4, 40)}
    df = spark.createDataFrame([(k, f, x) for k, xs in rows.items() for f, x in enumerate(xs)], "k long, frame long, energy array<double>")
    out = G.tempo_candidates(df, ["k"], tempi)
    seen = sorted(out.collect(), key=lambda x: (x.k, x.place))
    assert [(x.k, x.place, x.bpm, round(x.weight, 9)) for x in seen] == [(k, p, b, w) for k in rows for p, (b, w) in enumerate(tempi_of(rows[k], tempi), 1)]
    assert plan_of(out).count("aggregate(") <= 3
