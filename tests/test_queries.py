"""Every query against its SQL, and the scans that SQL can't express against plain Python."""

import os
import random

import pytest

from tactus.operators import joins, scans, series
from tactus.plans.catalog import ORACLE, QUERIES

from tests.oracle import connect, differences

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, con, name):
    assert differences(spark, con, SF, QUERIES[name], ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def points(seed, n=300, keys=3):
    r = random.Random(seed)
    return [(k, round(r.uniform(0, 200), 2), round(r.uniform(0, 9), 1)) for k in range(keys) for _ in range(n)]


def by_key(rows):
    out = {}
    for k, *rest in rows:
        out.setdefault(k, []).append(tuple(rest))
    return {k: sorted(v) for k, v in out.items()}


def bucket():
    from pyspark.sql import functions as F

    return F.floor(F.col("_t") / 10)


def test_gap_collapse(spark):
    rows = points(1)
    want = {}
    for k, p in by_key(rows).items():
        kept = []
        for t, v in p:
            if kept and t - kept[-1][0] < 0.3:
                if v > kept[-1][1]:
                    kept[-1] = (t, v)
            else:
                kept.append((t, v))
        want[k] = kept
    df = spark.createDataFrame(rows, "k int, t double, v double")
    assert by_key(map(tuple, scans.collapse_gaps(df, ["k"], "t", "v", 0.3, bucket()).collect())) == want


def test_suppression(spark):
    rows = points(2)
    want = {}
    for k, p in by_key(rows).items():
        kept = []
        for t, v in sorted(p, key=lambda x: (-x[1], x[0])):
            if all(abs(t - s) >= 0.7 for s, _ in kept):
                kept.append((t, v))
        want[k] = sorted(kept)
    df = spark.createDataFrame(rows, "k int, t double, v double")
    assert by_key(map(tuple, scans.suppress(df, ["k"], "t", "v", 0.7, bucket()).collect())) == want


def test_match_within(spark):
    a, b = points(3, 150), points(4, 150)
    want = {}
    left, right = by_key(a), by_key(b)
    for k in left:
        r, e = [t for t, _ in left[k]], [t for t, _ in right[k]]
        i = j = 0
        got = []
        while i < len(r) and j < len(e):
            if abs(r[i] - e[j]) <= 0.25:
                got.append((r[i], e[j]))
                i, j = i + 1, j + 1
            elif r[i] < e[j]:
                i += 1
            else:
                j += 1
        want[k] = sorted(got)
    f = lambda rows: spark.createDataFrame(rows, "k int, t double, v double")
    assert by_key(map(tuple, joins.match_within(f(a), f(b), ["k"], "t", 0.25, bucket()).collect())) == want


def test_viterbi_against_all_paths(spark):
    import itertools
    import math

    r = random.Random(5)
    logs = [[round(r.uniform(-3, 0), 2) for _ in range(3)] for _ in range(6)]
    hold, move = math.log(0.7), math.log(0.15)
    best = max(itertools.product(range(3), repeat=6), key=lambda p: sum(logs[i][s] for i, s in enumerate(p)) + sum(hold if a == b else move for a, b in itertools.pairwise(p)))
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(logs)], "k int, idx long, logs array<double>")
    assert [x["state"] for x in scans.viterbi(df, ["k"], "idx", "logs", 0.7).orderBy("idx").collect()] == list(best)


def best_path(logs, stay):
    """Viterbi step by step in whole numbers: lowest of equally good predecessors, last of equally good ends."""
    import math

    k = len(logs[0])
    least = lambda x: max(x, -1000.0)
    count = lambda x: round(least(x) * 2**28)
    hold, move = count(math.log(stay)), count(math.log((1 - stay) / (k - 1)))
    x = [[count(v - max(row)) for v in row] for row in logs]
    score, back = x[0], []
    for row in x[1:]:
        came = [max(range(k), key=lambda r: (score[r] + (hold if r == s else move), -r)) for s in range(k)]
        score = [score[r] + (hold if r == s else move) + row[s] for s, r in enumerate(came)]
        back.append(came)
    path = [max(range(k), key=lambda s: (score[s], s))]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


@pytest.mark.parametrize(("block", "stay"), [(1, 0.6), (2, 0.9), (7, 0.25), (4096, 0.6)])
def test_viterbi_in_blocks_of_any_size(spark, block, stay):
    r = random.Random(block)
    series_ = {k: [[r.choice([-1.0, -2.0, -3.0, float("-inf"), -2.5]) for _ in range(3)] for _ in range(n)] for k, n in enumerate((1, 2, 13, 40, 41))}
    series_[9] = [[-1.0] * 3] * 30  # ties everywhere
    df = spark.createDataFrame([(k, i, x) for k, rows in series_.items() for i, x in enumerate(rows)], "k int, idx long, logs array<double>").repartition(3)
    got = {}
    for x in scans.viterbi(df, ["k"], "idx", "logs", stay, block=block).orderBy("idx").collect():
        got.setdefault(x["k"], []).append(x["state"])
        assert x["score"] == series_[x["k"]][x["idx"]][x["state"]]
    for k, rows in series_.items():
        assert got[k] == best_path([[-1e9 if v == float("-inf") else v for v in row] if max(row) > float("-inf") else [0.0] * 3 for row in rows], stay), k
    assert scans.viterbi(df.limit(0), ["k"], "idx", "logs", stay).count() == 0


def test_memory_average_in_blocks_of_any_size(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(points(16, 90, 3), "k int, t double, v double")
    want = {x["k"]: x["ema"] for x in scans.ema(df, ["k"], ["t"], "v", 0.9).collect()}
    for block in (1, 7, 64):
        for x in scans.ema(df, ["k"], ["t"], "v", 0.9, F.floor("t"), block).collect():
            assert abs(x["ema"] - want[x["k"]]) < 1e-9


def serial_suppression(p, distance):
    kept = []
    for t, v in sorted(set(p), key=lambda x: (-x[1], x[0])):
        if all(abs(t - s) >= distance for s, _ in kept):
            kept.append((t, v))
    return sorted(kept)


@pytest.mark.parametrize("rounds", [0, 1, 12])
def test_suppression_of_crowds_and_staircases(spark, rounds):
    r = random.Random(8)
    rows = [(0, r.uniform(5, 5.9), float(r.randint(0, 50))) for _ in range(5000)]  # all within reach of one another
    rows += [(1, 0.9 * i, 100.0 - i) for i in range(60)]  # each in reach of a better one
    rows += [(2, float(i % 7), 1.0) for i in range(40)] + [(2, 3.5, None), (2, None, 9.0), (2, float("nan"), 1.0), (2, 3.5, float("nan"))]
    df = spark.createDataFrame(rows, "k int, t double, v double").repartition(4)
    got = by_key(map(tuple, scans.suppress(df, ["k"], "t", "v", 1.0, bucket(), rounds).collect()))
    assert got == {k: serial_suppression([x for x in p if None not in x and x[0] == x[0] and x[1] == x[1]], 1.0) for k, p in {k: [(t, v) for kk, t, v in rows if kk == k] for k in range(3)}.items()}
    assert scans.suppress(df.limit(0), ["k"], "t", "v", 1.0, bucket()).collect() == []


def test_top_windows_against_the_serial_rule(spark):
    rows = points(12, 60, 4) + [(0, 3.0, None)]
    df = spark.createDataFrame(rows, "k int, t double, v double")
    from pyspark.sql import functions as F

    got = {}
    for x in scans.top_windows(df, ["k"], "t", F.col("v"), 30.0).orderBy("place").collect():
        got.setdefault(x["k"], []).append((x["t"], x["score"]))
    for k, p in by_key(r for r in rows if r[2] is not None).items():
        kept = []
        for t, v in sorted(p, key=lambda x: (-x[1], x[0])):
            if len(kept) < 4 and all(abs(t - s) >= 30.0 for s, _ in kept):
                kept.append((t, v))
        assert got[k] == kept


def test_tempo_over_a_gap_of_a_million_million_periods(spark):
    rows = [(1, t, 1.0, 1.0) for t in (0.0, 1.0, 1e12, 1e12 + 1, 1e12 + 1.5)] + [(2, t, 1.0, 1e-9) for t in (0.0, 1e12, 1e12 + 0.0001)]
    df = spark.createDataFrame(rows, "k int, t double, v double, p double")
    got = by_key((x["k"], x["t"]) for x in scans.follow_tempo(df, ["k"], "t", "v", "p").collect())
    assert got == {1: [(0.0,), (1.0,), (1e12,), (1e12 + 1,)], 2: [(0.0,), (1e12,), (1e12 + 0.0001,)]}  # a window is 0.04 wide


def test_matches_of_one_long_session(spark):
    """All times close together: one session, walked as a stream."""
    r = random.Random(9)
    a, b = (sorted(round(r.uniform(0, 50), 3) for _ in range(3000)) for _ in range(2))
    i = j = 0
    want = []
    while i < len(a) and j < len(b):
        if abs(a[i] - b[j]) <= 0.1:
            want.append((a[i], b[j]))
            i, j = i + 1, j + 1
        elif a[i] < b[j]:
            i += 1
        else:
            j += 1
    f = lambda x: spark.createDataFrame([(1, t) for t in x] + [(1, None)], "k int, t double")
    got = [(x["ref_at"], x["est_at"]) for x in joins.match_within(f(a), f(b), ["k"], "t", 0.1, bucket()).collect()]
    assert sorted(got) == want


def test_memory_average(spark):
    rows = points(6, 40, 2)
    df = spark.createDataFrame(rows, "k int, t double, v double")
    got = {x["k"]: x["ema"] for x in scans.ema(df, ["k"], ["t"], "v", 0.9).collect()}
    for k, p in by_key(rows).items():
        m = None
        for u, (_, v) in enumerate(p):
            d = min(0.9, (1 + u) / (10 + u))
            m = v if m is None else d * m + (1 - d) * v
        assert abs(got[k] - m) < 1e-9


def test_blocks_and_buckets_change_nothing(spark):
    """Small blocks cross every window; a series over one bucket or many gives the same."""
    from pyspark.sql import functions as F

    rows = [(k, i, t, v) for i, (k, t, v) in enumerate(points(7, 200, 2))] + [(None, 9999, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, id long, t double, v double")
    out = []
    for b, block in ((F.lit(0), 10_000), (F.floor(F.col("t")), 7)):
        x = series.index_rows(df, ["k"], ["t", "id"], b)
        x = series.moving_average(x, ["k"], "v", 5, block=block)
        x = series.running_sum(x, ["k"], ["t", "id"], b, F.col("v"), "s")
        x = series.carry(x, ["k"], ["t", "id"], b, {"back": F.col("id")})
        x = series.carry(x, ["k"], ["t", "id"], b, {"on": F.col("id")}, ahead=True)
        out.append(sorted((r["id"], r["idx"], round(r["smooth"], 9), round(r["s"], 6), r["back"], r["on"]) for r in x.collect()))
    assert out[0] == out[1] and len(out[0]) == 400
    assert series.index_rows(df.limit(0), ["k"], ["t"], F.lit(0)).collect() == []


def test_library_stands_without_the_corpus_operators():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['tactus.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) >= 80 and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def tempo_walk(peaks, period):
    """The rule of follow_tempo, peak by peak."""
    if len(peaks) < 2 or not (0 < period < float("inf")):
        return [t for t, _ in peaks]
    half, want, i, out = max(0.35 * period, 0.02), peaks[0][0], 0, []
    while i < len(peaks):
        near = [p for p in peaks[i:] if want - half <= p[0] < want + half]
        if near:
            best = max(near, key=lambda p: (p[1], -p[0]))
            i = max(k for k, p in enumerate(peaks) if p[0] < want + half) + 1
            out.append(best[0])
            want = best[0] + period
        else:
            want += period
            while i < len(peaks) and peaks[i][0] < want - half:
                i += 1
    return out


def test_follow_tempo_against_a_plain_walk(spark):
    r = random.Random(4)
    lists = {0: ([(0.43, 0.17), (0.581, 0.502)], 0.5), 1: ([(0.1, 0.2), (0.2, 0.1)], 0.0), 2: ([(1.0, 1.0)], 0.5)}
    frame = 256 / 22050
    lists[3] = ([(i * frame, 0.6) for i in range(0, 400, 20)], 40 * frame)  # a pulse twice as fast as the beat
    for k in range(4, 300):
        lists[k] = (sorted((round(r.uniform(0, 12), 3), round(r.random(), 1)) for _ in range(r.randint(0, 40))), r.choice([0.01, 0.3, 0.5, 1.1]))
    rows = [(k, t, v, p) for k, (peaks, p) in lists.items() for t, v in dict(peaks).items()]
    df = spark.createDataFrame(rows, "k long, t double, v double, p double").repartition(4)
    got = {}
    for x in scans.follow_tempo(df, ["k"], "t", "v", "p").collect():
        got.setdefault(x["k"], []).append(x["t"])
    for k, (peaks, p) in lists.items():
        assert sorted(got.get(k, [])) == tempo_walk(sorted(dict(peaks).items()), p), k
    assert sorted(got[0]) == [0.581] and 9 <= len(got[3]) <= 11
