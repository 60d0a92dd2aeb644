"""Alignment, chunks and scores against plain Python."""

import numpy as np
from pyspark.sql import functions as F

from tactus.operators import evaluation as V


def table(spark, x, key=1):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(x)], "k int, idx long, value double")


def test_best_lag_over_block_edges(spark):
    x = np.random.default_rng(3).normal(size=300)
    late = np.concatenate([np.zeros(9), x])
    got = V.best_lag(table(spark, x), table(spark, late), ["k"], "idx", "value", 20, block=32).collect()[0]
    assert got.lag == 9 and abs(got["product"] - (x @ x)) < 1e-6


def test_least_squares_of_a_known_mix(spark):
    r = np.random.default_rng(4).normal(size=(100, 2))
    df = spark.createDataFrame([(1, float(a), float(b), float(2 * a - b), 0.0) for a, b in r], "k int, a double, b double, y double, z double")
    got = V.least_squares(df, ["k"], F.col("y"), [F.col("a"), F.col("b"), F.col("z")]).collect()[0]
    np.testing.assert_allclose(got.coefficients, [2, -1, 0], atol=1e-9)
    assert abs(got.explained - 1) < 1e-9


def test_detection_score_counts_one_sided_keys(spark):
    ref = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0)], "k int, t double")
    est = spark.createDataFrame([(1, 1.1), (1, 9.0), (3, 1.0)], "k int, t double")
    got = {r.k: (r.found, r.refs, r.ests, r.f) for r in V.detection_score(ref, est, ["k"], "t", 0.2, F.floor(F.col("_t"))).collect()}
    assert got == {1: (1, 2, 2, 0.5), 2: (0, 1, 0, 0.0), 3: (0, 0, 1, 0.0)}
