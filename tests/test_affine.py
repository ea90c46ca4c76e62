"""Affine maps in columns: exact for three points, and without the wrong ones beyond that."""

import numpy as np
from pyspark.sql import functions as F

from tallymark.operators import affine

TRUE = np.array([[0.98, -0.05, 12.0], [0.04, 1.01, -7.5]])


def pair(x, y, off=(0.0, 0.0)):
    tx, ty = TRUE @ [x, y, 1]
    return (float(x), float(y), float(tx + off[0]), float(ty + off[1]))


def maps(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), f"k int, points {affine.POINTS}")
    return [r.m for r in df.select("k", affine.consensus(F.col("points")).alias("m")).orderBy("k").collect()]


def matrix(m):
    return np.array([[m.a, m.b, m.c], [m.d, m.e, m.f]])


def test_three_are_exact_and_a_wrong_one_of_five_is_left_out(spark):
    corners = [(30, 40), (1170, 36), (44, 1660), (1150, 1640), (600, 800)]
    three = [pair(*c) for c in corners[:3]]
    one_wrong = [pair(*c) if i != 3 else pair(*c, off=(90.0, -60.0)) for i, c in enumerate(corners)]
    four_wrong = [pair(*corners[0]), pair(*corners[1], off=(0.0, 300.0)), *[pair(*c) for c in corners[2:]]]
    for m, n in zip(maps(spark, [three, one_wrong, four_wrong]), (3, 4, 4), strict=True):
        assert np.allclose(matrix(m), TRUE, atol=1e-6) and m.inliers == n


def test_small_errors_are_fitted_by_least_squares(spark):
    rng = np.random.default_rng(1)
    for n in (3, 4, 7):
        points = [pair(*rng.uniform(0, 1500, 2), off=rng.uniform(-0.4, 0.4, 2)) for _ in range(n)]
        (m,) = maps(spark, [points])
        p = np.array(points)
        want = np.linalg.lstsq(np.column_stack([p[:, :2], np.ones(n)]), p[:, 2:], rcond=None)[0].T
        assert m.inliers == n and np.allclose(matrix(m), want, atol=1e-6)


def test_points_without_a_map(spark):
    line = [pair(x, 2 * x) for x in (0, 10, 20, 30)]
    same = [pair(5, 5)] * 4
    assert maps(spark, [line, same, [pair(0, 0), pair(1, 0)], [], None, [pair(0, 0), pair(1, 0), None]]) == [None] * 6
