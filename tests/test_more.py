from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from strokelake import plans
from strokelake.functions import geometry as g
from strokelake.operators import augment, spline
from strokelake.operators import vectors as v

SF = "/root/testdata/sf0.001"


def test_resampled_pieces_are_even(spark):
    rows = [("a", 0, i, math.cos(i / 3), math.sin(i / 3)) for i in range(12)] + [("a", 1, 0, 5.0, 5.0), ("a", 2, 0, 0.0, 0.0), ("a", 2, 1, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "id string, stroke int, pos int, x double, y double")
    out = spline.resample(spline.smooth_path(df), 0.05).orderBy("stroke", "j").collect()
    one = np.array([(r.x, r.y) for r in out if r.stroke == 0])
    steps = np.hypot(*np.diff(one, axis=0).T)
    assert abs(steps.mean() - 0.05) < 0.005 and steps.max() < 1.02 * steps.min()
    assert np.allclose(one[0], [1, 0]) and np.allclose(one[-1], [math.cos(11 / 3), math.sin(11 / 3)])
    assert [(r.x, r.y) for r in out if r.stroke == 1] == [(5.0, 5.0)]
    assert len([r for r in out if r.stroke == 2]) == 21


def test_altered_order():
    sizes = [3, 9, 2, 4, 5]
    assert augment.altered_order(sizes, [1.0] * 5, 0.5, 4) == [0, 1, 2, 3, 4]
    assert augment.altered_order(sizes, [0.0] * 5, 0.5, 4) == [0, 1, 3, 2, 4]
    assert augment.altered_order(sizes[:3], [0.0] * 5, 0.5, 4) == [0, 1, 2]


def test_restart_keeps_points(spark):
    loop = [(math.cos(a), math.sin(a)) for a in np.linspace(0, 2 * math.pi, 9)]
    df = spark.createDataFrame([(loop,)], "s array<struct<x:double,y:double>>")
    r = df.select(augment.restarted(F.col("s"), F.lit(3)).alias("t")).first().t
    assert len(r) == 9 and math.isclose(r[0].x, r[-1].x, abs_tol=1e-9) and np.allclose([(p.x, p.y) for p in r[:6]], loop[3:])


def test_ridge_and_pca(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) * [3, 1, 0.2]
    y = x @ [1.0, -2, 0.5] + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i int, x array<double>, y double")
    got = v.ridge_r2(df, "x", "y", F.col("i") % 5, 5, 1.0)
    z = np.c_[x, np.ones(200)]
    for k in range(5):
        test = np.arange(200) % 5 == k
        beta = np.linalg.solve(z[~test].T @ z[~test] + np.eye(4), z[~test].T @ y[~test])
        assert math.isclose(got[k], 1 - ((y[test] - z[test] @ beta) ** 2).sum() / ((y[test] - y[test].mean()) ** 2).sum(), abs_tol=1e-9)
    p = np.array([r.p for r in plans.QUERIES["v11_pca"](spark, SF).collect()])
    assert p[:, 0].var() >= p[:, 1].var()


def test_normalize_drops_what_is_not_finite(spark):
    s = [[(0.0, 0.0), (float("nan"), 1.0), (2.0, 1.0)], [], [(1.0, float("inf"))]]
    df = spark.createDataFrame([(s,), ([[(1.0, 1.0)]],), ([],)], "s array<array<struct<x:double,y:double>>>")
    got = [r.n for r in df.select(g.normalize(F.col("s")).alias("n")).collect()]
    assert [[(p.x, p.y) for p in q] for q in got[0]] == [[(0.0, 0.0), (1.0, 0.5)]] and got[1] is None and got[2] is None


def test_same_in_any_partitioning(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append({name: sorted(map(repr, plans.QUERIES[name](spark, SF).collect())) for name in ("c01_grid_walk", "f04_weighted_draws", "f06_join_words", "g15_runs", "e12_best_candidate")})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]
