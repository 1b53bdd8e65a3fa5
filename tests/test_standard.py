"""Frames, levels, splits beside fixed tests, and the two queries without SQL, against loops and numpy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from strokelake import plans
from strokelake.operators import augment, quality, sampling, scoring, standard
from strokelake.plans.adapters import ink_strokes

SF = "/root/testdata/sf0.001"
INK = "frame string, id string, text string, strokes array<array<struct<x:double,y:double>>>, xh array<double>, base double"


def spline_at(p: np.ndarray, i: int, share: float) -> np.ndarray:
    """A point of the centripetal curve between p[i] and p[i + 1], by repeated mixing."""
    four = [2 * p[0] - p[1] if i == 0 else p[i - 1], p[i], p[i + 1], 2 * p[-1] - p[-2] if i + 2 == len(p) else p[i + 2]]
    knots = [0.0]
    for a, b in zip(four, four[1:], strict=False):
        knots.append(knots[-1] + math.sqrt(math.dist(a, b)))
    t = knots[1] + (knots[2] - knots[1]) * share
    level = four
    for reach in (1, 2):
        level = [((knots[k + reach] - t) * level[k] + (t - knots[k]) * level[k + 1]) / (knots[k + reach] - knots[k]) for k in range(len(level) - 1)]
    return ((knots[2] - t) * level[0] + (t - knots[1]) * level[1]) / (knots[2] - knots[1])


def redrawn(stroke: np.ndarray) -> np.ndarray:
    line = stroke if len(stroke) < 3 else np.array([spline_at(stroke, i, j / 16) for i in range(len(stroke) - 1) for j in range(16)] + [stroke[-1]])
    at = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(line, axis=0).T))]) if len(line) > 1 else np.zeros(1)
    if at[-1] == 0:
        return line[:1]
    pieces = max(1, round(at[-1] / 0.01))
    want = np.arange(pieces + 1) * at[-1] / pieces
    return np.stack([np.interp(want, at, line[:, c]) for c in (0, 1)], axis=1)


def span(strokes, low=0.02, high=0.98) -> float:
    y = np.concatenate(strokes)[:, 1]
    return float(np.quantile(y, high) - np.quantile(y, low))


def band(strokes) -> float:
    y = np.concatenate(strokes)[:, 1]
    step, dense = max(np.ptp(y), 1e-6) / 200, []
    for s in strokes:
        for a, b in zip(s, s[1:], strict=False):
            n = max(1, math.ceil(math.dist(a, b) / step))
            dense += [a[1] + (b[1] - a[1]) * k / n for k in range(n)]
        dense.append(s[-1][1])
    counts = np.histogram(dense, bins=40)[0]
    smooth = [sum(counts[max(0, k - 1) : k + 2]) / 3 for k in range(40)]
    top = low = high = int(np.argmax(smooth))
    while high < 39 and smooth[high + 1] >= 0.25 * smooth[top]:
        high += 1
    while low > 0 and smooth[low - 1] >= 0.25 * smooth[top]:
        low -= 1
    return (high - low + 1) * (max(dense) - min(dense)) / 40


def frame_scale(rows) -> tuple[str, float]:
    short = lambda t, least: len(t) >= least and all(c in "acemnorsuvwxz" for c in t)
    words, letters = [span(s) for t, s, _ in rows if short(t, 2)], [h for _, _, hs in rows for h in hs or []]
    for how, values, least in (("words", words, 2), ("letters", letters, 1)):
        if len(values) >= 5:
            k = 0.123 / np.median(values)
            again = [span([redrawn(one * k) for one in s]) for t, s, _ in rows if short(t, least)]
            return how, k * 0.123 / np.median(again) if again else k
    bands = [band(s) for t, s, _ in rows if any(c.islower() for c in t)]
    return ("band", 0.123 / np.median(bands)) if len(bands) >= 3 else ("ink", 0.22 / np.median([span(s, 0.05, 0.95) for _, s, _ in rows]))


def foot(strokes, tall: float) -> float:
    y = [v for s in strokes for v in s[:, 1]]
    full = {b: sum(b - tall < v <= b for v in y) for b in y}
    return max(b for b, n in full.items() if n >= 0.95 * max(full.values()))


def frames():
    rng = np.random.default_rng(5)
    wave = lambda n, size: np.stack([np.arange(n) * size / 3 + rng.random(), size * (1 + rng.random(n))], axis=1)
    rows = []
    for frame, texts, size in (("a", ["ac", "mnor", "su", "vw", "xz", "tall", "a"], 5.0), ("b", ["a", "Bc", "e", "dot"], 0.4), ("c", ["tall", "high", "Lot", "UP"], 30.0), (None, ["UP", "GO", None], 2.0)):
        for i, t in enumerate(texts):
            strokes = [wave(int(rng.integers(4, 9)), size), wave(1 + i % 3, size)]
            rows.append((frame, f"{frame}{i}", t, strokes, [size * 0.9, size * 1.1] if frame == "b" else None, size if i == 1 else None))
    return rows


def test_frames_against_a_loop(spark):
    rows = frames()
    ink = spark.createDataFrame([(f, i, t, [[(float(x), float(y)) for x, y in s] for s in st], xh, b) for f, i, t, st, xh, b in rows] + [("a", "none", "ac", [], None, None)], INK)
    scales = standard.frame_scales(ink, letters="xh")
    got = {r.frame: (r.how, r.scale) for r in scales.collect()}
    assert set(got) == {"a", "b", "c", None}
    for frame in got:
        how, k = frame_scale([(t or "", st, xh) for f, _, t, st, xh, _ in rows if f == frame])
        assert got[frame][0] == how and math.isclose(got[frame][1], k, rel_tol=1e-9), frame
    assert [got[f][0] for f in ("a", "b", "c", None)] == ["words", "letters", "band", "ink"]
    out = {}
    for r in standard.standardised(ink, scales, baseline="base").collect():
        out.setdefault((r.id, r.stroke), []).append((r.j, r.x, r.y))
    assert len(out) == 2 * len(rows)
    heights = []
    for f, i, t, strokes, _, base in rows:
        k = got[f][1]
        low = base if base is not None else foot(strokes, 0.123 / k * (1 if any(c.islower() for c in t or "") else 2))
        ours = [np.array([(x, y) for _, x, y in sorted(out[i, n])]) for n in range(2)]
        for stroke, mine in zip(strokes, ours, strict=True):
            assert np.allclose(redrawn((stroke - [strokes[0][0, 0], low]) * k), mine, atol=1.01e-5)
        if f == "a" and t in ("ac", "mnor", "su", "vw", "xz"):
            heights.append(span(ours))
    assert abs(np.median(heights) / 0.123 - 1) < 0.01


def test_frames_without_rows(spark):
    ink = spark.createDataFrame([], INK)
    scales = standard.frame_scales(ink)
    assert scales.count() == 0 and standard.standardised(ink, scales).count() == 0


def test_level_in_many_ranges(spark):
    rng = np.random.default_rng(3)
    mass = np.round(rng.exponential(size=3000), 2) + 0.01
    df = spark.createDataFrame([(float(m),) for m in mass], "mass double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for share in (0.1, 0.5, 1.0):
            falling = np.sort(mass)[::-1]
            want = falling[np.searchsorted(np.cumsum(falling), share * mass.sum() - 1e-6)]
            assert math.isclose(scoring.half_mass_level(df, share).first().level, want), share
        assert scoring.half_mass_level(df.where("mass < 0")).first().level is None
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_fixed_tests_beside_a_split(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else None) for i in range(90)] + [(None, "hot")], "key int, source string")
    tests = spark.createDataFrame([(3, "t"), (4, "t"), (4, "t"), (None, "t"), (500, "t")], "key int, source string")
    got = sampling.split_by_tables(rows, tests, "key", "source", 20).collect()
    train = [r for r in got if r.part == "train"]
    assert sorted(str(r.key) for r in got if r.part == "test") == ["3", "4", "4", "500", "None"]
    assert not {3, 4} & {r.key for r in train} and sum(r.source == "hot" for r in train) == 20 and sum(r.source is None for r in train) == 20
    assert sampling.split_by_tables(rows, tests, "key", "source").where("part = 'train'").count() == 89
    weighed = rows.where("key IS NOT NULL").withColumn("w", F.when(F.col("key") < 60, F.lit(1000.0)).otherwise(F.when(F.col("key") < 80, 0.001).otherwise(0.0)))
    drawn = sampling.weighted_sample_by(weighed, 15, "source", "key", F.col("w")).collect()
    assert sum(r.source == "hot" for r in drawn) == 15 and all(r.key < 60 for r in drawn)
    assert sampling.weighted_sample_by(weighed, 1000, "source", "key", F.col("w")).count() == 80


def test_pca_against_numpy(spark):
    from strokelake.plans.registry import table

    vectors = {r.vec_id: r.embedding for r in table(spark, SF, "embeddings").select("vec_id", "embedding").collect()}
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    axes = np.linalg.svd(x - x.mean(axis=0))[2][:2]
    got = {r.vec_id: r.p for r in plans.QUERIES["v11_pca"](spark, SF).collect()}
    ours, want = np.array([got[i] for i in ids]), x @ axes.T
    assert np.allclose(ours * np.sign((ours * want).sum(axis=0)), want, atol=1e-8)


def test_altered_ink_against_a_loop(spark):
    import hashlib

    draw = lambda key, i: int(hashlib.md5(f"alter|{key}|{i}".encode()).hexdigest()[:8], 16) / 2**32
    ink = ink_strokes(spark, SF).select("id", "strokes")
    want = []
    for r in ink.collect():
        strokes = list(r.strokes)
        if len(strokes) >= 4:
            sizes = [len(s) for s in strokes]
            keep, order, i = sizes.index(max(sizes)), list(range(len(strokes))), 0
            while i + 1 < len(order):
                swapped = draw(r.id, i) < 0.3 and keep not in order[i : i + 2]
                if swapped:
                    order[i : i + 2] = reversed(order[i : i + 2])
                i += 2 if swapped else 1
            strokes = [strokes[k] for k in order]
        want += [(r.id, s, k, round(p.x, 6), round(p.y, 6)) for s, stroke in enumerate(strokes) for k, p in enumerate(stroke)]
    got = [tuple(r[c] for c in ("id", "stroke", "pos", "x", "y")) for r in plans.QUERIES["b11_alter"](spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_hot_groups_are_ranked_in_many_tasks(spark):
    rng = np.random.default_rng(1)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else "b", i, float(v), float(w)) for i, (v, w) in enumerate(zip(rng.integers(0, 40, 600), rng.normal(size=600), strict=True))]
    df = spark.createDataFrame(rows, "by string, key int, v double, w double")
    groups = {g: [r for r in rows if r[0] == g] for g in (None, "hot", "b")}
    best = {g: sorted(rs, key=lambda r: (-r[2], r[1])) for g, rs in groups.items()}
    got = quality.top_share(df, "by", F.col("v"), "key", 0.3).collect()
    assert sorted(r.key for r in got) == sorted(r[1] for rs in best.values() for r in rs[: math.ceil(0.3 * len(rs) - 1e-9)])
    limit = 2 * min(map(len, groups.values()))
    got = {(r.by, r["rank"]): r.key for r in quality.balanced_best(df, "by", F.col("v"), "key").collect()}
    assert got == {(g, n + 1): r[1] for g, rs in best.items() for n, r in enumerate(rs[:limit])}
    got = {r.by: (r.n, r.correlation) for r in augment.rank_correlation(df, "by", F.col("v"), F.col("w"), "key").collect()}
    for g, rs in groups.items():
        ranks = [np.argsort(sorted(range(len(rs)), key=lambda i, c=c: (rs[i][c], rs[i][1]))) for c in (2, 3)]
        assert got[g][0] == len(rs) and math.isclose(got[g][1], np.corrcoef(*ranks)[0, 1], abs_tol=1e-9)


def test_primers_of_a_hot_writer(spark):
    import hashlib

    draw = lambda key: int(hashlib.md5(f"primer|{key}|0".encode()).hexdigest()[:8], 16) / 2**32
    rng = np.random.default_rng(4)
    rows = [("hot" if i % 4 else None, f"k{i}", int(n)) for i, n in enumerate(rng.integers(1, 40, 500))] + [("long", "z", 99)]
    got = {r.writer: r.primers for r in sampling.primers(spark.createDataFrame(rows, "writer string, id string, size int"), "writer", "id", "size", 30, 3).collect()}
    for writer in ("hot", None, "long"):
        used, keys = 0, []
        for _, _, key, n in sorted((-min(n, 5), draw(k), k, n) for w, k, n in rows if w == writer):
            if used + n <= 30 and len(keys) < 3:
                used, keys = used + n, [*keys, key]
        assert got[writer] == keys, writer
