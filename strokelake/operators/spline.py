"""Centripetal splines through strokes, and resampling to equal arc lengths: closed forms over windows of rows (id, stroke, pos),
or, where strokes are arrays in one row, `drawn`: the same without a shuffle, a row's strokes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 16
AT_ONCE = 20_000  # points of strokes drawn together, but for a longer row; a path has SAMPLES times as many


def curve(axis: str) -> str:
    """SQL of a spline's value on one axis from control values {axis}0..{axis}3, knots t0..t3 and the parameter t."""
    p = [f"{axis}{i}" for i in range(4)]
    mix = lambda a, b, lo, hi: f"((({hi}) - t) / (({hi}) - ({lo})) * ({a}) + (t - ({lo})) / (({hi}) - ({lo})) * ({b}))"
    a1, a2, a3 = mix(p[0], p[1], "t0", "t1"), mix(p[1], p[2], "t1", "t2"), mix(p[2], p[3], "t2", "t3")
    return mix(mix(a1, a2, "t0", "t2"), mix(a2, a3, "t1", "t3"), "t1", "t2")


def smooth_path(points: DataFrame) -> DataFrame:
    """Rows (id, stroke, k, x, y): SAMPLES points a segment and the end; repeats are dropped, strokes of under three stay."""
    w = Window.partitionBy("id", "stroke").orderBy("pos")
    before = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    p = points.withColumn("d", before).where("d IS NULL OR d >= 1e-9").withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("id", "stroke")))
    at = {f"{a}{k + 1}": (F.lag(a, -k) if k < 0 else F.lead(a, k)).over(w) for a in "xy" for k in (1, 2)}
    p = p.withColumns({"xm": F.lag("x").over(w), "ym": F.lag("y").over(w)} | at)
    ends = {}
    for a in "xy":
        ends[f"{a}0"], ends[f"{a}1"] = F.coalesce(f"{a}m", 2 * F.col(a) - F.col(f"{a}2")), F.col(a)
        ends[f"{a}3"] = F.coalesce(f"{a}3", 2 * F.col(f"{a}2") - F.col(a))
    seg = p.where("n >= 3 AND x2 IS NOT NULL").withColumns(ends).withColumn("t0", F.lit(0.0))
    for k in (1, 2, 3):
        seg = seg.withColumn(f"t{k}", F.col(f"t{k - 1}") + F.sqrt(F.hypot(F.col(f"x{k}") - F.col(f"x{k - 1}"), F.col(f"y{k}") - F.col(f"y{k - 1}"))))
    seg = seg.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1)))).withColumn("t", F.col("t1") + (F.col("t2") - F.col("t1")) * F.col("j") / SAMPLES)
    drawn = seg.select("id", "stroke", (F.col("i") * SAMPLES + F.col("j")).alias("k"), F.expr(curve("x")).alias("x"), F.expr(curve("y")).alias("y"))
    kept = p.where("n < 3 OR i = n - 1").select("id", "stroke", (F.col("i") * SAMPLES).alias("k"), "x", "y")
    return drawn.unionByName(kept)


def resample(path: DataFrame, spacing: float) -> DataFrame:
    """Rows (id, stroke, j, x, y): max(1, round(length / spacing)) equal pieces of each path; single points stay."""
    w = Window.partitionBy("id", "stroke").orderBy("k")
    whole = Window.partitionBy("id", "stroke")
    p = path.withColumns({"nx": F.lead("x").over(w), "ny": F.lead("y").over(w)}).withColumn("d", F.coalesce(F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")), F.lit(0.0)))
    p = p.withColumns({"to": F.sum("d").over(w), "length": F.sum("d").over(whole), "last": F.col("nx").isNull()}).withColumn("from", F.col("to") - F.col("d"))
    p = p.withColumn("n", F.greatest(F.lit(1), F.rint(F.col("length") / spacing)).cast("int"))
    place = lambda c: F.ceil(F.col(c) * F.col("n") / F.col("length") - 1e-9).cast("int")
    inner = p.where("NOT last AND d > 0").withColumns({"a": place("from"), "b": place("to") - 1}).where("b >= a").withColumn("j", F.explode(F.sequence("a", "b")))
    part = (F.col("j") * F.col("length") / F.col("n") - F.col("from")) / F.col("d")
    inner = inner.select("id", "stroke", "j", (F.col("x") + (F.col("nx") - F.col("x")) * part).alias("x"), (F.col("y") + (F.col("ny") - F.col("y")) * part).alias("y"))
    end = p.where("last").select("id", "stroke", F.when(F.col("length") > 0, F.col("n")).otherwise(0).alias("j"), "x", "y")
    return inner.unionByName(end)


def _path(p: np.ndarray) -> np.ndarray:
    """Smooth paths of equally many points: from (2, strokes, points) to (2, strokes, path)."""
    if p.shape[2] < 3:
        return p
    before, after = 2 * p[..., :1] - p[..., 1:2], 2 * p[..., -1:] - p[..., -2:-1]
    whole = np.concatenate([before, p, after], axis=2)
    x0, x1, x2, x3 = (whole[..., k : whole.shape[2] - 3 + k, None] for k in range(4))
    knot = lambda a, b: np.sqrt(np.hypot(*(b - a)))
    t0 = 0.0
    t1 = knot(x0, x1)
    t2 = t1 + knot(x1, x2)
    t3 = t2 + knot(x2, x3)
    t = t1 + (t2 - t1) * np.arange(SAMPLES) / SAMPLES
    mix = lambda a, b, lo, hi: (hi - t) / (hi - lo) * a + (t - lo) / (hi - lo) * b
    a1, a2, a3 = mix(x0, x1, t0, t1), mix(x1, x2, t1, t2), mix(x2, x3, t2, t3)
    each = mix(mix(a1, a2, t0, t2), mix(a2, a3, t1, t3), t1, t2)
    return np.concatenate([each.reshape(2, p.shape[1], -1), p[..., -1:]], axis=2)


def _pieces(path: np.ndarray, spacing: float) -> tuple[np.ndarray, np.ndarray]:
    """Points a stroke, and the points (2, all) of even pieces of paths of equally many points."""
    step = path[..., 1:] - path[..., :-1]
    d = np.nan_to_num(np.hypot(*step), posinf=np.inf)
    to = np.cumsum(d, axis=1)
    length = to[:, -1:] if to.shape[1] else np.zeros((len(to), 1))
    n = np.where(length > 0, np.maximum(1, np.rint(length / spacing)), 0).astype(np.int64)
    # a stroke of length 0 is its last point; of the others a piece starts in the first part that reaches past its place
    place = np.where(length > 0, np.ceil(to * n / np.where(length > 0, length, 1) - 1e-9), 0).astype(np.int64)
    place = np.concatenate([np.zeros((len(to), 1), np.int64), place], axis=1)
    row, part = np.nonzero(place[:, 1:] > place[:, :-1])
    count = (place[:, 1:] - place[:, :-1])[row, part]
    j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(place[row, part], count)
    row, part = np.repeat(row, count), np.repeat(part, count)
    share = (j * length[row, 0] / n[row, 0] - (to - d)[row, part]) / d[row, part]
    sizes = n[:, 0] + 1
    out = np.empty((2, sizes.sum()))
    ends = np.cumsum(sizes)
    out[:, (ends - sizes)[row] + j] = path[:, row, part] + step[:, row, part] * share
    out[:, ends - 1] = path[..., -1]
    return sizes, out


def _drawn(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, spacing: float) -> tuple[np.ndarray, np.ndarray]:
    """Points a stroke, and the points (2, all), of strokes of the given sizes, one after the other, made smooth and resampled."""
    stroke = np.repeat(np.arange(len(sizes)), sizes)
    first = np.zeros(len(x), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    kept = first | ~(np.hypot(np.diff(x, prepend=0.0), np.diff(y, prepend=0.0)) < 1e-9)
    p, n = np.stack([x[kept], y[kept]]), np.bincount(stroke[kept], minlength=len(sizes))
    starts = np.cumsum(n) - n
    made = []
    for size in np.unique(n[n > 0]):
        which = np.flatnonzero(n == size)
        made.append((which, *_pieces(_path(p[:, starts[which][:, None] + np.arange(size)]), spacing)))
    out_sizes = np.zeros(len(sizes), np.int64)
    for which, counts, _ in made:
        out_sizes[which] = counts
    begin, out = np.cumsum(out_sizes) - out_sizes, np.empty((2, out_sizes.sum()))
    for which, counts, points in made:
        out[:, np.repeat(begin[which] - np.cumsum(counts) + counts, counts) + np.arange(points.shape[1])] = points
    return out_sizes, out


def _row_points(strokes: pa.ListArray) -> np.ndarray:
    """Points a row of a column of strokes."""
    inner = strokes.flatten().value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.bincount(np.repeat(np.arange(len(strokes)), strokes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), weights=inner, minlength=len(strokes)).astype(np.int64)


def _drawn_column(strokes: pa.ListArray, spacing: float) -> pa.ListArray:
    each = strokes.flatten()
    points = each.flatten()
    x, y = (points.field(c).to_numpy(zero_copy_only=False).astype(float) for c in "xy")
    with np.errstate(divide="ignore", invalid="ignore"):
        sizes, out = _drawn(x, y, each.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), spacing)
    xy = pa.StructArray.from_arrays([pa.array(v, pa.float64(), from_pandas=True) for v in out], names=["x", "y"])
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), xy)
    lengths = strokes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), inner, mask=strokes.is_null())


def drawn(ink: DataFrame, spacing: float, column: str = "strokes") -> DataFrame:
    """Ink whose strokes (arrays of points x, y) are made smooth and cut into max(1, round(length / spacing)) equal pieces each.

    A row is drawn by itself, so nothing is shuffled or sorted, and a task holds some rows at a time, however many there are.
    Strokes keep their places; empty ones stay empty, and null ink stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(column)
            sizes = _row_points(batch.column(at))
            group = (np.cumsum(sizes) - sizes) // AT_ONCE  # rows that are drawn together
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                columns = list(part.columns)
                columns[at] = _drawn_column(columns[at], spacing)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    plain = ink.withColumn(column, F.col(column).cast("array<array<struct<x:double,y:double>>>"))
    return plain.mapInArrow(run, plain.schema)
