"""Stroke geometry as column expressions: no shuffle, no Python.

Strokes are `array<array<struct<x:double,y:double>>>`; points are `array<struct<x:double,y:double,pen:int>>`, where each
stroke ends with a repeat of its last point with pen 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strokelake.functions.arrays import indices, let, pairs, total

STEP_LIMIT = 127  # largest step a packed stroke can hold


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def bounds(strokes: Column) -> Column:
    """Struct x0, x1, y0, y1 of all points (nulls if there are none)."""
    return let(F.flatten(strokes), lambda p: F.struct(
        F.array_min(F.transform(p, lambda q: q["x"])).alias("x0"), F.array_max(F.transform(p, lambda q: q["x"])).alias("x1"),
        F.array_min(F.transform(p, lambda q: q["y"])).alias("y0"), F.array_max(F.transform(p, lambda q: q["y"])).alias("y1")))


def map_points(strokes: Column, f) -> Column:
    return F.transform(strokes, lambda s: F.transform(s, f))


def normalize(strokes: Column) -> Column:
    """Without non-finite points and empty strokes, shifted to the origin, longer side 1; null without extent."""
    clean = F.filter(F.transform(strokes, lambda s: F.filter(s, lambda p: _finite(p["x"]) & _finite(p["y"]))), lambda s: F.size(s) > 0)

    def scaled(s: Column) -> Column:
        def by(b: Column) -> Column:
            side = F.greatest(b["x1"] - b["x0"], b["y1"] - b["y0"])
            return F.when(side > 0, map_points(s, lambda p: _xy((p["x"] - b["x0"]) / side, (p["y"] - b["y0"]) / side)))

        return let(bounds(s), by)

    return let(clean, scaled)


def ink_length(strokes: Column) -> Column:
    each = F.transform(strokes, lambda s: F.coalesce(total(pairs(s, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))), F.lit(0.0)))
    return total(each)


def centred(strokes: Column) -> Column:
    """Shifted so that the middle of the bounding box is the origin."""
    return let(bounds(strokes), lambda b: map_points(strokes, lambda p: _xy(p["x"] - (b["x0"] + b["x1"]) / 2, p["y"] - (b["y0"] + b["y1"]) / 2)))


def to_points(strokes: Column) -> Column:
    def with_lift(s: Column) -> Column:
        down = F.transform(s, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(1).alias("pen")))
        last = F.element_at(s, -1)
        return F.concat(down, F.array(F.struct(last["x"].alias("x"), last["y"].alias("y"), F.lit(0).alias("pen"))))

    return F.flatten(F.transform(F.filter(strokes, lambda s: F.size(s) > 0), with_lift))


def to_strokes(points: Column) -> Column:
    """The runs of pen 1."""

    def runs(p: Column) -> Column:
        i = indices(p)
        down = lambda k: F.coalesce(F.get(p, k)["pen"] == 1, F.lit(False))
        first = F.filter(i, lambda k: down(k) & ~down(k - 1))
        last = F.filter(i, lambda k: down(k) & ~down(k + 1))
        return F.zip_with(first, last, lambda a, b: F.transform(F.slice(p, a + 1, b - a + 1), lambda q: _xy(q["x"], q["y"])))

    return let(points, runs)


def measure(points: Column) -> Column:
    """Struct ink (length over longer side, 0 without extent) and strokes (count)."""

    def of(s: Column) -> Column:
        side = let(bounds(s), lambda b: F.greatest(b["x1"] - b["x0"], b["y1"] - b["y0"]))
        return F.struct(F.coalesce(F.when(side > 0, ink_length(s) / side), F.lit(0.0)).alias("ink"), F.size(s).alias("strokes"))

    return let(to_strokes(points), of)


def smooth(strokes: Column) -> Column:
    """Three-point moving mean; ends stay, strokes of under three points stay."""

    def one(s: Column) -> Column:
        def at(p: Column, i: Column) -> Column:
            a, b = F.get(s, i - 1), F.get(s, i + 1)
            inner = (i > 0) & (i < F.size(s) - 1)
            return _xy(F.when(inner, (a["x"] + p["x"] + b["x"]) / 3).otherwise(p["x"]), F.when(inner, (a["y"] + p["y"] + b["y"]) / 3).otherwise(p["y"]))

        return F.when(F.size(s) < 3, s).otherwise(F.transform(s, at))

    return F.transform(strokes, one)


def quantize(stroke: Column, unit: float) -> Column:
    """Cells of a stroke: half-even rounding, repeats dropped, steps over 127 cut evenly."""
    cell = lambda v: F.rint(v / unit).cast("int")
    cells = F.transform(stroke, lambda p: _xy(cell(p["x"]), cell(p["y"])))

    def split(c: Column) -> Column:
        moved = F.filter(c, lambda p, i: (i == 0) | (p != F.get(c, i - 1)))

        def steps(m: Column) -> Column:
            def between(p: Column, i: Column) -> Column:
                def parts(a: Column) -> Column:
                    dx, dy = p["x"] - a["x"], p["y"] - a["y"]
                    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(dx), F.abs(dy)) / STEP_LIMIT)).cast("int")
                    return F.transform(F.sequence(F.lit(1), n), lambda k: _xy((a["x"] + F.rint(dx * k / n)).cast("int"), (a["y"] + F.rint(dy * k / n)).cast("int")))

                return F.when(i == 0, F.array(p)).otherwise(let(F.get(m, i - 1), parts))

            return F.flatten(F.transform(m, between))

        return let(moved, steps)

    return let(cells, split)


def pack(strokes: Column, unit: float) -> Column:
    """Struct x0, y0 (smallint), stroke_len (int), dx, dy (tinyint) and unit. Starts out of range raise an error."""
    cells = F.transform(F.filter(strokes, lambda s: F.size(s) > 0), lambda s: quantize(s, unit))

    def columns(c: Column) -> Column:
        step = lambda k: F.flatten(F.transform(c, lambda s: F.coalesce(pairs(s, lambda a, b: b[k] - a[k]), F.array().cast("array<int>")))).cast("array<tinyint>")
        start = lambda k: F.transform(c, lambda s: s[0][k]).cast("array<smallint>")
        return F.struct(start("x").alias("x0"), start("y").alias("y0"), F.transform(c, F.size).alias("stroke_len"), step("x").alias("dx"), step("y").alias("dy"), F.lit(unit).alias("unit"))

    return let(cells, columns)


def lifts_per_letter(points: Column, text: Column) -> Column:
    return (F.size(to_strokes(points)) - 1) / F.greatest(F.length(text), F.lit(1))


def wrapped(angle: Column) -> Column:
    """An angle difference brought to [-pi, pi)."""
    two_pi = 2 * 3.141592653589793
    return angle - two_pi * F.floor((angle + two_pi / 2) / two_pi)


def affine(strokes: Column, a: Column, b: Column, c: Column, d: Column, dx: Column, dy: Column) -> Column:
    """x' = a x + b y + dx, y' = c x + d y + dy."""
    return map_points(strokes, lambda p: _xy(a * p["x"] + b * p["y"] + dx, c * p["x"] + d * p["y"] + dy))


def svg(strokes: Column, pad: float = 0.05) -> Column:
    """An SVG document: one path a stroke, dots widened by 0.01."""
    number = lambda v: F.format_string("%.4f", v)

    def path(s: Column) -> Column:
        dots = F.when(F.size(s) == 1, F.concat(s, F.transform(s, lambda p: _xy(p["x"] + 0.01, p["y"])))).otherwise(s)
        return F.concat(F.lit('<path d="M'), F.array_join(F.transform(dots, lambda p: F.concat(number(p["x"]), F.lit(" "), number(p["y"]))), " L"), F.lit('"/>'))

    def whole(b: Column) -> Column:
        box = F.concat_ws(" ", number(b["x0"] - pad), number(b["y0"] - pad), number(b["x1"] - b["x0"] + 2 * pad), number(b["y1"] - b["y0"] + 2 * pad))
        paths = F.array_join(F.transform(F.filter(strokes, lambda s: F.size(s) > 0), path), "")
        return F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="'), box, F.lit('"><g fill="none" stroke="black">'), paths, F.lit("</g></svg>"))

    return let(bounds(strokes), whole)
