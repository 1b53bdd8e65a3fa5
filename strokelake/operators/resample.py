"""Operators that place, resample and measure ink row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strokelake.functions import geometry as g
from strokelake.functions.arrays import indices, let, total
from strokelake.operators.sampling import numbered


def filled(points: Column, step: float | Column) -> Column:
    """Pen-down segments cut into equal parts no longer than `step`; pen-up ones stay."""

    def whole(p: Column) -> Column:
        def parts(q, i):
            nxt = F.get(p, i + 1)
            n = F.when(nxt.isNull() | (q["pen"] != 1), 1).otherwise(F.greatest(F.lit(1), F.ceil(F.hypot(nxt["x"] - q["x"], nxt["y"] - q["y"]) / step).cast("int")))
            at = lambda k, j, m: q[k] + F.coalesce((nxt[k] - q[k]) * j / m, F.lit(0.0))
            return let(n, lambda m: F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.struct(at("x", j, m).alias("x"), at("y", j, m).alias("y"), q["pen"].alias("pen"))))

        return F.flatten(F.transform(p, parts))

    return let(points, whole)


def densify(ink: DataFrame, step: float) -> DataFrame:
    """Rows (id, pos, x, y, pen) of filled points."""
    return ink.select("id", F.posexplode(filled(F.col("points"), step)).alias("pos", "p")).select("id", "pos", "p.*")


def sheet(ink: DataFrame, columns: int, gap: float) -> DataFrame:
    """Drawings in order of id on a grid of unit cells."""
    ids = numbered(ink.select("id"), [F.col("id")])
    moved = ink.join(ids, "id")
    pitch = 1 + gap
    shift_x, shift_y = (F.col("number") % columns) * pitch, F.floor(F.col("number") / columns) * pitch
    return moved.withColumn("strokes", g.map_points(F.col("strokes"), lambda p: F.struct((p["x"] + shift_x).alias("x"), (p["y"] + shift_y).alias("y")))).drop("number")


def bend(ink: DataFrame) -> DataFrame:
    """Rows (id, jerk): mean absolute change of turning along the strokes, turns brought to [-pi, pi)."""
    p = ink.select("id", F.posexplode("strokes").alias("stroke", "s")).select("id", "stroke", F.posexplode("s").alias("pos", "p"))
    w = Window.partitionBy("id", "stroke").orderBy("pos")
    heading = F.atan2(F.col("p.y") - F.lag("p.y").over(w), F.col("p.x") - F.lag("p.x").over(w))
    h = p.select("id", "stroke", "pos", heading.alias("h")).where("h IS NOT NULL")
    t = h.withColumn("turn", g.wrapped(F.col("h") - F.lag("h").over(w))).where("turn IS NOT NULL")
    return t.withColumn("change", F.abs(F.col("turn") - F.lag("turn").over(w))).groupBy("id").agg(F.avg("change").alias("jerk"))


def core_band(ink: DataFrame, bins: int, share: float) -> DataFrame:
    """Rows (id, peak_bin, low_bin, high_bin): a smoothed height histogram, grown from its peak while above a share of it."""

    def found(y):
        low, high = F.array_min(y), F.array_max(y)

        def histogram(size):
            placed = F.transform(y, lambda v: F.least(F.lit(bins - 1), F.floor((v - low) / size).cast("int")))
            return let(placed, lambda b: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.size(F.filter(b, lambda x: x == k))))

        def grown(c):
            at = lambda i: F.coalesce(F.get(c, i), F.lit(0))
            smooth = F.transform(indices(c), lambda i: (at(i - 1) + at(i) + at(i + 1)) / 3.0)

            def spread(v):
                peak = F.array_max(v)
                top = (F.array_position(v, peak) - 1).cast("int")
                under = F.filter(indices(v), lambda i: F.get(v, i) < share * peak)
                return F.struct(top.alias("peak_bin"), F.coalesce(F.array_max(F.filter(under, lambda i: i < top)) + 1, F.lit(0)).alias("low_bin"),
                                F.coalesce(F.array_min(F.filter(under, lambda i: i > top)) - 1, F.lit(bins - 1)).alias("high_bin"))

            return let(smooth, spread)

        return F.when(high > low, let(histogram((high - low) / bins), grown))

    ys = F.transform(F.flatten("strokes"), lambda p: p["y"])
    return ink.where(F.size("strokes") > 0).select("id", let(ys, found).alias("b")).where("b IS NOT NULL").select("id", "b.*")


def layout(words: DataFrame, width: float, pitch: float, gap: float) -> DataFrame:
    """Rows (id, x, y) for rows (id, writer, place, width): each writer's words in lines, wrapped at `width`.

    Placing a word needs the one before it, so a writer's words (a page) are folded in order.
    """
    line = words.groupBy("writer").agg(F.sort_array(F.collect_list(F.struct("place", "id", "width"))).alias("w"))
    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.array().cast("array<struct<id:string,x:double,y:double>>").alias("out"))

    def put(a, w):
        first = F.size(a["out"]) == 0
        wraps = ~first & (a["x"] + gap + w["width"] > width)
        x = F.when(first | wraps, 0.0).otherwise(a["x"] + gap)
        y = F.when(wraps, a["y"] + pitch).otherwise(a["y"])
        return F.struct((x + w["width"]).alias("x"), y.alias("y"), F.concat(a["out"], F.array(F.struct(w["id"].alias("id"), x.alias("x"), y.alias("y")))).alias("out"))

    return line.select(F.inline(F.aggregate("w", start, put, lambda a: a["out"])))


def lowest_full_window(strokes: Column, height: float | Column, share: float = 0.95) -> Column:
    """Foot of the lowest window of `height` that holds at least `share` of the fullest window's points."""

    def of(y):
        tall = height if isinstance(height, Column) else F.lit(height)
        foot = lambda b, low: F.struct(b.alias("b"), F.size(F.filter(y, lambda v: (v > low) & (v <= b))).alias("n"))
        counts = let(tall, lambda h: F.transform(y, lambda b: let(b - h, lambda low: foot(b, low))))  # the height is computed once an ink
        return let(counts, lambda c: let(share * F.array_max(F.transform(c, lambda r: r["n"])), lambda least: F.array_max(F.transform(F.filter(c, lambda q: q["n"] >= least), lambda q: q["b"]))))

    return let(F.transform(F.flatten(strokes), lambda p: p["y"]), of)


def baseline(ink: DataFrame, height: float, share: float = 0.95) -> DataFrame:
    """Rows (id, baseline)."""
    return ink.select("id", lowest_full_window(F.col("strokes"), height, share).alias("baseline"))


def ink_by_writer(ink: DataFrame) -> DataFrame:
    """Rows (writer, words, strokes, points, ink): volumes of each writer."""
    length = g.ink_length(F.col("strokes"))
    points = total(F.transform("strokes", lambda s: F.size(s).cast("double")))
    return ink.groupBy("writer").agg(F.count("*").alias("words"), F.sum(F.size("strokes")).alias("strokes"), F.sum(points).cast("long").alias("points"), F.sum(length).alias("ink"))
