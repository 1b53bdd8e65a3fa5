"""The polar tokenizer: thinned points as a token pair of angle and radius."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strokelake.functions.arrays import indices, let

N_ANGLES = 220
# Fixed values, by rule: evenly spaced angles; radii 0, 30 linear ones, 120 geometric ones.
ANGLES = [-math.pi + 2 * math.pi * i / (N_ANGLES - 1) for i in range(N_ANGLES)]
RADII = [0.0, *np.linspace(1e-4, 0.060, 30).tolist(), *np.geomspace(0.06001, 0.90, 120).tolist()]


def thin(points: Column, k: int) -> Column:
    """Keeps pen-up points, every k-th point since a stroke's start, the point before a pen-up, and the last."""

    def kept(p: Column) -> Column:
        starts = F.filter(indices(p), lambda i: (i == 0) | (F.get(p, i - 1)["pen"] != 1))

        def keep(i: Column) -> Column:
            start = F.array_max(F.filter(starts, lambda s: s <= i))
            nxt = F.get(p, i + 1)
            return (F.get(p, i)["pen"] != 1) | ((i - start) % k == 0) | nxt.isNull() | (nxt["pen"] != 1)

        return F.transform(F.filter(indices(p), keep), lambda i: F.get(p, i))

    return let(points, kept)


def nearest(value: Column, bins: list[float]) -> Column:
    """Number of the nearest bin of an ascending list; a tie goes to the upper one."""
    middles = F.array(*[F.lit((a + b) / 2) for a, b in zip(bins, bins[1:], strict=False)])
    return F.size(F.filter(middles, lambda m: m <= value))


def steps(points: Column, k: int) -> Column:
    """Structs (angle, radius) of the displacements from the kept point before (the origin first)."""

    def token(d: Column) -> Column:
        radius = N_ANGLES + nearest(F.hypot(d["dx"], d["dy"]), RADII) + len(RADII) * (d["pen"] != 1).cast("int")
        return F.struct(nearest(F.atan2(d["dy"], d["dx"]), ANGLES).alias("angle"), radius.alias("radius"))

    def moved(p: Column) -> Column:
        before = lambda i, c: F.coalesce(F.get(p, i - 1)[c], F.lit(0.0))
        return F.transform(p, lambda q, i: let(F.struct((q["x"] - before(i, "x")).alias("dx"), (q["y"] - before(i, "y")).alias("dy"), q["pen"].alias("pen")), token))

    return let(thin(points, k), moved)


def tokens(points: Column, k: int) -> Column:
    """One array of angle and radius in turn."""
    return F.flatten(F.transform(steps(points, k), lambda d: F.array(d["angle"], d["radius"])))


def encode(ink: DataFrame, k: int) -> DataFrame:
    """Rows (id, pos, angle, radius)."""
    return ink.select("id", F.posexplode(steps(F.col("points"), k)).alias("pos", "d")).select("id", "pos", "d.*")


def decode(tokens: DataFrame) -> DataFrame:
    """Rows (id, pos, x, y, pen) from rows (id, pos, angle, radius)."""
    r = F.col("radius") - N_ANGLES
    radius = F.get(F.array(*[F.lit(v) for v in RADII]), (r % len(RADII)).cast("int"))
    angle = F.get(F.array(*[F.lit(v) for v in ANGLES]), F.col("angle").cast("int"))
    w = Window.partitionBy("id").orderBy("pos")
    return tokens.select("id", "pos", F.sum(radius * F.cos(angle)).over(w).alias("x"), F.sum(radius * F.sin(angle)).over(w).alias("y"), F.when(r >= len(RADII), 0).otherwise(1).alias("pen"))
