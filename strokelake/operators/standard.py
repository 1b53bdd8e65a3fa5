"""Ink of many frames (sheets, writers) brought to one size: the x-height is measured, the ink scaled, measured again after
resampling and corrected, then resampled by arc length and rounded.

Ink has rows (frame, id, text, strokes); ids are unique within a frame, a null frame is a frame of its own. Null texts are
empty, and ink without points is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strokelake.functions import geometry as g
from strokelake.functions.arrays import let
from strokelake.operators import resample, spline
from strokelake.operators.quality import INK_HEIGHT, X_HEIGHT
from strokelake.operators.sampling import percentiles
from strokelake.sources.scratch import written

# Letters that fill the x-height alone, the spacing of points, and how many measures a frame's median needs.
SHORT = "acemnorsuvwxz"
SPACING = 0.01
LEAST = {"words": 5, "letters": 5, "band": 3, "ink": 1}


def quantile_span(values: Column, low: float, high: float) -> Column:
    """Distance of two quantiles of an array, linear between neighbours."""

    def at(v: Column, share: float) -> Column:
        place = share * (F.size(v) - 1)
        before = F.floor(place).cast("int")
        return F.get(v, before) + (F.coalesce(F.get(v, before + 1), F.get(v, before)) - F.get(v, before)) * (place - before)

    return let(F.sort_array(values), lambda v: at(v, high) - at(v, low))


def _heights(strokes: Column) -> Column:
    return F.transform(F.flatten(strokes), lambda p: p["y"])


def _short(least: int) -> Column:
    return F.coalesce(F.col("text"), F.lit("")).rlike(f"^[{SHORT}]{{{least},}}$")


def _medians(measures: DataFrame) -> DataFrame:
    """Rows (frame, kind, median) of measures (frame, kind, h), of kinds with enough of them and a median over zero."""
    measures = written(measures.where("h IS NOT NULL").select(F.struct("frame", "kind").alias("_f"), "h"))
    need = F.create_map(*[F.lit(x) for pair in LEAST.items() for x in pair])
    counts = measures.groupBy(F.col("_f").alias("_c")).agg(F.count("*").alias("n")).where(F.col("n") >= need[F.col("_c.kind")])
    middle = percentiles(measures, "_f", "h", [0.5]).join(counts, F.col("_f").eqNullSafe(F.col("_c")))
    return middle.select("_f.frame", "_f.kind", F.col("q")[0].alias("median")).where("median > 0 OR kind = 'ink'")


def band_heights(ink: DataFrame, bins: int = 40, share: float = 0.25) -> DataFrame:
    """Rows (frame, h): height of the fullest band of each ink, its segments cut to a 200th of the ink's height before."""
    y = _heights(F.col("strokes"))
    step = F.greatest(F.array_max(y) - F.array_min(y), F.lit(1e-6)) / 200
    dense = ink.select(F.struct("frame", "id").alias("id"), g.to_strokes(resample.filled(g.to_points(F.col("strokes")), step)).alias("strokes"))
    size = dense.select(F.col("id").alias("_i"), ((F.array_max(y) - F.array_min(y)) / bins).alias("_size"))
    found = resample.core_band(dense, bins, share).join(size, F.col("id").eqNullSafe(F.col("_i")))
    return found.select("id.frame", ((F.col("high_bin") - F.col("low_bin") + 1) * F.col("_size")).alias("h"))


def frame_scales(ink: DataFrame, letters: str | None = None, spacing: float = SPACING) -> DataFrame:
    """Rows (frame, how, scale). A frame is measured by its words of short letters (five or more), else by heights of single
    letters (`letters` names an array of them), else by the bands of its lower-case inks (three or more), else by whole ink.

    Ink scaled by words or letters is resampled and measured again, and the scale corrected by what is found, since
    smoothing and resampling move the extremes. Bands and whole ink are measured in frames alone that have nothing better.
    """
    ink = ink.where(F.size(F.flatten("strokes")) > 0)
    measures = ink.where(_short(2)).select("frame", F.lit("words").alias("kind"), quantile_span(_heights(F.col("strokes")), 0.02, 0.98).alias("h"))
    if letters:
        measures = measures.unionByName(ink.select("frame", F.lit("letters").alias("kind"), F.explode(letters).alias("h")))
    first = _medians(measures).groupBy("frame").agg(F.max_by("median", "kind").alias("median"), F.max("kind").alias("how"))  # "words" over "letters"
    first = written(first.select("frame", "how", (X_HEIGHT / F.col("median")).alias("scale")))
    known = first.select(F.col("frame").alias("_f"), F.col("how").alias("_how"), F.col("scale").alias("_scale"))

    trial = ink.where(_short(1)).join(known, F.col("frame").eqNullSafe(F.col("_f"))).where((F.col("_how") == "letters") | _short(2))
    scaled = trial.select("frame", "id", g.map_points(F.col("strokes"), lambda p: F.struct((p["x"] * F.col("_scale")).alias("x"), (p["y"] * F.col("_scale")).alias("y"))).alias("strokes"))
    spans = written(spline.drawn(scaled, spacing).select("frame", quantile_span(_heights(F.col("strokes")), 0.02, 0.98).alias("h")))
    got = percentiles(spans, "frame", "h", [0.5]).select(F.col("frame").alias("_f"), F.col("q")[0].alias("_got"))
    better = first.join(got, F.col("frame").eqNullSafe(F.col("_f")), "left")
    better = better.select("frame", "how", (F.col("scale") * F.when(F.col("_got") > 0, X_HEIGHT / F.col("_got")).otherwise(1.0)).alias("scale"))

    rest = written(ink.join(known, F.col("frame").eqNullSafe(F.col("_f")), "left_anti"))  # else bands are filtered, and so taken, before the join
    lower = rest.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{Ll}"))
    measures = band_heights(lower).select("frame", F.lit("band").alias("kind"), "h").unionByName(
        rest.select("frame", F.lit("ink").alias("kind"), quantile_span(_heights(F.col("strokes")), 0.05, 0.95).alias("h")))
    size = F.when(F.col("kind") == "band", X_HEIGHT / F.col("median")).otherwise(INK_HEIGHT / F.greatest("median", F.lit(1e-9)))
    other = _medians(measures).groupBy("frame").agg(F.min("kind").alias("how"), F.min_by(size, "kind").alias("scale"))  # "band" over "ink"
    return better.unionByName(other.select("frame", "how", "scale"))


def standardised(ink: DataFrame, scales: DataFrame, baseline: str | None = None, spacing: float = SPACING) -> DataFrame:
    """Rows (frame, id, stroke, j, x, y): ink by its frame's scale, first point at x 0, baseline at 0, resampled, five places.

    The baseline is the column named, where it is not null, else the lowest window of an x-height (two for ink without
    lower-case letters) that is nearly as full as the fullest.
    """
    own = scales.select(F.col("frame").alias("_f"), F.col("scale").alias("_k"))
    placed = ink.where(F.size(F.flatten("strokes")) > 0).join(own, F.col("frame").eqNullSafe(F.col("_f")))
    tall = X_HEIGHT / F.col("_k") * F.when(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{Ll}"), 1).otherwise(2)
    found = resample.lowest_full_window(F.col("strokes"), tall)
    y0 = F.coalesce(F.col(baseline), found) if baseline else found
    placed = placed.select("frame", "id", "strokes", F.struct(F.get(F.flatten("strokes"), F.lit(0))["x"].alias("x"), y0.alias("y"), F.col("_k").alias("k")).alias("_o"))
    scaled = let(F.col("_o"), lambda o: g.map_points(F.col("strokes"), lambda p: F.struct(((p["x"] - o["x"]) * o["k"]).alias("x"), ((p["y"] - o["y"]) * o["k"]).alias("y"))))
    out = spline.drawn(placed.select("frame", "id", scaled.alias("strokes")), spacing)
    each = out.select("frame", "id", F.posexplode("strokes").alias("stroke", "s")).select("frame", "id", "stroke", F.posexplode("s").alias("j", "p"))
    return each.select("frame", "id", "stroke", "j", F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))
