"""The packed stroke format: one row a drawing, a start per stroke and small integer steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strokelake.functions import geometry as g

# The format's columns.
PACKED = ("x0", "y0", "stroke_len", "dx", "dy", "unit")


def pack(ink: DataFrame, unit: float) -> DataFrame:
    """Replaces `strokes` (and `points`, if there) by the packed columns."""
    return ink.withColumn("_p", g.pack(F.col("strokes"), unit)).select(*[c for c in ink.columns if c not in ("strokes", "points")], "_p.*")


def unpack(packed: DataFrame) -> DataFrame:
    """Rows (id, stroke, pos, x, y): running sums of the steps from each start, times the unit.

    A stroke's steps start after those of the strokes before it, less one step a stroke.
    """
    starts = F.transform(F.sequence(F.lit(0), F.size("stroke_len") - 1), lambda i: F.aggregate(F.slice("stroke_len", F.lit(1), i), F.lit(0), lambda a, x: a + x) - i)

    def one(at, i):
        n = F.get(F.col("stroke_len"), i) - 1
        return F.struct(F.get(F.col("x0"), i).cast("int").alias("x0"), F.get(F.col("y0"), i).cast("int").alias("y0"),
                        F.concat(F.array(F.lit(0)), F.slice("dx", at + 1, n).cast("array<int>")).alias("dx"), F.concat(F.array(F.lit(0)), F.slice("dy", at + 1, n).cast("array<int>")).alias("dy"))

    strokes = packed.where(F.size("stroke_len") > 0).select("id", "unit", F.posexplode(F.transform(starts, one)).alias("stroke", "s"))
    steps = strokes.select("id", "unit", "stroke", "s.x0", "s.y0", F.posexplode(F.arrays_zip(F.col("s.dx").alias("dx"), F.col("s.dy").alias("dy"))).alias("pos", "d"))
    run = Window.partitionBy("id", "stroke").orderBy("pos")
    return steps.select("id", "stroke", "pos", ((F.col("x0") + F.sum("d.dx").over(run)) * F.col("unit")).alias("x"), ((F.col("y0") + F.sum("d.dy").over(run)) * F.col("unit")).alias("y"))
