"""Views of the given tables as ink: Spark DataFrames, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strokelake.functions import geometry as g
from strokelake.plans.registry import table

POINTS_PER_WORD = 12


def ink_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (id, writer, seq, x, y, pen, letter): writers are users, words are twelve events in a row."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rn = F.row_number().over(order) - 1
    rows = table(spark, sf_dir, "events").select("user_id", "value", "event_type", rn.alias("rn"))
    word, seq = F.floor(F.col("rn") / POINTS_PER_WORD), F.col("rn") % POINTS_PER_WORD
    return rows.select(
        F.concat(F.lit("e/"), F.col("user_id").cast("string"), F.lit("/"), word.cast("string")).alias("id"), F.col("user_id").alias("writer"), seq.cast("int").alias("seq"),
        (seq * 0.02).alias("x"), (F.col("value") / 400).alias("y"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("pen"),
        F.substring("event_type", 1, 1).alias("letter"))


def ink_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (id, writer, label, points), one per word."""
    rows = ink_points(spark, sf_dir).groupBy("id", "writer").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y", "pen", "letter"))).alias("p"))
    points = F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), q["pen"].alias("pen")))
    return rows.select("id", "writer", F.array_join(F.transform("p", lambda q: q["letter"]), "").alias("label"), points.alias("points"))


def ink_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (id, writer, label, points, strokes)."""
    return ink_events(spark, sf_dir).withColumn("strokes", g.to_strokes(F.col("points")))


def exploded(df: DataFrame, strokes: str = "strokes", places: int = 6) -> DataFrame:
    """Rows (id, stroke, pos, x, y), coordinates rounded."""
    each = df.select("id", F.posexplode(strokes).alias("stroke", "s")).select("id", "stroke", F.posexplode("s").alias("pos", "p"))
    return each.select("id", "stroke", "pos", F.round("p.x", places).alias("x"), F.round("p.y", places).alias("y"))


# The same in SQL. pts has a row per event, stk one per point with pen 1, with its stroke and its place in it.
PTS = """
ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events),
pts AS (SELECT 'e/' || user_id || '/' || (rn // 12) AS id, user_id AS writer, (rn % 12)::INT AS seq, (rn % 12) * 0.02::DOUBLE AS x, value / 400 AS y,
  CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS pen, substr(event_type, 1, 1) AS letter FROM ev),
words AS (SELECT id, any_value(writer) AS writer, string_agg(letter, '' ORDER BY seq) AS label FROM pts GROUP BY id)"""
STK = PTS + """,
runs AS (SELECT *, CASE WHEN pen = 1 AND coalesce(lag(pen) OVER (PARTITION BY id ORDER BY seq), 0) <> 1 THEN 1 ELSE 0 END AS starts FROM pts),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY seq) - 1 AS stroke FROM runs),
stk AS (SELECT id, writer, stroke::INT AS stroke, (row_number() OVER (PARTITION BY id, stroke ORDER BY seq) - 1)::INT AS pos, seq, x, y FROM numbered WHERE pen = 1)"""
