"""Queries on stroke geometry and the packed format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokelake.functions import geometry as g
from strokelake.functions.arrays import total
from strokelake.operators import codec, resample
from strokelake.plans.adapters import PTS, STK, exploded, ink_events, ink_points, ink_strokes
from strokelake.plans.registry import query

BOX = "box AS (SELECT id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM stk GROUP BY id)"


@query(f"WITH {STK} SELECT id, stroke, pos, round(x, 6) AS x, round(y, 6) AS y FROM stk")
def b05_to_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(ink_strokes(spark, sf_dir))


@query(f"""WITH {STK}, {BOX} SELECT stk.id, stroke, pos, round((x - x0) / greatest(x1 - x0, y1 - y0), 6) AS x, round((y - y0) / greatest(x1 - x0, y1 - y0), 6) AS y
FROM stk JOIN box ON stk.id = box.id WHERE greatest(x1 - x0, y1 - y0) > 0""")
def b01_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(ink_strokes(spark, sf_dir).withColumn("strokes", g.normalize(F.col("strokes"))))


LENGTHS = "seg AS (SELECT id, stroke, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS d FROM stk WINDOW w AS (PARTITION BY id, stroke ORDER BY pos))"


@query(f"WITH {STK}, {LENGTHS} SELECT id, round(coalesce(sum(d), 0), 6) AS ink FROM seg GROUP BY id")
def b02_ink_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ink_strokes(spark, sf_dir).where(F.size("strokes") > 0)
    return words.select("id", F.round(g.ink_length(F.col("strokes")), 6).alias("ink"))


UNIT = 0.002
QUANTIZED = f"""
cells AS (SELECT id, stroke, pos, round_even(x / {UNIT}, 0)::INT AS cx, round_even(y / {UNIT}, 0)::INT AS cy FROM stk),
moved AS (SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM cells WINDOW w AS (PARTITION BY id, stroke ORDER BY pos)),
kept AS (SELECT *, CASE WHEN px IS NULL THEN 1 ELSE greatest(1, ceil(greatest(abs(cx - px), abs(cy - py)) / 127.0)) END::INT AS n FROM moved WHERE px IS NULL OR cx <> px OR cy <> py),
parts AS (SELECT *, unnest(range(1, n + 1)) AS k FROM kept),
quant AS (SELECT id, stroke, (row_number() OVER (PARTITION BY id, stroke ORDER BY pos, k) - 1)::INT AS pos,
  CASE WHEN px IS NULL THEN cx ELSE px + round_even((cx - px) * k / n::DOUBLE, 0) END::INT AS x, CASE WHEN px IS NULL THEN cy ELSE py + round_even((cy - py) * k / n::DOUBLE, 0) END::INT AS y FROM parts)"""


@query(f"WITH {STK}, {QUANTIZED} SELECT id, stroke, pos, x, y FROM quant")
def b03_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.transform("strokes", lambda s: g.quantize(s, UNIT))
    rows = ink_strokes(spark, sf_dir).select("id", F.posexplode(cells).alias("stroke", "s")).select("id", "stroke", F.posexplode("s").alias("pos", "p"))
    return rows.select("id", "stroke", "pos", "p.x", "p.y")


@query(f"""WITH {STK}, lifted AS (SELECT id, stroke, pos, x, y, 1 AS pen FROM stk UNION ALL
  SELECT id, stroke, max(pos) + 1, arg_max(x, pos), arg_max(y, pos), 0 FROM stk GROUP BY id, stroke)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY stroke, pos) - 1)::INT AS pos, round(x, 6) AS x, round(y, 6) AS y, pen FROM lifted""")
def b04_to_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ink_strokes(spark, sf_dir).select("id", F.posexplode(g.to_points(F.col("strokes"))).alias("pos", "p"))
    return rows.select("id", "pos", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"), "p.pen")


@query(f"WITH {STK}, {BOX} SELECT stk.id, stroke, pos, round(x - (x0 + x1) / 2, 7) AS x, round(y - (y0 + y1) / 2, 7) AS y FROM stk JOIN box ON stk.id = box.id")
def b06_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(ink_strokes(spark, sf_dir).withColumn("strokes", g.centred(F.col("strokes"))), places=7)


@query(f"""WITH {STK}, {LENGTHS}, {BOX}, l AS (SELECT id, coalesce(sum(d), 0) AS ink, count(DISTINCT stroke) AS n FROM seg GROUP BY id)
SELECT words.id, round(CASE WHEN greatest(x1 - x0, y1 - y0) > 0 THEN ink / greatest(x1 - x0, y1 - y0) ELSE 0 END, 6) AS ink, coalesce(n, 0)::INT AS strokes
FROM words LEFT JOIN l ON words.id = l.id LEFT JOIN box ON words.id = box.id""")
def b07_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ink_events(spark, sf_dir).select("id", g.measure(F.col("points")).alias("m"))
    return m.select("id", F.round("m.ink", 6).alias("ink"), "m.strokes")


@query(f"""WITH {STK}, n AS (SELECT *, count(*) OVER (PARTITION BY id, stroke) AS c, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM stk
  WINDOW w AS (PARTITION BY id, stroke ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT id, stroke, pos, round(CASE WHEN pos > 0 AND pos < c - 1 THEN mx ELSE x END, 6) AS x, round(CASE WHEN pos > 0 AND pos < c - 1 THEN my ELSE y END, 6) AS y FROM n""")
def b10_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(ink_strokes(spark, sf_dir).withColumn("strokes", g.smooth(F.col("strokes"))))


STEP = 0.05


@query(f"""WITH {PTS}, nx AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM pts WINDOW w AS (PARTITION BY id ORDER BY seq)),
c AS (SELECT *, CASE WHEN x2 IS NULL OR pen <> 1 THEN 1 ELSE greatest(1, ceil(sqrt(power(x2 - x, 2) + power(y2 - y, 2)) / {STEP})) END::INT AS n FROM nx),
e AS (SELECT *, unnest(range(n)) AS j FROM c)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY seq, j) - 1)::INT AS pos, round(x + coalesce((x2 - x) * j / n, 0), 10) AS x, round(y + coalesce((y2 - y) * j / n, 0), 10) AS y, pen FROM e""")
def b08_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resample.densify(ink_events(spark, sf_dir), STEP)
    return rows.select("id", "pos", F.round("x", 10).alias("x"), F.round("y", 10).alias("y"), "pen")


@query(f"""WITH {STK}, placed AS (SELECT id, (row_number() OVER (ORDER BY id) - 1)::BIGINT AS k FROM words)
SELECT stk.id, stroke, pos, round(x + (k % 40) * 1.2, 6) AS x, round(y + (k // 40) * 1.2, 6) AS y FROM stk JOIN placed ON stk.id = placed.id""")
def b16_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(resample.sheet(ink_strokes(spark, sf_dir), columns=40, gap=0.2))


@query(f"""WITH {STK}, s AS (SELECT id, count(DISTINCT stroke) AS n FROM stk GROUP BY id),
h AS (SELECT id, stroke, pos, atan2(y - lag(y) OVER w, x - lag(x) OVER w) AS a FROM stk WINDOW w AS (PARTITION BY id, stroke ORDER BY pos)),
d AS (SELECT id, stroke, pos, a - lag(a) OVER (PARTITION BY id, stroke ORDER BY pos) AS raw FROM h WHERE a IS NOT NULL),
t AS (SELECT id, stroke, pos, raw - 2 * pi() * floor((raw + pi()) / (2 * pi())) AS turn FROM d WHERE raw IS NOT NULL),
c AS (SELECT id, abs(turn - lag(turn) OVER (PARTITION BY id, stroke ORDER BY pos)) AS bend FROM t)
SELECT words.id, round((coalesce(n, 0) - 1) / length(label), 6) AS lifts, round((SELECT avg(bend) FROM c WHERE c.id = words.id), 6) AS jerk FROM words LEFT JOIN s ON words.id = s.id""")
def b17_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ink_strokes(spark, sf_dir)
    rows = resample.bend(words)
    lifts = words.select("id", F.round(g.lifts_per_letter(F.col("points"), F.col("label")), 6).alias("lifts"))
    return lifts.join(rows, "id", "left").select("id", "lifts", F.round("jerk", 6).alias("jerk"))


@query(f"""WITH {STK} SELECT id, stroke, pos, round((1.1 * cos(0.1) + 0.2 * -sin(0.1)) * x + (1.1 * -sin(0.1) + 0.2 * cos(0.1)) * y + 0.03, 6) AS x,
  round(sin(0.1) * x + cos(0.1) * y - 0.01, 6) AS y FROM stk""")
def b12_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = F.cos(F.lit(0.1)), F.sin(F.lit(0.1))
    moved = g.affine(F.col("strokes"), 1.1 * c - 0.2 * s, -1.1 * s + 0.2 * c, s, c, F.lit(0.03), F.lit(-0.01))
    return exploded(ink_strokes(spark, sf_dir).withColumn("strokes", moved))


@query(f"""WITH {STK}, {QUANTIZED}, p AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM quant WINDOW w AS (PARTITION BY id, stroke ORDER BY pos))
SELECT id, count(DISTINCT stroke)::INT AS strokes, count(*)::BIGINT AS points, sum(CASE WHEN pos = 0 THEN x END)::BIGINT AS x0, sum(CASE WHEN pos = 0 THEN y END)::BIGINT AS y0,
  coalesce(sum(abs(x - px)), 0)::BIGINT AS dx, coalesce(sum(abs(y - py)), 0)::BIGINT AS dy FROM p GROUP BY id""")
def a03_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = codec.pack(ink_strokes(spark, sf_dir).where(F.size("strokes") > 0), UNIT)
    whole = lambda c: total(F.transform(c, lambda v: F.abs(v.cast("double")))).cast("bigint")
    signed = lambda c: total(F.transform(c, lambda v: v.cast("double"))).cast("bigint")
    return packed.select("id", F.size("x0").alias("strokes"), total(F.col("stroke_len").cast("array<double>")).cast("bigint").alias("points"), signed("x0").alias("x0"), signed("y0").alias("y0"),
                         whole("dx").alias("dx"), whole("dy").alias("dy"))


@query(f"WITH {STK}, {QUANTIZED} SELECT id, stroke, pos, round(x * {UNIT}::DOUBLE, 6) AS x, round(y * {UNIT}::DOUBLE, 6) AS y FROM quant")
def a04_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = codec.pack(ink_strokes(spark, sf_dir).where(F.size("strokes") > 0), UNIT)
    return codec.unpack(packed).select("id", "stroke", "pos", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"""WITH {STK}, b AS (SELECT id, least(19, floor((y - min(y) OVER (PARTITION BY id)) / ((max(y) OVER (PARTITION BY id) - min(y) OVER (PARTITION BY id)) / 20)))::INT AS bin,
  max(y) OVER (PARTITION BY id) > min(y) OVER (PARTITION BY id) AS ok FROM stk),
c AS (SELECT id, bin, count(*) AS n FROM b WHERE ok GROUP BY id, bin), grid AS (SELECT DISTINCT id, unnest(range(20)) AS bin FROM c),
f AS (SELECT grid.id, grid.bin, coalesce(n, 0) AS n FROM grid LEFT JOIN c ON grid.id = c.id AND grid.bin = c.bin),
s AS (SELECT id, bin, (coalesce(lag(n) OVER w, 0) + n + coalesce(lead(n) OVER w, 0)) / 3.0::DOUBLE AS v FROM f WINDOW w AS (PARTITION BY id ORDER BY bin)),
p AS (SELECT id, max(v) AS peak, arg_min(bin, struct_pack(a := -v, b := bin)) AS top FROM s GROUP BY id)
SELECT p.id, top AS peak_bin, (SELECT coalesce(max(bin) + 1, 0) FROM s WHERE s.id = p.id AND bin < top AND v < 0.4 * peak) AS low_bin,
  (SELECT coalesce(min(bin) - 1, 19) FROM s WHERE s.id = p.id AND bin > top AND v < 0.4 * peak) AS high_bin FROM p""")
def b13_core_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.core_band(ink_strokes(spark, sf_dir), bins=20, share=0.4)


@query(f"""WITH RECURSIVE {PTS}, w AS (SELECT id, writer, max(x) - min(x) AS width, split_part(id, '/', 3)::INT AS k FROM pts GROUP BY id, writer),
r AS (SELECT id, writer, k, width, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y FROM w WHERE k = 0 UNION ALL
  SELECT w.id, w.writer, w.k, w.width, CASE WHEN r.x + r.width + 0.1 + w.width > 1.5 THEN 0 ELSE r.x + r.width + 0.1 END,
  CASE WHEN r.x + r.width + 0.1 + w.width > 1.5 THEN r.y + 0.5 ELSE r.y END FROM r JOIN w ON w.writer = r.writer AND w.k = r.k + 1)
SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM r""")
def b15_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ink_points(spark, sf_dir).groupBy("id", "writer").agg((F.max("x") - F.min("x")).alias("width"))
    placed = resample.layout(words.withColumn("place", F.split("id", "/")[2].cast("int")), width=1.5, pitch=0.5, gap=0.1)
    return placed.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"""WITH {STK}, {LENGTHS}, l AS (SELECT id, sum(d) AS ink, count(*) AS points, count(DISTINCT stroke) AS strokes FROM seg GROUP BY id)
SELECT writer, count(*) AS words, coalesce(sum(strokes), 0)::BIGINT AS strokes, coalesce(sum(points), 0)::BIGINT AS points, round(coalesce(sum(ink), 0), 6) AS ink FROM words LEFT JOIN l ON words.id = l.id GROUP BY writer""")
def ink_by_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.ink_by_writer(ink_strokes(spark, sf_dir))
    return out.select("writer", "words", "strokes", "points", F.round("ink", 6).alias("ink"))
