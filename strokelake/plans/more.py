"""Queries on splines, frames, trials and tasks."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokelake.functions.arrays import uniform
from strokelake.operators import augment, resample, spline, standard
from strokelake.operators import sampling as s
from strokelake.plans.adapters import PTS, STK, exploded, ink_events, ink_points, ink_strokes
from strokelake.plans.registry import query, table
from strokelake.plans.sampling import u
from strokelake.sources.scratch import written

PATH = f"""{STK}, dd AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS d FROM stk WINDOW w AS (PARTITION BY id, stroke ORDER BY pos)),
pn AS (SELECT id, stroke, x, y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY id, stroke) AS n, lag(x) OVER w AS xm, lag(y) OVER w AS ym, lead(x) OVER w AS xa, lead(y) OVER w AS ya,
  lead(x, 2) OVER w AS xb, lead(y, 2) OVER w AS yb FROM dd WHERE d IS NULL OR d >= 1e-9 WINDOW w AS (PARTITION BY id, stroke ORDER BY pos)),
cn AS (SELECT id, stroke, i, coalesce(xm, 2 * x - xa) AS x0, x AS x1, xa AS x2, coalesce(xb, 2 * xa - x) AS x3, coalesce(ym, 2 * y - ya) AS y0, y AS y1, ya AS y2, coalesce(yb, 2 * ya - y) AS y3, 0.0::DOUBLE AS t0 FROM pn WHERE n >= 3 AND xa IS NOT NULL),
k1 AS (SELECT *, sqrt(sqrt(power(x1 - x0, 2) + power(y1 - y0, 2))) AS t1 FROM cn), k2 AS (SELECT *, t1 + sqrt(sqrt(power(x2 - x1, 2) + power(y2 - y1, 2))) AS t2 FROM k1), k3 AS (SELECT *, t2 + sqrt(sqrt(power(x3 - x2, 2) + power(y3 - y2, 2))) AS t3 FROM k2),
sj AS (SELECT *, unnest(range(16)) AS j FROM k3), sg AS (SELECT *, t1 + (t2 - t1) * j / 16 AS t FROM sj),
path AS (SELECT id, stroke, i * 16 + j AS k, {spline.curve('x')} AS x, {spline.curve('y')} AS y FROM sg UNION ALL SELECT id, stroke, i * 16, x, y FROM pn WHERE n < 3 OR i = n - 1)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = ink_strokes(spark, sf_dir).select("id", F.posexplode("strokes").alias("stroke", "s")).select("id", "stroke", F.posexplode("s").alias("pos", "p"))
    return each.select("id", "stroke", "pos", "p.x", "p.y")


@query(f"WITH {PATH} SELECT id, stroke, k::INT AS k, round(x, 6) AS x, round(y, 6) AS y FROM path")
def b09_spline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spline.smooth_path(points(spark, sf_dir)).select("id", "stroke", F.col("k").cast("int").alias("k"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"""WITH {PATH}, q AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM path WINDOW w AS (PARTITION BY id, stroke ORDER BY k)),
r AS (SELECT *, coalesce(sqrt(power(nx - x, 2) + power(ny - y, 2)), 0) AS d FROM q), s AS (SELECT *, sum(d) OVER (PARTITION BY id, stroke) AS l FROM r)
SELECT id, stroke, CASE WHEN max(l) > 0 THEN greatest(1, round_even(max(l) / 0.02, 0)) ELSE 0 END::INT + 1 AS n FROM s GROUP BY id, stroke""")
def b09_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points a stroke after resampling; tests hold that they are evenly spaced."""
    out = spline.drawn(ink_strokes(spark, sf_dir).select("id", "strokes"), 0.02)
    return out.select("id", F.posexplode("strokes").alias("stroke", "s")).select("id", "stroke", F.size("s").alias("n"))


@query(f"""WITH {STK}, c AS (SELECT a.id, a.y AS b, count(*) AS n FROM stk a JOIN stk p ON a.id = p.id AND p.y > a.y - 0.5 AND p.y <= a.y GROUP BY a.id, a.stroke, a.pos, a.y), m AS (SELECT id, max(n) AS m FROM c GROUP BY id)
SELECT c.id, round(max(b), 6) AS baseline FROM c JOIN m ON c.id = m.id WHERE n >= 0.95 * m GROUP BY c.id""")
def b14_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resample.baseline(ink_strokes(spark, sf_dir).where(F.size("strokes") > 0), 0.5)
    return rows.select("id", F.round("baseline", 6).alias("baseline"))


@query()
def b11_alter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(augment.alter(ink_strokes(spark, sf_dir), swap=0.3))


@query(f"""WITH {STK}, f AS (SELECT writer, max(y) - min(y) AS ih, min(y) AS base FROM stk GROUP BY writer), o AS (SELECT id, arg_min(x, seq) AS x0 FROM stk GROUP BY id)
SELECT stk.id, stroke, pos, round((x - x0) * CASE WHEN f.writer % 2 = 0 THEN 0.123 / (ih / 2) ELSE 0.22 / ih END, 6) AS x, round((y - base) * CASE WHEN f.writer % 2 = 0 THEN 0.123 / (ih / 2) ELSE 0.22 / ih END, 6) AS y
FROM stk JOIN f ON stk.writer = f.writer JOIN o ON stk.id = o.id""")
def e06_standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = ink_points(spark, sf_dir).where("pen = 1").groupBy("writer").agg((F.max("y") - F.min("y")).alias("ink_height"), F.min("y").alias("baseline"))
    frames = each.withColumn("x_height", F.when(F.col("writer") % 2 == 0, F.col("ink_height") / 2))
    return exploded(augment.standardised(ink_strokes(spark, sf_dir).select("id", "writer", "strokes"), frames))


def resampled(name: str, scales: str) -> str:
    """SQL for the points (id, stroke, j, x, y) of the paths at the scales k of rows (id, k), resampled, still unscaled."""
    return f"""{name}l AS (SELECT id, stroke, l, k, CASE WHEN l > 0 THEN greatest(1, round_even(l * k / {standard.SPACING}, 0)) ELSE 0 END::INT AS n FROM ln JOIN {scales} USING (id)),
{name}s AS (SELECT id, stroke, j, least(l, l * j / greatest(n, 1)) AS s FROM (SELECT *, unnest(range(n + 1)) AS j FROM {name}l)),
{name} AS (SELECT t.id, t.stroke, t.j, x + coalesce((nx - x) * (s - lo) / d, 0) AS x, y + coalesce((ny - y) * (s - lo) / d, 0) AS y FROM {name}s t ASOF JOIN dn ON t.id = dn.id AND t.stroke = dn.stroke AND t.s >= dn.lo)"""


@query(f"""WITH {PATH}, st AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM path WINDOW w AS (PARTITION BY id, stroke ORDER BY k)),
sd AS (SELECT *, sqrt(power(nx - x, 2) + power(ny - y, 2)) AS d FROM st), ln AS (SELECT id, stroke, coalesce(sum(d), 0) AS l FROM sd GROUP BY ALL),
dn AS (SELECT id, stroke, x, y, nx, ny, d, coalesce(sum(d) OVER (PARTITION BY id, stroke ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM sd),
wd AS (SELECT id, writer % 5 AS frame, CASE WHEN writer % 5 = 0 THEN upper(label[1:2]) ELSE label[1:2] END AS text FROM words),
sh AS (SELECT id, quantile_cont(y, 0.98) - quantile_cont(y, 0.02) AS h, quantile_cont(y, 0.95) - quantile_cont(y, 0.05) AS ih, arg_min(x, seq) AS x0 FROM stk GROUP BY id),
ws AS (SELECT *, regexp_full_match(text, '[{standard.SHORT}]{{2,}}') AS short FROM wd JOIN sh USING (id)),
f1 AS (SELECT frame, CASE WHEN count(*) FILTER (short) >= 5 THEN 'words' ELSE 'ink' END AS how, CASE WHEN count(*) FILTER (short) >= 5 THEN 0.123 / median(h) FILTER (short) ELSE 0.22 / greatest(median(ih), 1e-9) END AS k FROM ws GROUP BY frame),
tr AS (SELECT id, k FROM ws JOIN f1 USING (frame) WHERE short AND how = 'words'), {resampled('ta', 'tr')},
tm AS (SELECT frame, median(h) AS got FROM (SELECT id, k * (quantile_cont(y, 0.98) - quantile_cont(y, 0.02)) AS h FROM ta JOIN tr USING (id) GROUP BY id, k) JOIN wd USING (id) GROUP BY frame),
f2 AS (SELECT frame, how, k * coalesce(0.123 / got, 1) AS k FROM f1 LEFT JOIN tm USING (frame)),
fk AS (SELECT id, x0, how, k, 0.123 / k * CASE WHEN text = upper(text) THEN 2 ELSE 1 END AS tall FROM ws JOIN f2 USING (frame)),
ct AS (SELECT a.id, a.y AS b, count(*) AS n FROM stk a JOIN fk USING (id) JOIN stk p ON a.id = p.id AND p.y > a.y - tall AND p.y <= a.y GROUP BY a.id, a.stroke, a.pos, a.y),
bl AS (SELECT id, max(b) AS y0 FROM ct JOIN (SELECT id, max(n) AS m FROM ct GROUP BY id) USING (id) WHERE n >= 0.95 * m GROUP BY id), {resampled('fa', 'fk')}
SELECT fa.id, any_value(how) AS how, round(any_value(k), 6) AS scale, count(*) AS n, round(avg(round((x - x0) * k, 5)), 4) AS x, round(avg(round((y - y0) * k, 5)), 4) AS y
FROM fa JOIN fk USING (id) JOIN bl USING (id) GROUP BY fa.id""")
def e06_corrected_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sheets of writers, one of them in capitals, brought to one x-height with a correcting pass: each word's points and their middle."""
    sheet = F.col("writer") % 5
    text = F.substring("label", 1, 2)
    ink = ink_strokes(spark, sf_dir).select(sheet.alias("frame"), "id", F.when(sheet == 0, F.upper(text)).otherwise(text).alias("text"), "strokes")
    ink = written(ink)
    scales = written(standard.frame_scales(ink))
    each = standard.standardised(ink, scales).groupBy("frame", "id").agg(F.count("*").alias("n"), F.round(F.avg("x"), 4).alias("x"), F.round(F.avg("y"), 4).alias("y"))
    return each.join(scales, "frame").select("id", "how", F.round("scale", 6).alias("scale"), "n", "x", "y")


@query(f"""WITH t AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'), r AS (SELECT o_orderkey AS key, o_orderstatus AS source, o_totalprice AS w FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)),
tr AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY {u('split', 'key')}, key) <= 3000)
SELECT source, key FROM tr WHERE w > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY ln(greatest({u('sample', 'key')}, 1e-12)) / w DESC, key) <= 400""")
def f05_sources_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """400 rows a source by weight, out of at most 3,000 that train beside a fixed test table."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("source"), F.col("o_totalprice").cast("double").alias("w"))
    tests = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("source"), F.col("o_totalprice").cast("double").alias("w"))
    parts = s.split_by_tables(rows, tests, "key", "source", 3000)
    return s.weighted_sample_by(parts.where("part = 'train'"), 400, "source", "key", F.col("w")).select("source", "key")


@query("""WITH r AS (SELECT label, vec_id, round(embedding[1]::DOUBLE, 5) AS q, round(embedding[2]::DOUBLE, 5) AS a FROM embeddings),
d AS (SELECT label, vec_id, q, lead(q) OVER w AS q2, a - lead(a) OVER w AS a FROM r WINDOW w AS (PARTITION BY label ORDER BY q DESC, vec_id)) SELECT label, vec_id, round(a, 6) AS a FROM d WHERE q > q2""")
def e18_pair_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.round(e[0].cast("double"), 5).alias("q"), F.round(e[1].cast("double"), 5).alias("a"))
    return augment.pair_differences(rows, "label", "vec_id", "q", ["a"]).select("label", "vec_id", F.round("a", 6).alias("a"))


@query(f"""WITH {PTS}, w AS (SELECT id, writer, writer % 3 AS source FROM words), r AS (SELECT *, row_number() OVER (PARTITION BY source, writer ORDER BY {u('trial', 'id')}, id) AS r FROM w),
p AS (SELECT source, writer, list(id ORDER BY r) FILTER (r <= 2) AS primes FROM r GROUP BY source, writer HAVING count(*) > 2),
g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {u('trial', 'writer')}, writer) - 1 AS at, count(*) OVER (PARTITION BY source) AS n FROM p)
SELECT g.source, g.writer AS trial, i::INT AS place, h.writer AS candidate, h.primes FROM g, range(4) t(i), g h WHERE g.n >= 4 AND h.source = g.source AND h.at = (g.at + i) % g.n""")
def f14_style_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ink_events(spark, sf_dir).select("id", "writer", (F.col("writer") % 3).alias("source"))
    return augment.style_trials(words, "source", "writer", "id", n=4, k=2).select("source", "trial", "place", "candidate", "primes")


@query("SELECT vec_id, p.label AS prompt, e.label = p.label AS own FROM embeddings e, (SELECT DISTINCT label FROM embeddings) p")
def f15_all_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    each = s.all_prompts(rows, rows.select(F.col("label").alias("prompt")).distinct())
    return each.select("vec_id", "prompt", (F.col("prompt") == F.col("label")).alias("own"))


@query(f"""WITH {PTS}, m AS (SELECT writer FROM words GROUP BY writer HAVING count(*) >= 4), o AS (SELECT id, writer, substr(label, 1, 3 + length(label) % 6) AS text FROM words WHERE writer IN (SELECT writer FROM m)),
t AS (SELECT * FROM o WHERE regexp_full_match(text, '[A-Za-z]{{3,8}}') QUALIFY row_number() OVER (PARTITION BY writer ORDER BY {u('transfer', 'id')}, id) <= 2),
p AS (SELECT * FROM o WHERE (writer, lower(text)) NOT IN (SELECT writer, lower(text) FROM t) QUALIFY row_number() OVER (PARTITION BY writer ORDER BY {u('transfer', 'id')}, id) <= 3)
SELECT writer, 'target' AS role, id FROM t UNION ALL SELECT writer, 'primer', id FROM p""")
def f19_transfer_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ink_events(spark, sf_dir).select("id", "writer", F.col("label").substr(F.lit(1), 3 + F.length("label") % 6).alias("text"))
    return augment.transfer_tasks(words, "writer", "id", "text", targets=2, primers=3)


@query("SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def v05_shared_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rename = lambda t, p: t.select(*[F.col(c).alias({"custkey": "key", "suppkey": "key", "nationkey": "nation"}.get(c[2:], c[2:])) for c in t.columns if c.startswith(p)])
    tables = {"customer": rename(table(spark, sf_dir, "customer"), "c_"), "supplier": rename(table(spark, sf_dir, "supplier"), "s_")}
    columns = augment.shared_columns(tables, "key", ["key", "name", "nation"])
    return tables["customer"].select(*columns).unionByName(tables["supplier"].select(*columns))


@query()
def v11_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two principal components; tests hold that they have the greatest spread."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(rows)
    return model.transform(rows).select("vec_id", vector_to_array("p").alias("p"))


@query(f"SELECT draw, {u('draw', 'draw')} AS u FROM range(1000) t(draw)".replace("range(1000) t(draw)", "(SELECT o_orderkey AS draw FROM orders)"))
def k02_draw_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded numbers by index: any shard can compute its own again."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("draw"), uniform("draw", F.col("o_orderkey")).alias("u"))


