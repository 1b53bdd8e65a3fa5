"""Queries on vectors and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokelake.functions.arrays import dot, norm, rounded
from strokelake.operators import vectors as v
from strokelake.plans.registry import query, table

VEC = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
LONG = f"{VEC}, x AS (SELECT vec_id, label, unnest(range(1, len(v) + 1)) AS d, unnest(v) AS c FROM e)"
MEANS = f"{LONG}, m AS (SELECT label, d, avg(c) AS mc FROM x GROUP BY label, d), w AS (SELECT label AS prompt, list(mc ORDER BY d) AS w FROM m GROUP BY label)"
WHOLE = "(list_sum({}))"
NONE = float("nan")  # SQL divides a zero vector by zero


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.mean_by(base(spark, sf_dir), ["label"], "v")


@query(f"WITH {VEC}, q AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) AS t FROM e) SELECT vec_id, list_transform(v, lambda x: round_even(x / t * 127, 0)::INT) AS q FROM q")
def v01_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("vec_id", v.quantise(F.col("v")).alias("q"))


@query(f"WITH {VEC}, q AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) AS t FROM e) SELECT vec_id, round(list_sum(list_transform(v, lambda x: round_even(x / t * 7, 0) * t / 7)), 6) AS s FROM q")
def v01_round_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = v.round_bits(F.col("v"), 4)
    return base(spark, sf_dir).select("vec_id", F.round(F.aggregate(rounded, F.lit(0.0), lambda a, x: a + x), 6).alias("s"))


@query(f"WITH {VEC} SELECT vec_id, list_transform(v, lambda x: round(x / sqrt(list_sum(list_transform(v, lambda y: y * y))), 6)) AS u FROM e")
def v02_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("vec_id", F.transform(v.unit(F.col("v"), NONE), lambda x: rounded(x, 6)).alias("u"))


@query(f"WITH {VEC} SELECT vec_id, text <> '' AND n_chars > 500 AS there FROM e JOIN documents ON doc_id = vec_id")
def v03_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.when(F.col("n_chars") > 500, F.col("text")).otherwise("").alias("t"))
    return base(spark, sf_dir).join(docs, "vec_id").select("vec_id", v.present(F.col("v"), F.col("t")).isNotNull().alias("there"))


@query(f"""WITH {MEANS}, k AS (SELECT e.vec_id, CASE WHEN e.vec_id % 3 = 0 THEN NULL ELSE w END AS frame, v AS name FROM e JOIN w ON label = prompt)
SELECT vec_id, CASE WHEN frame IS NULL THEN 'name' ELSE 'frame' END AS kind, round(list_sum(coalesce(frame, name)), 6) AS s FROM k""")
def v04_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir).join(label_means(spark, sf_dir), "label").select("vec_id", F.when(F.col("vec_id") % 3 != 0, F.col("mean")).alias("frame"), F.col("v").alias("name"))
    return v.told(rows, "vec_id", ["name", "frame"], ["frame"]).select("vec_id", "kind", F.round(F.aggregate("told", F.lit(0.0), lambda a, x: a + x), 6).alias("s"))


@query(f"""WITH {MEANS}, p AS (SELECT vec_id, list_transform(list_zip(v, w), lambda z: (z[1] + z[2]) / 2) AS h FROM e JOIN w ON label = prompt)
SELECT vec_id, list_transform(h, lambda x: round(x / sqrt(list_sum(list_transform(h, lambda y: y * y))), 6)) AS m FROM p""")
def v04_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir).join(label_means(spark, sf_dir), "label")
    return rows.select("vec_id", F.transform(v.mixed(F.col("v"), F.col("mean"), NONE), lambda x: rounded(x, 6)).alias("m"))


@query(f"""WITH {MEANS}, d AS (SELECT x.d, avg(c - 0.5 * mc) AS s FROM x JOIN m ON x.label = m.label AND x.d = m.d GROUP BY x.d) SELECT round(sqrt(sum(s * s)), 6) AS length FROM d""")
def v06_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir).join(label_means(spark, sf_dir), "label").withColumn("half", F.transform("mean", lambda x: x * 0.5))
    return v.shift(rows, "v", "half").select(F.round("length", 6).alias("length"))


RANKED = f"{MEANS}, s AS (SELECT vec_id, label, prompt, list_dot_product(v, w) AS c FROM e, w), r AS (SELECT vec_id, 1 + sum((c > own)::INT) AS rank FROM (SELECT *, max(CASE WHEN prompt = label THEN c END) OVER (PARTITION BY vec_id) AS own FROM s) GROUP BY vec_id)"


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = base(spark, sf_dir).select(F.col("vec_id").alias("item"), F.col("label").alias("own"), "v")
    prompts = label_means(spark, sf_dir).select(F.col("label").alias("prompt"), F.col("mean").alias("w"))
    return v.prompt_ranks(v.matches(items, prompts))


@query(f"WITH {RANKED} SELECT vec_id AS item, rank::BIGINT AS rank FROM r")
def v08_prompt_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks(spark, sf_dir)


@query(f"WITH {RANKED} SELECT count(*) AS n, round(avg((rank = 1)::INT), 6) AS first, round(avg((rank <= 5)::INT), 6) AS top5, round(avg(rank), 6) AS mean FROM r")
def v08_rank_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("rank")
    return ranks(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg((r == 1).cast("int")), 6).alias("first"), F.round(F.avg((r <= 5).cast("int")), 6).alias("top5"), F.round(F.avg("rank"), 6).alias("mean"))


@query(f"""WITH {MEANS}, s AS (SELECT vec_id, label, prompt, list_dot_product(v, w) AS c FROM e, w)
SELECT round(avg(c) FILTER (prompt = label), 6) AS own, round(avg(c) FILTER (prompt <> label), 6) AS other FROM s""")
def v07_cosine_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = base(spark, sf_dir).select(F.col("vec_id").alias("item"), F.col("label").alias("own"), "v")
    prompts = label_means(spark, sf_dir).select(F.col("label").alias("prompt"), F.col("mean").alias("w"))
    m = v.matches(items, prompts)
    return m.agg(F.round(F.avg(F.when(F.col("prompt") == F.col("own"), F.col("match"))), 6).alias("own"), F.round(F.avg(F.when(F.col("prompt") != F.col("own"), F.col("match"))), 6).alias("other"))


@query(f"WITH {MEANS} SELECT prompt AS label, list_transform(w, lambda x: round(x, 6)) AS mean FROM w")
def v09_mean_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_means(spark, sf_dir).select("label", F.transform("mean", lambda x: rounded(x, 6)).alias("mean"))


@query(f"""WITH {VEC}, p AS (SELECT a.vec_id, a.v AS a, b.v AS b, acos(least(1.0, greatest(-1.0, list_dot_product(a.v, b.v)))) AS t FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_sum(list_transform(list_zip(a, b), lambda z: z[1] * 0.7 + z[2] * 0.3)), 6) AS line,
  round(list_sum(list_transform(list_zip(a, b), lambda z: z[1] * sin(0.7 * t) / sin(t) + z[2] * sin(0.3 * t) / sin(t))), 6) AS arc FROM p""")
def v10_blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = base(spark, sf_dir).select("vec_id", F.col("v").alias("a"))
    p = a.join(a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    whole = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6)
    return p.select("vec_id", whole(v.lerp(F.col("a"), F.col("b"), 0.3)).alias("line"), whole(v.slerp(F.col("a"), F.col("b"), 0.3)).alias("arc"))


@query()
def v11_ridge_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R squared of the first component predicted from the next ones, by fold; tests compare with numpy."""
    rows = base(spark, sf_dir).select(F.slice("v", 2, 8).alias("x"), F.col("v")[0].alias("y"), "vec_id")
    scores = v.ridge_r2(rows, "x", "y", (F.col("vec_id") % 5).cast("int"), 5, 1.0)
    return spark.createDataFrame(list(enumerate(scores)), "fold int, r2 double")


@query(f"WITH {MEANS} SELECT x.vec_id, round(sqrt(sum((c - mc) * (c - mc))), 6) AS length FROM x JOIN m ON x.label = m.label AND x.d = m.d GROUP BY x.vec_id")
def v12_without_group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.without_group_mean(base(spark, sf_dir), "label", "v").select("vec_id", F.round(norm(F.col("v")), 6).alias("length"))


@query(f"WITH {VEC} SELECT a.vec_id, round(list_dot_product(a.v, b.v), 6) AS c FROM e a JOIN e b ON b.vec_id = a.vec_id + 7")
def v07_neighbour_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = base(spark, sf_dir).select("vec_id", "v")
    return a.join(a.select((F.col("vec_id") - 7).alias("vec_id"), F.col("v").alias("w")), "vec_id").select("vec_id", F.round(dot(F.col("v"), F.col("w")), 6).alias("c"))


def mark(line: str) -> str:
    """SQL of a multiset mark."""
    return " || ".join(f"printf('%08x', (coalesce(sum(('0x' || substr(md5({line}), {1 + 8 * i}, 8))::BIGINT), 0) % 4294967296)::BIGINT)" for i in range(4))


@query(f"SELECT count(*) AS n, {mark('o_orderkey::VARCHAR || chr(10) || o_orderstatus')} AS mark FROM orders")
def a08_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.fingerprint(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus"])
