"""Queries on splits, draws, packing and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokelake.functions.arrays import uniform
from strokelake.operators import sampling as s
from strokelake.plans.adapters import PTS, ink_events
from strokelake.plans.registry import query, table
from strokelake.plans.tokens import WALK, tokens


def u(seed: str, key: str, k: int | str = 0) -> str:
    """SQL for the hash uniform."""
    return f"(('0x' || substr(md5('{seed}|' || ({key})::VARCHAR || '|' || ({k})::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def picks(most: int, source: str, members: str) -> str:
    """SQL for (draw, grp, key, place) of draws (draw, grp, n, lim) and members (grp, key)."""
    steps = ["s0 AS (SELECT *, []::BIGINT[] AS s FROM " + source + ")"]
    for j in range(most):
        steps.append(f"""s{j + 1} AS (SELECT * EXCLUDE (t) REPLACE (CASE WHEN {j} < lim THEN list_append(s, CASE WHEN list_contains(s, t) THEN n - lim + {j} ELSE t END) ELSE s END AS s)
  FROM (SELECT *, floor({u('draw', 'draw', 2 + j)} * (n - lim + {j + 1}))::BIGINT AS t FROM s{j}))""")
    return f"""{', '.join(steps)}, mem AS (SELECT grp, key, row_number() OVER (PARTITION BY grp ORDER BY {u('draw-member', 'key')}, key) - 1 AS i FROM {members}),
picked AS (SELECT draw, grp, unnest(s) AS i FROM s{most}),
chosen AS (SELECT draw, picked.grp, key, row_number() OVER (PARTITION BY draw ORDER BY {u('draw', "draw || '/' || key", "'order'")}, key) AS place FROM picked JOIN mem ON picked.grp = mem.grp AND picked.i = mem.i)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")


@query(f"""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {u('split', 'doc_id')} DESC, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, CASE WHEN r <= least(1000, n // 20) THEN 'test' ELSE 'train' END AS part FROM r""")
def f01_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.split(docs(spark, sf_dir), "doc_id", "source").select("doc_id", "part")


@query(f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {u('eval', 'doc_id')}, doc_id) <= 30")
def f02_capped_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.first_by_hash(docs(spark, sf_dir), "doc_id", "source", 30, "eval").select("doc_id", "source")


@query("""WITH d AS (SELECT source, row_number() OVER (ORDER BY source) AS id FROM (SELECT DISTINCT source FROM documents WHERE lang = 'en'))
SELECT doc_id, coalesce(id, 0)::INT AS id FROM documents LEFT JOIN d ON documents.source = d.source""")
def f03_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir)
    return s.with_dimension(rows, s.dimension(rows.where("lang = 'en'"), "source"), "source").select("doc_id", "id")


@query(f"""WITH g AS (SELECT label, sum(vec_id % 3 + 1) AS w, count(*) AS n FROM embeddings GROUP BY label),
sp AS (SELECT label, n, (sum(w) OVER (ORDER BY label) - w) / (sum(w) OVER ())::DOUBLE AS low, sum(w) OVER (ORDER BY label) / (sum(w) OVER ())::DOUBLE AS high FROM g),
d AS (SELECT draw, {u('draw', 'draw')} AS x FROM range(200) t(draw)),
h AS (SELECT draw, label AS grp, n, (floor({u('draw', 'draw', 1)} * least(5, n)) + 1)::INT AS lim FROM d JOIN sp ON x >= low AND x < high),
mm AS (SELECT label AS grp, vec_id AS key FROM embeddings), {picks(5, 'h', 'mm')}
SELECT draw, grp AS label, key AS vec_id, place::INT AS place FROM chosen""")
def f04_weighted_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 3 + 1).alias("w"))
    return s.weighted_draws(rows, 200, "label", "w", "vec_id", most=5)


@query(f"""SELECT vec_id FROM embeddings ORDER BY ln(greatest({u('sample', 'vec_id')}, 1e-12)) / (vec_id % 3 + 1) DESC, vec_id LIMIT 100""")
def f05_weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id")
    return s.weighted_sample(rows, 100, "vec_id", (F.col("vec_id") % 3 + 1).cast("double"))


JOINED = f"""{WALK}, n AS (SELECT id, count(*) AS t FROM tok GROUP BY id), w AS (SELECT n.id, writer, t, strlen(label) AS b, split_part(n.id, '/', 3)::INT AS k FROM n JOIN words ON n.id = words.id),
c AS (SELECT *, row_number() OVER o AS r, sum(t) OVER o AS st, sum(b) OVER o AS sb FROM w WINDOW o AS (PARTITION BY writer ORDER BY k)),
v AS (SELECT *, max((r > 1 AND (st + 2 * (r - 1) > 254 OR sb + r - 1 > 50))::INT) OVER (PARTITION BY writer ORDER BY k) AS bad FROM c)"""


@query(f"WITH {JOINED} SELECT writer, id FROM v WHERE bad = 0")
def f06_join_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens(spark, sf_dir).select("id", "writer", F.size("tokens").alias("t"), F.octet_length("label").alias("b"), F.split("id", "/")[2].cast("int").alias("k"))
    return s.join_words(rows, "writer", "k", "t", "b", block=256, limit=50).select("writer", "id")


@query(f"""WITH {PTS} SELECT id, CASE WHEN {u('drop', 'id')} < 0.3 THEN '' ELSE label END AS told, {u('hint', 'id')} < 0.5 AS hinted FROM words""")
def f07_prompt_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ink_events(spark, sf_dir)
    return words.select("id", F.when(uniform("drop", F.col("id")) < 0.3, "").otherwise(F.col("label")).alias("told"), (uniform("hint", F.col("id")) < 0.5).alias("hinted"))


@query(f"""WITH {WALK}, w AS (SELECT id, list(token ORDER BY pos) AS t FROM tok GROUP BY id), k AS (SELECT id, t[:62] AS h, len(t) AS n FROM w)
SELECT id, list_concat([13], h, [11], list_transform(range(62 - len(h)), lambda i: 10)) AS x, list_concat(h, [CASE WHEN n > 62 THEN -1 ELSE 11 END], list_transform(range(63 - len(h)), lambda i: -1)) AS y FROM k""")
def f08_make_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(spark, sf_dir).select("id", s.make_example(F.col("tokens"), 64, bos=13, end=11, pad=10).alias("e")).select("id", "e.x", "e.y")


@query("""WITH b AS (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 32 AS batch FROM documents) SELECT batch, count(*) AS n_rows, max(n_chars) AS width FROM b GROUP BY batch""")
def f09_sorted_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.sorted_batches(docs(spark, sf_dir), "doc_id", "n_chars", 32)
    return rows.groupBy("batch").agg(F.count("*").alias("n_rows"), F.max("n_chars").alias("width"))


@query()
def f10_token_budget_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools of documents by hash; tests hold the fold's invariants."""
    rows = docs(spark, sf_dir).withColumns({"pool": F.floor(F.col("doc_id") / 500), "length": F.least(F.col("n_chars"), F.lit(768))})
    return s.token_budget_batches(rows, "pool", "doc_id", "length", budget=4096, step=64, block=768)


@query("""SELECT source, count(*) AS n, round(median(n_chars), 6) AS median, round(quantile_cont(n_chars::DOUBLE, 0.99), 6) AS p99, round(avg((n_chars > 766)::INT), 6) AS cut FROM documents GROUP BY source""")
def f11_length_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = s.length_report(docs(spark, sf_dir), "n_chars", 768, "source")
    return out.select("source", "n", *[F.round(c, 6).alias(c) for c in ("median", "p99", "cut")])


@query(f"""WITH RECURSIVE {PTS}, w AS (SELECT writer, id, length(label) AS size, row_number() OVER (PARTITION BY writer ORDER BY -least(length(label), 5), {u('primer', 'id')}, id) AS r FROM words),
f AS (SELECT writer, 0 AS r, 0 AS used, []::VARCHAR[] AS keys FROM w GROUP BY writer UNION ALL
  SELECT w.writer, w.r, CASE WHEN used + size <= 30 AND len(keys) < 3 THEN used + size ELSE used END, CASE WHEN used + size <= 30 AND len(keys) < 3 THEN list_append(keys, w.id) ELSE keys END FROM f JOIN w ON f.writer = w.writer AND w.r = f.r + 1)
SELECT writer, keys AS primers FROM f QUALIFY row_number() OVER (PARTITION BY writer ORDER BY r DESC) = 1""")
def f12_primers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.primers(ink_events(spark, sf_dir).withColumn("size", F.length("label")), "writer", "id", "size", 30, 3)


@query(f"""WITH {PTS}, r AS (SELECT writer, id, row_number() OVER (PARTITION BY writer ORDER BY {u('context', 'id')}, id) AS r FROM words),
p AS (SELECT a.id AS target, list(b.id ORDER BY b.r) AS l FROM r a JOIN r b ON a.writer = b.writer AND b.r <= 4 AND a.id <> b.id GROUP BY a.id HAVING count(*) >= 3)
SELECT target, k, l[:k] AS context FROM p, (SELECT unnest([0, 1, 3]) AS k)""")
def f13_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.contexts(ink_events(spark, sf_dir), "writer", "id", (0, 1, 3))


@query(f"SELECT user_id, row_number() OVER (ORDER BY {u('anonymous', 'user_id')}, user_id)::INT AS new FROM (SELECT DISTINCT user_id FROM events)")
def f16_anonymised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.anonymised(table(spark, sf_dir, "events"), "user_id")


@query("""SELECT source, min(doc_id) AS first, CASE WHEN regexp_matches(source, '^[aeiou]') THEN 'an ' ELSE 'a ' END || source AS prompt FROM documents GROUP BY source""")
def f17_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct labels in order of first sight, with their article."""
    article = F.when(F.col("source").rlike("^[aeiou]"), "an ").otherwise("a ")
    return docs(spark, sf_dir).groupBy("source").agg(F.min("doc_id").alias("first")).withColumn("prompt", F.concat(article, F.col("source")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def f18_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(known, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query("""WITH b AS (SELECT n_chars, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 32 AS batch FROM documents)
SELECT batch, sum(n_chars)::BIGINT AS real, (max(n_chars) * count(*) - sum(n_chars))::BIGINT AS padded FROM b GROUP BY batch""")
def g18_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.sorted_batches(docs(spark, sf_dir), "doc_id", "n_chars", 32)
    return rows.groupBy("batch").agg(F.sum("n_chars").alias("real"), (F.max("n_chars") * F.count("*") - F.sum("n_chars")).alias("padded"))
