"""Queries on pooling, captions, vector side tables, and streams run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strokelake.operators import codec
from strokelake.plans.adapters import STK, ink_strokes
from strokelake.plans.geometry import QUANTIZED, UNIT
from strokelake.plans.registry import query, table
from strokelake.sources import ink
from strokelake.sources.scratch import scratch
from strokelake.streaming import streams

SINCE = 946_684_800  # the first event time; a watermark begins at 0 and holds rows of that moment late


@query(f"WITH {STK}, {QUANTIZED} SELECT id, stroke, pos, round(x * {UNIT}::DOUBLE, 6) AS x, round(y * {UNIT}::DOUBLE, 6) AS y FROM quant")
def a02_stroke_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed, written, read and unpacked."""
    path = scratch(spark)
    ink.write_strokes(codec.pack(ink_strokes(spark, sf_dir).where(F.size("strokes") > 0), UNIT), path)
    return codec.unpack(ink.read_strokes(spark, path)).select("id", "stroke", "pos", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""WITH p AS (SELECT 'c/' || c_custkey AS id, 'customer' AS source, 1.0 AS weight FROM customer UNION ALL SELECT 's/' || s_suppkey, 'supplier', 3.0 FROM supplier)
SELECT source, weight::DOUBLE AS weight, count(*) AS n, count(DISTINCT id) AS ids FROM p GROUP BY source, weight""")
def a05_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {name: table(spark, sf_dir, name).select(F.concat(F.lit(name[0] + "/"), F.col(key).cast("string")).alias("id")) for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey"))}
    return ink.pool(tables, {"supplier": 3.0}).groupBy("source", "weight").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


CAPTIONS = "cp AS (SELECT doc_id, lang, CASE WHEN doc_id % 4 = 0 THEN '' ELSE source END AS source FROM documents)"


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("source")).alias("source"))


@query(f"WITH {CAPTIONS} SELECT vec_id AS doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM embeddings LEFT JOIN cp ON vec_id = doc_id")
def a06_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return ink.with_captions(vectors, captions(spark, sf_dir), ["lang", "source"], "doc_id")


@query(f"WITH {CAPTIONS} SELECT doc_id, 'lang' AS kind, lang AS text FROM cp WHERE lang <> '' UNION ALL SELECT doc_id, 'source', source FROM cp WHERE source <> ''")
def a06_long_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ink.long_captions(captions(spark, sf_dir), ["lang", "source"], "doc_id")


@query("SELECT vec_id, round(list_sum(embedding[:32])::DOUBLE, 4) AS first, round(list_sum(embedding[33:])::DOUBLE, 4) AS second FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings)")
def a07_vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of a pair kind, grouped by their names into one."""
    v = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(v, 1, 32).alias("half_1"), F.slice(v, 33, 32).alias("half_2"))
    pair = rows.select("vec_id", ink.vector_column(ink.vector_fields(["half_1", "half_2"])["half"]).alias("half"))
    whole = lambda k: F.round(F.aggregate(F.col("half")[k], F.lit(0.0), lambda a, x: a + x), 4)
    return pair.select("vec_id", whole(0).alias("first"), whole(1).alias("second"))


METRIC = """mt AS (SELECT l_returnflag || l_linestatus AS run, month(l_shipdate)::BIGINT AS step, round(avg(l_discount)::DOUBLE, 9) AS test_loss, round(avg(l_tax)::DOUBLE, 9) AS word_score FROM lineitem GROUP BY ALL)"""


def metrics_log(spark: SparkSession, sf_dir: str) -> str:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("run"), F.month("l_shipdate").cast("bigint").alias("step"))
    rows = rows.agg(F.round(F.avg("l_discount").cast("double"), 9).alias("test_loss"), F.round(F.avg("l_tax").cast("double"), 9).alias("word_score"))
    path = scratch(spark)
    rows.write.json(path)
    return path


@query(f"WITH {METRIC} SELECT run, step, test_loss, word_score FROM mt")
def a09_metrics_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ink.read_metrics(spark, metrics_log(spark, sf_dir)).select("run", "step", "test_loss", "word_score")


@query(f"WITH {METRIC} SELECT run, arg_min(step, struct_pack(a := test_loss, b := step)) AS best, max(step) AS last, min(test_loss) AS loss FROM mt GROUP BY run")
def k03_running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metrics log read as a stream to its end; the result is the last complete output."""
    name = f"best_{uuid.uuid4().hex}"
    stream = streams.running_best(streams.metrics_stream(spark, metrics_log(spark, sf_dir)))
    running = stream.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name).select("run", F.col("best.step").alias("best"), F.col("last.step").alias("last"), F.col("best.test_loss").alias("loss"))


@query()
def k01_batch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream of lengths, folded into token-budget batches with carried rows; written and read again.

    Files come in order of doc_id, two a trigger. Rows that still wait are written by the stream as batch -1, as in f10: an
    end mark moves the watermark past every shard's last row.
    """
    slim, out = scratch(spark), scratch(spark)
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 8).alias("shard"), F.col("doc_id").alias("key"), F.least("n_chars", F.lit(768)).cast("int").alias("length"),
                                                    F.timestamp_seconds(F.col("doc_id") + SINCE).alias("ts"))
    top = docs.agg(F.max("key").alias("top"))  # one row
    quarter = F.floor(4 * F.col("key") / (F.col("top") + 1))
    for i in range(4):
        docs.crossJoin(F.broadcast(top)).where(quarter == i).drop("top").coalesce(1).write.mode("append").parquet(slim)
    end = top.select(F.lit(-1).cast("bigint").alias("shard"), F.lit(-1).cast("bigint").alias("key"), F.lit(1).alias("length"), F.timestamp_seconds(F.coalesce("top", F.lit(0)) + SINCE + 86_400).alias("ts"))
    end.write.mode("append").parquet(slim)
    stream = spark.readStream.schema("shard bigint, key bigint, length int, ts timestamp").option("maxFilesPerTrigger", 2).parquet(slim)
    batches = streams.batch_stream(stream, 4096, 64, 768, pool=16)
    running = batches.writeStream.format("parquet").option("checkpointLocation", scratch(spark)).option("path", out).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(streams.BATCHES).parquet(out).where("shard >= 0").select("shard", "batch", "key", "width")


@query(f"WITH {STK} SELECT id, count(DISTINCT stroke) AS n_paths, (count(*) - count(DISTINCT stroke) + sum((one)::INT))::BIGINT AS n_lines FROM (SELECT *, count(*) OVER (PARTITION BY id, stroke) = 1 AS one FROM stk) GROUP BY id")
def a14_svg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strokelake.functions import geometry as g

    pictures = ink_strokes(spark, sf_dir).where(F.size("strokes") > 0).select("id", g.svg(F.col("strokes")).alias("svg"))
    return pictures.select("id", F.regexp_count("svg", F.lit("<path")).cast("bigint").alias("n_paths"), F.regexp_count("svg", F.lit(" L")).cast("bigint").alias("n_lines"))
