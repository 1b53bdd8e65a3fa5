"""Queries on stored sketches, one mapping over many tables, pairs in blocks, sessions by event time, and counts kept while filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strokelake.operators import anonymous, blocks, sketches
from strokelake.operators import quality as q
from strokelake.plans.registry import query, table
from strokelake.plans.sampling import u
from strokelake.plans.vectors import VEC, base
from strokelake.sources.scratch import scratch, written
from strokelake.streaming import streams


@query()
def f11_sketched_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of each type and day are stored, then merged by type; tests hold the bounds of error."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    stored = written(sketches.sketched(events, ["event_type", "day"], "value", "user_id"))
    out = sketches.estimates(sketches.merged(stored, ["event_type"]), ["event_type"], [0.5, 0.99])
    return out.select("event_type", "n", F.round(F.col("q")[0], 6).alias("median"), F.round(F.col("q")[1], 6).alias("p99"), "members")


KEEP = ["3", "11", "25"]
PLACE = f"(n * {anonymous.STEP}) % {36 ** 5}"
CODE = " || ".join(f"substr('{anonymous.ALPHABET}', (({PLACE}) // {36 ** i} % 36)::INT + 1, 1)" for i in (4, 3, 2, 1, 0))


@query(f"""WITH names AS (SELECT c_custkey::VARCHAR AS name FROM customer UNION SELECT o_custkey::VARCHAR FROM orders),
placed AS (SELECT name, row_number() OVER (ORDER BY {u('anonymous', 'name')}, name) - 1 AS n FROM names),
codes AS (SELECT name, CASE WHEN name IN ('3', '11', '25') THEN name ELSE {CODE} END AS code FROM placed)
SELECT code AS customer, c_nationkey AS nation, count(o_orderkey) AS n_orders FROM customer JOIN codes ON name = c_custkey::VARCHAR LEFT JOIN orders ON o_custkey = c_custkey GROUP BY code, c_nationkey""")
def f16_remapped_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and orders under one mapping with a keep-list: they still join."""
    customers, orders = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    _, out = anonymous.remap_all({"customer": (customers, ["c_custkey"]), "orders": (orders, ["o_custkey"])}, KEEP)
    met = out["customer"].join(out["orders"], F.col("c_custkey") == F.col("o_custkey"), "left")
    return met.groupBy(F.col("c_custkey").alias("customer"), F.col("c_nationkey").alias("nation")).agg(F.count("o_orderkey").alias("n_orders"))


@query(f"""WITH {VEC}, top AS (SELECT max(vec_id) + 1 AS m FROM e), s AS (SELECT a.vec_id AS item, b.vec_id AS prompt, (a.vec_id + 1) % m AS own, list_dot_product(a.v, b.v) AS c FROM e a, e b, top),
o AS (SELECT item, max(CASE WHEN prompt = own THEN c END) AS mine FROM s GROUP BY item)
SELECT s.item, 1 + sum((c > mine + 1e-9 AND prompt <> own)::INT)::BIGINT AS rank, arg_max(prompt, (round(c, 9), -prompt)) AS best FROM s JOIN o ON s.item = o.item GROUP BY s.item""")
def v08_blocked_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's rank for the next one among all vectors, in blocks, and the one that matches best."""
    vectors = base(spark, sf_dir)
    top = vectors.agg((F.max("vec_id") + 1).alias("m"))  # one row
    items = vectors.crossJoin(F.broadcast(top)).select(F.col("vec_id").alias("item"), ((F.col("vec_id") + 1) % F.col("m")).alias("own"), "v")
    out = blocks.ranked(items, vectors.select(F.col("vec_id").alias("prompt"), F.col("v").alias("w")), k=1)
    return out.select("item", "rank", F.col("best")[0].alias("best"))


@query("""WITH g AS (SELECT user_id, ts, value, coalesce(ts - lag(ts) OVER w > INTERVAL 6 HOUR, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n, round(sum(value), 4) AS value FROM s GROUP BY user_id, session""")
def g19_event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of events read as a stream in order of time; one is written once the watermark has passed its end."""
    folder, out = scratch(spark), scratch(spark)
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    ends = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high"))  # one row
    part = F.floor(4 * (F.unix_micros("ts") - F.unix_micros("low")) / (F.unix_micros("high") - F.unix_micros("low") + 1))
    for i in range(4):
        events.crossJoin(F.broadcast(ends)).where(part == i).select("user_id", "ts", "value").coalesce(1).write.mode("append").parquet(folder)
    ends.select(F.lit(-1).cast("bigint").alias("user_id"), (F.col("high") + F.expr("INTERVAL 2 DAYS")).alias("ts"), F.lit(0.0).alias("value")).write.mode("append").parquet(folder)  # an end mark
    stream = spark.readStream.schema("user_id bigint, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(folder)
    running = streams.session_stream(stream, "6 hours", "1 hour").writeStream.format("parquet").option("checkpointLocation", scratch(spark)).option("path", out).trigger(availableNow=True).start()
    running.awaitTermination()
    made = spark.read.schema("user_id bigint, start timestamp, end timestamp, n bigint, value double").parquet(out)
    return made.where("user_id >= 0").select("user_id", F.unix_micros("start").alias("start"), "n", F.round("value", 4).alias("value"))


@query("""SELECT reason, n FROM (SELECT unnest(['kept', 'too long', 'not one word', 'no text']) AS reason, unnest([
  count(*) FILTER (p_name IS NOT NULL AND strlen(p_name) <= 24 AND w = 1), count(*) FILTER (strlen(p_name) > 24), count(*) FILTER (strlen(p_name) <= 24 AND w <> 1), count(*) FILTER (p_name IS NULL)]) AS n
  FROM (SELECT p_name, len(list_filter(regexp_split_to_array(p_name, '\\s+'), lambda w: w <> '')) AS w FROM part))""")
def e01_dropped_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept are written; how many were dropped, and why, is counted by the same pass."""
    kept, counts = q.words_kept(table(spark, sf_dir, "part"), "p_name", 24)
    written(kept)
    return spark.createDataFrame(list(counts.get.items()), "reason string, n bigint")
