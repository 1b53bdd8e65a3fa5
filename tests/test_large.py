"""Sketches, remapping, blocks, event-time state, multiset marks, and observations, each against a plain version."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strokelake import plans
from strokelake.operators import anonymous, blocks, quality, sketches, vectors
from strokelake.operators.sampling import budget_batches, percentiles
from strokelake.sources.scratch import scratch, written
from strokelake.streaming import streams


def test_sketches_of_days_are_within_their_bounds(spark):
    rows = spark.range(120_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 40).alias("day"), (F.pmod(F.xxhash64("id"), F.lit(10_007)) * F.pmod(F.xxhash64(F.col("id") + 7), F.lit(97))).cast("double").alias("x"), F.floor(F.col("id") / 4).alias("who"))
    stored = written(sketches.sketched(rows, ["g", "day"], "x", "who", size=400))
    shares = [0.01, 0.25, 0.5, 0.75, 0.99]
    out = {r.g: r for r in sketches.estimates(sketches.merged(stored, ["g"]), ["g"], shares).collect()}
    members = {r.g: r.n for r in rows.groupBy("g").agg(F.count_distinct("who").alias("n")).collect()}
    values = {g: np.sort([r.x for r in rows.where(F.col("g") == g).select("x").collect()]) for g in range(3)}
    exact = {r.g: r.q for r in percentiles(rows, "g", "x", shares).collect()}
    for g, r in out.items():
        assert r.n == 40_000 and abs(r.members - members[g]) < 5 * 1.04 / 2**7 * members[g]
        for share, found, true in zip(shares, r.q, exact[g], strict=True):
            for x, bound in ((found, 3 * 2.3 / 400**0.9), (true, 1e-3)):  # equal values share an interval of ranks
                low, high = (np.searchsorted(values[g], x, side) / len(values[g]) for side in ("left", "right"))
                assert low - bound <= share <= high + bound
    again = sketches.estimates(sketches.merged(stored.where("day < 39").union(stored.where("day = 39")), ["g"]), ["g"], shares).collect()
    assert all(r.n == 40_000 and abs(r.members - members[r.g]) < 5 * 1.04 / 2**7 * members[r.g] for r in again)  # merged in another order


def test_sketches_of_nothing_and_of_nulls(spark):
    rows = spark.createDataFrame([("a", None, None), ("b", 1.0, 5)], "g string, x double, who int")
    out = {r.g: r for r in sketches.estimates(sketches.merged(sketches.sketched(rows, ["g"], "x", "who"), ["g"]), ["g"], [0.5]).collect()}
    assert (out["a"].n, out["a"].q, out["a"].members) == (0, None, 0) and (out["b"].n, out["b"].q, out["b"].members) == (1, [1.0], 1)


def test_codes_are_distinct_and_come_back(spark):
    first = [r.c for r in spark.range(40).select(anonymous.code(F.col("id"), 5).alias("c")).collect()]
    assert [anonymous.number_of(c) for c in first] == list(range(40))
    keep = ["w3", "w7", first[0], first[1], first[5], "zz"]  # some kept names are codes that others would get
    names = [f"w{i}" for i in range(60)] + [first[1], "", None]
    a, b = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "writer string, i int"), spark.createDataFrame([(n,) for n in names[:30] * 3], "writer string")
    codes, out = anonymous.remap_all({"a": (a, ["writer"]), "b": (b, ["writer"])}, keep)
    rows = codes.collect()
    assert len({r.code for r in rows}) == len(rows) == 62 and [(r.id, r.code) for r in rows if r.name == ""] == [(0, "")]
    assert sorted(r.id for r in rows) == list(range(62))
    assert all((r.code == r.name) == (r.name in keep or r.name == "") and (r.name in keep or r.code not in keep) and (r.name in keep or len(r.code) in (0, 5)) for r in rows)
    met = out["a"].join(out["b"], "writer")
    assert met.count() == 90
    back = anonymous.remapped(out["a"], "writer", codes, back=True)
    assert sorted((r.i, r.writer) for r in back.collect()) == [(i, n or "") for i, n in enumerate(names)]
    assert sorted(map(tuple, anonymous.mapping(a.repartition(5), "writer", keep).collect())) == sorted(map(tuple, anonymous.mapping(a, "writer", keep).collect()))


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_blocks_rank_as_one_product(spark, block):
    rng = np.random.default_rng(block)
    v, w = rng.normal(size=(50, 6)).round(3), rng.normal(size=(80, 6)).round(3)
    w[3] = w[9] = w[20]  # equal prompts
    own = [int(x) for x in rng.integers(0, 82, 50)]  # two of them are not there
    items = spark.createDataFrame([(i, own[i], v[i].tolist()) for i in range(50)], "item long, own long, v array<double>")
    prompts = spark.createDataFrame([(i, w[i].tolist()) for i in range(80)], "prompt long, w array<double>")
    match = v @ w.T
    for r in blocks.ranked(items, prompts, k=5, block=block).collect():
        mine = own[r.item]
        assert r.rank == (None if mine >= 80 else 1 + sum(match[r.item, p] > match[r.item, mine] + 1e-9 for p in range(80) if p != mine))
        found = [match[r.item, p] for p in r.best]
        assert len(r.best) == 5 and np.allclose(found, np.sort(match[r.item])[::-1][:5])


def test_blocks_of_nothing(spark):
    items, prompts = spark.createDataFrame([], "item long, own long, v array<double>"), spark.createDataFrame([(1, [1.0])], "prompt long, w array<double>")
    assert blocks.ranked(items, prompts).count() == 0
    alone = blocks.ranked(spark.createDataFrame([(1, 2, [1.0])], "item long, own long, v array<double>"), prompts.where("false")).collect()
    assert [(r.item, r.rank, r.best) for r in alone] == [(1, None, [])]


def streamed(spark, files, **how):
    folder, out = scratch(spark), scratch(spark)
    schema = "shard long, key long, length int, ts timestamp"
    for rows in files:
        spark.createDataFrame(rows, "shard long, key long, length int, s long").select("shard", "key", "length", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    running = streams.batch_stream(stream, 300, 10, 100, pool=8, **how).writeStream.format("parquet").option("checkpointLocation", scratch(spark)).option("path", out).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(streams.BATCHES).parquet(out).collect()


def test_state_is_the_fold_in_order(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0, 0, 0, 1, 2]), k, rng.randint(1, 120), 1_000_000_000 + k) for k in range(200)]
    files = [rows[:70], rows[70:140], rows[140:], [(-1, -1, 1, 1_000_900_000)]]
    got: dict = {}
    for r in streamed(spark, files, idle="5 minutes"):
        got.setdefault((r.shard, r.batch), []).append((r.key, r.width))
    want: dict = {}
    for shard in (0, 1, 2):
        waiting, made = [], 0
        for _, k, n, _ in (r for r in rows if r[0] == shard):
            waiting.append((n, k))
            if len(waiting) >= 8:
                batches, waiting = budget_batches(waiting, 300, 10, 100)
                for width, _, members in batches:
                    want[shard, made] = [(m, width) for m in members]
                    made += 1
        if waiting:
            want[shard, -1] = [(k, min(100, -(-n // 10) * 10)) for n, k in waiting]
    assert {k: sorted(v) for k, v in got.items() if k[0] >= 0} == {k: sorted(v) for k, v in want.items()}


def test_a_timer_writes_a_part_and_it_goes_on(spark):
    files = [[(0, k, 50, 1_000_000_000 + k) for k in range(5)], [(1, 100, 50, 1_000_010_000)], [(1, 101, 50, 1_000_011_000)], [(0, k, 50, 1_000_020_000 + k) for k in range(5, 12)], [(-1, -1, 1, 1_000_900_000)]]
    got = [r for r in streamed(spark, files, idle="5 minutes", parts=2) if r.shard == 0]
    assert sorted(r.key for r in got) == list(range(12)) and len({r.part for r in got}) == 2
    assert {r.key for r in got if r.batch == -1} >= set(range(5))


def test_sessions_leave_out_what_comes_late(spark):
    folder, out = scratch(spark), scratch(spark)
    for rows in ([(1, 1_000_000_000, 1.0), (1, 1_000_000_100, 2.0)], [(1, 1_000_050_000, 4.0)], [(9, 1_000_060_000, 0.0)], [(1, 1_000_000_050, 8.0)], [(9, 1_000_900_000, 0.0)]):
        spark.createDataFrame(rows, "user_id long, s long, value double").select("user_id", F.timestamp_seconds("s").alias("ts"), "value").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("user_id long, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(folder)
    streams.session_stream(stream, "10 minutes", "1 minute").writeStream.format("parquet").option("checkpointLocation", scratch(spark)).option("path", out).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("user_id long, start timestamp, end timestamp, n long, value double").parquet(out).where("user_id = 1").collect()
    assert sorted((r.n, r.value) for r in got) == [(1, 4.0), (2, 3.0)]


def test_marks_count_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None)], "k int, t string")
    mark = lambda df: vectors.fingerprint(df, ["k", "t"]).first()["mark"]
    assert mark(rows) == mark(rows.repartition(3)) and len(mark(rows)) == 32
    changed = rows.withColumn("t", F.when(F.col("k") == 2, "c").otherwise(F.col("t")))
    once, twice = changed.where("k = 2").limit(1), rows.where("k <> 2")
    assert len({mark(rows), mark(changed), mark(twice), mark(twice.union(once))}) == 4
    columns = lambda df: {r.column: r.mark for r in vectors.column_marks(df, "k", ["t"]).collect()}
    assert columns(rows) != columns(changed)


def test_dropped_words_are_counted_in_the_same_pass(spark):
    rows = spark.createDataFrame([("one",), ("two words",), (None,), ("x" * 30,), ("",), ("ok",)], "t string")
    kept, counts = quality.words_kept(rows, "t", 10)
    assert sorted(r.t for r in kept.collect()) == ["ok", "one"]
    assert counts.get == {"kept": 2, "too long": 1, "not one word": 2, "no text": 1}


def test_report_from_stored_sketches(spark):
    sf = "/root/testdata/sf0.001"
    out = {r.event_type: r for r in plans.QUERIES["f11_sketched_report"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").agg(F.count("value").alias("n"), F.sort_array(F.collect_list("value")).alias("v"), F.count_distinct("user_id").alias("m")).collect():
        own = out[r.event_type]
        assert own.n == r.n and own.members == r.m
        assert any(abs(own.median - x) < 1e-6 for x in r.v[r.n // 2 - 1 : r.n // 2 + 1])


def test_all_pairs_beyond_a_broadcast(spark):
    from strokelake.operators import blocks
    from strokelake.operators import sampling as s
    from strokelake.operators import vectors as v

    items = spark.createDataFrame([(i % 90, str(i % 7)) for i in range(100)], "item int, own string")  # ten rows repeat in item
    prompts = spark.createDataFrame([(str(p),) for p in range(37)] + [(None,)], "prompt string")
    want = sorted((i % 90, str(i % 7), str(p)) for i in range(100) for p in [*range(37), None])
    for most, block in ((1000, 16), (5, 16), (5, 1000), (5, 1)):
        got = blocks.all_pairs(items, prompts, most, block)
        assert sorted((r.item, r.own, str(r.prompt)) for r in got.collect()) == want
    assert sorted((r.item, r.own, str(r.prompt)) for r in s.all_prompts(items, prompts, most=5).collect()) == want
    assert s.all_prompts(items.where("item < 0"), prompts, most=5).count() == s.all_prompts(items, prompts.where("false"), most=5).count() == 0
    assert blocks.small(prompts) and not blocks.small(prompts, most_bytes=100) and not blocks.small(prompts, most_rows=37)
    vectors = spark.createDataFrame([(i, str(i % 3), [float(i), 1.0]) for i in range(9)], "item int, own string, v array<double>")
    means = spark.createDataFrame([(str(i), [1.0, float(i)]) for i in range(3)], "prompt string, w array<double>")
    near, far = (sorted(map(tuple, v.matches(vectors, means, most).collect())) for most in (100, 1))
    assert near == far and len(near) == 27
