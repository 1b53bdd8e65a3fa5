from __future__ import annotations

from pyspark.sql import functions as F

from strokelake.functions import lateral
from strokelake.operators import bpe, plugins, scoring


def test_each_text_is_encoded_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def encode(texts):
        seen.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(i, ("a", "bb", None)[i % 3]) for i in range(30)], "id int, text string")
    got = {r.id: r.vector for r in plugins.encoded(rows, "text", encode).collect()}
    assert got[0] == [1.0, 1.0] and got[1] == [2.0, 1.0] and got[2] is None and len(got) == 30 and seen.value == 2


def test_a_scorer_plugs_in(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3]), (2, [])], "id int, tokens array<int>")
    out = scoring.scored_by(rows, lambda batch: [[t * 0.5 for t in tokens] for tokens in batch])
    assert {r.id: r.nats for r in out.collect()} == {1: [0.5, 1.0, 1.5], 2: []}


def test_tokenizers_by_name(spark):
    r = plugins.tokenized(spark.createDataFrame([("é",)], "t string"), "bytes", F.col("t"), 5).first()
    assert r.tokens == [196, 170, 257, 0, 0]
    assert spark.range(1).select(plugins.told_vector(F.lit(None).cast("array<double>"), 2).alias("v")).first().v == [0.0, 0.0]


def test_merges_as_an_expression(spark):
    rules = [(0, 0, 10), (10, 1, 11), (2, 2, 12)]
    rows = [[], [8, 9], [0, 0, 1, 8, 0, 0, 0, 1, 2, 2, 2, 9, 0, 0, 1], None, [2, 8, 2, 9]]
    df = spark.createDataFrame([(t,) for t in rows], "tokens array<int>")
    got = [r.m for r in df.select(bpe.merged(F.col("tokens"), rules).alias("m")).collect()]
    assert got == [[], [8, 9], [11, 8, 10, 0, 1, 12, 2, 9, 11], None, [2, 8, 2, 9]]
    assert [r.m for r in df.select(bpe.merged(F.col("tokens"), []).alias("m")).collect()] == rows
    want = [r.tokens for r in bpe.apply_merges(df.where("tokens IS NOT NULL"), rules).collect()]
    assert [m for m in got if m is not None] == want


def test_a_table_function_in_a_lateral_join(spark):
    df = spark.createDataFrame([("a", [0, 8, 1, 9, 4]), ("b", []), ("c", None)], "id string, tokens array<int>")
    want = [("a", 0, 1, 0, 0), ("a", 1, 1, 0, 1), ("a", 2, 2, 1, 1), ("a", 3, 2, 1, 0), ("a", 4, 1, 1, 0)]
    got = df.lateralJoin(lateral.PenPath(F.col("tokens").outer())).select("id", "pos", "x", "y", "down")
    assert sorted(map(tuple, got.collect())) == want
    lateral.register(spark)
    df.createOrReplaceTempView("lateral_words")
    assert sorted(map(tuple, spark.sql("SELECT w.id, p.* FROM lateral_words w, LATERAL pen_path(w.tokens) p").collect())) == want
