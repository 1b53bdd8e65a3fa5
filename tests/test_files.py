from __future__ import annotations

import pytest

from strokelake.sources import ink


def test_dataset_specs():
    assert ink.dataset_specs("a.parquet:3, b.parquet") == [("a.parquet", 3.0), ("b.parquet", 1.0)]
    assert ink.source_name("/x/b.parquet") == "b"


def test_vocabulary_round_trip(spark, tmp_path):
    rules = [(0, 0, 10), (10, 1, 11)]
    ink.write_vocabulary(rules, 0.02, ["a"], spark, str(tmp_path / "v"))
    assert ink.read_vocabulary(spark, str(tmp_path / "v"), 0.02, 2) == rules
    with pytest.raises(ValueError, match="merges"):
        ink.read_vocabulary(spark, str(tmp_path / "v"), 0.02, 3)


def test_arrow_merges(spark, tmp_path):
    (tmp_path / "m.txt").write_text("#version\na b\na b\nab c\nx a\nc c\n")
    assert ink.read_arrow_merges(spark, str(tmp_path / "m.txt"), ["a", "b", "c"], 2) == [(0, 1, 3), (3, 2, 4)]


def test_repeated_ids(spark):
    a = spark.createDataFrame([("a/1", 1)], "id string, x int")
    b = spark.createDataFrame([("a/1", "t"), ("b/1", "u")], "id string, label string")
    pooled = ink.pool({"a": a, "b": b}, {"b": 2.0})
    assert pooled.count() == 3 and [r.id for r in ink.repeated_ids(pooled).collect()] == ["a/1"]
    assert ink.vector_fields(["k_1", "k_2", "name"]) == {"k": ["k_1", "k_2"], "name": ["name"]}


def test_arrow_merges_ask_for_their_names_alone(spark, tmp_path):
    (tmp_path / "m.txt").write_text("a b\nab c\nx y\n\na\nc a\nab c\nd d\n")
    names = spark.createDataFrame([(i, w) for i, w in enumerate(["a", "b", "c", "ca", "d", "unused"])], "number bigint, name string")
    assert ink.read_arrow_merges(spark, str(tmp_path / "m.txt"), names, 9) == [(0, 1, 6), (6, 2, 7), (4, 4, 8)]
    (tmp_path / "none.txt").write_text("\n")
    assert ink.read_arrow_merges(spark, str(tmp_path / "none.txt"), names, 9) == []
