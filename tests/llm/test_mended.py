"""Hot ids, clashing column names, pages of broken tags, and stages beside each other."""

from __future__ import annotations

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strokelake.llm import html_extraction, language_id

SF = Path("/root/testdata/sf0.001")
# names that operators give to columns of their own
OWN = ("gone", "chosen", "d", "s", "s2", "r", "k", "n", "sid", "sid2", "row", "w", "i", "t", "m", "size", "key", "part", "target", "source_size", "component_id", "wanted", "kept", "h", "hash", "lines", "line", "words", "n_words", "base_failed", "first", "share", "copies")


@pytest.mark.parametrize("broken", ["<a ", '<a href="x ', "if a<b then ", '<a ">" ', "<title>", "<!-- x ", "<textarea/ "])
def test_time_is_linear_on_broken_tags(broken):
    page = "<p>" + broken * (1_000_000 // len(broken))
    began = time.time()
    html_extraction.main_text(page, html_extraction.PRIOR)
    assert time.time() - began < 15


def test_slash_after_a_value_closes_nothing():
    page = "<body><script src=/js/>var code = 1;</script><p>One two three four five six seven eight.</p><br/><p>Nine ten.</p></body>"
    assert html_extraction.main_text(page, html_extraction.PRIOR) == "One two three four five six seven eight. Nine ten."


def test_pages_with_clashing_columns(spark):
    pages = spark.read.parquet(str(SF / "pages.parquet")).where("page_id < 20")
    more = pages.select("*", *[F.lit("x").alias(c) for c in OWN])
    plain, other = (sorted(map(tuple, html_extraction.extract(p).collect())) for p in (pages, more.union(more)))
    assert other == sorted(plain * 2)


def test_one_doc_id_for_most_rows(spark):
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    hot = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit(2)).when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.col("doc_id"))).withColumn("cuts", F.lit(1)).withColumn("r", F.lit(1))
    seen = []
    train = language_id.Network.train
    try:
        language_id.Network.train = lambda self, x, y: (seen.append(len(x)), train(self, x, y))[1]
        out = language_id.identify(hot, per_language=20).collect()
    finally:
        language_id.Network.train = train
    assert len(out) == docs.count() and seen[0] <= 20 * 3 * len({r.lang_pred for r in out} | {""})


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_with_clashing_columns(spark, name, stage):
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    more = docs.select("*", *[F.lit("x").alias(c) for c in OWN])
    plain, other = stage(spark, docs, str(SF)), stage(spark, more, str(SF))
    if name != "pack_sequences":
        assert other.columns == more.columns
        assert sorted(map(repr, plain.collect())) == sorted(map(repr, other.select(*docs.columns).collect()))
    else:
        assert plain.count() == other.count()


def test_stages_beside_each_other(spark):
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    first = corpus_pipeline.line_dedup_stage(spark, docs, str(SF))
    n = first.count()
    corpus_pipeline.mix_sources(spark, docs, str(SF)).count()
    corpus_pipeline.run(spark, str(SF)).count()
    assert first.count() == n


def test_a_written_result_gives_back_its_own_tables_alone(spark):
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    first, other = (corpus_pipeline.line_dedup_stage(spark, docs, str(SF)) for _ in range(2))
    n = first.count()
    left = corpus_pipeline.written(first, "stage")
    corpus_pipeline.mix_sources(spark, left, str(SF)).count()
    assert left.count() == other.count() == n  # the other call's tables are there
    lazy = corpus_pipeline.mix_sources(spark, other, str(SF))  # reads the other's tables itself
    assert lazy.count() == corpus_pipeline.mix_sources(spark, left, str(SF)).count()
