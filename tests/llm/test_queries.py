"""Registered queries against SQL, and the pipeline against its stages' meaning."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from strokelake.llm import queries

SF = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    df = queries.queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    theirs = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == theirs


def test_pipeline(spark):
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(SF))
        assert docs.columns == columns
        docs = corpus_pipeline.written(docs, "stage")
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(SF))
    n = last.groupBy("doc_id").count().count()
    assert n == docs.select("doc_id").distinct().count()
    assert last.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").isEmpty()
    assert corpus_pipeline.run(spark, str(SF)).count() == last.count()


def test_pipeline_of_nothing(spark, tmp_path):
    empty = spark.read.parquet(str(SF / "documents.parquet")).where("false")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
