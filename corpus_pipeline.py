"""A training-data pipeline over `documents`: quality rules, line dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, in their order; columns that are not used, also ones whose
names clash with an operator's own, come through as they are. An empty table gives an empty result in every stage.

A stage names its result in the metadata of doc_id, which Parquet keeps. When a stage is given the written result of another, the
tables that the other's operators wrote on the way are emptied, those of that one call and no others: so a stage's DataFrame can
be read again until a stage begins over what was written from it, whatever else runs beside it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from strokelake.llm import host_rules, jaccard_join, line_dedup, mixing, packing
from strokelake.llm.common import emptied, noted, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
RUN = "made_by"
_made: dict[str, list[DataFrame]] = {}


def given_back(docs: DataFrame) -> list[DataFrame]:
    """Empties what the stage that made docs wrote on the way, but for tables that docs still reads, which are returned."""
    tables = _made.pop(docs.schema["doc_id"].metadata.get(RUN, ""), [])
    read = set(docs.inputFiles()) if tables else set()
    kept = [t for t in tables if not read.isdisjoint(t.inputFiles())]
    for table in tables:
        if table not in kept:
            emptied(table)
    return kept


def tidy(stage: Stage) -> Stage:
    """The stage, which begins by giving back what its docs no longer need."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        kept, made = given_back(docs), uuid.uuid4().hex
        with noted() as tables:
            out = stage(spark, docs, sf_dir)
        _made[made] = kept + tables
        return out.withMetadata("doc_id", {RUN: made})

    return run_stage


@tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text and host pass the rules.

    Null and empty texts fail; null sources are one host; repeated rows are judged one by one; whole texts are read,
    however long; ties cannot occur.
    """
    return host_rules.keep_good(docs)


@tidy
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier line or are within the edit bound of one; documents that lose every line go.

    Null texts stay; the earliest line by (doc_id, line number) stays, null doc_ids first; rows that share a doc_id share
    their places, so equal lines at the same place all stay.
    """
    return line_dedup.deduplicated(docs)


@tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links by five-word shingles at a similarity of 0.8 or more: the least doc_id.

    Rows without words or without a doc_id link with nothing and stay; rows that share the least doc_id of a group stay once.
    """
    return jaccard_join.one_per_group(docs, width=5, p=8, q=10)


@tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target weights: documents repeated, left out, or cut at their source's budget.

    Null and empty texts have no words and go; a null source is a source of its own; rows with equal keys go in order of size.
    """
    return mixing.mixed(docs)


@tidy
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place. Null and empty texts give the end id alone; repeated rows are packed one by one."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

# Tokenization and best-fit packing cannot be said in SQL; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    given_back(docs)
    return docs
