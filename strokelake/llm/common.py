"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space that parts words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
TRIM = " \t\n\x0b\x0c\r"
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or (where it is unset and Spark is local, as in tests) one of our own."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_noted = threading.local()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for tables in getattr(_noted, "lists", []):
        tables.append(spark.read.schema(df.schema).parquet(path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def noted() -> Iterator[list[DataFrame]]:
    """A list that gathers the tables that this thread writes inside."""
    tables: list[DataFrame] = []
    before = getattr(_noted, "lists", [])
    _noted.lists = [*before, tables]
    try:
        yield tables
    finally:
        _noted.lists = before


def emptied(table: DataFrame) -> None:
    """Gives back the disk of a written table that nothing reads any more: its folder is overwritten with no rows."""
    base = shared_dir(table.sparkSession)
    plain = lambda p: p.split(":", 1)[-1].replace("///", "/", 1) if ":" in p.split("/", 1)[0] else p
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if plain(folder).startswith(plain(base) + "/"):
            none = table.sparkSession.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema])
            none.coalesce(1).write.mode("overwrite").parquet(folder)


def words(text: Column) -> Column:
    """Array of the words of a text (null: none)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(TRIM))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE + "+")), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """`body(v)` with `v` bound once to `value`, so that a lambda inside `body` does not compute it anew per element."""
    return F.transform(F.array(value), body)[0]


def crc_mod(column: str, k: int) -> Column:
    """CRC-32 of a column's text modulo k (null: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % k


def small_or_plain(df: DataFrame, limit: int, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for broadcast if it has at most `limit` rows, of `most_bytes` bytes as text (both counted here), else as it is."""
    if df.count() > limit:
        return df
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("b")).first()["b"]
    return F.broadcast(df) if (size or 0) <= most_bytes else df
