"""Stroke, caption, vector, vocabulary and metrics tables as files."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strokelake.operators.codec import PACKED

INK_COLUMNS = "x0 array<smallint>, y0 array<smallint>, stroke_len array<int>, dx array<tinyint>, dy array<tinyint>, unit double"
METRICS = ("run string, step bigint, minutes double, train_loss double, test_loss double, word_score double, text_rank double, gap double, test_loss_by map<string,double>, "
           "seen_loss_by map<string,double>, word_score_by map<string,double>, unseen_by map<string,array<double>>")


def write_strokes(packed: DataFrame, path: str, rows_per_file: int = 1_000_000, by: list[str] | None = None) -> None:
    """Packed strokes as compressed Parquet; the commit protocol publishes all files or none."""
    writer = packed.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).option("parquet.enable.dictionary#id", "false")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def read_strokes(spark: SparkSession, path: str) -> DataFrame:
    """The packed columns and every column that is not nested."""
    df = spark.read.parquet(path)
    return df.select(*[c for c, kind in df.dtypes if c in PACKED or not kind.startswith(("array", "struct", "map"))])


def dataset_specs(spec: str) -> list[tuple[str, float]]:
    """Paths and weights of `a.parquet:3,b.parquet`."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        path, colon, weight = part.rpartition(":")
        out.append((path, float(weight)) if colon and weight.replace(".", "", 1).isdigit() else (part, 1.0))
    return out


def source_name(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2].removesuffix(".parquet")


def pool(tables: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """All rows, with source and weight; columns that a table lacks are null."""
    named = [df.withColumns({"source": F.lit(name), "weight": F.lit((weights or {}).get(name, 1.0))}) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def repeated_ids(pooled: DataFrame, key: str = "id") -> DataFrame:
    """Ids that occur more than once; a pool should have none."""
    return pooled.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def with_captions(ink: DataFrame, captions: DataFrame, kinds: list[str], key: str = "id") -> DataFrame:
    """Captions joined by id; missing ones are empty."""
    return ink.join(captions.select(key, *kinds), key, "left").withColumns({k: F.coalesce(k, F.lit("")) for k in kinds})


def long_captions(captions: DataFrame, kinds: list[str], key: str = "id") -> DataFrame:
    """Rows (id, kind, text), empty ones left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("text")) for k in kinds])
    return captions.select(key, F.inline(pairs)).where(F.coalesce("text", F.lit("")) != "")


def vector_fields(columns: list[str]) -> dict[str, list[str]]:
    """Vector columns by kind: `k_1` and `k_2` make a pair kind."""
    out: dict[str, list[str]] = {}
    for c in columns:
        kind = c[:-2] if c.endswith(("_1", "_2")) and c[:-1] + ("2" if c.endswith("1") else "1") in columns else c
        out.setdefault(kind, []).append(c)
    return out


def vector_column(names: list[str]) -> Column:
    return F.array(*[F.col(n) for n in sorted(names)]) if len(names) > 1 else F.array(F.col(names[0]))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS).json(path)


def write_vocabulary(rules: list[tuple[int, int, int]], grid: float, sources: list[str], spark: SparkSession, path: str) -> None:
    line = json.dumps({"grid": grid, "n_merges": len(rules), "sources": sources, "merges": [list(r) for r in rules]})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_vocabulary(spark: SparkSession, path: str, grid: float, n_merges: int) -> list[tuple[int, int, int]]:
    """The rules; a different grid or number of merges is an error."""
    found = json.loads(spark.read.option("wholetext", True).text(path).first()[0])
    if abs(found["grid"] - grid) > 1e-12 or found["n_merges"] != n_merges:
        raise ValueError(f"{path} has grid {found['grid']} and {found['n_merges']} merges, not {grid} and {n_merges}")
    return [tuple(r) for r in found["merges"]]


LINES = 32_768  # of a vocabulary file


def read_arrow_merges(spark: SparkSession, path: str, names: DataFrame | list[str], n: int) -> list[tuple[int, int, int]]:
    """Rules from lines of two glyph strings: kept where both halves are known and the whole is new, up to n. Names are rows
    (number, name) with distinct numbers from 0, or a list in order.

    Which rule is kept depends on those before it, and a vocabulary has some thousand lines, so the driver folds them. Only
    the names that these lines can ask for are brought there, two halves and a whole a line.
    """
    lines = [r.value.split() for r in spark.read.text(path).withColumn("i", F.monotonically_increasing_id()).orderBy("i").limit(LINES).select("value").collect()]
    pairs = [tuple(p) for p in lines if len(p) == 2]
    asked = spark.createDataFrame([(w,) for w in sorted({w for a, b in pairs for w in (a, b, a + b)})], "name string")
    if isinstance(names, list):
        names = spark.createDataFrame(list(enumerate(names)), "number bigint, name string")
    known = {r.name: r.number for r in names.join(F.broadcast(asked), "name", "left_semi").collect()}  # at most 3 LINES rows either way
    fresh = names.count()
    rules: list[tuple[int, int, int]] = []
    for a, b in pairs:
        if len(rules) < n and a in known and b in known and a + b not in known:
            known[a + b] = fresh + len(rules)
            rules.append((known[a], known[b], known[a + b]))
    return rules
