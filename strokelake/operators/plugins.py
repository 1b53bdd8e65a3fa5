"""Where a user's own functions plug in: tokenizers, text encoders, and what a model is told."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strokelake.functions import walk
from strokelake.functions.arrays import let
from strokelake.operators import bpe, polar


def merged_walk(points: Column, grid: float, rules: list[tuple[int, int, int]]) -> Column:
    """The walk under rules learned here or read from a vocabulary file."""
    return let(walk.encode(points, grid), lambda t: bpe.merged(t, rules))


# Column functions by name; add to it to plug in another.
TOKENIZERS: dict[str, Callable[..., Column]] = {"walk": walk.encode, "merged": merged_walk, "polar": polar.tokens, "bytes": walk.byte_tokens, "hints": walk.hint_digits}


def tokenized(rows: DataFrame, name: str, *args, into: str = "tokens") -> DataFrame:
    return rows.withColumn(into, TOKENIZERS[name](*args))


def encoded(rows: DataFrame, text: str, encode: Callable[[list[str]], list[list[float]]], into: str = "vector") -> DataFrame:
    """Adds vectors of texts: each distinct text goes to the encoder once, in Arrow batches, and is joined back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encode(batch.column(0).to_pylist()), pa.list_(pa.float64()))], names=["_text", into])

    known = rows.where(F.col(text).isNotNull()).select(F.col(text).alias("_text")).distinct().mapInArrow(run, f"_text string, {into} array<double>")
    return rows.join(known, F.col(text) == F.col("_text"), "left").drop("_text")


def told_bytes(text: Column, length: int) -> Column:
    """What a model is told as byte tokens; empty for a missing text."""
    return walk.byte_tokens(text, length)


def told_vector(vector: Column, size: int) -> Column:
    """What a model is told as a vector; zeros for a missing one."""
    return let(vector, lambda v: F.coalesce(v, F.array_repeat(F.lit(0.0), size)))
