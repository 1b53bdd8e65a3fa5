"""Operators on texts: ink-token parsing, normalisers, labels."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strokelake.functions.arrays import let

START = 450
SIDE = 224


def detokenize(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (key, stroke, pos, x, y) of `<ink_token_N>` texts: a start marker opens a stroke, pairs are x and y + 225.

    Numbers outside the pair's bounds end a stroke's readable part; an odd last number is dropped.
    """
    numbers = F.transform(F.regexp_extract_all("text", F.lit(r"<ink_token_(\d+)>"), F.lit(1)), lambda n: n.cast("int"))

    def strokes(n: Column) -> Column:
        # places of the start markers, and one past the end
        marks = F.concat(F.array_compact(F.transform(n, lambda x, i: F.when(x == START, i))), F.array(F.size(n)))

        def pairs(a: Column, b: Column) -> Column:
            m = F.floor((b - a - 1) / 2).cast("int")
            whole = F.when(m > 0, F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.struct(F.get(n, a + 1 + 2 * i).alias("x"), (F.get(n, a + 2 + 2 * i) - 225).alias("y"))))
            return F.filter(whole, lambda q: (q["x"] >= 0) & (q["x"] <= SIDE) & (q["y"] >= 0) & (q["y"] <= SIDE))

        return let(marks, lambda m: F.filter(F.zip_with(F.slice(m, F.lit(1), F.size(m) - 1), F.slice(m, F.lit(2), F.size(m) - 1), pairs), lambda s: F.size(s) > 0))

    rows = texts.select(key, F.posexplode(let(numbers, strokes)).alias("stroke", "s")).select(key, "stroke", F.posexplode("s").alias("pos", "p"))
    return rows.select(key, "stroke", "pos", "p.x", "p.y")


def plain(text: Column) -> Column:
    """Lower case without accents, zeros as o. Arrow function: compatibility decomposition has no built-in."""

    def strip(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower().replace("0", "o"))

    @F.pandas_udf("string")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return strip(batches)

    return apply(text)


def core(text: Column) -> Column:
    """Letters and digits of the lower-cased text, zeros as o."""
    return F.regexp_replace(F.translate(F.lower(text), "0", "o"), r"[^\p{L}\p{N}]", "")


def clipped(read: Column, label: Column) -> Column:
    """The reading is the label without its first or last character."""
    n = F.length(label)
    return (n > 1) & ((read == label.substr(F.lit(1), n - 1)) | (read == label.substr(F.lit(2), n - 1)))


def pseudonym(name: Column, length: int = 5) -> Column:
    """Five characters of base 61, low digit first, of the first eight bytes of sha-256."""
    # Fixed value: the digits, in order.
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxy"
    value = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    whole = lambda k: F.floor(value / F.lit(61**k).cast("decimal(20,0)")) if k else value
    return F.concat(*[F.substring(F.lit(digits), 1, 61).substr((whole(k) % 61).cast("int") + 1, F.lit(1)) for k in range(length)])
