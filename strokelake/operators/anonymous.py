"""Anonymous ids: one mapping of names to short codes, applied to many tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strokelake.functions.arrays import uniform
from strokelake.operators.sampling import numbered

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
LEAST_LENGTH = 5
STEP = 7_368_787  # a prime that shares no factor with a power of 36, so steps of it reach every code once
MOST_KEPT = 10_000


def code(number: Column, length: int) -> Column:
    """The code of a number below 36 ** length; different numbers have different codes."""
    place = (number * STEP) % (len(ALPHABET) ** length)
    return F.concat(*[F.substring(F.lit(ALPHABET), (F.floor(place / len(ALPHABET) ** i) % len(ALPHABET) + 1).cast("int"), F.lit(1)) for i in reversed(range(length))])


def number_of(text: str) -> int | None:
    """The number whose code a text is, if it is one of at least the least length."""
    if len(text) < LEAST_LENGTH or not set(text) <= set(ALPHABET):
        return None
    space, place = len(ALPHABET) ** len(text), 0
    for c in text:
        place = place * len(ALPHABET) + ALPHABET.index(c)
    return place * pow(STEP, -1, space) % space


def mapping(names: DataFrame, name: str, keep: list[str] = (), seed: str = "anonymous") -> DataFrame:
    """Rows (name, id, code), one per distinct name (as a string): id 0 and the empty code for the unknown name "", others from 1
    in hash order with a code of their own; names of the keep-list are their own code, and no other name gets one of these.

    Codes have five characters, or as many as the number of names needs. Names are numbered by ranges; no task holds them all.
    """
    if len(keep) > MOST_KEPT:
        raise ValueError(f"a keep-list has at most {MOST_KEPT} names")
    known = names.select(F.coalesce(F.col(name).cast("string"), F.lit("")).alias("name")).where("name <> ''").distinct()
    placed = numbered(known.withColumn("_u", uniform(seed, F.col("name"))), [F.col("_u"), F.col("name")], "_i").select("name", "_i")
    length = LEAST_LENGTH
    while placed.count() + len(keep) > len(ALPHABET) ** length:
        length += 1
    # numbers whose codes are kept names are passed over: the i-th of them moves those from (it - i) on by one
    passed = sorted(n for k in set(keep) if len(k) == length and (n := number_of(k)) is not None)
    over = F.size(F.filter(F.array(*[F.lit(n - i) for i, n in enumerate(passed)]).cast("array<bigint>"), lambda x: x <= F.col("_i")))
    kept = F.array_contains(F.array(*[F.lit(k) for k in keep]), F.col("name")) if keep else F.lit(False)
    made = placed.select("name", (F.col("_i") + 1).alias("id"), F.when(kept, F.col("name")).otherwise(code(F.col("_i") + over, length)).alias("code"))
    unknown = names.sparkSession.range(1).select(F.lit("").alias("name"), F.col("id"), F.lit("").alias("code"))
    return unknown.union(made)


def remapped(rows: DataFrame, column: str, codes: DataFrame, back: bool = False) -> DataFrame:
    """The rows with the column's names as codes, or (`back`) codes as names again; null is unknown, so the empty text."""
    one, other = ("code", "name") if back else ("name", "code")
    named = codes.select(F.col(one).alias("_from"), F.col(other).alias("_to"))
    met = rows.withColumn("_from", F.coalesce(F.col(column).cast("string"), F.lit(""))).join(named, "_from", "left")
    missing = F.raise_error(F.concat(F.lit("no mapping for "), F.col("_from")))
    return met.select(*[F.coalesce("_to", missing.cast("string")).alias(c) if c == column else F.col(c) for c in rows.columns])


def remap_all(tables: dict[str, tuple[DataFrame, list[str]]], keep: list[str] = (), seed: str = "anonymous") -> tuple[DataFrame, dict[str, DataFrame]]:
    """The mapping of all names in the named columns of the tables, and the tables with it applied, so that keys still meet."""
    names = None
    for rows, columns in tables.values():
        for c in columns:
            own = rows.select(F.col(c).cast("string").alias("name")).distinct()
            names = own if names is None else names.union(own)
    codes = mapping(names, "name", keep, seed)
    out = {}
    for title, (rows, columns) in tables.items():
        for c in columns:
            rows = remapped(rows, c, codes)
        out[title] = rows
    return codes, out
