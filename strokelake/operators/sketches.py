"""Mergeable sketches of a column by group: KLL for quantiles, HLL for distinct counts.

Sketches are columns, so they are stored like any table, one row a group and period, and periods are merged without their
rows: a day that is added costs its own rows alone. A KLL sketch of size k is exact up to about k values; beyond, the rank
of an estimate is off by about 2.3 / k ** 0.9 of the values at 99 % confidence. An HLL sketch of 2 ** lg registers is off by about
1.04 / sqrt(2 ** lg), one standard error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, LG = 4096, 14


def sketched(rows: DataFrame, by: list[str], value: str, member: str, size: int = SIZE, lg: int = LG) -> DataFrame:
    """Rows (by, n, values, members): count and sketches of each group's values and members; nulls are in neither sketch."""
    x = F.col(value).cast("double")
    return rows.groupBy(*by).agg(F.count(x).alias("n"), F.kll_sketch_agg_double(x, size).alias("values"), F.hll_sketch_agg(F.col(member), lg).alias("members"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Stored sketches of many periods as one of each group of `by`."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("values").alias("values"), F.hll_union_agg("members", F.lit(True)).alias("members"))


def estimates(sketches: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """Rows (by, n, q, members): quantiles at the shares, null without values, and distinct counts."""
    q = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("values", F.array(*[F.lit(s) for s in shares])))
    return sketches.select(*by, "n", q.alias("q"), F.hll_sketch_estimate("members").alias("members"))
