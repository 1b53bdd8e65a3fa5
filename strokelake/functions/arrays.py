"""Small helpers on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """`body(v)` with `v` bound once to `value`: a lambda inside `body` then does not compute it anew per element."""
    return F.transform(F.array(value), body)[0]


def indices(a: Column) -> Column:
    """0 .. size - 1, empty for an empty array."""
    return F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))


def total(a: Column) -> Column:
    """Sum of an array of doubles; 0 for an empty one."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def pairs(a: Column, f) -> Column:
    """f(previous, next) for neighbours."""
    n = F.size(a)
    return F.when(n > 1, F.zip_with(F.slice(a, F.lit(1), n - 1), F.slice(a, F.lit(2), n - 1), f))


def uniform(seed: str, key: Column, k: Column | int = 0) -> Column:
    """A number in [0, 1) that depends on seed, key and k alone: the same in any partitioning and engine."""
    k = k if isinstance(k, Column) else F.lit(k)
    text = F.concat_ws("|", F.lit(seed), key.cast("string"), k.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def rounded(x: Column, places: int) -> Column:
    """x to so many places as SQL engines on doubles round: the product is rounded, halves away from zero, and zero keeps its sign.

    `F.round` goes by decimal digits, so it differs where the product meets a half, and it has no -0.0.
    """

    def of(y: Column) -> Column:
        whole = F.floor(F.abs(y))
        near = F.signum(y) * (whole + F.when(F.abs(y) - whole >= 0.5, 1).otherwise(0)) / 10.0**places
        return F.when(F.abs(y) < 2.0**52, near).otherwise(x)  # null and past that nothing is left to round

    return let(x * 10.0**places, of)
