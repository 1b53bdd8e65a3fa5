"""Vectors as arrays: quantisation, mixing, geometry, retrieval measures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strokelake.functions.arrays import dot, let, norm, uniform
from strokelake.operators import blocks

FLOOR = 1e-12


def quantise(v: Column) -> Column:
    """Whole numbers with the largest magnitude at 127."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x)))
    return let(top, lambda t: F.transform(v, lambda x: F.rint(x / F.greatest(t, F.lit(FLOOR)) * 127).cast("int")))


def round_bits(v: Column, bits: int) -> Column:
    """Each row rounded to b-bit steps of its largest magnitude."""
    steps = 2 ** (bits - 1) - 1
    top = F.array_max(F.transform(v, lambda x: F.abs(x)))
    return let(top, lambda t: F.transform(v, lambda x: F.rint(x / F.greatest(t, F.lit(FLOOR)) * steps) * t / steps))


def unit(v: Column, empty: float = 0.0) -> Column:
    """At length 1, missing components left out of the length; those of a zero vector are `empty`."""
    return let(norm(F.filter(v, lambda x: x.isNotNull())), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).when(x.isNotNull(), empty)))


def plus(a: Column, b: Column, k: float | Column = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * k)


def present(v: Column, text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", v)


def mean_by(rows: DataFrame, by: list[str], v: str) -> DataFrame:
    """Rows (by, mean): element-wise means, summed by dimension before they are put together."""
    each = rows.select(*by, F.posexplode(v).alias("d", "x")).groupBy(*by, "d").agg(F.avg("x").alias("x"))
    return each.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("m")).select(*by, F.transform("m", lambda e: e["x"]).alias("mean"))


def without_group_mean(rows: DataFrame, by: str, v: str) -> DataFrame:
    means = mean_by(rows, [by], v)
    return rows.join(means, by).withColumn(v, plus(F.col(v), F.col("mean"), -1.0)).drop("mean")


def lerp(a: Column, b: Column, m: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x * (1 - m) + y * m)


def slerp(a: Column, b: Column, m: float) -> Column:
    """Along the great circle between two unit vectors; nearly equal ones are mixed on a line."""
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b))))
    return let(angle, lambda t: F.when(F.sin(t) < 1e-6, lerp(a, b, m)).otherwise(F.zip_with(a, b, lambda x, y: x * F.sin((1 - m) * t) / F.sin(t) + y * F.sin(m * t) / F.sin(t))))


def told(rows: DataFrame, key: str, kinds: list[str], prefer: list[str]) -> DataFrame:
    """Adds told (the first preferred kind that is there) and kind; null without any."""
    first = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in [*prefer, *[k for k in kinds if k not in prefer]]])
    value = F.coalesce(*[F.col(k) for k in [*prefer, *[k for k in kinds if k not in prefer]]])
    return rows.withColumns({"kind": first, "told": value})


def picked(rows: DataFrame, key: str, single: list[str], paired: list[str], pair: float, two: float, named: float, seed: str = "told") -> DataFrame:
    """Adds told, kinds and flags, by hash of key: with probability `pair`, or where there is no single kind, one of the pair
    kinds (arrays of two vectors), else one single kind or with probability `two` two of them. `told` is the vector, or the
    unit mean of two that are there; `flags` holds a 1 for each kind told, or zeros with probability 1 - `named`.
    """
    u = lambda name: uniform(f"{seed}-{name}", F.col(key))
    there = lambda names: F.filter(F.array(*[F.struct(uniform(f"{seed}-{n}", F.col(key)).alias("u"), F.lit(n).alias("kind"), F.col(n).alias("v")) for n in names]), lambda s: s["v"].isNotNull())
    rows = rows.withColumns({"_one": F.sort_array(F.transform(there(single), lambda s: F.struct(s["u"], s["kind"], F.array(s["v"]).alias("v")))), "_two": F.sort_array(there(paired))})
    use_pair = (F.size("_two") > 0) & ((F.size("_one") == 0) | (u("pair") < pair))
    rows = rows.withColumn("_p", F.when(use_pair, F.slice("_two", 1, 1)).otherwise(F.slice("_one", F.lit(1), F.when(u("two") < two, 2).otherwise(1))))
    vectors = F.filter(F.flatten(F.transform("_p", lambda s: s["v"])), lambda v: F.exists(v, lambda x: x != 0))
    told_ = let(vectors, lambda v: F.when(F.size(v) > 1, mixed(F.get(v, F.lit(0)), F.get(v, F.lit(1)))).otherwise(F.get(v, F.lit(0))))
    kinds = F.transform("_p", lambda s: s["kind"])
    flags = F.array(*[F.when(F.array_contains("kinds", n) & (u("named") < named) & F.col("told").isNotNull(), 1).otherwise(0) for n in [*single, *paired]])
    return rows.withColumns({"kinds": kinds, "told": told_}).withColumn("flags", flags).drop("_one", "_two", "_p")


def nearest_own(matched: DataFrame) -> DataFrame:
    """One row (nearest): the share of items whose own prompt matches best, from rows (item, own, prompt, match)."""
    best = matched.groupBy("item", "own").agg(F.max_by("prompt", F.struct("match", "prompt")).alias("b"))
    return best.agg(F.avg((F.col("b") == F.col("own")).cast("int")).alias("nearest"))


def centred_own(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row (centred): the mean cosine of pairs after each side's mean is taken off."""
    one = pairs.select(F.lit(1).alias("_o"), F.col(a).alias("a"), F.col(b).alias("b"))
    means = mean_by(one, ["_o"], "a").withColumnRenamed("mean", "ma").join(mean_by(one, ["_o"], "b").withColumnRenamed("mean", "mb"), "_o")  # one row
    level = one.join(F.broadcast(means), "_o").select(plus(F.col("a"), F.col("ma"), -1.0).alias("a"), plus(F.col("b"), F.col("mb"), -1.0).alias("b"))
    return level.agg(F.avg(dot(F.col("a"), F.col("b")) / F.greatest(norm(F.col("a")) * norm(F.col("b")), F.lit(FLOOR))).alias("centred"))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors whose mask is true; null without any."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda z: z["m"]), lambda z: z["v"])
    return let(kept, lambda k: F.when(F.size(k) > 0, F.transform(F.aggregate(F.slice(k, F.lit(2), F.size(k)), F.transform(F.get(k, F.lit(0)), lambda x: x.cast("double")), lambda a, b: plus(a, b)), lambda x: x / F.size(k))))


def mixed(a: Column, b: Column, empty: float = 0.0) -> Column:
    """The unit mean of two vectors."""
    return unit(F.zip_with(a, b, lambda x, y: (x + y) / 2), empty)


def matches(items: DataFrame, prompts: DataFrame, most: int = blocks.MOST_ROWS) -> DataFrame:
    """Rows (item, own, prompt, match): cosines of every item with every prompt, beyond `most` prompts in blocks. Where only ranks
    or the best are wanted, `blocks.ranked` makes no pairs."""
    return blocks.all_pairs(items, prompts, most).select("item", "own", "prompt", dot(F.col("v"), F.col("w")).alias("match"))


def prompt_ranks(scored: DataFrame) -> DataFrame:
    """Rows (item, rank): one plus the number of prompts strictly better than the item's own."""
    own = F.max(F.when(F.col("prompt") == F.col("own"), F.col("match"))).over(Window.partitionBy("item"))
    return scored.withColumn("_own", own).groupBy("item").agg((1 + F.sum((F.col("match") > F.col("_own")).cast("int"))).alias("rank"))


def shift(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row (shift, length): the mean of a minus that of b."""
    d = mean_by(pairs.select(F.lit(1).alias("one"), plus(F.col(a), F.col(b), -1.0).alias("d")), ["one"], "d")
    return d.select(F.col("mean").alias("shift"), norm(F.col("mean")).alias("length"))


def ridge_r2(rows: DataFrame, features: str, target: str, fold: Column, folds: int, alpha: float) -> list[float]:
    """R squared on each fold, fitted on the others: normal equations summed by fold, then systems of fixed size."""
    size = rows.select(F.size(features)).first()[0] + 1
    z = rows.select(fold.cast("int").alias("f"), F.concat(F.col(features).cast("array<double>"), F.array(F.lit(1.0), F.col(target).cast("double"))).alias("z"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, size + 1, size + 1))  # a partition's products, by fold
        for batch in batches:
            f, own = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for k in np.unique(f):
                total[k] += own[f == k].T @ own[f == k]
        at = np.argwhere(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, c], pa.int32()) for c in range(3)] + [pa.array(total[tuple(at.T)])], names=["f", "i", "j", "s"])

    m = np.zeros((folds, size + 1, size + 1))
    for r in z.mapInArrow(sums, "f int, i int, j int, s double").groupBy("f", "i", "j").agg(F.sum("s").alias("s")).collect():  # folds times (features + 2) squared entries
        m[r.f, r.i, r.j] = r.s
    out = []
    for k in range(folds):
        train, test = m.sum(0) - m[k], m[k]
        beta = np.linalg.solve(train[:size, :size] + alpha * np.eye(size), train[:size, size])
        n, s, ss = test[size - 1, size - 1], test[size - 1, size], test[size, size]
        error = ss - 2 * beta @ test[:size, size] + beta @ test[:size, :size] @ beta
        out.append(float(1 - error / (ss - s * s / n)) if n and ss - s * s / n > 0 else float("nan"))
    return out


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row (n, mark): an order-free mark of a table's content for freshness checks; see `multiset_mark`."""
    return rows.agg(F.count("*").alias("n"), multiset_mark(*columns).alias("mark"))


def multiset_mark(*columns: str) -> Column:
    """An aggregate: 32 hex digits, the sums of the rows' MD5 words, each modulo 2 ** 32. Rows count as often as they occur,
    so a row that is there twice does not cancel, and parts of a table can be marked in any order."""
    line = F.md5(F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("binary"))
    word = lambda i: F.conv(F.substring(line, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")  # noqa: E731  sums pass 2 ** 63 at 2 ** 31 rows
    return F.concat(*[F.lpad(F.lower(F.hex((F.coalesce(F.sum(word(i)), F.lit(0)) % (1 << 32)).cast("bigint"))), 8, "0") for i in range(4)])


def column_marks(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows (column, mark): an order-free mark of each column's texts with their keys, in one pass."""
    marks = [multiset_mark(key, c).alias(c) for c in columns]
    return rows.agg(*marks).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("mark")) for c in columns])))


def fresh_columns(recorded: DataFrame, now: DataFrame) -> DataFrame:
    """Rows (column): those made from what the table holds now; a column whose texts have changed since is dropped."""
    return recorded.select("column", "mark").join(now.select("column", "mark"), ["column", "mark"], "left_semi").select("column")
