"""From scored tokens to scores, ranks, error rates and shares; and a built-in bigram scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from strokelake.operators.sampling import percentiles
from strokelake.sources.scratch import written

BATCH = 1024  # rows whose bigrams are counted at a time


def bigram_scores(tokens: DataFrame, vocabulary: int) -> DataFrame:
    """Rows (id, pos, token, nats): add-one smoothed bigram costs, counted on the same sequences. -1 stands before the first."""
    w = Window.partitionBy("id").orderBy("pos")
    rows = tokens.withColumn("before", F.coalesce(F.lag("token").over(w), F.lit(-1)))
    pair = rows.groupBy("before", "token").agg(F.count("*").alias("c"))
    first = pair.groupBy("before").agg(F.sum("c").alias("n"))
    cost = pair.join(first, "before").select("before", "token", (-F.ln((F.col("c") + 1) / (F.col("n") + vocabulary))).alias("nats"))
    cost = F.broadcast(cost) if (vocabulary + 1) ** 2 <= 1_000_000 else cost  # there are no more pairs than that
    return rows.join(cost, ["before", "token"]).select("id", "pos", "token", "nats")


def scored_by(examples: DataFrame, score: Callable[[list[list[int]]], list[list[float]]], column: str = "tokens") -> DataFrame:
    """Adds `nats` (one cost a token) from a user's model, called on batches in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = score(batch.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(costs, pa.list_(pa.float64()))], names=[*batch.schema.names, "nats"])

    return examples.mapInArrow(run, examples.withColumn("nats", F.lit(None).cast("array<double>")).schema)


def primed_costs(trials: DataFrame, words: DataFrame, by: list[str], vocabulary: int, firsts: tuple[int, ...] | None = None) -> DataFrame:
    """Rows (by, nats, moves) of trials (by, target, context): what a target's tokens cost after those of its context words, by
    add-one smoothed bigrams of the context alone, and its base moves. `words` are rows (id, tokens), tokens from 0 to below
    `vocabulary`. With `firsts`, rows (by, k, nats, moves) for each k of them: the costs after the first k words of the context.

    Words stay arrays: those of a trial meet in one row, whose bigrams a task counts in Arrow batches. No row is made for a token
    or a bigram, so what a task sorts is what it was dealt and does not unfold there.
    """
    small = "tinyint" if vocabulary <= 128 else "int"
    known_words = words.where(F.col("tokens").isNotNull()).select("id", F.col("tokens").cast(f"array<{small}>").alias("_tokens"))
    named = F.posexplode(F.flatten(F.array_compact(F.array(F.array("target"), "context"))))
    # files of tokens are far smaller than tokens, so that by their size too many would be broadcast
    asked = trials.select(*by, named.alias("_place", "id")).join(known_words.hint("merge"), "id").drop("id")
    rows = asked.repartition(*by).groupBy(*by).agg(F.collect_list(F.struct("_place", "_tokens")).alias("_words"))  # dealt first, so that a task holds what it was dealt
    counts = firsts or (None,)

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                known, moves, nats = bigram_costs(batch.column("_words"), vocabulary, counts)
                keys = batch.select(by).filter(pa.array(known))
                for k, each in zip(counts, nats, strict=True):
                    k_column = [] if k is None else [pa.array(np.full(keys.num_rows, k), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*keys.columns, *k_column, pa.array(each[known]), pa.array(moves[known])], names=names)

    kind = StructType([*trials.select(*by).schema, *([StructField("k", IntegerType())] if firsts else []), StructField("nats", DoubleType()), StructField("moves", LongType())])
    names = kind.names
    return rows.select(*by, "_words").mapInArrow(cost, kind)


def bigram_costs(words: pa.ListArray, vocabulary: int, counts: tuple[int | None, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of rows with a list of (place, tokens), the target at place 0: which have tokens of their own, their base moves, and their
    nats after the first k words for each k (None: all). -1 stands before the first token and after a null, which matches none."""
    each = words.flatten()
    place, lists = each.field("_place").to_numpy(), each.field("_tokens")
    sizes = pc.list_value_length(lists).to_numpy()
    row = np.repeat(np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy()), sizes)
    place = np.repeat(place, sizes)
    token = pc.fill_null(lists.flatten(), -2).to_numpy().astype(np.int64)
    before = np.roll(token, 1)
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = -1
    base = int(token.max(initial=0)) + 3
    first = row * base + np.maximum(before, -1) + 2
    pair = first * base + token + 2

    def found(keys: np.ndarray, seen: np.ndarray) -> np.ndarray:
        values, times = np.unique(seen, return_counts=True)
        at = np.minimum(np.searchsorted(values, keys), len(values) - 1)
        return np.where(values[at] == keys, times[at], 0) if len(values) else np.zeros(len(keys), np.int64)

    pairs, times = np.unique(pair[place == 0], return_counts=True)
    own, last = pairs // base**2, pairs % base - 2
    nats = []
    for k in counts:
        told = (place > 0) & (place <= (np.inf if k is None else k))
        share = (np.where(last == -2, 0, found(pairs, pair[told])) + 1) / (found(pairs // base, first[told]) + vocabulary)
        nats.append(np.bincount(own, times * -np.log(share), len(words)))
    moves = np.bincount(own, np.where((last >= 0) & (last < 8), times, 0), len(words)).astype(np.int64)
    return np.bincount(own, minlength=len(words)) > 0, moves, nats


def losses(scored: DataFrame, moves: Column, source: str = "source") -> DataFrame:
    """Rows (source, loss, word_score): nats a target, and nats a base move. `moves` says how many base moves a token stands for."""
    total = F.sum("nats")
    return scored.groupBy(source).agg((total / F.count("*")).alias("loss"), (total / F.sum(moves)).alias("word_score"))


def gap(held: DataFrame, seen: DataFrame, source: str, score: str) -> DataFrame:
    """One row: the mean over shared sources of held minus seen."""
    a, b = held.select(source, F.col(score).alias("h")), seen.select(source, F.col(score).alias("s"))
    return a.join(b, source).agg(F.avg(F.col("h") - F.col("s")).alias("gap"))


def ranks(costs: DataFrame, trial: str, own: Column, cost: str) -> DataFrame:
    """Rows (trial, rank): one plus the number of candidates strictly cheaper than the own one."""
    mine = F.min(F.when(own, F.col(cost))).over(Window.partitionBy(trial))
    return costs.withColumn("_own", mine).groupBy(trial).agg((1 + F.sum((F.col(cost) < F.col("_own")).cast("int"))).alias("rank"))


def rank_summary(ranked: DataFrame) -> DataFrame:
    return ranked.agg(F.count("*").alias("n"), F.avg("rank").alias("mean"), F.avg((F.col("rank") == 1).cast("int")).alias("first"))


def character_error(reads: DataFrame, source: str) -> DataFrame:
    """Rows (source, n, error, exact), and one with a null source for all: summed distances over summed lengths."""
    rows = reads.where(F.length("label") > 0)
    return rows.rollup(source).agg(F.count("*").alias("n"), (F.sum(F.levenshtein("read", "label")) / F.sum(F.length("label"))).alias("error"),
                                   F.avg((F.col("read") == F.col("label")).cast("int")).alias("exact"))


def by_role(scored: DataFrame, role: str = "role") -> DataFrame:
    """Rows (role, mean, nats_share, token_share)."""
    each = scored.groupBy(role).agg(F.sum("nats").alias("nats"), F.count("*").alias("n"))
    everything = Window.partitionBy()
    return each.select(role, (F.col("nats") / F.col("n")).alias("mean"), (F.col("nats") / F.sum("nats").over(everything)).alias("nats_share"), (F.col("n") / F.sum("n").over(everything)).alias("token_share"))


def by_progress(scored: DataFrame, key: str = "id", bins: int = 10) -> DataFrame:
    """Rows (bin, mean, n) by place in the sequence."""
    length = F.count("*").over(Window.partitionBy(key))
    return scored.withColumn("_n", length).withColumn("bin", F.least(F.floor(F.col("pos") * bins / F.col("_n")), F.lit(bins - 1)).cast("int")).groupBy("bin").agg(F.avg("nats").alias("mean"), F.count("*").alias("n"))


def progress_gain(told: DataFrame, untold: DataFrame) -> DataFrame:
    """Rows (bin, gain, share): what telling saves in each bin, and its share of all savings."""
    gain = untold.select("bin", F.col("mean").alias("u")).join(told.select("bin", F.col("mean").alias("t")), "bin").select("bin", (F.col("u") - F.col("t")).alias("gain"))
    return gain.withColumn("share", F.col("gain") / F.sum("gain").over(Window.partitionBy()))


def runs(rows: DataFrame, key: str, pos: str, value: str, least: int = 3) -> DataFrame:
    """Rows (key, value, start, length): a run under `least` between two equal neighbours is absorbed; then the longest
    run of each value in each key, of those with at least `least` places."""
    order = Window.partitionBy(key).orderBy(pos)

    def islands(df: DataFrame) -> DataFrame:
        new = F.coalesce((F.col(value) != F.lag(value).over(order)).cast("int"), F.lit(0))
        return df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order)).groupBy(key, "_island", value).agg(F.min(pos).alias(pos), F.count("*").alias("length"))

    first = islands(rows.select(key, pos, value))
    w = Window.partitionBy(key).orderBy("_island")
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    filled = first.withColumn("_fill", F.when((F.col("length") < least) & (before == after), before)).withColumn(value, F.coalesce("_fill", value)).drop("_fill", "_island")
    new = F.coalesce((F.col(value) != F.lag(value).over(order)).cast("int"), F.lit(0))
    joined = filled.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order)).groupBy(key, "_island", value).agg(F.min(pos).alias("start"), F.sum("length").alias("length"))
    rank = F.row_number().over(Window.partitionBy(key, value).orderBy(F.desc("length"), "start"))
    return joined.where(F.col("length") >= least).withColumn("_r", rank).where("_r = 1").select(key, value, "start", "length")


def heat(cells: DataFrame, kernel: dict[tuple[int, int], float]) -> DataFrame:
    """Rows (x, y, mass): counts by cell spread by a kernel of offsets."""
    counts = cells.groupBy("x", "y").agg(F.count("*").alias("n"))
    spread = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(w).alias("w")) for (a, b), w in kernel.items()])
    return counts.select("x", "y", "n", F.inline(spread)).groupBy((F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y")).agg(F.sum(F.col("n") * F.col("w")).alias("mass"))


def half_mass_level(heat_map: DataFrame, share: float = 0.5) -> DataFrame:
    """One row (level): the mass at which the fullest cells hold `share` of all, null without cells.

    Distinct masses are dealt into ranges and written; the sums of the ranges tell which one holds the level, and only
    that range is summed in order.
    """
    by = heat_map.groupBy("mass").agg(F.sum("mass").alias("m"))
    ranged = written(by.repartitionByRange(F.desc("mass")).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(F.sum("m").alias("_m"))  # a row for each range
    so_far = F.sum("_m").over(Window.orderBy("_part"))
    placed = sums.select("_part", "_m", so_far.alias("_to"), (F.sum("_m").over(Window.partitionBy()) * share).alias("_want")).where("_to >= _want")
    cut = placed.orderBy("_part").limit(1).select("_part", (F.col("_want") - F.col("_to") + F.col("_m")).alias("_left"))
    inside = F.sum("m").over(Window.partitionBy("_part").orderBy(F.desc("mass")))
    ran = ranged.join(F.broadcast(cut), "_part").withColumn("_c", inside)  # one row is broadcast
    # rounding can put the level past its range's last sum: then it is the least mass there
    return ran.agg(F.coalesce(F.max(F.when(F.col("_c") >= F.col("_left"), F.col("mass"))), F.min("mass")).alias("level"))


def extremes(rows: DataFrame, measure: str, key: str, k: int) -> DataFrame:
    """The k least and the k greatest rows, with their side and rank."""
    low = rows.orderBy(F.asc(measure), key).limit(k).withColumn("side", F.lit("low"))
    high = rows.orderBy(F.desc(measure), key).limit(k).withColumn("side", F.lit("high"))
    return low.unionByName(high)


def gap_threshold(gaps: DataFrame, gap_column: str, rounds: int, low: float = 0.25, high: float = 0.90) -> float:
    """Two means on log gaps, from two percentiles, in a fixed number of rounds; the middle of the two, back from the log."""
    logs = gaps.where(F.col(gap_column) > 0).select(F.ln(gap_column).alias("g")).persist()
    a, b = percentiles(logs, None, "g", [low, high]).first()["q"]
    for _ in range(rounds):
        cut = (a + b) / 2
        m = logs.agg(F.avg(F.when(F.col("g") <= cut, F.col("g"))).alias("a"), F.avg(F.when(F.col("g") > cut, F.col("g"))).alias("b")).first()
        a, b = m.a if m.a is not None else a, m.b if m.b is not None else b
    logs.unpersist()
    import math

    return math.exp((a + b) / 2)


def sessions(rows: DataFrame, key: str, at: Column, order: list[str], threshold: float) -> DataFrame:
    """Adds `session`: a new one where the gap to the row before passes the threshold."""
    w = Window.partitionBy(key).orderBy(*order)
    new = F.coalesce((at - F.lag(at).over(w) > threshold).cast("int"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(w)).drop("_new")


