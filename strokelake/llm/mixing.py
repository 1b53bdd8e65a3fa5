"""Mixing sources to target weights.

Sources weigh 5, 2, 1, repeating, in code-point order (null last) and share all words; a target stops at `most` times
its source's size and the excess is reshared by weight. Documents get hash-random keys (md5 of doc_id and a seed); the
key's leading bits deal each source into equal key ranges, sums over the ranges give each range its start, and a
running sum inside a range places each document. A source of any size is thus spread over many tasks. The words from
0 to the budget are taken: whole rounds of the source first, then the prefix up to the exact cut.

Defined cases: null text has size 0 and takes nothing; null source is a source of its own; rows with equal keys are
ordered by size; an empty table, or one without words, takes nothing; extra input columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strokelake.llm.common import n_words, small_or_plain, written

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix"
ROWS_PER_RANGE = 5_000
BROADCAST_SOURCES = 50_000


def random_key(doc_id: Column, seed: str = SEED) -> Column:
    """52 bits of md5: the same in every run and engine."""
    text = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """From (source, source_size), one row a source: adds weight and target by capped resharing.

    In order of `most * size / weight` the sources that reach their ceiling come first: a source is capped if sharing
    what the sources before it leave, by weight among the rest, would pass its ceiling. One running sum finds them all.
    """
    # One row a source here: as many rows as there are sources, never as many as documents.
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", weight.alias("weight")).withColumn("ceiling", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(rest)
    shared = ranked.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") > F.col("ceiling"))
    # the level at which the first uncapped source stands holds for all sources from there on
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("ceiling") / F.col("weight"), F.col("level")))).over(everything)["level"]
    return (shared.withColumn("final", final)
            .withColumn("target", F.when(F.col("capped"), F.col("ceiling")).otherwise(F.least("ceiling", F.col("final") * F.col("weight"))))
            .select("source", "source_size", "weight", "target"))


def mix(docs: DataFrame, carry: list[str] | None = None, weights=WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken[, carried columns]), one per input row.

    Only the one range of each source that holds its cut is sorted; what lies below it is taken and what lies above is
    not, so carried columns (whole texts, say) are shuffled for that range alone.
    """
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"),
                        random_key(F.col("doc_id"), seed).alias("key"), *(carry or []))
    slim = written(sized.select("doc_id", "source", "size", "key"), "mix-sizes")
    placed = sized if carry else slim
    ranges = max(1, slim.count() // ROWS_PER_RANGE)
    in_range = (F.col("key") / F.lit(2.0**52) * ranges).cast("int")
    parts = slim.groupBy("source", in_range.alias("p")).agg(F.sum("size").alias("part_size"))
    whole = Window.partitionBy("source")
    starts = written(parts.select("source", "p", "part_size", F.sum("part_size").over(whole).alias("total"),
                                  (F.sum("part_size").over(whole.orderBy("p")) - F.col("part_size")).alias("start")), "mix-starts")
    goals = written(targets(starts.groupBy("source").agg(F.max("total").alias("source_size")), weights, most), "mix-targets")
    goals = goals.select(F.col("source").alias("s"), "source_size", "target")
    budget = F.round(F.col("target")).cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    ranged = starts.join(small_or_plain(goals, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("s"))).select(
        "s", "p", "source_size", "target", rounds.alias("rounds"), "part_size", (budget - rounds * F.col("source_size") - F.col("start")).alias("room"))
    ranged = written(ranged, "mix-ranges")
    joined = placed.withColumn("part", in_range).join(
        small_or_plain(ranged, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    cut_here = (F.col("room") > 0) & (F.col("room") < F.col("part_size"))
    order = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(F.sum("size").over(order), F.lit(0))
    edge = joined.where(cut_here).withColumn("last", F.greatest(F.lit(0), F.least("size", F.col("room") - above)))
    clear = joined.where(~cut_here).withColumn("last", F.when(F.col("room") > 0, F.col("size")).otherwise(0))
    taken = (F.col("rounds") * F.col("size") + F.col("last")).cast("long")
    return clear.unionByName(edge).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), *(carry or []))


def mixed(docs: DataFrame) -> DataFrame:
    """The mixture itself, with the input's columns: a document once per whole round, and cut after its words at the budget."""
    got = mix(docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row")), carry=["row"])
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    copies = got.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    part = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    led = F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))  # words with the space before them
    text = F.when(part >= F.col("size"), F.col("row.text")).otherwise(F.array_join(F.slice(led, F.lit(1), part), ""))
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return copies.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
