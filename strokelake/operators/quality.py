"""Quality gates and selection over tables of measures."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from strokelake.functions.arrays import rounded, uniform
from strokelake.operators.sampling import percentiles, places

# Thresholds of the trace gate.
RULES = {"coverage": 0.80, "coverage_read": 0.70, "read_error_strict": 0.15, "min_mark": 0.5, "precision": 0.90, "read_error": 0.34,
         "length_ratio": 1.6, "retrace": 0.35, "max_mark_length": 1.95}
X_HEIGHT, INK_HEIGHT = 0.123, 0.22


def held_out(key: Column, k: int) -> Column:
    """CRC-32 of the key's text divides by k."""
    return F.crc32(key.cast("string").cast("binary")) % k == 0


def one_word(text: Column, limit: int) -> Column:
    """At most `limit` UTF-8 bytes and exactly one word between white space."""
    return (F.octet_length(text) <= limit) & (F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) == 1)


def words_kept(rows: DataFrame, text: str, limit: int, name: str = "words") -> tuple[DataFrame, Observation]:
    """The rows whose text is one word within the limit, and an observation that counts those and the dropped ones by reason.

    The counts are there once the rows have been written or collected; they cost no pass of their own.
    """
    long = F.octet_length(text) > limit
    one = one_word(F.col(text), limit)
    reason = F.when(F.col(text).isNull(), "no text").when(long, "too long").when(~one, "not one word").otherwise("kept")
    counts = Observation(f"{name}-{uuid.uuid4().hex}")
    seen = rows.observe(counts, *[F.count(F.when(reason == r, 1)).alias(r) for r in ("kept", "too long", "not one word", "no text")])
    return seen.where(one), counts


def held_out_writers(rows: DataFrame, k: int, source: str = "source", writer: str = "writer") -> DataFrame:
    """Rows (source, writer) held out by hash, of sources with at least k writers."""
    writers = rows.select(source, writer).distinct()
    enough = writers.groupBy(source).agg(F.count("*").alias("n")).where(F.col("n") >= k).select(source)
    return writers.where(held_out(F.col(writer), k)).join(enough, source, "left_semi")


def held_out_words(rows: DataFrame, k: int, most: int, key: str = "id", source: str = "source", writer: str = "writer", seed: str = "held") -> DataFrame:
    """Rows of held-out writers, at most `most` a source, in hash order of key."""
    words = rows.join(held_out_writers(rows, k, source, writer), [source, writer], "left_semi")
    return capped(words, source, [uniform(seed, F.col(key)), F.col(key)], most)


def trace_gate(rows: DataFrame) -> DataFrame:
    """Adds read_error, reasons (failed rules) and passed to rows (read, label, measures)."""
    error = F.levenshtein("read", "label") / F.greatest(F.length("label"), F.lit(1))
    r = RULES
    covered = (F.col("coverage") >= r["coverage"]) | ((F.col("coverage") >= r["coverage_read"]) & (F.col("read_error") <= r["read_error_strict"]))
    checks = {"coverage": ~covered, "mark": F.col("min_mark") < r["min_mark"], "precision": F.col("precision") < r["precision"], "read": F.col("read_error") > r["read_error"],
              "length": F.col("length_ratio") > r["length_ratio"], "retrace": F.col("retrace") > r["retrace"], "long": F.col("max_mark_length") > r["max_mark_length"]}
    reasons = F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in checks.items()]))
    return rows.withColumn("read_error", error).withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def best_candidate(rows: DataFrame, item: str = "item", score: Column | None = None) -> DataFrame:
    """One row an item: passed first, then the best score, then the first."""
    score = F.col("coverage") * F.col("precision") if score is None else score
    w = Window.partitionBy(item).orderBy(F.desc("passed"), score.desc(), "seq")
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def retry(first: DataFrame, second: DataFrame, least: int, item: str = "item", by: str | None = None) -> DataFrame:
    """The first round, and of the second the items that did not pass, where fewer than `least` did: of all, or of each group."""
    passed = first.where("passed").select(item, *([by] if by else [])).distinct()
    again = second.join(passed.select(item), item, "left_anti")
    if by:
        enough = passed.groupBy(by).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(by)
        again = again.join(enough, by, "left_anti")
    else:
        few = passed.agg((F.count("*") < least).alias("few"))  # one row
        again = again.join(F.broadcast(few), F.col("few"), "left_semi")
    return first.unionByName(again.select(*first.columns))


def eligible_label(label: Column, legibility: Column) -> Column:
    return (legibility >= 6) & F.length(label).between(2, 12) & label.rlike(r"^[\x21-\x7e]+$") & label.rlike("[a-z]")


def within_class(rows: DataFrame, by: str, measure: str, low: float, high: float) -> DataFrame:
    """Rows whose measure lies between two percentiles of their class."""
    cut = percentiles(rows, by, measure, [low, high]).withColumnRenamed("q", "_cut")
    return rows.join(cut, by).where(F.col(measure).between(F.col("_cut")[0], F.col("_cut")[1])).drop("_cut")


def balanced_best(rows: DataFrame, by: str, quality: Column, key: str, factor: int = 2) -> DataFrame:
    """Best rows by class, no class more than `factor` times the smallest; `rank` from 1."""
    least = rows.groupBy(by).agg(F.count("*").alias("n")).agg((factor * F.min("n")).alias("_limit"))  # one row
    ranked = places(rows.withColumn("_q", quality), by, [F.col("_q").desc(), F.col(key)])
    return ranked.join(F.broadcast(least), F.col("_at") < F.col("_limit")).select(*rows.columns, (F.col("_at") + 1).cast("int").alias("rank"))


def top_share(rows: DataFrame, by: str, quality: Column, key: str, share: float) -> DataFrame:
    """The best share of each class."""
    ranked = places(rows.withColumn("_q", quality), by, [F.col("_q").desc(), F.col(key)])
    return ranked.where(F.col("_at") < F.ceil(share * F.col("_n"))).select(*rows.columns)


def capped(rows: DataFrame, by: str, order: list[Column], limit: int) -> DataFrame:
    """At most `limit` rows of each group, in order."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def numbers_known(text: Column, source: Column) -> Column:
    """All numbers of a caption occur in its source text."""
    return F.size(F.array_except(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), F.regexp_extract_all(source, F.lit(r"\d+"), F.lit(0)))) == 0


def funnel(rows: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """Rows (place, stage, n): rows that pass each stage and all before it, in one pass."""
    passed, columns, before = [], [], F.lit(True)
    for name, test in stages.items():
        before = before & F.coalesce(test, F.lit(False))
        columns.append(F.sum(before.cast("long")).alias(name))
        passed.append(name)
    pairs = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("stage"), F.coalesce(F.col(n), F.lit(0)).alias("n")) for i, n in enumerate(passed)])
    return rows.agg(*columns).select(F.inline(pairs))


def distinct_by(rows: DataFrame, content: list[str], key: str) -> DataFrame:
    """One row for each content, the one with the least key (a unique column). Nulls are contents of their own.

    Contents are grouped by SHA-256 of their JSON, which tells nulls, columns and any character apart, so long ones are
    not shuffled.
    """
    line = F.to_json(F.struct(*content), {"ignoreNullFields": "false"})
    first = rows.groupBy(F.sha2(line.cast("binary"), 256).alias("_s")).agg(F.min(key).alias(key))
    return rows.join(first.select(key), key, "left_semi")


def frame_check(words: DataFrame, by: str = "writer") -> DataFrame:
    """Rows (by, x_height, baseline, ink_height, errors) from rows (by, id, short, y): medians of percentile heights.

    `short` marks words of short letters only; a median needs five words.
    """
    per = words.groupBy(by, "id", "short").agg(F.count("*").alias("n"), F.percentile("y", F.array(F.lit(0.02), F.lit(0.98))).alias("q"), F.percentile("y", F.array(F.lit(0.05), F.lit(0.95))).alias("r")).where("n >= 3")
    some = lambda c, test: F.when(F.count(F.when(test, 1)) >= 5, F.median(F.when(test, c)))
    out = per.groupBy(by).agg(some(F.col("q")[1] - F.col("q")[0], F.col("short")).alias("x_height"), some(F.col("q")[1], F.col("short")).alias("baseline"),
                              some(F.col("r")[1] - F.col("r")[0], F.lit(True)).alias("ink_height"))
    ratio, ink = F.col("x_height") / X_HEIGHT, F.col("ink_height") / INK_HEIGHT
    errors = F.array_compact(F.array(F.when((ratio <= 0.6) | (ratio >= 1.7), F.lit("x-height")), F.when(F.abs("baseline") > 0.06, F.lit("baseline")),
                                     F.when(F.col("x_height").isNull() & ((ink <= 0.5) | (ink >= 2)), F.lit("ink height"))))
    return out.withColumn("errors", errors)


def frame_warnings(points: DataFrame, words: DataFrame, grid: float, by: str = "writer", most_long: float = 0.05) -> DataFrame:
    """Rows (by, spacing, long_steps, tokens_per_char, warnings) of rows (by, id, seq, x, y, pen) and (id, tokens, chars).

    Steps lie between neighbouring points with the pen down; words with under three such points do not count.
    """
    at = Window.partitionBy("id").orderBy("seq")
    step = F.when((F.col("pen") == 1) & (F.lag("pen").over(at) == 1), F.hypot(F.col("x") - F.lag("x").over(at), F.col("y") - F.lag("y").over(at)))
    stepped = points.withColumn("_step", step)
    enough = stepped.groupBy(by, "id").agg(F.sum("pen").alias("n")).where("n >= 3")
    steps = stepped.where("_step IS NOT NULL").join(enough.select("id"), "id", "left_semi").groupBy(by).agg(
        F.median("_step").alias("spacing"), F.avg((F.col("_step") > grid).cast("int")).alias("long_steps"))
    chars = enough.select(by, "id").join(words, "id").groupBy(by).agg((F.sum("tokens") / F.greatest(F.sum("chars"), F.lit(1))).alias("tokens_per_char"))
    return chars.join(steps, by, "left").withColumn("warnings", F.array_compact(F.array(F.when(F.col("long_steps") > most_long, F.lit("long steps")))))


def x_height_ladder(rows: DataFrame, by: str = "writer") -> DataFrame:
    """Rows (by, method, height): the first of words, letters and bands that has enough values (5, 5, 3), from rows (by, kind, height)."""
    ladder = (("words", 5), ("letters", 5), ("bands", 3))
    agg = [F.when(F.count(F.when(F.col("kind") == k, 1)) >= n, F.median(F.when(F.col("kind") == k, F.col("height")))).alias(k) for k, n in ladder]
    method = reduce(lambda c, k: c.when(F.col(k).isNotNull(), k), [k for k, _ in ladder[1:]], F.when(F.col("words").isNotNull(), "words")).otherwise("none")
    return rows.groupBy(by).agg(*agg).select(by, method.alias("method"), F.coalesce(*[F.col(k) for k, _ in ladder]).alias("height"))


def stage_cuts(strokes: DataFrame, stages: int = 5) -> DataFrame:
    """Rows (id, stroke, stage) from rows (id, stroke, x0, y0, x1, y1): cut at the largest pen jumps, equal ones (to nine places)
    in order of strokes."""
    w = Window.partitionBy("id").orderBy("stroke")
    jump = rounded(F.hypot(F.col("x0") - F.lag("x1").over(w), F.col("y0") - F.lag("y1").over(w)), 9)
    ranked = strokes.withColumn("jump", jump).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc_nulls_last("jump"), "stroke")))
    cut = (F.col("r") <= stages - 1) & F.col("jump").isNotNull()
    return ranked.select("id", "stroke", F.sum(cut.cast("int")).over(w).alias("stage"))
