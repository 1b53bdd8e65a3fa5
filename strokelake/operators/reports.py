"""Report tables over metrics logs: best rows, ablations, seed spread, Markdown in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_and_last(metrics: DataFrame, run: str, loss: str, step: str) -> DataFrame:
    """One row a run: the row of the least loss and that of the last step, as structs."""
    row = F.struct(*metrics.columns)
    return metrics.groupBy(run).agg(F.min_by(row, F.struct(loss, step)).alias("best"), F.max_by(row, step).alias("last"))


def ablation(scores: DataFrame, run: str, source: str, score: str, base: str) -> DataFrame:
    """Rows (run, score, delta, n): means over the sources shared with the base run, and the mean difference to it."""
    own = scores.select(run, source, F.col(score).alias("s"))
    reference = own.where(F.col(run) == base).select(source, F.col("s").alias("b"))
    return own.join(reference, source).groupBy(run).agg(F.avg("s").alias("score"), F.avg(F.col("s") - F.col("b")).alias("delta"), F.count("*").alias("n"))


def pivoted(scores: DataFrame, run: str, source: str, score: str, sources: list[str]) -> DataFrame:
    return scores.groupBy(run).pivot(source, sources).agg(F.first(score))


def seed_spread(rows: DataFrame, group: str, value: str, seed: str, expected: int, places: int = 3) -> DataFrame:
    """Rows (group, text): mean and sample deviation over seeds, below the shown places as `<`; the first seed's value if any is missing."""
    n = F.count(value)
    g = rows.groupBy(group).agg(n.alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("sd"), F.min_by(value, seed).alias("first"))
    number = lambda c: F.format_string(f"%.{places}f", c)
    small = F.round("sd", places) == 0
    spread = F.when(small, F.lit(f"<{10**-places:.{places}f}")).otherwise(number(F.col("sd")))
    return g.select(group, F.when((F.col("n") < expected) | (F.col("n") < 2), number(F.col("first"))).otherwise(F.concat(number(F.col("m")), F.lit(" ± "), spread)).alias("text"))


def finished(metrics: DataFrame, run: str, step: str, least: int) -> DataFrame:
    """Rows of the runs whose last step reaches `least`."""
    done = metrics.groupBy(run).agg(F.max(step).alias("_last")).where(F.col("_last") >= least).select(run)
    return metrics.join(done, run, "left_semi")


def later_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def best_configuration(rows: DataFrame, group: str, name: str, score: str) -> DataFrame:
    return rows.groupBy(group).agg(F.min_by(name, F.struct(score, name)).alias(name), F.min(score).alias(score))


def signed(value: Column, places: int = 3) -> Column:
    return F.format_string(f"%+.{places}f", value)


def markdown_rows(lines: DataFrame, keep_real: str = "7") -> DataFrame:
    """Rows (file, key, cells) of result tables in Markdown: lines (file, value) led by a pipe with more than two cells;
    headers, rulers and rows of real ink but the one for `keep_real` sources go; a later file wins."""
    cells = F.transform(F.filter(F.split("value", r"\|"), lambda c, i: i > 0), lambda c: F.trim(c))
    rows = lines.where(F.trim("value").startswith("|")).select("file", cells.alias("cells")).withColumn("cells", F.slice("cells", F.lit(1), F.greatest(F.lit(0), F.size("cells") - 1)))
    rows = rows.where((F.size("cells") > 2) & ~F.get("cells", F.lit(0)).rlike("^[-: ]*$") & (F.lower(F.get("cells", F.lit(0))) != "run"))
    real = F.get("cells", F.lit(0)).startswith("real ink")
    rows = rows.where(~real | F.get("cells", F.lit(0)).contains(keep_real))
    return later_wins(rows.withColumn("key", F.substring_index(F.get("cells", F.lit(0)), " (", 1)), "key", "file")


def markdown_line(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
