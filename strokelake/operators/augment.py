"""Order changes of strokes, standard frames, quality probes, trials and tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strokelake.functions import geometry as g
from strokelake.functions.arrays import let, uniform
from strokelake.operators.quality import INK_HEIGHT, X_HEIGHT
from strokelake.operators.sampling import places


def altered_order(sizes: list[int], draws: list[float], swap: float, least: int) -> list[int]:
    """Stroke numbers after a walk that swaps neighbours with probability `swap`, never the longest, skipping one after a swap."""
    order = list(range(len(sizes)))
    if len(sizes) < least:
        return order
    longest = max(range(len(sizes)), key=lambda i: sizes[i])
    i = 0
    while i < len(order) - 1:
        if draws[i] < swap and longest not in (order[i], order[i + 1]):
            order[i], order[i + 1] = order[i + 1], order[i]
            i += 1
        i += 1
    return order


def alter(ink: DataFrame, swap: float, seed: str = "alter", least: int = 4) -> DataFrame:
    """Strokes in a changed order: (id, strokes). The walk is sequential, so it runs in Arrow batches on sizes and draws alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders = [altered_order(s, d, swap, least) for s, d in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(orders, pa.list_(pa.int32()))], names=["id", "strokes", "order"])

    sizes = F.transform("strokes", F.size)
    draws = F.transform("strokes", lambda s, i: uniform(seed, F.col("id"), i))
    kind = ink.schema["strokes"].dataType.simpleString()
    rows = ink.select("id", "strokes", sizes.alias("sizes"), draws.alias("draws")).mapInArrow(run, f"id string, strokes {kind}, order array<int>")
    return rows.select("id", F.transform("order", lambda i: F.get("strokes", i)).alias("strokes"))


def reversed_stroke(s: Column) -> Column:
    return F.reverse(s)


def restarted(s: Column, at: Column) -> Column:
    """A closed stroke (ends under 0.03 apart, more than three points) begun at another of its points."""
    closed = (F.size(s) > 3) & (F.hypot(F.element_at(s, 1)["x"] - F.element_at(s, -1)["x"], F.element_at(s, 1)["y"] - F.element_at(s, -1)["y"]) < 0.03)
    inside = F.greatest(F.lit(1), F.least(at, F.size(s) - 2))
    return F.when(closed, F.concat(F.slice(s, inside + 1, F.size(s) - inside), F.slice(s, F.lit(2), inside))).otherwise(s)


def redrawn(strokes: Column, key: Column, restart: float, reverse: float, seed: str = "redraw") -> Column:
    """Closed strokes begun at another point and strokes drawn backwards, each with its probability."""

    def one(s: Column, i: Column) -> Column:
        at = 1 + F.floor(uniform(f"{seed}-at", key, i) * (F.size(s) - 2)).cast("int")
        begun = F.when(uniform(f"{seed}-restart", key, i) < restart, restarted(s, at)).otherwise(s)
        return let(begun, lambda b: F.when(uniform(f"{seed}-reverse", key, i) < reverse, F.reverse(b)).otherwise(b))

    return F.transform(strokes, one)


WAVES = 3


def bend_parameters(key: Column, grid: float, warp: float, perspective: float, rotate: float, shear: float, stretch: float, shift: float, seed: str = "bend") -> Column:
    """A struct of the numbers of one bend, drawn by hash of key: for each wave its direction and length (wx, wy), phase and
    push (px, py); tilt (tx, ty), the matrix a b c d of turning, shear and size, and the shift (sx, sy) with a nudge inside a cell."""
    u = lambda name, k=0: uniform(f"{seed}-{name}", key, k)
    around = lambda name, most: (2 * u(name) - 1) * most
    normal = lambda name, k, f: F.sqrt(-2 * F.ln(F.greatest(u(name, k), F.lit(1e-12)))) * f(2 * math.pi * u(f"{name}-turn", k))
    waves = []
    for k in range(WAVES):
        angle, size = 2 * math.pi * u("angle", k), 0.4 + 0.6 * u("length", k)
        waves.append(F.struct((F.cos(angle) * size).alias("wx"), (F.sin(angle) * size).alias("wy"), (2 * math.pi * u("phase", k)).alias("phase"),
                              (normal("push", k, F.cos) * (warp / math.sqrt(WAVES))).alias("px"), (normal("push", k, F.sin) * (warp / math.sqrt(WAVES))).alias("py")))
    turn, lean = around("rotate", math.radians(rotate)), around("shear", shear)
    wide, high = F.exp(around("wide", stretch)), F.exp(around("high", stretch))
    c, s = F.cos(turn), F.sin(turn)
    return F.struct(F.array(*waves).alias("waves"), around("tilt-x", perspective).alias("tx"), around("tilt-y", perspective).alias("ty"),
                    (c * wide).alias("a"), (s * high).alias("b"), ((lean * c - s) * wide).alias("c"), ((lean * s + c) * high).alias("d"),
                    (around("shift-x", shift) + (u("nudge-x") - 0.5) * grid).alias("sx"), (around("shift-y", shift) + (u("nudge-y") - 0.5) * grid).alias("sy"))


def bent(strokes: Column, how: Column) -> Column:
    """Strokes moved by a bend: waves, perspective, matrix, then centred and shifted. Long steps are made short before (densify)."""

    def middle(s: Column, body) -> Column:
        x, y = F.transform(F.flatten(s), lambda p: p["x"]), F.transform(F.flatten(s), lambda p: p["y"])
        return let(F.struct(((F.array_min(x) + F.array_max(x)) / 2).alias("x"), ((F.array_min(y) + F.array_max(y)) / 2).alias("y")), body)

    def moved(h: Column, m: Column) -> Column:
        def point(p: Column) -> Column:
            x, y = p["x"] - m["x"], p["y"] - m["y"]
            pushed = lambda c: F.aggregate(h["waves"], F.lit(0.0), lambda t, w: t + F.sin(2 * math.pi * (x * w["wx"] + y * w["wy"]) + w["phase"]) * w[c])

            def tilted(q: Column) -> Column:
                return let(1 + q["x"] * h["tx"] + q["y"] * h["ty"], lambda d: F.struct(
                    ((q["x"] * h["a"] + q["y"] * h["c"]) / d).alias("x"), ((q["x"] * h["b"] + q["y"] * h["d"]) / d).alias("y")))

            return let(F.struct((x + pushed("px")).alias("x"), (y + pushed("py")).alias("y")), tilted)

        return let(g.map_points(strokes, point), lambda s: middle(s, lambda n: g.map_points(s, lambda p: F.struct((p["x"] - n["x"] + h["sx"]).alias("x"), (p["y"] - n["y"] + h["sy"]).alias("y")))))

    return let(how, lambda h: middle(strokes, lambda m: moved(h, m)))


def standardised(ink: DataFrame, frames: DataFrame, by: str = "writer") -> DataFrame:
    """Ink scaled to the standard x-height, or ink height where a writer has none; first point at x 0, baseline at 0.

    Frames: rows (by, x_height, ink_height, baseline), one a writer.
    """
    k = F.coalesce(X_HEIGHT / F.col("x_height"), INK_HEIGHT / F.col("ink_height"), F.lit(1.0))
    scaled = let(F.get(F.flatten("strokes"), F.lit(0))["x"], lambda x0: g.map_points(
        F.col("strokes"), lambda p: F.struct(((p["x"] - x0) * k).alias("x"), ((p["y"] - F.coalesce("baseline", F.lit(0.0))) * k).alias("y"))))
    return ink.join(frames, by, "left").select(*[c for c in ink.columns if c != "strokes"], scaled.alias("strokes"))


def pair_differences(rows: DataFrame, by: str, key: str, quality: str, features: list[str]) -> DataFrame:
    """Rows of better-minus-worse feature differences: each row with the next in quality of its group, so that pairs are
    as many as rows."""
    w = Window.partitionBy(by).orderBy(F.desc(quality), key)
    nxt = {f"_{c}": F.lead(c).over(w) for c in [quality, *features]}
    return rows.withColumns(nxt).where(F.col(quality) > F.col(f"_{quality}")).select(by, key, *[(F.col(c) - F.col(f"_{c}")).alias(c) for c in features])


def ridge_of_pairs(differences: DataFrame, features: list[str], alpha: float) -> list[float]:
    """Weights w that make w . difference near 1 for better-minus-worse rows: ridge without an intercept, from summed products."""
    import numpy as np

    d = len(features)
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"_{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features)] + [F.sum(a).alias(f"_{i}") for i, a in enumerate(features)]
    r = differences.agg(*sums).first()
    m = np.array([[r[f"_{i}_{j}"] or 0.0 for j in range(d)] for i in range(d)]) + alpha * np.eye(d)
    return np.linalg.solve(m, np.array([r[f"_{i}"] or 0.0 for i in range(d)])).tolist()


def rank_correlation(rows: DataFrame, by: str, a: Column, b: Column, key: str) -> DataFrame:
    """Rows (by, n, correlation): correlation of the ranks of two measures in each group, ties in order of key."""
    one = places(rows.select(by, a.alias("_u"), b.alias("_v"), key), by, [F.col("_u"), F.col(key)], "_a", "_n")
    both = places(one.select(by, "_v", key, "_a"), by, [F.col("_v"), F.col(key)], "_b", "_n")
    return both.groupBy(by).agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("correlation"))


def style_trials(words: DataFrame, source: str, writer: str, key: str, n: int, k: int, seed: str = "trial", fits: tuple[str, str, int, int] | None = None) -> DataFrame:
    """Rows (source, trial, place, candidate, primes, target): for each writer as the true one, itself and n - 1 others of its
    source, each with k words, and the true writer's next word as the target. Sources with under n writers that have more
    than k words give none.

    `fits` names a column of tokens counted and of bytes, with the block and the bytes they must fit into: a trial of which
    one candidate's words overflow with the target goes as a whole.
    Writers stand in a ring by hash; a writer's rivals are the next ones, so trials are n rows a writer.
    """
    order = Window.partitionBy(source, writer).orderBy(uniform(seed, F.col(key)), key)
    tokens, size = (F.col(c) for c in fits[:2]) if fits else (F.lit(0), F.lit(0))
    ranked = words.select(source, writer, key, tokens.alias("_t"), size.alias("_b"), F.row_number().over(order).alias("_r")).where(F.col("_r") <= k + 1)
    primes = ranked.groupBy(source, writer).agg(F.sort_array(F.collect_list(F.struct("_r", F.col(key).alias("k"), F.col("_t").alias("t"), F.col("_b").alias("b")))).alias("p")).where(F.size("p") > k)
    summed = lambda c: F.aggregate(F.slice("p", 1, k), F.lit(0), lambda a, x: a + x[c].cast("int"))
    last = F.get("p", F.lit(k))
    ring = primes.select(source, writer, F.transform(F.slice("p", 1, k), lambda x: x["k"]).alias("primes"), last.alias("last"), summed("t").alias("t"), summed("b").alias("b"), (F.row_number().over(Window.partitionBy(source).orderBy(uniform(seed, F.col(writer)), writer)) - 1).alias("at"),
                         F.count("*").over(Window.partitionBy(source)).alias("writers")).where(F.col("writers") >= n)
    trials = ring.select(source, F.col(writer).alias("trial"), "last", "writers", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.col("at") + i) % F.col("writers"))).alias("place", "at"))
    met = trials.join(ring.select(source, "at", F.col(writer).alias("candidate"), "primes", "t", "b"), [source, "at"])
    if fits:
        over = (F.col("t") + F.col("last.t") + 2 * k > fits[2] - 2) | (F.col("b") + F.col("last.b") + k > fits[3])
        met = met.withColumn("_over", F.max(over).over(Window.partitionBy(source, "trial"))).where("NOT _over")
    return met.select(source, "trial", "place", "candidate", "primes", F.col("last.k").alias("target"))


def transfer_tasks(words: DataFrame, writer: str, key: str, text: str, targets: int, primers: int, seed: str = "transfer") -> DataFrame:
    """Rows (writer, role, key): target words (letters only, 3 to 8) at random, and primers whose text is no target's; of
    writers with four words or more."""
    many = words.groupBy(writer).agg(F.count("*").alias("_n")).where("_n >= 4").select(writer)
    own = words.join(many, writer, "left_semi").withColumn("_u", uniform(seed, F.col(key)))
    w = Window.partitionBy(writer).orderBy("_u", key)
    target = own.where(F.col(text).rlike("^[A-Za-z]{3,8}$")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= targets)
    known = target.select(writer, F.lower(text).alias("_t")).distinct()
    rest = own.withColumn("_t", F.lower(text)).join(known, [writer, "_t"], "left_anti").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= primers)
    return target.select(writer, F.lit("target").alias("role"), key).unionByName(rest.select(writer, F.lit("primer").alias("role"), key))


def shared_columns(tables: dict[str, DataFrame], required: str, subset: list[str] | None = None) -> list[str]:
    """Columns that all tables have, in the first one's order; the required one must be among them."""
    first = next(iter(tables.values()))
    out = [c for c in first.columns if all(c in t.columns for t in tables.values()) and (subset is None or c in subset or c == required)]
    if required not in out:
        raise ValueError(f"not every table has {required}")
    return out
