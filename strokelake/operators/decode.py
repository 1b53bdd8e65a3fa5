"""Tokens back to ink: pen states, points, displacements, roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strokelake.functions.walk import DOWN, DX, DY, UP


def steps(tokens: DataFrame) -> DataFrame:
    """Rows (id, pos, token, dx, dy) of base tokens."""
    at = lambda table: F.coalesce(F.get(F.array(*[F.lit(v) for v in table]), F.col("token")), F.lit(0))
    rows = tokens.select("id", F.posexplode("tokens").alias("pos", "token"))
    return rows.select("id", "pos", "token", at(DX).alias("dx"), at(DY).alias("dy"))


def pen_states(tokens: DataFrame) -> DataFrame:
    """Rows (id, pos, token, x, y, down): cell and pen after each token. The position moves on pen-up moves as well."""
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    state = F.when(F.col("token") == DOWN, 1).when(F.col("token") == UP, 0)
    return steps(tokens).select("id", "pos", "token", F.sum("dx").over(w).alias("x"), F.sum("dy").over(w).alias("y"),
                                F.coalesce(F.last(state, ignorenulls=True).over(w), F.lit(0)).alias("down"))


def decoded(tokens: DataFrame, grid: float) -> DataFrame:
    """Rows (id, point, x, y, pen): DOWN gives the current place, moves while down theirs, UP repeats the last with pen 0."""
    kept = pen_states(tokens).where(F.col("token").isin(DOWN, UP) | (F.col("down") == 1))
    point = F.row_number().over(Window.partitionBy("id").orderBy("pos")) - 1
    return kept.select("id", point.alias("point"), (F.col("x") * grid).alias("x"), (F.col("y") * grid).alias("y"), F.when(F.col("token") == UP, 0).otherwise(1).alias("pen"))


def token_deltas(rules: DataFrame) -> DataFrame:
    """Rows (token, dx, dy) of moves and merges, from a vocabulary (rank, a, b, new).

    A vocabulary is a small ordered table by nature; its sums follow its ranks.
    """
    found = {t: (DX[t], DY[t]) for t in range(8)}
    for r in rules.orderBy("rank").collect():
        found[r.new] = tuple(u + v for u, v in zip(found[r.a], found[r.b], strict=True))
    return rules.sparkSession.createDataFrame([(t, *d) for t, d in found.items()], "token int, dx bigint, dy bigint")


def owners(tokens: DataFrame, expansions: list[list[int]]) -> DataFrame:
    """Rows (id, owner, point, token): base tokens in order, with the place of the token they come from."""
    table = F.array(*[F.array(*[F.lit(t) for t in e]) for e in expansions])
    each = F.flatten(F.transform("tokens", lambda t, i: F.transform(F.get(table, t), lambda b: F.struct(i.alias("owner"), b.alias("token")))))
    return tokens.select("id", F.posexplode(each).alias("point", "e")).select("id", "e.owner", "point", "e.token")


def roles(tokens: DataFrame) -> DataFrame:
    """Rows (id, pos, token, role): travel, touch down, first move, rest, lift."""
    w = Window.partitionBy("id").orderBy("pos")
    rows = pen_states(tokens).withColumn("before", F.lag("token").over(w))
    role = (F.when(F.col("token") == DOWN, "touch down").when(F.col("token") == UP, "lift").when(F.col("down") == 0, "travel")
            .when(F.col("before") == DOWN, "first move").otherwise("rest"))
    return rows.select("id", "pos", "token", role.alias("role"))
