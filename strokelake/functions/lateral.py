"""A table function for lateral joins: `words.lateralJoin(PenPath(F.col("tokens").outer()))`, or by name in SQL once registered."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from strokelake.functions.walk import DOWN, DX, DY, UP


@udtf(returnType="pos int, x bigint, y bigint, down int")
class PenPath:
    """Cell and pen after each base token of a walk; nothing for a null or empty one. Rows come as they are made."""

    def eval(self, tokens: list[int] | None) -> Iterator[tuple[int, int, int, int]]:
        x = y = down = 0
        for pos, token in enumerate(tokens or []):
            if token in (DOWN, UP):
                down = int(token == DOWN)
            elif token < len(DX):
                x, y = x + DX[token], y + DY[token]
            yield pos, x, y, down


def register(spark: SparkSession, name: str = "pen_path") -> None:
    """Makes the function known to SQL: SELECT w.id, p.* FROM words w, LATERAL pen_path(w.tokens) p."""
    spark.udtf.register(name, PenPath)
