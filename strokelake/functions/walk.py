"""The grid walk: ink as moves of one cell in eight directions, with pen-down and pen-up tokens.

Tokens 0..7 are moves, 8 puts the pen down, 9 lifts it, merges follow from 10, then PAD, END, WORD and BOS.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strokelake.functions.arrays import let

DOWN, UP, FIRST_MERGE = 8, 9, 10
# The eight directions in order.
DIRECTIONS = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))
DX, DY = zip(*DIRECTIONS, strict=True)


def specials(n_merges: int) -> dict[str, int]:
    return {name: FIRST_MERGE + n_merges + i for i, name in enumerate(("PAD", "END", "WORD", "BOS"))}


def direction(sx: Column, sy: Column) -> Column:
    """Token of a unit step; the table is laid out by 3 (sy + 1) + sx + 1."""
    by_step = {d: i for i, d in enumerate(DIRECTIONS)}
    cells = [by_step.get((x, y)) for y in (-1, 0, 1) for x in (-1, 0, 1)]
    return F.get(F.array(*[F.lit(c).cast("int") for c in cells]), (3 * (sy + 1) + sx + 1).cast("int"))


def line_steps(dx: Column, dy: Column) -> Column:
    """Moves of a straight hop of (dx, dy) cells, one for each cell of the longer axis.

    After k of n moves an axis that goes a cells has passed the whole number nearest to k a / n, halves rounded down.
    """

    def moves(n: Column) -> Column:
        def passed(cells: Column, k: Column) -> Column:
            return F.floor((2 * k * cells + n - 1) / (2 * n))

        def gone(cells: Column, k: Column) -> Column:
            return F.signum(cells) * (passed(F.abs(cells), k) - passed(F.abs(cells), k - 1))

        none = F.array().cast("array<int>")
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: direction(gone(dx, k), gone(dy, k)))).otherwise(none)

    return let(F.greatest(F.abs(dx), F.abs(dy)).cast("int"), moves)


def encode(points: Column, grid: float) -> Column:
    """Tokens of a word: hop to the first cell, DOWN, moves, UP for each run of the pen."""
    down = F.filter(F.transform(points, lambda p, i: F.struct(
        F.rint(p["x"] / grid).cast("int").alias("x"), F.rint(p["y"] / grid).cast("int").alias("y"), p["pen"].alias("pen"), i.alias("i"))), lambda p: p["pen"] == 1)

    def tokens(c: Column) -> Column:
        def one(p: Column, k: Column) -> Column:
            before, after = F.get(c, k - 1), F.get(c, k + 1)
            starts = before.isNull() | (before["i"] != p["i"] - 1)
            ends = after.isNull() | (after["i"] != p["i"] + 1)
            steps = line_steps(p["x"] - F.coalesce(before["x"], F.lit(0)), p["y"] - F.coalesce(before["y"], F.lit(0)))
            none = F.array().cast("array<int>")
            return F.concat(steps, F.when(starts, F.array(F.lit(DOWN))).otherwise(none), F.when(ends, F.array(F.lit(UP))).otherwise(none))

        return F.flatten(F.transform(c, one))

    return let(down, tokens)


def count_moves(points: Column, grid: float) -> Column:
    """Size of `encode` without building it: hops plus pen-downs and pen-ups."""
    down = F.filter(F.transform(points, lambda p, i: F.struct(
        F.rint(p["x"] / grid).cast("int").alias("x"), F.rint(p["y"] / grid).cast("int").alias("y"), p["pen"].alias("pen"), i.alias("i"))), lambda p: p["pen"] == 1)

    def total(c: Column) -> Column:
        def one(p: Column, k: Column) -> Column:
            before = F.get(c, k - 1)
            starts = F.when(before.isNull() | (before["i"] != p["i"] - 1), 2).otherwise(0)
            return F.greatest(F.abs(p["x"] - F.coalesce(before["x"], F.lit(0))), F.abs(p["y"] - F.coalesce(before["y"], F.lit(0)))) + starts

        return F.aggregate(F.transform(c, one), F.lit(0), lambda a, x: a + x)

    return let(down, total)


def expand(tokens: Column, expansions: Column) -> Column:
    """Base tokens; `expansions` is an array by token of arrays of base tokens."""
    return F.flatten(F.transform(tokens, lambda t: F.get(expansions, t)))


def split_words(tokens: Column, word: int, first_special: int) -> Column:
    """Arrays of tokens between WORD tokens, specials dropped, empty words dropped."""

    def cut(t: Column) -> Column:
        marks = F.concat(F.array(F.lit(-1)), F.array_compact(F.transform(t, lambda x, i: F.when(x == word, i))), F.array(F.size(t)))
        parts = let(marks, lambda m: F.zip_with(F.slice(m, F.lit(1), F.size(m) - 1), F.slice(m, F.lit(2), F.size(m) - 1), lambda a, b: F.filter(F.slice(t, a + 2, b - a - 1), lambda x: x < first_special)))
        return F.filter(parts, lambda p: F.size(p) > 0)

    return let(tokens, cut)


def letters(text: Column) -> Column:
    """The letters a-z of a text in lower case, all else dropped."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]+", ""))


def split_letters(text: Column, word: str) -> Column:
    """The same on the letters of a text, each a token of its place in the alphabet and `word` the WORD token: strings of letters,
    empty words dropped. `letter_tokens` makes tokens of one of them, best of one in a row."""
    return F.filter(F.split(letters(text), word), lambda w: w != "")


def letter_tokens(word: Column) -> Column:
    return let(word, lambda w: F.when(w != "", F.transform(F.split(w, ""), lambda c: F.ascii(c) - ord("a"))).otherwise(F.array().cast("array<int>")))


def byte_tokens(text: Column, length: int, end: int = 257) -> Column:
    """Bytes plus one, cut to length - 1, the end token, zeros up to length."""
    hexed = F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))

    def build(h: Column) -> Column:
        n = F.least(F.length(h) / 2, F.lit(length - 1)).cast("int")
        own = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int") + 1)).otherwise(F.array().cast("array<int>"))
        return F.concat(own, F.array(F.lit(end)), F.array_repeat(F.lit(0), F.lit(length - 1) - n))

    return let(hexed, build)


def hint_digits(ink: Column, strokes: Column, first: int = 258) -> Column:
    """Four digit tokens of twice the ink and of the stroke count, both clipped to 0..99."""
    a = F.least(F.lit(99), F.greatest(F.lit(0), F.rint(2 * ink).cast("int")))
    b = F.least(F.lit(99), F.greatest(F.lit(0), strokes.cast("int")))
    return F.array(*[(F.lit(first + 10 * k) + d).cast("int") for k, d in enumerate((F.floor(a / 10), a % 10, F.floor(b / 10), b % 10))])
