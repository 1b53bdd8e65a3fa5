"""Properties of the walk, merges, polar tokens, batches and packing."""

from __future__ import annotations

import math
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strokelake.functions import walk
from strokelake.operators import bpe, polar, sampling
from strokelake.operators.sampling import budget_batches


def slow_line(dx: int, dy: int) -> list[int]:
    """Cells of a straight line by rounding half down along the longer axis."""
    n = max(abs(dx), abs(dy))
    at = lambda d, k: math.copysign(math.ceil((2 * abs(d) * k - n) / (2 * n)), d) if n else 0
    out = []
    for k in range(n):
        step = tuple(int(at(d, k + 1) - at(d, k)) for d in (dx, dy))
        out.append(walk.DIRECTIONS.index(step))
    return out


def slow_merges(tokens: list[int], rules: list[tuple[int, int, int]]) -> list[int]:
    for a, b, new in rules:
        out, i = [], 0
        while i < len(tokens):
            if tokens[i : i + 2] == [a, b]:
                out.append(new)
                i += 2
            else:
                out.append(tokens[i])
                i += 1
        tokens = out
    return tokens


def test_line_steps(spark):
    steps = [(x, y) for x in range(-9, 10) for y in range(-9, 10)]
    df = spark.createDataFrame(steps, "x int, y int").select("x", "y", walk.line_steps(F.col("x"), F.col("y")).alias("t"))
    for r in df.collect():
        assert r.t == slow_line(r.x, r.y), (r.x, r.y)
        assert (sum(walk.DX[t] for t in r.t), sum(walk.DY[t] for t in r.t)) == (r.x, r.y)


def walks(n: int, seed: int) -> list[tuple[int, list[int]]]:
    rng = random.Random(seed)
    return [(i, [8, *rng.choices(range(8), weights=[9, 3, 1, 1, 1, 1, 1, 4], k=rng.randint(1, 40)), 9, *rng.choices(range(8), k=rng.randint(0, 5)), 8, 0, 0, 0, 9]) for i in range(n)]


def test_merges_learned_and_applied(spark):
    rows = walks(150, 1)
    df = spark.createDataFrame(rows, "id int, tokens array<int>")
    rules = bpe.learn_merges(bpe.move_runs(df), 10, min_count=5)
    assert [r[2] for r in rules] == list(range(10, 10 + len(rules))) and len(rules) == 10
    seqs = [t for _, t in rows]
    for a, b, new in rules:  # each rule is the most frequent pair left, ties to the least code
        counts: dict[tuple[int, int], int] = {}
        for t in seqs:
            for p in zip(t, t[1:], strict=False):
                if not set(p) & {8, 9}:
                    counts[p] = counts.get(p, 0) + 1
        assert (a, b) == min(counts, key=lambda p: (-counts[p], p[0] * 20 + p[1]))
        seqs = [slow_merges(t, [(a, b, new)]) for t in seqs]
    merged = {r.id: list(r.tokens) for r in bpe.apply_merges(df, rules).collect()}
    assert merged == dict(zip((i for i, _ in rows), seqs, strict=True))
    flat = bpe.expansions(rules)
    assert all([x for t in merged[i] for x in flat[t]] == t for i, t in rows)
    again = bpe.learn_merges(bpe.move_runs(df.repartition(1)), 10, min_count=5)
    assert again == rules


@given(st.lists(st.integers(0, 3), max_size=30))
def test_rank_order_equals_learned_order(tokens):
    rules = [(0, 0, 10), (10, 0, 11), (1, 2, 12), (12, 1, 13), (10, 10, 14)]
    assert bpe.apply_rules(tokens, {(a, b): n for a, b, n in rules}) == slow_merges(list(tokens), rules)


def test_polar_round_trip(spark):
    points = [(1, [(i * 0.013, 0.1 * math.sin(i / 3), 1 if i != 15 else 0) for i in range(30)])]
    ink = spark.createDataFrame(points, "id int, points array<struct<x:double,y:double,pen:int>>")
    back = {r.pos: r for r in polar.decode(polar.encode(ink, 1)).collect()}
    assert len(back) == 30
    drift = max(math.hypot(back[i].x - p[0], back[i].y - p[1]) for i, p in enumerate(points[0][1]))
    assert drift < 0.05
    assert all(back[i].pen == p[2] for i, p in enumerate(points[0][1]))


@given(st.lists(st.integers(1, 256), max_size=300), st.sampled_from([(4096, 64), (300, 7)]))
def test_budget_batches(lengths, shape):
    budget, step = shape
    batches, left = budget_batches([(n, i) for i, n in enumerate(lengths)], budget, step, 256)
    keys = [k for _, _, b in batches for k in b] + [k for _, k in left]
    assert sorted(keys) == list(range(len(lengths)))
    for width, rows, members in batches:
        assert len(members) == rows == max(1, budget // width) and max(lengths[k] for k in members) <= width


def test_batches_same_in_any_partitioning(spark):
    rows = spark.createDataFrame([(i % 3, i, 1 + i * 37 % 200) for i in range(500)], "pool int, key long, length int")
    run = lambda df: sorted(map(tuple, sampling.token_budget_batches(df, "pool", "key", "length", 1024, 16, 256).collect()))
    assert run(rows.repartition(1)) == run(rows.repartition(8))


def test_example_cut(spark):
    df = spark.createDataFrame([(1, list(range(3))), (2, list(range(8)))], "id int, tokens array<int>")
    rows = {r.id: r.e for r in df.select("id", sampling.make_example(F.col("tokens"), 8, bos=13, end=11, pad=10).alias("e")).collect()}
    assert rows[1].x == [13, 0, 1, 2, 11, 10, 10, 10] and rows[1].y == [0, 1, 2, 11, -1, -1, -1, -1]
    assert rows[2].x == [13, 0, 1, 2, 3, 4, 5, 11] and rows[2].y == [0, 1, 2, 3, 4, 5, -1, -1]


@pytest.mark.parametrize("ahead,listed", [(64, 2000), (3, 5), (1, 2000)])
def test_learned_rules_are_those_of_recounting(spark, monkeypatch, ahead, listed):
    """Several rules a round, with counts changed by the runs they touch, give what one rule a round and counting anew gives."""
    import random

    from strokelake.operators import bpe

    monkeypatch.setattr(bpe, "AHEAD", ahead)
    monkeypatch.setattr(bpe, "MOST_LISTED", listed)
    rng = random.Random(9)
    runs = {}
    for _ in range(300):
        runs[tuple(rng.choices(range(8), weights=[9, 7, 5, 4, 3, 2, 2, 1], k=rng.randint(2, 14)))] = rng.randint(1, 5)
    slow, rules = dict(runs), []
    while len(rules) < 40:
        counts = {}
        for run, n in slow.items():
            for p in zip(run, run[1:], strict=False):
                counts[p] = counts.get(p, 0) + n
        best = min(counts, key=lambda p: (-counts[p], p[0] * 50 + p[1]))
        if counts[best] < 5:
            break
        rules.append((*best, 10 + len(rules)))
        again = {}
        for run, n in slow.items():
            out, i = [], 0
            while i < len(run):
                hit = run[i : i + 2] == best
                out.append(rules[-1][2] if hit else run[i])
                i += 1 + hit
            again[tuple(out)] = again.get(tuple(out), 0) + n
        slow = again
    df = spark.createDataFrame([(list(r), n) for r, n in runs.items()], "run array<int>, freq long")
    assert bpe.learn_merges(df, 40, 5) == rules
    assert bpe.next_rules({(0, 1): 9, (2, 3): 8, (1, 4): 7, (5, 6): 6}, 10, 1, 50) == [(0, 1), (2, 3)]
    assert bpe.next_rules({(0, 1): 9, (2, 3): 8, (1, 4): 8}, 10, 1, 50) == [(0, 1)]


def test_many_rules_by_one_table(spark):
    """The vocabulary query's rules against counting anew, and rules applied by one fold against ranks."""
    from strokelake import plans

    words = plans.tokens.tokens(spark, "/root/testdata/sf0.001")
    rules = [(r.a, r.b, r.new) for r in plans.QUERIES["c05_vocabulary"](spark, "/root/testdata/sf0.001").orderBy("rank").collect()]
    runs = [(list(r.run), r.freq) for r in bpe.move_runs(words).collect()]
    for a, b, new in rules:
        counts: dict[tuple[int, int], int] = {}
        for run, n in runs:
            for p in zip(run, run[1:], strict=False):
                counts[p] = counts.get(p, 0) + n
        assert (a, b) == min(counts, key=lambda p: (-counts[p], p[0] * 266 + p[1]))
        runs = [(slow_merges(run, [(a, b, new)]), n) for run, n in runs]
    rows = lambda df: sorted((r.id, list(r.tokens)) for r in df.select("id", "tokens").collect())
    assert len(rules) > 20 and rows(bpe.apply_in_order(words, rules)) == rows(bpe.apply_merges(words, rules))
