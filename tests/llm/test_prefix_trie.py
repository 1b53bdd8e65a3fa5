"""The trie against a walk over all prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict
from pathlib import Path

import pytest

from strokelake.llm import prefix_trie, queries

SF = Path("/root/testdata/sf0.001")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def walked(convs: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    """From conversations' turns, one row per distinct prefix."""
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * len(p[-1][1].encode() if p else b"") + sum(saved[k] for k in kids[p])
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(convs[c]) == len(p)))).encode()).hexdigest()
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], ends(p)) for p, m in members.items()]


def table(spark, convs, parts=3):
    rows = [(c, i, r, x, 0, "n") for c, turns in convs.items() for i, (r, x) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int, number string").repartition(parts)


def compared(spark, convs) -> None:
    ids = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    out = prefix_trie.trie(ids, prefix_trie.written(prefix_trie.turns(table(spark, convs)), "turns"))
    assert out.columns == COLUMNS
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, walked(convs)))


@pytest.mark.parametrize("kinds,longest,segment", [(2, 14, 1024), (3, 40, 4)])
def test_random_conversations(spark, monkeypatch, kinds, longest, segment):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    rng = random.Random(kinds)
    turn = lambda: ("ua"[rng.random() < 0.3], "é" * rng.randrange(kinds))
    convs = {c: [turn() for _ in range(rng.randrange(longest))] for c in range(-20, 220)}
    for c in range(220, 300):  # copies and continuations
        convs[c] = convs[rng.randrange(0, 200)][: rng.randrange(longest)] + [turn() for _ in range(rng.randrange(3))]
    compared(spark, convs)


def test_snapshots_of_one_long_conversation(spark):
    turns = [("u", f"{i}") for i in range(700)]
    compared(spark, {i: turns[: i * 9] for i in range(70)} | {1000 + i: turns[:500] + [("a", "x")] for i in range(40)})


@pytest.mark.parametrize("convs", [{5: []}, {5: [("u", "a")]}, {5: [("u", "a")], 3: [("u", "a")]}, {1: [("", "")], 2: []}])
def test_small_tables(spark, convs):
    compared(spark, convs)


def test_empty_table(spark):
    out = prefix_trie.trie(spark.createDataFrame([], "conv_id long"), prefix_trie.turns(table(spark, {})))
    assert out.count() == 0


@pytest.mark.parametrize("nulls", [False, True])
def test_query_by_walk(spark, tmp_path, nulls):
    rows = [tuple(r) for r in spark.read.parquet(str(SF / "conversations.parquet")).select("conv_id", "turn", "role", "text").collect()]
    if nulls:
        seen, kept = set(), []
        for i, (c, t, r, x) in enumerate(rows):
            t = None if i % 7 == 0 and (c, None) not in seen else t
            seen.add((c, t))
            kept.append((c, t, r if i % 5 else None, x if i % 11 else None))
        rows = kept + [(None, 1, "user", "Hm."), (-7, 3, "user", "?"), (-7, 1, None, "!"), (-5, 3, "user", "."), (10**12 + 3, None, "user", "x" * 100_000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    own = defaultdict(list)
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((r or "", x or ""))
    convs = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - (c % 5 if c >= 0 else -(-c % 5))
        convs[c] = own.get(base, [])[:h] + own[c][h:]
    out = queries.queries()["op12_prefix_trie"](spark, str(tmp_path))
    assert sorted(map(repr, (tuple(r[c] for c in COLUMNS) for r in out.collect()))) == sorted(map(repr, walked(convs)))
