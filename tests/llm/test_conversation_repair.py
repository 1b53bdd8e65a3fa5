"""Repairs against a search over all edit scripts."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from pathlib import Path

import pytest

from strokelake.llm import conversation_repair, queries

SF = Path("/root/testdata/sf0.001")
SHAPE = re.compile(r"(s?(ua)+)?\Z")
START = re.compile(r"(s?(ua)*u?)?\Z")


def searched(rows: list[tuple[str, str]]) -> tuple[int, str, str]:
    """Cheapest script by uniform-cost search over (rows done, letters), from (role, text, fault): cost, letters, hash."""
    kinds, seen = [], set()
    for role, text in rows:
        words = text.strip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not words else "duplicate" if (role, text) in seen else "none" if words[-1] in ".!?" else "truncated")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, at, shape, out = heapq.heappop(heap)
        if at == len(rows) and SHAPE.match(shape):
            return cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest()
        state = (at, shape[-1:], shape == "")
        if state in done:
            continue
        done.add(state)
        for role in ("user", "assistant"):
            if START.match(shape + role[0]):
                heapq.heappush(heap, (cost + 2, letters + "I", at, shape + role[0], (*out, role + ":")))
        if at < len(rows):
            (role, text), kind = rows[at], kinds[at]
            heapq.heappush(heap, (cost + 3, letters + "D", at + 1, shape, out))
            if kind in ("none", "truncated"):
                more = kind == "truncated"
                if role and START.match(shape + role[0]):
                    heapq.heappush(heap, (cost + more, letters + "K", at + 1, shape + role[0], (*out, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if START.match(shape + new[0]):
                        heapq.heappush(heap, (cost + 2 + more, letters + "R", at + 1, shape + new[0], (*out, f"{new}:{text}")))
    raise AssertionError


def described(conv: list[tuple]) -> dict:
    """From (turn, role, text) rows without nulls of role and text, in order."""
    rows = [(r, t) for _, r, t in conv]
    counts, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, set()
    for role, text in rows:
        words = text.strip(" \t\n\x0b\x0c\r")
        kind = "blank" if not words else "duplicate" if (role, text) in seen else None if words[-1] in ".!?" else "truncated"
        seen.add((role, text))
        if kind:
            counts[kind] += 1
    turns = [t for t, _, _ in conv if t is not None]
    cost, audit, sha = searched(rows)
    return counts | {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "illegal": sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:])),
                     "cost": cost, "audit": audit, "repaired_sha256": sha}


def compared(spark, convs: dict[int | None, list[tuple]]) -> None:
    rows = spark.createDataFrame([(c, t, r, x, "k") for c, conv in convs.items() for t, r, x in conv], "conv_id long, turn long, role string, text string, number string").repartition(3)
    found = conversation_repair.written(conversation_repair.repair(rows), "repaired")
    hashes = {r.conv_id: r.repaired_sha256 for r in conversation_repair.digests(conversation_repair.edits(rows, found)).collect()}
    out = {r.conv_id: r.asDict() for r in found.collect()}
    assert set(out) == set(hashes) == set(convs)
    for c, conv in convs.items():
        conv = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in conv]
        assert {k: v for k, v in out[c].items() if k != "conv_id"} | {"repaired_sha256": hashes[c]} == described(conv), (c, conv)


@pytest.mark.parametrize("segment", [2, 256])
def test_random_conversations(spark, monkeypatch, segment):
    monkeypatch.setattr(conversation_repair, "SEGMENT", segment)
    monkeypatch.setattr(conversation_repair, "LEAST_COUNT", 2)
    rng = random.Random(segment)
    roles, texts = ["user", "user", "assistant", "assistant", "system", "tool", "", None], ["Yes.", "No!", "Why?", "cut off", "", " \n", None, "Well. ", "so it is.\n\t"]
    convs = {i: [(turn, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}" + rng.choice([".", ""])) for turn in sorted(rng.sample(range(20), rng.randint(1, 9)))] for i in range(250)}
    convs[None] = [(None, "user", "Hm."), (3, "user", "Ha."), (7, "assistant", "x")]
    compared(spark, convs)


def test_repeated_rows_and_long_conversations(spark):
    convs = {1: [(0, "user", "Hello.")] * 700, 2: [(i, ["user", "assistant"][i % 2], f"{i}.") for i in range(1500)], 3: [(i, "user", f"{i}" + "." * (i % 3 > 0)) for i in range(300)], 4: [(0, "user", "x" * 200_000)]}
    compared(spark, convs)


def test_empty_table(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    found = conversation_repair.repair(rows)
    assert found.count() == 0 and conversation_repair.edits(rows, found).count() == 0


def test_edits_say_what_stands_there(spark):
    rows = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi."), (1, 2, "assistant", ""), (1, 5, "tool", "What?")], "conv_id long, turn long, role string, text string")
    found = conversation_repair.repair(rows)
    out = conversation_repair.edits(rows, found).orderBy("place").collect()
    assert "".join(r.edit for r in out) == found.first().audit
    kept = [(r.role, r.text) for r in out if r.edit != "D"]
    assert SHAPE.match("".join(role[0] for role, _ in kept)) and ("system", "Be kind.") in kept and all(r.role is None for r in out if r.edit == "D")


@pytest.mark.parametrize("nulls", [False, True])
def test_query_by_search(spark, tmp_path, nulls):
    table = [tuple(r) for r in spark.read.parquet(str(SF / "conversations.parquet")).select("conv_id", "turn", "role", "text").collect()]
    if nulls:
        table = [(c, t if i % 7 else None, r if i % 5 else None, x if i % 11 else None) for i, (c, t, r, x) in enumerate(table)] + [(None, None, "user", "Hm."), (None, 2, "assistant", "Hm"), (77_777_777, 4, "user", "?")]
    spark.createDataFrame(table, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    convs: dict = {}
    for c, t, r, x in table:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        convs.setdefault(c, []).extend([] if k == 0 else [(t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1))
    none = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    out = {r.conv_id: r.asDict() for r in queries.queries()["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    assert set(out) == set(convs)
    tied = lambda rows: len({(t, r) for t, r, _ in rows}) < len(set(rows))
    for c, conv in convs.items():
        conv = sorted(conv, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        if not tied(conv):  # rows of one turn and role go by a hash
            assert {k: v for k, v in out[c].items() if k != "conv_id"} == (described(conv) if conv else none)
