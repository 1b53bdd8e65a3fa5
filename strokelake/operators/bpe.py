"""Byte-pair merges over the moves of the grid walk, learned and applied as Spark jobs.

Merges never cover a pen-down or pen-up token, so sequences are cut there into runs of moves. Runs are counted and kept
once each with their number: counting pairs and rewriting both work on distinct runs. Pairs are counted once, and a round
of learning shuffles the changes of counts in the runs that its rules touch. Runs are strings, a character for each token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strokelake.functions.arrays import indices, let
from strokelake.functions.walk import DOWN, FIRST_MERGE, UP
from strokelake.sources.scratch import written

CUT_EVERY = 8  # rounds between writes of the rewritten runs
AHEAD = 64  # pairs whose runs are kept apart
MOST_LISTED = 2_000  # pairs in one pattern
FIRST_CHARACTER = 0x4E00
MOST_CELLS = 1 << 20  # of a table of all pairs in a task


def move_runs(tokens: DataFrame, column: str = "tokens") -> DataFrame:
    """Rows (run, freq): distinct runs of moves of two tokens or more."""
    t = F.col(column)
    marks = let(t, lambda a: F.concat(F.array(F.lit(-1)), F.filter(indices(a), lambda i: F.get(a, i).isin(DOWN, UP)), F.array(F.size(a))))
    parts = let(marks, lambda m: F.zip_with(F.slice(m, F.lit(1), F.size(m) - 1), F.slice(m, F.lit(2), F.size(m) - 1), lambda a, b: F.slice(t, a + 2, b - a - 1)))
    runs = tokens.select(F.explode(F.filter(parts, lambda r: F.size(r) > 1)).alias("run"))
    return runs.groupBy("run").agg(F.count("*").alias("freq"))


def coded(run: Column) -> Column:
    """A run of base moves as a string, a character for each token, so that a rule is one replacement of two characters by one."""
    return F.array_join(run.cast("array<string>"), "")


def character(token: int) -> str:
    return str(token) if token < FIRST_MERGE else chr(FIRST_CHARACTER + token - FIRST_MERGE)


def decoded(text: Column) -> Column:
    """The tokens of a coded run."""
    at = lambda c: F.ascii(c)  # noqa: E731  the code point of the first character
    return F.transform(F.split(text, ""), lambda c: F.when(at(c) < FIRST_CHARACTER, at(c) - ord("0")).otherwise(at(c) - FIRST_CHARACTER + FIRST_MERGE).cast("int"))


def pair_counts(runs: DataFrame, signs: dict[str, int] | None = None, vocabulary: int = FIRST_MERGE) -> DataFrame:
    """Rows (a, b, n): neighbouring tokens, overlapping ones as well, in coded runs, `freq` times each. `signs` names columns of runs
    and whether their pairs are added or taken off. A task counts in Arrow batches and hands on one row a pair."""
    signs = signs or {"run": 1}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            freq = batch.column("freq").to_numpy()
            for column, sign in signs.items():
                texts = batch.column(column).to_pylist()
                codes = np.frombuffer("\0".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
                times = np.repeat(freq, [len(t) + 1 for t in texts])[: len(codes)]
                token = np.where(codes >= FIRST_CHARACTER, codes - FIRST_CHARACTER + FIRST_MERGE, codes - ord("0"))
                inside = (codes[:-1] != 0) & (codes[1:] != 0)
                pairs, at = np.unique((token[:-1] * vocabulary + token[1:])[inside], return_inverse=True) if vocabulary**2 > MOST_CELLS else (None, (token[:-1] * vocabulary + token[1:])[inside])
                sums = np.bincount(at, times[:-1][inside])  # exact below 2 ** 53
                for i in np.flatnonzero(sums):
                    pair = int(i if pairs is None else pairs[i])
                    found[pair] = found.get(pair, 0) + sign * int(sums[i])
        pairs, sums = list(found), list(found.values())
        yield pa.RecordBatch.from_arrays([pa.array([p // vocabulary for p in pairs], pa.int32()), pa.array([p % vocabulary for p in pairs], pa.int32()), pa.array(sums, pa.int64())], names=["a", "b", "n"])

    return runs.select("freq", *signs).mapInArrow(count, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def next_rules(counts: dict[tuple[int, int], int], most: int, least: int, vocabulary: int) -> list[tuple[int, int]]:
    """The next pairs to merge that are certain from these counts: the most frequent one, ties to the least a * vocabulary + b,
    and those after it as long as no pair as frequent shares a token with one that is taken.

    A merge changes only counts of pairs that share a token with it, and a new pair is no more frequent than such a pair was.
    """
    order = sorted(((-n, a * vocabulary + b, a, b) for (a, b), n in counts.items() if n >= least))
    taken: list[tuple[int, int]] = []
    used: set[int] = set()
    for i, (n, _, a, b) in enumerate(order):
        equal = takewhile(lambda p, n=n: p[0] == n, order[i:])
        if len(taken) == most or any(x in used or y in used for _, _, x, y in equal):
            break
        taken.append((a, b))
        used |= {a, b}
    return taken


def learn_merges(runs: DataFrame, n_merges: int, min_count: int = 20) -> list[tuple[int, int, int]]:
    """Up to n_merges rules (a, b, new): the most frequent pair each time, ties to the least a * vocabulary + b.

    Pairs are counted once; a round then sends back by how much its rules change the counts of pairs in the runs that they
    touch. Counts are at most the square of the vocabulary, so the driver holds them.

    A round does not read all runs. The runs that hold one of the `AHEAD` most frequent pairs are written apart; until a rule
    needs another pair, all rules are among these pairs and those that merging has made, which lie in the same runs. Then the
    parts are joined again, without the runs that no rule can touch any more (no pair of `min_count`), and cut anew.
    """
    vocabulary, rules = FIRST_MERGE + n_merges, []
    rest = written(runs.select(coded(F.col("run")).alias("run"), "freq"))
    counts = {(r.a, r.b): r.n for r in pair_counts(rest).collect()}
    active: DataFrame | None = None
    ours: set[tuple[int, int]] = set()
    now, rounds = F.col("run"), 0
    while batch := next_rules(counts, n_merges - len(rules), min_count, vocabulary):
        if batch[0] not in ours:
            if active is not None:
                rest = rest.unionByName(active.select(now.alias("run"), "freq"))
            live = sorted((-n, a * vocabulary + b, a, b) for (a, b), n in counts.items() if n >= min_count)
            ours = {(a, b) for _, _, a, b in live[:AHEAD]}
            holds = lambda pairs: F.col("run").rlike("|".join(re.escape(character(a)) + re.escape(character(b)) for a, b in pairs))
            whole = written(rest.where(holds([(a, b) for *_, a, b in live]) if len(live) <= MOST_LISTED else F.length("run") > 1))
            active, rest, now, rounds = written(whole.where(holds(ours))), whole.where(~holds(ours)), F.col("run"), 0
        batch = list(takewhile(ours.__contains__, batch))
        before = now
        for a, b in batch:
            new = FIRST_MERGE + len(rules)
            now = F.replace(now, F.lit(character(a) + character(b)), F.lit(character(new)))
            rules.append((a, b, new))
        if len(rules) == n_merges:
            break
        changed = active.select("freq", before.alias("run"), now.alias("new")).where("run <> new")
        for r in pair_counts(changed, {"run": -1, "new": 1}, vocabulary).collect():
            pair = (r.a, r.b)
            if max(pair) >= FIRST_MERGE + len(rules) - len(batch):
                ours.add(pair)  # made by this round, so it lies in the active runs alone
            if left := counts.pop(pair, 0) + r.n:
                counts[pair] = left
        rounds += 1
        if rounds % CUT_EVERY == 0:
            active, now = written(active.select(now.alias("run"), "freq").where(F.length("run") > 1)), F.col("run")
    return rules


def _rule_table(rules: list[tuple[int, int, int]]) -> Column:
    none = F.array().cast("array<struct<pair:string,new:string>>")
    return F.array(*[F.struct(F.lit(character(a) + character(b)).alias("pair"), F.lit(character(new)).alias("new")) for a, b, new in rules]) if rules else none


def merged(tokens: Column, rules: list[tuple[int, int, int]]) -> Column:
    """Merged tokens of a word as an expression: no shuffle and no Python, but a run is merged anew in each word.

    Rules never hold a pen token, so a whole word is rewritten at once, its pens in place.
    """
    whole = F.aggregate(_rule_table(rules), coded(tokens), lambda text, r: F.replace(text, r["pair"], r["new"]))
    return F.when(F.size(tokens) > 0, decoded(whole)).when(tokens.isNotNull(), F.array().cast("array<int>"))


def apply_in_order(tokens: DataFrame, rules: list[tuple[int, int, int]], column: str = "tokens") -> DataFrame:
    """Replaces the token column by its merged form, one rule after the other over distinct runs.

    Each run of moves is merged once, by one fold over the table of rules, and joined back.
    """
    whole = F.aggregate(_rule_table(rules), coded(F.col("run")), lambda text, r: F.replace(text, r["pair"], r["new"]))
    done = written(move_runs(tokens, column).select(F.col("run").alias("_run"), decoded(whole).alias("run")))
    t = F.col(column)
    places = let(t, lambda x: F.concat(F.array(F.lit(-1)), F.filter(indices(x), lambda i: F.get(x, i).isin(DOWN, UP)), F.array(F.size(x))))
    none = F.array().cast("array<int>")
    parts = let(places, lambda m: F.transform(F.slice(m, F.lit(1), F.size(m) - 1), lambda a, i: F.struct(
        F.slice(t, a + 2, F.get(m, i + 1) - a - 1).alias("run"), F.when(F.get(m, i + 1) < F.size(t), F.slice(t, F.get(m, i + 1) + 1, F.lit(1))).otherwise(none).alias("pen"))))
    rest = [c for c in tokens.columns if c != column]
    each = tokens.withColumn("_row", F.monotonically_increasing_id()).select("_row", *rest, F.posexplode(parts).alias("_place", "_p"))
    each = each.select("_row", *rest, "_place", F.col("_p.run").alias("_run"), F.col("_p.pen").alias("_pen")).join(done.select("_run", F.col("run").alias("_done")), "_run", "left")
    whole = F.sort_array(F.collect_list(F.struct("_place", F.concat(F.coalesce("_done", "_run"), F.col("_pen")).alias("t"))))
    out = each.groupBy("_row").agg(*[F.first(c).alias(c) for c in rest], whole.alias("_w"))
    return out.select(*[F.flatten(F.transform("_w", lambda w: w["t"])).alias(c) if c == column else F.col(c) for c in tokens.columns])


def apply_rules(tokens: list[int], rules: dict[tuple[int, int], int]) -> list[int]:
    """Rules in learned order: always the earliest rule present, over the whole sequence, left to right."""
    out = list(tokens)
    while len(out) > 1:
        rank = min((rules.get(p, 1 << 30) for p in zip(out, out[1:], strict=False)), default=1 << 30)
        if rank == 1 << 30:
            return out
        nxt, i = [], 0
        while i < len(out):
            if i + 1 < len(out) and rules.get((out[i], out[i + 1])) == rank:
                nxt.append(rank)
                i += 2
            else:
                nxt.append(out[i])
                i += 1
        out = nxt
    return out


def apply_merges(tokens: DataFrame, rules: list[tuple[int, int, int]], column: str = "tokens") -> DataFrame:
    """Replaces the token column by its merged form. New ids grow with rank, so an id is its rule's rank."""
    table = {(a, b): new for a, b, new in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, ...], list[int]] = {}
        for batch in batches:
            out = []
            for t in batch.column(column).to_pylist():
                whole: list[int] = []
                part: list[int] = []
                for x in [*(t or []), DOWN]:  # one more pen token ends the last run
                    if x not in (DOWN, UP):
                        part.append(x)
                        continue
                    if part:
                        if (key := tuple(part)) not in known:
                            if len(known) >= 200_000:
                                known.clear()
                            known[key] = apply_rules(part, table)
                        whole += known[key]
                    whole.append(x)
                    part = []
                whole.pop()
                out.append(whole)
            columns = [pa.array(out, pa.list_(pa.int32())) if name == column else batch.column(name) for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return tokens.withColumn(column, F.col(column).cast("array<int>")).mapInArrow(run, tokens.withColumn(column, F.col(column).cast("array<int>")).schema)


def expansions(rules: list[tuple[int, int, int]]) -> list[list[int]]:
    """Base tokens of every token, by token."""
    out = [[t] for t in range(FIRST_MERGE)]
    for a, b, _ in rules:
        out.append(out[a] + out[b])
    return out


def vocabulary(spark, rules: list[tuple[int, int, int]]) -> DataFrame:
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rules)], "rank int, a int, b int, new int")
