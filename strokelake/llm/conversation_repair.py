"""Repair of conversation structure by grammar-compressed dynamic programming.

A conversation's rows, in order, become a string of symbols: the initial of the role (s, u, a or another) and the fault. An
edit script keeps, reroles or deletes each row and inserts rows anywhere, so that the roles' initials spell `(s?(ua)+)?`; the
cheapest script wins, of equal ones the one whose letters (D, I, K, R) come first in ASCII.

1. Rows are numbered in order of (conversation, turn, role, hash of the text) over all conversations, by ranges; a conversation's
   rows are cut into segments of at most `SEGMENT` rows, so a long conversation is many segments in many tasks.
2. Re-Pair over the distinct segments of all conversations: pairs of neighbouring symbols are counted, and the most frequent of
   a round become rules, each replaced from left to right; at most `RULES_A_ROUND` rules a round come to the driver. Rules only
   share work: whatever they are, results are the same.
3. Each symbol is a matrix over the four states of the pattern's automaton: the least cost from state to state, with its
   letters as a rope (a pair of the ropes it was made of). A rule's matrix is the min-plus product of its two symbols', made
   once, bottom-up; a segment is the product of what its string is compressed to, made once per distinct string and worker.
4. A conversation's segments are multiplied pairwise in order, and its best cell from the start to an accepting state is taken.
   Scripts that compete for a cell cover the same rows at the same cost, so none is the start of another, and the least
   script of a product is made of least scripts.

Defined cases: null roles and texts are one space; a null conv_id is a conversation of its own; null turns come first, rows of one
turn by role, then by the hash of role and text (equal rows by place); a role without an initial counts as another role; an
empty table gives empty results; other columns are not read. A script is one value, so it must fit a row; texts are not
gathered: `edits` and `digests` stream through a conversation's sorted rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from strokelake.llm.common import TRIM, written
from strokelake.operators.sampling import numbered

SEGMENT = 256
ROUNDS = 4
RULES_A_ROUND = 32
LEAST_COUNT = 4
CACHE_STRINGS = 100_000
BATCH = 2_000

INITIALS = "sua"  # the fourth kind is any other
FAULTS = ("none", "truncated", "blank", "duplicate")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})  # states: nothing yet, after s, after u, after a
ACCEPTS = (0, 3)
LEGAL = {"su", "ua", "au"}

Rope = str | tuple  # letters, or two ropes
Cell = tuple[int, Rope] | None
Matrix = list[list[Cell]]


def symbol(initial: int, fault: int) -> str:
    return chr(65 + 4 * initial + fault)


def spelled(rope: Rope) -> str:
    out, stack = [], [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            out.append(top)
        else:
            stack += [top[1], top[0]]
    return "".join(out)


def better(a: Cell, b: Cell) -> Cell:
    if a is None or b is None or a[0] != b[0]:
        return a if b is None or a is not None and a[0] < b[0] else b
    return a if spelled(a[1]) <= spelled(b[1]) else b


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for k in range(4):
            if (left := a[i][k]) is not None:
                for j in range(4):
                    if (right := b[k][j]) is not None:
                        cell = (left[0] + right[0], (left[1], right[1]) if left[1] and right[1] else left[1] or right[1])
                        out[i][j] = cell if out[i][j] is None else better(out[i][j], cell)
    return out


def insertions() -> Matrix:
    """Rows inserted at one place."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        at, letters = i, ""
        while out[i][at] is None:
            out[i][at] = (INSERT * len(letters), letters)
            at, letters = NEXT[at].get("u", NEXT[at].get("a")), letters + "I"
    return out


def of_row(name: str) -> Matrix:
    """One row, with what is inserted before it."""
    initial, fault = divmod(ord(name) - 65, 4)
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        out[i][i] = (DELETE, "D")
        if fault < 2:
            steps = [(NEXT[i].get(INITIALS[initial]) if initial < 3 else None, KEEP, "K"), *((NEXT[i].get(r), REROLE, "R") for r in "ua")]
            for at, cost, letter in steps:
                if at is not None:
                    out[i][at] = better(out[i][at], (cost + TRUNCATED * fault, letter))
    return product(insertions(), out)


class Grammar:
    """Rules (pair, name) in order, with a matrix for each symbol, made bottom-up."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.rules = rules
        self.matrices = {s: of_row(s) for s in (symbol(i, f) for i in range(4) for f in range(4))}
        for pair, name in rules:
            self.matrices[name] = product(self.matrices[pair[0]], self.matrices[pair[1]])

    def compressed(self, symbols: str) -> str:
        for pair, name in self.rules:
            symbols = symbols.replace(pair, name)
        return symbols

    def matrix(self, symbols: str) -> Matrix:
        names = self.compressed(symbols)
        out = self.matrices[names[0]]
        for name in names[1:]:
            out = product(out, self.matrices[name])
        return [[cell and (cell[0], spelled(cell[1])) for cell in row] for row in out]


def learned(strings: DataFrame) -> list[tuple[str, str]]:
    """Re-Pair rules of the distinct strings (symbols), by rounds."""
    rules: list[tuple[str, str]] = []
    for _ in range(ROUNDS):
        chars = F.split("symbols", "")
        pairs = F.transform(F.sequence(F.lit(1), F.length("symbols") - 1), lambda i: F.concat(F.get(F.col("c"), i - 1), F.get(F.col("c"), i)))
        counts = strings.where(F.length("symbols") > 1).withColumn("c", chars).select(F.explode(pairs).alias("pair")).groupBy("pair").count().where(F.col("count") >= LEAST_COUNT)
        new = [(r.pair, chr(256 + len(rules) + i)) for i, r in enumerate(counts.orderBy(F.desc("count"), "pair").limit(RULES_A_ROUND).collect())]
        if not new:
            break
        rules += new
        now: Column = F.col("symbols")
        for pair, name in new:
            now = F.replace(now, F.lit(pair), F.lit(name))
        strings = written(strings.select(now.alias("symbols")), "paired")
    return rules


def ordered(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, h1, h2): nulls of role and text filled, and the hash that orders and names role and text."""
    filled = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return filled.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "text", "role")})


def _order() -> list[Column]:
    return [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("h1"), F.asc("h2")]


def symbols(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, segment, symbols), from rows (conv_id, turn, role, text)."""
    last = F.substring(F.rtrim("text", F.lit(TRIM)), -1, 1)
    kind = F.when(last == "", 2).when(last.isin(".", "!", "?"), 0).otherwise(1)
    initial = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(INITIALS) for x in (r, i)]), F.substring("role", 1, 1)), F.lit(3))
    slim = ordered(rows).select("conv_id", "turn", "role", "h1", "h2", initial.alias("initial"), kind.alias("kind"))
    # equal rows are told apart by nothing but their place, so a range may end between them
    placed = numbered(slim.withColumn("row", F.monotonically_increasing_id()), [*_order(), F.asc("row")]).drop("row")
    firsts = placed.groupBy("conv_id", "role", "h1", "h2").agg(F.min("number").alias("first")).select("first")
    marked = placed.join(firsts, F.col("number") == F.col("first"), "left")
    fault = F.when((F.col("kind") != 2) & F.col("first").isNull(), 3).otherwise(F.col("kind"))
    named = marked.select("conv_id", F.floor(F.col("number") / SEGMENT).alias("segment"), "number", F.chr(65 + 4 * F.col("initial") + fault).alias("name"))
    inside = F.transform(F.sort_array(F.collect_list(F.struct("number", "name"))), lambda x: x["name"])
    return named.groupBy("conv_id", "segment").agg(F.array_join(inside, "").alias("symbols"))


def described(text: str, matrix: Matrix) -> dict:
    """What a segment says: its counts, the pairs of initials that are not allowed, and its matrix."""
    kinds = [divmod(ord(c) - 65, 4) for c in text]
    initials = ["sua-"[i] for i, _ in kinds]
    cells = [cell for row in matrix for cell in row]
    return {"truncated": sum(f == 1 for _, f in kinds), "blank": sum(f == 2 for _, f in kinds), "duplicate": sum(f == 3 for _, f in kinds),
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "head": initials[0], "tail": initials[-1],
            "costs": [c and c[0] for c in cells], "audits": [c and c[1] for c in cells]}


DESCRIBED = "truncated bigint, blank bigint, duplicate bigint, illegal bigint, head string, tail string, costs array<bigint>, audits array<string>"


def joined(a: dict, b: dict) -> dict:
    """Two neighbouring segments as one."""
    left, right = ([[None if c is None else (c, t) for c, t in zip(x["costs"][i : i + 4], x["audits"][i : i + 4])] for i in (0, 4, 8, 12)] for x in (a, b))
    cells = [cell and (cell[0], spelled(cell[1])) for row in product(left, right) for cell in row]
    out = {k: a[k] + b[k] for k in ("truncated", "blank", "duplicate")}
    return out | {"illegal": a["illegal"] + b["illegal"] + (a["tail"] + b["head"] not in LEGAL), "head": a["head"], "tail": b["tail"], "costs": [c and c[0] for c in cells], "audits": [c and c[1] for c in cells]}


def finished(x: dict) -> tuple[int, str]:
    """Cost and letters of the cheapest script from the start to an accepting state, with what is inserted at the end."""
    start: Matrix = [[None if c is None else (c, t) for c, t in zip(x["costs"][:4], x["audits"][:4])]] + [[None] * 4] * 3
    row = product(start, insertions())[0]
    cost, rope = better(row[ACCEPTS[0]], row[ACCEPTS[1]])
    return cost, spelled(rope)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Neighbouring rows with equal conv_id, over the borders of batches."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, key=lambda r: r["conv_id"])


def repair(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one per conversation of rows (conv_id, turn, role, text)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    strings = written(symbols(rows), "symbols")
    grammar = Grammar(learned(written(strings.select("symbols").distinct(), "distinct-symbols")))

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                if (found := known.get(text)) is None:
                    if len(known) >= CACHE_STRINGS:
                        known.clear()
                    found = known[text] = described(text, grammar.matrix(text))
                out.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[f.name] for r in out], f.type) for f in list(segment_schema)[2:])], schema=segment_schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv_id, segments in _runs(batches):
            stack: list[tuple[int, dict]] = []
            for segment in segments:  # neighbours of equal weight are joined, so a script is copied a logarithmic number of times
                weight, own = 1, segment
                while stack and stack[-1][0] <= weight:
                    w, before = stack.pop()
                    weight, own = weight + w, joined(before, own)
                stack.append((weight, own))
            while len(stack) > 1:
                (w, own), (v, before) = stack.pop(), stack.pop()
                stack.append((v + w, joined(before, own)))
            cost, audit = finished(stack[0][1])
            out.append({"conv_id": conv_id, "cost": cost, "audit": audit} | {k: stack[0][1][k] for k in ("blank", "duplicate", "truncated", "illegal")})
            if len(out) >= BATCH:
                yield pa.RecordBatch.from_pylist(out, schema=final_schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=final_schema)

    told = f"conv_id {kind}, segment bigint, {DESCRIBED}"
    final = f"conv_id {kind}, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
    spark = rows.sparkSession
    segment_schema, final_schema = (to_arrow_schema(spark.createDataFrame([], s).schema) for s in (told, final))
    segments = strings.select("conv_id", "segment", "symbols").mapInArrow(evaluate, told)
    found = segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(fold, final)
    turns = rows.groupBy(F.col("conv_id").alias("c")).agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("g"))
    return found.join(turns, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", F.coalesce("g", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def edits(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """Rows (conv_id, place, edit, turn, was, role, text): each letter of a conversation's script, what it did and what stands there now.

    `was` is the row's own role, null for what is inserted; role and text are null for what is deleted. A conversation's rows
    come in order in one partition.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    both = ordered(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "h1", "h2", "text")
    scripts = repaired.select("conv_id", F.lit(0), F.lit(None).cast(kinds["turn"]), F.lit(""), F.lit(0).cast("long"), F.lit(0).cast("long"), F.col("audit"))
    stream = both.union(scripts).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "kind", *_order()[1:])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for conv_id, run in _runs(batches):
            letters, place, state = next(run)["text"], 0, 0
            while True:
                row = next(run, None)
                while place < len(letters) and letters[place] == "I":
                    state, role = (3, "assistant") if state == 2 else (2, "user")
                    out.append({"conv_id": conv_id, "place": place, "edit": "I", "role": role, "text": ""})
                    place += 1
                if row is None:
                    break
                edit, own = letters[place], {"conv_id": conv_id, "place": place, "turn": row["turn"], "was": row["role"]}
                if edit == "R":
                    state, role = (3, "assistant") if state == 2 else (2, "user")
                elif edit == "K":
                    role = row["role"]
                    state = NEXT[state][role[0]]
                out.append(own | {"edit": edit} | ({} if edit == "D" else {"role": role, "text": row["text"]}))
                place += 1
                if len(out) >= BATCH:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    told = f"conv_id {kinds['conv_id']}, place bigint, edit string, turn {kinds['turn']}, was string, role string, text string"
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], told).schema)
    return stream.select("conv_id", "turn", "role", "text").mapInArrow(apply, told)


def digests(edited: DataFrame) -> DataFrame:
    """Rows (conv_id, repaired_sha256): SHA-256 of a repaired conversation's `role:text`, joined by line feeds. From `edits` as it came."""
    kind = edited.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv_id, run in _runs(batches):
            told, first = hashlib.sha256(), True
            for row in run:
                if row["edit"] != "D":
                    told.update(f"{'' if first else chr(10)}{row['role']}:{row['text']}".encode())
                    first = False
            out.append({"conv_id": conv_id, "repaired_sha256": told.hexdigest()})
            if len(out) >= BATCH:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    told = f"conv_id {kind}, repaired_sha256 string"
    schema = to_arrow_schema(edited.sparkSession.createDataFrame([], told).schema)
    return edited.select("conv_id", "edit", "role", "text").mapInArrow(digest, told)
