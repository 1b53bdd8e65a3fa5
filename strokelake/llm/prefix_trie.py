"""Conversation prefixes as a z-fast trie.

A conversation is a row of turns (role, text). Its prefix of d turns is named by the exclusive or of its turns' 128-bit hashes,
each with its depth in it; so prefixes are equal if their depths and names are, and names come from running totals. Equal
conversations are one class with its members counted.

A compacted node ends at depth e (its extent) below its parent's end p, and lies in a hash table under the name of its extent's
prefix at the two-fattest depth in (p, e], the one that most powers of two divide. A class finds its exit node by fat binary
search: in the interval (a, b] it asks for the two-fattest depth; a hit moves a to the node's end, a miss moves b below the depth
asked for. One more lookup of the next turn finds the edge it enters but leaves before its handle.

Classes are put in by batches: in each round all pending classes search the trie as it is and compare the edge they exit in with
its representative turn by turn. Of all that exit at one place with one next turn, the longest becomes a leaf; edges are split
at all exit depths at once; a class that ends on the trie has its end as a node. The others search again. So rounds grow with the
number of branches on a path, not with the classes, and all of a class's candidates are found by lookups of names, never by
pairs of classes.

Numbers over subtrees come from doubling: each node knows its ancestor 1, 2, 4, .. nodes up and the total of what is nearer. At
last edges are expanded to nodes, one for each turn.

Turns are numbered by ranges, and names are running totals by segments of `SEGMENT` turns, so a conversation of many rows is no
group. Defined cases: null roles and texts are empty; rows without a conv_id belong to no conversation and go; null turns come
first, rows of one turn by role, then by the hash of role and text; repeated rows are turns of their own; an empty table gives
an empty result (no root); other columns are not read; texts go into hashes and lengths once and are not shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strokelake.llm.common import written
from strokelake.operators.sampling import numbered

SEGMENT = 1024
STEPS = 4  # search steps between two written tables
BATCH = 2_000


def turns(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, x1, x2, bytes): turns in order from 1, with a hash of role and text and the text's UTF-8 bytes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = rows.where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), F.xxhash64(role, text).alias("x1"), F.xxhash64(F.lit(1), text, role).alias("x2"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "x1", "x2"]
    placed = numbered(slim.withColumn("row", F.monotonically_increasing_id()), [*(F.col(c) if isinstance(c, str) else c for c in order), F.col("row")], "number")
    starts = placed.groupBy(F.col("conv_id").alias("c")).agg(F.min("number").alias("start"))
    return placed.join(starts, F.col("conv_id") == F.col("c")).select("conv_id", (F.col("number") - F.col("start") + 1).alias("depth"), "x1", "x2", "bytes")


def prefixes(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, h1, h2, bytes, total): names of prefixes and their texts' bytes, from turns (conv_id, depth, x1, x2, bytes)."""
    named = turns.select("conv_id", "depth", "bytes", F.floor((F.col("depth") - 1) / SEGMENT).alias("s"), F.xxhash64("depth", "x1", "x2").alias("t1"), F.xxhash64("x2", "x1", "depth").alias("t2"))
    inside = Window.partitionBy("conv_id", "s").orderBy("depth")
    runs = named.withColumns({"t1": F.bit_xor("t1").over(inside), "t2": F.bit_xor("t2").over(inside), "total": F.sum("bytes").over(inside)})
    totals = named.groupBy("conv_id", "s").agg(F.bit_xor("t1").alias("u1"), F.bit_xor("t2").alias("u2"), F.sum("bytes").alias("u"))
    before = Window.partitionBy("conv_id").orderBy("s")  # a row a segment
    starts = totals.select(F.col("conv_id").alias("c"), (F.col("s") + 1).alias("q"), F.bit_xor("u1").over(before).alias("u1"), F.bit_xor("u2").over(before).alias("u2"), F.sum("u").over(before).alias("u"))
    # only conversations of several segments have starts to add
    longer = named.where("s > 0").select(F.col("conv_id").alias("l"), F.col("s").alias("ls")).distinct()
    starts = starts.join(longer, (F.col("c") == F.col("l")) & (F.col("q") == F.col("ls"))).select("c", "q", "u1", "u2", "u")
    met = runs.join(starts, (F.col("conv_id") == F.col("c")) & (F.col("s") == F.col("q")), "left")
    add = lambda a, b: F.col(a).bitwiseXOR(F.coalesce(b, F.lit(0)))
    return met.select("conv_id", "depth", add("t1", "u1").alias("h1"), add("t2", "u2").alias("h2"), "bytes", (F.col("total") + F.coalesce("u", F.lit(0))).alias("total"))


def fattest(a: Column, b: Column) -> Column:
    """The number in (a, b] that the highest power of two divides: b without the bits below the highest where a and b differ."""
    x = a.bitwiseXOR(b)
    for k in (1, 2, 4, 8, 16, 32):  # all bits below the highest
        x = x.bitwiseOR(F.shiftrightunsigned(x, k))
    return b.bitwiseAND(F.bitwise_not(F.shiftrightunsigned(x, 1)))


def resolved(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Nodes with the names they are found by, from edges (rep, p, e): a class's turns after depth p to depth e.

    Rows (rep, p, e, p1, p2, c1, c2, f, f1, f2, e1, e2): names at p, at p + 1 (the child's), at the handle f and at e.
    """
    edges = edges.withColumn("f", fattest(F.col("p"), F.col("e")))
    asked = edges.select("rep", "p", "e", "f", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("at")) for k, c in enumerate(("p", "f", "e"))], F.struct(F.lit(3).alias("k"), (F.col("p") + 1).alias("at")))).alias("w"))
    met = asked.select("rep", "p", "e", "f", "w.k", "w.at").join(names, (F.col("rep") == F.col("class")) & (F.col("at") == F.col("depth")), "left")
    here = lambda k, h: F.coalesce(F.max(F.when(F.col("k") == k, F.col(h))), F.lit(0))
    return met.groupBy("rep", "p", "e", "f").agg(*[here(k, h).alias(x + h[1]) for k, x in ((0, "p"), (3, "c"), (1, "f"), (2, "e")) for h in ("h1", "h2")])


def located(pending: DataFrame, nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (class, n, rep, p, e, depth): the edge a class exits in (null: none) and how many of its turns the trie holds.

    `pending` has (class, n), `nodes` what `resolved` gives, `names` (class, depth, h1, h2).
    """
    table = nodes.select(F.col("f").alias("tf"), F.col("f1").alias("t1"), F.col("f2").alias("t2"), F.struct("rep", "p", "e", "e1", "e2").alias("hit"))
    state = pending.select(F.col("class").alias("x"), "n", F.lit(0).cast("long").alias("a"), F.col("n").alias("b"), F.lit(None).cast(table.schema["hit"].dataType).alias("node"))
    step = 0
    while step == 0 or not state.where("a < b").isEmpty():
        for _ in range(STEPS):  # the interval halves, or loses an edge
            asked = state.withColumn("f", F.when(F.col("a") < F.col("b"), fattest(F.col("a"), F.col("b"))))
            asked = asked.join(names, (F.col("x") == F.col("class")) & (F.col("f") == F.col("depth")), "left").drop("class", "depth")
            asked = asked.join(table, (F.col("f") == F.col("tf")) & (F.col("h1") == F.col("t1")) & (F.col("h2") == F.col("t2")), "left")
            found = F.col("hit").isNotNull()
            inside = F.col("hit.e") < F.col("b")
            state = asked.select("x", "n", F.when(found & inside, F.col("hit.e")).otherwise(F.col("a")).alias("a"),
                                 F.when(found & inside, F.col("b")).when(found, F.col("a")).otherwise(F.coalesce(F.col("f") - 1, F.col("b"))).alias("b"), F.coalesce("hit", "node").alias("node"))
        state = written(state, "trie-search")
        step += 1
    # the node's end is on the class's path, or the class exits in its edge; below such an end, the edge that the next turn enters
    at_end = state.join(names, (F.col("x") == F.col("class")) & (F.col("node.e") == F.col("depth")), "left")
    whole = F.col("node").isNull() | ((F.col("node.e") <= F.col("n")) & (F.col("h1") == F.col("node.e1")) & (F.col("h2") == F.col("node.e2")))
    ends = at_end.select("x", "n", "node", F.coalesce(whole, F.lit(False)).alias("whole")).withColumn("next", F.when(F.col("whole"), F.coalesce("node.e", F.lit(0)) + 1))
    children = nodes.select((F.col("p") + 1).alias("cd"), F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.struct("rep", "p", "e", "e1", "e2").alias("child"))
    below = ends.join(names, (F.col("x") == F.col("class")) & (F.col("next") == F.col("depth")), "left").drop("class", "depth")
    below = below.join(children, (F.col("next") == F.col("cd")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    edge = F.when(F.col("whole"), F.col("child")).otherwise(F.col("node"))
    exits = written(below.select("x", "n", edge.alias("edge"), F.coalesce(F.when(F.col("whole"), F.col("node.e")), F.lit(0)).alias("reached")), "trie-exits")
    # along the edge, the last depth with the representative's name
    inside = exits.where("edge IS NOT NULL").select("x", F.col("edge.rep").alias("r"), F.explode(F.sequence(F.col("edge.p") + 1, F.least("edge.e", "n"))).alias("d"))
    inside = inside.where("d > 0").join(names, (F.col("x") == F.col("class")) & (F.col("d") == F.col("depth"))).select("x", "r", "d", "h1", "h2")
    other = names.select(F.col("class").alias("rc"), F.col("depth").alias("rd"), F.col("h1").alias("r1"), F.col("h2").alias("r2"))
    same = inside.join(other, (F.col("r") == F.col("rc")) & (F.col("d") == F.col("rd")) & (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")))
    longest = same.groupBy(F.col("x").alias("y")).agg(F.max("d").alias("m"))
    out = exits.join(longest, F.col("x") == F.col("y"), "left")
    return out.select(F.col("x").alias("class"), "n", "edge.rep", "edge.p", "edge.e", F.greatest("reached", F.coalesce("m", F.lit(0))).alias("depth"))


def compacted(classes: DataFrame, names: DataFrame) -> DataFrame:
    """The trie's nodes but the root (see `resolved`), from classes (class, n) and their prefixes' names (class, depth, h1, h2).

    The first batch is the longest class of each first turn."""
    pending = classes.where("n > 0").select("class", "n")
    nodes: DataFrame | None = None
    while not pending.isEmpty():
        if nodes is None:
            found = pending.select("class", "n", *[F.lit(None).cast("long").alias(c) for c in ("rep", "p", "e")], F.lit(0).cast("long").alias("depth"))
        else:
            found = located(pending, nodes, names)
        found = written(found, "trie-located")
        going = found.where("depth < n").join(names.select(F.col("class").alias("k"), F.col("depth").alias("kd"), "h1", "h2"), (F.col("class") == F.col("k")) & (F.col("depth") + 1 == F.col("kd")))
        # one class for each place and next turn
        batch = written(going.groupBy("kd", "h1", "h2").agg(F.max_by(F.struct("class", "n", "depth"), F.struct("n", F.negative("class"))).alias("b")).select("b.*"), "trie-batch")
        leaves = batch.select(F.col("class").alias("rep"), F.col("depth").alias("p"), F.col("n").alias("e"))
        if nodes is None:
            nodes = written(resolved(leaves, names), "trie-nodes")
        else:
            cuts = found.where("rep IS NOT NULL AND depth > p AND depth < e").select(F.col("rep").alias("cr"), F.col("p").alias("cp"), F.col("e").alias("ce"), "depth").distinct()
            cuts = written(cuts, "trie-cuts")
            whole = cuts.select("cr", "cp", "ce", "depth").union(cuts.select("cr", "cp", "ce", F.col("ce")).distinct())
            edge = Window.partitionBy("cr", "cp", "ce").orderBy("depth")
            parts = whole.select(F.col("cr").alias("rep"), F.coalesce(F.lag("depth").over(edge), F.col("cp")).alias("p"), F.col("depth").alias("e"))
            kept = nodes.join(cuts.select("cr", "cp", "ce").distinct(), (F.col("rep") == F.col("cr")) & (F.col("p") == F.col("cp")) & (F.col("e") == F.col("ce")), "left_anti")
            nodes = written(kept.unionByName(resolved(leaves.union(parts), names)), "trie-nodes")
        pending = written(found.where("depth < n").select("class", "n").join(batch.select(F.col("class").alias("in")), F.col("class") == F.col("in"), "left_anti"), "trie-pending")
    return nodes if nodes is not None else resolved(classes.where("false").select(F.col("class").alias("rep"), F.col("n").alias("p"), F.col("n").alias("e")), names)


def subtrees(nodes: DataFrame, values: dict[str, str]) -> DataFrame:
    """Rows (e, e1, e2, values): each column totalled ("sum" or "min") over the node and all below it, by doubling.

    `nodes` has (e, e1, e2, p, p1, p2, values); the root is the row with e = 0 and p = -1.
    """
    key, up = ["e", "e1", "e2"], ["p", "p1", "p2"]
    both = {"sum": lambda a, b: F.col(a) + F.coalesce(b, F.lit(0)), "min": lambda a, b: F.least(a, b)}
    now = written(nodes.select(*key, *up, *values), "trie-up")
    while not now.where("p >= 0").isEmpty():
        totals = now.where("p >= 0").groupBy(*[F.col(u).alias("g" + u) for u in up]).agg(*[getattr(F, how)(c).alias("g_" + c) for c, how in values.items()])
        ahead = now.select(*[F.col(k).alias("a" + k) for k in key], *[F.col(u).alias("a" + u) for u in up])
        met = now.join(totals, (F.col("e") == F.col("gp")) & (F.col("e1") == F.col("gp1")) & (F.col("e2") == F.col("gp2")), "left")
        met = met.join(ahead, (F.col("p") == F.col("ae")) & (F.col("p1") == F.col("ae1")) & (F.col("p2") == F.col("ae2")), "left")
        now = written(met.select(*key, F.coalesce("ap", F.lit(-1).cast("long")).alias("p"), F.coalesce("ap1", F.lit(0)).alias("p1"), F.coalesce("ap2", F.lit(0)).alias("p2"), *[both[how](c, "g_" + c).alias(c) for c, how in values.items()]), "trie-up")
    return now.select(*key, *values)


def member_digests(members: DataFrame) -> DataFrame:
    """Rows (class, ends_sha256): SHA-256 of the conv_ids of a class in decimal, ascending, joined by commas; streamed in order."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, told, classes, out = None, None, [], []
        for batch in batches:
            for own, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own == last:
                    told.update(f",{conv_id}".encode())
                    continue
                if told is not None:
                    classes.append(last)
                    out.append(told.hexdigest())
                last, told = own, hashlib.sha256(str(conv_id).encode())
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(out, pa.string())], names=["m", "ends_sha256"])
            classes, out = [], []
        if told is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([told.hexdigest()], pa.string())], names=["m", "ends_sha256"])

    return members.select("class", "conv_id").repartition("class").sortWithinPartitions("class", "conv_id").mapInArrow(digest, "m bigint, ends_sha256 string")


def trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one per distinct prefix.

    `ids` (conv_id, distinct) are the conversations, `turns` (conv_id, depth from 1, x1, x2, bytes) their turns; a conversation
    may have none.
    """
    every = written(prefixes(turns), "prefixes")
    last = every.groupBy(F.col("conv_id").alias("c")).agg(F.max_by(F.struct("depth", "h1", "h2"), "depth").alias("l"))
    convs = ids.join(last, F.col("conv_id") == F.col("c"), "left").select("conv_id", *[F.coalesce("l." + k, F.lit(0).cast("long")).alias(v) for k, v in (("depth", "n"), ("h1", "n1"), ("h2", "n2"))])
    convs = written(convs, "conversations")
    classes = written(convs.groupBy("n", "n1", "n2").agg(F.min("conv_id").alias("class"), F.count("*").alias("members")), "trie-classes")
    members = convs.join(classes.withColumnsRenamed({"n": "m", "n1": "m1", "n2": "m2"}), (F.col("n") == F.col("m")) & (F.col("n1") == F.col("m1")) & (F.col("n2") == F.col("m2")))
    digests = written(member_digests(members), "trie-members")
    names = written(every.join(classes.select("class"), F.col("conv_id") == F.col("class"), "left_semi").select(F.col("conv_id").alias("class"), "depth", "h1", "h2", "bytes", "total"), "trie-names")
    bare = names.drop("bytes", "total")
    nodes = compacted(classes, bare).select("rep", "p", "e", "p1", "p2", "e1", "e2")
    zero = F.lit(0).cast("long")
    root = classes.groupBy().agg(F.min("class").alias("rep")).where("rep IS NOT NULL").select("rep", F.lit(-1).cast("long").alias("p"), zero.alias("e"), *[zero.alias(c) for c in ("p1", "p2", "e1", "e2")])
    nodes = nodes.unionByName(root)

    # what each node has of its own: the class that ends there, children, and the bytes of its edge
    edge = nodes.select("rep", "p", "e", F.explode(F.sequence(F.col("p") + 1, F.col("e"))).alias("d")).where("d > 0")
    steps = written(edge.join(names, (F.col("rep") == F.col("class")) & (F.col("d") == F.col("depth"))).select("rep", "p", "e", "d", (F.col("total") - F.col("bytes")).alias("before"), "bytes"), "trie-edges")
    sizes = steps.groupBy(F.col("rep").alias("sr"), F.col("p").alias("sp"), F.col("e").alias("se")).agg(F.sum("bytes").alias("size"), F.min("before").alias("base"))
    children = nodes.where("p >= 0").groupBy(F.col("p").alias("kp"), F.col("p1").alias("kp1"), F.col("p2").alias("kp2")).agg(F.count("*").alias("kids"))
    own = nodes.join(classes, (F.col("e") == F.col("n")) & (F.col("e1") == F.col("n1")) & (F.col("e2") == F.col("n2")), "left")
    own = own.join(children, (F.col("e") == F.col("kp")) & (F.col("e1") == F.col("kp1")) & (F.col("e2") == F.col("kp2")), "left")
    own = own.join(sizes, (F.col("rep") == F.col("sr")) & (F.col("p") == F.col("sp")) & (F.col("e") == F.col("se")), "left")
    own = written(own.select("rep", "p", "p1", "p2", "e", "e1", "e2", F.col("class").alias("least"), F.col("class").alias("ending"), F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("kids", F.lit(0)).alias("kids"),
                             F.coalesce("kids", F.lit(0)).eqNullSafe(0).cast("long").alias("leaves"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("base", F.lit(0)).alias("base")), "trie-own")
    key = ["e", "e1", "e2"]
    below = subtrees(own, {"members": "sum", "least": "min", "leaves": "sum"})
    full = written(own.drop("members", "least", "leaves").join(below, key).withColumn("saved", (F.col("members") - 1) * F.col("size")), "trie-full")
    full = full.drop("saved").join(subtrees(full, {"saved": "sum"}), key)
    parents = full.select(F.col("e").alias("qe"), F.col("e1").alias("qe1"), F.col("e2").alias("qe2"), F.col("least").alias("parent_least"))
    full = full.join(parents, (F.col("p") == F.col("qe")) & (F.col("p1") == F.col("qe1")) & (F.col("p2") == F.col("qe2")), "left")
    full = full.join(digests, F.col("ending") == F.col("m"), "left")
    full = written(full.select("rep", "p", "e", "least", "parent_least", "members", "kids", "leaves", "saved", "base", "ends_sha256"), "trie-totals")

    # expanded edges: a node inside an edge has one child, and what its subtree saves lacks the turns above it on the edge
    inner = steps.select(F.col("rep").alias("er"), F.col("p").alias("ep"), F.col("e").alias("ee"), "d", "before")
    inner = inner.union(root.select("rep", "p", "e", zero, zero))
    out = inner.join(full, (F.col("er") == F.col("rep")) & (F.col("ep") == F.col("p")) & (F.col("ee") == F.col("e")))
    end = F.col("d") == F.col("e")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("least").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == F.col("p") + 1, F.col("parent_least")).otherwise(F.col("least")).alias("parent_conv_id"), F.col("members").alias("n_convs"),
                      F.when(end, F.col("kids")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") - (F.col("members") - 1) * (F.col("before") - F.col("base"))).alias("saved_tokens"),
                      F.coalesce(F.when(end, F.col("ends_sha256")), F.lit(none)).alias("ends_sha256"))
