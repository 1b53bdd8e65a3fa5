"""Splits, draws, packing of examples and batches, reproducible by hashes of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strokelake.functions.arrays import uniform
from strokelake.operators import blocks
from strokelake.sources.scratch import written


DRAW_CELLS = 1024


def split(rows: DataFrame, key: str, source: str, most_test: int = 1000, share: int = 20, seed: str = "split") -> DataFrame:
    """Adds `part`: of each source the last min(most_test, n div share) rows in hash order are test."""
    order = Window.partitionBy(source).orderBy(F.desc(uniform(seed, F.col(key))), key)
    # only rows that can be test are ranked: each task hands on `most_test` a source, however large the source
    last = rows.select(F.col(source).alias("_s"), F.col(key).alias("_k"), F.row_number().over(order).alias("_r")).where(F.col("_r") <= most_test)
    sizes = rows.groupBy(F.col(source).alias("_t")).agg(F.count("*").alias("_n"))
    test = last.join(sizes, F.col("_s").eqNullSafe(F.col("_t"))).where(F.col("_r") <= F.floor(F.col("_n") / share)).select("_k", F.lit("test").alias("_p"))
    return rows.join(test, F.col(key) == F.col("_k"), "left").withColumn("part", F.coalesce("_p", F.lit("train"))).drop("_k", "_p")


def split_by_tables(rows: DataFrame, tests: DataFrame, key: str, source: str, most_train: int | None = None, seed: str = "split") -> DataFrame:
    """Adds `part` where test tables are given: every row of `tests` is test and no row of its key trains; of the others at most
    `most_train` a source train, in hash order, and the rest are left out. A test row needs no twin among the rows.

    Null keys are no test keys. Each task hands on `most_train` rows a source, however large the source.
    """
    train = rows.join(tests.select(F.col(key).alias("_k")).where("_k IS NOT NULL").distinct(), F.col(key) == F.col("_k"), "left_anti")
    if most_train is not None:
        train = first_by_hash(train, key, source, most_train, seed)
    return train.withColumn("part", F.lit("train")).unionByName(tests.select(*rows.columns, F.lit("test").alias("part")))


def numbered(rows: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """Adds `name`, the place of each row in the order, from 0. Rows are range-sorted and written once; a range starts where
    the counts before it end, so no task sorts all rows, and a key of many rows is no group."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_c"))  # a row for each range
    starts = counts.select("_part", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_start"))
    return ranged.join(F.broadcast(starts), "_part").select(*rows.columns, (F.col("_start") + F.col("_at")).cast("long").alias(name))


def places(rows: DataFrame, by: str, order: list[Column], place: str = "_at", size: str = "_n") -> DataFrame:
    """Adds each row's place in its group, from 0, and the group's size. Groups are cut from one numbered order, so a group of
    any size is spread over many tasks; rows are computed once, and written before they are dealt."""
    spread = numbered(written(rows), [F.col(by), *order], "_i")
    sizes = spread.groupBy(F.col(by).alias("_b")).agg(F.min("_i").alias("_s"), F.count("*").alias(size))
    return spread.join(sizes, F.col(by).eqNullSafe(F.col("_b"))).select(*rows.columns, (F.col("_i") - F.col("_s")).alias(place), size)


def first_by_hash(rows: DataFrame, key: str, by: str, limit: int, seed: str) -> DataFrame:
    """At most `limit` rows of each group, in hash order."""
    w = Window.partitionBy(by).orderBy(uniform(seed, F.col(key)), key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def percentiles(rows: DataFrame, by: str | None, value: str, shares: list[float]) -> DataFrame:
    """Rows (by, q): exact percentiles of each group (or of all rows, with a constant `by`), linear between neighbours.

    Values are numbered in a range-sorted table and only those at the places asked for are read, so a group of any size is
    spread over many tasks.
    """
    group = by or "_g"
    clean = (rows if by else rows.withColumn("_g", F.lit(1))).select(group, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    placed = numbered(clean, [F.col(group), F.col("_v")], "_i")
    sizes = placed.groupBy(F.col(group).alias("_b")).agg(F.min("_i").alias("_s"), F.count("*").alias("_n"))
    at = [(F.lit(p) * (F.col("_n") - 1), i) for i, p in enumerate(shares)]
    wanted = F.array(*[x for place, _ in at for x in (F.floor(place), F.ceil(place))])
    some = placed.join(sizes, F.col(group).eqNullSafe(F.col("_b"))).withColumn("_k", F.col("_i") - F.col("_s")).where(F.array_contains(wanted, F.col("_k")))
    here = lambda k: F.max(F.when(F.col("_k") == k, F.col("_v")))
    between = lambda place: (lambda low, high, share: low + (high - low) * share)(here(F.floor(place)), here(F.ceil(place)), F.max(place - F.floor(place)))
    return some.groupBy(group).agg(F.array(*[between(place) for place, _ in at]).alias("q"))


def dimension(rows: DataFrame, name: str) -> DataFrame:
    """Rows (id, name): sorted distinct names from 1; 0 means unknown."""
    names = rows.where(F.coalesce(F.col(name).cast("string"), F.lit("")) != "").select(name).distinct()
    return numbered(names, [F.col(name)], "_i").select((F.col("_i") + 1).cast("int").alias("id"), name)


def with_dimension(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    return rows.join(ids, name, "left").withColumn("id", F.coalesce("id", F.lit(0)))


def draw_tables(rows: DataFrame, group: str, weight: str, key: str, seed: str = "draw", carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """What draws are made from, written once for any number of shards of draws: the spans of the groups on [0, 1), and the members
    numbered in each group, with the columns they carry."""
    cells = DRAW_CELLS
    groups = rows.groupBy(group).agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
    order = Window.orderBy(group)  # a row a group
    total = F.sum("w").over(Window.partitionBy())
    spans = groups.select(group, "n", ((F.sum("w").over(order) - F.col("w")) / total).alias("low"), (F.sum("w").over(order) / total).alias("high"))
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells).cast("int"), F.least(F.lit(cells - 1), F.floor(F.col("high") * cells).cast("int")))))
    numbers = numbered(rows.select(group, key, *carry).withColumn("_u", uniform(f"{seed}-member", F.col(key))), [F.col(group), F.col("_u"), F.col(key)], "_i")
    starts = numbers.groupBy(group).agg(F.min("_i").alias("_s"))
    members = numbers.join(starts, group).select(group, key, *carry, (F.col("_i") - F.col("_s")).alias("_m"))
    return written(spans), written(members)


def weighted_draws(rows: DataFrame, draws: DataFrame | int, group: str, weight: str, key: str, most: int, seed: str = "draw", carry: tuple[str, ...] = (),
                   tables: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Rows (draw, group, key, place) and carried columns: a group by the sum of its weights, then uniform 1..min(most, size) distinct members.

    `draws` are numbers, or rows (draw): a draw depends on its own number alone, so any shard can make its own, from `draw_tables`
    made once. Groups cover [0, 1) by cumulated weight, and a draw's number falls into one of them. Groups are cut into cells of
    the unit interval, so the interval join is an equi-join on cells. Members are numbered in each group; a draw picks
    distinct numbers (the i-th of the last `limit` stands in for one that is there already), so it meets its own members alone.
    """
    spans, members = tables or draw_tables(rows, group, weight, key, seed, carry)
    draws = rows.sparkSession.range(draws).withColumnRenamed("id", "draw") if isinstance(draws, int) else draws.select("draw")
    draws = draws.withColumn("u", uniform(seed, F.col("draw")))
    draws = draws.withColumn("cell", F.floor(F.col("u") * DRAW_CELLS).cast("int"))
    hit = draws.join(spans, "cell").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    limit = F.floor(uniform(seed, F.col("draw"), 1) * F.least(F.lit(most), F.col("n"))).cast("int") + 1
    hit = hit.select("draw", group, "n", limit.alias("limit"))

    def pick(taken: Column, j: Column) -> Column:
        last = F.col("n") - F.col("limit") + j
        one = F.floor(uniform(seed, F.col("draw"), 2 + j) * (last + 1))
        return F.concat(taken, F.array(F.when(F.array_contains(taken, one), last).otherwise(one)))

    picked = F.aggregate(F.sequence(F.lit(0), F.col("limit") - 1), F.array().cast("array<bigint>"), pick)
    met = hit.select("draw", group, F.explode(picked).alias("_m")).join(members, [group, "_m"])
    place = F.row_number().over(Window.partitionBy("draw").orderBy(uniform(seed, F.concat_ws("/", F.col("draw").cast("string"), F.col(key).cast("string")), F.lit("order")), key))
    return met.select("draw", group, key, *carry, place.alias("place"))


def weighted_sample(rows: DataFrame, n: int, key: str, weight: Column, seed: str = "sample") -> DataFrame:
    """n rows without replacement, by weight: the largest ln(u) / w."""
    order = F.ln(F.greatest(uniform(seed, F.col(key)), F.lit(1e-12))) / weight
    return rows.withColumn("_k", order).orderBy(F.desc("_k"), key).limit(n).drop("_k")


def weighted_sample_by(rows: DataFrame, n: int, by: str, key: str, weight: Column, seed: str = "sample") -> DataFrame:
    """At most n rows of each group without replacement, by weight: the largest ln(u) / w, n a group from each task. Rows with no
    weight over zero are never drawn."""
    order = F.ln(F.greatest(uniform(seed, F.col(key)), F.lit(1e-12))) / weight
    w = Window.partitionBy(by).orderBy(F.desc("_k"), key)
    return rows.where(weight > 0).withColumn("_k", order).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_k", "_r")


def join_words(words: DataFrame, seq: str, place: str, tokens: str, size: str, block: int, limit: int) -> DataFrame:
    """Words of a sequence up to the first that would overflow: two more tokens between words, one more byte between texts.

    The first word always stays. Running sums over the words in order find the first overflow.
    """
    w = Window.partitionBy(seq).orderBy(place)
    more = F.when(F.row_number().over(w) > 1, 1).otherwise(0)
    sums = words.withColumns({"_t": F.sum(F.col(tokens)).over(w) + 2 * (F.row_number().over(w) - 1), "_b": F.sum(F.col(size)).over(w) + F.row_number().over(w) - 1, "_m": more})
    over = (F.col("_m") == 1) & ((F.col("_t") > block - 2) | (F.col("_b") > limit))
    return sums.withColumn("_o", over.cast("int")).withColumn("_s", F.max("_o").over(w)).where("_s = 0").drop("_t", "_b", "_m", "_o", "_s")


def make_example(tokens: Column, block: int, bos: int, end: int, pad: int) -> Column:
    """Struct x, y of `block` tokens: BOS, tokens, END, padding; y is x shifted, -1 on padding and for an END after a cut."""
    kept = F.slice(tokens, F.lit(1), F.lit(block - 2))
    x = F.concat(F.array(F.lit(bos)), kept, F.array(F.lit(end)), F.array_repeat(F.lit(pad), F.lit(block - 2) - F.size(kept)))
    last = F.when(F.size(tokens) > block - 2, -1).otherwise(end)
    y = F.concat(kept, F.array(last), F.array_repeat(F.lit(-1), F.lit(block - 1) - F.size(kept)))
    return F.struct(x.alias("x"), y.alias("y"))


def sorted_batches(rows: DataFrame, key: str, length: str, size: int) -> DataFrame:
    """Adds `batch`: rows in order of length and key, `size` a batch."""
    return numbered(rows, [F.col(length), F.col(key)], "_i").withColumn("batch", F.floor(F.col("_i") / size)).drop("_i")


def budget_batches(pool: list[tuple[int, int]], budget: int, step: int, block: int) -> tuple[list[tuple[int, int, list[int]]], list[tuple[int, int]]]:
    """Batches (width, rows, keys) of one pool of (length, key), longest first, and what is carried over."""
    pool = sorted(pool)
    end, out = len(pool), []
    while end > 0:
        width = min(block, -(-pool[end - 1][0] // step) * step)
        size = max(1, budget // width)
        if size > end:
            break
        out.append((width, size, [k for _, k in pool[end - size : end]]))
        end -= size
    return out, pool[:end]


def token_budget_batches(rows: DataFrame, pool: str, key: str, length: str, budget: int, step: int, block: int) -> DataFrame:
    """Rows (pool, batch, key, width): each pool folded by itself; leftovers have batch -1. Pools hold a bounded number of rows."""
    import pyarrow as pa

    def fold(table: pa.Table) -> pa.Table:
        pairs = list(zip(table.column("length").to_pylist(), table.column("key").to_pylist(), strict=True))
        batches, left = budget_batches(pairs, budget, step, block)
        out = [(b, k, width) for b, (width, _, keys) in enumerate(batches) for k in keys] + [(-1, k, min(block, -(-n // step) * step)) for n, k in left]
        name = table.column("pool")[0].as_py()
        return pa.table({"pool": pa.array([name] * len(out), pa.int64()), "batch": pa.array([o[0] for o in out], pa.int32()), "key": pa.array([o[1] for o in out], pa.int64()),
                         "width": pa.array([o[2] for o in out], pa.int32())})

    slim = rows.select(F.col(pool).cast("bigint").alias("pool"), F.col(key).cast("bigint").alias("key"), F.col(length).cast("int").alias("length"))
    return slim.groupBy("pool").applyInArrow(fold, "pool bigint, batch int, key bigint, width int")


def length_report(rows: DataFrame, length: str, block: int, by: str | None = None) -> DataFrame:
    """Rows (by, n, median, p99, cut): count, median, 99th percentile and the share that is cut, by group or (by 1) of all rows."""
    rows, by = (rows, by) if by else (rows.withColumn("all", F.lit(1)), "all")
    q = percentiles(rows, by, length, [0.5, 0.99]).withColumnRenamed(by, "_b")
    counts = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg((F.col(length) > block - 2).cast("double")).alias("cut"))
    return counts.join(q, F.col(by).eqNullSafe(F.col("_b")), "left").select(by, "n", F.col("q")[0].alias("median"), F.col("q")[1].alias("p99"), "cut")


def example_tables(words: DataFrame, group: str, weight: str, key: str, tokens: str, size: str, seed: str = "draw") -> tuple[DataFrame, DataFrame]:
    """The `draw_tables` that `drawn_examples` needs, to be made once for many shards of draws."""
    sized = words.select(group, weight, key, F.size(tokens).alias("_n"), F.col(size).alias("_size"))
    return draw_tables(sized, group, weight, key, seed, ("_n", "_size"))


def drawn_examples(words: DataFrame, draws: DataFrame | int, group: str, weight: str, key: str, tokens: str, size: str, most: int, block: int, limit: int, marks: dict[str, int], seed: str = "draw",
                   tables: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Rows (draw, x, y): words drawn, joined up to the first that overflows (two WORD tokens between), made an example.

    Which words stay is decided by their sizes; only then do tokens meet them, cut one past what an example can hold.
    """
    tables = tables or example_tables(words, group, weight, key, tokens, size, seed)
    chosen = weighted_draws(words, draws, group, weight, key, most, seed, ("_n", "_size"), tables)
    kept = join_words(chosen, "draw", "place", "_n", "_size", block, limit).select("draw", "place", key)
    held = kept.join(words.select(key, F.slice(tokens, 1, block - 1).alias("_t")), key)
    whole = held.groupBy("draw").agg(F.sort_array(F.collect_list(F.struct("place", F.col("_t").alias("t")))).alias("_w"))
    gap = F.array(F.lit(marks["WORD"]), F.lit(marks["WORD"]))
    joined = F.flatten(F.transform("_w", lambda w, i: F.when(i > 0, F.concat(gap, w["t"])).otherwise(w["t"])))
    return whole.select("draw", make_example(joined, block, marks["BOS"], marks["END"], marks["PAD"]).alias("e")).select("draw", "e.x", "e.y")


def evaluation_parts(rows: DataFrame, key: str, source: str, held: Column, most_held: int = 1000, most_seen: int = 300, most_train: int | None = None, seed: str = "eval") -> DataFrame:
    """The rows of each part with `part`: of each source at most so many held-out and seen ones, and for training those not
    held out, at most `most_train` over all sources; each in hash order."""
    inside, outside = rows.where(held), rows.where(~held)
    train = outside if most_train is None else outside.orderBy(uniform(f"{seed}-train", F.col(key)), key).limit(most_train)
    parts = {"held": first_by_hash(inside, key, source, most_held, seed), "seen": first_by_hash(outside, key, source, most_seen, seed), "train": train}
    named = [df.withColumn("part", F.lit(name)) for name, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


def prompt_list(rows: DataFrame, label: str, phrase: str, key: str, source: str, held: Column, n: int, most: int, seed: str = "prompt") -> DataFrame:
    """Rows (kind, text, place): n distinct labels in hash order, and phrases of held-out rows, at most `most` a source, each
    text once at its first place."""
    labels = rows.select(F.col(label).alias("text")).where("text <> ''").distinct().orderBy(uniform(seed, F.col("text")), "text").limit(n)
    order = Window.partitionBy(source).orderBy(uniform(f"{seed}-held", F.col(key)), key)
    some = rows.where(held & (F.col(phrase) != "")).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    phrases = some.groupBy(F.col(phrase).alias("text")).agg(F.min(F.struct(F.col(source).cast("string").alias("s"), F.col("_r").alias("r"))).alias("_f"))
    first = Window.orderBy(uniform(seed, F.col("text")), "text")  # over n rows
    return labels.select(F.lit("label").alias("kind"), "text", F.row_number().over(first).cast("string").alias("place")).unionByName(
        phrases.select(F.lit("phrase").alias("kind"), "text", F.concat_ws("/", F.col("_f.s"), F.col("_f.r").cast("string")).alias("place")))


def contexts(words: DataFrame, writer: str, key: str, counts: tuple[int, ...], seed: str = "context", fits: tuple[str, str, int, int] | None = None) -> DataFrame:
    """Rows (k, target, context): for each word the first k other words of its writer in the writer's hash order.

    `fits` names a column of tokens counted and of bytes, with the block and the bytes they must fit into: targets stay
    whose largest context fits with them, two tokens and a space between words.

    A writer's order is the same for all targets, so the k + 1 first words of a writer serve every target: those joined
    are bounded, and no writer's words are joined with each other.
    """
    most = max(counts)
    order = Window.partitionBy(writer).orderBy(uniform(seed, F.col(key)), key)
    tokens, size = (F.col(c) for c in fits[:2]) if fits else (F.lit(0), F.lit(0))
    sized = words.select(writer, key, tokens.alias("_t"), size.alias("_b"))
    ranked = sized.withColumn("_r", F.row_number().over(order))
    first = ranked.where(F.col("_r") <= most + 1).groupBy(writer).agg(F.sort_array(F.collect_list(F.struct("_r", F.col(key).alias("k"), F.col("_t").alias("t"), F.col("_b").alias("b")))).alias("_f"))
    known = F.filter("_f", lambda x: x["k"] != F.col("target"))
    others = F.transform(known, lambda x: x["k"])
    got = sized.withColumnRenamed(key, "target").join(first, writer).where(F.size(others) >= most)
    if fits:
        summed = lambda c: F.aggregate(F.slice(known, 1, most), F.lit(0), lambda a, x: a + x[c].cast("int"))
        got = got.where((F.col("_t") + summed("t") + 2 * most <= fits[2] - 2) & (F.col("_b") + summed("b") + most <= fits[3]))
    return got.select("target", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.slice(others, F.lit(1), F.lit(k)).alias("context")) for k in counts])).alias("c")).select("target", "c.*")


def anonymised(rows: DataFrame, key: str, seed: str = "anonymous") -> DataFrame:
    """Rows (key, new): fresh numbers in hash order."""
    keys = rows.select(key).distinct().withColumn("_u", uniform(seed, F.col(key)))
    return numbered(keys, [F.col("_u"), F.col(key)], "_i").select(key, (F.col("_i") + 1).cast("int").alias("new"))


def greedy_within(items: Column, budget: int, most: int) -> Column:
    """From an ordered array of structs (size, key): keys that fit a budget, skipping those that do not."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("keys"))

    def put(a, x):
        fits = (a["used"] + x["size"] <= budget) & (F.size(a["keys"]) < most)
        return F.struct(F.when(fits, a["used"] + x["size"]).otherwise(a["used"]).alias("used"), F.when(fits, F.concat(a["keys"], F.array(x["key"]))).otherwise(a["keys"]).alias("keys"))

    return F.aggregate(items, start, put, lambda a: a["keys"])


def primers(words: DataFrame, writer: str, key: str, size: str, budget: int, most: int, seed: str = "primer", long: int = 5) -> DataFrame:
    """Rows (writer, primers): a writer's words, those of `long` and more first, then by hash, each taken that still fits.

    What is used only grows, so a word that does not fit bars later ones of its size: of each size the first `most` words
    decide, and a writer's list holds `most` a size up to the budget, however many words there are.
    """
    item = F.struct((-F.least(F.col(size), F.lit(long))).alias("a"), uniform(seed, F.col(key)).alias("u"), F.col(key).alias("key"), F.col(size).alias("size"))
    order = Window.partitionBy(writer, size).orderBy("w")
    fit = words.select(writer, F.col(size), item.alias("w")).where(F.col(size) <= budget)
    fit = fit.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).groupBy(writer).agg(F.sort_array(F.collect_list("w")).alias("w"))
    writers = words.groupBy(F.col(writer).alias("_w")).agg(F.count("*").alias("_n"))
    met = writers.join(fit, F.col("_w").eqNullSafe(F.col(writer)), "left")
    return met.select(F.col("_w").alias(writer), F.coalesce(greedy_within(F.col("w"), budget, most), F.array().cast("array<string>")).alias("primers"))


def all_prompts(examples: DataFrame, prompts: DataFrame, most: int = blocks.MOST_ROWS) -> DataFrame:
    """Each example under every prompt of a list; beyond `most` prompts in blocks."""
    return blocks.all_pairs(examples, prompts, most)
