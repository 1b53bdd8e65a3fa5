"""N-gram Jaccard join by grouped prefixes.

A document's set holds its distinct word shingles (hashed to 64 bits). Two sets link if `q * |A and B| >= p * |A or B|`.

1. Equal sets collapse to one class.
2. Tokens are ordered rarest first, and linked sets share a token among their first n - ceil(p n / q) + 1. It is enough to
   order a part of the hash space, the same part for all: a set keeps that guarantee there as long as it has more tokens
   in it than it may lose, n - ceil(p n / q). Sets that have fewer (small ones) are ordered a second time over all their
   tokens, in a key space of their own, where any two of them meet.
3. Tokens that occur once take their place in a prefix but are no keys, nor in the part of the hash space are tokens of
   more than `LIGHT` sets. If the first common token of two linked sets is so frequent, it lies in both their prefixes;
   so all sets with such a token in their prefix are ordered anew over all their tokens, in a third key space, where
   their own rare tokens fill the prefixes and a passage that thousands of texts share does not.
   Classes with equal prefix and size form one group.
4. Groups meet on prefix tokens, and the size, position and sketch filters drop pairs. First each group meets only the hub of
   the token it shares most with, and members their group's leader; pairs are verified on the whole sets and links
   joined to components. Then, for tokens whose groups still lie in several components, groups are expanded and all
   pairs across components are filtered and verified. Pairs inside a component are never made, so no group is expanded
   into all its pairs and no link between components is lost.

Defined cases: null, empty and word-free texts have the empty set and link with nothing; texts shorter than a shingle
have their whole word sequence as the one shingle; rows with a null doc_id are returned with a null component and do not
link; rows that share a doc_id are compared like any others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strokelake.llm.common import emptied, small_or_plain, written

CACHE_WORDS = 300_000
BROADCAST_DOCS = 200_000
SKETCH_BITS = 1024
LIGHT = 500
U = np.uint64


class WordHash(dict):
    """64-bit hashes of words as bytes, found once per word and worker."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_digest(word)
        return found


_hashes = WordHash()


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, A-Z lower-cased, words parted by ASCII white space."""
    found = (text or "").encode().lower().split()  # bytes: only A-Z change and only ASCII space parts
    if not found:
        return np.empty(0, U)
    h = np.frombuffer(b"".join(map(_hashes.__getitem__, found)), "<u8")
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(width, len(h)), U)
    for i in range(min(width, len(h))):
        out = _stir(out * U(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def universe(p: int, q: int) -> float:
    """The share of the hash space that is ordered: it grows with what linked sets may lose."""
    return min(1.0, 0.05 + 2 * (1 - p / q))


def spaces(tokens: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray | None]:
    """The tokens to order: those in the common part of the hash space, and for sets with too few there all. The last two
    bits tell the key spaces apart."""
    some = tokens[: np.searchsorted(tokens, U(min(int(universe(p, q) * 2**64), 2**64 - 1)), "right")]
    few = len(some) <= len(tokens) - -(-p * len(tokens) // q)
    return some & ~U(3), tokens & ~U(3) | U(1) if few else None


def told_apart(classes: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function on rows (sid, sid2, ..) that gives classes which share the first 64 bits of their id new ones.

    Among n classes about n * n / 2**65 pairs do: none in most tables, some hundred in the largest.
    """
    shared = classes.groupBy("sid").agg(F.count("*").alias("k")).where("k > 1").select("sid")
    again = written(classes.join(shared, "sid", "left_semi").select(F.col("sid").alias("_s"), F.col("sid2").alias("_s2"), F.xxhash64("sid", "sid2").alias("_new")), "clashes")
    if again.isEmpty():
        return lambda rows: rows

    def renamed(rows: DataFrame) -> DataFrame:
        met = rows.join(small_or_plain(again, BROADCAST_DOCS), (F.col("sid") == F.col("_s")) & (F.col("sid2") == F.col("_s2")), "left")
        return met.withColumn("sid", F.coalesce("_new", "sid")).drop("_s", "_s2", "_new")

    return renamed


def set_id(tokens: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), "<i8").tolist()
    return a, b


def shingled(docs: DataFrame, width: int, p: int, q: int) -> DataFrame:
    """Rows (doc_id, n, sid, sid2, some, whole): set size, 128-bit set id and the tokens to order (see `spaces`)."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py(), width) for text in batch.column(1)]
            ids = [set_id(s) for s in sets]
            parts = [spaces(s, p, q) for s in sets]
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([i for i, _ in ids], pa.int64()), pa.array([j for _, j in ids], pa.int64()),
                       pa.array([some.view(np.int64) for some, _ in parts], pa.list_(pa.int64())), pa.array([None if whole is None else whole.view(np.int64) for _, whole in parts], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "sid", "sid2", "some", "whole"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(describe, f"doc_id {kind}, n int, sid bigint, sid2 bigint, some array<bigint>, whole array<bigint>")


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """Whether each of SKETCH_BITS buckets holds an odd number of tokens, as 64-bit words. Two sketches differ in at most
    as many bits as the sets differ in tokens, since tokens of both cancel out."""
    odd = np.bincount((tokens >> U(20)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """Rows (sid, sid2, n, tokens, sketch) of documents."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py(), width) for text in batch.column(0)]
            ids = [set_id(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in ids], pa.int64()), pa.array([j for _, j in ids], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                                              pa.array([parity_sketch(s) for s in sets], pa.list_(pa.int64()))], names=["sid", "sid2", "n", "tokens", "sketch"])

    return docs.select(F.col("text").cast("string")).mapInArrow(describe, "sid bigint, sid2 bigint, n int, tokens array<bigint>, sketch array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """Rows (v, c): c the least node reachable over edges (a, b). Least labels spread to neighbours and skip ahead to
    their label's label, so the rounds grow with the logarithm of the longest path."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("a"), F.min("b")).alias("c")), "labels")
    while True:
        heard = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("c").alias("heard"))
        new = labels.join(heard, labels["v"] == heard["a"]).select("v", F.col("c").alias("old"), F.least("c", "heard").alias("c"))
        new = written(new, "labels")
        ahead = new.select(F.col("v").alias("at"), F.col("c").alias("further"))
        new = written(new.join(ahead, new["c"] == ahead["at"], "left").select("v", "old", F.least("c", "further").alias("c")), "labels")
        labels = new.select("v", "c")
        if new.where("c <> old").isEmpty():
            return labels


def _similar_sizes(p: int, q: int, a: str, b: str) -> Column:
    return (q * F.least(a, b)) >= (p * F.greatest(a, b))


def _can_meet(p: int, q: int, a: str, at_a: str, sketch_a: str, b: str, at_b: str, sketch_b: str) -> Column:
    """Size, position and sketch filters on a pair's first common token.

    Linked sets have at least `needed` tokens in common. All tokens before the first common one are in one set alone, so
    neither set has more of them than it can lose; and the sketches differ in no more bits than the sets in tokens.
    """
    needed = F.ceil(p * (F.col(a) + F.col(b)) / (p + q))
    differ = F.aggregate(F.zip_with(sketch_a, sketch_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (_similar_sizes(p, q, a, b) & (F.col(at_a) <= F.col(a) - needed) & (F.col(at_b) <= F.col(b) - needed)
            & (differ <= F.col(a) + F.col(b) - 2 * needed))


def verified(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs (a, b) of set ids that link, checked on the whole sets."""
    left = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(left, "a").join(right, "b").where(q * both >= p * (F.size("ta") + F.size("tb") - both)).select("a", "b")


def prefixes(tokens: DataFrame, p: int, q: int) -> DataFrame:
    """Rows (sid, n, once, keys): prefixes in order of rarity; `once` counts their tokens that no other set has, `keys`
    are the others with their counts.

    From rows (sid, n, all), `all` the tokens of a set to order.
    """
    each = tokens.select("sid", F.explode("all").alias("t"))
    often = tokens.select(F.explode("all").alias("t")).groupBy("t").agg(F.count("*").alias("f")).where("f > 1")
    space = F.col("t").bitwiseAND(F.lit(3))
    ranked = each.join(often, "t").groupBy("sid", space.alias("space")).agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("ft"))
    sizes = tokens.select("sid", F.get("all", F.lit(0)).bitwiseAND(F.lit(3)).alias("space"), "n", F.size("all").alias("m"))
    ranked = ranked.join(sizes, ["sid", "space"])
    length = F.col("n") - F.ceil(p * F.col("n") / q).cast("int") + 1
    once = F.col("m") - F.size("ft")
    keys = F.slice("ft", F.lit(1), F.greatest(F.lit(0), length - once))
    return ranked.select("sid", "n", once.alias("once"), keys.alias("keys")).where("size(keys) > 0")


def linked(pre: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """Links (a, b) whose components are the components of all links."""
    pre = pre.join(sets.select("sid", "sketch"), "sid").withColumn("gid", F.xxhash64("n", "once", "keys"))
    pre = written(pre, "prefixes")
    groups = pre.groupBy("gid").agg(F.min_by(F.struct("sid", "sketch"), "sid").alias("lead"), F.first("n").alias("n"), F.first("once").alias("once"), F.first("keys").alias("keys"))
    groups = groups.select("gid", "n", "once", "keys", F.col("lead.sid").alias("leader"), "lead.sketch")
    keyed = written(groups.select("gid", "leader", "n", "once", "sketch", F.posexplode("keys").alias("i", "t")).withColumn("at", F.col("once") + F.col("i")), "group-keys")

    # each group with the hub of the key they share most of: the group with the fewest tokens of its own
    hubs = keyed.groupBy("t").agg(F.min(F.struct("once", "leader", "gid", "n", "at", "sketch")).alias("hub"), F.count("*").alias("n_groups")).where("n_groups > 1")
    met = keyed.join(hubs.select("t", "hub"), "t").where("gid <> hub.gid").withColumns({"hn": F.col("hub.n"), "hat": F.col("hub.at"), "hs": F.col("hub.sketch")})
    met = met.where(_can_meet(p, q, "n", "at", "sketch", "hn", "hat", "hs")).groupBy("leader", F.col("hub.leader").alias("other")).agg(F.count("*").alias("shared"))
    best = met.groupBy("leader").agg(F.max_by("other", F.struct("shared", "other")).alias("other"))
    members = pre.select("gid", "sid").join(groups.select("gid", "leader"), "gid").where("sid <> leader")
    pairs = best.select(F.col("leader").alias("a"), F.col("other").alias("b")).union(members.select("sid", "leader"))
    links = written(verified(pairs.distinct(), sets, p, q), "links")

    # what is left: pairs of members on keys whose groups lie in several components
    labels = components(links)
    rows = pre.select("sid", "n", "once", "sketch", F.posexplode("keys").alias("i", "t")).join(labels, F.col("sid") == F.col("v"), "left")
    rows = written(rows.select("t", "sid", "n", "sketch", (F.col("once") + F.col("i")).alias("at"), F.coalesce("c", "sid").alias("c")), "member-keys")
    sizes = rows.groupBy("t", "c").agg(F.count("*").alias("size"))
    main = sizes.groupBy("t").agg(F.max_by("c", F.struct("size", "c")).alias("main"), F.count("*").alias("n_c")).where("n_c > 1").select("t", "main")
    rest = rows.join(main, "t")
    small = rest.where("c <> main").select("t", F.col("sid").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"), F.col("sketch").alias("sa"), F.col("c").alias("ca"), "main")
    other = rest.select(F.col("t").alias("t2"), F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"), F.col("sketch").alias("sb"), F.col("c").alias("cb"))
    across = small.join(other, (F.col("t") == F.col("t2")) & (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b")))
                        & _can_meet(p, q, "na", "pa", "sa", "nb", "pb", "sb"))
    more = verified(across.select("a", "b").distinct(), sets, p, q)
    return links.union(written(more, "links"))


def labelled(docs: DataFrame, width: int, p: int, q: int) -> DataFrame:
    """Rows (doc_id, n, sid, sid2, component_id), one per input row."""
    raw = written(shingled(docs, width, p, q), "sets")
    classes = written(raw.where("n > 0 AND doc_id IS NOT NULL").groupBy("sid", "sid2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "classes")
    apart = told_apart(classes)
    classes, made = apart(classes), apart(raw.withColumn("sid1", F.col("sid")))
    slim = made.select("doc_id", "n", "sid", "sid1", "sid2")
    # of equal sets, those of other documents than the first go; a first document may still be there in several rows
    copies = slim.where("n > 0").join(classes.where("copies > 1").select("sid", "sid2", "first"), ["sid", "sid2"]).where("doc_id <> first").select(F.col("doc_id").alias("d"), F.col("sid").alias("s")).distinct()
    copies = small_or_plain(written(copies, "copies"), BROADCAST_DOCS)
    own = made.where("n > 0 AND doc_id IS NOT NULL").join(copies, (F.col("doc_id") == F.col("d")) & (F.col("sid") == F.col("s")), "left_anti")
    if repeats_doc_ids(slim):
        own = own.groupBy("sid", "n").agg(F.first("some").alias("some"), F.first("whole").alias("whole"))
    tokens = own.select("sid", "n", F.explode(F.array("some", "whole")).alias("all")).where("size(all) > 0")
    pre = written(prefixes(tokens, p, q), "all-prefixes")
    slim = written(slim, "slim-sets")
    emptied(raw)

    def chosen(some: DataFrame) -> DataFrame:
        """Sets (sid, n, tokens, sketch) of the classes in `some` (sid), from their first documents' texts."""
        wanted = written(classes.join(some, "sid", "left_semi").select(F.col("first").alias("wanted"), F.col("sid").alias("wanted_sid")), "wanted")
        texts = docs.select("doc_id", "text").join(small_or_plain(wanted.select("wanted").distinct(), BROADCAST_DOCS), F.col("doc_id") == F.col("wanted"), "left_semi")
        sets = apart(sets_of(texts, width)).drop("sid2").join(small_or_plain(wanted.select("wanted_sid"), BROADCAST_DOCS), F.col("sid") == F.col("wanted_sid"), "left_semi")
        sets = written(sets, "wanted-sets")
        if sets.count() > wanted.count():  # rows that share a doc_id
            sets = written(sets.groupBy("sid").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch")), "wanted-sets")
        return sets

    # sets whose prefix in the common part holds a frequent token
    common = F.col("keys")[0]["t"].bitwiseAND(F.lit(3)) == 0
    poor = written(pre.where(common & (F.element_at("keys", -1)["f"] > LIGHT)).select("sid"), "poor")
    light = F.when(common, F.filter("keys", lambda k: k["f"] <= LIGHT)).otherwise(F.col("keys"))
    plain = pre.select("sid", "n", "once", F.transform(light, lambda k: k["t"]).alias("keys")).where("size(keys) > 0")
    if not poor.isEmpty():
        third = F.transform("tokens", lambda t: t.bitwiseAND(F.lit(-4)).bitwiseOR(F.lit(2)))
        anew = written(prefixes(chosen(poor).select("sid", "n", third.alias("all")), p, q), "poor-prefixes")
        plain = plain.union(anew.select("sid", "n", "once", F.transform("keys", lambda k: k["t"]).alias("keys")))
    keys = plain.select("sid", F.explode("keys").alias("t"))
    shared = keys.groupBy("t").agg(F.min("sid").alias("a"), F.max("sid").alias("b")).where("a <> b").select("t")
    met = written(keys.join(shared, "t", "left_semi").select("sid").distinct(), "met")
    labels = written(components(linked(plain, chosen(met), p, q)), "component-labels")
    named = classes.join(labels, F.col("sid") == F.col("v"), "left").withColumn("c", F.coalesce("c", "sid"))
    least = named.groupBy("c").agg(F.min("first").alias("component"))
    named = named.select("sid", "sid2", "c").join(least, "c").select(F.col("sid").alias("s"), F.col("sid2").alias("s2"), "component")
    named = written(named, "class-components")
    out = slim.join(named, (F.col("sid") == F.col("s")) & (F.col("sid2") == F.col("s2")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("doc_id")))
    return out.select("doc_id", "n", F.col("sid1").alias("sid"), "sid2", component.alias("component_id"))


def repeats_doc_ids(rows: DataFrame) -> bool:
    return not rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty()


def jaccard_components(docs: DataFrame, width: int = 3, p: int = 9, q: int = 10) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one per input row."""
    return labelled(docs, width, p, q).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def one_per_group(docs: DataFrame, width: int = 5, p: int = 8, q: int = 10) -> DataFrame:
    """The input rows without those that belong to a component of a smaller doc_id. Rows that share the least doc_id of
    a component stay once. Rows without words or without a doc_id all stay."""
    rows = labelled(docs, width, p, q)
    if not repeats_doc_ids(docs):
        gone = written(rows.where("component_id < doc_id").select("doc_id"), "near-copies")
        return docs.join(small_or_plain(gone, BROADCAST_DOCS), "doc_id", "left_anti").select(*docs.columns)
    named = written(rows.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "sid", "sid2", "component_id").distinct(), "set-components")
    first = Window.partitionBy("component_id").orderBy("sid", "sid2")
    stays = named.where("component_id = doc_id").withColumn("r", F.row_number().over(first)).where("r = 1").select(F.col("doc_id").alias("d"), F.col("sid").alias("s"), F.col("sid2").alias("s2"))
    ids = with_set_ids(docs, width)
    bare = ids.where("sid IS NULL OR row.doc_id IS NULL")
    once = Window.partitionBy("d", "s", "s2").orderBy(F.xxhash64("row"))
    kept = ids.join(stays, (F.col("row.doc_id") == F.col("d")) & (F.col("sid") == F.col("s")) & (F.col("sid2") == F.col("s2"))).withColumn("r", F.row_number().over(once)).where("r = 1")
    return bare.select("row.*").unionByName(kept.select("row.*"))


def with_set_ids(docs: DataFrame, width: int) -> DataFrame:
    """Rows (row, sid, sid2): the input rows with their set ids, null for empty sets."""

    @F.pandas_udf("sid bigint, sid2 bigint")
    def ids(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, width) for t in texts]
        return pd.DataFrame([set_id(s) if len(s) else (None, None) for s in sets], columns=["sid", "sid2"], dtype="Int64")

    return docs.select(F.struct(*docs.columns).alias("row"), ids(F.col("text").cast("string")).alias("i")).select("row", "i.sid", "i.sid2")
