"""Line dedup by a deletion-neighbourhood join (DataFrame functions only).

A line is its sequence of words; the edit bound is one word inserted, deleted or replaced. Equal lines collapse to one
distinct line with its earliest place (doc_id, line number). For the others, every variant with one word deleted is
emitted as a hashed key; lines with a common key are joined through the earliest line of the key, never in pairs:

* a key of (words, position of the deleted word, hash of the rest) joins lines that differ in that word alone, so all
  lines of such a key are within the bound of each other;
* a key of the hash of the rest joins a line to the lines that have one word more.

Each joined pair is verified on its words. A line is dropped if an earlier line is equal to it or within the bound.
The edit bound is a function of a line's length, the words of the shorter line div `min_words`, one at most: short lines
("Part one", "Part two") differ in a word because they say something else, so below `min_words` words the bound is zero,
and equal lines alone are joined. Before variants are made, lines that cannot have a
partner are set aside without loss: of two lines within the bound, the first or the last c = (t - 1) div 2 words are
equal, t being the words of the shorter. A line with no such half in common with another line emits no variants, and
one with a common first half emits those of words after it alone (likewise for a common last half).

Lines are named by two 64-bit hashes; texts are read again where words are needed.

Defined cases: null texts and lines without words are left as they are; rows that share a doc_id share their places, so
equal lines at the same place are all kept; null doc_ids come first; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strokelake.llm.common import SPACE, TRIM, let, small_or_plain, written

MIN_WORDS = 8
BROADCAST_ROWS = 200_000
BROADCAST_LINES = 1_000_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _place(doc_id: str = "doc_id", line: str = "line") -> Column:
    return F.struct(F.col(doc_id).alias("doc_id"), F.col(line).alias("line"))


def line_words(t: Column) -> Column:
    """Words of a line with a word in it. Plain spacing, the usual case, is split without a pattern."""
    plain = t == F.btrim(t, F.lit(TRIM))
    for odd in ("  ", "\t", "\r", "\x0b", "\x0c"):
        plain = plain & ~F.contains(t, F.lit(odd))
    return F.when(plain, F.split(t, " ")).otherwise(F.split(F.btrim(t, F.lit(TRIM)), SPACE))


def _named(w: Column) -> tuple[Column, Column]:
    return F.xxhash64(w), F.xxhash64(F.lit("line"), w)


def line_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, line, n, h, h2, keys): one per line with a word; texts are not kept.

    keys: (c, hash) of the first c words and (-c, hash) of the last c, for every c a partner may share.
    """
    each = docs.select("doc_id", F.posexplode(_lines(F.col("text"))).alias("line", "t")).where(F.btrim("t", F.lit(TRIM)) != "")
    each = each.select("doc_id", "line", F.explode(F.array(line_words(F.col("t")))).alias("w"))  # a generator, so that words are split once
    w, n = F.col("w"), F.size("w")
    h, h2 = _named(w)
    long, short = F.floor((n - 1) / 2).cast("int"), F.floor((n - 2) / 2).cast("int")

    def halves(c: Column) -> list[Column]:
        return [F.struct(c.alias("c"), F.xxhash64(c, F.slice(w, F.lit(1), c)).alias("k")), F.struct((-c).alias("c"), F.xxhash64(-c, F.slice(w, n - c + 1, c)).alias("k"))]

    keys = F.when(n >= min_words, F.when(long == short, F.array(*halves(long))).otherwise(F.array(*halves(long), *halves(short))))
    return each.select("doc_id", "line", n.alias("n"), h.alias("h"), h2.alias("h2"), keys.alias("keys"))


def one_word_apart(a: Column, b: Column) -> Column:
    """Whether two word arrays are equal or one word insertion, deletion or replacement apart."""

    def check(long: Column, short: Column) -> Column:
        # p: words before the first difference
        first = F.array_position(F.zip_with(F.slice(long, F.lit(1), F.size(short)), short, lambda x, y: x == y), False).cast("int")
        p = F.when(first == 0, F.size(short)).otherwise(first - 1)
        more = F.size(long) - F.size(short)

        def tail(x: Column, start: Column) -> Column:
            return F.slice(x, start, F.greatest(F.lit(0), F.size(x) - start + 1))

        return let(p, lambda q: (more <= 1) & (tail(long, q + 2) == tail(short, q + 2 - more)))

    return F.when(F.size(a) >= F.size(b), check(a, b)).otherwise(check(b, a))


def likely_lines(lines: DataFrame) -> DataFrame:
    """Rows (h, h2, first, low, high): lines that share a half with another, and the places low .. high - 1 where they
    may differ from a partner, counted in the longer of two lines."""
    keyed = lines.where("keys IS NOT NULL").select("h", "h2", "doc_id", "line", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy(F.col("key.k").alias("k")).agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("k")
    shared = small_or_plain(written(shared, "lines-halves"), BROADCAST_ROWS)
    met = keyed.join(shared, F.col("key.k") == F.col("k"), "left_semi").withColumn("c", F.col("key.c"))
    low = F.coalesce(F.min(F.when(F.col("c") >= 0, F.col("c"))), F.lit(1 << 30))
    back = F.coalesce(F.min(F.when(F.col("c") <= 0, -F.col("c"))), F.lit(1 << 30))
    found = met.groupBy("h", "h2", "n").agg(F.min(_place()).alias("first"), low.alias("low"), back.alias("back"))
    # a common first half alone: from its end on; a common last half alone: up to its start; both: anywhere
    both = (F.col("low") < 1 << 30) & (F.col("back") < 1 << 30)
    return found.select("h", "h2", "first", F.when(both | (F.col("low") == 1 << 30), 0).otherwise(F.col("low")).alias("low"),
                        F.when(both | (F.col("back") == 1 << 30), F.col("n")).otherwise(F.col("n") - F.col("back")).alias("high"))


def lines_with_words(docs: DataFrame, likely: DataFrame) -> DataFrame:
    """The likely lines with their words, from their first places."""
    wanted = likely.groupBy(F.col("first.doc_id").alias("wanted_doc")).agg(F.collect_list(F.struct("h", "h2", F.col("first.line").alias("line"), "low", "high")).alias("wanted"))
    wanted = small_or_plain(written(wanted, "lines-wanted"), BROADCAST_ROWS) if likely.count() <= BROADCAST_LINES else wanted
    found = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_doc")))
    picked = let(_lines(F.col("text")), lambda t: F.transform("wanted", lambda x: F.struct(
        x["h"].alias("h"), x["h2"].alias("h2"), F.struct(F.col("doc_id").alias("doc_id"), x["line"].alias("line")).alias("first"), x["low"].alias("low"), x["high"].alias("high"),
        F.get(t, x["line"]).alias("t"))))
    rows = found.select(F.inline(picked)).where("t IS NOT NULL").withColumn("words", line_words(F.col("t")))
    # rows that share a doc_id may hold another line at that place
    rows = rows.where((F.xxhash64("words") == F.col("h")) & (F.xxhash64(F.lit("line"), "words") == F.col("h2"))).groupBy("h", "h2").agg(F.first(F.struct("first", "low", "high", "words")).alias("r"))
    return rows.select("h", "h2", "r.*", F.size("r.words").alias("n"))


def near_lines(lines: DataFrame, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (h, h2) of the distinct lines with an earlier line within the bound."""
    cand = written(lines_with_words(docs, written(likely_lines(lines), "lines-likely")), "lines-candidates")

    at = Window.partitionBy("h", "h2")
    before = at.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    upto = at.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = cand.select("h", "h2", "first", "n", "low", "high", F.posexplode("words").alias("pos", "word"))
    w = w.select("h", "h2", "first", "n", "low", "high", "pos", F.xxhash64("word", "pos").alias("here"), F.xxhash64("word", F.col("pos") - 1).alias("moved"))
    zero = F.lit(0).cast("long")
    w = w.withColumns({"all": F.bit_xor("here").over(at), "head": F.coalesce(F.bit_xor("here").over(before), zero),
                       "tail": F.bit_xor("moved").over(at).bitwiseXOR(F.bit_xor("moved").over(upto))})
    inside = F.col("pos").between(F.col("low"), F.col("high") - 1)
    replaced = F.when(inside, F.xxhash64(F.lit("r"), "n", "pos", F.col("all").bitwiseXOR(F.col("here"))))
    deleted = F.when(inside & (F.col("n") > min_words), F.xxhash64(F.lit("d"), F.col("n") - 1, F.col("head").bitwiseXOR(F.col("tail"))))
    full = F.when(F.col("pos") == 0, F.xxhash64(F.lit("d"), "n", F.col("all")))
    emitted = F.array(F.struct(replaced.alias("key"), F.lit("r").alias("role")), F.struct(deleted.alias("key"), F.lit("d").alias("role")),
                      F.struct(full.alias("key"), F.lit("f").alias("role")))
    variants = w.select("h", "h2", "first", F.inline(emitted)).where("key IS NOT NULL")
    variants = written(variants, "lines-variants")
    met = written(variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "lines-met")
    variants = written(variants.join(small_or_plain(met, BROADCAST_ROWS), "key", "left_semi"), "lines-joined")
    line = F.struct("first", "h", "h2")
    least = variants.groupBy("key").agg(F.min(F.when(F.col("role") != "f", line)).alias("least"), F.min(F.when(F.col("role") == "f", line)).alias("whole"))
    partner = F.when(F.col("role") == "d", F.col("whole")).otherwise(F.col("least"))
    pairs = variants.join(least, "key").withColumn("partner", partner).where("partner.first < first")
    pairs = pairs.select("h", "h2", F.col("partner.h").alias("ph"), F.col("partner.h2").alias("ph2")).distinct()
    other = cand.select(F.col("h").alias("ph"), F.col("h2").alias("ph2"), F.col("words").alias("partner_words"))
    near = pairs.join(cand.select("h", "h2", "words"), ["h", "h2"]).join(other, ["ph", "ph2"]).where(one_word_apart(F.col("words"), F.col("partner_words")))
    return near.select("h", "h2").distinct()


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, lines, equal): per document the numbers of its dropped lines, and how many equal an earlier line."""
    lines = written(line_table(docs, min_words), "lines")
    near = near_lines(lines, docs, min_words).select("h", "h2", F.lit(None).cast(lines.select(_place().alias("p")).schema["p"].dataType).alias("first"), F.lit(True).alias("near"))
    again = lines.groupBy("h", "h2").agg(F.min(_place()).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "h2", "first", F.lit(False).alias("near"))
    marked = again.unionByName(near).groupBy("h", "h2").agg(F.max("first").alias("first"), F.max("near").alias("near"))
    marked = small_or_plain(written(marked, "lines-marked"), BROADCAST_ROWS)
    placed = lines.select("doc_id", "line", "h", "h2").join(marked, ["h", "h2"])
    equal = F.col("first").isNotNull() & ~_place().eqNullSafe(F.col("first"))
    return (placed.withColumn("equal", equal).where("near OR equal").groupBy("doc_id")
            .agg(F.collect_set("line").alias("lines"), F.sum(F.col("equal").cast("long")).alias("equal")))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (row, kept_text, n_lines, n_dropped, n_equal): the input row, and its text without the dropped lines."""
    gone = written(dropped_lines(docs, min_words).select(F.col("doc_id").alias("gone_doc"), F.col("lines").alias("gone"), "equal"), "lines-gone")
    if (gone.agg(F.sum(F.size("gone"))).first()[0] or 0) <= BROADCAST_LINES:
        gone = small_or_plain(gone, BROADCAST_ROWS)
    rows = docs.select(F.struct(*docs.columns).alias("row")).join(gone, F.col("row.doc_id").eqNullSafe(F.col("gone_doc")), "left")

    def rest(t: Column) -> Column:
        keep = F.array_except(F.sequence(F.lit(0), F.size(t) - 1), F.col("gone"))
        return F.array_join(F.transform(keep, lambda i: F.get(t, i)), "\n")

    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(let(_lines(F.col("row.text")), rest))
    n = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(_lines(F.col("row.text")))).cast("long")
    zero = F.lit(0).cast("long")
    return rows.select("row", text.alias("kept_text"), n.alias("n_lines"), F.coalesce(F.size("gone").cast("long"), zero).alias("n_dropped"),
                       F.coalesce("equal", zero).alias("n_equal"))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The input with dropped lines taken out of `text`; a document whose every line with a word was dropped goes."""
    out = dedup_lines(docs, min_words).where((F.col("n_dropped") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[(changed[c] if c in changed else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
