"""WARC records and a Merkle fixity audit of replicas.

Rows become WARC response records; records are laid one after the other into files, so each has an ordered offset range.
Every record is hashed over its bytes, and a tree over each file hashes runs of children with their lengths, in order of
offset. A run ends after a child whose hash says so, about every `FAN`-th, so a record that is lost or added changes the
nodes above it alone and not those of all records behind it. Two replicas are compared from the roots down, matching nodes
of a file by hash: only children of nodes without a match are read on, so intact files cost one comparison. What matches is
laid in order on both sides, so records that changed places are reported too.

Equal records of a page are one leaf with a number of copies, and a file that has more than `MOST_RECORDS` different records on
either side (a page_id that repeats) is cut into volumes by hash, each with offsets and a tree of its own: so no task sorts,
and no node holds, more than some thousands of records.

Defined cases: null html is an empty payload and a null url an empty target; rows with null page_id are spread over files
of their own by hash; repeated rows are separate records, ordered by their hash, and as many of them match as both
replicas have at the same page; a record that one replica lacks is reported alone, and those behind it have not moved; records
that only changed places within a file are intact and moved; very long records are hashed as they are; an empty table gives
no files; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strokelake.llm.common import small_or_plain, written

FAN = 16
RECORDS_PER_FILE = 1000
MOST_RECORDS = 4000
VOLUME = ("file_id", "volume")


def record_bytes(url: Column, payload: Column, name: Column) -> Column:
    """A WARC/1.1 response record. The record id is made from the name."""
    body = F.coalesce(payload, F.lit("")).cast("binary")
    digest = F.md5(F.coalesce(name.cast("string"), F.lit("")).cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def records(pages: DataFrame, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Rows (file_id, page_id, record binary)."""
    spread = F.pmod(F.xxhash64("url", "html"), F.lit(1 << 20)).cast("long")
    file_id = F.coalesce(F.floor(F.col("page_id") / per_file), -1 - spread).cast("long")
    return pages.select(file_id.alias("file_id"), "page_id", record_bytes(F.col("url"), F.col("html"), F.col("page_id")).alias("record"))


def parse_records(files: DataFrame) -> DataFrame:
    """Rows (path, offset, length, url, payload) from rows (path, content) as `binaryFile` reads them; the inverse of `records`."""
    head = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.DOTALL)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, at = [], 0
                while content and (found := head.match(content, at)):
                    fields = dict(line.split(b": ", 1) for line in found[1].split(b"\r\n") if b": " in line)
                    end = found.end() + int(fields.get(b"Content-Length", b"0"))
                    rows.append((path, at, end + 4 - at, fields.get(b"WARC-Target-URI", b"").decode(), content[found.end() : end].decode("utf-8", "replace")))
                    at = end + 4
                yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(("path", "offset", "length", "url", "payload"))},
                                                 schema=pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("payload", pa.string())]))

    return files.select(F.col("path").cast("string"), "content").mapInArrow(parse, "path string, offset bigint, length bigint, url string, payload string")


def grouped(found: DataFrame) -> DataFrame:
    """Rows (file_id, page_id, length, hash, copies): equal records of a page are counted together before the shuffle."""
    hashed = found.select("file_id", "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("hash"))
    return hashed.groupBy("file_id", "page_id", "length", "hash").agg(F.count("*").alias("copies"))


def volumes(sizes: DataFrame, most: int, per_file: int) -> DataFrame:
    """Rows (file_id, parts) of the files with more than `most` different records on either side of rows (side, file_id, n)."""
    over = sizes.groupBy("file_id").agg(F.max("n").alias("n")).where(F.col("n") > most)
    return over.select("file_id", F.ceil(F.col("n") / per_file).alias("parts"))


def placed(groups: DataFrame, most: int = MOST_RECORDS, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Rows (side, file_id, volume, place, page_id, offset, length, copies, hash) of written rows (side, file_id, page_id,
    length, hash, copies): the range of each record, or run of equal ones, in order of page_id and hash within its volume."""
    sizes = groups.groupBy("side", "file_id").agg(F.count("*").alias("n"))
    cut = small_or_plain(written(volumes(sizes, most, per_file), "volumes"), 100_000)
    volume = F.when(F.col("parts").isNull(), 0).otherwise(F.conv(F.substring("hash", 9, 8), 16, 10).cast("long") % F.col("parts")).cast("int")
    order = Window.partitionBy("side", "file_id", "volume").orderBy("page_id", "hash").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda n: F.coalesce(F.sum(n).over(order), F.lit(0).cast("long"))
    return groups.join(cut, "file_id", "left").withColumn("volume", volume).select(
        "side", "file_id", "volume", before(F.col("copies")).alias("place"), "page_id", before(F.col("length") * F.col("copies")).alias("offset"), "length", "copies", "hash")


def leaves(found: DataFrame) -> DataFrame:
    """Rows (file_id, volume, place, page_id, offset, length, copies, hash) of one replica's records."""
    return placed(written(grouped(found).withColumn("side", F.lit("ours")), "records")).drop("side")


def tree(leaf: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """Levels from the leaves to the roots: rows (side, file_id, volume, place, up, first, n, length, hash), `up` the place of the
    node above, `first` and `n` the records it spans. Each level is written, and has about a `fan`-th of the rows of the one below."""
    order = Window.partitionBy("side", *VOLUME).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") % fan == 0
    levels, level = [], leaf.select("side", *VOLUME, "place", F.col("place").alias("first"), F.col("copies").alias("n"), "length", "hash")
    while True:
        levels.append(written(level.withColumn("up", F.coalesce(F.sum(ends.cast("long")).over(order), F.lit(0).cast("long"))), "merkle"))
        if levels[-1].where("place > 0").isEmpty():
            return levels
        line = F.concat_ws(":", F.col("length").cast("string"), F.col("n").cast("string"), "hash")
        child = F.sort_array(F.collect_list(F.struct("place", line.alias("line"))))
        whole = F.col("length") * F.col("n") if len(levels) == 1 else F.col("length")
        above = levels[-1].groupBy("side", *VOLUME, F.col("up").alias("place")).agg(
            F.min("first").alias("first"), F.sum("n").alias("n"), F.sum(whole).alias("length"), child.alias("children"))
        text = F.array_join(F.transform("children", lambda c: c["line"]), "\n")
        level = above.select("side", *VOLUME, "place", "first", "n", "length", F.sha2(text.cast("binary"), 256).alias("hash"))


def audit(levels: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The leaves that do not match, found by descent, and those that match elsewhere in the order.

    Rows (side, file_id, volume, place, matched) of leaves with fewer `matched` copies on the other side than they have, and rows
    (file_id, volume, place) of our leaves that moved. Nodes that match stand for all records below them; what matches on the way
    down is laid in order on both sides, and has moved where the matched records before it are not equally many.
    """
    again = Window.partitionBy("side", *VOLUME, "hash").orderBy("place")
    of = lambda side: F.max(F.when(F.col("side") == side, F.struct("place", "first", "n"))).alias(side)
    lone = lambda met, side, other: met.where(F.col(other).isNull()).select(F.lit(side).alias("side"), *VOLUME, F.col(f"{side}.place").alias("up"))
    opened, met, agreed = None, None, []
    for depth in reversed(range(len(levels))):
        level = levels[depth] if opened is None else levels[depth].join(opened, ["side", *VOLUME, "up"], "left_semi")
        met = written(level.withColumn("again", F.row_number().over(again)).groupBy(*VOLUME, "hash", "again").agg(of("ours"), of("theirs")), "met")
        opened = lone(met, "ours", "theirs").unionByName(lone(met, "theirs", "ours"))
        agreed.append(met.where("ours IS NOT NULL AND theirs IS NOT NULL").select(
            F.lit(depth).alias("depth"), *VOLUME, "ours.place", F.col("ours.first").alias("here"), F.col("theirs.first").alias("there"), F.least("ours.n", "theirs.n").alias("n")))
    matched = F.least(F.coalesce("ours.n", F.lit(0)), F.coalesce("theirs.n", F.lit(0))).alias("matched")
    lacking = [met.where(F.col(f"{side}.n") > matched).select(F.lit(side).alias("side"), *VOLUME, f"{side}.place", matched) for side in ("ours", "theirs")]
    before = lambda by: F.coalesce(F.sum("n").over(Window.partitionBy(*VOLUME).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = reduce(DataFrame.unionByName, agreed)
    moved = written(both.withColumn("moved", before("here") != before("there")).where("moved").select("depth", *VOLUME, "place"), "moved")
    down = None
    for depth in reversed(range(len(levels))):
        here = moved.where(F.col("depth") == depth).select(*VOLUME, "place")
        if down is not None:
            below = levels[depth].where("side = 'ours'").join(down.withColumnRenamed("place", "up"), [*VOLUME, "up"], "left_semi")
            here = here.unionByName(below.select(*VOLUME, "place"))
        down = here
    return written(lacking[0].unionByName(lacking[1]), "unmatched"), down


def compared(ours: DataFrame, theirs: DataFrame, fan: int = FAN, most: int = MOST_RECORDS, per_file: int = RECORDS_PER_FILE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The leaves of both sides (see `placed`) of two replicas' records, and what `audit` finds of them."""
    sides = [grouped(found).withColumn("side", F.lit(side)) for side, found in (("ours", ours), ("theirs", theirs))]
    both = written(placed(written(sides[0].unionByName(sides[1]), "records"), most, per_file), "leaves")
    return both, *audit(tree(both, fan))


def each_copy(leaf: DataFrame) -> DataFrame:
    """A row for each record of a run of equal ones, with its `copy` from 0, its place and its offset; in steps, so no array is long."""
    step = 10_000
    starts = leaf.withColumn("_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(step).cast("long"))))
    each = starts.withColumn("copy", F.explode(F.sequence("_start", F.least(F.col("_start") + step, "copies") - 1)))
    return each.withColumns({"place": F.col("place") + F.col("copy"), "offset": F.col("offset") + F.col("copy") * F.col("length")}).drop("_start", "copies")


def audited(ours: DataFrame, theirs: DataFrame, fan: int = FAN, most: int = MOST_RECORDS, per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """Rows (file_id, volume, place, page_id, offset, length, hash, intact, moved) for all our records, given both replicas' records."""
    both, lacking, moved = compared(ours, theirs, fan, most, per_file)
    bad = lacking.where("side = 'ours'").select(*VOLUME, "place", "matched")
    mine = both.where("side = 'ours'").join(bad, [*VOLUME, "place"], "left").join(moved.withColumn("away", F.lit(True)), [*VOLUME, "place"], "left")
    intact = F.col("matched").isNull() | (F.col("copy") < F.col("matched"))
    return each_copy(mine).select(*VOLUME, "place", "page_id", "offset", "length", "hash", intact.alias("intact"), (intact & F.col("away").isNotNull()).alias("moved"))
