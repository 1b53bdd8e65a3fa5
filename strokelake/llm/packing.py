"""Best-fit packing by hierarchical residual merging.

Documents become token ids plus an end id; what is longer than a sequence is cut, and full pieces are sequences of
their own. The other pieces are dealt to partitions by hash. Each partition packs its pieces best-fit (longest first,
into the open bin with the least room that holds it) and emits bins that are nearly full, or that no bin left can go into.
The rest go on as items to the next round, dealt anew to as many tasks as they need; a round of one task emits all.
Best-fit leaves a task at most one bin that is half full or less, and two others never fit together: so after the second
round only such bins go on, and no task ever takes more than about `ITEMS_PER_TASK` items. A bin holds at most `capacity`
tokens, so at most that many pieces.

Defined cases: null and empty texts give one piece, the end id alone; repeated rows are packed one by one; an empty
table gives no pieces; other columns of the input are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strokelake.llm.common import written

CAPACITY = 2048
END_ID = 0
ITEMS_PER_TASK = 20_000
SLACK = 16  # a bin with at most this room is nearly full
CACHE_WORDS = 450_000


# How the word-level byte-pair file cleans and splits a text.
CLEANS = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLITS = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
                                                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds(dict):
    """Ids of white-space separated words, as little-endian 32-bit bytes; found once per word and worker.

    For a file that cleans and splits as `CLEANS` and `SPLITS` say; `whole` tells other files, whose texts go through the
    tokenizer as they are. Such a tokenizer drops white space and never joins across it, so a text's ids are its words' ids in a row. Words of
    plain Latin letters, digits and marks are split here as the tokenizer splits and go to its model; others go through
    the whole tokenizer.
    """

    PLAIN = re.compile("[!-~¡-į]+")

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self.whole = (said.get("normalizer"), said.get("pre_tokenizer")) != (CLEANS, SPLITS)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}
        self.split = regex.compile(SPLIT).findall
        # A byte's stand-in letter: itself where it is a printable Latin-1 character, else the next letter from 256.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def part(self, piece: str) -> bytes:
        found = self.parts.get(piece)
        if found is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            if len(self.parts) >= CACHE_WORDS:
                self.parts.clear()
            found = self.parts[piece] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return found

    def __missing__(self, key: bytes) -> bytes:
        word = key.decode()
        if word.isascii() and (word.isalpha() or word[:-1].isalpha() and word[-1] in ".,;:!?"):
            low = word.lower()  # most words: letters, or letters and one mark
            found = self.part(low) if low.isalpha() else self.part(low[:-1]) + self.part(low[-1])
        elif b"<|" in key or not self.PLAIN.fullmatch(word):
            found = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        else:
            found = b"".join(map(self.part, self.split(word.lower())))
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[key] = found
        return found


_words: dict[str, WordIds] = {}


def token_bytes(text: str | None, path: str) -> bytes:
    """The ids of a text and the end id, 4 bytes each."""
    if (ids := _words.get(path)) is None:
        ids = _words[path] = WordIds(path)
    if ids.whole:
        return array("I", [*ids.tokenizer.encode(text or "", add_special_tokens=False).ids, END_ID]).tobytes()
    return b"".join(map(ids.__getitem__, (text or "").encode().split())) + END_ID.to_bytes(4, "little")


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]), in order of each document's ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids)}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = token_bytes(text.as_py(), path)
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at : at + 4 * capacity]
                    row = (doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own), *[np.frombuffer(own, "<u4").astype("i4")] * ids)
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    text = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * ids
    schema = to_arrow_schema(_parse_datatype_string(text))
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(cut, text)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest item first, each into the open bin with the least room that holds it.

    Open bins are stacked by room; a bit per room value says which stacks have bins.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        length = lengths[item]
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = stacks[room].pop()
            if not stacks[room]:
                rooms &= ~(1 << room)
            bins[at].append(item)
        else:
            at, room = len(bins), capacity
            bins.append([item])
        if room := room - length:
            stacks[room].append(at)
            rooms |= 1 << room
    return bins


def pack_round(items: DataFrame, capacity: int, least: int) -> DataFrame:
    """One task's bins for each `task`: rows (task, bin, fill, done, members), from items (task, fill, members)."""
    out = f"task int, bin bigint, fill bigint, done boolean, members {items.schema['members'].dataType.simpleString()}"

    def pack(table: pa.Table) -> pa.Table:
        members = table.column("members").combine_chunks()
        fills, starts, rows = table.column("fill").to_pylist(), members.offsets.to_numpy(), members.values
        sizes = np.diff(starts)
        bins = best_fit(fills, capacity)
        order = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for b in bins for i in b])
        count = np.array([sum(int(sizes[i]) for i in b) for b in bins])
        ends = np.cumsum(count)
        rows = rows.take(pa.array(order))
        lengths = rows.field("length").to_numpy()
        before = np.cumsum(lengths) - lengths
        offset = before - np.repeat(before[ends - count], count)
        names = [f.name for f in rows.type]
        rows = pa.StructArray.from_arrays([pa.array(offset, pa.int64()) if n == "offset" else rows.field(n) for n in names], names)
        full = [sum(fills[i] for i in b) for b in bins]
        return pa.table({
            "task": pa.array([table.column("task")[0].as_py()] * len(bins), pa.int32()), "bin": pa.array(range(len(bins)), pa.int64()), "fill": pa.array(full, pa.int64()),
            "done": pa.array([x >= least for x in full], pa.bool_()), "members": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), rows),
        })

    return items.groupBy("task").applyInArrow(pack, out)


def pack(items: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """The items (any columns with `length`, 1 to capacity, but no sequence_id or offset) with sequence_id and offset.

    `items` is read twice; pass a written table. Sequence ids hold the round, the task and the bin.
    """
    tasks = max(1, -(-items.count() // per_task))
    member = F.struct(*[F.col(c) for c in items.columns], F.lit(0).cast("long").alias("offset"))
    # the number of a row in the written table deals out rows that are equal in every column
    dealt = F.pmod(F.xxhash64("length", F.monotonically_increasing_id()), F.lit(tasks)).cast("int")
    todo = items.select(dealt.alias("task"), F.col("length").alias("fill"), F.array(member).alias("members"))
    out: DataFrame | None = None
    number = 0
    while True:
        packed = written(pack_round(todo, capacity, capacity - slack if tasks > 1 else 0), "pack-round")
        left = packed.where("NOT done").agg(F.min("fill").alias("least")).first()
        # what goes on: bins that some bin left fits into; after the second round, those that are half full or less
        most = 0 if left["least"] is None else capacity - left["least"] if number == 0 else capacity // 2
        on = ~F.col("done") & (F.col("fill") <= most)
        ids = F.shiftleft(F.lit(number).cast("long"), 56) + F.shiftleft(F.col("task").cast("long"), 32) + F.col("bin")
        rows = packed.where(~on).select(ids.alias("sequence_id"), F.explode("members").alias("m")).select("m.*", "sequence_id")
        out = rows if out is None else out.unionByName(rows)
        if not (items_left := packed.where(on).count()):
            break
        number += 1
        tasks = -(-items_left // per_task)
        todo = packed.where(on).select(F.pmod(F.xxhash64(F.lit(number), "task", "bin"), F.lit(tasks)).cast("int").alias("task"), "fill", "members")
    return out


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, offset, sequence_id[, ids]), one per piece.

    With `ids` the pieces' token ids come along: a training sequence is the ids of one sequence_id in order of offset.
    """
    return pack(written(pieces(docs, path or tokenizer_path(), capacity, ids), "pieces"), capacity)
