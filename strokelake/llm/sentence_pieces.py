"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece of a model holds a space mark after another character, no merge crosses the place before a mark that
follows another character. A text is then a row of chunks (a run of marks and the word after it), and its ids are its
chunks' ids in a row; as each chunk's first piece starts with a mark, runs of byte pieces end with their chunk, and so
decoding goes chunk by chunk as well.

1. Blocks: each task cuts its texts into chunks and numbers the distinct ones of about `BLOCK_CHARS` characters of text.
2. Table: the blocks' distinct chunks go to shards by their hash. A shard's task holds its part of the table and segments each
   distinct chunk once, whatever number of blocks ask for it, and answers each block with numbers and ids.
3. The texts are cut again into the same blocks; each block's answers meet its documents, and ids and decoded text take their
   places back by number.

Only distinct chunks of blocks, their ids and the numbers are shuffled, packed as compressed Arrow columns; nothing is written.
A chunk is in a block's list once however often it occurs there, and a shard takes a chunk's requests one list at a time, so a
chunk of all blocks weighs no more than others. A document is never parted, since its result is one row. Models that can cross a
mark, normalise texts or know user-defined pieces are told by their file (`by_chunks`); there a text is one chunk, and the same
steps segment each distinct text once.

Defined cases: null and empty texts have no ids and decode to the empty text; a mark character (U+2581) in a text is a space,
as in the library; repeated rows are encoded one by one, by place and not by doc_id, which may be null; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

MARK = "▁"
BLOCK_CHARS = 8 << 20
ROWS_OUT = 500
TABLE_CHUNKS = 500_000


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_models: dict[str, object] = {}


def model(path: str):
    """The library's model, loaded once per worker."""
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def by_chunks(path: str) -> bool:
    """Whether no piece crosses a mark and texts stay as they are but for the marks."""
    from sentencepiece import sentencepiece_model_pb2

    said = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        said.ParseFromString(file.read())
    plain = said.normalizer_spec
    kinds = {p.type for p in said.pieces}
    known = {p.piece for p in said.pieces if p.type == 1}
    return (plain.name == "identity" and plain.add_dummy_prefix and plain.escape_whitespaces and not plain.remove_extra_whitespaces and not said.trainer_spec.treat_whitespace_as_suffix
            and said.trainer_spec.model_type == 2 and 4 not in kinds and MARK in known and not any(MARK in p.lstrip(MARK) for p in known))


_JOINED = re.compile("^ +|(?<= ) +")


def chunk_rows(texts: pa.Array, split: bool) -> pa.ListArray:
    """Each text's chunks without their first mark: what the library is given for a chunk, since it sets a mark in front.

    Spaces at the start or after a space belong to the chunk that follows and become marks, so the others part chunks.
    """
    texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar(None, pa.string()), texts)
    if not split:
        known = pc.is_valid(texts).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(known)]), pa.int32()), texts.drop_null())
    texts = pc.replace_substring(texts, MARK, " ")
    joined = pc.fill_null(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), False)
    if pc.any(joined).as_py():
        changed = [_JOINED.sub(lambda m: MARK * len(m.group()), t) for t in texts.filter(joined).to_pylist()]
        texts = pc.replace_with_mask(texts, joined, pa.array(changed, pa.string()))
    return pc.split_pattern(texts, " ")


PACKED = pa.ipc.IpcWriteOptions(compression="zstd")


def packed(columns: dict[str, pa.Array]) -> bytes:
    """Arrow columns of any lengths as one compressed value, so that a shuffle moves few and small rows."""
    batch = pa.RecordBatch.from_pydict({k: pa.LargeListArray.from_arrays(pa.array([0, len(v)], pa.int64()), v) for k, v in columns.items()})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=PACKED) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpacked(value: bytes) -> dict[str, pa.Array]:
    batch = pa.ipc.open_stream(value).read_next_batch()
    return {k: batch.column(k).flatten() for k in batch.schema.names}


def bytewise(name: str, numbers: np.ndarray) -> dict[str, pa.Array]:
    """32-bit numbers as four columns of bytes: small numbers leave the higher ones all zero."""
    flat = numbers.astype("<u4").view("u1").reshape(-1, 4)
    return {f"{name}{i}": pa.array(np.ascontiguousarray(flat[:, i])) for i in range(4)}


def from_bytes(name: str, columns: dict[str, pa.Array]) -> np.ndarray:
    return np.stack([columns[f"{name}{i}"].to_numpy() for i in range(4)], axis=1).reshape(-1).view("<u4")


def cut(batches: Iterator[pa.RecordBatch], split: bool, block_chars: int) -> Iterator[tuple[bytes, pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """A task's blocks: (block, distinct chunks, doc_ids, chunks a document, numbers of the documents' chunks).

    A block's id is a hash of its task, place and chunks: a second cut of the same rows gives the same blocks, and one of
    rows that come in another order gives ids that meet nothing, which `restored` reports.
    """
    task, count, chars, held = TaskContext.get().partitionId(), 0, 0, []

    def block() -> tuple[bytes, pa.Array, pa.Array, np.ndarray, np.ndarray]:
        lists = chunk_rows(pa.concat_arrays([b.column(1) for b in held]), split)
        found = lists.flatten().dictionary_encode()
        told = xxhash.xxh3_128(f"{task} {count} {len(lists)} {len(found)}")
        told.update(pa.array(found.dictionary.to_pylist(), pa.string()).buffers()[2] or b"")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        return told.digest(), found.dictionary, pa.concat_arrays([b.column(0) for b in held]), sizes, found.indices.to_numpy().astype("<u4")

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy().astype("i8") + 64)  # a row weighs at least 64
        at, before = 0, 0
        while at < batch.num_rows:
            end = min(batch.num_rows, int(np.searchsorted(ends, before + block_chars - chars)) + 1)
            held.append(batch.slice(at, end - at))
            chars += int(ends[end - 1]) - before
            at, before = end, int(ends[end - 1])
            if chars >= block_chars:
                yield block()
                count, chars, held = count + 1, 0, []
    if held:
        yield block()


def chunk_lists(docs: DataFrame, split: bool, block_chars: int, shards: int) -> DataFrame:
    """Rows (shard, block, value): a block's distinct chunks whose hash falls into the shard, with their numbers."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, texts, *_ in cut(batches, split, block_chars):
            shard = np.fromiter((zlib.crc32(c.encode()) for c in texts.to_pylist()), "u4", len(texts)) % shards
            order = np.argsort(shard, kind="stable")
            ends = np.searchsorted(shard[order], np.arange(shards + 1))
            for at in np.unique(shard).tolist():
                own = order[ends[at] : ends[at + 1]]  # ascending
                yield pa.RecordBatch.from_pydict({"shard": pa.array([at], pa.int32()), "block": [block], "value": [packed(bytewise("step", np.diff(own, prepend=0)) | {"chunk": texts.take(pa.array(own))})]})

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(listed, "shard int, block binary, value binary")


def places(docs: DataFrame, split: bool, block_chars: int) -> DataFrame:
    """Rows (block, value): doc_ids of up to `ROWS_OUT` documents and the numbers of their chunks, byte by byte."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, ids, sizes, flat in cut(batches, split, block_chars):
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for at in range(0, len(ids), ROWS_OUT):
                head = packed({"doc_id": ids.slice(at, ROWS_OUT), "size": pa.array(sizes[at : at + ROWS_OUT], pa.int64())})
                value = packed(bytewise("n", flat[ends[at] : ends[min(at + ROWS_OUT, len(ids))]]))
                yield pa.RecordBatch.from_pydict({"block": [block], "head": [head], "value": [value]})

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(placed, "block binary, head binary, value binary")


def segmented(lists: DataFrame, path: str, split: bool) -> DataFrame:
    """Rows (block, value): numbers of a block's chunks and their ids. Lists come by shard, so a distinct chunk is in one
    task, which keeps what it has segmented (and forgets it all beyond `TABLE_CHUNKS`)."""

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = model(path)
        mark = [sp.piece_to_id(MARK)] * split
        table: dict[str, list[int]] = {}
        for batch in batches:
            for block, value in zip(batch.column(0), batch.column(1), strict=True):
                own = unpacked(value.as_py())
                asked = own["chunk"].to_pylist()
                if len(table) > TABLE_CHUNKS:
                    table.clear()
                new = [c for c in asked if c not in table]
                for at in range(0, len(new), 4096):
                    part = new[at : at + 4096]
                    table.update(zip(part, (i or mark for i in sp.encode(part, num_threads=1)), strict=True))
                ids = pa.array([table[c] for c in asked], pa.list_(pa.int32()))
                steps = {k: v for k, v in own.items() if k != "chunk"}
                answer = packed(steps | bytewise("size", pc.list_value_length(ids).to_numpy()) | bytewise("id", ids.flatten().to_numpy()))
                yield pa.RecordBatch.from_pydict({"b": [block.as_py()], "answer": [answer]}, schema=schema)

    schema = pa.schema([("b", pa.binary()), ("answer", pa.binary())])
    return lists.select("block", "value").mapInArrow(segment, "b binary, answer binary")


def restored(left: pa.Table, right: pa.Table, path: str, split: bool) -> Iterator[pa.RecordBatch]:
    """A block's documents (doc_id, ids, decoded): its chunks' ids and texts at the documents' numbers."""
    sp = model(path)
    answers = [unpacked(v.as_py()) for v in right.column("answer")]
    none = [np.empty(0, "i8")]
    n = np.concatenate([np.cumsum(from_bytes("step", a)) for a in answers] or none)
    sizes = np.concatenate([from_bytes("size", a) for a in answers] or none).astype("i8")
    flat = np.concatenate([from_bytes("id", a) for a in answers] or none).astype("i4")
    order = np.argsort(n)
    starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
    whole = flat.tolist()
    said = sp.decode([whole[a:b] for a, b in zip(starts.tolist(), (starts + sizes).tolist(), strict=True)]) if len(n) else []
    said = [" " + s for s in said] if split else said
    for head, value in zip(left.column("head"), left.column("value"), strict=True):
        head, value = unpacked(head.as_py()), unpacked(value.as_py())
        at = from_bytes("n", value)
        if len(at) and at.max() >= len(n):
            raise ValueError("the documents came in another order when read again: write them first")
        count = sizes[at]
        before = np.cumsum(count) - count
        ids = flat[np.repeat(starts[at] - before, count) + np.arange(count.sum())]
        ends = np.concatenate([[0], np.cumsum(head["size"].to_numpy())])
        total = np.concatenate([[0], np.cumsum(count)])[ends]
        texts = ["".join(map(said.__getitem__, at[a:b].tolist()))[split:] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_pydict({"doc_id": head["doc_id"], "ids": pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(ids, pa.int32())), "decoded": pa.array(texts, pa.string())})


def encode(docs: DataFrame, path: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (doc_id, ids, decoded), one per row of docs (doc_id, text): the library's ids and what they decode to.

    `docs` is read twice and must give its rows in the same order each time, as a stored table does."""
    path = path or model_path()
    split = by_chunks(path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shards = max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lists = chunk_lists(docs, split, block_chars, shards).repartition("shard")
    asked = places(docs, split, block_chars)

    def restore(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches(restored(left, right, path, split), to_arrow_schema(schema))

    schema = StructType([docs.schema["doc_id"], StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])
    # an outer cogroup: a block of empty texts alone has no chunks
    return asked.groupBy("block").cogroup(segmented(lists, path, split).groupBy("b")).applyInArrow(restore, f"doc_id {kind}, ids array<int>, decoded string")


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """The rows with `name`, the text of their ids (null: empty) by the library, for ids that come from elsewhere."""
    path = path or model_path()

    @F.pandas_udf("string")
    def said(lists):
        sp = model(path)
        return lists.map(lambda i: "" if i is None else sp.decode([int(x) for x in i]))

    return rows.withColumn(name, said(F.col(ids)))
