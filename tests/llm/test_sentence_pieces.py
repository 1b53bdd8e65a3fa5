"""Encoding by distinct chunks against the library on whole texts."""

from __future__ import annotations

import hashlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from strokelake.llm import queries, sentence_pieces

SF = Path("/root/testdata/sf0.001")
ODD = ["", None, " ", "   ", "a", " a", "a ", "  a  b ", "▁", "a▁b", "▁ ▁", "\n\n", "a\n b", "日本 語 ", "<s> </s> <unk>", "\0 x\0", "😀 😀😀", "é  é" * 50, "x" * 5000, " " * 5000, "　 a b", "<0x41> a", "a", "the cat " * 30_000, "thé🂡 " * 40]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model_path())


@pytest.mark.parametrize("block_chars", [1, 150, 8 << 20])
def test_odd_texts(spark, library, block_chars):
    docs = spark.createDataFrame([(i, t, "z", "z") for i, t in enumerate(ODD)] + [(None, "a b", "q", "q"), (4, "b", "q", "q"), (4, "b", "q", "q")], "doc_id long, text string, chunk string, block string")
    out = sentence_pieces.encode(docs, block_chars=block_chars).collect()
    want = [(i, t or "") for i, t in enumerate(ODD)] + [(None, "a b"), (4, "b"), (4, "b")]
    ids = {t: library.encode(t) for _, t in want}
    assert sorted(map(repr, [(r.doc_id, r.ids, r.decoded) for r in out])) == sorted(map(repr, [(i, ids[t], library.decode(ids[t])) for i, t in want]))


def test_whole_texts_where_chunks_would_not_do(spark, library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "by_chunks", lambda path: False)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    for r in sentence_pieces.encode(docs).collect():
        assert r.ids == library.encode(ODD[r.doc_id] or "") and r.decoded == library.decode(r.ids)


def test_tables_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    out = sentence_pieces.encode(docs)
    assert out.count() == 0 and dict(out.dtypes)["doc_id"] == "int"
    blank = sentence_pieces.encode(spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")).collect()
    assert [(r.ids, r.decoded) for r in blank] == [([], "")] * 2


def test_query_is_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(str(SF / "documents.parquet")).collect()}
    out = queries.queries()["op13_sentencepiece"](spark, str(SF)).collect()
    assert len(out) == len(texts)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in out:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_decode_of_other_ids(spark, library):
    rows = spark.createDataFrame([(1, library.encode("a  b é")), (2, None), (3, [])], "k int, ids array<int>")
    assert [r.decoded for r in sentence_pieces.decode(rows).orderBy("k").collect()] == ["a  b é", "", ""]


def test_rows_in_another_order_are_told(library):
    path, one = sentence_pieces.model_path(), sentence_pieces.packed
    left = pa.table({"block": [b"x"], "head": [one({"doc_id": pa.array([1]), "size": pa.array([1])})], "value": [one(sentence_pieces.bytewise("n", np.array([0])))]})
    with pytest.raises(ValueError, match="another order"):
        list(sentence_pieces.restored(left, pa.table({"answer": pa.array([], pa.binary())}), path, True))
