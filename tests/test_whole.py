"""Registered queries over whole tables: no row is left out."""

from __future__ import annotations

import unicodedata

from strokelake import plans
from strokelake.operators import sampling


def documents(spark, path, rows) -> str:
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_plain_text_of_every_document(spark, tmp_path):
    texts = [(1, "Café 10", "en"), (2, "Ünder\n0", "de"), (3, "ﬁn É", None), (4, None, "en"), (5, "", "fr"), (6, "x" * 5000 + "É", "en")]
    got = plans.QUERIES["e08_plain_text"](spark, documents(spark, tmp_path, [(i, t, lang, "s", 0) for i, t, lang in texts])).collect()
    slow = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower().replace("0", "o")
    assert sorted((r.doc_id, r.plain) for r in got) == [(i, None if t is None else slow(t)) for i, t, _ in texts]


def test_batch_stream_keeps_every_document(spark, tmp_path):
    """Rows that wait when the stream ends come out as batch -1."""
    rows = [(i, "t", "en", "s", 40 * (1 + i % 30)) for i in range(203)]
    got = plans.QUERIES["k01_batch_stream"](spark, documents(spark, tmp_path, rows)).collect()
    assert sorted(r.key for r in got) == list(range(203))
    assert all(r.shard == r.key % 8 and r.width == min(768, -(-40 * (1 + r.key % 30) // 64) * 64) for r in got if r.batch == -1)
    assert 0 < sum(r.batch == -1 for r in got) < 8 * 16
    batches: dict = {}
    for r in got:
        if r.batch >= 0:
            batches.setdefault((r.shard, r.batch), []).append(r)
    for members in batches.values():  # as many rows as the budget holds at the width of the longest, none longer
        width = members[0].width
        lengths = [min(768, 40 * (1 + r.key % 30)) for r in members]
        assert {r.width for r in members} == {width} and len(members) == max(1, 4096 // width) and width == min(768, -(-max(lengths) // 64) * 64)


def test_draws_are_distinct_and_uniform(spark):
    """A draw's members are distinct, of one group, and each member of a group is drawn about as often."""
    rows = spark.createDataFrame([(i, "ab"[i % 10 == 0], 1.0) for i in range(60)], "id long, g string, w double")
    got = sampling.weighted_draws(rows, 4000, "g", "w", "id", most=4).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.draw, []).append(r)
    assert len(by) == 4000
    for members in by.values():
        assert len({r.id for r in members}) == len(members) <= 4 and len({r.g for r in members}) == 1
        assert sorted(r.place for r in members) == list(range(1, len(members) + 1))
    assert 0.86 < sum(m[0].g == "a" for m in by.values()) / 4000 < 0.94
    counts = [sum(r.id == i for r in got) for i in range(60) if i % 10]
    assert min(counts) > 0.6 * sum(counts) / len(counts) and max(counts) < 1.4 * sum(counts) / len(counts)
