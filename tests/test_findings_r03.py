"""Findings of the third round."""

from __future__ import annotations

import math
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strokelake import plans
from strokelake.functions import walk
from strokelake.functions.arrays import rounded
from strokelake.operators import blocks, bpe, quality, sampling, scoring, spline, standard, textops

VECTORS = "vec_id long, embedding array<float>, label int"


def bits(v):
    return [None if x is None else struct.pack("d", x if not math.isnan(x) else math.nan) for x in v]


def test_equal_jumps_are_cut_in_order_of_strokes(spark):
    # three jumps of 0.04 that differ in the last bit alone, the later ones longer
    at = [0.0, 0.1, 0.24, 0.38]
    rows = [("a", k, x, 0.0, x + 0.1 if k else 0.06, 0.0) for k, x in enumerate(at)]
    jumps = [rows[k][2] - rows[k - 1][4] for k in (1, 2, 3)]
    assert len(set(jumps)) > 1 and len({round(j, 9) for j in jumps}) == 1
    df = spark.createDataFrame(rows, "id string, stroke int, x0 double, y0 double, x1 double, y1 double")
    assert [r.stage for r in quality.stage_cuts(df, 3).orderBy("stroke").collect()] == [0, 1, 2, 2]


def test_rounded_as_sql_rounds(spark):
    values = [-1e-7, 1e-7, -0.0, 0.0, 0.5e-6, -0.5e-6, 1.0000005, 2.675, 1.005, 0.1234565, -0.1234565, 1e300, math.inf, math.nan, None, *np.random.default_rng(0).normal(size=2000).tolist(), *(np.arange(-999, 999) / 2e6).tolist()]
    ours = [r.r for r in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").orderBy("i").select(rounded(F.col("x"), 6).alias("r")).collect()]
    theirs = [duckdb.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in values]
    assert bits(ours) == bits(theirs)


def test_unit_of_odd_vectors_as_in_sql(spark, tmp_path):
    rows = [(1, [0.0, 0.0], 0), (2, [3.0, None], 0), (3, [-1e-9, 1.0], 0), (4, None, 0), (5, [1e-20, 1e-20], 0), (6, [], 0), (7, [float("nan"), 1.0], 0), (8, [-3.0, 4.0], 0)]
    spark.createDataFrame(rows, VECTORS).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    theirs = {k: u and bits(u) for k, u in con.execute(plans.SQL["v02_unit"]).fetchall()}
    assert {r.vec_id: r.u and bits(r.u) for r in plans.QUERIES["v02_unit"](spark, str(tmp_path)).collect()} == theirs


def test_strokes_drawn_by_row_as_by_windows(spark):
    rng = np.random.default_rng(1)
    ink = [("a", [[(math.cos(i / 3), math.sin(i / 3)) for i in range(12)], [], [(5.0, 5.0)], [(0.0, 0.0), (1.0, 0.0)], [(2.0, 2.0)] * 3]), ("b", None), ("c", []),
           *[(f"w{k}", [np.cumsum(rng.normal(size=(n, 2)) / 20, axis=0).tolist() for n in rng.integers(1, 40, 5)]) for k in range(30)]]
    df = spark.createDataFrame([(k, s and [[tuple(map(float, p)) for p in x] for x in s]) for k, s in ink], "id string, strokes array<array<struct<x:double,y:double>>>")
    each = df.select("id", F.posexplode("strokes").alias("stroke", "s")).select("id", "stroke", F.posexplode("s").alias("pos", "p")).select("id", "stroke", "pos", "p.x", "p.y")
    theirs = sorted(map(tuple, spline.resample(spline.smooth_path(each), 0.02).select("id", "stroke", "j", "x", "y").collect()))
    drawn = spline.drawn(df, 0.02)
    got = {r.id: r.strokes for r in drawn.collect()}
    ours = sorted((k, i, j, p.x, p.y) for k, s in got.items() for i, q in enumerate(s or []) for j, p in enumerate(q))
    assert [r[:3] for r in ours] == [r[:3] for r in theirs] and np.allclose([r[3:] for r in ours], [r[3:] for r in theirs], atol=1e-9)
    assert got["b"] is None and got["c"] == [] and "Exchange" not in drawn._jdf.queryExecution().toString()


def test_bands_read_only_the_frames_that_need_them(spark, monkeypatch):
    plans_seen, bands = [], standard.band_heights

    def seen(ink):
        plans_seen.append(ink._jdf.queryExecution().optimizedPlan().toString())
        return bands(ink)

    monkeypatch.setattr(standard, "band_heights", seen)
    rows = [(f, f"{f}/{k}", "no" if f == 1 else "bad", [[(0.0, 0.0), (0.1, 0.2 + k / 100), (0.2, 0.0)]]) for f in (1, 2) for k in range(6)]
    ink = spark.createDataFrame(rows, "frame int, id string, text string, strokes array<array<struct<x:double,y:double>>>")
    assert {r.frame: r.how for r in standard.frame_scales(ink).collect()} == {1: "words", 2: "band"}
    assert "Join" not in plans_seen[0]  # a filter on bands went below the join, to all ink


@pytest.mark.parametrize("block", [1, 2, 100])
def test_matches_equal_to_nine_places_go_to_the_smaller_prompt(spark, block):
    items = spark.createDataFrame([(1, 3, [1.0, 0.0]), (2, 9, [0.0, 1.0])], "item long, own long, v array<double>")
    prompts = spark.createDataFrame([(3, [1.0, 2.0]), (4, [1.0 + 1e-12, 0.0]), (5, [1.0 + 1e-6, 0.0]), (6, [1.0 + 1e-6 + 1e-12, 2.0 + 1e-13])], "prompt long, w array<double>")
    got = {r.item: (r.rank, r.best) for r in blocks.ranked(items, prompts, k=3, block=block).collect()}
    assert got == {1: (3, [5, 6, 3]), 2: (None, [3, 6, 4])}


ODD_TEXTS = [(1, "See the E, eel!"), (2, None), (3, ""), (4, "eEe"), (5, "a1b-Kİé e\nXyZ"), (6, "b" * 3000 + "e" + "c" * 3001), (7, "no vowel thr"), (8, "e" * 500 + "ABab" * 7)]


def from_texts(spark, tmp_path, query):
    """Rows of a query and of its SQL over odd texts."""
    spark.createDataFrame([(k, t, len(t or "")) for k, t in ODD_TEXTS], "doc_id long, text string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    made = plans.QUERIES[query](spark, str(tmp_path))
    return made, sorted(tuple(r) for r in made.collect()), sorted(con.execute(plans.SQL[query]).fetchall())


def test_letters_are_split_as_strings(spark, tmp_path):
    made, ours, theirs = from_texts(spark, tmp_path, "c13_split_words")
    assert ours == theirs and len(ours) > 5
    assert "regexp_extract_all" not in made._jdf.queryExecution().optimizedPlan().toString()  # an array of all letters of a text
    df = spark.createDataFrame(ODD_TEXTS, "doc_id long, text string")
    letters = F.split(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")), "")
    coded = F.transform(F.filter(letters, lambda c: c != ""), lambda c: F.when(c == "e", 522).otherwise(F.ascii(c) - 97))
    assert sorted(tuple(r) for r in df.select("doc_id", F.posexplode(walk.split_words(coded, 522, 520))).collect()) == ours


def test_letters_as_ink_tokens_as_in_sql(spark, tmp_path):
    made, ours, theirs = from_texts(spark, tmp_path, "c12_detokenize_texts")
    assert ours == theirs and len(ours) > 5
    assert "[A-Za-z], 0" not in made._jdf.queryExecution().optimizedPlan().toString()  # an array of all letters, named one by one
    texts = ["<ink_token_450>", "<ink_token_1><ink_token_230>", "<ink_token_450><ink_token_1>", "<ink_token_0450> <ink_token_1>x<ink_token_226><ink_token_450><ink_token_225><ink_token_225><ink_token_450><ink_token_2><ink_token_x><ink_token_225>", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, textops.detokenize(df).collect())) == [(3, 0, 0, 1, 1), (3, 1, 0, 2, 0)]


def test_shards_of_draws_share_tables_and_move_bounded_words(spark):
    words = spark.createDataFrame([(f"w{i}", i % 3, 1 + i % 2, [i % 8] * (5 + 40 * (i % 5)), 3) for i in range(60)], "id string, g int, weight int, tokens array<int>, b int")
    args = ("g", "weight", "id", "tokens", "b")
    whole = {r.draw: r for r in sampling.drawn_examples(words, 90, *args, most=4, block=64, limit=40, marks=walk.specials(0)).collect()}
    tables = sampling.example_tables(words, *args)
    shards = [sampling.drawn_examples(words, spark.range(a, a + 30).withColumnRenamed("id", "draw"), *args, most=4, block=64, limit=40, marks=walk.specials(0), tables=tables) for a in (0, 30, 60)]
    assert {r.draw: r for s in shards for r in s.collect()} == whole and len(whole) == 90
    assert {len(r.x) for r in whole.values()} == {64} and {r.y[-1] for r in whole.values()} == {-1} and any(r.x[1:-1].count(10) == 0 and 11 not in r.y for r in whole.values())  # one is cut


def test_pairs_are_counted_in_tasks(spark):
    texts = [("0120", 3), ("00", 2), ("7", 5), ("", 1), ("0" + bpe.character(10) + bpe.character(11), 4)]
    runs = spark.createDataFrame([(t, t[:2], f) for t, f in texts], "run string, new string, freq long").coalesce(1)
    made = bpe.pair_counts(runs, {"run": -1, "new": 1}, 12)
    assert {(r.a, r.b): r.n for r in made.collect() if r.n} == {(1, 2): -3, (2, 0): -3, (10, 11): -4}
    assert {(r.a, r.b): r.n for r in bpe.pair_counts(runs, vocabulary=3000).collect()} == {(0, 1): 3, (1, 2): 3, (2, 0): 3, (0, 0): 2, (0, 10): 4, (10, 11): 4}
    assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString()  # no row for each pair of neighbours


def costs_by_hand(words, target, context, vocabulary):
    """Nats and moves of a target's tokens; a null matches none, and the token after it stands after -1."""
    pairs = lambda k: list(zip([-1, *(-1 if t is None else t for t in words[k])], words[k], strict=False))
    seen = [p for k in context or [] if words.get(k) for p in pairs(k)]
    cost = lambda b, t: -math.log(((0 if t is None else seen.count((b, t))) + 1) / (sum(a == b for a, _ in seen) + vocabulary))
    return sum(cost(*p) for p in pairs(target)), sum(t is not None and t < 8 for t in words[target])


@pytest.mark.parametrize("vocabulary", [10, 40_000])
def test_primed_costs_as_by_hand(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(scoring, "BATCH", 3)
    rng = np.random.default_rng(2)
    words = {f"w{i}": rng.integers(0, 10, n).tolist() for i, n in enumerate([1, 2, 30, 100, 7, 0, 12])} | {"odd": [None, 3, None, 3, 3], "none": None, "high": [vocabulary - 1, 0] * 3}
    told = [("w3", ["w2", "w4", "w6"]), ("w3", []), ("w2", ["w3", "w3"]), ("w4", None), ("w5", ["w2"]), ("none", ["w2"]), ("w6", ["gone", "none", "w3"]), ("odd", ["odd", "w3"]), ("w3", ["odd"]), ("high", ["high", "w0"]), ("w0", ["w5", None, "w1"]), ("gone", ["w1"])]
    trials = spark.createDataFrame([(i, i % 3, *t) for i, t in enumerate(told)], "n int, m long, target string, context array<string>")
    rows = spark.createDataFrame(list(words.items()), "id string, tokens array<int>")
    kept = [i for i, (t, _) in enumerate(told) if words.get(t)]
    whole = {(r.n, r.m): (r.nats, r.moves) for r in scoring.primed_costs(trials, rows, ["n", "m"], vocabulary).collect()}
    assert sorted(whole) == [(i, i % 3) for i in kept]
    assert all(whole[i, i % 3] == pytest.approx(costs_by_hand(words, *told[i], vocabulary), abs=1e-9) for i in kept)
    firsts = {(r.n, r.k): (r.nats, r.moves) for r in scoring.primed_costs(trials, rows, ["n"], vocabulary, firsts=(0, 1, 3)).collect()}
    assert sorted(firsts) == [(i, k) for i in kept for k in (0, 1, 3)]
    assert all(v == pytest.approx(costs_by_hand(words, told[i][0], (told[i][1] or [])[:k], vocabulary), abs=1e-9) for (i, k), v in firsts.items())


@pytest.mark.parametrize("query", ["g05_context_scores", "g04_style_rank"])
def test_primed_scores_make_no_row_for_a_token(spark, tmp_path, query):
    rng = np.random.default_rng(3)
    # user 0 has half of all words, users from 40 too few; some values are null
    users = [0] * 1500 + [int(u) for u in rng.integers(1, 40, 1500)] + list(range(40, 50))
    kinds = ["view", "signup", "click", "error", "purchase"]
    rows = [(i, int(rng.integers(0, 10**6)), u, kinds[rng.integers(5)], None if i % 50 == 0 else float(round(rng.exponential(50), 2))) for i, u in enumerate(users)]
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double").select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props"))
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    made = plans.QUERIES[query](spark, str(tmp_path))
    cursor = con.execute(plans.SQL[query])
    names = [d[0] for d in cursor.description]
    theirs, ours = sorted(cursor.fetchall()), sorted(tuple(r[c] for c in names) for r in made.collect())
    assert len(theirs) > 2 and np.allclose(np.array(ours, float), np.array(theirs, float), rtol=0, atol=2e-6)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(tokens" not in plan and "strategy=merge" in plan  # tokens unfolded in a task, or words broadcast by the size of their file
