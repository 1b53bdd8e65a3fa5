"""Operators on documents against brute-force versions, with nulls, empty and odd texts, repeated rows and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strokelake.llm import host_rules, jaccard_join, line_dedup, mixing, packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, sid string, key int, part string, h int"


def made(n: int = 120, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 6))) for _ in range(300)]
    line = lambda k: " ".join(rng.choices(vocabulary, k=k))
    bases = ["\n".join(line(rng.randint(1, 30)) for _ in range(rng.randint(1, 12))) for _ in range(n // 3)]
    texts: list[str | None] = []
    for i in range(n):
        base = rng.choice(bases)
        words = base.split(" ")
        kind = i % 6
        if kind == 1:
            words[rng.randrange(len(words))] = "Zz"
        elif kind == 2 and len(words) > 3:
            del words[rng.randrange(len(words))]
        elif kind == 3:
            words.insert(rng.randrange(len(words) + 1), "New")
        texts.append(" ".join(words) if kind else base.upper() if i % 12 == 0 else base)
    texts += [None, "", "   \n\t ", "one", "two words", "\n\n", "a b a b a b a b", "x " * 60, "tab\tsplit  double \r\n line", "### $$ |<>|", " nbsp em", "same line of words that is long enough to be compared\n" * 3]
    rows = [(i, t, "en", None if i % 17 == 0 else f"s{i % 4}", 0, 1, "x", 2, "p", 3) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, "null id " * 5, None, None, 0, 1, "x", 2, "p", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def test_host_rules(spark, docs, none):
    got = host_rules.quality_rules(docs).collect()
    seen = collections.Counter()
    for r in made():
        w = words(r[1])
        count = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) if count[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
        lines = [x for x in (r[1] or "").split("\n") if WORD.search(x)]
        base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        seen[r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r[1] or "")), len(lines) - len(set(lines)), len(covered), base] += 1
    assert seen == collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert all(not r.kept for r in got if r.base_failed)
    assert host_rules.quality_rules(none).count() == 0
    assert host_rules.keep_good(none).count() == 0 and host_rules.keep_good(docs).columns == docs.columns


def test_bad_hosts_go(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows = [(i, good if (h != 0 or i % 10 == 0) else bad, f"h{h}") for h in range(6) for i in range(h * 100, h * 100 + 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in host_rules.quality_rules(df).collect()}
    assert all(not kept[i] for i, _, s in rows if s == "h0") and all(kept[i] for i, _, s in rows if s != "h0")
    assert {r.doc_id for r in host_rules.keep_good(df).collect()} == {i for i, k in kept.items() if k}
    assert host_rules.beta_prior(3, 0, 0, 0.0) == (0.5, 0.5)


def slow_targets(sizes):
    order = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    target, open_ = {}, set(sizes)
    left = sum(sizes.values())
    while open_:
        share = left / sum(weight[k] for k in open_)
        over = {k for k in open_ if share * weight[k] > 3 * sizes[k]}
        if not over:
            return target | {k: share * weight[k] for k in open_}
        for k in over:
            target[k] = 3 * sizes[k]
            left -= target[k]
        open_ -= over
    return target


def test_targets(spark):
    sizes = {"a": 10, "b": 500, "c": 300, None: 90, "d": 0}
    target = slow_targets(sizes)
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got.keys() == target.keys() and all(abs(got[k] - target[k]) < 1e-6 for k in target)


def test_mixing(spark, docs, none, monkeypatch):
    rows = [tuple(r) for r in mixing.mix(docs).collect()]
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 7)  # many ranges give the same mixture
    assert collections.Counter(rows) == collections.Counter(tuple(r) for r in mixing.mix(docs.repartition(5)).collect())
    taken, size = collections.Counter(), collections.Counter()
    for _, source, n, total, target, t in rows:
        taken[source] += t
        size[source] += n
        assert 0 <= t <= 3 * n
    for _, source, _, total, target, _ in rows:
        assert size[source] == total and abs(taken[source] - target) <= 1
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert sum(len(words(r.text)) for r in out.collect()) == sum(taken.values())
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_packing(spark, docs, none, monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 20)
    items = packing.written(packing.pieces(docs, packing.tokenizer_path(), 64, ids=True), "t")
    got = packing.pack(items, 64, per_task=20).collect()
    expected = collections.Counter()
    for r in made():
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 64)):
            own = ids[at : at + 64]
            expected[r[0], k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert expected == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length, len(r.ids)))
    for members in by.values():
        members.sort()
        assert [o for o, _, _ in members] == [sum(n for _, n, _ in members[:i]) for i in range(len(members))]
        assert sum(n for _, n, _ in members) <= 64 and all(n == k for _, n, k in members)
    assert len(by) <= 1.1 * -(-sum(r.length for r in got) // 64) + 1
    assert packing.pack_documents(none).count() == 0


@pytest.mark.parametrize("short", [0, 3, 40])
def test_packing_bounds_every_task(spark, monkeypatch, short):
    """Pieces over half a sequence, of which no two fit together, and a few short ones: no task gets them all."""
    rng = random.Random(short)
    lengths = [rng.randint(33, 47) for _ in range(600)] + [rng.randint(1, 20) for _ in range(short)]
    items = packing.written(spark.createDataFrame(list(enumerate(lengths)), "item long, length long"), "t")
    sizes, whole = [], packing.pack_round

    def seen(todo, *rest):
        sizes.append(todo.groupBy("task").count().agg({"count": "max"}).first()[0])
        return whole(todo, *rest)

    monkeypatch.setattr(packing, "pack_round", seen)
    got = packing.pack(items, 64, per_task=50).collect()
    assert max(sizes) <= 100, sizes
    assert sorted((r.item, r.length) for r in got) == list(enumerate(lengths))
    fills = collections.Counter()
    for r in got:
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 64 and 600 <= len(fills) <= 600 + short // 10


@pytest.mark.parametrize("text", ["don't <|endoftext|> It's", "İstanbul ΑΣ a\x1cb", "\xbcx\xbd na\xefve CAF\xc9!", "é ẞ ﬁ", "3.14 \xdf", "'s 're ab'll x,", "你好 x y"])
def test_token_bytes(text):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(packing.tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert packing.token_bytes(text, packing.tokenizer_path()) == np.array([*ids, 0], "<u4").tobytes()


def test_other_tokenizer_files():
    """A file that splits otherwise goes through its own tokenizer whole."""
    from tokenizers import Tokenizer

    path = packing.tokenizer_path("byte_bpe_50k.json")
    ids = Tokenizer.from_file(path).encode("Two  words, and\nmore.", add_special_tokens=False).ids
    assert packing.token_bytes("Two  words, and\nmore.", path) == np.array([*ids, 0], "<u4").tobytes()


def slow_components(rows, width, p, q):
    sets = []
    for doc_id, text in rows:
        w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append((doc_id, frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()))
    parent = {d: d for d, _ in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and q * len(s & t) >= p * len(s | t):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets}


@pytest.mark.parametrize(("width", "p", "q", "light"), [(3, 9, 10, 500), (5, 8, 10, 2), (1, 5, 10, 4)])
def test_jaccard(spark, docs, none, monkeypatch, width, p, q, light):
    monkeypatch.setattr(jaccard_join, "LIGHT", light)
    rows = [(r[0], r[1]) for r in made() if r[0] is not None]
    truth = slow_components(rows, width, p, q)
    got = jaccard_join.jaccard_components(docs, width, p, q).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_shingles, r.component_id) == (truth[r.doc_id] if r.doc_id is not None else (r.n_shingles, None))
    assert jaccard_join.jaccard_components(none, width, p, q).count() == 0
    kept = jaccard_join.one_per_group(docs, width, p, q)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in truth.items() if c == d} | {None}


def test_one_of_rows_that_share_a_doc_id(spark):
    """Identical rows stay once, and a near copy goes without a clean row of the same doc_id."""
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long), (1, long), (2, long + " end"), (2, "another text of its own"), (3, None), (3, None), (None, long)]
    kept = jaccard_join.one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter(map(tuple, kept)) == collections.Counter([(1, long), (2, "another text of its own"), (3, None), (3, None), (None, long)])


def test_sets_that_share_half_an_id(spark, monkeypatch):
    """Classes whose ids have the same first 64 bits are told apart by the others."""
    for name in ("shingled", "sets_of"):
        real = getattr(jaccard_join, name)
        monkeypatch.setattr(jaccard_join, name, lambda *a, real=real: real(*a).withColumn("sid", F.col("sid") % 3))
    rows = [(r[0], r[1]) for r in made() if r[0] is not None][:60]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()} == slow_components(rows, 3, 9, 10)


def test_shared_passage_makes_no_pairs(spark):
    """Texts that share most of their words but do not link stay apart; those that link among them are found."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    own = lambda k: " ".join(f"o{rng.randrange(10**9)}" for _ in range(k))
    texts = [f"{own(12)} {passage} {own(12)}" for _ in range(900)]
    texts += [f"{t} one more" for t in texts[::100]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    truth = slow_components(list(enumerate(texts)), 3, 9, 10)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()} == truth
    assert sum(c != d for d, (_, c) in truth.items()) == 9


def test_sketch_bounds_difference():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 1 << 40, 200).astype(np.uint64) << np.uint64(20)) for _ in range(2))
        b = np.unique(np.r_[a[: rng.integers(200)], b[:20]])
        x = np.bitwise_xor(jaccard_join.parity_sketch(a), jaccard_join.parity_sketch(b))
        assert sum(int(v).bit_count() for v in x.view(np.uint64)) <= len(np.setxor1d(a, b))


def slow_dropped_lines(rows, least):
    """(doc_id, line) of the lines that are dropped."""
    first, places = {}, []
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0])):
        for i, line in enumerate((text or "").split("\n")):
            if w := tuple(words(line)):
                places.append((doc_id, i, w))
                first.setdefault(w, (doc_id is not None, doc_id, i))

    def near(a, b):
        if len(a) < len(b):
            a, b = b, a
        if len(b) < least or len(a) - len(b) > 1:
            return False
        k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
        return a[k + 1 :] == b[k + (len(a) == len(b)) :]

    gone = {w for w in first for v in first if first[v] < first[w] and near(w, v)}
    return [(d, i) for d, i, w in places if w in gone or first[w] != (d is not None, d, i)]


def slow_dropped(rows, least):
    return collections.Counter(d for d, _ in slow_dropped_lines(rows, least))


def test_line_dedup(spark, docs, none):
    truth = slow_dropped([(r[0], r[1]) for r in made()], 8)
    out = line_dedup.dedup_lines(docs)
    for r in out.select("row.doc_id", "row.text", "kept_text", "n_lines", "n_dropped").collect():
        assert r.n_dropped == truth[r.doc_id], r
        assert r.n_lines == (0 if r.text is None else len(r.text.split("\n")))
        assert (r.kept_text or "").count("\n") == max(0, r.n_lines - r.n_dropped - 1)
    assert sum(truth.values()) > 50
    clean = line_dedup.deduplicated(docs)
    assert clean.columns == docs.columns and line_dedup.deduplicated(none).count() == 0
    assert all(r.text is None or WORD.search(r.text) or r.doc_id not in truth for r in clean.collect())


def test_repeated_items_are_dealt_out(spark, monkeypatch):
    """Rows equal in every column go to many tasks."""
    items = packing.written(spark.createDataFrame([(1, 40)] * 400, "item long, length long"), "t")
    sizes, whole = [], packing.pack_round
    monkeypatch.setattr(packing, "pack_round", lambda todo, *rest: (sizes.append(todo.groupBy("task").count().agg({"count": "max"}).first()[0]), whole(todo, *rest))[1])
    assert packing.pack(items, 64, per_task=50).select("sequence_id").distinct().count() == 400 and max(sizes) <= 120


@pytest.mark.parametrize("limit", [0, 10**6])
def test_joins_beyond_broadcast(spark, docs, monkeypatch, limit):
    """The same rows whether small sides are broadcast or shuffled."""
    for module, names in ((line_dedup, ("BROADCAST_ROWS", "BROADCAST_LINES")), (mixing, ("BROADCAST_SOURCES",)), (host_rules, ("BROADCAST_HOSTS",)), (jaccard_join, ("BROADCAST_DOCS",))):
        for name in names:
            monkeypatch.setattr(module, name, limit)
    truth = slow_dropped([(r[0], r[1]) for r in made()], 8)
    assert all(r.n_dropped == truth[r.doc_id] for r in line_dedup.dedup_lines(docs).select("row.doc_id", "n_dropped").collect())
    components = slow_components([(r[0], r[1]) for r in made() if r[0] is not None], 3, 9, 10)
    assert all((r.n_shingles, r.component_id) == components[r.doc_id] for r in jaccard_join.jaccard_components(docs.where("doc_id IS NOT NULL")).collect())
    assert sum(r.taken for r in mixing.mix(docs).collect()) > 0 and host_rules.keep_good(docs).count() <= docs.count()


def test_very_long_texts(spark):
    """A text of 200,000 words and a line of 50,000: nothing is cut."""
    long = "\n".join(" ".join(f"v{i}x{j}" for j in range(1000)) for i in range(200))
    wide = " ".join(f"u{i}" for i in range(50_000))
    rows = [(0, long, "a"), (1, long + " end", "a"), (2, wide, "b"), (3, wide + " end", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    judged = {r.doc_id: r for r in host_rules.quality_rules(df).collect()}
    assert [judged[i].n_words for i in range(4)] == [200_000, 200_001, 50_000, 50_001] and not any(r.n_repeat_words for r in judged.values())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df).collect()} == {0: (199_998, 0), 1: (199_999, 0), 2: (49_998, 2), 3: (49_999, 2)}
    assert {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(df).select("row.doc_id", "n_dropped").collect()} == {0: 0, 1: 200, 2: 0, 3: 1}
    got = packing.pack_documents(df.where("doc_id < 1")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("length").alias("most")).first()
    assert got.most <= 2048 and got.n == len(packing.token_bytes(long, packing.tokenizer_path())) // 4


def test_many_lines_one_word_apart(spark):
    """A counter line in many documents: all but the first go, without pairs of all with all."""
    text = "page number {} of the long report about many small things"
    df = spark.createDataFrame([(i, text.format(i)) for i in range(400)], "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.deduplicated(df).collect()} == {0}
    short = spark.createDataFrame([(0, "a b c d e f g"), (1, "a b c d e f x"), (2, "a b c d e f g"), (3, "a b c d e f g h"), (4, "a b c d e f x h")], "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.deduplicated(short).collect()} == {0, 1, 3}  # the bound is 0 below 8 words of the shorter line
    longer = spark.createDataFrame([(0, "a b c d e f g h i"), (1, "a b c d e f g h"), (2, "a b c d x e f g h"), (3, "a b c y d z e f g h")], "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.deduplicated(longer).collect()} == {0, 3}


def test_words_agree(spark, docs):
    from strokelake.llm.common import n_words
    from strokelake.llm.common import words as split

    for r in docs.select("text", split(F.col("text")).alias("w"), n_words(F.col("text")).alias("n")).collect():
        assert r.w == words(r.text) and r.n == len(r.w)


def slow_rules(rows):
    """Rows (doc_id, text, source) that pass the base rules and whose host is not rejected."""
    failed = {}
    for doc_id, text, _ in rows:
        w = words(text)
        count = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) if count[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
        failed[doc_id] = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    n = collections.Counter(source for _, _, source in rows)
    f = collections.Counter(source for doc_id, _, source in rows if failed[doc_id])
    alpha, beta = host_rules.beta_prior(len(n), len(rows), sum(f.values()), sum(f[h] ** 2 / n[h] for h in n))
    return [r for r in rows if not failed[r[0]] and (f[r[2]] + alpha) / (n[r[2]] + alpha + beta) <= 0.5]


def slow_mix(rows):
    """Texts of the mixture, with their doc_ids."""
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(words(text))
    out = []
    for source, target in slow_targets(sizes).items():
        rounds, left = divmod(round(target), sizes[source])
        own = sorted((int(hashlib.md5(f"mix|{d}".encode()).hexdigest()[:13], 16), d, t) for d, t, s in rows if s == source)
        for _, d, t in own:
            out += [(d, t)] * rounds
            if part := min(left, len(words(t))):
                out.append((d, t if part == len(words(t)) else "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", t)[:part])))
            left -= part
    return out


def test_whole_pipeline(spark):
    """Every stage of the pipeline against plain loops, each on what the loops before it kept."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    kept = [(i, f"{t}\n{t[::-1]}" if i % 9 else t, s) for i, t, _, s, *_ in made(150, seed=11)[:-2] if t]
    schema = "doc_id long, text string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, len(r[1])) for r in kept], schema)
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.written(stage(spark, docs, "whole"), f"t-{name}")
        if number == 0:
            kept = slow_rules(kept)
        elif number == 1:
            gone = set(slow_dropped_lines([r[:2] for r in kept], 8))
            lines = {d: [x for i, x in enumerate(t.split("\n")) if (d, i) not in gone] for d, t, _ in kept}
            kept = [(d, "\n".join(lines[d]), s) for d, _, s in kept if any(map(words, lines[d]))]
        elif number == 2:
            found = slow_components([r[:2] for r in kept], 5, 8, 10)
            kept = [r for r in kept if found[r[0]][1] == r[0]]
        elif number == 3:
            mixture = slow_mix(kept)
            assert collections.Counter((r.doc_id, r.text) for r in out.collect()) == collections.Counter(mixture)
        else:
            encode = Tokenizer.from_file(packing.tokenizer_path()).encode
            pieces = collections.Counter()
            for d, t in mixture:
                ids = [*encode(t, add_special_tokens=False).ids, 0]
                pieces.update((d, at // 2048, zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for at in range(0, len(ids), 2048))
            rows = out.collect()
            assert collections.Counter((r.doc_id, r.piece, r.ids_crc32) for r in rows) == pieces
            assert max(sum(r.length for r in rows if r.sequence_id == k) for k in {r.sequence_id for r in rows}) <= 2048
        if number < 3:
            assert sorted((r.doc_id, r.text, r.source) for r in out.collect()) == sorted(kept), name
            assert len(kept) > 20
        docs = out
