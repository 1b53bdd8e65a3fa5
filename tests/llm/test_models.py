"""Operators with models or indexes: held-out accuracy, recall, round trips."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strokelake.llm import ann_search, html_extraction, language_id, quality_classifier, warc_fixity

SYLLABLES = {"aa": ["tha", "ing", "ou"], "bb": ["sch", "ein", "\xfcb"], "cc": ["ci\xf3n", "os", "a\xf1"]}


def test_language_id(spark):
    rng = random.Random(1)
    rows = []
    for i in range(240):
        lang = list(SYLLABLES)[i % 3]
        text = " ".join("".join(rng.choices(SYLLABLES[lang], k=3)) for _ in range(rng.randint(5, 200)))
        rows.append((i, text, lang if i % 7 else None, 1.0, "x"))
    rows += [(900, None, "aa", 1.0, "x"), (901, "", "aa", 1.0, "x"), (902, "12 ## 34", "bb", 1.0, "x"), (None, "thaing ou", None, 1.0, "x"), rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    got = language_id.identify(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    held = [i for i in range(240) if by[i].held_out]
    assert 50 < len(held) < 110
    assert np.mean([by[i].lang_pred == list(SYLLABLES)[i % 3] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    none = df.where("false")
    assert language_id.identify(none).count() == 0
    assert {r.lang_pred for r in language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_whole_texts_are_read():
    net = language_id.Network(["a", "b"])
    net.tables()
    x, owner = language_id.windows_of([b"q" * 1000, b"", b"z"])
    assert owner.tolist() == [0, 0, 0, 0, 1, 2] and x[:4].astype(bool).sum() == 1000


def test_quality(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) + ("" if good else "###") for _ in range(rng.randint(20, 120)))
        rows.append((i, text, 0.0))
        if i % 5:
            labels.append((i, int(good)))
    rows += [(1000, None, 0.0), (1001, "", 0.0), (None, "x y", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels, (7, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_classifier.classify(df, lab).collect()}
    assert len(got) == len(rows)
    held = [(int(i % 4 != 0), got[i].score) for i in range(400) if got[i].held_out]
    good, bad = [s for y, s in held if y], [s for y, s in held if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())
    assert {r.score for r in quality_classifier.classify(df, lab.where("false")).collect()} == {0.5}
    assert quality_classifier.classify(df.where("false"), lab).count() == 0


def test_isotonic():
    x, y = quality_classifier.isotonic(np.array([2.0, 2, 2, 2]), np.array([0.0, 2, 1, 2]), np.array([0.1, 0.2, 0.3, 0.4]))
    assert np.all(np.diff(y) > 0) and np.allclose(y, [0, 0.75, 1]) and np.allclose(x, [0.1, 0.25, 0.4])


PAGE = """<html><head><title>t</title><script>var a = "<p>no</p>";</script></head><body><header><a href="/">Home</a> Site of many words</header>
<nav><ul><li><a>One</a><li><a>Two</a></ul></nav><div class="cookie-notice"><p>We use cookies to make this page good for you and more.</p></div>
<{tag} class="layout has-sidebar"><h1>Title &amp; more</h1><p>First   paragraph of the <em>main</em> text has &lt;b&gt; and&nbsp;many words that make it long enough to win.
<p>Second<br>paragraph with several words in it too, and then more words.</p><form><label>Your name</label><input></form><div class="ad">Buy things now</div>
<p>Third paragraph ends the text with words and words again.</p></{tag}><aside><p>Sidebar words about things you may like to read soon.</p></aside>
<section id="comments"><div class="comment"><p>I liked this text very much and want to say so with many words.</p></div></section><footer>Copyright words</footer></body></html>"""
MAIN = "Title & more First paragraph of the main text has <b> and many words that make it long enough to win. Second paragraph with several words in it too, and then more words. Third paragraph ends the text with words and words again."


def test_html(spark):
    rows = [(1, "u", PAGE.replace("{tag}", "article"), "c"), (2, "u", PAGE.replace("{tag}", "div"), "c"), (3, None, None, "c"), (4, "", "", "c"), (5, "x", "just plain words", "c"), (None, "n", "<p>a</p>", "c"),
            (6, "cut", PAGE.replace("{tag}", "article")[:900], "c"), (7, "tags", "<div><div></div>", "c"), (1, "u", PAGE.replace("{tag}", "article"), "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extraction.extract(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[1] == MAIN and by[3] == by[4] == by[7] == "" and by[5] == "just plain words"
    assert by[2].endswith(MAIN[8:]) and "cookies" not in by[2] and "Sidebar" not in by[2] and "liked" not in by[2]
    assert MAIN.startswith(by[6]) and len(by[6]) > 100
    assert html_extraction.extract(pages.where("false")).count() == 0


@pytest.mark.parametrize("tag", ["article", "main"])
def test_html_scores_decide_inside_content(tag):
    """Lists of links at either end of a content element are cut off; a heading, short paragraphs and what follows a marked element stay."""
    links = "".join(f'<li><a href="/{i}">Read this other story number {i}</a></li>' for i in range(6))
    body = "<h1>Title words</h1><p>" + "Many words of the text. " * 8 + "</p><form>" + "never shown " * 60 + "</form><ul><li>a point</li></ul><p>Short.</p>"
    page = f"<body><{tag}><ul>{links}</ul>{body}<ul>{links}</ul></{tag}><p>Out</p></body>"
    text = html_extraction.main_text(page, html_extraction.PRIOR)
    assert "other story" not in text and "never" not in text and "Out" not in text
    assert text.startswith("Title words Many") and text.endswith("text. a point Short.")


def test_html_wrapper_beats_a_little_text():
    """A few words outside a layout wrapper do not hide the text inside; a sidebar with less than the text stays out."""
    long, aside = "Many words of the text. " * 20, "Words of a side. " * 5
    wrapped = f'<body><p>Welcome to this site</p><div class="has-sidebar"><p>{long}</p></div></body>'
    assert long.strip() in html_extraction.main_text(wrapped, html_extraction.PRIOR)
    beside = f'<body><div><p>{long}</p></div><div class="sidebar"><p>{aside}</p></div></body>'
    assert html_extraction.main_text(beside, html_extraction.PRIOR) == long.strip()


TEXT = "Some words of a text that goes on. " * 12


@pytest.mark.parametrize(("page", "first", "out"), [
    (f'<article><header class="entry-header"><h1>The Title</h1></header><p>{TEXT}</p></article>', "The Title Some", None),
    (f'<div class="post"><div class="post-header"><h1>The Title</h1></div><p>{TEXT}</p></div><div class="footer"><p>Copyright by us and many more</p></div>', "The Title Some", "Copyright"),
    (f'<p>Short line here.</p><div class="layout sidebar-right"><div>{TEXT}</div></div>', "", None),
    (f'<p>Short line here.</p><div class="content social-science"><p>{TEXT}</p></div>', "", None),
    (f'<head><title>t</title><meta><body><ul><li><a>One</a><li><a>Two</a></ul><table><tr><td>{TEXT}<td>x</table>', "", None),
])
def test_html_pages_of_other_kinds(page, first, out):
    counted = html_extraction.Page(PAGE.replace("{tag}", "article")).labels()
    fitted = dict(html_extraction.PRIOR)
    for side in ("word", "tag"):
        fitted |= html_extraction.logistic({k: 50 * n for k, n in counted.items() if k[0][0] == side})
    for weights in (fitted, html_extraction.PRIOR):
        text = html_extraction.main_text(f"<html>{page}</html>", weights)
        assert TEXT.strip() in text and text.startswith(first) and not (out and out in text)


def test_html_weights_decide(spark):
    """Flat weights give other texts than fitted ones."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    weights = html_extraction.fit(pages)
    flat = {k: 1.0 if k == "word" else -0.1 if k == "tag" else 0.0 for k in weights}
    rows = [r.html for r in pages.select("html").collect()]
    assert sum(html_extraction.main_text(x, flat) != html_extraction.main_text(x, weights) for x in rows) > len(rows) / 2
    page = html_extraction.Page(rows[0])
    assert all(v <= -html_extraction.LEAST_TAG for v, tag in zip(page.scores(weights), page.tags, strict=True) if tag)


@pytest.mark.parametrize("page", ["<div>word " * 100_000, "<b><i>word " * 60_000, "<h1><b>x" + "<b>word " * 100_000, "<p>" + "<b>" * 50_000 + "<h1>word" * 20_000, "</x>" * 200_000])
def test_html_time_grows_with_length(page):
    import time

    began = time.process_time()
    html_extraction.main_text(page, html_extraction.PRIOR)
    assert time.process_time() - began < 6


@pytest.mark.parametrize("k", [1, 20])
def test_ann(spark, k):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 12)) * rng.uniform(0.5, 2, (1500, 1))
    x[700:760] = x[700]  # one vector many times
    rows = [(i, v.astype("f4").tolist(), 1) for i, v in enumerate(x)]
    bad = [(5000, None, 1), (5020, [0.0] * 12, 1), (5040, [float("nan")] * 12, 1), (5060, [None] * 12, 1), (5080, [1.0, 2.0], 1), (None, [1.0] * 12, 1), (5100, [float("inf")] * 12, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, rank int")
    got = ann_search.search(df, df.where("vec_id % 20 = 0"), k=k).collect()
    v = np.array([r[1] for r in rows], float)
    hits = 0
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert by.keys() == set(range(0, 1500, 20))
    for q, found in by.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, k + 1)) and q not in {r.vec_id for r in found} and len({r.vec_id for r in found}) == k
        s = (v * v[q]).sum(1)
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        s[q] = -np.inf
        hits += len({r.vec_id for r in found} & set(np.lexsort((np.arange(1500), -s))[:k].tolist()))
    assert hits / (k * len(by)) >= 0.9
    assert ann_search.search(df.where("false"), df.where("false")).count() == 0


@pytest.mark.parametrize("hot", ["twice", "copies", "vectors"])
def test_ann_repeated_vec_ids(spark, monkeypatch, hot):
    """Repeated rows, one vec_id with many copies of a vector, one with many vectors: k distinct neighbours, as brute force finds them."""
    monkeypatch.setattr(ann_search, "SHARD", 150)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 6))
    rows = [(i, x[i]) for i in range(300)]
    if hot == "twice":
        rows *= 2
    elif hot == "copies":
        rows += [(7, 5 * x[7])] * 200
    else:
        rows += [(7, 5 * v) for v in rng.normal(size=(200, 6))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>").repartition(3)
    got: dict[int, list] = {}
    for r in ann_search.search(df, df.where("vec_id % 30 = 7"), lists=1).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    assert got.keys() == set(range(7, 300, 30))
    for q, found in got.items():
        best: dict[int, float] = {}
        for mine in [v for i, v in rows if i == q]:
            for i, v in rows:
                if i != q:
                    best[i] = max(best.get(i, -np.inf), round(float(mine @ v), 9))
        order = sorted(best, key=lambda i: (-best[i], i))[:20]
        assert sorted(found) == [(n, i, best[i]) for n, i in enumerate(order, 1)]


def test_warc(spark, tmp_path):
    rows = [(i, f"http://h{i % 3}/p", f"<p>text {i} \xe9</p>" * (1 + i % 5), "c") for i in range(2300)] + [(None, None, None, "c"), (None, "u", "", "c"), (7, "http://h1/p", "<p>text 7 \xe9</p>" * 3, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, hash string")
    ours = warc_fixity.records(pages)
    assert all(r.intact for r in warc_fixity.audited(ours, ours).collect())
    hit = {1, 999, 1000, 2299}
    other = warc_fixity.records(pages.withColumn("html", F.when(F.col("page_id").isin(*hit), F.translate("html", "e", "3")).otherwise(F.col("html"))))
    got = warc_fixity.audited(ours, other).collect()
    assert len(got) == len(rows) and {r.page_id for r in got if not r.intact} == hit
    for f in {r.file_id for r in got}:
        ranges = sorted((r.place, r.offset, r.length) for r in got if r.file_id == f)
        assert [o for _, o, _ in ranges] == [sum(n for _, _, n in ranges[:i]) for i in range(len(ranges))]
    missing = warc_fixity.audited(ours, warc_fixity.records(pages.where("NOT page_id <=> 2000")))
    assert [r.page_id for r in missing.where("NOT intact").collect()] == [2000]
    both, odd, moved = warc_fixity.compared(warc_fixity.records(pages.where("NOT page_id <=> 1500")), ours)
    gone = odd.collect()
    assert [(r.side, r.file_id, r.matched) for r in gone] == [("theirs", 1, 0)] and moved.count() == 0
    at = {r.place: r for r in warc_fixity.leaves(ours).where("file_id = 1").collect()}[gone[0].place]
    there = both.where("side = 'theirs' AND page_id = 1500").first()
    assert at.page_id == 1500 and (at.place, at.offset, at.length) == (there.place, there.offset, there.length)
    twice = warc_fixity.records(pages.where("page_id = 3").union(pages.where("page_id = 3")).union(pages.where("page_id = 4")))
    assert [r.page_id for r in warc_fixity.audited(twice, warc_fixity.records(pages.where("page_id IN (3, 4)"))).where("NOT intact").collect()] == [3]
    raw = b"".join(bytes(r.record) for r in ours.where("file_id = 0").orderBy("page_id").collect())
    (tmp_path / "a.warc").write_bytes(raw)
    parsed = warc_fixity.parse_records(spark.read.format("binaryFile").load(str(tmp_path))).orderBy("offset").collect()
    assert len(parsed) == 1001 and {(r.url, r.payload) for r in parsed} == {(r[1], r[2]) for r in rows if r[0] is not None and r[0] < 1000}
    assert warc_fixity.audited(ours.where("false"), ours.where("false")).count() == 0


def test_warc_order_and_hot_pages(spark):
    """Lost, added, changed, repeated and moved records, against lists; a page_id that holds most rows is cut into volumes."""
    shape = "file_id long, page_id long, record binary"
    rng = np.random.default_rng(5)
    ours = [(0, i, b"r%d" % i) for i in range(700)] + [(1, i, b"s%d" % (i // 3)) for i in range(300)] + [(2, 5, b"same")] * 900 + [(2, 6, b"t%d" % i) for i in range(900)]
    theirs = [list(r) for r in ours]
    theirs[3][1], theirs[4][1] = 4, 3  # neighbours
    theirs[40][1], theirs[600][1] = 600, 40  # far apart
    for i in range(100, 164):  # a run behind another run
        theirs[i][1], theirs[i + 100][1] = i + 100, i
    for i in rng.choice(len(theirs), 40, replace=False):
        theirs[i][2] = theirs[i][2] + b"!"
    theirs = [tuple(r) for k, r in enumerate(theirs) if k % 191 != 17] + [(0, 350, b"new"), (3, 1, b"other")]
    make = lambda rows: spark.createDataFrame(rows, shape)
    got = warc_fixity.audited(make(ours), make(theirs), most=400, per_file=200).collect()
    volume = {r.hash: r.volume for r in got}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert {v for h, v in volume.items() if h in {digest(b"t%d" % i) for i in range(900)}} == set(range(5))  # 901 records, 200 a volume

    def laid(rows):
        files: dict = {}
        for f, p, b in rows:
            h = digest(b)
            parts = {0: 4, 2: 5}.get(f, 0)
            files.setdefault((f, int(h[8:16], 16) % parts if parts else 0), []).append((p, h))
        runs = {}
        for key, members in files.items():
            counts = Counter(members)
            runs[key] = [(p, h, counts[p, h]) for p, h in sorted(counts)]
        return runs

    mine, other, want = laid(ours), laid(theirs), []
    for key, runs in mine.items():
        seen, there = Counter(), {}
        for at, (_, h, n) in enumerate(other.get(key, [])):
            seen[h] += 1
            there[h, seen[h]] = (at, n)
        seen, pairs = Counter(), []
        for at, (_, h, n) in enumerate(runs):
            seen[h] += 1
            if (h, seen[h]) in there:
                pairs.append((at, *there[h, seen[h]], n))
        before = 0
        ahead = {at: sum(min(n, m) for _, t2, m, n in pairs if t2 < t) for at, t, _, _ in pairs}
        state = {}
        for at, _, m, n in pairs:
            state[at] = (min(n, m), ahead[at] != before)
            before += min(n, m)
        for at, (p, h, n) in enumerate(runs):
            k, away = state.get(at, (0, False))
            want += [(*key, p, h, i < k, away and i < k) for i in range(n)]
    assert sorted((r.file_id, r.volume, r.page_id, r.hash, r.intact, r.moved) for r in got) == sorted(want)
    assert sum(w[5] for w in want) > 130 and sum(not w[4] for w in want) > 40
    for key in mine:
        ranges = sorted((r.place, r.offset, r.length) for r in got if (r.file_id, r.volume) == key)
        assert [(p, o) for p, o, _ in ranges] == [(i, sum(n for _, _, n in ranges[:i])) for i in range(len(ranges))]


def test_recall_on_the_given_vectors(spark):
    """Of the true twenty nearest of each query, at least nine in ten are found; queries are the rows whose id divides by 20."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.v for r in rows])
    found: dict[int, set] = {}
    for r in ann_search.search(df, df.where("vec_id % 20 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(1)
        s[ids == ids[i]] = -np.inf
        true = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hits, total = hits + len(true & found[int(ids[i])]), total + len(true)
    assert total == 20 * len(found) and hits / total >= 0.9


def test_shards_copied_only_for_their_queries(spark, monkeypatch):
    """Small shards and blocks of queries: the same neighbours as one shard and one block give."""
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 5)))]
    df = spark.createDataFrame(rows + rows[:3], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, ann_search.search(df, df.where("vec_id % 5 = 0"), lists=6).collect()))
    monkeypatch.setattr(ann_search, "SHARD", 40)
    monkeypatch.setattr(ann_search, "QUERY_BYTES", 400)
    monkeypatch.setattr(ann_search, "QUERIES_AT_ONCE", 3)
    monkeypatch.setattr(ann_search, "BROADCAST_SHARDS", 0)
    assert sorted(map(tuple, ann_search.search(df, df.where("vec_id % 5 = 0"), lists=6).collect())) == whole


def test_language_tables_are_the_convolution():
    """Predictions by tables of byte pairs equal filters slid over the bytes one by one; ties go to the first language."""
    net = language_id.Network(["a", "b", "c"], seed=1)
    net.tables()
    x, _ = language_id.windows_of([bytes(range(40, 200)), b"short", b""])
    pooled = []
    for row in x:
        h = []
        for w in language_id.WIDTHS:
            responses = [net.p["e"][row[i : i + w]].reshape(-1) @ net.p[f"w{w}"] + net.p[f"b{w}"] for i in range(language_id.LENGTH - w + 1)]
            h.append(np.maximum(np.max(responses, 0), 0))
        pooled.append(np.concatenate(h))
    assert np.allclose(net.probabilities(x), language_id.softmax(np.array(pooled) @ net.p["u"] + net.p["c"]), atol=1e-5)
    net.p["u"][:], net.p["c"][:] = 0, 0
    assert net.predict(["words", None])[0] == ["a", language_id.UNKNOWN]


def test_quality_equations_are_ridge(spark):
    """Weights from sums by partition equal ridge solved on all rows at once; repeated and very long texts get scores."""
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdef", k=rng.randint(1, 8))) for _ in range(rng.randint(5, 80))) for _ in range(150)]
    rows = [(i, t, float(i % 3 == 0)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y double").repartition(7)
    learn = quality_classifier.features(df).join(df.select("doc_id", "y"), "doc_id").select("x", "y").cache()
    model = quality_classifier.fit(learn)
    x = np.array([quality_classifier.statistics(t) for t in texts])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.where(x.std(0) > 1e-9, x.std(0), 1.0))
    z, y = model.phi(x), np.array([r[2] for r in rows])
    penalty = np.eye(z.shape[1]) * quality_classifier.RIDGE * len(y) / quality_classifier.DIMENSIONS
    penalty[-1, -1] = 0
    assert np.allclose(model.raw(x), z @ np.linalg.solve(z.T @ z + penalty, z.T @ y), atol=1e-6)
    more = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(3, texts[3]), (900, " ".join(texts) * 60)], "doc_id long, text string")
    got = quality_classifier.classify(more, spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, quality int")).collect()
    assert len(got) == 152 and len({r.score for r in got if r.doc_id == 3}) == 1 and all(0 <= r.score <= 1 for r in got)
