"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes (A-Z lower-cased) are embedded; filters of several widths run over them, each filter's largest response in a window is kept, and a
softmax over these gives the language. Training takes windows of a bounded sample: `WINDOWS_PER_TEXT` windows, spread over
the whole text, of at most `PER_LANGUAGE` texts of each language, those with the least hash of doc_id. For prediction, embedding and filters are folded into tables by byte pair,
and every window of every whole text is read; a text's probabilities are its windows' means, weighted by letters.

Defined cases: null text or text without a letter gives `und` with score 0; languages that are not learned are never
predicted; equal probabilities give the language first in order; with nothing to learn from every text gives `und`; an empty table gives an empty result; repeated rows are
predicted one by one; other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strokelake.llm.common import crc_mod

PER_LANGUAGE = 1000
WINDOWS_PER_TEXT = 3
LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
STEPS = 300
BATCH = 96
UNKNOWN = "und"
HELD_OUT_OF, HELD_OUT_IS = 3, 1

# Weight of a byte: 1 for A-Z, a-z and bytes of non-ASCII characters.
LETTER = np.array([(65 <= b <= 90) or (97 <= b <= 122) or b >= 128 for b in range(256)], np.float32)


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Zero-padded windows over the whole of each text, and which text each comes from."""
    counts = np.array([max(1, -(-len(t) // LENGTH)) for t in texts], np.int64)
    padded = b"".join(t.ljust(int(c) * LENGTH, b"\0") for t, c in zip(texts, counts, strict=True))
    return np.frombuffer(padded, np.uint8).reshape(-1, LENGTH), np.repeat(np.arange(len(texts)), counts)


class Network:
    def __init__(self, languages: list[str], seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        k = len(WIDTHS) * FILTERS
        self.p = {"e": rng.normal(size=(256, EMBEDDING)).astype("f4") * 0.5, "u": rng.normal(size=(k, len(languages))).astype("f4") * 0.1, "c": np.zeros(len(languages), "f4")}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(size=(w * EMBEDDING, FILTERS)).astype("f4") / np.sqrt(w * EMBEDDING / 2)
            self.p[f"b{w}"] = np.zeros(FILTERS, "f4")

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        embedded = p["e"][x]
        pooled, saved = [], []
        for w in WIDTHS:
            patches = np.lib.stride_tricks.sliding_window_view(embedded, w, axis=1).transpose(0, 1, 3, 2).reshape(n, LENGTH - w + 1, -1)
            response = patches @ p[f"w{w}"] + p[f"b{w}"]
            at = response.argmax(1)
            best = np.take_along_axis(response, at[:, None, :], 1)[:, 0]
            pooled.append(np.maximum(best, 0))
            saved.append((patches[np.arange(n)[:, None], at], at, best > 0))
        h = np.hstack(pooled)
        probability = softmax(h @ p["u"] + p["c"])
        d = probability.copy()
        d[np.arange(n), y] -= 1
        d /= n
        g = {"u": h.T @ d, "c": d.sum(0)}
        dh = d @ p["u"].T
        de = np.zeros_like(p["e"])
        for i, w in enumerate(WIDTHS):
            patch, at, on = saved[i]
            dr = dh[:, i * FILTERS : (i + 1) * FILTERS] * on
            g[f"w{w}"] = np.einsum("nfd,nf->df", patch, dr)
            g[f"b{w}"] = dr.sum(0)
            dp = (dr[:, :, None] * p[f"w{w}"].T[None]).reshape(n, FILTERS, w, EMBEDDING)
            where = x[np.arange(n)[:, None, None], at[:, :, None] + np.arange(w)]
            for k in range(EMBEDDING):
                de[:, k] += np.bincount(where.ravel(), weights=dp[..., k].ravel(), minlength=256)
        de[0] = 0  # padding stays at zero
        return g | {"e": de}

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.p["e"][0] = 0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        by_class = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        for step in range(1, STEPS + 1):
            rows = np.array([rng.choice(by_class[k]) for k in rng.integers(len(by_class), size=BATCH)])  # classes weigh the same
            for k, g in self.gradients(x[rows], y[rows]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] = (self.p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype("f4")

    def tables(self) -> None:
        """Responses to single bytes and to byte pairs at each place of each filter."""
        self.table: dict[int, list[tuple[int, bool, np.ndarray]]] = {}
        for w in WIDTHS:
            single = [self.p["e"] @ self.p[f"w{w}"][j * EMBEDDING : (j + 1) * EMBEDDING] for j in range(w)]
            single[0] = single[0] + self.p[f"b{w}"]
            steps = [(j, True, (single[j + 1][:, None] + single[j][None]).reshape(65536, FILTERS)) for j in range(0, w - 1, 2)]
            self.table[w] = steps + [(w - 1, False, single[w - 1])] * (w % 2)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax for windows, some at a time."""
        out = np.empty((len(x), len(self.languages)), "f4")
        for at in range(0, len(x), 64):
            part = x[at : at + 64].astype(np.intp)
            pairs = part[:, :-1] + (part[:, 1:] << 8)
            pooled = []
            for w in WIDTHS:
                total = None
                for j, paired, table in self.table[w]:
                    ids = (pairs if paired else part)[:, j : j + LENGTH - w + 1]
                    total = table.take(ids, axis=0) if total is None else np.add(total, table.take(ids, axis=0), out=total)
                pooled.append(np.maximum(total.max(axis=1), 0))
            out[at : at + 64] = softmax(np.hstack(pooled) @ self.p["u"] + self.p["c"])
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if known:
            x, owner = windows_of([texts[i].encode().lower() for i in known])
            weight = LETTER[x].sum(1) + 1e-3
            probability = self.probabilities(x) * weight[:, None]
            mean = np.stack([np.bincount(owner, weights=c, minlength=len(known)) for c in probability.T], 1)
            mean /= np.bincount(owner, weights=weight, minlength=len(known))[:, None]
            best = mean.argmax(1)
            for i, k, s in zip(known, best, mean.max(1), strict=True):
                names[i], scores[i] = self.languages[k], min(1.0, max(0.0, float(s)))
        return names, scores


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(learn: DataFrame, per_language: int = PER_LANGUAGE) -> Network | None:
    """From rows (doc_id, text, lang). The sample that comes to the driver has at most `per_language` cuts of texts a language."""
    # training reads a few windows of each sampled text: one from each equal part of it, at a place by hash
    part = F.greatest(F.lit(1), F.floor(F.length("text") / WINDOWS_PER_TEXT)).cast("int")
    cuts = F.array(*[F.col("text").substr(1 + i * part + F.pmod(F.xxhash64("doc_id", F.lit(i)), part).cast("int"), F.lit(LENGTH)) for i in range(WINDOWS_PER_TEXT)])
    # rows are ranked with their cuts, so rows that share a doc_id are rows of their own, and each task hands on `per_language` a language
    some = learn.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang", cuts.alias("cuts"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "cuts")
    rows = some.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_language).drop("r").collect()
    rows.sort(key=lambda r: (r.lang, r.doc_id if r.doc_id is not None else -1, r.cuts))
    if not rows:
        return None
    languages = sorted({r.lang for r in rows})
    net = Network(languages)
    cut = [(c.encode().lower()[:LENGTH].ljust(LENGTH, b"\0"), languages.index(r.lang)) for r in rows for c in r.cuts if any(map(str.isalpha, c))]
    if not cut:
        return None
    languages_seen = {k for _, k in cut}
    if len(languages_seen) < len(languages):
        net = Network([languages[k] for k in sorted(languages_seen)])
        cut = [(c, net.languages.index(languages[k])) for c, k in cut]
    x, y = np.frombuffer(b"".join(c for c, _ in cut), np.uint8).reshape(-1, LENGTH), np.array([k for _, k in cut])
    net.train(x, y)
    return net


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score). Learns from rows whose crc32(doc_id as text) mod 3 is not 1."""
    held = F.coalesce(crc_mod("doc_id", HELD_OUT_OF) == HELD_OUT_IS, F.lit(False))
    net = fit(docs.where(~held).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), per_language)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if net:
            net.tables()
        for batch in batches:
            names, scores = [], []
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(1)[at : at + 256].to_pylist()
                a, b = net.predict(texts) if net else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
                names += a
                scores.append(b)
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
