"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

Statistics of each whole text are standardised and mapped to cosines of random projections, whose products approximate
a Gaussian kernel. Each partition sums its share of the normal equations; Spark adds the shares entry by entry, and the
driver solves one system of fixed size. Scores of the learning rows are counted in bins of fixed number, and pooling
adjacent violators over the bins gives the calibration.

Defined cases: null and empty texts have all-zero counts and are scored from them; documents without labels are scored;
a document labelled twice counts twice in learning; without any label to learn from the score is 0.5; an empty table
gives an empty result; other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strokelake.llm.common import crc_mod, written

N_FEATURES = 24
DIMENSIONS = 256
WIDTH = 4.0  # of the kernel, in standard deviations
RIDGE = 1e-3
BINS = 1000
THRESHOLD = 0.3
HELD_OUT_OF = 5


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars.encode("latin-1"))] = 1
    return out


# Bytes counted together; fixed values.
CLASSES = np.stack([
    _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("abcdefghijklmnopqrstuvwxyz"), _mask("0123456789"), _mask(" \t\r\v\f"), _mask("\n"),
    _mask(".,;:?"), _mask("!"), _mask("#*$%&"), _mask("|"), _mask("<>{}[]()=+/\\_~^@"), _mask("\"'-"),
])


def statistics(text: str | None) -> np.ndarray:
    raw = (text or "").encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, nw, nl = max(len(raw), 1), max(len(words), 1), max(len(lines), 1)
    counts = CLASSES @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    ids: dict[bytes, int] = {}
    h = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(h) > 2:
        windows = (h[:-2] * (1 << 42)) ^ (h[1:-1] * (1 << 21)) ^ h[2:]
        fresh = len(np.unique(windows)) / len(windows)
    else:
        fresh = 1.0
    top = np.bincount(h).max() / nw if len(h) else 0.0
    ends = sum(x.rstrip()[-1:] in b".!?\"" for x in lines) / nl
    long_lines = max(map(len, lines)) if lines else 0
    shouted = sum(1 for w in words if w.isupper() and len(w) > 1) / nw
    return np.array([
        *(np.sqrt(counts / n)), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        len(ids) / nw, fresh, len(set(lines)) / nl, top, ends, np.log1p(long_lines), shouted, np.log1p(len(words) / nl),
    ])


def features(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, x)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(describe, f"doc_id {kind}, x array<double>")


class Model:
    """Standardisation, random projection, ridge weights, and calibration points."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(len(mean), DIMENSIONS)) / WIDTH
        self.b = rng.uniform(0, 2 * np.pi, DIMENSIONS)
        self.beta = np.zeros(DIMENSIONS + 1)
        self.at = self.value = np.array([0.0, 1.0])

    def phi(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / DIMENSIONS) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.phi(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.value), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)


def isotonic(count: np.ndarray, total: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators; returns the blocks' mean places and mean labels."""
    blocks: list[list[float]] = []
    for c, t, a in zip(count, total, at, strict=True):
        blocks.append([c, t, a * c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last, strict=True)]
    x, y = np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])
    return x, y


def fit(learn: DataFrame, seed: int = 7) -> Model | None:
    """From rows (x, y)."""
    columns = [f(F.col("x")[i]).alias(f"{name}{i}") for i in range(N_FEATURES) for name, f in (("m", F.avg), ("s", F.stddev_pop))]
    stats = learn.agg(F.count("*").alias("n"), *columns).first()
    if not stats["n"]:
        return None
    mean = np.array([stats[f"m{i}"] for i in range(N_FEATURES)])
    scale = np.array([stats[f"s{i}"] for i in range(N_FEATURES)])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), seed)
    size = DIMENSIONS + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                z, y = model.phi(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False)
                total += z.T @ np.c_[z, y]
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    shares = learn.select("x", F.col("y").cast("double")).mapInArrow(sums, "i int, j int, v double")
    equations = np.zeros((size, size + 1))
    for row in shares.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # fixed number of entries
        equations[row.i, row.j] = row.v
    penalty = np.eye(size) * RIDGE * stats["n"] / DIMENSIONS
    penalty[-1, -1] = 0
    model.beta = np.linalg.solve(equations[:, :-1] + penalty, equations[:, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, place = np.zeros(BINS), np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            if batch.num_rows:
                raw, y = model.raw(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False)
                for out, w in ((count, None), (total, y), (place, raw)):
                    out += np.bincount(_bin(raw), weights=w, minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(range(BINS), pa.int32()), pa.array(count), pa.array(total), pa.array(place)], names=["bin", "n", "y", "at"])

    bins = learn.select("x", F.col("y").cast("double")).mapInArrow(binned, "bin int, n double, y double, at double")
    found = bins.groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("n", "y", "at")]).where("n > 0").orderBy("bin").collect()
    n, y, at = (np.array([r[c] for r in found]) for c in ("n", "y", "at"))
    model.at, model.value = isotonic(n, y, at / n)
    return model


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted). Learns from labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    described = written(features(docs), "statistics")
    known = labels.where(F.col(label).isNotNull() & (crc_mod("doc_id", HELD_OUT_OF) != 0)).select(F.col("doc_id").alias("known"), F.col(label).cast("double").alias("y"))
    learn = written(described.join(known, F.col("doc_id") == F.col("known")).select("x", "y"), "learn")
    model = fit(learn)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch.column(1))) if model and batch.num_rows else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = described.mapInArrow(score, f"doc_id {kind}, score double")
    held = F.coalesce(crc_mod("doc_id", HELD_OUT_OF) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
