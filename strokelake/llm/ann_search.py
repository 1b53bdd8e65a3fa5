"""Approximate nearest neighbours by balanced posting lists.

There are about as many lists as the square root of the number of vectors, `MOST_LISTS` at most. Centroids are fitted to a
bounded sample (`LEAST_LIST` vectors a list and `LEAST_SAMPLE` at least, those with the least hash of vec_id) by k-means
that charges for crowded lists. Every vector goes to its nearest centroid's list, and vectors near a boundary to further lists
as well: those almost as near, unless a list chosen before is much nearer to them than the vector is. A query walks an
in-memory graph of centroids best-first and takes the lists whose distance is within a ratio of the nearest one. That
ratio is measured on the sample, so that its lists hold `TARGET` of the sample's own true neighbours. Inner product
becomes distance by one more coordinate that gives all vectors the same length.

Lists are cut into blocks and dealt to shards of at most `SHARD` entries. Queries go to the shards that hold their lists; a
shard that more than `QUERY_BYTES` of them ask for is copied for each such block of queries, other shards are not copied.
Each shard returns every query's best, scored in double precision on the original vectors.

Defined cases: vectors that are null, all zero, of another dimension than most, or with null or non-finite components
take no part; rows that share a vec_id count as one vector with the best of their scores, among the queries as well, and a
query never meets its own vec_id; rows with null vec_id take no part; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strokelake.llm.common import small_or_plain, written

LEAST_SAMPLE = 20_000
MOST_LISTS = 1024
SHARD = 20_000
QUERY_BYTES = 32 << 20
QUERIES_AT_ONCE = 512
BROADCAST_SHARDS = 200_000
ROWS_AT_ONCE = 8192
BOUNDARY = 0.05  # a list this much farther than the nearest is almost as near
COPIES = 4
TARGET = 0.97
DEGREE = 12
SPREAD = 0.5  # lists nearer to each other than this share of the vector's distance hold no second copy
LEAST_LIST = 64  # sample vectors a list
K = 20


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, v array<double>) of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", v.alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    if (most := rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()) is None:
        return rows
    return rows.where(F.size("v") == most["d"])


class Index:
    """Centroids, their graph and the search ratio."""

    def __init__(self, sample: np.ndarray, top: float, lists: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.top = top
        x = self.lifted(sample)
        k = max(1, min(lists, len(x) // LEAST_LIST))
        c = x[rng.choice(len(x), k, replace=False)]
        charge = np.zeros(k)
        for _ in range(12):
            near, least = np.empty(len(x), np.int64), np.empty(len(x))
            for a in range(0, len(x), ROWS_AT_ONCE):
                d = squared(x[a : a + ROWS_AT_ONCE], c)
                near[a : a + ROWS_AT_ONCE], least[a : a + ROWS_AT_ONCE] = (d + charge).argmin(1), d.min(1)
            size = np.bincount(near, minlength=k)
            charge += 0.02 * least.mean() * (size / (len(x) / k) - 1)
            for j in range(k):
                c[j] = x[near == j].mean(0) if size[j] else x[rng.integers(len(x))]
        self.c = c
        between = squared(c, c)
        np.fill_diagonal(between, np.inf)
        near = between.argsort(1)[:, : min(DEGREE, k - 1)]
        links = [set(map(int, row)) for row in near]
        for i in range(k):  # both ways, and some far links that keep the graph connected
            for j in [*links[i], (i + 1) % k, *map(int, rng.integers(k, size=3))]:
                links[i].add(j)
                links[j].add(i)
        self.links = [np.array(sorted(s - {i}), np.int64) for i, s in enumerate(links)]
        self.between = np.sqrt(squared(c, c))
        self.sizes = np.full(k, np.inf)  # entries of each list, once they are known
        self.ratio = self.measured(sample, x, rng)

    def lifted(self, v: np.ndarray) -> np.ndarray:
        return np.c_[v, np.sqrt(np.maximum(self.top**2 - (v * v).sum(1), 0))]

    def aimed(self, q: np.ndarray) -> np.ndarray:
        return np.c_[q * (self.top / np.linalg.norm(q, axis=1, keepdims=True)), np.zeros(len(q))]

    def measured(self, sample: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> float:
        """The distance ratio within which TARGET of true neighbours in the sample have a list."""
        some = rng.choice(len(sample), min(200, len(sample)), replace=False)
        scores = sample[some] @ sample.T
        scores[np.arange(len(some)), some] = -np.inf
        true = np.argsort(-scores, 1)[:, : min(K, len(sample) - 1)]
        d = np.sqrt(squared(self.aimed(sample[some]), self.c))
        needed = []
        for i, row in enumerate(true):
            for lists in self.assigned(x[row], lifted=True):
                needed.append(d[i, lists].min() / max(d[i].min(), 1e-12))
        return float(np.quantile(needed, TARGET)) if needed else np.inf

    def assigned(self, v: np.ndarray, lifted: bool = False) -> list[list[int]]:
        """Each vector's lists: the nearest, and boundary copies by the relative neighbourhood rule."""
        d = np.sqrt(squared(v if lifted else self.lifted(v), self.c))
        order = np.argsort(d, 1)[:, : COPIES * 3]
        out = []
        for row, dist in zip(order, d, strict=True):
            lists = [int(row[0])]
            for j in row[1:]:
                if len(lists) == COPIES or dist[j] > (1 + BOUNDARY) * dist[row[0]]:
                    break
                if all(self.between[i, j] >= SPREAD * dist[j] for i in lists):
                    lists.append(int(j))
            out.append(lists)
        return out

    def probed(self, q: np.ndarray, least: int) -> list[list[int]]:
        """Each query's lists: a best-first walk over the graph, kept up as long as it finds lists within the ratio, or
        the lists found hold fewer than `least` entries."""
        out, k = [], len(self.c)
        for one in self.aimed(q):
            seen = np.zeros(k, bool)
            start = np.unique(np.linspace(0, k - 1, 8).astype(int))
            seen[start] = True
            dist = np.sqrt(squared(one[None], self.c[start])[0])
            heap = list(zip(dist.tolist(), start.tolist(), strict=True))
            heapq.heapify(heap)
            best, found, held = float(dist.min()), [], 0.0
            while heap and (heap[0][0] <= best * self.ratio * 1.02 or held < least):
                at, i = heapq.heappop(heap)
                found.append((at, i))
                held += self.sizes[i]
                new = self.links[i][~seen[self.links[i]]]
                if len(new):
                    seen[new] = True
                    dist = np.sqrt(squared(one[None], self.c[new])[0])
                    best = min(best, float(dist.min()))
                    for pair in zip(dist.tolist(), new.tolist(), strict=True):
                        heapq.heappush(heap, pair)
            found.sort()
            enough = np.cumsum([self.sizes[i] for _, i in found]) - self.sizes[[i for _, i in found]]
            out.append([i for (at, i), before in zip(found, enough, strict=True) if at <= best * self.ratio or before < least])
        return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def fit(rows: DataFrame, lists: int | None = None) -> Index | None:
    found = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("top"), F.count("*").alias("n")).first()
    top = found["top"]
    if top is None:
        return None
    lists = lists or min(MOST_LISTS, max(1, round(math.sqrt(found["n"]))))
    sample = max(LEAST_SAMPLE, LEAST_LIST * lists)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).select("v").toArrow()
    return Index(matrix(chosen.column("v")), float(top), lists)


def best_of_unit(q: np.ndarray, qid: np.ndarray, v: np.ndarray, vid: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the places of a unit's entries, in order of vec_id, whose vec_id may be among the best k: ties included."""
    scores = q @ v.T
    scores[qid[:, None] == vid[None]] = -np.inf
    slack = 1e-9 * np.maximum(1, np.abs(scores).max(1, where=np.isfinite(scores), initial=0))  # block products round differently
    first = np.flatnonzero(np.r_[True, np.diff(vid) != 0])
    single = len(first) == len(vid)
    tops = scores if single else np.maximum.reduceat(scores, first, axis=1)  # the best of each vec_id
    cut = np.partition(tops, -k, axis=1)[:, -k] - slack if len(first) > k else np.full(len(q), -np.inf)
    copies = np.diff(np.r_[first, len(vid)])
    out = []
    for n, (row, low) in enumerate(zip(scores, cut, strict=True)):
        near = row >= low if single else row >= np.maximum(low, np.repeat(tops[n] - slack[n], copies))
        out.append(np.flatnonzero(near & np.isfinite(row)))
    return out


def best_of_shard(queries: pa.Table, entries: pa.Table, k: int) -> pa.Table:
    """The best k vec_ids of a shard for each query row, each with the best of its scores."""
    q, qid = matrix(queries.column("v")), queries.column("query_id").to_numpy()
    v, vid = matrix(entries.column("v")), entries.column("vec_id").to_numpy()
    unit = entries.column("unit").to_numpy()
    wanted: dict[int, list[int]] = {}
    for i, units in enumerate(queries.column("units").to_pylist()):
        for u in units:
            wanted.setdefault(u, []).append(i)
    order = np.lexsort((vid, unit))
    edges = np.flatnonzero(np.r_[True, np.diff(unit[order]) != 0, True]) if len(unit) else np.array([0])
    kept: list[list[np.ndarray]] = [[] for _ in range(len(q))]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        members = order[a:b]
        asking = np.array(wanted.get(int(unit[members[0]]), []), np.int64)
        for some in (asking[i : i + QUERIES_AT_ONCE] for i in range(0, len(asking), QUERIES_AT_ONCE)):
            for i, places in zip(some, best_of_unit(q[some], qid[some], v[members], vid[members], k), strict=True):
                kept[i].append(members[places])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, parts in enumerate(kept):
        if not parts:
            continue
        at = np.concatenate(parts)
        score = (v[at] * q[i]).sum(1)
        rank = np.lexsort((vid[at], -score))
        ids, first = np.unique(vid[at][rank], return_index=True)
        pick = rank[np.sort(first)][:k]
        out.append((np.full(len(pick), qid[i]), vid[at][pick], score[pick]))
    columns = [np.concatenate(c) if out else [] for c in (zip(*out, strict=True) if out else ([], [], []))]
    return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})


def search(vectors: DataFrame, queries: DataFrame, k: int = K, lists: int | None = None) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query vec_id's k nearest of the other vec_ids of `vectors`."""
    rows = written(usable(vectors), "vectors")
    if rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        rows = written(rows.distinct(), "vectors")
    asked = usable(queries).distinct()
    index = fit(rows, lists)
    out = "query_id bigint, vec_id bigint, score double"
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = index.assigned(matrix(batch.column(1)))
                at = np.repeat(np.arange(len(found)), [len(f) for f in found])
                taken = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array([i for f in found for i in f], pa.int32()), taken.column(0), taken.column(1)], names=["list", "vec_id", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = index.probed(matrix(batch.column(1)), COPIES * (k + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["query_id", "v", "lists"])

    posted = written(rows.mapInArrow(post, "list int, vec_id bigint, v array<double>"), "postings")
    sizes = {r["list"]: r["n"] for r in posted.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one row a list
    # A vec_id counts once a list, and COPIES over all lists at most, so a search that has held enough has met k others.
    ids = posted.groupBy("vec_id").agg(F.collect_set("list").alias("lists")).select(F.least(F.lit(1.0), COPIES / F.size("lists")).alias("n"), F.explode("lists").alias("list"))
    held = {r["list"]: r["n"] for r in ids.groupBy("list").agg(F.sum("n").alias("n")).collect()}
    index.sizes = np.array([held.get(i, 0.0) for i in range(len(index.c))])
    # A list's blocks are units of at most SHARD entries; units fill shards in order.
    units, shard, room = [], 0, SHARD
    for name in sorted(sizes):
        blocks = -(-sizes[name] // SHARD)
        for block in range(blocks):
            size = -(-sizes[name] // blocks)
            if size > room and room < SHARD:
                shard, room = shard + 1, SHARD
            units.append((name, block, blocks, len(units), shard))
            room -= size
    spark = vectors.sparkSession

    def table() -> DataFrame:  # lists and their blocks: a row for each list and SHARD entries
        return F.broadcast(spark.createDataFrame(units, "l int, block int, blocks int, unit int, shard int"))

    entries = posted.join(table(), (F.col("list") == F.col("l")) & (F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")) == F.col("block")))
    asked = written(asked.select("vec_id", "v").mapInArrow(probe, "query_id bigint, v array<double>, lists array<int>"), "queries")
    routed = asked.select("query_id", "v", F.explode("lists").alias("list")).join(table(), F.col("list") == F.col("l"))
    routed = written(routed.groupBy("query_id", "v", "shard").agg(F.collect_list("unit").alias("units")), "routed")
    # blocks of queries by shard: one row a shard
    block = max(1, QUERY_BYTES // (8 * (index.c.shape[1] - 1)))
    parts = small_or_plain(written(routed.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")), "shard-parts"), BROADCAST_SHARDS)
    routed = routed.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("query_id", "v"), F.col("parts")).cast("int"))
    entries = entries.join(parts, "shard").select("unit", "shard", "vec_id", "v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = routed.groupBy("shard", "part").cogroup(entries.groupBy("shard", "part")).applyInArrow(lambda a, b: best_of_shard(a, b, k), out)
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return best.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)
