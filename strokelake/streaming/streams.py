"""Structured Streaming: running run metrics, sessions, and token-budget batches with carried rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strokelake.operators.sampling import budget_batches
from strokelake.sources.ink import METRICS


def metrics_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(METRICS).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def running_best(metrics: DataFrame) -> DataFrame:
    """Per run the best and the last row so far; the same on a stream (update or complete mode) and on a table."""
    row = F.struct("step", "test_loss", "word_score")
    return metrics.groupBy("run").agg(F.min_by(row, F.struct("test_loss", "step")).alias("best"), F.max_by(row, "step").alias("last"))


def session_stream(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Rows (user_id, session window, n, value) with a watermark on ts."""
    windowed = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return windowed.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "value")


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BATCHES = "shard bigint, part int, batch bigint, key bigint, width int"


class Batches(StatefulProcessor):
    """One part of a shard: rows wait in list state until a pool is full, are folded into token-budget batches, longest first,
    and what is left waits on. When the watermark has passed a part's last row by `idle_ms`, its timer writes out what
    waits as batch -1."""

    def __init__(self, budget: int, step: int, block: int, pool: int, idle_ms: int) -> None:
        self.shape, self.pool, self.idle_ms = (budget, step, block), pool, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "length int, key bigint")
        self.made = handle.getValueState("made", "n bigint, timer bigint")

    def frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(int(key[0]), int(key[1]), *r) for r in rows], columns=["shard", "part", "batch", "key", "width"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(rows).sort_values(["ts", "key"], kind="stable")  # rows of one micro-batch come in no order
        waiting = [(int(n), int(k)) for n, k in self.waiting.get()]
        made, timer = self.made.get() if self.made.exists() else (0, -1)
        done = []
        for k, length in zip(new["key"], new["length"], strict=True):
            waiting.append((int(length), int(k)))
            if len(waiting) >= self.pool:
                batches, waiting = budget_batches(waiting, *self.shape)
                for width, _, members in batches:
                    done += [(made, m, width) for m in members]
                    made += 1
        if waiting:
            self.waiting.put(waiting)
        else:
            self.waiting.clear()
        if timer >= 0:
            self.handle.deleteTimer(timer)
        timer = max(timer, int(new["ts"].iloc[-1].timestamp() * 1000) + self.idle_ms)
        self.handle.registerTimer(timer)
        self.made.update((made, timer))
        yield self.frame(key, done)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        step, block = self.shape[1:]
        left = sorted((int(n), int(k)) for n, k in self.waiting.get())
        self.waiting.clear()
        made, _ = self.made.get()
        self.made.update((made, -1))
        yield self.frame(key, [(-1, k, min(block, -(-n // step) * step)) for n, k in left])

    def close(self) -> None:
        pass


def batch_stream(rows: DataFrame, budget: int, step: int, block: int, pool: int, parts: int = 1, idle: str = "10 minutes", late: str = "0 seconds") -> DataFrame:
    """Rows (shard, part, batch, key, width) from a stream of (shard, key, length, ts); see `Batches`.

    A shard is dealt to `parts` by a hash of the key, so a hot shard is folded by several tasks. Rows wait in the state store (RocksDB,
    which this sets for the session) and are written by the stream itself once the watermark, `late` behind the newest row of any shard, has passed
    a part's last row by `idle`. Back-pressure is the source's: `maxFilesPerTrigger` or the like.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    ms = int(spark.range(1).select(F.expr(f"CAST(unix_millis(TIMESTAMP'2000-01-01' + INTERVAL {idle}) - unix_millis(TIMESTAMP'2000-01-01') AS BIGINT)")).first()[0])
    dealt = rows.withWatermark("ts", late).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    return dealt.groupBy("shard", "part").transformWithStateInPandas(Batches(budget, step, block, pool, ms), BATCHES, "append", "eventTime")


def batch_fold(rows: DataFrame, budget: int, step: int, block: int, pool: int) -> DataFrame:
    """Rows (shard, batch, key, width) from a stream of (shard, key, length), on any state store: each shard gathers `pool` rows,
    folds them into token-budget batches, longest first, and carries the rest over; what waits at the end is not written."""
    out, state = "shard bigint, batch bigint, key bigint, width int", "keys array<bigint>, lengths array<int>, made bigint"

    def fold(shard: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        keys, lengths, made = held.get if held.exists else ([], [], 0)
        waiting = list(zip(map(int, lengths), map(int, keys), strict=True))
        done: list[tuple[int, int, int, int]] = []
        for frame in frames:
            for key, length in zip(frame["key"], frame["length"], strict=True):
                waiting.append((int(length), int(key)))
                if len(waiting) >= pool:
                    batches, waiting = budget_batches(waiting, budget, step, block)
                    for width, _, members in batches:
                        done += [(int(shard[0]), made, k, width) for k in members]
                        made += 1
        held.update(([k for _, k in waiting], [n for n, _ in waiting], made))
        yield pd.DataFrame(done, columns=["shard", "batch", "key", "width"])

    return rows.groupBy("shard").applyInPandasWithState(fold, out, state, "append", "NoTimeout")
