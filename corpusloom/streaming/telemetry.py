"""Telemetry as streams: rolling rates with a bounded history, and metrics merged by step in a sink that replays don't change."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Milliseconds without a row after which a run's history is forgotten.
IDLE_MS = 7 * 24 * 3600 * 1000
#: What :func:`rolling` needs of the session when its stream begins: a store of several states, and no batches that only wait for timers.
NEEDS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


class _Rolling(StatefulProcessor):
    """Keeps of each run how many rows it has had, and the last ``window`` of them."""

    def __init__(self, run: str, order: list[str], clock: str, batch: int, window: int, idle_ms: int):
        self.run, self.order, self.clock, self.batch, self.window, self.idle_ms = run, order, clock, batch, window, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "clock double")
        self.seen = handle.getValueState("seen", "n long, touched long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        n = self.seen.get()[0] if self.seen.exists() else 0
        before = [r[0] for r in self.last.get()] if self.last.exists() else []
        clock = np.concatenate([np.array(before, float), new[self.clock].to_numpy(float)])
        now = int(time.time() * 1000)
        self.seen.update((n + len(new), now))
        self.last.put([(float(c),) for c in clock[-self.window :]])
        self.handle.registerTimer(now + self.idle_ms)
        at = np.arange(len(before), len(clock))
        at = at[at >= self.window]
        took = clock[at] - clock[at - self.window]
        rate = np.divide(self.batch * self.window, took, out=np.full(len(at), np.nan), where=took != 0)
        rates = pd.Series(rate, dtype="object").where(took != 0, None)
        yield pd.DataFrame({self.run: pd.Series([key[0]] * len(at), dtype=new[self.run].dtype), "iter": n + at - len(before) + 1, "samples_per_sec": rates})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists() and self.seen.get()[1] + self.idle_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
            self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def rolling(events: DataFrame, run: str, order: list[str], clock: str, batch: int, window: int, idle_ms: int = IDLE_MS) -> DataFrame:
    """run, iter and samples_per_sec over the last ``window`` steps of each run, for append mode.

    Rows of a run come in order from batch to batch; within a batch they are
    sorted. A run's state is ``window`` numbers and a count, and is dropped when the
    run has been idle. The session must be as :func:`started` sets it.
    """
    kind = events.schema[run].dataType.simpleString()
    machine = _Rolling(run, order, clock, batch, window, idle_ms)
    return events.groupBy(run).transformWithStateInPandas(machine, f"{run} {kind}, iter long, samples_per_sec double", "Append", "ProcessingTime")


def started(out: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs a stream over all that is there, into Parquet files under ``path``; goes on from ``checkpoint`` when started anew."""
    spark = out.sparkSession
    before = {k: spark.conf.get(k, None) for k in NEEDS}
    try:
        for k, v in NEEDS.items():
            spark.conf.set(k, v)
        return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def merged(metrics: DataFrame, path: str, checkpoint: str, step: str, seq: str, name: str, value: str) -> StreamingQuery:
    """Writes a stream of (step, seq, name, value) so that :func:`current` shows the last value of each metric at each step.

    Each batch has a folder of its own, named by its id and written whole: a batch
    that is replayed after a failure replaces what it wrote before. Rows without a
    step or a value drop out.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        last = batch.filter(F.col(step).isNotNull() & F.col(value).isNotNull()).groupBy(step, name).agg(F.max_by(value, seq).alias(value), F.max(seq).alias(seq))
        last.write.mode("overwrite").parquet(batch_path(path, batch_id))

    return metrics.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_path(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/batch_id={batch_id}"


def current(spark: SparkSession, path: str, step: str, seq: str, name: str, value: str) -> DataFrame:
    """The merged table, long: step, name, value."""
    return spark.read.parquet(path).groupBy(step, name).agg(F.max_by(value, seq).alias(value))
