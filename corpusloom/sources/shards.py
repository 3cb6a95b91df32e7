"""Shards of bounded bytes: rows are packed one by one, so that no file of several rows is over the bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD = "shard"


def row_bytes(df: DataFrame) -> DataFrame:
    """``df`` with ``_bytes``, a row's size as JSON."""
    return df.withColumn("_bytes", F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).cast("long"))


def packed(sizes: np.ndarray, most: int, shard: int, held: int) -> tuple[np.ndarray, int, int]:
    """A shard for each row, in order: the open one as long as the row fits, else the next. Goes on from shard and bytes held, and gives both."""
    out = np.empty(len(sizes), np.int64)
    ends = np.cumsum(sizes)
    k, base = 0, -held
    while k < len(sizes):
        # All rows up to the bound; a row that is over it alone has a shard of its own.
        upto = int(np.searchsorted(ends, base + most, side="right"))
        if upto <= k:
            if held:
                shard, held, base = shard + 1, 0, int(ends[k] - sizes[k])
                continue
            upto = k + 1
        out[k:upto] = shard
        held = int(ends[upto - 1]) - base
        k = upto
    return out, shard, held


def with_shards(df: DataFrame, most: int) -> DataFrame:
    """``df`` with ``shard``: the task's number and a number within it."""
    rows = row_bytes(df).withColumn("_task", F.spark_partition_id())
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = held = 0
        for batch in batches:
            own, shard, held = packed(batch.column("_bytes").to_numpy().astype(np.int64), most, shard, held)
            task = batch.column("_task")[0].as_py() if batch.num_rows else 0
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array([f"{task:05d}-{s:06d}" for s in own.tolist()], pa.string())], names=[*names, SHARD])

    return rows.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(SHARD, T.StringType())]))


def load(spark: SparkSession, path: str) -> DataFrame:
    """A dataset, without the column of the layout if it has it."""
    out = spark.read.parquet(path)
    return out.drop(SHARD) if any(f"/{SHARD}=" in f for f in out.inputFiles()[:1]) else out


def save(df: DataFrame, path: str, most: int, by: str | None = None) -> None:
    """Writes ``df`` as Parquet, files of at most ``most`` bytes of rows (or one larger row), below folders of ``by`` and of shards.

    Spark's commit protocol holds: what a task leaves behind when it is aborted is not part of the dataset.
    """
    if most <= 0:
        raise ValueError(f"a shard needs room, not {most} bytes")
    if SHARD in df.columns:
        raise ValueError(f"the column {SHARD} is named by the layout")
    with_shards(df, most).write.mode("errorifexists").partitionBy(*([by] if by else []), SHARD).parquet(path)
