"""Queries that run as streams over the events, to their end, and read what these have written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import telemetry as T
from corpusloom.plans import runs
from corpusloom.plans.common import table
from corpusloom.shared import shared_dir
from corpusloom.streaming import telemetry as S


def events_stream(spark: SparkSession, sf_dir: str, files: int = 4) -> DataFrame:
    # As a pattern, since a stream takes the path of a single file for a folder.
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/event[s].parquet")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"


def stream_rolling_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rates of rolling_throughput from a stream with state."""
    e = events_stream(spark, sf_dir, 1_000_000).select("user_id", "event_id", F.expr(runs.MICROS).alias("us")).withColumn("clock", F.col("us") / 1e6)
    base = _folder(spark, "stream-rates")
    S.started(S.rolling(e, "user_id", ["us", "event_id"], "clock", 8, 2), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("user_id", "iter", F.round("samples_per_sec", 9).alias("samples_per_sec"))


def stream_metric_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of metric_table from a stream into a sink by batches."""
    e = events_stream(spark, sf_dir).select(F.expr(f"{runs.MICROS} div 3600000000").alias("step"), "event_id", "event_type", "value")
    base = _folder(spark, "stream-metrics")
    S.merged(e, f"{base}/out", f"{base}/state", "step", "event_id", "event_type", "value").awaitTermination()
    found = S.current(spark, f"{base}/out", "step", "event_id", "event_type", "value")
    names = T.metric_names(table(spark, sf_dir, "events"), "event_type")
    return found.groupBy("step").pivot("event_type", names).agg(F.first("value"))


QUERIES = {f.__name__: f for f in (stream_rolling_throughput, stream_metric_merge)}
ORACLES = {"stream_rolling_throughput": runs.ORACLES["rolling_throughput"], "stream_metric_merge": runs.ORACLES["metric_table"]}
