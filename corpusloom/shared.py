"""Tables on the way to a result, in the folder that driver and executors share; bounds on what a Python worker holds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session with a local master may do without, and gets a temporary folder."""
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not named and context.getCheckpointDir() is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table that a lost executor doesn't take along."""
    path = f"{shared_dir(df.sparkSession)}/corpusloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_arrow_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that very long texts don't add up in a worker.

    Sets two options of the session, downwards only; a longer text still travels whole, in a batch of its own.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = _bytes(spark.conf.get(key))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def _bytes(size: str) -> int:
    """A number of Spark's options, with or without a unit; 0 if it can't be read."""
    digits, unit = size.rstrip("bBkKmMgG"), size.lower().rstrip("b")[-1:]
    return int(digits) << {"k": 10, "m": 20, "g": 30}.get(unit, 0) if digits.isdigit() else 0


def at_a_time(texts: list[str], most: int) -> Iterator[list[str]]:
    """The texts in runs of about ``most`` characters; a longer text is taken alone, and whole."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run
