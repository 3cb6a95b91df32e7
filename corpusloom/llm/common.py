"""What the operators share: reading tables, cutting lineage, size checks."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.shared import small_arrow_batches  # noqa: F401 - the operators take it from here

#: Words of the contracts: anything but ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"

#: A side with at most this many rows of fixed width (up to about 100 bytes) may be broadcast.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session with a local master, as in tests, may do without: it gets a
    temporary folder. On a cluster such a folder would be one machine's alone.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not named and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusloom-"))
    return named or context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/corpusloom/{name}-{uuid.uuid4().hex}"


class _Work(threading.local):
    """The folders written by each operator that is at work in a thread, the innermost last."""

    def __init__(self):
        self.written: list[list[str]] = []


_WORK = _Work()


def stored(df: DataFrame, name: str = "table", compression: str | None = None, **options) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    The written rows survive a lost executor, and a later read prunes columns. ``options`` are the writer's.
    """
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path, compression=compression)
    if _WORK.written:
        _WORK.written[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can write."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tidied(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator with its result written, and all that it stored on the way deleted; for results that are small beside the texts."""

    @wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        _WORK.written.append(paths := [])
        try:
            out = operator(*args, **kwargs)
            spark, path = out.sparkSession, new_path(out.sparkSession, operator.__name__)
            out.write.parquet(path)
        finally:
            _WORK.written.pop()
        for x in paths:
            removed(spark, x)
        if _WORK.written:
            _WORK.written[-1].append(path)
        return spark.read.schema(out.schema).parquet(path)

    return run


def broadcast_if_small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows allow it, else for a shuffled join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= most else df.hint("merge")


def words(text: Column) -> Column:
    """Words of a text (null: none) as an array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
