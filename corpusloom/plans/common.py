"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(values: Column | str) -> Column:
    """An array as one string, its elements joined by commas."""
    c = F.col(values) if isinstance(values, str) else values
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def rows(spark: SparkSession, names: str, values: list[tuple]) -> DataFrame:
    """A small table written in code, built from literals."""
    out = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names.split(), r, strict=True)]) for r in values])
    return spark.range(1).select(F.inline(out))


def sql_rows(names: str, values: list[tuple]) -> str:
    """The same in SQL."""
    show = lambda v: "NULL" if v is None else repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in values)}) v({', '.join(names.split())})"
