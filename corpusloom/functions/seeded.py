"""Seeded order and uniforms from md5: the same on every engine, at every retry and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def place(seed: int, key: Column) -> Column:
    """A digest that puts rows into a seeded order."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def uniform_sql(text: str) -> str:
    """A uniform from [0, 1) by the string expression ``text``, in Spark SQL."""
    return f"(cast(conv(substr(md5({text}), 1, 8), 16, 10) AS bigint) / 4294967296.0D)"


def uniform_duckdb(text: str) -> str:
    return f"(CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) / 4294967296.0)"
