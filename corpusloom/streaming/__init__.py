"""Extension: the stateless operators and a windowed rate over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import tokenise


def chunk_stream(docs: DataFrame, text: str, vocab: DataFrame, length: int, overlap: int) -> DataFrame:
    """Chunks of streamed documents: narrow and stateless, for append mode; ``vocab`` is a static table."""
    return tokenise.causal_chunks(tokenise.encode(docs, text, vocab).drop(text), length, overlap)


def throughput(events: DataFrame, clock: str, value: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows and values of each key in tumbling windows of event time; rows later than ``late`` drop out."""
    timed = events.withWatermark(clock, late)
    out = timed.groupBy(F.window(clock, width), key).agg(F.count("*").alias("rows"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), key, "rows", "total")


def last_by_step(batch: DataFrame, step: str, seq: str, value: str) -> DataFrame:
    """Last write wins, for use in ``foreachBatch``."""
    return batch.groupBy(step).agg(F.max_by(value, seq).alias(value))
