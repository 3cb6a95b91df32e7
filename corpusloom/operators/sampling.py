"""Splits, samples and merges of exact size in a seeded order.

A prefix of a seeded order is found without a global sort: keys are counted by
the first digits of their digest, running totals give the bucket in which the
wanted size is met, a large one is counted by further digits, and only the last
one's keys are ranked.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.seeded import place
from corpusloom.operators.telemetry import positions
from corpusloom.shared import written

#: Groups whose edges may be broadcast, some 100 bytes each.
BROADCAST_GROUPS = 200_000

#: Hex digits of the digest that rows are counted by at a time: 4096 buckets for each group.
DIGITS = 3
#: Rows of a bucket that are ranked; a larger one is counted by further digits first.
RANKED = 10_000


def _edges(slim: DataFrame, size: str, by: list[str]) -> DataFrame:
    """For each group (_g0, ...; n rows) the digest (_at) and key (_key) at which ``size`` is met, how many rows have both (_ties) and how many of these are in (_take)."""
    groups = [f"_g{k}" for k in range(len(by))]
    slim = slim.withColumn("_one", F.lit(1))
    edges = slim.groupBy("_one", *groups).agg(F.count("*").alias("n")).select("*", F.lit("").alias("_prefix"), F.lit(0).cast("long").alias("_before"), F.expr(f"least(cast({size} AS bigint), n)").alias("_size"))
    edges = written(edges, "prefix-sizes")
    digits = 0
    while True:
        digits = min(digits + DIGITS, 32)
        met = _within(slim, edges, groups).withColumn("_bucket", F.substring("_place", 1, digits))
        counts = met.groupBy("_one", *groups, "n", "_size", "_before", "_bucket").agg(F.count("*").alias("_k"))
        upto = F.sum("_k").over(Window.partitionBy("_one", *groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))  # over the buckets of a group
        counts = counts.withColumn("_upto", F.col("_before") + upto).filter("_upto >= _size AND _upto - _k < _size")
        edges = written(counts.select("_one", *groups, "n", "_size", F.col("_bucket").alias("_prefix"), (F.col("_upto") - F.col("_k")).alias("_before"), "_k"), "prefix-edges")
        if digits == 32 or (edges.agg(F.max("_k")).first()[0] or 0) <= RANKED:
            break
        edges = edges.drop("_k")
    tied = _within(slim, edges.drop("_k"), groups).groupBy("_one", *groups, "n", "_size", "_before", "_place", "_key").agg(F.count("*").alias("_ties"))
    upto = F.col("_before") + F.sum("_ties").over(Window.partitionBy("_one", *groups).orderBy("_place", "_key").rowsBetween(Window.unboundedPreceding, 0))
    tied = tied.withColumn("_upto", upto).filter("_upto >= _size AND _upto - _ties < _size")
    return tied.select(*groups, F.col("_place").alias("_at"), "_key", "_ties", (F.col("_size") - F.col("_upto") + F.col("_ties")).alias("_take"))


def _within(slim: DataFrame, edges: DataFrame, groups: list[str]) -> DataFrame:
    """The rows whose digest begins with their group's prefix, with what the group's edge tells."""
    named = edges.withColumnsRenamed({g: f"{g}_" for g in groups}).drop("_one")
    on = F.startswith(F.col("_place"), F.col("_prefix"))
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"{g}_"))
    return slim.join(named if groups else F.broadcast(named), on).drop("_prefix", *[f"{g}_" for g in groups])


def with_prefix(df: DataFrame, key: str, seed: int, size: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``n`` (rows of its group) and ``chosen``: among the first ``size`` (SQL over n) of the group in seeded order.

    What is looked for is the one place of each group's order at which its size is
    met, from keys and groups alone; whole rows are then compared with it where
    they are. Ties of the digest are ordered by the key; rows that share a key are
    chosen one by one in no fixed order.
    """
    groups = [f"_g{k}" for k in range(len(by))]
    slim = df.select(*[F.col(c).alias(g) for c, g in zip(by, groups, strict=True)], F.col(key).alias("_key")).withColumn("_place", place(seed, F.col("_key")))
    sizes = slim.groupBy(*groups).agg(F.count("*").alias("n"))
    edges = written(sizes.join(_edges(slim, size, list(by)).withColumnsRenamed({g: f"{g}_" for g in groups}), _same(groups), "left").drop(*[f"{g}_" for g in groups]), "prefix-found")
    named = edges.withColumnsRenamed({g: f"{g}_" for g in groups}).withColumnRenamed("_key", "_edge")
    on = F.lit(True)
    for c, g in zip(by, groups, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(f"{g}_"))
    rows = df.withColumn("_place", place(seed, F.col(key)))
    out = rows.join(F.broadcast(named) if edges.count() <= BROADCAST_GROUPS else named, on) if by else rows.join(F.broadcast(named))
    at_edge = F.coalesce((F.col("_place") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_edge")), F.lit(False))
    first = F.coalesce((F.col("_place") < F.col("_at")) | ((F.col("_place") == F.col("_at")) & F.coalesce(F.col(key) < F.col("_edge"), F.col(key).isNull() & F.col("_edge").isNotNull())), F.lit(False))
    helpers = ["_place", "_at", "_edge", "_ties", "_take", *[f"{g}_" for g in groups]]
    if edges.filter("_ties > _take").isEmpty():
        return out.withColumn("chosen", first | at_edge).drop(*helpers)
    # Rows that share the very key at the edge: as many as are wanted.
    rank = F.row_number().over(Window.partitionBy(*by, "_place").orderBy(key))
    split = out.filter(~at_edge).withColumn("chosen", first).unionByName(out.filter(at_edge).withColumn("chosen", rank <= F.col("_take")))
    return split.drop(*helpers)


def _same(groups: list[str]):
    on = F.lit(True)
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"{g}_"))
    return on


def train_valid_split(df: DataFrame, key: str, ratio: float, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``split``: ceil(n * ratio) rows of each group valid, the others train; ratio 0: all train."""
    if ratio == 0:
        return df.withColumn("split", F.lit("train"))
    out = with_prefix(df, key, seed, f"ceil(n * {ratio}D)", by)
    return out.withColumn("split", F.when(F.col("chosen"), F.lit("valid")).otherwise(F.lit("train"))).drop("n", "chosen")


def sample(df: DataFrame, key: str, fraction: float, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """int(n * fraction) rows of each group; over 1 the seeded order is repeated and cut."""
    if fraction <= 0:
        raise ValueError(f"the fraction must be over 0, not {fraction}")
    whole, rest = f"cast(floor(n * {fraction}D) AS bigint) div n", f"cast(floor(n * {fraction}D) AS bigint) % n"
    out = with_prefix(df, key, seed, rest, by)
    times = F.expr(f"{whole} + CASE WHEN chosen THEN 1 ELSE 0 END").cast("int")
    out = out.withColumn("_times", times).filter("_times > 0")
    if fraction < 1:
        return out.drop("n", "chosen", "_times")
    return out.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("n", "chosen", "_times", "_again")


def shuffled(df: DataFrame, key: str, seed: int, exact_order: bool = True) -> DataFrame:
    """``df`` in seeded order; without ``exact_order`` rows are only dealt out and sorted within partitions."""
    digest = place(seed, F.col(key))
    if exact_order:
        return df.orderBy(digest, key)
    return df.withColumn("_place", digest).repartition("_place").sortWithinPartitions("_place", key).drop("_place")


#: Rounds of the permutation, and the multipliers of its hash.
ROUNDS, MULTIPLIERS = 6, (1103515245, 1220703125)


def round_keys(seed: int) -> list[int]:
    return [int(hashlib.md5(f"{seed}-round-{k}".encode()).hexdigest()[:7], 16) for k in range(ROUNDS)]


def permuted(pos: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where a seeded permutation of 0 to n-1 sends each of ``pos``, told from the number alone.

    A Feistel network over pairs: with a * b >= n, a number is (left, right) below a and b,
    and each round adds a hash of one side to the other. What lands at n or beyond
    goes through again until it doesn't; it must come back, so all places are met once.
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = -(-n // a) if n else 1
    keys = round_keys(seed)

    def mixed(x: np.ndarray, key: int) -> np.ndarray:
        y = (x * MULTIPLIERS[0] + key) % (1 << 31)
        y = (y ^ (y >> 15)) * MULTIPLIERS[1] % (1 << 31)
        return y ^ (y >> 13)

    out = pos.astype(np.int64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] // b, out[todo] % b
        for k, key in enumerate(keys):
            if k % 2:
                right = (right + mixed(left, key)) % b
            else:
                left = (left + mixed(right, key)) % a
        out[todo] = left * b + right
        todo = todo[out[todo] >= n]
    return out


def with_place(df: DataFrame, key: str, seed: int, name: str = "place") -> DataFrame:
    """``df`` with each row's place, from 0 and without gaps, in a seeded permutation of its order by a whole-number ``key``."""
    group = "_all"
    rows = positions(df.withColumn(group, F.lit(0)), group, key).drop(group)
    n = df.count()

    def place_of(pos: pa.Array) -> pa.Array:
        return pa.array(permuted(pos.to_numpy(), n, seed), pa.int64())

    return rows.withColumn(name, F.arrow_udf(place_of, "long")(F.col("pos").cast("long"))).drop("pos")


def permuted_order(df: DataFrame, key: str, seed: int, rows: int = 1 << 20) -> DataFrame:
    """``df`` in the order of :func:`with_place`: dealt out by place, ``rows`` places a partition, and sorted there."""
    placed = with_place(df, key, seed, "_place")
    parts = max(1, -(-df.count() // rows))
    return placed.repartitionByRange(parts, "_place").sortWithinPartitions("_place").drop("_place")


def split_seed(seed: int, split: str) -> int:
    """The seed of a split's shuffle: the same in every process."""
    return seed + zlib.crc32(split.encode()) % 1000


def shuffled_splits(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``df`` dealt out and sorted within partitions in a seeded order, each split with the seed of :func:`split_seed`."""
    own = F.lit(seed) + F.pmod(F.crc32(F.coalesce(F.col("split"), F.lit("")).cast("binary")), F.lit(1000))
    digest = F.md5(F.concat(own.cast("string"), F.lit("-"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    return df.withColumn("_place", digest).repartition("_place").sortWithinPartitions("split", "_place", key).drop("_place")


def check_compatible(datasets: list[DataFrame]) -> None:
    """Raises if column names or types differ; names the first mismatch. Nullability doesn't count."""
    first = {f.name: f.dataType.simpleString() for f in datasets[0].schema}
    for k, other in enumerate(datasets[1:], 1):
        own = {f.name: f.dataType.simpleString() for f in other.schema}
        if first.keys() != own.keys():
            raise ValueError(f"dataset {k}: columns differ: {sorted(first.keys() ^ own.keys())}")
        for name, kind in first.items():
            if own[name] != kind:
                raise ValueError(f"dataset {k}: column {name} is {own[name]}, not {kind}")


def merge(datasets: list[DataFrame], key: str, fractions: list[float], seed: int = 42) -> DataFrame:
    """Samples of the datasets, each with its own seed, one after the other, with ``dataset_id``; splits are sampled each for itself."""
    if len(datasets) < 2:
        raise ValueError("a merge takes at least two datasets")
    check_compatible(datasets)
    by = ("split",) if "split" in datasets[0].columns else ()
    parts = [sample(d, key, p, seed + k, by).withColumn("dataset_id", F.lit(k)) for k, (d, p) in enumerate(zip(datasets, fractions, strict=True))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def first_per_group(df: DataFrame, by: str, order: Column, k: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("_rank") <= k).drop("_rank")
