"""Seeded prefixes and permutations against plain Python: ties, nulls, groups, sizes that are no powers of two."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import sampling as S


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 17, 64, 100, 1000, 4097, 65_537])
def test_permutation_meets_every_place_once(n):
    got = S.permuted(np.arange(n), n, 9)
    assert sorted(got.tolist()) == list(range(n))
    if n > 100:
        assert (got != np.arange(n)).mean() > 0.9 and (got != S.permuted(np.arange(n), n, 10)).mean() > 0.9
        # Neighbours don't stay together.
        assert (np.abs(np.diff(got)) == 1).mean() < 0.05


def test_places_and_order(spark):
    df = spark.createDataFrame([(k * k, f"t{k}") for k in range(1003)], "id long, text string").repartition(7)
    got = S.with_place(df, "id", 5).collect()
    want = S.permuted(np.arange(1003), 1003, 5)
    assert {r.id: r.place for r in got} == {k * k: int(p) for k, p in enumerate(want)}
    order = [r.id for r in S.permuted_order(df, "id", 5, 100).collect()]
    assert order == [k * k for k in np.argsort(want).tolist()]
    assert S.with_place(df.limit(0), "id", 5).count() == 0


@pytest.mark.parametrize("ranked", [10_000, 2])
def test_prefix_against_plain_python(spark, monkeypatch, ranked):
    monkeypatch.setattr(S, "RANKED", ranked)
    monkeypatch.setattr(S, "DIGITS", 1)
    rows = [(k, ("a", "b", None)[k % 3] if k % 10 else "c") for k in range(400)] + [(1000, "lone")]
    df = spark.createDataFrame(rows, "id long, g string").withColumn("text", F.lit("x")).repartition(5)
    for size in ("0", "n", "n + 5", "ceil(n * 0.3D)", "1"):
        got = S.with_prefix(df, "id", 3, size, ("g",)).collect()
        assert len(got) == len(rows)
        for g in ("a", "b", "c", None, "lone"):
            own = sorted((hashlib.md5(f"3-{k}".encode()).hexdigest(), k) for k, x in rows if x == g)
            most = {"0": 0, "n": len(own), "n + 5": len(own), "ceil(n * 0.3D)": -(-len(own) * 3 // 10), "1": 1}[size]
            assert {r.id for r in got if r.g == g and r.chosen} == {k for _, k in own[:most]} and {r.n for r in got if r.g == g} == {len(own)}


def test_prefix_with_shared_and_null_keys(spark):
    rows = [(7,)] * 50 + [(None,)] * 30 + [(k,) for k in range(100, 120)]
    df = spark.createDataFrame(rows, "id long")
    for size in (1, 33, 60, 99, 100):
        got = S.with_prefix(df, "id", 1, str(size)).collect()
        assert sum(r.chosen for r in got) == size and len(got) == 100
        whole = Counter(r.id for r in got if r.chosen)
        partly = [k for k, n in Counter(r[0] for r in rows).items() if 0 < whole[k] < n]
        assert len(partly) <= 1
    assert S.with_prefix(df.limit(0), "id", 1, "3").count() == 0


def test_splits_are_shuffled_by_their_own_seeds(spark):
    df = spark.createDataFrame([(k, ("train", "valid")[k % 2]) for k in range(60)], "id long, split string")
    rows = [r for part in S.shuffled_splits(df, "id", 4).withColumn("p", F.spark_partition_id()).collect() for r in [part]]
    assert sorted(r.id for r in rows) == list(range(60)) and S.split_seed(4, "train") != S.split_seed(4, "valid")
    for p in {r.p for r in rows}:
        for s in ("train", "valid"):
            ids = [r.id for r in rows if r.p == p and r.split == s]
            assert ids == sorted(ids, key=lambda k: hashlib.md5(f"{S.split_seed(4, s)}-{k}".encode()).hexdigest())
