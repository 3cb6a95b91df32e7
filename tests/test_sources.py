"""Large JSON arrays over many splits, and shards of bounded bytes."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.sources import files, json_arrays, shards


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rng.choice(['"quoted" {', "}", "]}", "\\", '\\"}', "é😀\n", "", "[{", "a, b"])
    if kind in (1, 2):
        return rng.choice([1, -2.5, True, None])
    if kind == 3:
        return "x" * rng.randrange(60)
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b}", 'c"', "text"]): value(rng, depth + 1) for _ in range(rng.randrange(4))}


def whole(spark, path):
    """The same by from_json over whole files."""
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.trim(F.regexp_replace("value", r"^[\s\x{FEFF}]+|\s+$", "")).alias("value"), F.col("_metadata.file_path").alias("path"))
    return text.select(F.explode(F.when(F.startswith("value", F.lit("[")), F.from_json("value", "array<string>")).otherwise(F.array("value"))).alias("value"), "path").filter("value IS NOT NULL")


def plain(text):
    try:
        return json.dumps(json.loads(text))
    except ValueError:  # a string among the elements
        return text


def told(df):
    return sorted((r.path.rsplit("/", 1)[1], plain(r.value)) for r in df.collect())


@pytest.mark.parametrize("split", ["300b", "2000b", "128m"])
def test_arrays_over_many_splits(spark, tmp_path, split):
    rng = random.Random(6)
    for k in range(12):
        rows = [{"id": j, "v": value(rng)} if rng.random() < 0.8 or k % 3 else value(rng, 2) for j in range(rng.randrange(60))]
        (tmp_path / f"f{k}.json").write_text(json.dumps(rows, indent=k % 3 or None, ensure_ascii=k % 2 == 0) + "\n" * (k % 2))
    (tmp_path / "one.json").write_text('{"a": {"b": [1, {"c": "}"}]}}\n')
    (tmp_path / "bare.json").write_text('{"a": 1}')
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "long.json").write_text(json.dumps([{"text": "y" * 5000 + "}" * 50}, {"text": ["z"] * 900}]))
    (tmp_path / "scalars.json").write_text('[1, "two", [3]]')
    (tmp_path / "other.txt").write_text("[}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got, tasks = told(files.json_rows(spark, str(tmp_path))), json_arrays.entries(spark, str(tmp_path)).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "other.txt").unlink()
    assert got == told(whole(spark, str(tmp_path)).filter("path NOT LIKE '%empty.json'"))
    assert tasks > 60 if split == "300b" else tasks >= 17


def test_splits_beyond_the_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(json_arrays, "BROADCAST_SPLITS", 0)
    (tmp_path / "a.json").write_text(json.dumps([{"id": k, "s": "}{" * k} for k in range(50)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200b")
    try:
        assert sorted(json.loads(r.value)["id"] for r in files.json_rows(spark, str(tmp_path)).collect()) == list(range(50))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_strings_are_skipped():
    assert json_arrays.scanned('{"a\\"}": [1]}', False) == (False, [(0, 1), (8, 1), (10, -1), (11, -1)]) or json_arrays.scanned('{"a\\"}": [1]}', False)[1][0] == (0, 1)
    assert json_arrays.scanned('} \\" ] " }', True) == (False, [(9, -1)]) and json_arrays.scanned("no end \\\\", True) == (True, [])


def test_packing():
    rng = np.random.default_rng(1)
    for most in (1, 50, 1000):
        sizes = rng.integers(1, 200, 400)
        got, shard, held = [], 0, 0
        for part in np.split(sizes, [3, 3, 90, 250]):
            own, shard, held = shards.packed(part, most, shard, held)
            got += own.tolist()
        assert got == sorted(got) and set(got) == set(range(got[-1] + 1))
        for s in set(got):
            mine = sizes[np.array(got) == s]
            assert mine.sum() <= most or len(mine) == 1
        # No shard could have taken the next one's first row.
        firsts = [got.index(s) for s in sorted(set(got))]
        assert all(sizes[a:b].sum() + sizes[b] > most for a, b in zip(firsts, firsts[1:], strict=False))


def test_no_shard_over_its_bytes(spark, tmp_path):
    rows = [(k, "w" * (50 if k % 97 else 5000), ("train", "valid")[k % 5 == 0]) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, text string, split string").repartition(3)
    out = str(tmp_path / "set")
    files.save(df, out, shard_bytes=2000)
    back = files.load(spark, out)
    assert sorted(map(tuple, back.select("id", "text", "split").collect())) == sorted(rows) and sorted(back.columns) == ["id", "split", "text"]
    sizes = [sum(len(json.dumps(r.asDict())) for r in spark.read.parquet(str(p)).collect()) for p in list((tmp_path / "set").rglob("*.parquet"))[:12]]
    counts = [spark.read.parquet(str(p)).count() for p in list((tmp_path / "set").rglob("*.parquet"))[:12]]
    assert all(s <= 2000 or n == 1 for s, n in zip(sizes, counts, strict=True))
    with pytest.raises(ValueError, match="needs room"):
        shards.save(df, str(tmp_path / "x"), 0)
    with pytest.raises(ValueError, match="named by the layout"):
        shards.save(df.withColumn("shard", F.lit(1)), str(tmp_path / "x"), 10)


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    @F.udf("string")
    def fails(k):
        if k == 77:
            raise RuntimeError("lost")
        return "x"

    df = spark.range(100).repartition(4).withColumn("text", fails("id"))
    with pytest.raises(Exception, match="lost"):
        shards.save(df, str(tmp_path / "set"), 100)
    assert not list((tmp_path / "set").rglob("part-*.parquet")) or not (tmp_path / "set" / "_SUCCESS").exists()
    assert not [p for p in (tmp_path / "set").rglob("part-*.parquet") if "_temporary" not in str(p)]
