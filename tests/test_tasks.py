import json

import pytest
from pyspark.sql import functions as F

from corpusloom import __main__, config, streaming
from corpusloom.operators import pipelines, tokenise


def causal(base, out):
    return {"task": "tokenization", "seed": 3, "test_size": 0.5, "tokenizer": {"task": "clm_training", "context_length": 16, "overlap": 4, "vocab_size": 50}, "dataset": {"source": "local", "nameOrPath": base, "format": "files"}, "output": {"path": out}}


def test_faults():
    assert config.faults(causal("x", "y")) == []
    assert config.faults({"task": "other"})[0].startswith("[task]")
    bad = causal("x", "y")
    bad["tokenizer"] |= {"overlap": 16}
    assert config.faults(bad) == ["[tokenizer/overlap] must be less than the sequence length"]
    del bad["tokenizer"]["task"], bad["output"]
    assert config.faults(bad) == ["[tokenizer/task] is missing", "[output] is missing"]
    merge = {"task": "dataset_merge", "datasets": [{"path": "a", "percentage": 11}], "output_path": "o"}
    assert config.faults(merge) == ["[datasets/0/percentage] must be a number from 0.01 to 10.0", "[datasets] needs at least two"]


@pytest.mark.parametrize("missing", ["source", "output"])
def test_each_missing_key_is_told(missing):
    full = {"task": "anonymization", "source": "s", "output": "o"}
    del full[missing]
    assert config.faults(full) == [f"[{missing}] is missing"]


def test_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(f"line {k} of words " + "w " * k + "mail me@x.org" for k in range(20)))
    out = str(tmp_path / "tok")
    pipelines.tokenization(spark, causal(str(tmp_path / "in"), out))
    got = spark.read.parquet(out)
    assert {r["split"]: r["n"] for r in got.groupBy("split").agg(F.count_distinct("row_id").alias("n")).collect()} == {"train": 10, "valid": 10}
    pipelines.dataset_merge(spark, {"datasets": [{"path": out, "percentage": 0.5}, {"path": out, "percentage": 2.0}], "output_path": str(tmp_path / "merged"), "shuffle_seed": 1})
    sizes = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    assert {r["split"]: r["count"] for r in spark.read.parquet(str(tmp_path / "merged")).groupBy("split").count().collect()} == {k: n // 2 + 2 * n for k, n in sizes.items()}
    pipelines.anonymization(spark, {"source": str(tmp_path / "in"), "output": str(tmp_path / "anon")})
    assert spark.read.parquet(str(tmp_path / "anon")).filter("text LIKE '%[EMAIL]%'").count() == 20


def test_command_line(tmp_path, capsys):
    f = tmp_path / "c.json"
    f.write_text(json.dumps(causal("x", "y")))
    assert __main__.main(["--config", str(f), "--validate"]) == 0
    f.write_text(json.dumps({"task": "anonymization"}))
    assert __main__.main(["--config", str(f)]) == 1 and "[source] is missing" in capsys.readouterr().err


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(k, "a b c d e f g h " * k) for k in range(1, 5)], "id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    vocab = tokenise.vocabulary(docs, "text", 10)
    stream = streaming.chunk_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs")), "text", vocab, 8, 2)
    q = stream.writeStream.format("memory").queryName("chunks").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = tokenise.causal_chunks(tokenise.encode(docs, "text", vocab).drop("text"), 8, 2)
    assert sorted(map(str, spark.table("chunks").collect())) == sorted(map(str, want.collect()))
    timed = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS k, 1.0D AS v UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 2.0D")
    assert [(r["rows"], r["total"]) for r in streaming.throughput(timed, "ts", "v", "k").collect()] == [(2, 3.0)]
