"""Subword tokenizers, instruction sets, sinks, checkpoints, formats and rules of configurations."""

import collections
import io
import json
import pickle
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom import __main__, config
from corpusloom.operators import anonymise, checkpoints, conversations, pipelines, sampling, subword, tokenise
from corpusloom.operators import telemetry as T
from corpusloom.sources import files

public_tokenizers = pytest.importorskip("public_tokenizers")
JSON, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = ["A usual sentence, of some words.", "", None, "ünï ç😀 <|endoftext|> tail", "x" * 5000]


@pytest.mark.parametrize("path", [JSON, PIECES])
def test_subword_ids_are_the_librarys(spark, path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    use = subword.tokenizer(path)
    got = {r["doc_id"]: r for r in subword.decode(subword.encode(docs, "text", path), "ids", path, pieces="pieces").collect()}
    for i, t in enumerate(TEXTS):
        assert got[i]["ids"] == use.encode([t or ""])[0] and got[i]["decoded"] == (t or "") and len(got[i]["pieces"]) == len(got[i]["ids"])
    if path == JSON:
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        assert got[0]["ids"] == lib.encode(TEXTS[0], add_special_tokens=False).ids and use.pad == use.end == 50256
    else:
        assert use.pad == use.end == 2 and use.special[:3] == (0, 1, 2)


def test_backends_can_be_added(spark, tmp_path):
    with pytest.raises(ValueError, match="no tokenizer for .other"):
        subword.tokenizer("model.other")
    subword.register(".other", subword.PieceTokenizer)
    try:
        copy = tmp_path / "model.other"
        copy.write_bytes(open(PIECES, "rb").read())
        assert subword.encode(spark.createDataFrame([("a b",)], "text string"), "text", str(copy)).first()["ids"] == subword.tokenizer(PIECES).encode(["a b"])[0]
    finally:
        del subword.BACKENDS[".other"]
    assert [subword.partitions_for(8, w, b) for w, b in ((None, False), (3, False), (99, False), (3, True))] == [4, 3, 8, None]


def test_every_token_of_a_sample_is_told(spark):
    rows = spark.createDataFrame([(1, list(range(50)), [1] * 40 + [0] * 10, [-100] * 5 + list(range(5, 50))), (2, [7], [], [])], "id long, ids array<int>, mask array<int>, labels array<int>")
    got = subword.labelled(rows, "ids", "mask", "labels").groupBy("id").agg(F.count("*").alias("n"), F.count_if("attended").alias("a"), F.count_if("trained").alias("t")).orderBy("id").collect()
    assert [(r["n"], r["a"], r["t"]) for r in got] == [(50, 40, 45), (1, 1, 1)]


def instructions(base):
    for lang, key in (("en", "k1"), ("fr", "k2")):
        folder = base / lang / key
        folder.mkdir(parents=True)
        rows = [{"input": f"{lang} question {i}", "target": f"answer {i}", "system": " be short "} for i in range(6)]
        rows += [{"input": ["one", "two"], "assistance": ["first"], "target": "second"}, {"input": [], "target": "no question"}, 7]
        (folder / "a.json").write_text(json.dumps(rows))
        (folder / "b.json").write_text(json.dumps({"input": "single", "target": "one"}))
        (base / lang / "top.json").write_text(json.dumps([{"input": "top", "target": lang}]))
    return str(base)


def test_instruction_sources(spark, tmp_path):
    base = instructions(tmp_path / "set")
    keyed = files.read_instructions(spark, base, "files", ["k1", "k2", "none"])
    assert sorted((r["key"], r["input"][0], r["target"]) for r in keyed.collect()) == [("k1", "single", "one"), ("k2", "single", "one")]
    assert files.read_instructions(spark, base, "files", ["none"]).count() == 0
    whole = files.read_instructions(spark, base)
    assert "file" in whole.columns and whole.filter("size(input) = 2 AND assistance[0] = 'first'").count() == 2 and whole.filter("system = 'be short'").count() == 12
    langs = files.read_instructions(spark, base, "multilanguage_files", languages=["en", "xx"])
    assert [(r["language"], r["target"]) for r in langs.collect()] == [("en", "en")]
    files.save(whole.withColumn("split", F.lit("train")), str(tmp_path / "saved"))
    assert files.read_instructions(spark, str(tmp_path / "saved"), "dataset").count() == whole.count()
    with pytest.raises(ValueError, match="unknown form"):
        files.read_instructions(spark, base, "other")


@pytest.mark.parametrize(("path", "padding"), [(None, "fixed"), (JSON, "dynamic")])
def test_instruction_task(spark, tmp_path, path, padding):
    base, out = instructions(tmp_path / "set"), str(tmp_path / "out")
    tokenizer = {"task": "instruction", "max_sequence_length": 48, "masking_strategy": "response_only", "padding_strategy": padding, "vocab_size": 100} | ({"tokenizer_path": path} if path else {})
    task = {"task": "tokenization", "test_size": 0.5, "tokenizer": tokenizer, "dataset": {"source": "local", "nameOrPath": base, "format": "files"}, "output": {"path": out, "max_shard_bytes": 1000}}
    assert config.faults(task) == []
    pipelines.tokenization(spark, task)
    got = files.load_training(spark, out)
    rows = got.collect()
    assert len(rows) == 18 and {r["split"] for r in rows} == {"train", "valid"}
    sizes = {len(r[c]) for r in rows for c in ("input_ids", "attention_mask", "labels")}
    assert len(sizes) == 1 and (sizes == {48} if padding == "fixed" else sizes == {min(48, max(r["n"] for r in rows))})
    for r in rows:
        masked = sum(x == -100 for x in r["labels"][: r["n"]])
        assert 0 < masked and all(a == 0 for a in r["attention_mask"][:masked])
    if path:
        pairs = conversations.prompt_pairs(files.read_instructions(spark, base)).collect()
        use = subword.tokenizer(path)
        full = {tuple((use.encode([p["prompt_and_response"]])[0][:47] + [use.end])[:48]) for p in pairs}
        assert {tuple(r["input_ids"][: min(r["n"], 48)]) for r in rows} == full


def test_subword_causal_task(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = " ".join(f"word{k} and more" for k in range(200))
    (tmp_path / "in" / "a.txt").write_text(text)
    out = str(tmp_path / "out")
    pipelines.tokenization(spark, {"task": "tokenization", "seed": 1, "tokenizer": {"task": "clm_training", "context_length": 32, "overlap": 8, "tokenizer_path": JSON}, "dataset": {"source": "local", "nameOrPath": str(tmp_path / "in"), "format": "files"}, "output": {"path": out}})
    rows = sorted(spark.read.parquet(out).collect(), key=lambda r: r["chunk"])
    ids = subword.tokenizer(JSON).encode([text])[0]
    assert rows[0]["input_ids"] == ids[:32] and rows[1]["input_ids"] == ids[24:56] and rows[-1]["start"] + sum(rows[-1]["attention_mask"]) == len(ids)
    assert all(x == (i if a else 50256) for r in rows for x, i, a in zip(r["input_ids"], ids[r["start"] : r["start"] + 32] + [0] * 32, r["attention_mask"], strict=False))
    with pytest.raises(ValueError, match="no mask token"):
        pipelines.tokenization(spark, {"seed": 1, "tokenizer": {"task": "mlm_training", "context_length": 32, "tokenizer_path": JSON}, "dataset": {"source": "local", "nameOrPath": str(tmp_path / "in")}, "output": {"path": out}})


def test_unknown_strategy_is_told(spark):
    pairs = spark.createDataFrame([([1, 2], [1, 2, 3])], "p array<int>, f array<int>")
    with pytest.warns(UserWarning, match="unknown masking strategy"):
        row = tokenise.instruction_rows(pairs, "p", "f", 6, "other").first()
    assert row["labels"] == [-100, -100, 3, tokenise.EOS, -100, -100] and row["attention_mask"] == [1, 1, 1, 1, 0, 0]


def test_listing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, str(tmp_path / "none"))
    (tmp_path / "f.txt").write_text("x")
    with pytest.raises(NotADirectoryError):
        files.list_files(spark, str(tmp_path / "f.txt"))
    (tmp_path / "empty").mkdir()
    with pytest.warns(UserWarning, match="no files"):
        assert files.list_files(spark, str(tmp_path / "empty")).count() == 0
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "g.jsonl").write_text("{}")
    (tmp_path / "sub" / "h.md").write_text("x")
    assert files.list_files(spark, str(tmp_path)).count() == 3
    assert [(r["ext"], r["kind"]) for r in files.analysis_inputs(spark, str(tmp_path)).collect()] == [("txt", "raw"), ("jsonl", "tokenized")]


def test_sinks(spark, tmp_path):
    files.write_summary(spark, str(tmp_path / "s.json"), {"n": 1, "where": tmp_path, "é": [1.5]})
    assert json.loads((tmp_path / "s.json").read_text()) == {"n": 1, "where": str(tmp_path), "é": [1.5]}
    files.write_report(spark, str(tmp_path / "r.md"), "Title", {"Rows": spark.createDataFrame([(k, "a|b") for k in range(5)], "k int, v string")}, most=3)
    text = (tmp_path / "r.md").read_text()
    assert text.startswith("# Title\n\n## Rows\n\n| k | v |\n|---|---|\n") and text.count("a\\|b") == 3 and text.endswith("2 more not shown\n")
    problems = spark.createDataFrame([("garbled_content", "s2", "b"), ("empty_files", "s1", "z"), ("empty_files", "s1", "a"), ("empty_files", "s0", "c")], "category string, source string, name string")
    files.write_problems(problems, str(tmp_path / "p"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "p")).collect()]
    assert lines == ["[Empty Files] s0: 1", "  c", "[Empty Files] s1: 2", "  a", "  z", "[Garbled Content] s2: 1", "  b"]
    split = spark.createDataFrame([(k, "train" if k % 2 else "valid") for k in range(10)], "k int, split string")
    files.write_samples(split, str(tmp_path / "samples"), 2)
    assert spark.read.json(str(tmp_path / "samples" / "train")).count() == 2 and spark.read.json(str(tmp_path / "samples" / "valid")).count() == 2
    files.save(split.coalesce(1).drop("split"), str(tmp_path / "small"), shard_bytes=30)
    assert len(list((tmp_path / "small").rglob("part-*.parquet"))) >= 3  # a folder for each shard
    merged = T.merged_by_step(spark.createDataFrame([(1, 0, 2.0, None), (1, 1, None, 3.0), (0, 2, 1.0, None)], "step int, seq int, b double, a double"), "step", "seq", ["b", "a"])
    files.write_metrics_csv(merged, "step", str(tmp_path / "m"))
    assert [p.read_text() for p in (tmp_path / "m").glob("part-*.csv")] == ["a,b,step\n,1.0,0\n3.0,2.0,1\n"]
    assert files.validation_split(["train", "my_valid", "test"]) == "my_valid" and files.validation_split(["a", "b"]) == "a"
    assert sampling.split_seed(7, "train") == sampling.split_seed(7, "train") != sampling.split_seed(7, "valid")
    with pytest.raises(ValueError, match="labels"):
        files.required_columns(split, ["k", "labels"])


def checkpoint(path, names):
    path.parent.mkdir(parents=True, exist_ok=True)
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("archive/data.pkl", pickle.dumps(collections.OrderedDict((n, k) for k, n in enumerate(names)), protocol=2))
    path.write_bytes(body.getvalue())


def test_convert(spark, tmp_path):
    names = [f"model.layers.{k}.w" for k in range(40)] + ["lm_head.weight"]
    checkpoint(tmp_path / "in" / "run" / "e-001-gs-000010.pth", [f"model.{n}" if n != "lm_head.weight" else "model.lm_head.weight" for n in names])
    checkpoint(tmp_path / "in" / "run" / "e-002-gs-000020.pth", [f"model.{n}" for n in names[:20]])
    (tmp_path / "in" / "broken.pth").write_bytes(b"not a checkpoint")
    (tmp_path / "model.txt").write_text("\n".join(names))
    task = {"task": "convert", "source": str(tmp_path / "in"), "output": str(tmp_path / "out"), "model_parameters": str(tmp_path / "model.txt")}
    assert config.faults(task) == []
    got = {r["folder"]: r for r in pipelines.convert(spark, task).collect()}
    assert {k: r["ok"] for k, r in got.items()} == {"run_e-001-gs-000010": True, "run_e-002-gs-000020": False, "broken": False}
    assert got["run_e-001-gs-000010"]["coverage_pct"] == 100 and "covers 48.8%" in got["run_e-002-gs-000020"]["error"] and got["broken"]["error"]
    assert json.loads((tmp_path / "out" / "summary.json").read_text()) == {"source": str(tmp_path / "in"), "found": 3, "total": 3, "ok": 1, "failed": 2, "ok_pct": 33.333333333}
    assert checkpoints.discover(spark, str(tmp_path / "in" / "broken.pth")).count() == 1
    with pytest.raises(ValueError, match="no .pth files"):
        (tmp_path / "none").mkdir()
        checkpoints.discover(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        checkpoints.discover(spark, str(tmp_path / "missing"))


def test_anonymisation_formats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('é "quoted" me@x.org and 08001\nnothing')
    (tmp_path / "rules.csv").write_text('label,regex\nzip,"\\b[0-9]{5}\\b"\nEMAIL,"[a-z]+@[a-z.]+"\n')
    base = {"task": "anonymization", "source": str(tmp_path / "in"), "regexes": str(tmp_path / "rules.csv"), "labels": ["ZIP", "EMAIL"]}
    pipelines.anonymization(spark, base | {"output": str(tmp_path / "plain"), "format": "plain"})
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "plain")).collect()) == ["nothing", 'é "quoted" [EMAIL] and [ZIP]']
    pipelines.anonymization(spark, base | {"output": str(tmp_path / "doccano"), "format": "doccano"})
    rows = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "doccano")).collect()]
    assert {"text": 'é "quoted" me@x.org and 08001', "label": [[24, 29, "ZIP"], [11, 19, "EMAIL"]]} in rows and {"text": "nothing", "label": []} in rows
    for form in ("jsonl", None):
        task = base | {"output": str(tmp_path / f"kept-{form}"), "format": form, "skip_existing": True}
        for _ in range(2):
            pipelines.anonymization(spark, task)
        read = spark.read.json if form else spark.read.parquet
        assert read(task["output"]).count() == 2
    (tmp_path / "in" / "b.txt").write_text("later")
    pipelines.anonymization(spark, task)
    assert sorted(r["text"] for r in spark.read.parquet(task["output"]).collect())[0] == "later" and spark.read.parquet(task["output"]).count() == 3
    (tmp_path / "bad.csv").write_text("label,regex\nNOPE,x\n")
    with pytest.raises(ValueError, match="unknown label"):
        anonymise.rules_from_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "bad.csv").write_text("label,regex\nZIP,(\n")
    with pytest.raises(ValueError, match="can't be read"):
        anonymise.rules_from_csv(spark, str(tmp_path / "bad.csv"))


def test_rules_of_configurations(tmp_path):
    assert "overlap!" in config.rules_for({"task": "tokenization", "tokenizer": {"task": "clm_training"}})["tokenizer"]
    assert "overlap" in config.rules_for({"task": "tokenization", "tokenizer": {"task": "other"}})["tokenizer"]
    assert config.rules_for({"task": "mlm_training"}) == config.rules_for({"task": "training"})
    with pytest.raises(LookupError, match="there are rules for"):
        config.rules_for({"task": "nothing"})
    training = {"task": "clm_training", "model_name": "m", "number_epochs": 1, "batch_size": 8, "lr": 1e-4, "lr_scheduler": "fixed", "dataset": {"nameOrPath": "d"}}
    assert config.faults(training) == [] and config.faults(training | {"lr_scheduler": "x"})[0].startswith("[lr_scheduler]")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "mine.schema.json").write_text('{"": {"source!": "x"}}')
    own = config.read_rules(str(tmp_path))
    assert own["mine"] == own["sub/mine.schema.json"] == {"": {"source!": "x"}} and len(own) == 3
    (tmp_path / "a.json").write_text('{"lr": 1, "batch_size": 2}')
    (tmp_path / "b.json").write_text('{"lr": 3}')
    assert config.training_settings(str(tmp_path / "a.json"), str(tmp_path / "missing.json"), str(tmp_path / "b.json")) == {"lr": 3, "batch_size": 2}


def test_training_is_planned(spark, tmp_path):
    rows = spark.createDataFrame([([1], [1], [1], "train" if k % 5 else "valid") for k in range(100)], "input_ids array<int>, attention_mask array<int>, labels array<int>, split string")
    files.save(rows, str(tmp_path / "set"))
    task = {"task": "clm_training", "model_name": "m", "number_epochs": 3, "batch_size": 4, "lr": 0.5, "gradient_accumulation_steps": 2, "warmup_ratio": 0.1, "lr_scheduler": "warmup_linear", "validations_per_epoch": 2, "optimizer": "adamw", "output": str(tmp_path / "plan"), "dataset": {"nameOrPath": str(tmp_path / "set")}}
    assert config.faults(task) == [] and config.faults(task | {"parallelization_strategy": "x"})
    assert pipelines.RUN["clm_training"](spark, task).agg(F.max("lr"), F.max("step")).first() == (0.5, 30)
    told = json.loads((tmp_path / "plan" / "summary.json").read_text())
    assert (told["train_rows"], told["steps_per_epoch"], told["total_steps"], told["warmup_steps"], told["validation_steps"], told["validation_split"]) == (80, 20, 30, 3, [10, 20], "valid")
    with pytest.raises(ValueError, match="leaves no rows"):
        pipelines.training(spark, task | {"train_ratio": 0.001})
    files.save(rows.drop("labels"), str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="labels"):
        pipelines.training(spark, task | {"dataset": {"nameOrPath": str(tmp_path / "bad")}})


def test_info(capsys):
    assert __main__.main(["--info"]) == 0 and "Spark 4" in capsys.readouterr().out and __main__.cores() >= 1


def test_units_and_schedules(spark):
    with pytest.raises(ValueError, match="unknown unit"):
        T.elapsed(F.lit(1), F.lit(1), "weeks")
    pos = T.positions(spark.createDataFrame([("a", k * 1000) for k in range(300)] + [(None, 5), (None, 3)], "g string, k long"), "g", "k", 1 << 14).collect()
    assert sorted(r["pos"] for r in pos if r["g"]) == list(range(300)) and {r["k"]: r["pos"] for r in pos if r["g"] is None} == {3: 0, 5: 1}
