import json
import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions import tokens as K
from corpusloom.operators import anonymise, checkpoints, conversations, sampling, telemetry, tokenise
from corpusloom.sources import files


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,category",
    [
        ("", "empty_files"), ("  \n\t", "empty_files"), ("-" * 50, "garbled_content"), ("-" * 49, None), ("é" * 50, "garbled_content"), ("a" * 51, "garbled_content"), ("a" * 50, None),
        ("señor ÿ", "garbled_content"), ("x�", "garbled_content"), (("0123456789"[:9] + " ") * 10, None), (("a" + "1" * 9 + " ") * 9 + "a" + "1" * 10, "garbled_content"), ("plain text", None),
    ],
)
def test_quality_category(spark, text, category):
    assert one(spark, text, X.quality_category) == category


def test_text_scalars(spark):
    assert one(spark, "a b c\x1cd\x85e", X.word_count) == 5
    assert one(spark, "\n One sentence here. ok. Another longer one!", lambda c: F.size(X.sentences(c))) == 2
    assert one(spark, "aaaaa aa", lambda c: X.occurrences(c, "aa")) == 3
    assert one(spark, "Straße CAFÉ ñandú", lambda c: X.latin_words(X.fold(c))) == ["cafe", "nandu"]
    assert one(spark, "", X.line_count) == 1 and one(spark, "a\n", X.line_count) == 2
    assert one(spark, "☃☃", X.display_clean) == "Unknown"


@pytest.mark.parametrize("n,overlap,want", [(0, 2, [(0, 0)]), (8, 2, [(0, 8)]), (9, 2, [(0, 8), (6, 3)]), (14, 2, [(0, 8), (6, 8)]), (15, 2, [(0, 8), (6, 8), (12, 3)]), (20, 0, [(0, 8), (8, 8), (16, 4)])])
def test_windows(spark, n, overlap, want):
    df = spark.createDataFrame([(1, list(range(n)))], "id int, ids array<int>")
    got = tokenise.causal_chunks(df, 8, overlap).orderBy("chunk").collect()
    assert [(r["start"], sum(r["attention_mask"])) for r in got] == want
    assert all(len(r["input_ids"]) == len(r["attention_mask"]) == len(r["labels"]) == 8 for r in got)
    assert all(label == (i if m else -100) for r in got for i, m, label in zip(r["input_ids"], r["attention_mask"], r["labels"], strict=True))


def test_overlap_must_be_less_than_window():
    with pytest.raises(ValueError):
        K.window_starts("ids", 8, 8)


@pytest.mark.parametrize("strategy,mask", [("context_aware", [1, 1, 1, 1, 0, 0]), ("response_only", [0, 0, 1, 1, 0, 0])])
def test_instruction_rows(spark, strategy, mask):
    df = spark.createDataFrame([(1, [1, 2], [1, 2, 7])], "id int, p array<int>, f array<int>")
    r = tokenise.instruction_rows(df, "p", "f", 6, strategy).first()
    assert r["input_ids"] == [1, 2, 7, tokenise.EOS, 0, 0] and r["attention_mask"] == mask
    assert r["labels"] == [-100, -100, 7, tokenise.EOS, -100, -100] and r["n"] == 4


@pytest.mark.parametrize("lengths,most,p,want", [([1, 2, 3, 4], 10, None, 4), ([1, 2, 3, 20], 10, None, 10), ([1, 2, 3, 20], 10, 50.0, 2)])
def test_dynamic_target(spark, lengths, most, p, want):
    df = spark.createDataFrame([(x,) for x in lengths], "n int")
    assert tokenise.dynamic_target(df, "n", most, p).first()["target"] == want


def test_mlm_rates_and_labels(spark):
    df = spark.createDataFrame([(i, list(range(4, 104))) for i in range(200)], "id long, ids array<int>")
    rows = tokenise.mlm(df, "id", 128, 500, 7).collect()
    chosen = sum(x != -100 for r in rows for x in r["labels"])
    assert abs(chosen / 20000 - 0.15) < 4 * math.sqrt(0.15 * 0.85 / 20000)
    assert all(x == -100 for r in rows for x in r["labels"][100:])
    assert all(x in (-100, i + 4) for r in rows for i, x in enumerate(r["labels"][:100]))
    again = tokenise.mlm(df.repartition(7), "id", 128, 500, 7).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


@pytest.mark.parametrize("n,p,want", [(10, 0.15, 1), (10, 1.0, 10), (10, 2.3, 23), (100, 0.29, 28)])
def test_sample_sizes(spark, n, p, want):
    got = sampling.sample(spark.range(n), "id", p, 42).groupBy("id").count().collect()
    times = [r["count"] for r in got]
    assert sum(times) == want and max(times) - min(times) <= 1


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(0, 300), ratio=st.sampled_from([0.1, 0.3, 0.5]))
def test_split_is_exact(spark, n, ratio):
    got = {r["split"]: r["count"] for r in sampling.train_valid_split(spark.range(n), "id", ratio, 1).groupBy("split").count().collect()}
    assert got.get("valid", 0) == math.ceil(n * ratio) and sum(got.values()) == n


def test_merge_refuses_other_columns(spark):
    a, b, c = spark.range(3), spark.range(3).withColumn("x", F.lit(1)), spark.range(3).select(F.col("id").cast("int").alias("id"))
    with pytest.raises(ValueError, match="columns differ"):
        sampling.merge([a, b], "id", [1.0, 1.0])
    with pytest.raises(ValueError, match="column id is int"):
        sampling.merge([a, c], "id", [1.0, 1.0])
    assert sampling.merge([a, a], "id", [1.0, 2.0]).count() == 9


def repaired(spark, target, inputs, assistance, goal):
    schema = "system string, input array<string>, assistance array<string>, target string"
    r = conversations.repaired(spark.createDataFrame([("  ", inputs, assistance, goal)], schema), target).first()
    return None if r["turns"] is None else [(t["role"][0], t["content"]) for t in r["turns"]]


def test_repair(spark):
    assert repaired(spark, True, ["q"], None, " a ") == [("u", "q"), ("a", "a")]
    assert repaired(spark, False, ["q"], None, " a ") == [("u", "q")]
    assert repaired(spark, True, ["q1", "q2"], ["a1", "a2"], "t") == [("u", "q1"), ("a", "a1"), ("u", "q2"), ("a", "t")]
    assert repaired(spark, False, ["q1", "q2", "q3"], ["a1"], None) == [("u", "q1"), ("a", "a1"), ("u", "q2\n\nq3")]
    assert repaired(spark, True, ["q1"], ["a1", "a2"], None) == [("u", "q1"), ("a", "a2")]
    assert repaired(spark, True, ["q1", "q2"], None, None) == [("u", "q1"), ("a", conversations.LAST_ASSISTANT)]
    assert repaired(spark, True, [], None, None) is None and repaired(spark, False, None, None, None) is None


def test_telemetry(spark):
    rows = [(1, i, 8 * i, float(i)) for i in range(1, 6)]
    out = telemetry.rolling(spark.createDataFrame(rows, "run int, it int, s int, t double"), "run", "it", "s", "t", 2)
    assert sorted(r["it"] for r in out.collect()) == [3, 4, 5]
    assert telemetry.validation_steps(10, 3) == [3, 6, 10] and telemetry.validation_steps(1, 4) == [1]
    assert telemetry.step_plan(1000, 8, 2, 3, 4, 0.06) == {"steps_per_epoch": 62, "micro_steps": 186, "total_steps": 46, "warmup_steps": 2}
    sparse = spark.createDataFrame([(1, 1, 1, None), (1, 2, None, 2), (1, 3, 3, None), (None, 4, 9, None)], "step int, seq int, a int, b int")
    assert [tuple(r) for r in telemetry.merged_by_step(sparse, "step", "seq", ["a", "b"]).collect()] == [(1, 3, 2)]


def test_checkpoint_names(spark):
    assert one(spark, "model.model.layers.0.w", checkpoints.renamed) == "model.layers.0.w"
    assert one(spark, "model.lm_head.weight", checkpoints.renamed) == "lm_head.weight"
    assert one(spark, "model.embed_tokens.weight", checkpoints.renamed) == "model.embed_tokens.weight"


def test_anonymise_methods(spark):
    rules = list(anonymise.RULES)
    text = "write to ann@site.org on 2024-01-02"
    assert one(spark, text, lambda c: anonymise.anonymised(c, "label", rules)) == "write to [EMAIL] on [DATE]"
    assert one(spark, text, lambda c: anonymise.anonymised(c, "none", rules)) == text
    shaped = one(spark, text, lambda c: anonymise.anonymised(c, "intelligent", rules))
    assert re.fullmatch(r"write to [a-z]{3}@[a-z]{4}\.[a-z]{3} on \d{4}-\d\d-\d\d", shaped) and shaped != text
    with pytest.raises(ValueError):
        anonymise.anonymised(F.lit("x"), "other", rules)


def test_files(spark, tmp_path):
    base = tmp_path / "in"
    (base / "sub").mkdir(parents=True)
    (base / "empty").mkdir()
    (base / "a.txt").write_text("one\n\ntwo\n")
    (base / "bad.txt").write_bytes(b"caf\xe9 ok\xff end")
    (base / "sub" / "b.csv").write_text('body,n\n"x, ""y""",1\n')
    (base / "c.json").write_text(json.dumps([{"k": "v1"}, {"k": 5}, {"z": 1}]))
    (base / "sub" / "d.json").write_text(json.dumps({"k": "v2"}))
    (base / "e.jsonl").write_text('{"k": "v3"}\nnot json\n[1]\n{"z": 1}\n{"k": 7}\n')
    (base / "f.md").write_text("ignored")
    inv = {(r["source"], r["ext"]) for r in files.inventory(spark, str(base)).collect()}
    assert inv == {("", "txt"), ("sub", "csv"), ("", "json"), ("sub", "json"), ("", "jsonl")}
    assert sorted(r["text"] for r in files.read_lines(spark, str(base), "a.txt").collect()) == ["", "one", "two"]
    assert files.read_whole(spark, str(base), "a.txt").first()["text"] == "one\ntwo\n"
    assert len(files.read_whole(spark, str(base), "bad.txt").first()["text"]) == 10
    assert files.read_csv(spark, str(base), "body").first()["text"] == 'x, "y"'
    assert sorted(r["text"] for r in files.read_json(spark, str(base), "k").collect()) == ["v1", "v2"]
    good, bad = files.read_jsonl(spark, str(base), "k")
    assert [r["text"] for r in good.collect()] == ["v3"] and bad.count() == 4
    assert files.read_json(spark, str(base / "sub")).first()["text"] == json.dumps({"k": "v2"}, indent=2)
    with pytest.raises(ValueError):
        files.inventory(spark, str(base), "md")
    with pytest.raises(ValueError):
        files.read_directory(spark, str(base / "empty"))


def test_plans_stay_native(spark):
    from corpusloom.plans import catalogue

    for name in ("content_profile_by_source", "stratified_split", "conversation_repair", "rolling_throughput"):
        plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan


def test_whole_histograms(spark, tmp_path):
    from corpusloom.plans import profile

    spark.createDataFrame([(1, "ab " * 1000)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["char"]: r["n"] for r in profile.char_histogram_whole(spark, str(tmp_path)).collect()}
    assert got == {"a": 1000, "b": 1000, " ": 1000}
    assert [tuple(r) for r in profile.word_length_hist_whole(spark, str(tmp_path)).collect()] == [(2, 1000)]


def test_labels_without_a_rule_are_a_fault():
    with pytest.raises(ValueError, match="no rule for labels: ZIP"):
        anonymise.chosen(anonymise.RULES, ["EMAIL", "ZIP"])
    assert [k for k, _ in anonymise.chosen(anonymise.RULES, ["EMAIL"])] == ["EMAIL"]
