"""What a Python worker holds at a time is bounded, and results don't depend on it."""

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpusloom.operators import bpe, languages, subword, tokenise
from corpusloom.plans import subwords, tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture
def wide_batches(spark):
    """Spark's own bounds of an Arrow batch, which operators lower for themselves; put back behind the test."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.unset(k)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_subword_texts_are_encoded_a_bounded_run_at_a_time(wide_batches):
    class Told:
        """A tokenizer whose ids are the rows and characters that it was given together."""

        size, pad, end, mask, special = 0, 0, None, None, ()

        def __init__(self, path):
            pass

        def encode(self, texts):
            return [[len(texts), sum(map(len, texts))]] * len(texts)

    subword.register(".told", Told)
    try:
        docs = wide_batches.range(5000, numPartitions=1).withColumn("text", F.repeat(F.lit("abcd "), 400))
        got = subword.encode(docs, "text", "model.told", keep_text=False)
        assert got.columns == ["id", "ids"]
        rows, chars = got.agg(F.max(F.col("ids")[0]), F.max(F.col("ids")[1])).first()
        assert 0 < rows <= 2000 and 0 < chars <= subword.CHARS_AT_ONCE
    finally:
        del subword.BACKENDS[".told"]


def test_subword_round_trip_of_long_texts(wide_batches):
    texts = [None, "", "ab é😀 " * 70_000, *["some words " * 3000] * 12]
    docs = wide_batches.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    path = tokens.subword_model()
    e = subword.encode(docs, "text", path, keep_text=False)
    got = subword.decode(e.withColumn("ids", F.when(F.col("doc_id") > 0, F.col("ids"))), "ids", path)  # null ids have no text
    assert {r["doc_id"]: r["decoded"] for r in got.collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_subword_counts_are_those_of_built_windows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.when(F.col("doc_id") % 7 > 0, F.col("lang")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["lang"]: r for r in tokens.subword_chunk_counts(spark, str(tmp_path)).collect()}
    e = subword.encode(docs.select("doc_id", "lang", "text"), "text", tokens.subword_model(), keep_text=False)
    built = tokenise.causal_chunks(e, tokens.LENGTH, tokens.OVERLAP).groupBy("lang").agg(F.count("*"), F.sum(F.expr("size(filter(attention_mask, m -> m = 0))"))).collect()
    assert {(lang, r["windows"], r["padding"]) for lang, r in got.items()} == {tuple(r) for r in built} and None in got
    assert {(r[0], r[1], r[2]) for r in e.groupBy("lang").agg(F.count_distinct("doc_id"), F.sum(F.size("ids"))).collect()} == {(lang, r["documents"], r["ids"]) for lang, r in got.items()}


def test_languages_hold_a_bounded_run_of_characters(wide_batches, monkeypatch):
    docs = wide_batches.range(6000, numPartitions=1).select(F.when(F.col("id") % 2 == 0, F.lit("de")).otherwise(F.lit("en")).alias("lang"), F.repeat(F.when(F.col("id") % 2 == 0, "der hund und ").otherwise("the dog and "), 40).alias("text"))
    real, most = languages.trigrams, languages.CHARS_AT_ONCE

    def bounded(texts):
        if sum(map(len, texts)) > most:
            raise AssertionError("too many characters at once")
        return real(texts)

    # The functions that go to the workers are pickled with what they call.
    monkeypatch.setattr(languages, "trigrams", bounded)
    cloudpickle.register_pickle_by_value(languages)
    try:
        model = languages.fit(docs, "text", "lang")
        right = docs.select((languages.detected(F.col("text"), model)["lang"] == F.col("lang")).alias("right"))
        assert model.languages == ("de", "en") and right.filter("right").count() == 6000
        texts = ["der hund", "", "the dog and " * 30_000, "the dog", "x"] * 3
        names, sure = model.detect(texts[:2] + texts[3:5])
        assert model.detect([])[0] == [] and names[::2] == ["de", "en"]
    finally:
        cloudpickle.unregister_pickle_by_value(languages)
    monkeypatch.undo()
    names, sure = model.detect(texts)
    assert (names, sure.tolist()) == tuple(list(x) for x in zip(*[(n[0], s[0]) for n, s in (model.detect([t]) for t in texts)], strict=True))


def test_words_are_encoded_in_bounded_batches_without_their_text(wide_batches):
    docs = wide_batches.createDataFrame([(1, "b a A"), (2, None)], "doc_id long, text string")
    got = tokenise.encode(docs, "text", tokenise.vocabulary(docs, "text", 10), keep_text=False)
    assert int(wide_batches.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
    assert got.columns == ["doc_id", "ids"] and {tuple(r["ids"]) for r in got.collect()} == {(5, 4, 4), ()}


def test_windows_of_a_long_text_do_not_carry_it(spark):
    df = spark.range(1).select("id", F.sequence(F.lit(0), F.lit(99_999)).alias("ids"))
    got = tokenise.causal_chunks(df, 64, 16)
    generated = next(line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate posexplode" in line)
    assert "posexplode(transform(" in generated
    assert got.count() == 2083 and got.filter((F.col("input_ids")[0] != F.col("start")) | (F.size("input_ids") != 64) | (F.col("start") != F.col("chunk") * 48)).count() == 0


def test_rare_words_are_merged_where_they_stand(wide_batches):
    docs = wide_batches.range(3000, numPartitions=1).withColumn("text", F.concat(F.lit("often seen "), F.sha2(F.col("id").cast("string"), 256)))
    path = subwords.model()
    got = bpe.encode(docs, "text", path, resident=10, keep_text=False)
    assert got.columns == ["id", "ids"] and int(wide_batches.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    back = bpe.decode(got.withColumn("ids", F.when(F.col("id") != 1, F.col("ids"))), "ids", path)
    assert back.join(docs, "id").filter(F.col("decoded") != F.when(F.col("id") != 1, F.col("text")).otherwise("")).count() == 0
    halves = wide_batches.createDataFrame([(0, [bpe.ranks(path)["é".encode()[:1]]]), (1, [])], "id int, ids array<int>")
    assert [r["decoded"] for r in bpe.decode(halves, "ids", path).orderBy("id").collect()] == ["�", ""]
