"""The language classifier: held-out accuracy, and plain Python over a few rows."""

import math

from pyspark.sql import functions as F

from corpusloom.operators import languages as M
from corpusloom.plans import languages


def test_held_out_accuracy(spark):
    rows = languages.language_accuracy(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert len(rows) == 4 and all(r.right >= 0.95 for r in rows) and sum(r.files for r in rows) > 150


def test_against_plain_python(spark):
    train = [("Dies ist ein Satz, und DAS auch!", "de"), ("this is one sentence", "en"), ("and that too", "en"), (None, "en"), ("", "de"), ("no label", None), ("x", "zz")]
    df = spark.createDataFrame(train, "text string, lang string").repartition(3)
    model = M.fit(df, "text", "lang")

    def grams(text):
        t = " " + " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()) + " "
        return [(ord(a) * M.HASH[0] + ord(b) * M.HASH[1] + ord(c)) % M.BUCKETS for a, b, c in zip(t, t[1:], t[2:], strict=False)]

    counts = {lang: [g for t, x in train if x == lang for g in grams(t)] for lang in ("de", "en", "zz")}
    docs = {lang: sum(x == lang for _, x in train) for lang in counts}
    texts = ["Dieser Satz", "that sentence", "", None, "1234 !!", "x", "日本 ein"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", M.detected(F.col("text"), model).alias("d")).orderBy("k").collect()
    for r, t in zip(got, texts, strict=True):
        own = grams(t)
        if not own:
            assert (r.d.lang, r.d.confidence) == ("unknown", 0.0)
            continue
        score = {x: math.log(docs[x] / 6) + sum(math.log((counts[x].count(g) + M.SMOOTH) / (len(counts[x]) + M.SMOOTH * M.BUCKETS)) for g in own) / len(own) * min(len(own), M.EVIDENCE) for x in counts}
        best = max(score, key=lambda x: score[x])
        assert r.d.lang == best and abs(r.d.confidence - 1 / sum(math.exp(s - score[best]) for s in score.values())) < 1e-9
    assert (got[0].d.lang, got[1].d.lang) == ("de", "en")


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([("some text", None)], "text string, lang string")
    assert df.select(M.detected(F.col("text"), M.fit(df, "text", "lang")).alias("d")).first().d.lang == "unknown"
