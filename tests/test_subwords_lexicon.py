"""Byte-pair encoding and the term automaton against the public library and plain Python."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import bpe, lexicon
from corpusloom.plans import subwords

TEXTS = [None, "", " ", "Hello  world\n\n  it's 2024, isn't it?", "naïve café — déjà vu 😀😀 \t x", "a" * 5000, " \n" * 300 + "end", "x y　z   q", "they'll we've I'm '''' 12a34", "ﬁ Ǆ ẞ русский текст 中文", "tail  "]


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    with open(subwords.model(), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})


@pytest.mark.parametrize("resident", [200_000, 3, 0])
def test_ids_equal_the_library(spark, library, resident):
    df = spark.createDataFrame([(k, t, "mine") for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "mine")], "k int, text string, ids string").repartition(3)
    got = bpe.encode(df, "text", subwords.model(), "ids", resident)
    rows = got.collect()
    assert len(rows) == len(TEXTS) + 1 and got.columns == ["k", "text", "ids"]
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "")
    back = bpe.decode(got, "ids", subwords.model()).collect()
    assert all(r.decoded == (r.text or "") for r in back)


def test_merges_equal_the_library(library):
    rng = random.Random(5)
    table = bpe.ranks(subwords.model())
    for _ in range(400):
        word = "".join(rng.choices("abeinrst aé😀e", k=rng.randrange(1, 60)))
        assert bpe.merged(word.encode(), table) == library._encode_single_piece(word.encode())
    assert len(bpe.merged(b"ab" * 20_000, table)) < 40_000


def test_empty_corpus(spark):
    df = spark.createDataFrame([], "k int, text string")
    assert bpe.encode(df, "text", subwords.model()).count() == 0 and bpe.vocabulary(df, "text", subwords.model()).count() == 0
    with pytest.raises(FileNotFoundError):
        bpe.encode(df, "text", "/no/such/file")


def test_term_counts(spark, monkeypatch):
    terms = ["a", "aa", "aba", "ab", "che", "noche", "río", "ñ", "la habana", "habana", "x" * 40]
    rng = random.Random(2)
    texts = [None, "", "aaaa", "ababa", "x" * 125, "río ríoo", "la habana" * 300] + ["".join(rng.choice(["a", "b", " ", "che", "noche", "río", "la habana", "ñ", "x" * 39, "😀"]) for _ in range(rng.randrange(900))) for _ in range(40)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").repartition(3)
    for together in (4 << 20, 50):
        monkeypatch.setattr(lexicon, "TOGETHER", together)
        for r in df.withColumn("h", lexicon.hits(F.col("text"), terms)).collect():
            assert {x.term: x.n for x in r.h} == {t: (r.text or "").count(t) for t in terms if t in (r.text or "")}
    assert {(r.term, r.hits) for r in lexicon.by_term(df, F.col("text"), terms).collect()} == {(t, n) for t in terms if (n := sum((x or "").count(t) for x in texts))}
    assert lexicon.by_term(df.limit(0), F.col("text"), terms, "k").count() == 0
    with pytest.raises(ValueError, match="everywhere"):
        lexicon.Automaton(["a", ""])
