"""A corpus pipeline of five operators, from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns rows; all but the last keep
the columns of documents, extra ones included, whatever their names. Near
duplicates are five-word shingle sets with a Jaccard likeness of 0.8 or more.
The mix keeps nine tenths of the tokens that are left, in one epoch, so that no
document comes twice: it only trims to the budget, and the kept shares do not
reach the target weights.

Defined results: null, empty and blank texts fail the first stage, so that no
later one meets them; very long texts are judged like others (there is no upper
limit of words) and kept whole; rows alike in id and text are one row after the
second stage, and of texts with one set of shingles the smallest id stays; null
languages and sources are leaves of their own in the mix, ties in it are broken
by the id's digest; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import ngram_join, pii, quality_rules, sentencepieces, source_mixing
from corpusloom.llm.common import stored, table, words

#: The published rules without their upper limit of words, which has nothing to do with quality.
RULES = tuple(r for r in quality_rules.THRESHOLDS if r.name != "too_long")
#: Share of the tokens that the mix keeps.
MIX_SHARE = 0.9


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; a null text has no words and is too short."""
    return quality_rules.keep_good(docs, thresholds=RULES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each component of near duplicates."""
    return ngram_join.one_of_each(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked and disclosing terms generalised or removed; n_chars follows."""
    return pii.sanitised(docs, n_chars="n_chars")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the weights of their domain, language and source."""
    levels = {"domain": source_mixing.domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return source_mixing.mixed_documents(docs, levels, "doc_id", F.size(words(F.col("text"))), source_mixing.WEIGHTS, share=MIX_SHARE, max_epochs=1)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, the spans of their pieces in the text's UTF-8 bytes, and the digest of what the ids decode to."""
    out = sentencepieces.encode(docs.select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "begins", "ends", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("personal data", personal_data), ("mixing sources", mixing), ("SentencePiece", encoding)]

#: SQL can't express the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what each returns is written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
