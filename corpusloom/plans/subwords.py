"""Byte-pair encoding of the corpus: ids, text again, the words' merges, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import bpe
from corpusloom.plans.common import joined, long, table

LENGTH, OVERLAP = 1024, 256
STEP = LENGTH - OVERLAP


def model() -> str:
    """The public rank file that is installed on every machine; its path is a parameter of all operators."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", model(), keep_text=False)


def bpe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ids each document has, and a digest of them."""
    return _encoded(spark, sf_dir).select("doc_id", long(F.size("ids")).alias("n_ids"), F.md5(joined("ids").cast("binary")).alias("ids_md5"))


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that comes back from each document's ids, as a digest."""
    return bpe.decode(_encoded(spark, sf_dir), "ids", model()).select("doc_id", F.md5(F.col("decoded").cast("binary")).alias("decoded_md5"))


def bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct words, how often each occurs, and its ids."""
    words = bpe.vocabulary(table(spark, sf_dir, "documents"), "text", model())
    return words.select("word", "n", joined("ids").alias("ids"))


def bpe_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, characters an id, and windows of 1024 ids with an overlap of 256 of each language; all follow from the numbers of ids."""
    docs = table(spark, sf_dir, "documents").select("lang", "text", long(F.length("text")).alias("c"))
    n = bpe.encode(docs, "text", model(), keep_text=False).select("lang", long(F.size("ids")).alias("n"), "c")
    more = F.expr(f"CASE WHEN n <= {LENGTH} THEN 0L ELSE (n - {LENGTH} + {STEP - 1}) div {STEP} END")
    n = n.withColumn("windows", more + 1)
    return n.groupBy("lang").agg(long(F.sum("n")).alias("ids"), F.round(F.try_divide(F.sum("c"), F.sum("n")), 9).alias("chars_per_id"), long(F.sum("windows")).alias("windows"), long(F.sum(F.col("windows") * LENGTH - F.col("n") - (F.col("windows") - 1) * OVERLAP)).alias("padding"))


#: White space, and a mark that keeps the last blank of a run for the word behind it, as the pattern's look-ahead does.
_S = r"\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_MARK = r"\x{E000}"
_PATTERN = rf"''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}{_MARK}]+|[{_S}]+"


def _sql(rank_file: str) -> str:
    """Words by the pattern; each is merged a pair a step, that with the lowest rank first, until no pair has one."""
    return rf"""
WITH RECURSIVE r AS MATERIALIZED (SELECT from_base64(t) AS b, k FROM read_csv('{rank_file}', delim = ' ', header = false, quote = '', columns = {{'t': 'VARCHAR', 'k': 'BIGINT'}})),
t AS MATERIALIZED (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(regexp_replace(coalesce(text, ''), '([{_S}])([{_S}][^{_S}])', '\1' || chr(57344) || '\2', 'g'), '{_PATTERN}') AS w FROM documents),
words AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM t) GROUP BY 1),
m AS (
  SELECT 0 AS step, word, i, unhex(substr(hex(encode(word)), 2 * i - 1, 2)) AS b FROM (SELECT word, unnest(range(1, octet_length(encode(word)) + 1)) AS i FROM words)
  UNION ALL
  SELECT step + 1, word, i, CASE WHEN i = spot THEN b || nb ELSE b END
  FROM (SELECT p.*, q.spot, q.gone FROM (SELECT *, lead(b) OVER w AS nb FROM m WINDOW w AS (PARTITION BY word ORDER BY i)) p
        JOIN (SELECT word, arg_min(i, struct_pack(k := k, i := i)) AS spot, arg_min(ni, struct_pack(k := k, i := i)) AS gone
              FROM (SELECT word, i, lead(i) OVER w AS ni, b || lead(b) OVER w AS pair FROM m WINDOW w AS (PARTITION BY word ORDER BY i)) JOIN r ON r.b = pair GROUP BY word) q USING (word))
  WHERE i <> gone),
parts AS MATERIALIZED (SELECT word, list(k ORDER BY i) AS ids FROM (SELECT word, i, b FROM (SELECT *, max(step) OVER (PARTITION BY word) AS last FROM m) WHERE step = last) JOIN r USING (b) GROUP BY word),
e AS (SELECT doc_id, any_value(lang) AS lang, any_value(text) AS text, coalesce(flatten(list(ids ORDER BY i) FILTER (ids IS NOT NULL)), []) AS ids
      FROM t LEFT JOIN (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM t) x USING (doc_id) LEFT JOIN parts USING (word) GROUP BY doc_id)
"""


def _oracles() -> dict[str, str]:
    try:
        merges = _sql(model())
    except ImportError:  # the vocabularies aren't installed here
        return {}
    n = f"(SELECT lang, len(ids) AS n, length(text) AS c, CASE WHEN len(ids) <= {LENGTH} THEN 1 ELSE (len(ids) - {LENGTH} + {STEP - 1}) // {STEP} + 1 END AS windows FROM e)"
    return {
        "bpe_ids": f"{merges} SELECT doc_id, len(ids)::BIGINT AS n_ids, md5(array_to_string(ids, ',')) AS ids_md5 FROM e",
        "bpe_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS decoded_md5 FROM documents",
        "bpe_words": f"{merges} SELECT word, n, array_to_string(ids, ',') AS ids FROM words JOIN parts USING (word)",
        "bpe_chunk_counts": f"{merges} SELECT lang, sum(n)::BIGINT AS ids, round(sum(c) / nullif(sum(n), 0), 9)::DOUBLE AS chars_per_id, sum(windows)::BIGINT AS windows, sum(windows * {LENGTH} - n - (windows - 1) * {OVERLAP})::BIGINT AS padding FROM {n} GROUP BY lang",
    }


QUERIES = {f.__name__: f for f in (bpe_ids, bpe_round_trip, bpe_words, bpe_chunk_counts)}
ORACLES = _oracles()
