"""Vocabulary, chunks, masking, padding and inspection of token rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import tokens as K
from corpusloom.functions.seeded import uniform_duckdb
from corpusloom.functions.text import SQL
from corpusloom.operators import subword
from corpusloom.operators import tokenise as T
from corpusloom.plans.common import joined, long, table

VOCAB, LENGTH, OVERLAP, SEED = 4000, 64, 16, 1234
STEP = LENGTH - OVERLAP


def _vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.vocabulary(table(spark, sf_dir, "documents"), "text", VOCAB)


def _encoded(spark: SparkSession, sf_dir: str, *columns: str, first: int | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", *columns)
    return T.encode(docs, "text", _vocab(spark, sf_dir), first, keep_text=False)


def vocab_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocab(spark, sf_dir).select(long("token_id").alias("token_id"), "word", "n")


def _chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return T.causal_chunks(_encoded(spark, sf_dir, *columns), LENGTH, OVERLAP)


def causal_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window of every document, with its ids, mask and labels joined to strings."""
    return _chunks(spark, sf_dir).select("doc_id", "chunk", "start", joined("input_ids").alias("input_ids"), joined("attention_mask").alias("attention_mask"), joined("labels").alias("labels"))


def causal_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows, documents and attended tokens of each language; all follow from the number of ids, so no window is built."""
    n = _encoded(spark, sf_dir, "lang").select("lang", "doc_id", F.size("ids").alias("n"))
    more = F.expr(f"CASE WHEN n <= {LENGTH} THEN 0L ELSE cast(ceil((n - {LENGTH}) / {STEP}) AS bigint) END")
    n = n.withColumn("more", more).withColumn("tokens", F.col("more") * LENGTH + F.col("n") - F.col("more") * STEP)
    return n.groupBy("lang").agg(long(F.sum(F.col("more") + 1)).alias("chunks"), F.count_distinct("doc_id").alias("docs"), long(F.sum("tokens")).alias("tokens"))


def token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens a character and a word, and windows of 1024 tokens, by language."""
    e = _encoded(spark, sf_dir, "lang", "n_chars")
    a = e.groupBy("lang").agg(long(F.sum(F.size("ids"))).alias("tokens"), long(F.sum("n_chars")).alias("chars"))
    ratio = F.try_divide("tokens", "chars")
    label = F.when(ratio < 0.3, "high").when(ratio < 0.4, "good").when(ratio < 0.5, "fair").otherwise("low")
    return a.select("lang", "tokens", "chars", ratio.alias("tokens_per_char"), F.expr("tokens div 1024").alias("windows"), label.alias("efficiency"))


def padding_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, padding and lengths of the chunked set."""
    n = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    c = _chunks(spark, sf_dir).select(n.alias("n"))
    pad = LENGTH - F.col("n")
    return c.agg(
        F.count("*").alias("rows"), long(F.sum("n")).alias("tokens"), long(F.sum(pad)).alias("padding"), long(F.count_if(pad > 0)).alias("padded_rows"), F.avg(pad).alias("mean_padding"),
        F.avg("n").alias("mean_length"), long(F.min("n")).alias("shortest"), long(F.max("n")).alias("longest"), (F.sum(pad) / (F.count("*") * LENGTH)).alias("padding_share"),
    )


def length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median, 95th and 99th percentile of document lengths in tokens, and how many exceed 512."""
    n = _encoded(spark, sf_dir).select(F.size("ids").alias("n"))
    p = lambda q: F.round(F.percentile("n", F.lit(q)), 6)
    return n.agg(F.round(F.avg("n"), 6).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), long(F.max("n")).alias("longest"), long(F.count_if(F.col("n") > 512)).alias("over_512"))


def _mlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.mlm(_encoded(spark, sf_dir, first=LENGTH), "doc_id", LENGTH, VOCAB + 4, SEED)


def mlm_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mlm(spark, sf_dir).select("doc_id", joined("input_ids").alias("input_ids"), joined("labels").alias("labels"))


def mlm_mask_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of attended tokens chosen, and of these the share that became the mask."""
    count = lambda c: long(F.sum(F.expr(c)))
    m = _mlm(spark, sf_dir).agg(
        count("size(filter(attention_mask, x -> x = 1))").alias("tokens"), count("size(filter(labels, x -> x <> -100))").alias("chosen"),
        count(f"size(filter(zip_with(labels, input_ids, (l, i) -> l <> -100 AND i = {T.MASK}), x -> x))").alias("masked"),
    )
    return m.select("tokens", "chosen", "masked", F.try_divide("chosen", "tokens").alias("rate"))


def dynamic_pad_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length to pad to, by the three rules, for limits of 4096 and 512 tokens, and what it saves."""
    n = _encoded(spark, sf_dir).select((F.size("ids") + 1).alias("n"))
    parts = [T.dynamic_target(n, "n", most, p).select(F.lit(rule).alias("rule"), "target", F.round((1 - F.col("target") / most) * 100, 6).alias("saved_pct")) for rule, most, p in (("longest", 100000, None), ("p95", 512, None), ("p50", 512, 50.0))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def dynamic_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut and padded to the dynamic target of a limit of 512."""
    e = _encoded(spark, sf_dir)
    target = T.dynamic_target(e.select((F.size("ids") + 1).alias("n")), "n", 512)
    out = e.join(F.broadcast(target)).withColumn("part", F.expr("slice(ids, 1, cast(target AS int))"))
    return out.select("doc_id", "target", long(F.size("ids")).alias("n"), F.md5(joined(K.padded("part", "target", T.PAD)).cast("binary")).alias("ids_md5"))


def token_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each masked row: tokens, distinct ones, least and greatest id, chosen and attended ones, and their shares."""
    m = _mlm(spark, sf_dir)
    train = F.filter("labels", lambda x: x != -100)
    attended = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return m.select(
        "doc_id", long(F.size("input_ids")).alias("total"), long(F.size(F.array_distinct("input_ids"))).alias("distinct_ids"), long(F.array_min("input_ids")).alias("least"), long(F.array_max("input_ids")).alias("greatest"),
        long(F.size(train)).alias("training"), long(F.size(F.array_distinct(train))).alias("distinct_training"), long(attended).alias("attended"), F.try_divide(attended, F.size("input_ids")).alias("attention_ratio"),
        F.try_divide(F.size(train), F.size("labels")).alias("training_ratio"),
    )


def token_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last ten ids, and the first ten positions that are trained on."""
    m = _mlm(spark, sf_dir)
    positions = F.expr("slice(filter(sequence(0, size(labels) - 1), i -> labels[i] <> -100), 1, 10)")
    return m.select("doc_id", joined(F.slice("input_ids", 1, 10)).alias("head"), joined(F.expr("slice(input_ids, -least(10, size(input_ids)), 10)")).alias("tail"), joined(positions).alias("trained_at"))


def decode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens of each document as text again, as a digest; words beyond the vocabulary show as such."""
    e = T.decode(_encoded(spark, sf_dir), _vocab(spark, sf_dir)).filter(F.size("ids") > 0)
    return e.select("doc_id", long(F.size("ids")).alias("tokens"), F.md5(F.array_join("words", " ").cast("binary")).alias("decoded_md5"))


def subword_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded by a public byte-level model and decoded again from all their ids: the text comes back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = subword.decode(subword.encode(docs, "text", subword_model(), keep_text=False), "ids", subword_model())
    return out.select("doc_id", F.md5(F.col("decoded").cast("binary")).alias("decoded_md5"))


def subword_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, subword ids, windows and padding of each language; the library alone tells the ids, and all else follows from their numbers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    n = subword.encode(docs, "text", subword_model(), keep_text=False).select("doc_id", "lang", F.size("ids").cast("long").alias("n"))
    more = F.expr(f"CASE WHEN n <= {LENGTH} THEN 0L ELSE (n - {LENGTH} + {STEP - 1}) div {STEP} END")
    n = n.withColumn("windows", more + 1)
    padding = F.col("windows") * LENGTH - F.col("n") - (F.col("windows") - 1) * OVERLAP
    return n.groupBy("lang").agg(F.count_distinct("doc_id").alias("documents"), long(F.sum("windows")).alias("windows"), long(F.sum(padding)).alias("padding"), long(F.sum("n")).alias("ids"))


def subword_model() -> str:
    """The public byte-level model that is installed on every machine; its path is a parameter of all operators."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def most_frequent_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The padding id by the rule of the most frequent id of the padded set; ties by id."""
    ids = _chunks(spark, sf_dir).select(F.explode("input_ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return ids.orderBy(F.desc("n"), "id").limit(1).select(long("id").alias("id"), "n")


_W = f"w AS (SELECT doc_id, lang, n_chars, {SQL.words('lower(text)')} AS w FROM documents)"
_V = f"v AS (SELECT row_number() OVER (ORDER BY n DESC, word) + 3 AS token_id, word, n FROM (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM w) GROUP BY 1 ORDER BY n DESC, word LIMIT {VOCAB}))"
_E = f"{_W}, {_V}, e AS (SELECT w.doc_id, any_value(w.lang) AS lang, any_value(w.n_chars) AS n_chars, coalesce(list(coalesce(v.token_id, 1) ORDER BY i) FILTER (i IS NOT NULL), []) AS ids FROM w LEFT JOIN (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w) x ON x.doc_id = w.doc_id LEFT JOIN v ON v.word = x.word GROUP BY w.doc_id)"
_C = f"{_E}, c AS (SELECT doc_id, lang, unnest(range(0, CASE WHEN len(ids) <= {LENGTH} THEN 1 ELSE (ceil((len(ids) - {LENGTH}) / {STEP}) + 1)::BIGINT END)) AS chunk, ids FROM e), p AS (SELECT doc_id, lang, chunk, chunk * {STEP} AS start, ids[chunk * {STEP} + 1 : chunk * {STEP} + {LENGTH}] AS part FROM c)"
_M1 = f"{_E}, a AS (SELECT doc_id, ids[1:{LENGTH}] AS part FROM e), t AS (SELECT doc_id, i - 1 AS i, coalesce(part[i], 0) AS t, i <= len(part) AS real FROM (SELECT doc_id, part, unnest(range(1, {LENGTH} + 1)) AS i FROM a))"
_U = uniform_duckdb(f"'{SEED}-select-' || doc_id || '-' || i")
_K = uniform_duckdb(f"'{SEED}-kind-' || doc_id || '-' || i")
_R = uniform_duckdb(f"'{SEED}-token-' || doc_id || '-' || i")
_M = f"{_M1}, m AS (SELECT *, real AND t NOT IN (0, 1, 2, 3) AND {_U} < 0.15 AS chosen FROM t), r AS (SELECT *, CASE WHEN NOT chosen THEN t WHEN {_K} < 0.8 THEN 3 WHEN {_K} < 0.9::DOUBLE THEN floor({_R} * {VOCAB + 4})::INT ELSE t END AS id, CASE WHEN chosen THEN t ELSE -100 END AS label FROM m)"
_STR = "array_to_string(list({0} ORDER BY i), ',')"

QUERIES = {f.__name__: f for f in (vocab_build, causal_chunks, causal_chunk_counts, token_efficiency, padding_stats, length_percentiles, mlm_masking, mlm_mask_rate, dynamic_pad_target, dynamic_padded, token_analysis, token_breakdown, decode_tokens, subword_round_trip, subword_chunk_counts, most_frequent_token)}

ORACLES = {
    "vocab_build": f"WITH {_W}, {_V} SELECT token_id::BIGINT AS token_id, word, n FROM v",
    "causal_chunks": f"WITH {_C} SELECT doc_id, chunk, start, array_to_string(part || list_transform(range(0, {LENGTH} - len(part)), lambda x: 0), ',') AS input_ids, array_to_string(list_transform(range(0, {LENGTH}), lambda x: CASE WHEN x < len(part) THEN 1 ELSE 0 END), ',') AS attention_mask, array_to_string(part || list_transform(range(0, {LENGTH} - len(part)), lambda x: -100), ',') AS labels FROM p",
    "causal_chunk_counts": f"WITH {_C} SELECT lang, count(*) AS chunks, count(DISTINCT doc_id) AS docs, sum(len(part))::BIGINT AS tokens FROM p GROUP BY lang",
    "token_efficiency": f"WITH {_E}, a AS (SELECT lang, sum(len(ids))::BIGINT AS tokens, sum(n_chars)::BIGINT AS chars FROM e GROUP BY lang) SELECT lang, tokens, chars, tokens / chars AS tokens_per_char, tokens // 1024 AS windows, CASE WHEN tokens / chars < 0.3 THEN 'high' WHEN tokens / chars < 0.4 THEN 'good' WHEN tokens / chars < 0.5 THEN 'fair' ELSE 'low' END AS efficiency FROM a",
    "padding_stats": f"WITH {_C}, n AS (SELECT len(part) AS n, {LENGTH} - len(part) AS pad FROM p) SELECT count(*) AS rows, sum(n)::BIGINT AS tokens, sum(pad)::BIGINT AS padding, count(*) FILTER (pad > 0) AS padded_rows, avg(pad) AS mean_padding, avg(n) AS mean_length, min(n)::BIGINT AS shortest, max(n)::BIGINT AS longest, (sum(pad) / (count(*) * {LENGTH}))::DOUBLE AS padding_share FROM n",
    "length_percentiles": f"WITH {_E}, n AS (SELECT len(ids)::DOUBLE AS n FROM e) SELECT round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99, max(n)::BIGINT AS longest, count(*) FILTER (n > 512) AS over_512 FROM n",
    "mlm_masking": f"WITH {_M} SELECT doc_id, {_STR.format('id')} AS input_ids, {_STR.format('label')} AS labels FROM r GROUP BY doc_id",
    "mlm_mask_rate": f"WITH {_M} SELECT count(*) AS tokens, count(*) FILTER (chosen) AS chosen, count(*) FILTER (chosen AND id = 3) AS masked, (count(*) FILTER (chosen)) / count(*) AS rate FROM r WHERE real",
    "dynamic_pad_target": f"WITH {_E}, n AS (SELECT (len(ids) + 1)::DOUBLE AS n FROM e), t AS (SELECT 'longest' AS rule, 100000 AS most, max(n)::BIGINT AS target FROM n UNION ALL SELECT 'p95', 512, CASE WHEN max(n) >= 512 THEN least(floor(quantile_cont(n, 0.95)), 512) ELSE max(n) END::BIGINT FROM n UNION ALL SELECT 'p50', 512, least(floor(quantile_cont(n, 0.5)), 512)::BIGINT FROM n) SELECT rule, target, round((1 - target / most) * 100, 6) AS saved_pct FROM t",
    "dynamic_padded": f"WITH {_E}, g AS (SELECT CASE WHEN max(len(ids) + 1) >= 512 THEN least(floor(quantile_cont((len(ids) + 1)::DOUBLE, 0.95)), 512) ELSE max(len(ids) + 1) END::BIGINT AS target FROM e) SELECT doc_id, target, len(ids)::BIGINT AS n, md5(array_to_string(list_transform(range(1, target + 1), lambda x: coalesce(ids[x], 0)), ',')) AS ids_md5 FROM e, g",
    "token_analysis": f"WITH {_M} SELECT doc_id, count(*) AS total, count(DISTINCT id) AS distinct_ids, min(id)::BIGINT AS least, max(id)::BIGINT AS greatest, count(*) FILTER (chosen) AS training, count(DISTINCT label) FILTER (chosen) AS distinct_training, count(*) FILTER (real) AS attended, (count(*) FILTER (real)) / count(*) AS attention_ratio, (count(*) FILTER (chosen)) / count(*) AS training_ratio FROM r GROUP BY doc_id",
    "token_breakdown": f"WITH {_M} SELECT doc_id, array_to_string(list(id ORDER BY i) FILTER (i < 10), ',') AS head, array_to_string(list(id ORDER BY i) FILTER (i >= {LENGTH} - 10), ',') AS tail, coalesce(array_to_string((list(i ORDER BY i) FILTER (chosen))[1:10], ','), '') AS trained_at FROM r GROUP BY doc_id",
    "decode_tokens": f"WITH {_E}, x AS (SELECT doc_id, unnest(range(1, len(ids) + 1)) AS i, ids FROM e) SELECT doc_id, count(*) AS tokens, md5(string_agg(coalesce(word, '[UNK]'), ' ' ORDER BY i)) AS decoded_md5 FROM x LEFT JOIN v ON v.token_id = ids[i] GROUP BY doc_id",
    "subword_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS decoded_md5 FROM documents",
    "most_frequent_token": f"WITH {_C} SELECT id::BIGINT AS id, count(*) AS n FROM (SELECT unnest(part || list_transform(range(0, {LENGTH} - len(part)), lambda x: 0)) AS id FROM p) GROUP BY 1 ORDER BY n DESC, id LIMIT 1",
}
