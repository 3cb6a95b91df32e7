"""Conversations: repair, prompts, instruction rows and splits by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import SQL
from corpusloom.operators import conversations as C
from corpusloom.operators import sampling as S
from corpusloom.operators import tokenise as T
from corpusloom.plans.common import joined, long, table

LENGTH, VOCAB = 128, 2000


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.instruction_rows(table(spark, sf_dir, "conversations"))


def _shown(turns: str):
    return F.expr(f"array_join(transform({turns}, x -> concat(x.role, ':', x.content)), '\n--\n')")


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired turns with the target, or the error."""
    r = C.repaired(_rows(spark, sf_dir), True)
    return r.select("conv_id", "system", long(F.coalesce(F.size("turns"), F.lit(0))).alias("n_turns"), _shown("turns").alias("turns"), "error")


def prompt_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.prompt_pairs(_rows(spark, sf_dir), "2024-01-01")
    return p.select("conv_id", "prompt", "prompt_and_response")


def _instruction(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    p = C.prompt_pairs(_rows(spark, sf_dir)).select("conv_id", "prompt", "prompt_and_response")
    vocab = T.vocabulary(p, "prompt_and_response", VOCAB)
    a = T.encode(p, "prompt", vocab).withColumnRenamed("ids", "prompt_ids")
    b = T.encode(a, "prompt_and_response", vocab).withColumnRenamed("ids", "full_ids").select("conv_id", "prompt_ids", "full_ids")
    return T.instruction_rows(b, "prompt_ids", "full_ids", LENGTH, strategy)


def _show(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "n", joined("input_ids").alias("input_ids"), joined("attention_mask").alias("attention_mask"), joined("labels").alias("labels"))


def instruction_labels_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(_instruction(spark, sf_dir, "context_aware"))


def instruction_labels_response_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _show(_instruction(spark, sf_dir, "response_only"))


def keyed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split for each key, here the role of a conversation's first turn."""
    key = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("key"))
    return S.train_valid_split(key, "conv_id", 0.3, 1234, ("key",)).select("conv_id", "key", "split")


def turn_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), long(F.sum(F.length("text"))).alias("chars"))


_STRIP = r"regexp_replace({0}, '^[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}]+|[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}]+$', '', 'g')"
_ROWS = (
    "l AS (SELECT conv_id, max(turn) AS last, min(turn) AS first FROM conversations GROUP BY 1), "
    "base AS (SELECT c.conv_id, (SELECT " + _STRIP.format("coalesce(min_by(text, turn), '')") + " FROM conversations s WHERE s.conv_id = c.conv_id AND s.role = 'system') AS system, "
    "(SELECT list(text ORDER BY turn) FROM conversations s WHERE s.conv_id = c.conv_id AND s.role = 'user') AS i, "
    "(SELECT coalesce(list(text ORDER BY turn), []) FROM conversations s WHERE s.conv_id = c.conv_id AND s.role = 'assistant' AND NOT (s.turn = c.last)) AS a, "
    "(SELECT " + _STRIP.format("any_value(text)") + " FROM conversations s WHERE s.conv_id = c.conv_id AND s.role = 'assistant' AND s.turn = c.last) AS target FROM l c), "
    # interleaved turns, in order: user k at 2k, assistant k at 2k+1, the target last
    "x AS (SELECT conv_id, 2 * k AS o, 'user' AS role, i[k + 1] AS content FROM (SELECT conv_id, i, a, unnest(range(0, CASE WHEN len(a) > 0 THEN len(i) ELSE 1 END)) AS k FROM base WHERE len(i) > 0) UNION ALL "
    "SELECT conv_id, 2 * k + 1, 'assistant', a[k + 1] FROM (SELECT conv_id, a, unnest(range(0, len(a))) AS k FROM base WHERE len(i) > 0)), "
)


def _folded(name: str, src: str) -> str:
    """Runs of one role: users joined by a blank line, of assistants the last."""
    return (
        f"{name} AS (SELECT conv_id, g AS o, role, CASE WHEN role = 'user' THEN string_agg(content, chr(10) || chr(10) ORDER BY o) ELSE max_by(content, o) END AS content FROM "
        f"(SELECT *, sum(CASE WHEN role IS NOT DISTINCT FROM prev THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY o) AS g FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY o) AS prev FROM {src})) GROUP BY conv_id, g, role)"
    )


_WITH_TARGET = "y AS (SELECT conv_id, o, role, content FROM x UNION ALL SELECT conv_id, 1000000, 'assistant', target FROM base WHERE coalesce(target, '') <> '' AND len(i) > 0), " + _folded("ft", "y")
_PLAIN = _folded("fp", "x")
_FULL = "full_ AS (SELECT * FROM ft UNION ALL SELECT conv_id, 2000000, 'assistant', '" + C.LAST_ASSISTANT + "' FROM ft GROUP BY conv_id HAVING max_by(role, o) <> 'assistant')"
_FRAME = "string_agg('[' || role || ']' || chr(10) || content || '[/' || role || ']' || chr(10), '' ORDER BY o)"
_HEAD = "(CASE WHEN coalesce(system, '') <> '' THEN '[system]' || chr(10) || system || '[/system]' || chr(10) ELSE '' END)"
_PAIRS = f"pairs AS (SELECT b.conv_id, {_HEAD} || (SELECT {_FRAME} FROM fp WHERE fp.conv_id = b.conv_id) || '[assistant]' || chr(10) AS prompt, {_HEAD} || (SELECT {_FRAME} FROM full_ WHERE full_.conv_id = b.conv_id) AS full_text FROM base b WHERE len(b.i) > 0)"
_DATE = "'[date]2024-01-01[/date]' || chr(10) || "


def _instruction_sql(masked: bool) -> str:
    return (
        f"WITH {_ROWS}{_PLAIN}, {_WITH_TARGET}, {_FULL}, {_PAIRS}, w AS (SELECT conv_id, {SQL.words('lower(prompt)')} AS p, {SQL.words('lower(full_text)')} AS f FROM pairs), "
        f"v AS (SELECT row_number() OVER (ORDER BY n DESC, word) + 3 AS token_id, word FROM (SELECT word, count(*) AS n FROM (SELECT unnest(f) AS word FROM w) GROUP BY 1 ORDER BY n DESC, word LIMIT {VOCAB})), "
        f"e AS (SELECT conv_id, len(f) + 1 AS n, least(len(p), {LENGTH}) AS m, f[1:{LENGTH - 1}] AS g FROM w), "
        f"t AS (SELECT conv_id, n, m, i - 1 AS i, CASE WHEN i <= len(g) THEN coalesce(token_id, 1) WHEN i = len(g) + 1 THEN 2 ELSE 0 END AS id, i <= len(g) + 1 AS real FROM (SELECT *, unnest(range(1, {LENGTH} + 1)) AS i FROM e) LEFT JOIN v ON v.word = g[i]) "
        f"SELECT conv_id, any_value(n)::BIGINT AS n, array_to_string(list(id ORDER BY i), ',') AS input_ids, array_to_string(list(CASE WHEN real{' AND i >= m' if masked else ''} THEN 1 ELSE 0 END ORDER BY i), ',') AS attention_mask, "
        "array_to_string(list(CASE WHEN real AND i >= m THEN id ELSE -100 END ORDER BY i), ',') AS labels FROM t GROUP BY conv_id"
    )


QUERIES = {f.__name__: f for f in (conversation_repair, prompt_pairs, instruction_labels_context, instruction_labels_response_only, keyed_split, turn_counts)}

ORACLES = {
    "conversation_repair": f"WITH {_ROWS}{_WITH_TARGET}, {_FULL} SELECT b.conv_id, coalesce(b.system, '') AS system, (SELECT count(*) FROM full_ f WHERE f.conv_id = b.conv_id) AS n_turns, (SELECT string_agg(role || ':' || content, chr(10) || '--' || chr(10) ORDER BY o) FROM full_ f WHERE f.conv_id = b.conv_id) AS turns, CASE WHEN coalesce(len(b.i), 0) = 0 THEN 'no input' END AS error FROM base b",
    "prompt_pairs": f"WITH {_ROWS}{_PLAIN}, {_WITH_TARGET}, {_FULL}, {_PAIRS} SELECT conv_id, {_DATE}prompt AS prompt, {_DATE}full_text AS prompt_and_response FROM pairs",
    "instruction_labels_context": _instruction_sql(False),
    "instruction_labels_response_only": _instruction_sql(True),
    "keyed_split": "SELECT conv_id, key, CASE WHEN r <= ceil(n * 0.3::DOUBLE) THEN 'valid' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5('1234-' || conv_id), conv_id) AS r, count(*) OVER (PARTITION BY key) AS n FROM (SELECT conv_id, min_by(role, turn) AS key FROM conversations GROUP BY 1))",
    "turn_counts": "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1",
}
