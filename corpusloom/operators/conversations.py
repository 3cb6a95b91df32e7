"""Conversations: from turns in long form to repaired alternating turns, prompts and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

TURN = "struct<role:string,content:string>"
# What is put in where a turn is missing.
FIRST_USER = "Please help me with the following:"
LAST_ASSISTANT = "I understand. How can I help you?"


def instruction_rows(turns: DataFrame) -> DataFrame:
    """conv_id, system, input, assistance, target from turns (conv_id, turn, role, text).

    Blank system texts are empty. The assistant's last turn, if it is the last of all, is the target.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    c = turns.groupBy("conv_id").agg(ordered.alias("t"))
    pick = lambda role: f"transform(filter(t, x -> x.role = '{role}'), x -> x.text)"
    c = c.select("conv_id", F.expr(pick("system")).alias("s"), F.expr(pick("user")).alias("input"), F.expr(pick("assistant")).alias("a"), F.expr("element_at(t, -1).role = 'assistant'").alias("ended"))
    return c.select(
        "conv_id",
        F.coalesce(strip(F.get("s", F.lit(0))), F.lit("")).alias("system"),
        "input",
        F.expr("CASE WHEN ended THEN slice(a, 1, size(a) - 1) ELSE a END").alias("assistance"),
        F.expr("CASE WHEN ended THEN element_at(a, -1) END").alias("target"),
    )


def build_turns() -> Column:
    """Turns of a row with input and assistance: interleaved, or the first input alone; null without input."""
    several = (
        f"flatten(transform(sequence(0, greatest(size(input), size(assistance)) - 1), k -> filter(array("
        f"CASE WHEN k < size(input) THEN named_struct('role', 'user', 'content', input[k]) END, CASE WHEN k < size(assistance) THEN named_struct('role', 'assistant', 'content', assistance[k]) END), z -> z IS NOT NULL)))"
    )
    single = "array(named_struct('role', 'user', 'content', input[0]))"
    turns = f"CASE WHEN input IS NULL OR size(input) = 0 THEN CAST(NULL AS array<{TURN}>) WHEN assistance IS NOT NULL AND size(assistance) > 0 THEN {several} ELSE {single} END"
    return F.expr(turns)


def repaired(rows: DataFrame, include_target: bool) -> DataFrame:
    """``rows`` with ``turns`` and ``error`` (null, or why there are none).

    Turns alternate, begin with the user and, with the target, end with the
    assistant. Two user turns in a row become one with a blank line between; of
    two assistant turns the later stays. The target replaces a last assistant turn.
    """
    out = rows.withColumn("_t", build_turns())
    if include_target:
        out = out.withColumn("_target", strip(F.col("target")))
        out = out.withColumn("_t", F.expr(
            "CASE WHEN _t IS NULL OR _target IS NULL OR _target = '' THEN _t WHEN element_at(_t, -1).role = 'assistant' "
            "THEN concat(slice(_t, 1, size(_t) - 1), array(named_struct('role', 'assistant', 'content', _target))) ELSE concat(_t, array(named_struct('role', 'assistant', 'content', _target))) END"
        )).drop("_target")
    fold = (
        f"aggregate(_t, CAST(array() AS array<{TURN}>), (a, x) -> CASE WHEN size(a) = 0 OR element_at(a, -1).role <> x.role THEN concat(a, array(x)) "
        "WHEN x.role = 'user' THEN concat(slice(a, 1, size(a) - 1), array(named_struct('role', 'user', 'content', concat(element_at(a, -1).content, '\n\n', x.content)))) "
        "ELSE concat(slice(a, 1, size(a) - 1), array(x)) END)"
    )
    out = out.withColumn("_t", F.expr(fold))
    out = out.withColumn("_t", F.expr(f"CASE WHEN _t[0].role <> 'user' THEN concat(array(named_struct('role', 'user', 'content', '{FIRST_USER}')), _t) ELSE _t END"))
    if include_target:
        out = out.withColumn("_t", F.expr(f"CASE WHEN element_at(_t, -1).role <> 'assistant' THEN concat(_t, array(named_struct('role', 'assistant', 'content', '{LAST_ASSISTANT}'))) ELSE _t END"))
    return out.withColumn("turns", F.col("_t")).withColumn("error", F.when(F.col("_t").isNull(), F.lit("no input"))).drop("_t")


def rendered(turns: str, system: str, generation_prompt: bool, date: str | None = None) -> Column:
    """The prompt text of turns: system text and date first, then each turn in its frame; the frame is ours and fixed."""
    head = F.when(F.col(system) != "", F.concat(F.lit("[system]\n"), F.col(system), F.lit("[/system]\n"))).otherwise(F.lit(""))
    if date:
        head = F.concat(F.lit(f"[date]{date}[/date]\n"), head)
    body = F.expr(f"concat_ws('', transform({turns}, x -> concat('[', x.role, ']\n', x.content, '[/', x.role, ']\n')))")
    return F.concat(head, body, F.lit("[assistant]\n" if generation_prompt else ""))


def prompt_pairs(rows: DataFrame, date: str | None = None) -> DataFrame:
    """``rows`` with prompt (without target, asking for an answer) and prompt_and_response, rows in error left out."""
    out = repaired(rows, False).withColumnRenamed("turns", "_asked").filter("error IS NULL").drop("error")
    out = repaired(out, True).withColumnRenamed("turns", "_full").filter("error IS NULL").drop("error")
    return out.withColumn("prompt", rendered("_asked", "system", True, date)).withColumn("prompt_and_response", rendered("_full", "system", False, date)).drop("_asked", "_full")
