"""Training telemetry in tabular form: rolling rates, running totals, schedules, step plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import lexicons as L


# Seconds of the units that times can be told in.
UNITS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}


#: Rows of a run that one task takes; the rows before them that a window needs come along.
BLOCK = 1 << 16


def in_blocks(df: DataFrame, pos: str, before: int, block: int = BLOCK) -> DataFrame:
    """``df`` with ``_block``, ``block`` places of ``pos`` (dense, from 0) each, and ``_home``, a row's own block.

    The last ``before`` rows of each block stand in the next one, too, so that windows over
    (run, _block) are whole; rows whose ``_home`` isn't ``_block`` are dropped behind them.
    """
    if before > block:
        raise ValueError(f"a window over {before} rows needs blocks of as many, not of {block}")
    home = F.expr(f"cast({pos} AS bigint) div {block}")
    both = F.when(F.pmod(F.col(pos), F.lit(block)) >= block - before, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumns({"_home": home, "_block": F.explode(both)})


def rolling(df: DataFrame, run: str, order: str, samples: str, clock: str, window: int, loss: str | None = None, log_every: int = 1, lengths: str | None = None, flops: str | None = None, world: int = 1, available: float | None = None, block: int = BLOCK) -> DataFrame:
    """Rows whose window of ``window`` + 1 is full, with rates over it; a window without time has nulls.

    ``order`` counts the rows of a run from 1. samples_per_sec and batches_per_sec of one device; with ``lengths`` (running
    total of tokens) tokens_per_sec and total_tokens of all ``world`` devices;
    with ``flops`` (of a batch on one device) flops_per_sec of all and, where the
    ``available`` figure of a device is known, the share ``mfu`` of it; with
    ``loss`` its mean over ``log_every`` rows and the perplexity. A run of any
    length is dealt out in blocks.
    """
    w = Window.partitionBy(run, "_block").orderBy(order)
    full = w.rowsBetween(-window, 0)
    took = F.col(clock) - F.first(clock).over(full)
    seen = F.col(samples) - F.first(samples).over(full)
    rows = in_blocks(df.withColumn("_pos", F.col(order) - 1), "_pos", max(window, log_every - 1), block)
    out = rows.withColumns({"_n": F.count("*").over(full), "samples_per_sec": F.try_divide(seen, took), "batches_per_sec": F.try_divide(F.lit(window), took)})
    if lengths:
        each = (F.col(lengths) - F.first(lengths).over(full)) / window
        out = out.withColumns({"tokens_per_sec": F.try_divide(seen * world, took) * each, "total_tokens": each * world * F.col(samples)})
    if flops:
        done = (F.sum(flops).over(full) - F.first(flops).over(full)) * world
        out = out.withColumn("flops_per_sec", F.try_divide(done, took))
        if available:
            out = out.withColumn("mfu", F.col("flops_per_sec") / world / available)
    if loss:
        mean = F.avg(loss).over(w.rowsBetween(1 - log_every, 0))
        out = out.withColumns({"mean_loss": mean, "perplexity": F.exp(mean)})
    return out.filter((F.col("_home") == F.col("_block")) & (F.col("_n") == window + 1)).drop("_n", "_pos", "_home", "_block")


def elapsed(train: Column, valid: Column, unit: str = "seconds") -> dict[str, Column]:
    """Times of training, validation and both in a unit; raises for one that isn't known."""
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit}; known are {', '.join(UNITS)}")
    return {"time_train": train / UNITS[unit], "time_val": valid / UNITS[unit], "time_total": (train + valid) / UNITS[unit]}


def epoch_progress(n: Column, batch: int, world: int, accumulate: Column, epoch: Column, step: Column) -> Column:
    """Where in its epoch (from 1) an optimizer step lies, in percent; accumulation below 1 counts as 1."""
    per_epoch = F.greatest(F.lit(1), F.floor(F.floor(n / (batch * world)) / F.greatest(accumulate, F.lit(1))))
    return (step - (epoch - 1) * per_epoch) / per_epoch * 100


def position_label(percent: Column, epoch: Column) -> Column:
    return F.format_string("%.1f%% of epoch %d", percent, epoch)


def positions(df: DataFrame, by: str, order: str, width: int = 1 << 16, ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``pos``, a row's place from 0 within its group by a whole-number column, then ``ties``, without a task for a whole group.

    Rows are counted by ranges of ``width`` values; running totals over the ranges
    of a group and a rank within a range give the place.
    """
    rows = df.withColumn("_range", F.floor(F.col(order) / width))
    counts = rows.groupBy(by, "_range").agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), (upto - F.col("_k")).alias("_before"))
    out = rows.join(counts, F.col(by).eqNullSafe(F.col("_by")) & F.col("_range").eqNullSafe(F.col("_r")))
    rank = F.row_number().over(Window.partitionBy(by, "_range").orderBy(order, *ties))
    return out.withColumn("pos", F.col("_before") + rank - 1).drop("_range", "_by", "_r", "_before")


def layer_class(model: Column) -> Column:
    """The name of a model's layer class, by the first known fragment in its name; null if none is."""
    out = F.lit(None).cast("string")
    for fragment, name in reversed(L.LAYER_CLASSES):
        out = F.when(F.contains(F.lower(model), F.lit(fragment)), F.lit(name)).otherwise(out)
    return out


def running_total(df: DataFrame, run: str, order: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """``df`` with the total of ``value`` so far; ``order`` counts the rows of a run from 1.

    A prefix scan: sums of blocks, totals over the blocks before, and totals within a block.
    """
    rows = df.withColumn("_block", F.expr(f"cast({order} - 1 AS bigint) div {block}"))
    before = Window.partitionBy("_run").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(F.col(run).alias("_run"), F.col("_block").alias("_b")).agg(F.sum(value).alias("_s")).withColumn("_before", F.sum("_s").over(before)).drop("_s")
    out = rows.join(sums, F.col(run).eqNullSafe(F.col("_run")) & (F.col("_block") == F.col("_b")))
    own = F.sum(value).over(Window.partitionBy(run, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn(name, F.coalesce(own + F.col("_before"), own, F.col("_before"))).drop("_block", "_run", "_b", "_before")


def metric_names(metrics: DataFrame, name: str, most: int = 10_000) -> list[str]:
    """The distinct names of a long table of metrics, sorted; raises where there are too many for columns."""
    found = [r[0] for r in metrics.select(name).filter(F.col(name).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} metrics can't be columns")
    return sorted(found)


def wide(metrics: DataFrame, name: str, value: str) -> DataFrame:
    """A long table of metrics with a column for each name that occurs in it."""
    return metrics.select("*", *[F.when(F.col(name) == k, F.col(value)).alias(k) for k in metric_names(metrics, name)]).drop(name, value)


def merged_by_step(metrics: DataFrame, step: str, seq: str, names: list[str]) -> DataFrame:
    """One row a step with the last value of each metric, from sparse rows; rows without a step drop out."""
    last = [F.max_by(n, F.when(F.col(n).isNotNull(), F.col(seq))).alias(n) for n in sorted(names)]
    return metrics.filter(F.col(step).isNotNull()).groupBy(step).agg(*last)


def schedule(spark: SparkSession, kind: str, total: int, warmup: int, base: float = 1.0) -> DataFrame:
    """step and lr for the steps 0 to ``total`` of a schedule by its name."""
    t = F.col("step").cast("double")
    ramp = t / max(1, warmup)
    past = F.lit(0.0) if total == warmup else (t - warmup) / (total - warmup)
    forms: dict[str, Column] = {
        "fixed": F.lit(1.0),
        "cosine": (1 + F.cos(F.pi() * t / max(1, total))) / 2,
        "warmup_constant": F.when(t < warmup, ramp).otherwise(F.lit(1.0)),
        "warmup_linear": F.when(t < warmup, ramp).otherwise(F.greatest(F.lit(0.0), 1 - past)),
        "warmup_cosine": F.when(t < warmup, ramp).otherwise(F.greatest(F.lit(0.0), (1 + F.cos(F.pi() * past)) / 2)),
        "warmup_cosine_restart": F.when(t < warmup, ramp).when(past >= 1, F.lit(0.0)).otherwise((1 + F.cos(F.pi() * past)) / 2),
    }
    if kind not in forms:
        raise ValueError(f"unknown schedule {kind}; known are {', '.join(forms)}")
    return spark.range(total + 1).select(F.col("id").alias("step"), (forms[kind] * base).alias("lr"))


def step_plan(n: int, batch: int, world: int, epochs: int, accumulate: int, warmup: float) -> dict[str, int]:
    """Optimizer steps an epoch's batches come to, in all and for the warm-up."""
    per_epoch = n // (batch * world)
    total = per_epoch * epochs // accumulate
    return {"steps_per_epoch": per_epoch, "micro_steps": per_epoch * epochs, "total_steps": total, "warmup_steps": int(total * warmup)}


def validation_steps(steps: int, times: int) -> list[int]:
    return sorted({max(1, int(i / times * steps)) for i in range(1, times + 1)})


def device_key(name: Column) -> Column:
    """The row of the table of devices that a device's name leads to; null if none."""
    out = F.lit(None).cast("string")
    low = F.lower(name)
    for family, parts, key in reversed(L.DEVICE_ROUTES):
        hit = F.contains(low, F.lit(family)) & F.lit(False)
        for p in parts:
            hit = hit | (F.contains(low, F.lit(family)) & F.contains(low, F.lit(p)))
        out = F.when(hit, F.lit(key)).otherwise(out)
    return out
