"""Checkpoints: discovery, parameter names, mapping to a model's names, coverage, file names, summary."""

from __future__ import annotations

import io
import pickletools
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of the model's parameters, in percent, below which a mapping is refused.
LEAST_COVERAGE = 95


def discover(spark: SparkSession, path: str) -> DataFrame:
    """path of a single ``.pth`` file or of all below a directory, in order; raises if there is none."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pth")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(f"{path} doesn't exist")
    out = reader.load(path).select("path").orderBy("path")
    if out.isEmpty():
        raise ValueError(f"no .pth files at {path}")
    return out


_NAME = re.compile(r"[A-Za-z_]\w*(\.\w+)+")


def parameter_names(data: bytes) -> list[str]:
    """Dotted names among the strings of a saved checkpoint, read without running its pickle; raises if it is no such file."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        inner = next((n for n in z.namelist() if n.endswith("data.pkl")), None)
        if inner is None:
            raise ValueError("no data.pkl inside")
        strings = [arg for op, arg, _ in pickletools.genops(z.read(inner)) if "UNICODE" in op.name]
    return list(dict.fromkeys(x for x in strings if _NAME.fullmatch(x)))


def parameters(spark: SparkSession, path: str) -> DataFrame:
    """path, params (names) and error of each checkpoint; a file that can't be read has an error and no names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pth").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, errors = [], []
            for content in batch.column("content"):
                try:
                    names.append(parameter_names(content.as_py()))
                    errors.append(None)
                except (ValueError, zipfile.BadZipFile) as e:
                    names.append([])
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(names, pa.list_(pa.string())), pa.array(errors, pa.string())], names=["path", "params", "error"])

    return files.mapInArrow(run, "path string, params array<string>, error string")


def converted(found: DataFrame, model: DataFrame, base: str) -> DataFrame:
    """For each checkpoint of :func:`parameters` its output folder, how much of the model it covers, and whether that is enough."""
    wanted = F.broadcast(model.agg(F.array_distinct(F.collect_list("param")).alias("_model")))  # a model's names: some thousands
    new = F.array_distinct(F.transform("params", renamed))
    out = found.join(wanted).withColumn("loaded", F.size(F.array_intersect("_model", new)).cast("long"))
    pct = F.coalesce(F.try_divide(F.col("loaded") * 100, F.size("_model")), F.lit(0.0))
    ok = F.col("error").isNull() & (pct >= LEAST_COVERAGE)
    error = F.coalesce("error", F.when(~ok, F.format_string("covers %.1f%% of the model", pct)))
    return out.select("path", output_folder(F.regexp_replace("path", r"^[a-z]+:/*", "/"), base).alias("folder"), F.size("params").cast("long").alias("params"), "loaded", F.round(pct, 9).alias("coverage_pct"), ok.alias("ok"), error.alias("error"))


def renamed(param: Column) -> Column:
    return (
        F.when(F.startswith(param, F.lit("model.model.")), F.regexp_replace(param, r"^model\.model\.", "model."))
        .when(param == "model.lm_head.weight", F.lit("lm_head.weight"))
        .otherwise(param)
    )


def key_map(checkpoint: DataFrame, model: DataFrame) -> DataFrame:
    """param, new_key and status: mapped if the model has the new key, else unmapped; the head is never reported unmapped."""
    c = checkpoint.select("param", renamed(F.col("param")).alias("new_key"))
    m = model.select(F.col("param").alias("new_key"), F.lit(True).alias("there"))
    out = c.join(m, "new_key", "left")
    status = F.when(F.col("there"), F.lit("mapped")).when(F.col("new_key") == "lm_head.weight", F.lit("tied")).otherwise(F.lit("unmapped"))
    return out.select("param", "new_key", status.alias("status"))


def coverage(checkpoint: DataFrame, model: DataFrame) -> DataFrame:
    """loaded, missing and coverage_pct of the model's parameters, and whether it is enough."""
    new = checkpoint.select(renamed(F.col("param")).alias("param")).distinct().withColumn("loaded", F.lit(1))
    n = model.join(new, "param", "left").agg(F.count("*").alias("params"), F.count("loaded").alias("loaded"))
    pct = F.try_divide(F.col("loaded") * 100, "params")
    return n.select("params", "loaded", (F.col("params") - F.col("loaded")).alias("missing"), pct.alias("coverage_pct"), (pct >= LEAST_COVERAGE).alias("enough"))


def conversion_summary(results: DataFrame, by: str, ok: str) -> DataFrame:
    """For each group all conversions, those that succeeded and failed, and the percentage; ``ok`` is boolean, null counts as failed."""
    n = results.groupBy(by).agg(F.count("*").alias("total"), F.count_if(ok).alias("ok"))
    return n.select(by, "total", "ok", (F.col("total") - F.col("ok")).alias("failed"), F.round(F.col("ok") * 100 / F.col("total"), 9).alias("ok_pct"))


def output_folder(path: Column, base: str) -> Column:
    """The relative path without its suffix, separators as underscores."""
    rel = F.regexp_replace(F.replace(path, F.lit(f"{base.rstrip('/')}/"), F.lit("")), r"\.[^./]*$", "")
    return F.replace(rel, F.lit("/"), F.lit("_"))


def file_name(epoch: Column, step: Column) -> Column:
    return F.format_string("e-%03d-gs-%06d.pth", epoch, step)
