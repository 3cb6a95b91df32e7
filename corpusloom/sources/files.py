"""File sources and sinks: text, CSV, JSON and JSON lines, saved datasets, reports."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.sources import json_arrays
from corpusloom.sources import shards as sharded

#: Extensions that are read; the match is case-sensitive.
EXTENSIONS = ("txt", "csv", "json", "jsonl")


def extension(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1))


def relative(path: Column, base: str) -> Column:
    """The path below ``base``, whatever scheme and prefix Spark has put before it."""
    clean = base.split("://")[-1].split(":", 1)[-1].rstrip("/")
    return F.regexp_replace(path, "^.*?" + _escaped(clean) + "/", "")


def _escaped(text: str) -> str:
    return "".join(f"\\{c}" if not (c.isalnum() or c in "/_") else c for c in text)


def first_component(rel: Column) -> Column:
    return F.when(F.contains(rel, F.lit("/")), F.split_part(rel, F.lit("/"), F.lit(1))).otherwise(F.lit("root"))


def inventory(spark: SparkSession, base: str, only: str | None = None) -> DataFrame:
    """source (directory relative to ``base``, empty at its top), path and ext of the readable files below ``base``.

    Contents aren't read. Directories without such files don't show.
    """
    if only is not None and only not in EXTENSIONS:
        raise ValueError(f"unsupported extension {only}; supported are {', '.join(EXTENSIONS)}")
    glob = f"*.{only}" if only else "*.{" + ",".join(EXTENSIONS) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(base).select("path")
    rel = relative(F.col("path"), base)
    return files.select(F.regexp_replace(rel, "/?[^/]*$", "").alias("source"), "path", extension(F.col("path")).alias("ext"))


def _paths(base: str | list[str]) -> list[str]:
    return [base] if isinstance(base, str) else list(base)


def read_lines(spark: SparkSession, base: str | list[str], glob: str = "*.txt") -> DataFrame:
    """A row for each line, with the path it is from."""
    out = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(_paths(base))
    return out.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))


def read_whole(spark: SparkSession, base: str | list[str], glob: str = "*.txt", squeeze: bool = True) -> DataFrame:
    """A row for each file; ``squeeze`` makes double line feeds single. Bytes that aren't UTF-8 are dropped."""
    out = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(_paths(base), wholetext=True)
    text = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.replace(F.make_valid_utf8("value"), F.lit("�"), F.lit("")))
    if squeeze:
        text = F.replace(text, F.lit("\n\n"), F.lit("\n"))
    return out.select(text.alias("text"), F.col("_metadata.file_path").alias("path"))


def read_csv(spark: SparkSession, base: str | list[str], text_column: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Rows of CSV files with a header; ``text_column`` becomes ``text``."""
    out = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(_paths(base), header=True, multiLine=True, escape='"', encoding=encoding)
    return out.withColumnRenamed(text_column, "text") if text_column else out


def json_text(value: Column, text_key: str) -> Column:
    """The string at a key of a JSON object; null for other rows and for values of another kind."""
    v = F.try_parse_json(value)
    at = f"$.{text_key}"
    kind = F.schema_of_variant(F.try_variant_get(v, at, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(v, at, "string"))


def pretty_json(value: Column) -> Column:
    """A JSON text indented by two, with its keys in order; null if it isn't JSON. No built-in prints it so."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(json.loads(x), ensure_ascii=False, indent=2)
        except ValueError:
            return None

    @F.pandas_udf("string")
    def pretty(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(one)

    return pretty(value)


def read_jsonl(spark: SparkSession, base: str | list[str], text_key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """text and path of the good lines, and value and path of those that aren't JSON or lack the key."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(_paths(base))
    lines = lines.select("value", F.col("_metadata.file_path").alias("path")).filter(F.trim("value") != "")
    read = lines.withColumn("text", json_text(F.col("value"), text_key) if text_key else pretty_json(F.col("value")))
    return read.filter("text IS NOT NULL").select("text", "path"), read.filter("text IS NULL").select("value", "path")


def json_rows(spark: SparkSession, base: str | list[str]) -> DataFrame:
    """The objects of JSON files as JSON texts, with their path; a file is one object or an array of them, of any length."""
    return json_arrays.elements(spark, _paths(base))


def read_json(spark: SparkSession, base: str | list[str], text_key: str | None = None) -> DataFrame:
    """text and path of the objects of JSON files, by key or printed whole; others are left out."""
    out = json_rows(spark, base)
    return out.select((json_text(F.col("value"), text_key) if text_key else pretty_json(F.col("value"))).alias("text"), "path").filter("text IS NOT NULL")


def read_directory(spark: SparkSession, base: str, only: str | None = None, text_key: str | None = None, text_column: str | None = None, whole_files: bool = False) -> DataFrame:
    """text and path of all readable files below ``base``; raises if there are none."""
    found = {r["ext"] for r in inventory(spark, base, only).select("ext").distinct().collect()}
    if not found:
        raise ValueError(f"no valid data found below {base}")
    parts = []
    if "txt" in found:
        parts.append(read_whole(spark, base) if whole_files else read_lines(spark, base))
    if "csv" in found:
        parts.append(read_csv(spark, base, text_column).withColumn("path", F.input_file_name()))
    if "json" in found:
        parts.append(read_json(spark, base, text_key))
    if "jsonl" in found:
        parts.append(read_jsonl(spark, base, text_key)[0])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def keyed_files(files: DataFrame, keys: list[str]) -> DataFrame:
    """key and path: of the files with a directory named like a key, the last by path."""
    wanted = F.explode(F.array(*[F.lit(k) for k in keys]))
    met = files.select("path", wanted.alias("key")).filter(F.contains("path", F.concat(F.lit("/"), F.col("key"), F.lit("/"))))
    return met.groupBy("key").agg(F.max("path").alias("path"))


def with_language(rows: DataFrame, include: list[str] | None = None) -> DataFrame:
    """``rows`` with the directory of their path as ``language``, of those asked for."""
    out = rows.withColumn("language", F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1))
    return out.filter(F.col("language").isin(include)) if include else out


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def list_files(spark: SparkSession, base: str, glob: str = "*") -> DataFrame:
    """path of all files below a directory, in order; raises if it isn't there or no directory, warns if it is empty."""
    fs, where = _file_system(spark, base)
    if not fs.exists(where):
        raise FileNotFoundError(f"{base} doesn't exist")
    if not fs.getFileStatus(where).isDirectory():
        raise NotADirectoryError(f"{base} is not a directory")
    out = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(base).select("path").orderBy("path")
    if out.isEmpty():
        warnings.warn(f"no files below {base}", stacklevel=2)
    return out


def analysis_inputs(spark: SparkSession, base: str) -> DataFrame:
    """path, ext and kind (raw or tokenized) of what can be analysed below a directory: .txt is raw, .json and .jsonl are tokenized."""
    found = list_files(spark, base, "*.{txt,json,jsonl}").withColumn("ext", extension(F.col("path")))
    return found.withColumn("kind", F.when(F.col("ext") == "txt", F.lit("raw")).otherwise(F.lit("tokenized")))


_STRINGS = "array<string>"


def instruction_columns(rows: DataFrame, value: str = "value") -> DataFrame:
    """``rows`` with system, input, assistance and target from a column of JSON objects, which is dropped.

    input and assistance may be a string or a list of strings; what has another kind is null.
    """
    v = F.try_parse_json(value)

    def at(key: str, kind: str) -> Column:
        return F.try_variant_get(v, f"$.{key}", kind)

    def strings(key: str) -> Column:
        one = F.when(F.schema_of_variant(at(key, "variant")) == "STRING", F.array(at(key, "string")))
        return F.coalesce(one, at(key, _STRINGS), F.array().cast(_STRINGS))

    kept = [c for c in rows.columns if c != value]
    target = F.coalesce(F.when(F.schema_of_variant(at("target", "variant")) == "STRING", at("target", "string")), F.get(at("target", _STRINGS), F.lit(0)))
    return rows.select(*kept, F.coalesce(X.strip(at("system", "string")), F.lit("")).alias("system"), strings("input").alias("input"), strings("assistance").alias("assistance"), target.alias("target"))


def read_instructions(spark: SparkSession, base: str, form: str = "files", keys: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """Instruction rows (system, input, assistance, target) with the tag that the form gives them.

    files with ``keys``: of the files in a directory named like a key the last
    one, tagged ``key``, and no rows without any; files: all JSON files, tagged
    ``file``; multilanguage_files: JSON files in subdirectories, tagged
    ``language``, of those asked for; dataset: a saved one as it is.
    """
    if form == "dataset":
        return load(spark, base)
    if form not in ("files", "multilanguage_files"):
        raise ValueError(f"unknown form {form}; known are files, multilanguage_files, dataset")
    if form == "multilanguage_files":
        rows = with_language(json_rows(spark, base), languages)
        return instruction_columns(rows.filter(F.concat(F.lit("/"), relative(F.col("path"), base)).rlike("^/[^/]+/[^/]+$")).drop("path"))
    rows = json_rows(spark, base)
    if not keys:
        return instruction_columns(rows.withColumnRenamed("path", "file"))
    chosen = keyed_files(rows.select("path").distinct(), keys)  # a row for each key at most
    return instruction_columns(rows.join(F.broadcast(chosen), "path").drop("path"))


def required_columns(df: DataFrame, names: list[str]) -> None:
    """Raises if columns that a training set needs are missing, naming all of them."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")


def load_training(spark: SparkSession, path: str, names: tuple[str, ...] = ("input_ids", "attention_mask", "labels")) -> DataFrame:
    """A saved set for training: with its splits, or all train, and the columns that training needs."""
    out = load(spark, path)
    required_columns(out, list(names))
    return out


def save(df: DataFrame, path: str, shards: int | None = None, rows_per_file: int | None = None, shard_bytes: int | None = None) -> None:
    """Writes a dataset, by split if it has one; ``shard_bytes`` bounds the rows of a file by their sizes as JSON."""
    if shard_bytes:
        sharded.save(df.repartition(shards) if shards else df, path, shard_bytes, "split" if "split" in df.columns else None)
        return
    out = (df.repartition(shards) if shards else df).write.mode("errorifexists")
    if rows_per_file:
        out = out.option("maxRecordsPerFile", rows_per_file)
    if "split" in df.columns:
        out = out.partitionBy("split")
    out.parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, wherever Spark can write; an old one is replaced."""
    fs, where = _file_system(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_summary(spark: SparkSession, path: str, summary: dict) -> None:
    """A JSON summary; values that JSON has no form for are written as strings."""
    write_text(spark, path, json.dumps(summary, indent=2, ensure_ascii=False, default=str))


def markdown_table(rows: list, columns: list[str]) -> str:
    """Rows as a Markdown table, pipes escaped; for reports of a few rows."""
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    lines = [f"| {' | '.join(map(cell, columns))} |", f"|{'---|' * len(columns)}"]
    return "\n".join([*lines, *(f"| {' | '.join(cell(r[c]) for c in columns)} |" for r in rows)]) + "\n"


def write_report(spark: SparkSession, path: str, title: str, sections: dict[str, DataFrame], most: int = 1000) -> None:
    """A Markdown report with a table for each section, of at most ``most`` rows; more are counted at its end."""
    parts = [f"# {title}\n"]
    for name, df in sections.items():
        rows = df.limit(most + 1).collect()
        parts.append(f"\n## {name}\n\n{markdown_table(rows[:most], df.columns)}")
        if len(rows) > most:
            parts.append(f"\n{df.count() - most} more not shown\n")
    write_text(spark, path, "".join(parts))


def write_problems(problems: DataFrame, path: str) -> None:
    """A text report of problem files (category, source, name), by category and source, each in order."""
    heads = problems.groupBy("category", "source").agg(F.count("*").alias("n"))
    lines = heads.select("category", "source", F.lit("").alias("name"), F.concat(F.lit("["), X.title(F.col("category")), F.lit("] "), "source", F.lit(": "), F.col("n").cast("string")).alias("line"))
    lines = lines.unionByName(problems.select("category", "source", "name", F.concat(F.lit("  "), "name").alias("line")))
    lines.orderBy("category", "source", "name").select("line").write.text(path)


def write_samples(df: DataFrame, path: str, n: int = 10) -> None:
    """JSON lines of the first ``n`` rows of each split, in a folder for each."""
    splits = [r["split"] for r in df.select("split").distinct().orderBy("split").collect()]
    for split in splits:
        df.filter(F.col("split") == split).drop("split").limit(n).coalesce(1).write.json(f"{path.rstrip('/')}/{split}")


def load(spark: SparkSession, path: str) -> DataFrame:
    """A saved dataset; without a split all rows are train."""
    out = sharded.load(spark, path)
    return out if "split" in out.columns else out.withColumn("split", F.lit("train"))


def write_metrics_csv(merged: DataFrame, step: str, path: str) -> None:
    """One CSV of metrics by step, columns in order of their names."""
    merged.select(*sorted(merged.columns)).coalesce(1).sortWithinPartitions(step).write.csv(path, header=True)


def validation_split(names: list[str]) -> str:
    """The first split that looks like one for validation, else the first."""
    for fragment in ("valid", "val", "test"):
        for name in names:
            if fragment in name:
                return name
    return names[0]
