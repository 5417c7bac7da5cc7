"""Scans with contracts: line numbers, strict lines, training rows, scenarios, stage datasets, captures with a sidecar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.ndjson import is_header

STAGE = "input struct<system:string,tools:array<string>,history:array<struct<role:string,content:string>>,tool_result:string>,target string"


def read_every_line(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed rows of a file in which every line must be JSON: a blank or malformed line is an error."""
    lines = spark.read.text(path)
    broken = F.try_parse_json("value").isNull()
    checked = F.when(broken, F.raise_error(F.concat(F.lit("not JSON: "), F.substring("value", 1, 80)))).otherwise(F.col("value"))
    return lines.select(F.from_json(checked, schema).alias("_r")).select("_r.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """_file, line (from 1), value: lines with their place in their file, blank ones counted.

    A file is one row while it is cut, so this is for reports on files that fit a task; datasets are read without numbers.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), "value")
    cut = whole.select("_file", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), "\r?\n", -1)).alias("_at", "value"))
    return cut.select("_file", (F.col("_at") + 1).alias("line"), "value")


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """_file, line of the lines that are neither blank nor JSON."""
    return numbered_lines(spark, path).where((F.trim("value") != "") & F.try_parse_json("value").isNull()).select("_file", "line")


def read_some(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """`value`: JSON lines without header rows, blank and malformed ones; `most` is how many are wanted at most."""
    lines = spark.read.text(path).where((F.trim("value") != "") & F.try_parse_json("value").isNotNull())
    rows = lines.where(~is_header(F.col("value")))
    return rows if most is None else rows.limit(most)


def training_rows(df: DataFrame, prompt: str = "prompt", answer: str = "teacher_text", private: str = "teacher_reasoning_content") -> DataFrame:
    """Rows with a prompt and an answer that are not blank. A row with private reasoning is an error: the scan stops."""
    text = lambda c: F.regexp_like(F.coalesce(c, F.lit("")), F.lit(r"\S"))
    kept = df.where(text(F.col(prompt)) & text(F.col(answer)))
    if private not in df.columns:
        return kept
    # The test is part of a column that every reader of the answer needs, so it can't be pruned away.
    checked = F.when(text(F.col(private)), F.raise_error(F.lit(f"a row has {private}"))).otherwise(F.col(answer))
    return kept.withColumn(answer, checked).drop(private)


def read_scenarios(spark: SparkSession, path: str, schema: str, role: str | None = None) -> DataFrame:
    """Scenarios, those of one role if it is given; only JSON lines that name the role are typed."""
    rows = spark.read.schema(schema).json(path)
    return rows if role is None else rows.where(F.col("role") == role)


def read_stage(spark: SparkSession, path: str, strict: bool) -> DataFrame:
    """Rows of a stage dataset (input, target): a malformed line is an error if `strict`, else it is left out. Blank lines are skipped."""
    return spark.read.schema(STAGE).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def traces(events: DataFrame, meta: DataFrame, file: str, order: str, kind: Column, body: Column) -> DataFrame:
    """One row for each capture file: its events in order, its types, and its sidecar's columns.

    `meta` has the path of the sidecar in `file`: the capture's, with .meta.json for its extension. A capture without one keeps nulls.
    """
    stem = F.regexp_replace(file, r"(\.meta)?\.[^./]+$", "")
    rows = events.select(stem.alias("trace"), F.struct(F.col(order).alias("at"), kind.alias("type"), body.alias("body")).alias("_e")).groupBy("trace").agg(F.array_sort(F.collect_list("_e")).alias("events"))
    side = meta.select(stem.alias("trace"), F.struct(*[c for c in meta.columns if c != file]).alias("meta"))
    return rows.join(side, "trace", "left")
