"""Stores beside datasets: resumable output, metrics, audit rows, fingerprints, configuration, promoted versions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def resume(spark: SparkSession, todo: DataFrame, key: str, path: str, work: Callable[[DataFrame], DataFrame], budget: int | None = None, cost: Column | None = None, batch: int | None = None) -> int:
    """Append work(rows) to the Parquet table at `path` for rows of `todo` whose key isn't there yet; returns how many rows were new.

    `batch` rows (the least keys first) are done in one call; a call that was interrupted leaves whole appends only, so calling again goes
    on where it stopped. `budget`: no work is begun once the written `cost` reaches it.
    """
    left = todo
    if exists(spark, path):
        done = spark.read.parquet(path)
        if budget is not None and (done.agg(F.sum(cost)).first()[0] or 0) >= budget:
            return 0
        left = todo.join(done.select(key), key, "left_anti")
    if batch is not None:
        left = left.orderBy(key).limit(batch)
    n = left.count()
    if n:
        work(left).write.mode("append").parquet(path)
    return n


def append_metrics(metrics: DataFrame, path: str) -> None:
    """One more part of NDJSON lines; nulls are written."""
    metrics.write.mode("append").option("ignoreNullFields", "false").json(path)


def audit_rows(calls: DataFrame, tool: str, args: Column, start: Column, end: Column, error: Column) -> DataFrame:
    """One audit row for each call: tool, args, start, end, latency_ms, status, error."""
    latency = (F.unix_micros(end) - F.unix_micros(start)) / 1000.0
    return calls.select(F.col(tool).alias("tool"), args.alias("args"), start.alias("start"), end.alias("end"), latency.alias("latency_ms"), F.when(error.isNull(), "ok").otherwise("error").alias("status"), error.alias("error"))


def file_fingerprint(spark: SparkSession, path: str, header: str = "__header__") -> str:
    """SHA-256 over the lines of a text file, in order, without those that hold the header's key at the top level.

    The file's own bytes are read once, on one machine, line by line: a hash of a whole file has no parallel form.
    """
    digest = hashlib.sha256()
    for row in spark.read.text(path).coalesce(1).toLocalIterator():
        line = row["value"]
        try:
            value = json.loads(line)
        except json.JSONDecodeError:
            value = None
        if not (isinstance(value, dict) and header in value):
            digest.update(line.encode("utf-8", "surrogatepass") + b"\n")
    return digest.hexdigest()


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows and an order-free digest; a row's hash is taken of all its columns."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def config_fingerprint(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def deep_merge(base: dict, override: dict) -> dict:
    """Mappings merged at every level; elsewhere the right one wins."""
    return base | {k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in override.items()}


def load_config(spark: SparkSession, *paths: str) -> dict:
    """JSON files, later ones over earlier ones."""
    out: dict = {}
    for path in paths:
        out = deep_merge(out, json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())))
    return out


def without_old(df: DataFrame, created: str, now: Column, days: float) -> DataFrame:
    """Rows that are no older than `days`."""
    return df.where(F.unix_micros(created) >= F.unix_micros(now) - F.lit(int(days * 86_400_000_000)))


def load_registry(spark: SparkSession, folder: str) -> dict:
    """JSON schema files of a folder as a registry of operators.tools: tool to (required names, properties)."""
    out = {}
    for r in spark.read.text(f"{folder}/*.json", wholetext=True).withColumn("path", F.input_file_name()).collect():  # a row for each schema
        schema = json.loads(r["value"])
        rules = {k: (p.get("type", "string"), tuple(p["enum"]) if "enum" in p else None, p.get("minimum"), p.get("maximum")) for k, p in schema.get("properties", {}).items()}
        out[schema.get("title") or r["path"].rsplit("/", 1)[1].removesuffix(".json")] = (tuple(schema.get("required", ())), rules)
    return out


def with_validation_errors(df: DataFrame, record: Column, registry_entry: tuple) -> DataFrame:
    """`df` with `_validation_error`: what its JSON text breaks of a schema, or null; no row goes."""
    from granary.operators.tools import argument_errors

    errors = argument_errors(record, *registry_entry)
    broken = F.try_parse_json(record).isNull()
    return df.withColumn("_validation_error", F.when(broken, "not JSON").when(F.size(errors) > 0, F.array_join(errors, ",")))


def promote(df: DataFrame, root: str, version: str, passed: bool) -> str:
    """Write a dataset and its manifest to `root`/`version`, if its gates passed and the version isn't there yet."""
    spark, path = df.sparkSession, f"{root}/{version}"
    if not passed:
        raise ValueError("the gates did not pass")
    if exists(spark, path):
        raise ValueError(f"{path} exists")
    df.write.parquet(f"{path}/data")
    table_fingerprint(spark.read.parquet(f"{path}/data")).write.json(f"{path}/manifest")
    return path
