"""NDJSON datasets with an optional header row, and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

HEADER = "__header__"


def is_header(line: Column) -> Column:
    """Whether a line is an object with the header's key at the top level; a text that only mentions it is data."""
    return F.coalesce(F.array_contains(F.json_object_keys(line), HEADER), F.lit(False))


def read_strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed rows; blank lines are skipped, a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed rows without malformed lines and header rows, with `_file`; presence of keys is tested on the text before it is typed."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file")).where(F.trim("value") != "")
    good = lines.where(F.try_parse_json("value").isNotNull() & ~is_header(F.col("value")))
    return good.select(F.from_json("value", schema if isinstance(schema, str) else schema.simpleString()).alias("_r"), "_file").select("_r.*", "_file")


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """Header rows as JSON text, one for each file that has one."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    return lines.select("_file", F.get_json_object("value", f"$.{HEADER}").alias("header")).where("header is not null")


def load_statistics(spark: SparkSession, path: str) -> DataFrame:
    """Lines, blank, malformed and header rows of the files."""
    v = F.col("value")
    blank, bad = F.trim(v) == "", F.try_parse_json(v).isNull()
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("lines"), F.count_if(blank).alias("blank"), F.count_if(~blank & bad).alias("malformed"), F.count_if(is_header(v)).alias("headers"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompts of objects (`prompt`, else `text`) and of bare values."""
    v = F.col("value")
    return spark.read.text(path).where(F.trim("value") != "").select(F.coalesce(F.get_json_object(v, "$.prompt"), F.get_json_object(v, "$.text"), F.regexp_replace(F.trim(v), '^"|"$', "")).alias("prompt"))


def last_by_id(df: DataFrame, key: str = "id", position: str = "_pos") -> DataFrame:
    """The last row of each id; rows without an id are left out."""
    from granary.operators.ordered import keep_first

    return keep_first(df.where(F.col(key).isNotNull()), [F.col(key)], [F.col(position)], last=True)


def read_fixtures(spark: SparkSession, folder: str) -> DataFrame:
    """Tool fixtures of a folder of .jsonl files: the tool is the row's name, or else the file's; dots are underscores."""
    lines = spark.read.option("pathGlobFilter", "*.jsonl").text(folder).select("value", F.col("_metadata.file_name").alias("_f"))
    stem = F.regexp_replace("_f", r"\.jsonl$", "")
    name = F.replace(F.coalesce(F.get_json_object("value", "$.name"), stem), F.lit("."), F.lit("_"))
    return lines.where(F.trim("value") != "").select(name.alias("name"), F.get_json_object("value", "$.key").alias("key"), F.get_json_object("value", "$.result").alias("result"))


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows as NDJSON; nulls are written, so that a missing key can be told from a null."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_with_manifest(df: DataFrame, path: str, parameters: dict[str, str]) -> None:
    """Rows as NDJSON, and beside them a manifest with their count and the parameters."""
    write(df, f"{path}/data")
    stats = df.sparkSession.read.text(f"{path}/data").agg(F.count(F.lit(1)).alias("rows"))
    for k, v in parameters.items():
        stats = stats.withColumn(k, F.lit(v))
    write(stats, f"{path}/manifest")


def missing_from_cache(prompts: DataFrame, cache: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Prompts whose SHA-256 isn't in the cache's `key`."""
    keyed = prompts.withColumn("_key", F.sha2(prompt, 256))
    return keyed.join(cache.select(F.col("key").alias("_key")).distinct(), "_key", "left_anti").drop("_key")
