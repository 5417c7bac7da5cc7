"""Tool calls: registry, argument validation, canonical arguments, fixture lookup, tool inference from keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The default registry (required names; type, allowed values, least and greatest of properties).
REGISTRY = {
    "web.search": (("q",), {"q": ("string", None, None, None), "recency": ("integer", None, 0, 365), "top_k": ("integer", None, 1, 10), "site": ("string", ("example.com", "example.org", "example.net"), None, None)}),
    "web.open": (("url",), {"url": ("string", None, None, None)}),
    "read_file": (("path",), {"path": ("string", None, None, None), "encoding": ("string", ("utf-8", "latin-1"), None, None)}),
    "repo.read": (("path",), {"path": ("string", None, None, None), "grep": ("string", None, None, None)}),
    "file.write": (("path", "content"), {"path": ("string", None, None, None), "content": ("string", None, None, None)}),
    "code.execute": (("language", "code"), {"language": ("string", ("python", "bash", "javascript"), None, None), "code": ("string", None, None, None), "timeout_ms": ("integer", None, 100, 10000)}),
}


def registry_table(spark: SparkSession, registry: dict = REGISTRY) -> DataFrame:
    rows = [(tool, list(req), sorted(props)) for tool, (req, props) in sorted(registry.items())]
    return spark.createDataFrame(rows, "tool string, required array<string>, properties array<string>")


def argument_errors(args: Column, required: tuple[str, ...], properties: dict[str, tuple]) -> Column:
    """Codes missing:, type:, enum:, min:, max: for a JSON text of arguments, in registry order; unknown names are allowed."""
    value = lambda k: F.get_json_object(args, f"$.{k}")
    kind = lambda k: F.schema_of_variant(F.try_variant_get(F.try_parse_json(args), f"$.{k}", "variant"))
    tests = [F.when(value(k).isNull(), F.lit(f"missing:{k}")) for k in required]
    for k, (type_, allowed, least, most) in properties.items():
        there = value(k).isNotNull()
        accepted = {"string": ("STRING",), "integer": ("BIGINT", "BOOLEAN"), "number": ("BIGINT", "DOUBLE", "BOOLEAN")}[type_]
        good = kind(k).isin(*accepted) | (kind(k).startswith("DECIMAL") if type_ == "number" else F.lit(False))
        tests.append(F.when(there & ~good, F.lit(f"type:{k}")))
        if allowed:
            tests.append(F.when(there & ~value(k).isin(*allowed), F.lit(f"enum:{k}")))
        if least is not None:
            tests.append(F.when(value(k).try_cast("double") < least, F.lit(f"min:{k}")))
        if most is not None:
            tests.append(F.when(value(k).try_cast("double") > most, F.lit(f"max:{k}")))
    return F.array_compact(F.array(*tests))


def canonical_arguments(args: Column) -> Column:
    """A map of arguments without nulls, queries in lower case with single blanks, as sorted `name=value` text."""
    entries = F.filter(F.map_entries(F.from_json(args, "map<string,string>")), lambda e: e["value"].isNotNull())
    clean = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.when(e["key"].isin("q", "query"), F.trim(F.regexp_replace(F.lower(e["value"]), r"\s+", " "))).otherwise(e["value"])))
    return F.array_join(F.array_sort(clean), "&")


def lookup(calls: DataFrame, fixtures: DataFrame, name: str = "name", args: str = "args") -> DataFrame:
    """`calls` with `hit` and `result` of the fixture with the same name and canonical arguments; a miss says fixture_miss.

    Names agree whether they have dots or underscores. The broadcast of the fixtures is left to the size that Spark measures.
    """
    plain = lambda c: F.replace(c, F.lit("."), F.lit("_"))
    left = calls.withColumn("_name", plain(F.col(name))).withColumn("_key", canonical_arguments(F.col(args)))
    right = fixtures.select(plain(F.col("name")).alias("_name"), canonical_arguments(F.col("key")).alias("_key"), "result").dropDuplicates(["_name", "_key"])
    found = left.join(right, ["_name", "_key"], "left")
    return found.withColumn("hit", F.col("result").isNotNull()).withColumn("result", F.coalesce("result", F.lit("fixture_miss"))).drop("_name", "_key")


def match_by_keys(df: DataFrame, keys: str, registry: DataFrame) -> DataFrame:
    """`df` with `tool` and `match`: exact if a tool has the same names, else partial or ambiguous if the names are a subset that covers
    half of one tool or of several; none otherwise. Key sets are matched once each; they meet tools on a shared name."""
    sets = df.select(F.col(keys).alias("_keys")).distinct().where(F.size("_keys") > 0)
    by_name = registry.select("tool", "properties", F.explode("properties").alias("_k"))
    pairs = sets.withColumn("_k", F.explode("_keys")).join(by_name, "_k").select("_keys", "tool", "properties").distinct()
    pairs = pairs.where(F.size(F.array_except("_keys", "properties")) == 0).withColumn("_cover", F.size("_keys") / F.size("properties")).where("_cover >= 0.5")
    best = pairs.groupBy("_keys").agg(F.max(F.col("_cover") == 1).alias("_exact"), F.count(F.lit(1)).alias("_n"), F.min_by("tool", F.struct(-F.col("_cover"), "tool")).alias("tool"))
    named = best.select(F.col("_keys").alias(keys), "tool", F.when(F.col("_exact"), "exact").when(F.col("_n") == 1, "partial").otherwise("ambiguous").alias("match"))
    return df.join(named, keys, "left").withColumn("match", F.coalesce("match", F.lit("none")))
