"""Seeded synthetic rows: stratified cells, prompts with spans, judged pairs, toy rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Least counts of single calls, several calls and recovery from errors, for each scenario.
GRID = {"file_ops": (6, 4, 2), "web_search": (4, 4, 2), "code_exec": (3, 3, 2), "multi_step": (0, 4, 2)}
COMPLEXITY = ("single_call", "multi_call", "branching_error_recovery")
STRUCTURES = ("flat_args", "nested_args", "arrays", "enums", "numeric_ranges", "optional_keys")


def cells(spark: SparkSession, total: int, controls: float = 0.1, seed: int = 7) -> DataFrame:
    """`total` cells: the least grid scaled to the total, filled up by seeded choice, with structures in turn and a share of controls."""
    least = sum(sum(v) for v in GRID.values())
    scale = min(1.0, total / least)
    grid = [(s, c, max(1, int(n * scale))) for s, v in GRID.items() for c, n in zip(COMPLEXITY, v) if n]
    rows = spark.createDataFrame(grid, "scenario string, complexity string, n int").select("scenario", "complexity", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    fixed = rows.select("scenario", "complexity", F.lit(0).alias("extra"), "k")
    names, kinds = F.array(*map(F.lit, GRID)), F.array(*map(F.lit, COMPLEXITY))
    pick = lambda arr, salt: F.get(arr, F.pmod(F.xxhash64("id", F.lit(seed + salt)), F.size(arr)).cast("int"))
    fill = spark.range(total).select(pick(names, 1).alias("scenario"), pick(kinds, 2).alias("complexity"), F.lit(1).alias("extra"), F.col("id").cast("int").alias("k"))
    all_ = fixed.unionByName(fill).orderBy("extra", "scenario", "complexity", "k").limit(total)
    numbered = all_.withColumn("cell", F.row_number().over(Window.orderBy("extra", "scenario", "complexity", "k")) - 1)
    shapes = F.array(*map(F.lit, STRUCTURES))
    control = F.pmod(F.col("cell"), F.lit(max(1, round(1 / controls)))) == F.lit(max(1, round(1 / controls)) - 1) if controls else F.lit(False)
    return numbered.select("cell", "scenario", "complexity", F.get(shapes, F.pmod("cell", F.size(shapes)).cast("int")).alias("structure"), control.alias("control"))


def prompts(cells_: DataFrame, seed: int = 7) -> DataFrame:
    """Prompt, answer, call text, character spans of the call and of the integration, and a stable id, for each cell."""
    call = F.concat(F.lit('{"name": "'), F.col("scenario"), F.lit('", "arguments": {"id": '), F.col("cell").cast("string"), F.lit("}}"))
    said = F.concat(F.lit("found "), (F.pmod(F.xxhash64("cell", F.lit(seed)), F.lit(90)) + 10).cast("string"), F.lit(" items"))
    answer = F.when(F.col("control"), F.concat(F.lit("No tool is needed for request "), F.col("cell").cast("string"), F.lit("."))).otherwise(F.concat(call, F.lit("\nIntegration: "), said, F.lit(". ")))
    at = F.length(call) + F.length(F.lit("\nIntegration: "))
    span = lambda a, b: F.when(~F.col("control"), F.struct(a.cast("int").alias("start"), b.cast("int").alias("end")))
    return cells_.withColumns({
        "sample_id": F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("cell").cast("string"), "scenario", "complexity", "structure"), 256), 1, 16),
        "prompt": F.concat(F.lit("Handle "), F.col("scenario"), F.lit(" ("), F.col("complexity"), F.lit(", "), F.col("structure"), F.lit(")")),
        "answer": answer, "call_span": span(F.lit(0), F.length(call)), "integration_span": span(at, at + F.length(said)),
    })


def judged_pairs(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """Pairs of short answers with a winner, evenly a, b and tie."""
    h = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed + salt)), F.lit(1000))
    side = lambda name, salt: F.struct(F.concat(F.lit(f"answer {name} "), h(salt).cast("string")).alias("text"), F.array(F.lit("EVIDENCE_COMPLETENESS")).alias("clauses"))
    return spark.range(n).select("id", side("a", 1).alias("a"), side("b", 2).alias("b"), F.get(F.array(F.lit("a"), F.lit("b"), F.lit("tie")), F.pmod("id", F.lit(3)).cast("int")).alias("winner"))


def toy_rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select("id", F.concat(F.lit("question "), F.col("id").cast("string")).alias("prompt"), F.concat(F.lit("answer "), F.col("id").cast("string")).alias("answer"))


def long_context(c: Column, least: int = 24_000) -> Column:
    """A text made longer than `least` by repeats of itself."""
    return F.repeat(F.concat(c, F.lit("\n")), F.ceil(F.lit(least) / (F.length(c) + 1)).cast("int"))
