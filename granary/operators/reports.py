"""Aggregate reports, gates and comparisons of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.operators.quantiles import interpolated


def distribution(df: DataFrame, keys: list[str]) -> DataFrame:
    """key, value, n and share for several columns, in one pass over the rows."""
    parts = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])
    counts = df.select(F.explode(parts).alias("p")).groupBy("p.key", "p.value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("key")))


def length_histogram(tokens: Column) -> Column:
    """Bands under 200, 400, 800, 1200, 2000, and the rest."""
    out = None
    for most in (200, 400, 800, 1200, 2000):
        out = F.when(tokens < most, f"<{most}") if out is None else out.when(tokens < most, f"<{most}")
    return out.otherwise(">=2000")


def balance(df: DataFrame, label: str) -> DataFrame:
    """(largest - smallest class) / rows in percent, with a warning above 50."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(((F.max("n") - F.min("n")) / F.sum("n") * 100).alias("imbalance"))
    return n.withColumn("warn", F.col("imbalance") > 50)


def clause_share(df: DataFrame, a: str, b: str) -> DataFrame:
    """Clauses of both sides with their share of all sides."""
    total = F.count(F.lit(1)) * 2
    sides = df.agg(total.alias("sides"))
    counts = df.select(F.explode(F.concat(a, b)).alias("clause")).groupBy("clause").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(sides)).select("clause", "n", (F.col("n") / F.col("sides")).alias("share"))


def summarize(results: DataFrame) -> DataFrame:
    """One row over scored results: counts, rates, macro F1 and harmonic mean of mean precision and recall, over eligible rows."""
    e = F.col("eligible")
    rate = lambda c: F.coalesce(F.avg(F.when(e, F.col(c).cast("double"))), F.lit(0.0))
    s = results.agg(F.count(F.lit(1)).alias("total"), F.count_if(e).alias("n_eligible"), rate("f1").alias("macro_f1"), rate("precision").alias("p"), rate("recall").alias("r"), F.avg(F.col("privacy_ok").cast("int")).alias("privacy_rate"), F.avg(F.col("args_ok").cast("int")).alias("args_rate"), F.count_if("control_hit").alias("controls_hit"))
    return s.withColumn("micro_f1", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)).drop("p", "r")


def gates(summary: DataFrame, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """gate, value, limit and passed for every named measure of a one-row summary. A rate of zero fails like any other low rate."""
    rows = [F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("limit"), (F.coalesce(F.col(k).cast("double"), F.lit(0.0)) >= v).alias("passed")) for k, v in least.items()]
    rows += [F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("limit"), (F.coalesce(F.col(k).cast("double"), F.lit(0.0)) <= v).alias("passed")) for k, v in most.items()]
    return summary.select(F.inline(F.array(*rows)))


def compare_reports(old: DataFrame, new: DataFrame, threshold: float = 0.01, higher_is_better: tuple[str, ...] = ()) -> DataFrame:
    """metric, old, new, delta and status of two one-row reports; changes up to the threshold are same."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(name)) for c in df.columns])))

    both = long(old, "old").join(long(new, "new"), "metric", "full_outer").withColumn("delta", F.col("new") - F.col("old"))
    good = F.when(F.col("metric").isin(*higher_is_better) if higher_is_better else F.lit(False), F.col("delta") > 0).otherwise(F.col("delta") < 0)
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.abs("delta") <= threshold, "same").when(good, "better").otherwise("worse")
    return both.withColumn("status", status)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one row each, with file and time."""
    return spark.read.option("multiLine", True).json(path).withColumns({"_file": F.col("_metadata.file_name"), "_time": F.col("_metadata.file_modification_time")})


def find_baseline(spark: SparkSession, folder: str, task: str, seed: int) -> DataFrame:
    """The newest file `{task}_seed{seed}_*.json` of a folder: path and text."""
    files = spark.read.option("pathGlobFilter", f"{task}_seed{seed}_*.json").text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("at"))
    return files.agg(F.max_by(F.struct("path", "value"), F.struct("at", "path")).alias("f")).select("f.*").where("path is not null")


def match_profile(machines: DataFrame, profiles: list[tuple[str, str, int]], chip: str = "chip", memory: str = "memory_gb") -> DataFrame:
    """`machines` with the first profile (name, pattern, least memory) that fits, else default."""
    out = None
    for name, pattern, least in profiles:
        test = F.col(chip).rlike(pattern) & (F.col(memory) >= least)
        out = F.when(test, name) if out is None else out.when(test, name)
    return machines.withColumn("profile", out.otherwise("default") if out is not None else F.lit("default"))


def budgets(specs: DataFrame, tiers: dict[int, tuple[int, int]], waivers: DataFrame, default: tuple[int, int] = (25, 1000)) -> DataFrame:
    """max_files and max_loc of a spec's tier plus the sums of its active waivers; specs: id, tier; waivers: id, active, files, loc."""
    add = waivers.where("active").groupBy("id").agg(F.sum("files").alias("_f"), F.sum("loc").alias("_l"))
    pick = lambda i: F.coalesce(F.create_map(*[F.lit(x) for t, v in tiers.items() for x in (t, v[i])])[F.col("tier")], F.lit(default[i]))
    return specs.join(add, "id", "left").withColumns({"max_files": pick(0) + F.coalesce("_f", F.lit(0)), "max_loc": pick(1) + F.coalesce("_l", F.lit(0))}).drop("_f", "_l")


def with_baseline(models: DataFrame, order: str, measures: list[str]) -> DataFrame:
    """`models` with the differences of their measures to those of the first model."""
    first = models.agg(F.min_by(F.struct(*measures), order).alias("_b"))
    return models.crossJoin(F.broadcast(first)).withColumns({f"{m}_delta": F.col(m) - F.col(f"_b.{m}") for m in measures}).drop("_b")


def readiness(tests: Column, coverage: Column, gaps: Column, docs: Column) -> Column:
    """Weighted score .3 .3 .25 .15 in percent, one decimal."""
    return F.round((tests * 0.3 + coverage * 0.3 + gaps * 0.25 + docs * 0.15) * 100, 1)


def cost(tokens_in: Column, tokens_out: Column, cached: Column) -> Column:
    """Cost of a call: .60 (.15 if cached) and 2.50 a million tokens."""
    return tokens_in * F.when(cached, 0.15).otherwise(0.60) / 1e6 + tokens_out * 2.50 / 1e6


def hit_rates(probes: DataFrame) -> DataFrame:
    """Hits, misses and hit rate of a probe log; other versions are left out of the total."""
    return probes.agg(F.count_if(F.col("status") == "hit").alias("hits"), F.count_if(F.col("status") == "miss").alias("misses"), F.try_divide(F.count_if(F.col("status") == "hit").cast("double"), F.count_if(F.col("status").isin("hit", "miss"))).alias("hit_rate"))


def markdown(df: DataFrame, title: str) -> str:
    """A table of a small aggregate in Markdown."""
    rows = df.collect()
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(str(v) for v in r) + " |" for r in rows]) + "\n"


def acceptance(proposed: Column, accepted: Column) -> Column:
    return accepted / F.greatest(proposed, F.lit(1))


def dispersion(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Quartiles and median of each group, and variance over squared median; no task holds a group."""
    q = interpolated(df, group, F.col(value), {"p25": 0.25, "median": 0.5, "p75": 0.75}).alias("q")
    v = df.groupBy(*group).agg(F.var_pop(value).alias("_var")).alias("v")
    same = [F.col(f"q.{g}").eqNullSafe(F.col(f"v.{g}")) for g in group] or [F.lit(True)]
    return q.join(v, same).select(*[f"q.{g}" for g in group], "p25", "median", "p75", (F.col("_var") / F.pow("median", F.lit(2))).alias("cv"))
