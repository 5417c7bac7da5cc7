"""Exact quantiles from counted values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exclusive_and_linear(values: DataFrame, shares: list[float]) -> DataFrame:
    """measure, linear, exclusive for a column `v` of integers. Values are counted first: what is ordered is the distinct values."""
    counted = values.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    upto = counted.select("v", F.sum("n").over(Window.orderBy("v")).alias("hi"), "n").withColumn("lo", F.col("hi") - F.col("n") + 1)
    c = counted.agg(F.sum("n").alias("c"))
    q = values.sparkSession.createDataFrame([(float(p),) for p in shares], "p double").crossJoin(F.broadcast(c))
    pos = F.col("p") * (F.col("c") + 1)
    q = q.withColumn("pos", pos).withColumn("j", F.greatest(F.lit(1), F.least(F.col("c") - 1, F.floor("pos"))))
    q = q.withColumn("at", F.col("p") * (F.col("c") - 1) + 1).withColumn("i", F.floor("at"))
    need = q.select("p", "pos", "j", "at", "i", F.explode(F.array_distinct(F.array(F.col("j"), F.col("j") + 1, F.col("i"), F.least(F.col("i") + 1, F.col("c"))))).alias("r"))
    got = upto.join(F.broadcast(need), F.col("r").between(F.col("lo"), F.col("hi")))
    pick = lambda r: F.max(F.when(F.col("r") == r, F.col("v")))
    out = got.groupBy("p", "pos", "j", "at", "i").agg(pick(F.col("j")).alias("a"), pick(F.col("j") + 1).alias("b"), pick(F.col("i")).alias("x"), pick(F.col("i") + 1).alias("y"))
    linear = F.col("x") + (F.col("at") - F.col("i")) * (F.coalesce("y", "x") - F.col("x"))
    exclusive = F.col("a") + (F.col("pos") - F.col("j")) * (F.col("b") - F.col("a"))
    return out.select(F.concat(F.lit("p"), F.round(F.col("p") * 100).cast("int").cast("string")).alias("measure"), F.round(linear.cast("double"), 4).alias("linear"), F.round(exclusive.cast("double"), 4).alias("exclusive"))


def order_statistics(df: DataFrame, group: list[str], value: Column, ranks: dict[str, Callable[[Column], Column]], parts: int = 64) -> DataFrame:
    """One row per group: its columns, `n` (rows with a value) and, for each name, the value at rank ranks[name](n), from 0, as a double.

    Approximate quantiles, whose memory is bounded, cut each group into ranges. Counts of the ranges tell which of them hold the wanted
    ranks; only those are counted by value and ordered. The result is exact, and no task holds a group. A rank outside the group is null.
    """
    rows = df.where(value.isNotNull()).select(*group, value.cast("double").alias("_v"))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", shares, F.lit(16 * parts)).alias("_cuts"))
    own = [F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]
    keys = [f"_g{i}" for i in range(len(group))]

    def meet(a: DataFrame, b: DataFrame, *more: Column, how: str = "inner") -> DataFrame:
        return a.join(b, [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(group, keys)] + list(more), how).drop(*keys)

    placed = meet(rows, cuts.select(*own, "_cuts")).select(*group, "_v", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_part"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    spans = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n")).select(*group, "_part", F.sum("_n").over(before).alias("_hi"), "_n")
    wanted = cuts.select(*own, F.explode(F.array_distinct(F.array(*[r(F.col("n")).cast("bigint") for r in ranks.values()]))).alias("_rank"))
    hits = meet(spans, wanted, F.col("_rank").between(F.col("_hi") - F.col("_n"), F.col("_hi") - 1)).select(*own, F.col("_part").alias("_at"), "_rank", (F.col("_rank") - F.col("_hi") + F.col("_n")).alias("_within"))
    some = meet(placed, hits.select(*keys, "_at").distinct(), F.col("_part") == F.col("_at"), how="left_semi")
    counted = some.groupBy(*group, "_part", "_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = counted.withColumn("_hi", F.sum("_n").over(Window.partitionBy(*group, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    found = meet(upto, hits, F.col("_part") == F.col("_at"), F.col("_within").between(F.col("_hi") - F.col("_n"), F.col("_hi") - 1)).select(*own, "_rank", "_v")
    picks = [F.max(F.when(F.col("_rank") == r(F.col("n")).cast("bigint"), F.col("_v"))).alias(name) for name, r in ranks.items()]
    return meet(cuts.select(*group, "n"), found, how="left").groupBy(*group, "n").agg(*picks)


def interpolated(df: DataFrame, group: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """One row per group with the linearly interpolated quantile of each share, exact, from order statistics."""
    at = lambda p: lambda n: F.floor((n - 1) * F.lit(p))
    after = lambda p: lambda n: F.ceil((n - 1) * F.lit(p))
    s = order_statistics(df, group, value, {f"_{e}_{name}": f(p) for name, p in shares.items() for e, f in (("lo", at), ("hi", after))})
    part = lambda p: (F.col("n") - 1) * F.lit(p) - F.floor((F.col("n") - 1) * F.lit(p))
    return s.select(*group, "n", *[(F.col(f"_lo_{name}") + part(p) * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name) for name, p in shares.items()])
