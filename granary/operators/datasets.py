"""Datasets: upserts, comparisons, samples, splits, unions, gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.hashing import seeded


def upsert(main: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of `main`, replaced as a whole by the row of `changes` with the same key; unmatched changes are left out."""
    cols = [c for c in main.columns if c != key]
    new = changes.select(F.col(key), F.struct(*cols).alias("_new"))
    pick = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
    return main.join(new, key, "left").select(key, *[pick(c) for c in cols])


def compare_rows(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key and status: same, mismatch, missing (only in a) or extra (only in b)."""
    cols = [c for c in a.columns if c != key]
    left, right = a.select(key, F.struct(*cols).alias("_a")), b.select(key, F.struct(*cols).alias("_b"))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("mismatch")
    return left.join(right, key, "full_outer").select(key, status.alias("status"))


def close(a: Column, b: Column, absolute: float = 1e-6, relative: float = 1e-6) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(absolute), F.lit(relative) * F.greatest(F.abs(a), F.abs(b)))


def stratified_sample(df: DataFrame, stratum: str, key: str, targets: dict[str, int], seed: int = 42) -> DataFrame:
    """Exactly the target of each stratum: rows by a seeded order; a short stratum is repeated round by round (`copy` counts from 0)."""
    from granary.operators.ordered import exact_ranks

    want = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
    df = df.where(F.col(stratum).isin(*targets))
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size"))  # a row for each target
    ranked = exact_ranks(df, seeded(F.col(key), seed), F.col(key), group=stratum).withColumnRenamed("_rank", "_r").join(F.broadcast(sizes), stratum).withColumn("_want", want[F.col(stratum)])
    copies = F.when(F.col("_want") >= F.col("_r"), F.floor((F.col("_want") - F.col("_r")) / F.col("_size")) + 1).otherwise(0)
    return ranked.where("_r <= _want").withColumn("copy", F.explode(F.sequence(F.lit(0), (copies - 1).cast("int")))).drop("_r", "_size", "_want")


def rebalance(df: DataFrame, label: str, key: str, majority: str, others: dict[str, float], seed: int = 42) -> DataFrame:
    """`df` with `balanced`: rows of the majority label move, in a seeded order, to labels short of their share of all rows."""
    from granary.operators.ordered import exact_ranks

    named = [majority, *others]
    total, *known = df.agg(F.count(F.lit(1)), *[F.count_if(F.col(label) == x) for x in named]).first()
    known = dict(zip(named, known))
    left, at, moves = known[majority], 0, []
    for name, share in others.items():
        n = max(0, min(left, int(total * share) - known[name]))
        moves.append((name, at, at + n))
        at, left = at + n, left - n
    ranked = exact_ranks(df, seeded(F.col(key), seed), F.col(key), group=label).withColumnRenamed("_rank", "_r")
    out = F.col(label)
    for name, lo, hi in moves:
        out = F.when((F.col(label) == majority) & (F.col("_r") > lo) & (F.col("_r") <= hi), F.lit(name)).otherwise(out)
    return ranked.withColumn("balanced", out).drop("_r")


def split_exactly(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """`df` with `split`: val for exactly floor(n * share) rows of a seeded order, else train."""
    from granary.operators.ordered import exact_ranks

    total = df.agg(F.count(F.lit(1)).alias("_total"))
    ranked = exact_ranks(df, seeded(F.col(key), seed), F.col(key)).crossJoin(F.broadcast(total))
    return ranked.withColumn("split", F.when(F.col("_rank") <= F.floor(F.col("_total") * share), "val").otherwise("train")).drop("_rank", "_total")


def fill_gaps(df: DataFrame, rules: list[tuple[str, Column, str]]) -> DataFrame:
    """Rules (column, value, name) in order: a null takes the value; `filled` maps each filled column to its rule."""
    marks = []
    for column, value, name in rules:
        marks.append(F.when(F.col(column).isNull() & value.isNotNull(), F.struct(F.lit(column).alias("k"), F.lit(name).alias("v"))))
    df = df.withColumn("filled", F.map_from_entries(F.array_compact(F.array(*marks))))
    return df.withColumns({column: F.coalesce(column, value) for column, value, _ in rules})
