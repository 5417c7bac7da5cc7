"""Ordered operators that don't put a whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.session import fresh


def keep_first(df: DataFrame, key: list[Column], order: list[Column], last: bool = False) -> DataFrame:
    """One row for each key: the first by the order (or the last). Aggregated before the shuffle, so a common key is one row per task."""
    pick = F.max_by if last else F.min_by
    row, *keys = fresh(df, "_row", *(f"_key{i}" for i in range(len(key))))
    by = [k.alias(n) for k, n in zip(key, keys)]
    return df.groupBy(*by).agg(pick(F.struct(*df.columns), F.struct(*order)).alias(row)).select(f"{row}.*")


def running_sum(df: DataFrame, order: str, value: Column, name: str, bucket: int = 1 << 20) -> DataFrame:
    """Running sum of `value` by an integer column, in two levels: sums of ranges of the order, then within each range."""
    b, v, base, own = fresh(df, "_bucket", "_value", "_base", "_own")
    df = df.withColumn(b, F.floor(F.col(order) / bucket)).withColumn(v, value)
    sums = df.groupBy(b).agg(F.sum(v).alias(base))
    before = Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col(b), F.coalesce(F.sum(base).over(before), F.lit(0)).alias(base))
    within = Window.partitionBy(b).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(own, F.sum(v).over(within)).join(bases, b).withColumn(name, F.col(base) + F.col(own)).drop(b, v, base, own)


def exact_ranks(df: DataFrame, order: Column, tie: Column, digits: int = 4, group: str | None = None) -> DataFrame:
    """`df` with `_rank`, from 1 in the given order of hex digests (within each value of `group`): ranges of their first digits are
    counted, then ranked within, so neither a table nor a group is one task."""
    of = [group] if group else []
    df = df.withColumn("_range", F.substring(order, 1, digits))
    counts = df.groupBy(*of, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*of).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*of, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    w = Window.partitionBy(*of, "_range").orderBy(order, tie)
    ranked = df.withColumn("_own", F.row_number().over(w))
    if group:
        bases = bases.select(F.col(group).alias("_group"), F.col("_range").alias("_at"), "_base")
        joined = ranked.join(bases, ranked[group].eqNullSafe(bases["_group"]) & (ranked["_range"] == bases["_at"])).drop("_group", "_at")
    else:
        joined = ranked.join(bases, "_range")
    return joined.withColumn("_rank", F.col("_base") + F.col("_own")).drop("_range", "_own", "_base")


def last_rows(df: DataFrame, group: str, order: list[Column], n: int, salts: int = 64) -> DataFrame:
    """The last `n` rows of each group by the order: of every salt first, then of what is left, so a large group is many tasks."""
    salt, row = fresh(df, "_salt", "_row")
    newest = [c.desc_nulls_last() for c in order]
    some = df.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)))
    some = some.withColumn(row, F.row_number().over(Window.partitionBy(group, salt).orderBy(*newest))).where(F.col(row) <= n)
    return some.withColumn(row, F.row_number().over(Window.partitionBy(group).orderBy(*newest))).where(F.col(row) <= n).drop(salt, row)


def repeated_keys(df: DataFrame, key: str, order: str) -> DataFrame:
    """key, first, again: the place of the first row with a key, and of every later one."""
    firsts = df.groupBy(key).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return df.select(key, F.col(order).alias("again")).join(firsts, key).where("again > first").select(key, "first", "again")


def offenders(df: DataFrame, by: Column, tie: str, k: int) -> DataFrame:
    """The k rows of largest `by`; Spark keeps k rows of each task."""
    return df.orderBy(by.desc_nulls_last(), F.col(tie)).limit(k)


def merge_intervals(df: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """Overlapping and touching intervals of a key as one; with the number of intervals."""
    w = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
    island = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n_spans")).drop("_island")
