"""Mixes, samples and random pairs, all by seeded hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.hashing import seeded
from granary.operators.ordered import exact_ranks


def ratio_mix(df: DataFrame, part: str, key: str, ratios: dict[str, float], total: int, seed: int = 42) -> DataFrame:
    """`total` rows: of each part floor(total * ratio) in a seeded order, topped up from the first part, over again if it has too few.

    `place` counts from 0: parts in the order given, then what tops up. A short part gives all it has.
    """
    first = next(iter(ratios))
    wanted = {p: int(total * r) for p, r in ratios.items()}
    sizes = {r[part]: r["n"] for r in df.where(F.col(part).isin(*ratios)).groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each part
    taken = {p: min(n, sizes.get(p, 0)) for p, n in wanted.items()}
    start, at = {}, 0
    for p in ratios:
        start[p], at = at, at + taken[p]
    missing = max(0, total - at) if sizes.get(first) else 0
    ranked = exact_ranks(df.where(F.col(part).isin(*ratios)), seeded(F.col(key), seed), F.col(key), group=part)
    of = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col(part)]
    own = ranked.where(F.col("_rank") <= of(taken)).withColumn("place", (of(start) + F.col("_rank") - 1).cast("long"))
    n = max(1, sizes.get(first, 0))
    rounds = F.floor((F.lit(missing) - F.col("_rank")) / n) + 1  # how often the row's turn comes
    more = ranked.where((F.col(part) == first) & (F.col("_rank") <= missing)).withColumn("_k", F.explode(F.sequence(F.lit(0), (rounds - 1).cast("int"))))
    more = more.withColumn("place", (F.lit(at) + F.col("_k") * n + F.col("_rank") - 1).cast("long")).drop("_k")
    return own.unionByName(more).drop("_rank").where(F.col("place") < total)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """`n` rows by a seeded order; Spark keeps n rows of each task."""
    return df.orderBy(seeded(F.col(key), seed), F.col(key)).limit(n)


def fraction(key: Column, seed: int) -> Column:
    """A fixed pseudo-random number in [0, 1) of a key."""
    return F.conv(F.substring(seeded(key, seed), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def weighted_choice(key: Column, weights: dict[int, float], seed: int = 42, upweight_rare: bool = False) -> Column:
    """A value of `weights` for each key, in proportion to the weights; with `upweight_rare` to their inverses."""
    w = {k: (1 / x if x else 0.0) if upweight_rare else x for k, x in weights.items()}
    total, at, out = sum(w.values()), 0.0, None
    point = fraction(key, seed)
    for value, share in w.items():
        at += share / total
        out = F.when(point < at, F.lit(value)) if out is None else out.when(point < at, F.lit(value))
    return out.otherwise(F.lit(next(reversed(w))))


def random_pairs(df: DataFrame, key: str, text: str, pairs: int, attempts: int = 3, seed: int = 42, prefix: int = 100) -> DataFrame:
    """a_id, b_id: up to `pairs` random pairs of different rows, no two with the same first characters on both sides.

    Each of pairs * attempts draws names two ranks of a seeded order; draws are joined with the ranks, so no pair is made that isn't
    drawn. The first draw of a pair of prefixes counts.
    """
    n = df.count()
    if n < 2:
        return df.select(F.col(key).alias("a_id"), F.col(key).alias("b_id")).limit(0)
    ranked = exact_ranks(df.select(F.col(key).alias("_id"), F.substring(F.col(text), 1, prefix).alias("_text")), seeded(F.col("_id"), seed), F.col("_id"))
    spark = df.sparkSession
    pick = lambda salt: F.conv(F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"|{seed}|{salt}")), 256), 1, 12), 16, 10).cast("long") % n + 1
    draws = spark.range(pairs * attempts).select("id", pick("a").alias("_a"), pick("b").alias("_b")).where("_a <> _b")
    a = ranked.select(F.col("_rank").alias("_a"), F.col("_id").alias("a_id"), F.col("_text").alias("a_text"))
    b = ranked.select(F.col("_rank").alias("_b"), F.col("_id").alias("b_id"), F.col("_text").alias("b_text"))
    drawn = draws.join(a, "_a").join(b, "_b")
    once = drawn.groupBy(F.sha2(F.concat_ws("\x00", F.coalesce("a_text", F.lit("")), F.coalesce("b_text", F.lit(""))), 256).alias("_key")).agg(F.min(F.struct("id", "a_id", "b_id")).alias("_d"))
    return once.select("_d.*").orderBy("id").limit(pairs).select("a_id", "b_id")
