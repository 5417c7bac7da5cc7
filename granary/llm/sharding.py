"""Uniform shuffle into shards of exact sizes, with DataFrame functions only.

A communication matrix says how many rows each source sends to each target. Its rows are multivariate hypergeometric draws without
replacement, so the outcome has the law of a uniform permutation. Rows are permuted within their source, sent as the matrix says, and
permuted again where they arrive. The first round's sources are the input's partitions (a large one counts as several) and its targets
the shards. A shard of more than `block_rows` rows is then split in the same way, into blocks of gapless places, round by round until no
block is larger. So sources and blocks are of bounded size and their number follows the row count, and a round's matrix has at most
MATRIX_CELLS entries, or four for each source if that is more. Matrices are drawn on the driver, in a tree of vectorised draws.

The rows are first written to the shared folder (without texts unless asked for), each with a place of its own. All later steps read
written tables, so a lost executor repeats them with the same result.

Defined results: a null text has no bytes (size 1, crc 0); very long texts are only measured; repeated rows are rows of their own, so
ties can't occur (the order is by place); an empty table gives no row; shard sizes differ by one at most (the first shards are the
larger ones); columns named like the new ones stay, and the new ones get a number; the result depends on the seed and on the input's
partitions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.session import Scratch, fresh

#: Rows of a block; a source holds at most 2^SOURCE_BITS rows of one partition.
BLOCK_ROWS, SOURCE_BITS = 200_000, 20
#: Entries of the matrices of one round, and the most blocks that one round makes of a block.
MATRIX_CELLS, FAN = 1 << 22, 64
#: Entries of a matrix table that is broadcast.
BROADCAST_CELLS = 1 << 20
_LIBRARY_LIMIT = 10**9


def _log_factorial_ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log(a! / b!) without the cancellation of two large logarithms (Stirling's series; exact sums of logs below 64)."""
    small = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 64)))))
    x, y = np.maximum(a, 63).astype(np.float64), np.maximum(b, 63).astype(np.float64)
    d = x - y
    tail = lambda v: (1 - (1 / 30 - 2 / (7 * 30) / (v * v)) / (v * v)) / (12 * v)
    large = d * np.log(y) + (x + 0.5) * np.log1p(d / y) - d + tail(x) - tail(y)
    return large + (small[np.minimum(a, 63)] - small[63]) - (small[np.minimum(b, 63)] - small[63])


def _draw_large(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hypergeometric draws of any size by the ratio of uniforms, under a table-mountain hat around the mode."""
    total = good + bad
    share = good / total
    mean = n * share
    var = mean * (1 - share) * ((total - n) / np.maximum(total - 1, 1))
    width = 2 * np.sqrt(2 / np.e) * np.sqrt(var + 0.5) + 3 - 2 * np.sqrt(3 / np.e)
    low, high = np.maximum(0, n - bad), np.minimum(n, good)
    mode = np.clip(np.floor((n + 1.0) * ((good + 1) / (total + 2.0))).astype(np.int64), low, high)
    out = np.zeros(len(good), np.int64)
    todo = np.arange(len(good))
    while len(todo):
        u = 1 - rng.random(len(todo))
        x = np.floor(mean[todo] + 0.5 + width[todo] * (rng.random(len(todo)) - 0.5) / u)
        inside = (x >= low[todo]) & (x <= high[todo])
        k = np.where(inside, x, mode[todo]).astype(np.int64)
        m, g, b, s = mode[todo], good[todo], bad[todo], n[todo]
        log_p = _log_factorial_ratio(m, k) + _log_factorial_ratio(g - m, g - k) + _log_factorial_ratio(s - m, s - k) + _log_factorial_ratio(b - s + m, b - s + k)
        taken = inside & (2 * np.log(u) <= log_p)
        out[todo[taken]] = k[taken]
        todo = todo[~taken]
    return out


def hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of `n` rows drawn without replacement are good ones; arrays of any counts."""
    good, bad, n = (np.asarray(x, dtype=np.int64) for x in np.broadcast_arrays(good, bad, n))
    shape = good.shape
    good, bad, n = good.ravel(), bad.ravel(), n.ravel()
    large = (good >= _LIBRARY_LIMIT) | (bad >= _LIBRARY_LIMIT)
    sure = (n == 0) | (good == 0) | (bad == 0) | (n == good + bad)
    out = np.where(bad == 0, n, np.where(n == good + bad, good, 0))
    plain = ~large & ~sure
    if plain.any():
        out[plain] = rng.hypergeometric(good[plain], bad[plain], n[plain])
    rest = large & ~sure
    if rest.any():
        out[rest] = _draw_large(rng, good[rest], bad[rest], n[rest])
    return out.reshape(shape)


def _split_columns(rng: np.random.Generator, columns: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each line of `columns` (counts of targets): how many of `rows` drawn rows are of each target, by halving the targets."""
    width = columns.shape[1]
    if width == 1:
        return rows[:, None]
    half = width // 2
    left = columns[:, :half].sum(1)
    first = hypergeometric(rng, left, columns[:, half:].sum(1), rows)
    return np.hstack([_split_columns(rng, columns[:, :half], first), _split_columns(rng, columns[:, half:], rows - first)])


def communication_matrix(source_rows: list[int], target_rows: list[int], seed: int) -> np.ndarray:
    """counts[s, t]: rows that source s sends to target t; both margins are exact. Sources are halved level by level."""
    rng = np.random.default_rng(seed)
    sizes = np.array(source_rows, dtype=np.int64)
    starts, ends = np.array([0]), np.array([len(sizes)])
    counts = np.array(target_rows, dtype=np.int64)[None, :]
    upto = np.concatenate(([0], sizes.cumsum()))
    if not len(sizes):
        return np.zeros((0, counts.shape[1]), np.int64)
    while (ends - starts).max() > 1:
        cut = (starts + ends) // 2
        wide = np.flatnonzero(ends - starts > 1)
        first = _split_columns(rng, counts[wide], upto[cut[wide]] - upto[starts[wide]])
        order = np.concatenate([np.setdiff1d(np.arange(len(starts)), wide), wide, wide])
        more_starts, more_ends = starts[order], ends[order]
        n = len(starts) - len(wide)
        more_ends[n : n + len(wide)], more_starts[n + len(wide) :] = cut[wide], cut[wide]
        counts = np.concatenate([counts[order[:n]], first, counts[wide] - first])
        by_place = np.argsort(more_starts, kind="stable")
        starts, ends, counts = more_starts[by_place], more_ends[by_place], counts[by_place]
    return counts


def _even(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def exchange(spark: SparkSession, scratch: Scratch, rows: DataFrame, plan: dict, names: dict, seed: int) -> DataFrame:
    """One round. `rows` have a place, a block and a source; `plan`: block to (sources and their rows, targets as (block, rows)).

    Every row of a planned block goes to one of its targets, as that block's matrix says; other rows stay where they are.
    """
    at, block, source, rank = names["at"], names["block"], names["source"], names["rank"]
    lines, cells = [], 0
    for n, (b, (sources, targets)) in enumerate(sorted(plan.items())):
        matrix = communication_matrix([c for _, c in sources], [c for _, c in targets], seed + 7919 * n)
        cells += matrix.size
        lines += [(b, s, row, [t for t, _ in targets]) for (s, _), row in zip(sources, matrix.cumsum(1).tolist(), strict=True)]
    table = spark.createDataFrame(pd.DataFrame(lines, columns=["b", "s", "ends", "to"]), "b long, s long, ends array<long>, to array<long>")
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(block, source).orderBy(F.xxhash64(F.lit(seed), at), at)) - 1)
    table = F.broadcast(table) if cells <= BROADCAST_CELLS else scratch.write(table, "matrix")
    ends, to = fresh(ranked, "_ends", "_to")
    joined = ranked.join(table.select(F.col("b").alias(block), F.col("s").alias(source), F.col("ends").alias(ends), F.col("to").alias(to)), [block, source], "left")
    found = F.get(F.col(to), F.size(F.filter(ends, lambda c: c <= F.col(rank))))
    return joined.withColumn(block, F.coalesce(found, F.col(block))).drop(ends, to, rank, source)


def shuffle_to_shards(spark: SparkSession, df: DataFrame, shards: int = 8, seed: int = 17, block_rows: int = BLOCK_ROWS, matrix_cells: int = MATRIX_CELLS) -> DataFrame:
    """`df` with `shard` (0 to shards-1) and `slot` (0, 1, ... within the shard): a uniform shuffle with exact shard sizes."""
    at, source, rank, block, shard, slot = fresh(df, "_at", "_source", "_rank", "_block", "shard", "slot")
    names = {"at": at, "source": source, "rank": rank, "block": block}
    scratch = Scratch(spark, "shards")
    rows = scratch.write(df.withColumn(at, F.monotonically_increasing_id()).withColumn(block, F.lit(-1).cast("long")), "rows")
    # A block is named by its first place in the order of all rows; -1 is the whole table before the first round.
    chunk = F.shiftright(F.col(at), SOURCE_BITS)
    counts = sorted((r["s"], r["n"]) for r in rows.groupBy(chunk.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in counts)
    shard_sizes = _even(total, shards)
    starts = np.concatenate(([0], np.cumsum(shard_sizes))).tolist()
    most = max(1, matrix_cells // shards)
    if len(counts) > most:  # very many small partitions: several are one source
        chunk = F.pmod(F.xxhash64(chunk), F.lit(most))
        counts = sorted((r["s"], r["n"]) for r in rows.groupBy(chunk.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect())
    sizes = {starts[i]: n for i, n in enumerate(shard_sizes) if n}
    rows = exchange(spark, scratch, rows.withColumn(source, chunk), {-1: (counts, list(sizes.items()))}, names, seed)
    round_ = 0
    while max(sizes.values(), default=0) > block_rows:
        round_ += 1
        rows = scratch.write(rows, f"round{round_}")
        large = {b: n for b, n in sizes.items() if n > block_rows}
        per_source = 1 << SOURCE_BITS
        n_sources = {b: -(-n // per_source) for b, n in large.items()}
        fan = max(4, min(FAN, matrix_cells // sum(n_sources.values())))
        # Sources of a block: residues of a hash of the place, as many as its rows need.
        of_block = F.lit(1).cast("long")
        widest = max(n_sources.values())
        if widest > 1:
            of_block = F.lit(widest).cast("long")
        rows = rows.withColumn(source, F.pmod(F.xxhash64(F.lit(seed + 31 * round_), at), of_block))
        got: dict[int, list] = {}
        for r in rows.groupBy(block, source).agg(F.count(F.lit(1)).alias("n")).collect():
            if r[block] in large:
                got.setdefault(r[block], []).append((r[source], r["n"]))
        plan = {}
        for b, n in large.items():
            parts = _even(n, min(fan, -(-n // block_rows)))
            places = np.concatenate(([0], np.cumsum(parts)))[:-1] + b
            plan[b] = (sorted(got[b]), list(zip(places.tolist(), parts)))
        rows = exchange(spark, scratch, rows, plan, names, seed + round_)
        sizes = {b: n for b, n in sizes.items() if n <= block_rows} | {t: n for _, targets in plan.values() for t, n in targets}
    # The last permutation is within blocks; a block's name and the rank give the place, and the place gives shard and slot.
    again = Window.partitionBy(block).orderBy(F.xxhash64(F.lit(seed - 1), at), at)
    place = F.col(block) + F.row_number().over(again) - 1
    first = F.array(*[F.lit(int(x)) for x in starts[1:-1]]) if shards > 1 else F.array().cast("array<int>")
    out = rows.withColumn(rank, place)
    number = F.size(F.filter(first, lambda c: c <= F.col(rank)))
    begins = F.array(*[F.lit(int(x)).cast("long") for x in starts[:-1]])
    return out.select(*df.columns, number.cast("int").alias(shard), (F.col(rank) - F.get(begins, number)).cast("long").alias(slot))


def digest(spark: SparkSession, docs: DataFrame, shards: int = 8) -> DataFrame:
    """Shards of documents without their texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shuffle_to_shards(spark, narrow, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
