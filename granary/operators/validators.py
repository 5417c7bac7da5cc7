"""Row validators that give arrays of errors, and their histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.functions.judging import STAGES, WEIGHTS
from granary.functions.hashing import short_hash

#: Phrases of vague answers and the marks of text that isn't plain.
SUSPICIOUS = r"(?i)<script|javascript:|\x00"


def _errors(*tests: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for bad, name in tests]))


def histogram(df: DataFrame, errors: str) -> DataFrame:
    """Counts of the errors' kinds: what stands before a colon."""
    kind = F.get(F.split(F.col("_e"), ":"), 0)
    return df.select(F.explode(errors).alias("_e")).groupBy(kind.alias("error")).agg(F.count(F.lit(1)).alias("n"))


def presence_errors(raw: Column, required: tuple[str, ...]) -> Column:
    """missing:name and null:name, told apart on the JSON text."""
    keys = F.json_object_keys(raw)
    return F.flatten(
        F.array(*[
            F.when(~F.array_contains(keys, k), F.array(F.lit(f"missing:{k}"))).when(F.get_json_object(raw, f"$.{k}").isNull(), F.array(F.lit(f"null:{k}"))).otherwise(F.array().cast("array<string>"))
            for k in required
        ])
    )


def training_row_ok(prompt: Column, answer: Column) -> Column:
    return (X.strip(F.coalesce(prompt, F.lit(""))) != "") & (X.strip(F.coalesce(answer, F.lit(""))) != "")


def worker_errors(df: DataFrame) -> Column:
    """Worker rows: empty prompt or answer, unknown kind or level, a tool row without its supervision, ids out of the vocabulary."""
    kinds = ("plain", "tool_use", "long_context")
    return _errors(
        (X.strip(F.coalesce("prompt", F.lit(""))) == "", "empty:prompt"), (X.strip(F.coalesce("answer", F.lit(""))) == "", "empty:answer"), (~F.col("task_type").isin(*kinds), "enum:task_type"),
        (~F.col("level").between(0, 2), "range:level"), ((F.col("task_type") == "tool_use") & (F.coalesce(F.size("token_ids"), F.lit(0)) <= 0), "supervision:token_ids"),
        (F.exists("token_ids", lambda x: x < 0), "vocabulary:token_ids"),
    )


def judge_errors(df: DataFrame) -> Column:
    """Judged rows: winner and stage of the known ones, and totals that agree with the weighted parts within .01."""
    total = lambda s: F.abs(sum((F.col(f"{s}.{k}") * w for k, w in WEIGHTS.items()), F.lit(0.0)) - F.col(f"{s}.total")) > 0.01
    return _errors((~F.col("winner").isin("a", "b", "tie"), "enum:winner"), (~F.col("stage").isin(*STAGES), "enum:stage"), (total("a"), "total:a"), (total("b"), "total:b"))


def drafter_errors(text: Column, most: int = 2000) -> Column:
    return _errors((X.strip(F.coalesce(text, F.lit(""))) == "", "empty:text"), (X.estimated_tokens(text) > most, "long:text"))


def clean_text(c: Column, most: int = 100_000) -> Column:
    """Lenient cell: null is empty, longer texts are cut."""
    return F.substring(F.coalesce(c, F.lit("")), 1, most)


def is_suspicious(c: Column) -> Column:
    return c.rlike(SUSPICIOUS)


def clean_number(c: Column, least: float, most: float) -> Column:
    """Numbers in the range; null for anything else."""
    n = c.try_cast("double")
    return F.when(n.between(least, most), n)


def is_long_context(flag: Column, prompt: Column, least: int = 24_000) -> Column:
    return F.coalesce(flag, F.length(prompt) >= least)


def in_scope(paths: Column, inside: Column, outside: Column) -> Column:
    """All paths match a pattern of `inside` (if there is one) and none of `outside`; `*` stands for any characters."""
    match = lambda p, ps: F.exists(ps, lambda x: F.rlike(p, F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(x, r"([.+?()\[\]{}^$|\\])", r"\\$1"), r"\*+", ".*"))))
    return F.forall(paths, lambda p: ((F.size(inside) == 0) | match(p, inside)) & ~match(p, outside))


def verdict(within_budget: Column, gates_ok: Column, provenance_ok: Column, has_waiver: Column) -> Column:
    return F.when(within_budget & gates_ok & provenance_ok, "APPROVED").when(has_waiver, "WAIVER_REQUIRED").otherwise("REJECTED")


def flags_score(flags: dict[str, Column]) -> Column:
    """Flags and their mean."""
    return F.struct(*[c.alias(k) for k, c in flags.items()], (sum(c.cast("int") for c in flags.values()) / len(flags)).alias("score"))


def replace_identical(df: DataFrame, key: str, a: str, b: str, candidates: DataFrame, text: str = "text", seed: int = 42) -> DataFrame:
    """Where both sides are equal, side b takes a candidate of less than half the length's difference, by a seeded hash of the row.

    Candidates are numbered within length bands of a power of 1.25, so the choice is an equi join on (band, number).
    """
    from pyspark.sql import Window

    band = lambda c: F.floor(F.log(F.greatest(F.length(c), F.lit(1))) / F.log(F.lit(1.25)))
    c = candidates.select(F.col(text).alias("_text")).distinct().withColumn("_band", band(F.col("_text")))
    c = c.withColumn("_n", F.row_number().over(Window.partitionBy("_band").orderBy(F.sha2("_text", 256))) - 1)
    sizes = c.groupBy("_band").agg(F.count(F.lit(1)).alias("_size"))
    same = F.col(a) == F.col(b)
    rows = df.withColumn("_band", band(F.col(a))).join(sizes, "_band", "left").withColumn("_n", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.coalesce("_size", F.lit(1))).cast("int"))
    joined = rows.join(c, ["_band", "_n"], "left")
    fits = F.col("_text").isNotNull() & (F.col("_text") != F.col(a))
    return joined.withColumn("replaced", same & F.coalesce(fits, F.lit(False))).withColumn(b, F.when(F.col("replaced"), F.col("_text")).otherwise(F.col(b))).drop("_band", "_n", "_size", "_text")


def cache_key(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def row_fingerprint(*parts: Column) -> Column:
    return short_hash(*parts)
