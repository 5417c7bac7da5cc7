"""Row filters with reasons, and row validators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.session import fresh


def cascade_reasons(df: DataFrame, text: str = "text", order: str = "doc_id", min_length: int = 0, max_length: int | None = None, remove_truncated: bool = False, dedupe: bool = False) -> DataFrame:
    """`df` with `reason`: the first test that a row fails (empty, min_length, max_length, truncated, duplicate), or passed.

    A duplicate has a copy before it, by the order column, that passes the other tests.
    """
    t = F.col(text)
    reason = F.when(X.strip(F.coalesce(t, F.lit(""))) == "", "empty").when(F.length(t) < min_length, "min_length")
    if max_length is not None:
        reason = reason.when(F.length(t) > max_length, "max_length")
    if remove_truncated:
        reason = reason.when(X.is_truncated(t), "truncated")
    out = df.withColumn("reason", reason)
    if dedupe:
        # The first row of each text is an aggregate, so copies of one text meet as a row per task; the join back is left to Spark's
        # handling of skew. Rows that failed already join nothing.
        digest, first = fresh(df, "_digest", "_first")
        out = out.withColumn(digest, F.when(F.col("reason").isNull(), F.sha2(t, 256)))
        firsts = out.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(order).alias(first))
        out = out.join(firsts, digest, "left").withColumn("reason", F.coalesce("reason", F.when(F.col(order) > F.col(first), "duplicate"))).drop(digest, first)
    return out.withColumn("reason", F.coalesce("reason", F.lit("passed")))


def provenance_errors(source: Column, license: Column, text: Column, sources: tuple[str, ...], licenses: tuple[str, ...]) -> Column:
    """Names of the failed tests of origin and of personal data."""
    return F.array_compact(
        F.array(
            F.when(~source.isin(*sources), F.lit("unknown_source")),
            F.when(~license.isin(*licenses), F.lit("license_missing")),
            F.when(text.rlike(r"\b\d{3}-\d{2}-\d{4}\b"), F.lit("ssn")),
            F.when(text.rlike(X.EMAIL), F.lit("email")),
        )
    )


def rejection_reason(name: Column, payload: Column, known: tuple[str, ...], tier: Column, has_context: Column, mask: Column, ids: Column) -> Column:
    """First reason to reject: unknown_tool, malformed_json, inconsistent_tier, mismatched_mask; null for accepted rows."""
    return F.coalesce(
        F.when(~name.isin(*known), F.lit("unknown_tool")),
        F.when(F.try_parse_json(payload).isNull(), F.lit("malformed_json")),
        F.when((tier > 0) & ~has_context, F.lit("inconsistent_tier")),
        F.when((F.size(mask) > 0) & (F.size(ids) > 0) & (F.size(mask) != F.size(ids)), F.lit("mismatched_mask")),
    )
