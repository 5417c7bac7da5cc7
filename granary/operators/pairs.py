"""Pairs of short texts that share a word: evidence retrieval and support."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.judging import token_words
from granary.session import fresh, ship_package

#: Bytes of claims that every task holds at one time, and most such blocks.
BLOCK_BYTES, MOST_BLOCKS = 4 << 20, 8


def sharing_words(a: DataFrame, b: DataFrame, a_id: str, b_id: str, a_text: str, b_text: str) -> DataFrame:
    """a_id, b_id, shared, a_words, b_words for all pairs with a common word: an equi join on words, counted, so texts don't multiply."""
    left = a.select(a_id, token_words(F.col(a_text)).alias("w")).withColumn("a_words", F.size("w")).select(a_id, "a_words", F.explode("w").alias("word"))
    right = b.select(b_id, token_words(F.col(b_text)).alias("w")).withColumn("b_words", F.size("w")).select(b_id, "b_words", F.explode("w").alias("word"))
    return left.join(right, "word").groupBy(a_id, b_id).agg(F.count(F.lit(1)).alias("shared"), F.first("a_words").alias("a_words"), F.first("b_words").alias("b_words"))


def similar(a: DataFrame, b: DataFrame, a_id: str, b_id: str, a_text: str, b_text: str, above: float) -> DataFrame:
    """a_id, b_id, jaccard of all pairs whose words have a Jaccard similarity above `above`.

    Such a pair shares a word among the rarest n - floor(above * n) words of either side, so only those are joined: the commonest words
    never are. Pairs of too unequal size are left out before they are compared.
    """
    side = lambda df, i, t, n: df.select(F.col(i).alias(f"{n}_id"), F.array_sort(token_words(F.col(t))).alias(f"{n}_w")).where(F.size(f"{n}_w") > 0)
    left, right = side(a, a_id, a_text, "_a"), side(b, b_id, b_text, "_b")
    seen = left.select(F.explode("_a_w").alias("_word")).unionByName(right.select(F.explode("_b_w").alias("_word"))).groupBy("_word").agg(F.count(F.lit(1)).alias("_df"))

    def rare(df: DataFrame, n: str) -> DataFrame:
        own = df.select(f"{n}_id", F.size(f"{n}_w").alias(f"{n}_n"), F.explode(f"{n}_w").alias("_word")).join(seen, "_word")
        ranked = own.groupBy(f"{n}_id", f"{n}_n").agg(F.array_sort(F.collect_list(F.struct("_df", "_word"))).alias("_s"))
        return ranked.select(f"{n}_id", f"{n}_n", F.explode(F.slice("_s", F.lit(1), F.col(f"{n}_n") - F.floor(F.col(f"{n}_n") * above).cast("int"))).alias("_x")).select(f"{n}_id", f"{n}_n", F.col("_x._word").alias("_word"))

    fits = (F.col("_b_n") > F.col("_a_n") * above) & (F.col("_a_n") > F.col("_b_n") * above)
    candidates = rare(left, "_a").join(rare(right, "_b"), "_word").where(fits).select("_a_id", "_b_id").distinct()
    both = candidates.join(left, "_a_id").join(right, "_b_id").withColumn("_s", F.size(F.array_intersect("_a_w", "_b_w")))
    return both.select(F.col("_a_id").alias(a_id), F.col("_b_id").alias(b_id), (F.col("_s") / (F.size("_a_w") + F.size("_b_w") - F.col("_s"))).alias("jaccard")).where(F.col("jaccard") > above)


def contained(a: DataFrame, b: DataFrame, a_id: str, b_id: str, a_text: str, b_text: str) -> DataFrame:
    """a_id, b_id of all pairs in which b's text holds a's, in any case. A text without a character is in none.

    The words inside a's text (all but the first and the last, which may go on in b) are words of b, so the rarest of them is joined; texts
    of two words or fewer, or without any, meet on their first three characters.
    """
    low = lambda c: F.lower(F.col(c))
    left = a.select(F.col(a_id).alias("_a_id"), low(a_text).alias("_a_t")).where("_a_t <> ''")
    right = b.select(F.col(b_id).alias("_b_id"), low(b_text).alias("_b_t"))
    inner = F.array_distinct(F.filter(F.expr(r"slice(split(_a_t, '\\W+', -1), 2, greatest(size(split(_a_t, '\\W+', -1)) - 2, 0))"), lambda x: x != ""))
    words = left.select("_a_id", "_a_t", inner.alias("_in"))
    held = right.select("_b_id", F.explode(token_words(F.col("_b_t"))).alias("_word"))
    seen = held.groupBy("_word").agg(F.count(F.lit(1)).alias("_df"))
    # A word that b's texts don't have is rarest of all: its text is in none of them.
    keyed = words.where(F.size("_in") > 0).select("_a_id", "_a_t", F.explode("_in").alias("_word")).join(seen, "_word", "left")
    keyed = keyed.groupBy("_a_id", "_a_t").agg(F.min_by("_word", F.struct(F.coalesce("_df", F.lit(0)), "_word")).alias("_word"))
    grams = F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.length("_b_t")), lambda i: F.substring("_b_t", i, n))))
    short = words.where(F.size("_in") == 0).select("_a_id", "_a_t", F.substring("_a_t", 1, 3).alias("_gram"))
    parts = right.where("_b_t <> ''").select("_b_id", F.explode(F.array_distinct(grams)).alias("_gram"))
    met = keyed.join(held, "_word").select("_a_id", "_a_t", "_b_id").unionByName(short.join(parts, "_gram").select("_a_id", "_a_t", "_b_id"))
    return met.join(right, "_b_id").where(F.contains("_b_t", "_a_t")).select(F.col("_a_id").alias(a_id), F.col("_b_id").alias(b_id)).distinct()


def supported(claims: DataFrame, evidence: DataFrame, claim_id: str, evidence_id: str, claim: str, text: str, above: float = 0.3) -> DataFrame:
    """Claims that some evidence supports: similar words, or one text inside the other.

    The claims' texts go to every task in blocks of at most BLOCK_BYTES or, if that is larger, one text. Each block is one pass over the
    evidence, which is never shuffled: a task gives out each claim once. Claims of more than MOST_BLOCKS blocks meet evidence by joins.
    """
    (own,) = fresh(claims, "_claim")
    texts = claims.select(F.lower(F.col(claim)).alias(own)).where(F.col(own) != "").distinct()
    size = texts.agg(F.sum(F.octet_length(own))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    if n > MOST_BLOCKS:
        return supported_by_joins(claims, evidence, claim_id, evidence_id, claim, text, above)
    if not n:
        return claims.where(F.lit(False))
    found = None
    for b in range(n):
        block = texts if n == 1 else texts.where(F.pmod(F.xxhash64(own), F.lit(n)) == b)
        seen = evidence.select(F.lower(F.col(text)).alias(own)).mapInArrow(_search(evidence.sparkSession, sorted(r[0] for r in block.collect()), above, own), f"`{own}` string")
        found = seen if found is None else found.unionByName(seen)
    return claims.join(found.distinct(), F.lower(F.col(claim)) == F.col(own), "left_semi")


def _search(spark: SparkSession, claims: list[str], above: float, name: str):
    from granary.operators._support import Index, Search

    ship_package(spark)
    sent = spark.sparkContext.broadcast(Index(claims, above))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        search = Search(index)
        for batch in batches:
            for x in batch.column(0):
                search.read(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([index.claims[i] for i in search.found.nonzero()[0]], pa.string())], [name])

    return run


def supported_by_joins(claims: DataFrame, evidence: DataFrame, claim_id: str, evidence_id: str, claim: str, text: str, above: float = 0.3) -> DataFrame:
    """The same by joins on words, for claims of any size."""
    near = similar(claims, evidence, claim_id, evidence_id, claim, text, above).select(claim_id)
    inside = contained(claims, evidence, claim_id, evidence_id, claim, text).select(claim_id)
    around = contained(evidence, claims, evidence_id, claim_id, text, claim).select(claim_id)
    return claims.join(near.unionByName(inside).unionByName(around).distinct(), claim_id, "left_semi")


def retrieve(claims: DataFrame, evidence: DataFrame, k: int = 6, diversity: float = 0.5) -> DataFrame:
    """Greedy maximal marginal relevance: k evidence rows per claim, each of best (1-d) * overlap - d * greatest Jaccard to those taken.

    Candidates share a word with the claim; the greedy choice runs on the candidates of one claim in one task.
    """
    from granary.operators._mmr import choose

    pairs = sharing_words(claims, evidence, "claim_id", "evidence_id", "claim", "evidence").withColumn("overlap", F.col("shared") / F.col("a_words"))
    rows = pairs.join(evidence, "evidence_id").select("claim_id", "evidence_id", "overlap", token_words(F.col("evidence")).alias("words"))
    return rows.groupBy("claim_id").applyInPandas(lambda pdf: choose(pdf, k, diversity), "claim_id long, evidence_id long, rank int, overlap double")
