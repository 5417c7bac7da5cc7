"""Claims verified against evidence, from policy to status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import claims as C
from granary.functions import judging as G
from granary.functions import text as X
from granary.operators.ordered import last_rows
from granary.operators.pairs import sharing_words

#: Fixed value: categories of claims that need evidence of some kind.
NEEDS = ("STATUS", "BENCHMARK", "QUANT")


def policy_errors(claim: Column, kinds: Column, required: dict[str, tuple[str, ...]]) -> Column:
    """What the policy has against a claim before any evidence is read: superlatives, and categories of which no required kind is among
    the `kinds` of artifacts."""
    of, none = X.categories(claim), F.array().cast("array<string>")
    tests = [F.when(F.array_contains(of, "SUPERLATIVE"), F.array(F.lit("superlative_terms"))).otherwise(none)]
    for category in NEEDS:
        wanted = required.get(category, ())
        if wanted:
            lacks = F.array_contains(of, category) & ~F.coalesce(F.arrays_overlap(kinds, F.array(*map(F.lit, wanted))), F.lit(False))
            tests.append(F.when(lacks, F.array(*[F.lit(f"artifact:type:{t}") for t in wanted])).otherwise(none))
    return F.concat(*tests)


def _best(pairs: DataFrame, statement: str, name: str) -> DataFrame:
    """claim_id, `name`: the triage of the evidence that supports a statement most."""
    t = pairs.select("claim_id", "evidence_id", G.triage(F.col("evidence"), F.col(statement)).alias("_t"))
    return t.groupBy("claim_id").agg(F.max_by("_t", F.struct(F.col("_t.support"), -F.col("evidence_id"))).alias(name))


def verify(claims: DataFrame, evidence: DataFrame, required: dict[str, tuple[str, ...]] | None = None, k: int = 6, coverage_least: float = 0.7) -> DataFrame:
    """claim_id, status, outcome, coverage, violations, support, contradict, insufficient for every claim.

    `claims`: claim_id, claim, full (the claim with its hints), kinds (of artifacts); `evidence`: evidence_id, evidence. A claim that breaks
    the policy is outcome 6 unread. The k texts that share most words with the claim, and with its full form, are its evidence; without any
    it is outcome 7. VERIFIED needs outcome 1, 2 or 4, coverage of the claim's parts (.5 for a claim without a verb), and equal negation; outcome 5 is UNVERIFIED.
    """
    judged = claims.withColumn("violations", policy_errors(F.col("claim"), F.col("kinds"), required or {}))
    open_ = judged.where(F.size("violations") == 0).select("claim_id", "claim", "full")
    sides = []
    for statement in ("claim", "full"):
        pairs = sharing_words(open_, evidence, "claim_id", "evidence_id", statement, "evidence")
        chosen = last_rows(pairs, "claim_id", [F.col("shared"), -F.col("evidence_id")], k).select("claim_id", "evidence_id")
        sides.append(chosen.join(evidence, "evidence_id").join(open_, "claim_id"))
    own, wide = sides
    parts = own.withColumn("_el", C.elements(F.col("claim")))
    whole = F.col("_el.predicate").isNotNull()
    covered = parts.select("claim_id", F.when(whole, C.coverage(F.col("evidence"), F.col("_el"))).otherwise(0.5).alias("_c"), (whole & (F.col("_el.negation") != F.col("evidence").rlike(C.NEGATION))).alias("_m"))
    covered = covered.groupBy("claim_id").agg(F.max("_c").alias("coverage"), F.max_by("_m", F.struct("_c", ~F.col("_m"))).alias("_mismatch"))
    seen = reduce(lambda a, b: a.join(b, "claim_id", "full"), [_best(own, "claim", "_a"), _best(wide, "full", "_b"), _best(own, "full", "_m"), covered])
    nothing = F.struct(F.lit(0.0).alias("support"), F.lit(0.0).alias("contradict"), F.lit(1.0).alias("insufficient"))
    all_ = judged.join(seen, "claim_id", "left").withColumns({n: F.coalesce(n, nothing) for n in ("_a", "_b", "_m")})
    same = F.lower(X.strip(F.col("claim"))) == F.lower(X.strip(F.col("full")))
    found = F.when(F.size("violations") > 0, 6).when(F.col("coverage").isNull() & (F.col("_b.insufficient") == 1.0), 7).otherwise(G.outcome(same, F.col("_a"), F.col("_b"), F.col("_m")))
    all_ = all_.withColumns({"outcome": found, "coverage": F.when(F.size("violations") == 0, F.col("coverage"))}).withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    good = F.col("outcome").isin(1, 2, 4) & (F.col("coverage") >= coverage_least) & ~F.coalesce("_mismatch", F.lit(False))
    status = F.when(good, "VERIFIED").when(F.col("outcome") == 5, "UNVERIFIED").otherwise("INSUFFICIENT_EVIDENCE")
    of = lambda f, n: f(*[F.col(f"{t}.{n}") for t in ("_a", "_b", "_m")])
    s, c, i = of(F.greatest, "support"), of(F.greatest, "contradict"), of(F.least, "insufficient")
    return all_.select("claim_id", status.alias("status"), "outcome", "coverage", "violations", (s / (s + c + i)).alias("support"), (c / (s + c + i)).alias("contradict"), (i / (s + c + i)).alias("insufficient"))
