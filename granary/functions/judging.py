"""Judging: pair scores, stages, entailment, outcomes, gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the four side scores, clauses and their reasons, words of the stages, contradiction marks.
WEIGHTS = {"E": 0.4, "B": 0.3, "G": 0.2, "P": 0.1}
CLAUSES = ("EVIDENCE_COMPLETENESS", "BUDGET_ADHERENCE", "GATE_INTEGRITY", "PROVENANCE_CLARITY", "WAIVER_JUSTIFICATION")
STAGES = ("pleading", "examination", "deliberation", "verdict", "publication")
NEGATIONS = r"(?i)\b(not|no|never|false|incorrect|wrong|disproves?|refutes?|contradicts?)\b|\b(doesn't|don't|didn't|won't|can't|cannot)\b"


def total_score(e: Column, b: Column, g: Column, p: Column) -> Column:
    return F.round(e * WEIGHTS["E"] + b * WEIGHTS["B"] + g * WEIGHTS["G"] + p * WEIGHTS["P"], 2)


def token_words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\W+"), lambda x: x != ""))


def overlap_ratio(evidence: Column, claim: Column) -> Column:
    own = token_words(claim)
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.array_intersect(token_words(evidence), own)) / F.size(own))


def contradicts(evidence: Column, claim: Column) -> Column:
    """Evidence with a negation that has one of the claim's first five words, in alphabetical order."""
    keys = F.slice(F.array_sort(token_words(claim)), 1, 5)
    return evidence.rlike(NEGATIONS) & F.exists(keys, lambda k: F.contains(F.lower(evidence), k))


def overlap_logits(ratio: Column, against: Column, blank: Column) -> tuple[Column, Column, Column]:
    """Raw scores of support, contradict and insufficient from the overlap, a contradiction, and a claim without words."""
    return (
        F.when(blank, -1.0).when(against, -2.0).otherwise(ratio * 3.0 - 1.0),
        F.when(blank, -2.0).when(against, 2.0).otherwise(-2.0),
        F.when(blank, 1.0).when(against, -1.0).otherwise((F.lit(1.0) - ratio) * 2.0 - 1.0),
    )


def triage(evidence: Column, claim: Column, temperature: float = 0.6, bias: tuple[float, float, float] = (0.0, 0.0, 0.0), prior: tuple[float, float, float] = (0.33, 0.33, 0.34)) -> Column:
    """Smoothed probabilities of support, contradict and insufficient from lexical overlap."""
    raw = overlap_logits(overlap_ratio(evidence, claim), contradicts(evidence, claim), F.size(token_words(claim)) == 0)
    e = [F.exp(r / temperature + b) for r, b in zip(raw, bias)]
    z = e[0] + e[1] + e[2]
    return F.struct(*[(x / z * 0.5 + 0.5 * p).alias(n) for x, p, n in zip(e, prior, ("support", "contradict", "insufficient"))])


def top_label(t: Column, least: float = 0.5, precedence: tuple[str, ...] = ("contradict", "support", "insufficient")) -> Column:
    """The first label in precedence that reaches `least`, or else the likeliest."""
    out = None
    for n in precedence:
        out = F.when(t[n] >= least, n) if out is None else out.when(t[n] >= least, n)
    best = F.greatest(t["support"], t["contradict"], t["insufficient"])
    return out.otherwise(F.when(t["support"] == best, "support").when(t["contradict"] == best, "contradict").otherwise("insufficient"))


def outcome(same: Column, c: Column, cmax: Column, mapped: Column, contradict_least: float = 0.5) -> Column:
    """Seven outcomes; `c`, `cmax` and `mapped` are triage structs. Contradiction comes first."""
    against = (c["contradict"] >= contradict_least) | (cmax["contradict"] >= contradict_least) | (mapped["contradict"] >= contradict_least)
    a, b, m = top_label(c), top_label(cmax), top_label(mapped)
    yes, none = F.lit("support"), F.lit("insufficient")
    return (
        F.when(against, 5).when(same & (a == yes), 1).when((a == yes) & (b == yes) & (m == yes), 2).when((a == yes) & (m != yes), 3).when((b == yes) & (a != yes), 4)
        .when((a == none) & (b == none) & (m == none), 7).otherwise(6)
    )


def speed_gate(current: Column, baseline: Column, threshold: float = 0.05) -> Column:
    """Pass if the relative regression is at most the threshold."""
    return F.when(baseline <= 0, F.lit(True)).otherwise((current - baseline) / baseline <= threshold)


def reduction(baseline: Column, current: Column) -> Column:
    return F.when(baseline <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (baseline - current) / baseline)))
