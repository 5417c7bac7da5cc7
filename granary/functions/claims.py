"""Claims: ambiguity, verifiability, rewriting, coverage of their parts by evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions import text as X

# Patterns of facts and of opinion, words that refer to something else.
FACTS = (
    r"(?i)\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b(January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b",
    r"(?i)\b\d+\s*(percent|%|dollars?|\$|units?|items?|times?|hours?|minutes?|seconds?)\b",
    r"(?i)\b\d+\.?\d*\b",
    r"(?i)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b",
    r"(?i)\b(according to|per|stated by|reported by|source:|reference:)\b",
    r"(?i)\b\d+\s*(cm|m|km|inch|ft|yd|lb|kg|g|ml|l)\b",
)
OPINIONS = (
    r"(?i)\b(think|believe|feel|seem|appear|probably|maybe|perhaps|might|could|should)\b",
    r"(?i)\b(good|bad|better|best|worse|worst|nice|great|terrible|awesome)\b",
    r"(?i)\b(opinion|viewpoint|perspective|interpretation)\b",
)
SOFTENERS = (
    (r"(?i)\b(think|believe|feel)\s+that\s+", ""), (r"(?i)\b(probably|maybe|perhaps|might|could)\s+", ""), (r"(?i)\b(seems?|appears?)\s+to\s+be\s+", "is "),
    (r"(?i)\b(in my opinion|I think|I believe)\s*,?\s*", ""), (r"(?i)\b(opinion|viewpoint|perspective|interpretation)\s+is\s+that\s+", ""),
    (r"(?i)\bfrom\s+my\s+(perspective|viewpoint|understanding)\s*,?\s*", ""),
)
PRONOUNS = ("he", "she", "it", "they", "this", "that", "these", "those", "him", "her", "them")
TIMES = ("now", "then", "today", "recently", "soon", "later", "currently", "previously")
NEGATION = r"(?i)\b(not|no|never|none|nobody|nothing|nowhere)\b|\b(doesn't|don't|didn't|won't|can't|cannot|isn't|aren't)\b"


def verifiability(c: Column) -> Column:
    """.2 for every kind of fact less .3 for every kind of opinion, 0 to 1; above .3 a sentence can be verified."""
    facts = sum(c.rlike(p).cast("int") for p in FACTS)
    opinions = sum(c.rlike(p).cast("int") for p in OPINIONS)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), facts * 0.2 - opinions * 0.3)), 4)


def without_opinion(c: Column) -> Column:
    """The sentence without its softeners; null if nothing changes or nothing is left."""
    out = c
    for pattern, by in SOFTENERS:
        out = F.regexp_replace(out, pattern, by)
    out = X.strip(F.regexp_replace(out, r"\s+", " "))
    return F.when((out != c) & (out != ""), out)


def ambiguities(c: Column, known: Column) -> Column:
    """Ambiguous phrases with kind and confidence: pronouns and times are sure if `known` (earlier words) isn't empty."""
    plain = F.transform(X.words(F.lower(c)), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))
    sure = F.size(known) > 0
    row = lambda w, kind, conf: F.struct(w.alias("phrase"), F.lit(kind).alias("kind"), conf.alias("confidence"))
    refers = F.transform(F.filter(plain, lambda w: w.isin(*PRONOUNS)), lambda w: row(w, "referential", F.when(sure, 0.8).otherwise(0.2)))
    times = F.transform(F.filter(plain, lambda w: w.isin(*TIMES)), lambda w: row(w, "temporal", F.when(sure, 0.7).otherwise(0.3)))
    joins = F.transform(F.regexp_extract_all(c, F.lit(r"(?i)\b(?:and|or|but|that|which|who)\s+\w+"), F.lit(0)), lambda w: row(w, "structural", F.lit(0.5)))
    return F.concat(refers, times, joins)


def elements(c: Column) -> Column:
    """Subject, predicate and object around the first verb of the list, with numbers and negation as qualifiers."""
    pattern = r"(?i)^(.*?)\s+\b(" + "|".join(X.FACT_VERBS) + r")\b\s*(.*)$"
    part = lambda i: F.nullif(X.strip(F.regexp_extract(c, pattern, i)), F.lit(""))
    return F.struct(part(1).alias("subject"), part(2).alias("predicate"), part(3).alias("object"), F.nullif(F.regexp_extract(c, r"\d+(?:\.\d+)?\s?(?:%|ms|items)?", 0), F.lit("")).alias("quantity"), c.rlike(NEGATION).alias("negation"))


def coverage(evidence: Column, e: Column) -> Column:
    """Share of the claim's parts that the evidence has, less .25 if only one of the two is negated."""
    said = F.lower(evidence)
    hit = lambda k: F.coalesce(F.contains(said, F.lower(e[k])), F.lit(False)).cast("int")
    n = F.lit(3) + e["quantity"].isNotNull().cast("int")
    share = (hit("subject") + hit("predicate") + hit("object") + F.when(e["quantity"].isNotNull(), hit("quantity")).otherwise(0)) / n
    return F.when(e["negation"] != evidence.rlike(NEGATION), F.greatest(F.lit(0.0), share - 0.25)).otherwise(share)


def with_hints(c: Column, hints: Column) -> Column:
    """The claim with its distinct hints, sorted, in brackets."""
    some = F.array_sort(F.array_distinct(hints))
    return F.when(F.size(some) > 0, F.concat(c, F.lit(" ["), F.array_join(some, "; "), F.lit("]"))).otherwise(c)
