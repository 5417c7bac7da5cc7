"""Text expressions: token estimates, truncation, personal data, structure and quality scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.vectors import let

# Fixed values that results depend on: patterns, hosts and word lists.
EMAIL = r"[\w\.-]+@[\w\.-]+"
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\b"
PHONE_US = r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
PHONE_INTERNATIONAL = r"\+\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}"
CARD_GROUPS = r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b"
CARD_DIGITS = r"\b(?:\d[ -]?){13,19}\b"
PHONE_BOUNDED = r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b"
URL_HOST = r"https?://([^/\s]+)"
ALLOWED_HOSTS = ("example.com", "example.org", "example.net")
SEVERE_WORDS = ("invoice", "ssn", "patient", "claim", "medical", "financial")
CONTEXT_WORDS = ("contact", "support", "careers", "press", "help", "info")
ERROR_WORDS = ("undefined", "error:", "exception:", "failed", "cannot")
FACT_VERBS = ("is", "was", "are", "were", "has", "have", "had", "implements", "defines", "creates", "created", "returns", "uses")
PLAIN_WORDS = ("the", "and", "or", "but", "it", "is", "was", "are", "were", "has", "have", "had")
PARTICIPLES = ("created", "defined", "implemented", "returned")
VERIFIABLE = (r"\d{4}-\d{2}-\d{2}", r"\d+\.\d+", r"v\d+", r"#[A-Za-z0-9]+", r"```[\s\S]*?```", r"\{[\s\S]*?\}", r"\[[\s\S]*?\]", r"https?://[^\s]+", r"[A-Z][a-z]+ [A-Z][a-z]+")
HEDGES = (r"\b(I think|I believe|I feel|in my opinion)\b", r"\b(probably|maybe|perhaps|might|could)\b", r"\b(seems|appears|looks like)\b", r"\b(should|ought to|must)\b")
GENERIC = r"^(this is just|it is just|that is just|this is only|it is only|maybe|perhaps|probably|might|could)"
HEADERS = ("working spec", "invariants", "acceptance")
CATEGORIES = {
    "STATUS": r"(?i)\b(production[-\s]?ready|enterprise[-\s]?grade|battle[-\s]?tested|deployed|released)\b",
    "SUPERLATIVE": r"(?i)\b(best|leading|state[-\s]?of[-\s]?the[-\s]?art|next[-\s]?generation|revolutionary|breakthrough)\b",
    "BENCHMARK": r"(?i)\b(p50|p95|ttft|tps|throughput|latency|tokens\s?per\s?second)\b",
    "QUANT": r"-?\d+(?:\.\d+)?",
}


def strip(c: Column) -> Column:
    """Without blanks, tabs and line ends around; a plain trim, far cheaper than a pattern on long texts."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def words(c: Column) -> Column:
    """Words between white space; none for blank text."""
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def estimated_tokens(c: Column) -> Column:
    """A token for every four characters."""
    return F.floor(F.length(c) / 4).cast("bigint")


def is_truncated(c: Column) -> Column:
    """No closing mark but a blank among the last 50 characters, or an ellipsis or star at the end; empty text isn't truncated."""
    t = strip(F.coalesce(c, F.lit("")))
    tail = F.substring(t, -50, 50)
    open_end = ~t.rlike(r"[.!?]$") & F.contains(tail, F.lit(" "))
    return (t != "") & (open_end | t.endswith("...") | t.endswith("…") | t.endswith("*"))


def length_bucket(tokens: Column) -> Column:
    return F.when(tokens <= 200, 200).when(tokens <= 400, 400).otherwise(800)


def draft_segment(c: Column, max_tokens: int = 400) -> Column:
    """The text up to max_tokens; cut back to the last full stop or line end if it stands in the last fifth."""
    size = max_tokens * 4
    head = F.substring(c, 1, size)
    dot = size + 1 - F.instr(F.reverse(head), ".")
    line = size + 1 - F.instr(F.reverse(head), "\n")
    has_dot, has_line = F.instr(head, ".") > 0, F.instr(head, "\n") > 0
    near = F.lit(int(size * 0.8))
    last = F.greatest(F.when(has_dot, dot).otherwise(0), F.when(has_line, line).otherwise(0))
    cut = F.when(last - 1 > near, F.when(has_dot & (dot == last), F.substring(head, F.lit(1), last)).otherwise(F.substring(head, F.lit(1), last - 1))).otherwise(head)
    return F.when(F.length(c) <= size, c).otherwise(cut)


def redact(c: Column) -> Column:
    """Mail, UUID, phone and card numbers by marks, in this order."""
    c = F.regexp_replace(c, EMAIL, "[REDACTED_EMAIL]")
    c = F.regexp_replace(c, UUID, "[REDACTED_UUID]")
    c = F.regexp_replace(c, PHONE_US, "[REDACTED_PHONE]")
    c = F.regexp_replace(c, PHONE_INTERNATIONAL, "[REDACTED_PHONE]")
    c = F.regexp_replace(c, CARD_GROUPS, "[REDACTED_CC]")
    return F.regexp_replace(c, CARD_DIGITS, "[REDACTED_CC]")


def hosts(c: Column) -> Column:
    """Hosts of all URLs, lower case, without a leading www."""
    return F.transform(F.regexp_extract_all(c, F.lit(URL_HOST), F.lit(1)), lambda h: F.regexp_replace(F.lower(h), r"^www\.", ""))


def urls_allowed(c: Column) -> Column:
    return F.forall(hosts(c), lambda h: h.isin(*ALLOWED_HOSTS))


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("bigint")


def privacy(c: Column) -> Column:
    """Counts of mails, UUIDs and URLs, and of mails and phone numbers by severity of the 30 characters around their first place."""
    mails = F.regexp_extract_all(c, F.lit(EMAIL), F.lit(0))
    phones = F.regexp_extract_all(c, F.lit(PHONE_BOUNDED), F.lit(0))

    def severity(x: Column) -> Column:
        at = F.instr(c, x)
        start = F.greatest(at - 30, F.lit(1))
        around = F.lower(F.substring(c, start, at + F.length(x) + 30 - start))
        any_of = lambda ws: F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(around, w))
        return F.when(any_of(SEVERE_WORDS), "high").when(any_of(CONTEXT_WORDS), "contextual").otherwise("medium")

    kinds = F.transform(F.concat(mails, phones), severity)
    n = lambda k: F.size(F.filter(kinds, lambda x: x == k)).cast("bigint")
    uuids = count_matches(c, UUID)
    return F.struct(
        F.size(mails).cast("bigint").alias("emails_found"), uuids.alias("uuids_found"), F.size(hosts(c)).cast("bigint").alias("urls_found"), urls_allowed(c).alias("url_allowlist_ok"),
        n("high").alias("high_severity"), n("medium").alias("medium_severity"), n("contextual").alias("contextual"), ((F.size(kinds) == 0) & (uuids == 0) & urls_allowed(c)).alias("privacy_ok"),
    )


def heuristic_quality(c: Column, truth: Column | None = None, prompt: Column | None = None) -> Column:
    """Additive score of structure, length, variety and errors, and overlap with a truth and a prompt where given; 0 to 1."""
    counted = let(words(c), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("different")))
    return let(counted, lambda m: _quality_score(c, m["n"], m["different"] / m["n"], truth, prompt))


def _quality_score(c: Column, n: Column, unique: Column, truth: Column | None, prompt: Column | None) -> Column:
    has = lambda s: F.contains(c, F.lit(s))
    head = F.substring(c, 1, 200)
    structured = has("```") | (has("{") & has("}"))
    listed = F.contains(head, F.lit("- ")) | F.contains(head, F.lit("1. ")) | has("##")
    score = F.lit(0.5) + F.when(structured, 0.2).when(listed, 0.1).otherwise(0.0)
    score += F.when(n.between(50, 500), 0.15).when(n.between(20, 49), 0.05).when(n < 10, -0.3).when(n > 2000, -0.1).otherwise(0.0)
    score += F.when(n > 10, F.when(unique < 0.3, -0.2).when(unique > 0.7, 0.05).otherwise(0.0)).otherwise(0.0)
    errors = sum(F.contains(F.lower(c), F.lit(x)).cast("int") for x in ERROR_WORDS)
    score += F.when(errors > 2, -0.2).otherwise(0.0)
    own = F.array_distinct(words(F.lower(c))) if truth is not None or prompt is not None else None
    if truth is not None:
        other = F.array_distinct(words(F.lower(truth)))
        share = F.size(F.array_intersect(own, other)) / F.size(other)
        ratio = F.least(F.length(c), F.length(truth)) / F.greatest(F.length(c), F.length(truth))
        score += F.when(F.size(other) > 0, share * 0.15 + ratio * 0.05).otherwise(0.0)
    if prompt is not None:
        other = F.array_distinct(words(F.lower(prompt)))
        score += F.when(F.size(other) > 0, F.size(F.array_intersect(own, other)) / F.size(other) * 0.1).otherwise(0.0)
    return F.when(strip(F.coalesce(c, F.lit(""))) == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def code_block_score(c: Column) -> Column:
    """Score of fenced blocks, shared out among them; it can fall below zero."""
    pattern = r"(?s)```(\w+)?\n(.*?)```"
    codes = F.regexp_extract_all(c, F.lit(pattern), F.lit(2))
    named = F.exists(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: x != "")
    lines = lambda x: F.size(F.split(x, "\n", -1))
    parts = F.aggregate(codes, F.lit(0.0), lambda a, x: a + F.when(lines(x).between(5, 100), 0.1).when(lines(x) < 2, -0.1).otherwise(0.0))
    return F.when(F.size(codes) == 0, 0.0).otherwise(F.least(F.lit(1.0), (F.lit(0.5) + F.when(named, 0.2).otherwise(0.0) + parts) / F.size(codes)))


def structure_flags(c: Column) -> dict[str, Column]:
    low = F.lower(c)
    return {
        **{"has_" + h.replace(" ", "_"): F.contains(low, F.lit(h)) for h in HEADERS},
        "has_code_blocks": F.contains(c, F.lit("```")),
        "has_json": c.rlike(r"\{[^{}]*\}"),
        "has_lists": c.rlike(r"(?m)^[\s]*[-*]|\d+\."),
        "has_markdown": c.rlike(r"(?m)^#+\s"),
    }


def structure_score(c: Column) -> Column:
    """Headers .4, code .2, other structure .2, content .2. More than 50 words count alike: longer texts have no band of their own."""
    f = structure_flags(c)
    num = lambda x, v: F.when(x, v).otherwise(0.0)
    headers = sum(num(f["has_" + h.replace(" ", "_")], 1.0) for h in HEADERS) / len(HEADERS)
    bonus = num(f["has_json"], 0.15) + num(f["has_lists"], 0.1) + num(f["has_markdown"], 0.1)
    n = F.size(words(c))
    content = F.when(n > 50, 0.7).when(n < 10, 0.2).otherwise(0.5)
    score = headers * 0.4 + num(f["has_code_blocks"], 0.5) * 0.2 + bonus * 0.2 + content * 0.2
    return F.when(strip(F.coalesce(c, F.lit(""))) == "", 0.0).otherwise(F.least(F.lit(1.0), score))


def categories(c: Column) -> Column:
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(k)) for k, p in CATEGORIES.items()]))


def has_fact_structure(c: Column) -> Column:
    """A verb of the list and two further words (one if a participle is there)."""
    def test(w: Column) -> Column:
        any_of = lambda xs: F.arrays_overlap(w, F.array(*map(F.lit, xs)))
        kept = F.filter(w, lambda x: (F.length(x) > 3) & ~x.isin(*PLAIN_WORDS))
        return any_of(FACT_VERBS) & (F.size(kept) >= F.when(any_of(PARTICIPLES), 1).otherwise(2))

    return let(words(F.lower(c)), test)


def is_verifiable(c: Column) -> Column:
    start = F.lower(strip(c)).rlike(GENERIC)
    seen = [c.rlike("(?i)" + p) for p in VERIFIABLE]
    marks = F.contains(c, F.lit("```")) | F.contains(c, F.lit("{")) | F.contains(c, F.lit("["))
    some = marks
    for s in seen:
        some = some | s
    return ~start & (some | has_fact_structure(c))  # the dearest test last


def is_hedged(c: Column) -> Column:
    out = F.lit(False)
    for p in HEDGES:
        out = out | c.rlike("(?i)" + p)
    return out


def claim_confidence(c: Column) -> Column:
    n = sum(c.rlike("(?i)" + p).cast("int") for p in VERIFIABLE)
    has = lambda s: F.contains(c, F.lit(s))
    score = F.lit(0.5) + F.least(n * 0.1, F.lit(0.3)) + F.when(has("```"), 0.1).otherwise(0.0) + F.when(has("{") & has("}"), 0.1).otherwise(0.0)
    score = score + F.when(has("[") & has("]"), 0.05).otherwise(0.0) + F.when(has_fact_structure(c), 0.1).otherwise(0.0) - F.when(is_hedged(c), 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def claims(c: Column) -> Column:
    """Atomic statements of a text's verifiable sentences that aren't hedged."""
    sentences = F.filter(F.transform(F.split(c, r"[.!?]\s+"), strip), lambda s: (s != "") & is_verifiable(s) & ~is_hedged(s))

    def atoms(s: Column) -> Column:
        parts = F.filter(F.transform(F.split(s, r"\s+(?:and|or|but)\s+|\s*,\s+"), strip), lambda p: (p != "") & ~F.lower(p).isin("and", "or", "but", ","))
        return F.when(F.size(parts) <= 1, F.array(s)).otherwise(parts)

    return F.flatten(F.transform(sentences, atoms))
