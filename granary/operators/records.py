"""Expressions over nested records: judged pairs, tool-use items, changes, curricula."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as X
from granary.functions.hashing import seeded
from granary.operators.ordered import exact_ranks
from granary.functions.judging import CLAUSES, WEIGHTS

# Words of stages in prompts, the order of tests, synonyms for grounding.
STAGE_WORDS = (
    ("pleading", ("pleading", "submits change", "evidence manifest")),
    ("examination", ("examination", "examine", "budget and scope")),
    ("deliberation", ("deliberation", "deliberate", "gate integrity")),
    ("verdict", ("verdict", "pass", "fail")),
    ("publication", ("publication", "publish", "git")),
)
REASONS = {"EVIDENCE_COMPLETENESS": "EVIDENCE_COMPLETE", "BUDGET_ADHERENCE": "BUDGET_OK", "GATE_INTEGRITY": "GATES_OK", "PROVENANCE_CLARITY": "PROVENANCE_OK", "WAIVER_JUSTIFICATION": "WAIVER_OK"}
SYNONYMS = {"prefer": ("favor", "prioritize", "choose"), "extract": ("pull", "parse", "get"), "optimize": ("speed up", "improve", "enhance"), "support": ("enable", "allow", "permit")}


def _none(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _any(c: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.coalesce(c, F.lit("")), w))


# Judged pairs


def swap_sides(df: DataFrame) -> DataFrame:
    """Sides a and b change places; the winner and `Solution A` and `Solution B` in the reasons follow."""
    flip = F.when(F.col("winner") == "a", "b").when(F.col("winner") == "b", "a").otherwise(F.col("winner"))
    # A character that no text holds marks the first name while the second takes its place.
    said = F.regexp_replace(F.regexp_replace(F.regexp_replace("reasons", "(?<=[Ss]olution )A", "\u0001"), "(?<=[Ss]olution )B", "A"), "(?<=[Ss]olution )\u0001", "B")
    return df.withColumns({"a": F.col("b"), "b": F.col("a"), "winner": flip, "reasons": said})


def as_tie(df: DataFrame) -> DataFrame:
    """Winner tie, with reasons from the clauses that both sides share, in the order of side a."""
    a, b = _none(F.col("a.clauses")), _none(F.col("b.clauses"))
    both = F.filter(a, lambda c: F.array_contains(b, c))
    list_ = lambda c: F.array_join(c, ", ")
    shared = F.concat(F.lit("Both sides meet: "), list_(both), F.lit(". Side A meets: "), list_(a), F.lit(". Side B meets: "), list_(b), F.lit("."))
    return df.withColumns({"winner": F.lit("tie"), "reasons": F.when(F.size(both) > 0, shared).otherwise("Both sides are of like quality and meet different clauses.")})


def balance_winners(df: DataFrame, key: str, share_b: float = 0.42, share_tie: float = 0.16, seed: int = 42) -> DataFrame:
    """Rows of winner a become b (swapped) or tie, in a seeded order, up to the shares of all rows; rows of other winners go."""
    df = df.where(F.col("winner").isin("a", "b", "tie"))
    n = {r["winner"]: r["n"] for r in df.groupBy("winner").agg(F.count(F.lit(1)).alias("n")).collect()}  # three rows at most
    total = sum(n.values())
    to_b = max(0, min(n.get("a", 0), int(total * share_b) - n.get("b", 0)))
    to_tie = max(0, min(n.get("a", 0) - to_b, int(total * share_tie) - n.get("tie", 0)))
    ranked = exact_ranks(df, seeded(F.col(key), seed), F.col(key), group="winner").withColumnRenamed("_rank", "_r")
    own = F.col("winner") == "a"
    parts = [ranked.where(~own | (F.col("_r") > to_b + to_tie)), swap_sides(ranked.where(own & (F.col("_r") <= to_b))), as_tie(ranked.where(own & (F.col("_r") > to_b) & (F.col("_r") <= to_b + to_tie)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("_r")


def evidence_score(side: Column) -> Column:
    m = side["evidence_manifest"]
    score = F.when(F.size(_none(m["claims"])) > 0, 0.3).otherwise(0.0)
    score = score + F.when(m["verification_status"] == "verified", 0.4).when(F.coalesce(m["verification_status"], F.lit("pending")) == "pending", 0.2).otherwise(0.0)
    score = F.when(m.isNull(), 0.0).otherwise(F.least(F.lit(1.0), score + F.when(F.size(_none(m["evidence_references"])) > 0, 0.2).otherwise(0.0)))
    return F.round(F.when(F.array_contains(_none(side["clauses"]), CLAUSES[0]), F.greatest(score, F.lit(0.7))).otherwise(score), 2)


def budget_score(side: Column, max_files: Column, max_loc: Column) -> Column:
    """1 unless the change goes over; the clause of adherence sets 1 again before the numbers of the change are read."""
    change, clauses = F.coalesce(side["change_diff"], F.lit("")), _none(side["clauses"])
    over = F.upper(change).rlike("EXCEEDS BUDGET|BUDGET EXCEEDED")
    score = F.when(F.array_contains(clauses, CLAUSES[1]), 1.0).when(F.array_contains(clauses, CLAUSES[4]), 0.6).when(over, 0.3).otherwise(1.0)
    number = lambda p: F.regexp_extract(change, p, 1).try_cast("int")
    beyond = (F.coalesce(number(r"(?i)(\d+)\s+files?"), F.lit(0)) > max_files) | (F.coalesce(number(r"(?i)(\d+)\s+LOC"), F.lit(0)) > max_loc)
    return F.round(F.when(beyond, F.least(score, F.lit(0.4))).otherwise(score), 2)


def gate_score(side: Column) -> Column:
    clauses, said, claims = _none(side["clauses"]), F.lower(side["text"]), F.lower(F.array_join(_none(side["evidence_manifest"]["claims"]), " "))
    score = F.when(F.array_contains(clauses, CLAUSES[2]), 1.0).when(F.array_contains(clauses, CLAUSES[4]), 0.6).otherwise(0.5)
    for c, good, bad in ((claims, ("tests pass", "lint clean", "coverage"), ("tests fail", "lint error", "coverage below")), (said, ("all tests pass", "lint clean", "coverage above"), ("tests fail", "lint errors", "coverage below"))):
        score = F.when(_any(c, good), F.greatest(score, F.lit(0.8))).otherwise(score)
        score = F.when(_any(c, bad), F.least(score, F.lit(0.3))).otherwise(score)
    return F.round(score, 2)


def provenance_score(side: Column) -> Column:
    chain = side["provenance_chain"]
    n = F.size(_none(chain["steps"]))
    score = F.when(n >= 3, 0.7).when(n == 2, 0.6).when(n == 1, 0.4).otherwise(0.0) + F.when(F.coalesce(chain["audit_trail"], F.lit("")) != "", 0.2).otherwise(0.0)
    score = F.when(chain.isNull(), 0.0).otherwise(score)
    return F.round(F.when(F.array_contains(_none(side["clauses"]), CLAUSES[3]), F.greatest(score, F.lit(0.7))).otherwise(score), 2)


def side_scores(side: Column, max_files: Column, max_loc: Column) -> Column:
    parts = {"E": evidence_score(side), "B": budget_score(side, max_files, max_loc), "G": gate_score(side), "P": provenance_score(side)}
    total = sum((c * WEIGHTS[k] for k, c in parts.items()), F.lit(0.0))
    return F.struct(*[c.alias(k) for k, c in parts.items()], F.round(total, 2).alias("total"))


def stage(prompt: Column, a: Column, b: Column, has_budget: Column) -> Column:
    """First stage that the prompt names, or else that the sides show; verdict by default."""
    p = F.lower(F.coalesce(prompt, F.lit("")))
    out = None
    for name, words in STAGE_WORDS:
        out = F.when(_any(p, words), name) if out is None else out.when(_any(p, words), name)
    either = lambda f: f(a) | f(b)
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    out = out.when(either(lambda s: s["evidence_manifest"].isNotNull()) & either(lambda s: filled(s["rationale"])), "pleading")
    out = out.when(either(lambda s: filled(s["change_diff"])) & has_budget & _any(p, ("budget", "scope")), "examination")
    out = out.when(either(lambda s: _any(F.lower(F.array_join(_none(s["evidence_manifest"]["claims"]), " ")), ("test", "lint", "coverage", "gate"))), "deliberation")
    out = out.when(either(lambda s: _any(F.lower(s["text"]), ("pass:", "fail:", "waiver_required", "verdict"))), "verdict")
    out = out.when(either(lambda s: (F.size(_none(s["provenance_chain"]["steps"])) >= 4) & _any(F.lower(s["provenance_chain"]["audit_trail"]), ("git", "commit"))), "publication")
    return out.otherwise("verdict")


def clause_reasons(clauses: Column) -> Column:
    """Reasons of the clauses, distinct and in order; QUALITY_HIGHER for an unknown one."""
    known = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    return F.array_distinct(F.transform(_none(clauses), lambda c: F.coalesce(known[c], F.lit("QUALITY_HIGHER"))))


# Grounding of spans in tool results


def span_texts(text: Column) -> Column:
    """What follows `Integration:` up to the end of the sentence; without one, up to the end of the text."""
    return F.regexp_extract_all(text, F.lit(r"Integration:\s*([^\n]+?)(?:[.!?…]\s|$)"), F.lit(1))


def _folded(c: Column) -> Column:
    return X.strip(F.regexp_replace(F.lower(c), r"\s+", " "))


def is_grounded(span: Column, fields: Column) -> Column:
    """A span with a value of the map, with one of the value's synonyms, or with a number as a word of its own."""
    said = _folded(span)
    values = F.filter(F.map_values(fields), lambda v: F.coalesce(v, F.lit("")) != "")

    def held(v: Column) -> Column:
        forms = [_folded(v)] + [F.replace(_folded(v), F.lit(k), F.lit(x)) for k, xs in SYNONYMS.items() for x in xs]
        padded = F.concat(F.lit(" "), F.regexp_replace(span, r"[^\p{L}\p{N}_]+", " "), F.lit(" "))
        word = F.contains(padded, F.concat(F.lit(" "), F.regexp_replace(v, r"\D", ""), F.lit(" ")))
        return F.when(v.try_cast("double").isNotNull(), word).otherwise(F.exists(F.array(*forms), lambda f: F.contains(said, f)))

    return F.exists(values, held)


#: Fields of which one must be grounded.
KEYED = ("summary", "lines", "count", "top_k")


def is_grounded_strictly(span: Column, fields: Column, results: Column) -> Column:
    """A span with the value of a keyed field, or with one of the first three results.

    A number counts as a word of its own, or if all digits of the span are that number (with a point or a comma, within 1e-6), or a
    hundred times that number in a span that speaks of percent. A link counts if its host and the first part of its path are there.
    """
    said = _folded(span)
    point = F.regexp_replace(said, r"[^0-9.]", "").try_cast("double")
    comma = F.replace(F.regexp_replace(said, r"[^0-9,]", ""), F.lit(","), F.lit(".")).try_cast("double")
    percent = F.contains(said, F.lit("%")) | F.contains(said, F.lit("percent"))
    padded = F.concat(F.lit(" "), F.regexp_replace(said, r"[^\p{L}\p{N}_]+", " "), F.lit(" "))

    def near(v: Column, x: Column) -> Column:
        return F.coalesce(F.abs(v - x) <= 1e-6, F.lit(False)) | (percent & F.coalesce(F.abs(v - x / 100) <= 1e-6, F.lit(False)))

    def held(v: Column) -> Column:
        number = v.try_cast("double")
        whole = F.contains(padded, F.concat(F.lit(" "), number.cast("bigint").cast("string"), F.lit(" ")))
        host = F.regexp_replace(F.lower(F.regexp_extract(v, r"://([^/?#]*)", 1)), r"^www\.", "")
        path = F.regexp_extract(v, r"://[^/?#]*/+([^/?#]+)", 1)
        link = (host != "") & F.contains(said, host) & F.contains(said, F.lower(path))
        plain = F.contains(said, _folded(v))
        return F.coalesce(F.when(number.isNotNull(), whole | near(number, point) | near(number, comma)).otherwise(plain | link), F.lit(False))

    values = F.filter(F.array(*[fields[k] for k in KEYED]), lambda v: F.coalesce(v, F.lit("")) != "")
    items = F.filter(F.slice(F.coalesce(results, F.array().cast("array<string>")), 1, 3), lambda v: F.coalesce(v, F.lit("")) != "")
    return F.exists(values, held) | F.exists(items, lambda v: F.contains(said, _folded(v)))


def grounding_f1(spans: Column, fields: Column) -> Column:
    """Precision, recall (1 if any span is grounded) and F1; zeros without spans or fields."""
    n = F.size(F.filter(spans, lambda s: is_grounded(s, fields)))
    precision = n / F.greatest(F.size(spans), F.lit(1))
    recall = F.when(n > 0, 1.0).otherwise(0.0)
    nothing = (F.size(spans) <= 0) | (F.size(F.map_keys(fields)) <= 0)
    f1 = F.when(n > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    zero = F.lit(0.0)
    return F.struct(F.when(nothing, zero).otherwise(precision).alias("precision"), F.when(nothing, zero).otherwise(recall).alias("recall"), F.when(nothing, zero).otherwise(f1).alias("f1"))


def verify(prompt: Column, text: Column, fields: Column, is_control: Column, header: str = "header", header_keys: tuple[str, ...] = ("tier", "max_files", "max_loc", "cov", "mut")) -> Column:
    """ok, problems and F1 of one item. A missing header and a low F1 are problems that don't make an item fail."""
    first = X.strip(F.get(F.split(prompt, "\n", 2), 0))
    has_header = F.lit(True)
    for k in header_keys:
        has_header = has_header & F.get_json_object(first, f"$.{header}.{k}").isNotNull()
    spans = span_texts(text)
    f1 = grounding_f1(spans, fields)
    private = X.privacy(text)
    hard = [F.when(is_control & (F.size(spans) > 0), F.lit("control_has_integration")), F.when(~private["privacy_ok"], F.lit("privacy")), F.when(~is_control & (F.size(spans) > 0) & (f1["recall"] == 0), F.lit("not_grounded"))]
    soft = [F.when(~F.coalesce(has_header, F.lit(False)), F.lit("header")), F.when(~is_control & (f1["f1"] < 0.5), F.lit("low_f1"))]
    failed = F.array_compact(F.array(*hard))
    return F.struct((F.size(failed) == 0).alias("ok"), F.concat(failed, F.array_compact(F.array(*soft))).alias("problems"), f1.alias("integration"))


def score(prompt: Column, output: Column, calls: Column, fields: Column, wanted: Column, is_control: Column, span_cap: int = 3) -> Column:
    """Scores of one run. `calls`: array of (name, arguments as JSON text, result text); `wanted`: names of the expected calls."""
    spans = span_texts(output)
    capped = F.slice(spans, 1, span_cap)
    names = F.transform(calls, lambda c: c["name"])
    eligible = ~is_control & (F.size(names) > 0) & (F.size(F.map_keys(fields)) > 0)
    private = X.privacy(output)
    tokens = lambda c: X.estimated_tokens(F.array_join(c, " "))
    results = F.transform(calls, lambda c: F.coalesce(c["result"], F.lit("")))
    code = output.rlike(r"\bawait\b|\bimport\b")
    return F.struct(
        eligible.alias("eligible"), F.when(eligible, grounding_f1(capped, fields)).alias("integration"), F.size(spans).alias("n_spans"), (F.size(spans) > span_cap).alias("over_cap"),
        (names == wanted).alias("calls_match"), F.forall(calls, lambda c: F.try_parse_json(c["arguments"]).isNotNull()).alias("args_ok"),
        (is_control & (F.size(spans) > 0)).alias("control_hit"), private["privacy_ok"].alias("privacy_ok"),
        (X.estimated_tokens(prompt) + X.estimated_tokens(output) + tokens(results)).alias("tokens_total"), tokens(results).alias("tokens_results"),
        F.exists(results, lambda r: (F.length(r) > 20) & F.contains(output, r)).alias("leak"), code.alias("used_code"), (~code & (F.size(names) > 0)).alias("used_tools"),
    )


# Changes


def diff_stats(df: DataFrame, key: str, diff: str) -> DataFrame:
    """added, removed, files and total of a unified diff per key. A file header names a file; a diff without one is one file.

    In a hunk with only additions or only removals, a header that says more was replaced adds the missing lines.
    """
    lines = df.select(key, F.posexplode(F.split(F.coalesce(diff, F.lit("")), "\n", -1)).alias("i", "line"))
    head = F.col("line").rlike(r"^(\+\+\+|---)")
    hunk = F.col("line").rlike(r"^@@\s+-\d+,\d+\s+\+\d+,\d+\s+@@")
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    part = lambda n: F.regexp_extract("line", r"^@@\s+-\d+,(\d+)\s+\+\d+,(\d+)", n).try_cast("int")
    path = F.regexp_replace(X.strip(F.get(F.split(F.substring("line", 5, 1_000_000), "\t"), 0)), "^[ab]/", "")
    lines = lines.withColumns({"hunk": F.sum(hunk.cast("int")).over(w), "plus": (F.col("line").startswith("+") & ~head).cast("int"), "minus": (F.col("line").startswith("-") & ~head).cast("int"), "old": F.when(hunk, part(1)), "new": F.when(hunk, part(2)), "file": F.when(head & (path != "") & (path != "/dev/null"), path)})
    per = lines.groupBy(key, "hunk").agg(F.sum("plus").alias("p"), F.sum("minus").alias("m"), F.max("old").alias("old"), F.max("new").alias("new"), F.collect_set("file").alias("files"))
    net = F.col("new") - F.col("old")
    replaced = F.when((F.col("old") == 1) & (F.col("new") > 1) & (F.col("m") == 0) & (F.col("p") > 0), 1).otherwise(0) + F.when((F.col("p") > net) & (F.col("m") == 0), F.col("p") - net).otherwise(0)
    written = F.when((F.col("new") == 1) & (F.col("old") > 1) & (F.col("p") == 0) & (F.col("m") > 0), 1).otherwise(0) + F.when((net != F.col("p") - F.col("m")) & ~((F.col("p") > net) & (F.col("m") == 0)) & (net < 0) & (F.col("p") == 0), -net).otherwise(0)
    out = per.groupBy(key).agg(F.sum(F.col("p") + F.coalesce(written, F.lit(0))).alias("added"), F.sum(F.col("m") + F.coalesce(replaced, F.lit(0))).alias("removed"), F.greatest(F.size(F.array_distinct(F.flatten(F.collect_list("files")))), F.lit(1)).alias("files"))
    return out.withColumn("total", F.col("added") + F.col("removed"))


# Curricula, tags, batches


def tag_by_priority(df: DataFrame, tests: list[tuple[str, Column]], target: int, key: str) -> DataFrame:
    """`df` with `tag`: exactly `target` rows (or all that pass a test), those of earlier tests first, by key within a test."""
    first = None
    for i, (_, test) in enumerate(tests):
        first = F.when(test, i) if first is None else first.when(test, i)
    marked = df.withColumn("_p", first)
    counts = marked.where("_p is not null").groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each test
    n, left, parts = {r["_p"]: r["n"] for r in counts}, target, []
    ranked = marked.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(key)))
    tag = F.lit(None).cast("string")
    for i, (name, _) in enumerate(tests):
        take = min(left, n.get(i, 0))
        left -= take
        parts.append((i, name, take))
    for i, name, take in parts:
        tag = F.when((F.col("_p") == i) & (F.col("_r") <= take), F.lit(name)).otherwise(tag)
    return ranked.withColumn("tag", tag).drop("_p", "_r")


def latent_slots(steps: Column, answer: Column, replaced: int, slots: int) -> Column:
    """The first `replaced` steps become slots and one end mark; parts are set apart by blank lines."""
    head = F.concat(F.array_repeat(F.lit("<bot>"), slots), F.array(F.lit("<eot>")))
    rest = F.slice(steps, replaced + 1, 1 << 30)
    return F.array_join(F.concat(head, rest, F.array(answer)), "\n\n")


def shift_labels(ids: Column, size: int, pad: int = -100) -> Column:
    """Inputs (all but the last of size + 1) and labels (all but the first), labels padded to `size`."""
    own = F.slice(ids, 1, size + 1)
    labels = F.slice(own, 2, size)
    return F.struct(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))).alias("inputs"), F.concat(labels, F.array_repeat(F.lit(pad), F.lit(size) - F.size(labels))).alias("labels"))


def token_span(offsets: Column, start: Column, end: Column) -> Column:
    """First and last (exclusive) of the tokens (arrays of start and end) that overlap a character span; null if none does."""
    hits = F.filter(F.transform(offsets, lambda o, i: F.struct(i.alias("i"), (o["end"] > start).alias("a"), (o["start"] < end).alias("b"))), lambda h: h["a"] & h["b"])
    return F.when(F.size(hits) > 0, F.struct(F.get(hits, 0)["i"].alias("start"), (F.element_at(hits, -1)["i"] + 1).alias("end")))


def output_penalties(c: Column) -> Column:
    """Penalties of spans and steps over budget, of weak answers, and of code without tools."""
    spans = F.regexp_count(c, F.lit("<bot>"))
    steps = F.regexp_count(c, F.lit(r"(?i)Step \d+:"))
    budget = F.when(spans != F.regexp_count(c, F.lit("<eot>")), 1.0).otherwise(0.0) + F.greatest(spans - 3, F.lit(0)) * 0.5 + F.greatest(steps - 5, F.lit(0)) * 0.2
    low = F.lower(c)
    turns = sum(F.contains(low, F.lit(w)).cast("int") for w in ("however", "but", "contrary", "despite", "although"))
    quality = F.when(F.length(X.strip(c)) < 50, 1.0).otherwise(0.0) + turns * 0.1 + F.when(low.rlike("answer|conclusion|result|therefore"), 0.0).otherwise(0.2)
    return F.struct(budget.alias("budget"), quality.alias("quality"))
