"""Rows of worker, judge and drafter datasets: issues of their quality, links between them, traces, scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import json_text as J
from granary.functions.judging import CLAUSES

# Names of issues as reports print them, kinds of tasks, length buckets, words of integrated results.
TASKS = ("plain_kd", "tool_use", "caws_tool", "long_context")
WINNERS = ("a", "b", "tie")
BUCKETS = (200, 400, 800)
RESULT_WORDS = ("summary", "results", "content", "data", "output")
CALL = "tool.call{"
CALL_PARTS = ("tool", "call", "{", "ok")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _issues(*tests: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name) if isinstance(name, str) else name) for test, name in tests]))


def issue_score(issues: Column) -> Column:
    """Ten, less two for each issue, not below zero."""
    return F.greatest(F.lit(0), 10 - 2 * F.size(issues))


def worker_issues(prompt: Column, answer: Column, source: Column, task: Column, level: Column, has_context: Column, has_proof: Column) -> Column:
    """Issues of a worker row. `level` null is 0; `has_context`, `has_proof`: whether the row has a context, evidence and provenance."""
    p, a, n = _text(prompt), _text(answer), F.coalesce(level, F.lit(0))
    unproved = (n == 2) & ~has_proof
    return _issues(
        (F.length(p) < 20, "Very short prompt"), (F.length(p) > 10000, "Very long prompt"), (~p.rlike(r"(?U)\S"), "Empty prompt"), (~p.rlike(r"[?.]"), "Prompt lacks clear structure"),
        ((a != "") & (F.length(a) < 20), "Very short teacher_text"), (F.length(a) > 50000, "Very long teacher_text"), ((a == "") & ~source.eqNullSafe("synthetic"), "Missing teacher_text"),
        (unproved, "caws_level=2 but missing evidence/provenance"), (~unproved & (n >= 1) & ~has_context, F.concat(F.lit("caws_level="), n.cast("string"), F.lit(" but missing CAWS context"))),
        (~_text(task).isin(*TASKS), F.concat(F.lit("Invalid task_type: "), _text(task))),
    )


def judge_issues(prompt: Column, a: Column, b: Column, a_clauses: Column, b_clauses: Column, winner: Column) -> Column:
    """Issues of a judge row: two texts with their clauses, and the winner."""
    p, x, y = _text(prompt), _text(a), _text(b)
    none = F.array().cast("array<string>")
    clauses = F.concat(F.coalesce(a_clauses, none), F.coalesce(b_clauses, none))
    odd = F.filter(clauses, lambda c: ~c.isin(*CLAUSES))
    return _issues(
        (F.length(p) < 20, "Very short prompt"), (F.length(p) > 20000, "Very long prompt"), (F.length(x) < 10, "Very short a.text"), (F.length(y) < 10, "Very short b.text"),
        (F.size(clauses) == 0, "Both a and b have no clauses"), (F.size(odd) > 0, F.concat(F.lit("Invalid clauses: ['"), F.array_join(odd, "', '"), F.lit("']"))),
        (~_text(winner).isin(*WINNERS), F.concat(F.lit("Invalid winner: "), _text(winner))), (x == y, "a.text and b.text are identical"),
    )


def drafter_issues(prompt: Column, answer: Column, bucket: Column) -> Column:
    """Issues of a drafter row: a short answer with its length bucket."""
    n = F.length(_text(answer))
    return _issues(
        (F.length(_text(prompt)) < 20, "Very short prompt"), (n == 0, "Empty teacher_text"), (n > 2000, F.concat(F.lit("Too long for Drafter: "), n.cast("string"), F.lit(" chars"))),
        ((n > 0) & (n < 50), "Very short teacher_text"), (~F.coalesce(bucket, F.lit(0)).isin(*BUCKETS), F.concat(F.lit("Invalid length bucket: "), F.coalesce(bucket.cast("string"), F.lit("None")))),
    )


def issue_report(df: DataFrame, issues: Column, kind: Column) -> DataFrame:
    """kind, issue, n: how many rows of each kind have an issue; counted per task first."""
    return df.select(kind.alias("kind"), F.explode(F.array_distinct(issues)).alias("issue")).groupBy("kind", "issue").agg(F.count(F.lit(1)).alias("n"))


def working_id(raw: Column) -> Column:
    """The id of the working record of a JSON row: its own, or else that of its context; empty ids don't count."""
    at = lambda path: F.nullif(F.get_json_object(raw, path), F.lit(""))
    return F.coalesce(at("$.working_spec.id"), at("$.caws_context.working_spec.id"))


def provenance_hash(raw: Column) -> Column:
    return F.get_json_object(raw, "$.provenance.hash")


def linkage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct ids of two datasets, shared ones, and those of one side. Ids are counted once per side before they meet."""
    side = lambda df, n: df.where(F.col(key).isNotNull()).select(F.col(key).alias("_id"), F.lit(n).alias("_side"))
    ids = side(a, 1).unionByName(side(b, 2)).groupBy("_id").agg(F.bit_or("_side").alias("_in"))
    of = lambda *x: F.count_if(F.col("_in").isin(*x))
    return ids.agg(of(1, 3).alias("first_ids"), of(2, 3).alias("second_ids"), of(3).alias("shared_ids"), of(1).alias("first_only"), of(2).alias("second_only"))


def trace_calls(trace: Column) -> Column:
    """Calls (name, arguments) of an array of (name, arguments, result) with JSON texts; a missing name is empty, arguments are {}."""
    return F.transform(trace, lambda t: F.struct(_text(t["name"]).alias("name"), F.coalesce(t["arguments"], F.lit("{}")).alias("arguments")))


def result_fields(trace: Column) -> Column:
    """Fields of the object results of a trace, as texts; a later call's value of a field stays. Results that are no objects are left out."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    own = lambda t: F.coalesce(F.from_json(t["result"], "map<string,string>"), none)
    # Entries that the next call has go before its own are added, so keys stay unique.
    return F.aggregate(trace, none, lambda m, t: F.map_concat(F.map_filter(m, lambda k, v: ~F.map_contains_key(own(t), k)), own(t)))


def integrated_fields(text: Column, spans: Column) -> Column:
    """For each span (start, end) in order, the words of results that its characters hold, in any case."""
    held = lambda part: F.filter(F.array(*[F.lit(w) for w in RESULT_WORDS]), lambda w: F.contains(part, w))
    return F.flatten(F.transform(spans, lambda s: held(F.lower(F.substring(text, s["start"] + 1, s["end"] - s["start"])))))


def presence_f1(df: DataFrame, target: Column, said: Column, mark: str = CALL, parts: tuple[str, ...] = CALL_PARTS) -> DataFrame:
    """One row: tp, fp, fn and F1 of rows that hold a mark. A prediction counts if it holds the mark or any of its parts; a missed one
    counts half if it has any word that is no <placeholder>."""
    wanted, got = F.contains(_text(target), F.lit(mark)), F.lit(False)
    for p in (mark, *parts):
        got = got | F.contains(_text(said), F.lit(p))
    some = F.exists(F.split(_text(said), r"(?U)\s+"), lambda w: (w != "") & ~(F.startswith(w, F.lit("<")) & F.endswith(w, F.lit(">"))))
    missed = F.when(wanted & ~got, F.when(some, 0.5).otherwise(1.0)).otherwise(0.0)
    sums = df.agg(
        F.coalesce(F.sum(F.when(wanted & got, 1.0).when(wanted & some, 0.5).otherwise(0.0)), F.lit(0.0)).alias("tp"), F.coalesce(F.sum(F.when(got & ~wanted, 1.0).otherwise(0.0)), F.lit(0.0)).alias("fp"),
        F.coalesce(F.sum(missed), F.lit(0.0)).alias("fn"),
    )
    p, r = F.col("tp") / (F.col("tp") + F.col("fp") + 1e-9), F.col("tp") / (F.col("tp") + F.col("fn") + 1e-9)
    return sums.select("tp", "fp", "fn", (2 * p * r / (p + r + 1e-9)).alias("f1"))


def broken_vector(v: Column) -> Column:
    """(has_nan, all_zero) of an array of numbers; an empty one is all zero."""
    return F.struct(F.exists(v, lambda x: F.isnan(x)).alias("has_nan"), F.forall(v, lambda x: F.abs(x) < 1e-12).alias("all_zero"))


def scenario_result(output: Column, kind: Column, tools: Column, has_script: Column, most_calls: Column, pass_least: float = 0.8, unsure_least: float = 0.5) -> Column:
    """(result, score, errors) of a scenario. Too many calls or an object that doesn't parse is a failure. One rubric gives half a point:
    `schema_check` if all calls between <bot> and </bot> name a tool of `tools`, `functional_test` without a script, `judge_model` always."""
    text = _text(output)
    count = F.size(F.split(text, "<bot>", -1)) - 1
    spam = count > F.coalesce(most_calls, F.lit(10))
    broken = F.exists(F.regexp_extract_all(text, F.lit(r"\{[^}]*\}"), F.lit(0)), lambda j: ~J.is_valid(j))
    calls = F.regexp_extract_all(text, F.lit(r"<bot>([^<]+)</bot>"), F.lit(1))
    name = lambda j: F.get_json_object(j, "$.name")
    error = lambda j: F.when(~J.is_valid(j), F.concat(F.lit("Invalid JSON in tool call: "), j)).when(
        ~F.coalesce(F.array_contains(tools, name(j)), F.lit(False)), F.concat(F.lit("Unexpected tool: "), F.coalesce(name(j), F.lit("None"))))
    rubric = F.coalesce(kind, F.lit("schema_check"))
    none = F.array().cast("array<string>")
    errors = (
        F.when(spam | broken, F.array(F.lit("Catastrophic failure detected"))).when(rubric == "schema_check", F.array_compact(F.transform(calls, error)))
        .when((rubric == "functional_test") & has_script, F.array(F.lit("Functional test not implemented"))).otherwise(none)
    )
    score = F.when(spam | broken | (F.size(errors) > 0) | ~rubric.isin("schema_check", "functional_test", "judge_model"), 0.0).otherwise(0.5)
    result = F.when(spam | broken, "fail").when(score >= pass_least, "pass").when(score >= unsure_least, "inconclusive").otherwise("fail")
    return F.struct(result.alias("result"), score.alias("score"), errors.alias("errors"))
