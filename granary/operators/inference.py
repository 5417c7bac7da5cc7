"""Tool calls in answers: named tools, inference by priority, marked calls, rates of use; predictions compared."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import json_text as J
from granary.functions import vectors as V

#: What stands around a call in an answer.
CALL_MARKS = (r"(?s)TOOL_CALL:\s*(\{.*?\})", r"(?s)<tool_call>(.*?)</tool_call>", r"(?s)```json\s*(\{.*?\})\s*```")


def named_tool(text: Column, tools: list[str]) -> Column:
    """The tool that a text names as a word, in any case; null if it names none or several."""
    named = F.array_compact(F.array(*[F.when(text.rlike(rf"(?i)(?<![A-Za-z0-9_]){re.escape(t)}(?![A-Za-z0-9_])"), F.lit(t)) for t in tools]))
    return V.let(named, lambda n: F.when(F.size(n) == 1, F.get(n, 0)))


def json_slice(text: Column, start: Column, end: Column) -> Column:
    """The outermost object in characters start to end of a text, if it parses."""
    part = F.substring(text, start + 1, end - start)
    whole = F.regexp_extract(part, r"(?s)\{.*\}", 0)
    return F.when((whole != "") & J.is_valid(whole), whole)


def infer_tool(df: DataFrame, registry: DataFrame, has_ids: Column, tool: Column, call: Column, gold: Column, text: Column, marked: Column, tools: list[str]) -> DataFrame:
    """`df` with `inferred`, `source` and `confidence`, by the first that says something: the tool that is there already (original), the
    first call (api), the keys of the gold JSON or of the first object of the text (schema), of its repaired first object if the text has
    a marked span (mask+schema), a tool that the text names (heuristic).

    `call`: a struct (name, arguments) or null; `gold`, `arguments`: JSON texts. Key sets meet the registry on shared names, once each.
    """
    from granary.operators.tools import match_by_keys

    objects = J.objects(text)
    valid = F.get(F.filter(objects, J.is_valid), 0)
    repaired = J.repair(F.get(objects, 0))
    keyed = lambda c: F.coalesce(J.keys(c), F.array().cast("array<string>"))
    steps = {"_call": keyed(call["arguments"]), "_gold": keyed(gold), "_text": keyed(valid), "_mark": F.when(marked, keyed(F.when(J.is_valid(repaired), repaired))).otherwise(F.array().cast("array<string>"))}
    out = df.withColumns(steps)
    for name in steps:
        out = match_by_keys(out, name, registry).withColumnsRenamed({"tool": f"{name}_tool", "match": f"{name}_match"})
    known = call["name"].isin(*tools)
    heuristic = named_tool(text, tools)
    say = lambda t, s, c: F.struct(t.cast("string").alias("inferred"), F.lit(s).alias("source"), c.alias("confidence"))
    none = F.lit(None).cast("string")
    found = F.coalesce(
        F.when(has_ids, say(tool, "original", F.when(tool.isNotNull(), F.lit("exact")))),
        F.when(known, say(call["name"], "api", F.when(F.col("_call_match") != "none", F.col("_call_match")).otherwise("exact"))),
        F.when(F.col("_gold_match") != "none", say(F.col("_gold_tool"), "schema", F.col("_gold_match"))),
        F.when(F.col("_text_match") != "none", say(F.col("_text_tool"), "schema", F.col("_text_match"))),
        F.when(F.col("_mark_match") != "none", say(F.col("_mark_tool"), "mask+schema", F.col("_mark_match"))),
        F.when(heuristic.isNotNull(), say(heuristic, "heuristic", F.lit("low"))),
        F.struct(none.alias("inferred"), none.alias("source"), none.alias("confidence")),
    )
    return out.withColumn("_found", found).select(*df.columns, "_found.*")


def marked_calls(text: Column, tools: list[str]) -> Column:
    """Calls (name, arguments as JSON text) behind the three marks, in the order of the marks; JSON with a comma too many is mended, and
    calls of unknown tools go."""
    parts = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in CALL_MARKS])
    mended = F.transform(parts, lambda j: F.when(J.is_valid(j), j).otherwise(F.regexp_replace(j, r",\s*([}\]])", "$1")))
    calls = F.transform(F.filter(mended, J.is_valid), lambda j: F.struct(F.get_json_object(j, "$.name").alias("name"), F.coalesce(F.get_json_object(j, "$.arguments"), F.lit("{}")).alias("arguments")))
    return F.filter(calls, lambda c: c["name"].isin(*tools))


def use_rates(df: DataFrame, call: Column, wanted: Column, tools: list[str]) -> DataFrame:
    """One row: rates of valid JSON, of the wanted tool, of calls that only repair makes valid, and of success (valid and wanted)."""
    valid = F.coalesce(J.is_valid(call), F.lit(False))
    mended = ~valid & F.coalesce(J.is_valid(J.repair(call)), F.lit(False))
    whole = F.when(valid, call).when(mended, J.repair(call))
    chosen = F.coalesce((F.get_json_object(whole, "$.name") == wanted) & wanted.isin(*tools), F.lit(False))
    rate = lambda c: F.coalesce(F.avg(c.cast("int")), F.lit(0.0))
    return df.agg(F.count(F.lit(1)).alias("n"), rate(valid).alias("json_validity"), rate(chosen).alias("tool_selection"), rate(mended).alias("repair"), rate(valid & chosen).alias("success"))


def outcome_counts(df: DataFrame, outcome: str, score: str) -> DataFrame:
    """One row: passed, failed and inconclusive outcomes, the share that passed, and the mean score."""
    of = lambda x: F.count_if(F.col(outcome) == x)
    return df.agg(of("pass").alias("passed"), of("fail").alias("failed"), of("inconclusive").alias("inconclusive"), F.avg((F.col(outcome) == "pass").cast("int")).alias("pass_rate"), F.avg(score).alias("avg_score"))


def compare_predictions(a: DataFrame, b: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Two datasets joined by key, with distance, divergence of the softmax, entropy, confidence and agreement of `left` and `right`.

    Raises if the datasets have unequal numbers of rows.
    """
    n = [x.agg(F.count(F.lit(1))).first()[0] for x in (a, b)]
    if n[0] != n[1]:
        raise ValueError(f"unequal numbers of predictions: {n[0]} and {n[1]}")
    pairs = a.join(b, key)
    both = pairs.withColumn("_p", F.transform(F.array(F.col(left), F.col(right)), lambda v: V.softmax(v)))
    scored = V.let(F.col("_p"), lambda x: F.struct(V.kl(F.get(x, 0), F.get(x, 1)).alias("kl"), V.entropy(F.get(x, 0)).alias("entropy"), F.array_max(F.get(x, 0)).alias("confidence")))
    return both.withColumn("_s", scored).withColumns({"l2": V.l2(F.col(left), F.col(right)), "agrees": V.agreement(F.col(left), F.col(right))}).select("*", "_s.*").drop("_p", "_s")
