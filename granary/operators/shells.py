"""Shells of nested records: typed defaults, repair of dependent fields, fill counts, derived marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Clauses in their order.
EVIDENCE, PROVENANCE, GATE = "EVIDENCE_COMPLETENESS", "PROVENANCE_CLARITY", "GATE_INTEGRITY"
TOOL_TASKS = ("tool_use", "caws_tool")

SPEC = "struct<id:string,title:string,risk_tier:int,budget:struct<max_files:int,max_loc:int>,scope:struct<in:array<string>,out:array<string>>>"
MANIFEST = "struct<claims:array<string>,verification_status:string,evidence_references:array<string>>"
CHAIN = "struct<steps:array<string>,audit_trail:string>"
SUPERVISION = "struct<tool_name_ids:array<int>,gold_json_text_ids:array<int>,integration_mask:array<int>>"

_none = lambda kind: F.array().cast(f"array<{kind}>")


def working_spec(s: Column) -> Column:
    """A whole working spec: missing parts take their defaults."""
    budget = F.struct(*[F.coalesce(s["budget"][k], F.lit(0)).cast("int").alias(k) for k in ("max_files", "max_loc")])
    scope = F.struct(*[F.coalesce(s["scope"][k], _none("string")).alias(k) for k in ("in", "out")])
    return F.struct(F.coalesce(s["id"], F.lit("UNKNOWN")).alias("id"), F.coalesce(s["title"], F.lit("")).alias("title"), F.coalesce(s["risk_tier"], F.lit(0)).cast("int").alias("risk_tier"), budget.alias("budget"), scope.alias("scope"))


def manifest(m: Column) -> Column:
    return F.struct(F.coalesce(m["claims"], _none("string")).alias("claims"), F.coalesce(m["verification_status"], F.lit("UNKNOWN")).alias("verification_status"), F.coalesce(m["evidence_references"], _none("string")).alias("evidence_references"))


def chain(c: Column) -> Column:
    return F.struct(F.coalesce(c["steps"], _none("string")).alias("steps"), F.coalesce(c["audit_trail"], F.lit("")).alias("audit_trail"))


def supervision(p: Column, task: Column) -> Column:
    """A whole shell for tool tasks; for others what is there."""
    parts = [F.coalesce(p[k], _none("int")).alias(k) for k in ("tool_name_ids", "gold_json_text_ids", "integration_mask")]
    return F.when(task == "tool_use", F.struct(*parts)).otherwise(p)


def empty_scores() -> Column:
    side = lambda: F.struct(*[F.lit(0.0).alias(k) for k in ("E", "B", "G", "P", "total")])
    return F.struct(side().alias("a"), side().alias("b"))


def fill_worker(df: DataFrame) -> DataFrame:
    """Whole shells of a worker's record: working_spec, evidence_manifest, provenance_chain, role, task_type and caws_level; `filled` names
    the columns that were null."""
    rules = {
        "working_spec": working_spec(F.col("working_spec")), "evidence_manifest": manifest(F.col("evidence_manifest")), "provenance_chain": chain(F.col("provenance_chain")),
        "role": F.coalesce("role", F.lit("worker")), "task_type": F.coalesce("task_type", F.lit("plain_kd")), "caws_level": F.coalesce("caws_level", F.lit("none")),
    }
    marks = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in rules]))
    return df.withColumns({"filled": marks} | {c: v for c, v in rules.items()})


def fill_judge(df: DataFrame) -> DataFrame:
    """A judge's record: a missing winner is a tie (a wrong one stays), missing debate scores are zeros."""
    marks = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("winner", "debate_scores")]))
    return df.withColumns({"filled": marks, "winner": F.coalesce("winner", F.lit("tie")), "debate_scores": F.coalesce("debate_scores", empty_scores())})


def repair_dependencies(df: DataFrame) -> DataFrame:
    """Tool tasks have process supervision, records of a level other than none have a working spec; `repaired` names what was added."""
    tool = (F.col("task_type") == "tool_use") & F.col("process_supervision").isNull()
    spec = F.col("caws_level").isNotNull() & ~F.col("caws_level").isin("none", "0") & F.col("working_spec").isNull()
    marks = F.array_compact(F.array(F.when(tool, F.lit("process_supervision")), F.when(spec, F.lit("working_spec"))))
    return df.withColumns({"repaired": marks, "process_supervision": F.when(tool, supervision(F.col("process_supervision"), F.col("task_type"))).otherwise(F.col("process_supervision")), "working_spec": F.when(spec, working_spec(F.col("working_spec"))).otherwise(F.col("working_spec"))})


def fill_counts(df: DataFrame, marks: str = "filled") -> DataFrame:
    """How often each field was filled."""
    return df.select(F.explode(marks).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def inferred_clauses(level: Column, has_manifest: Column, has_chain: Column, task: Column) -> Column:
    """Clauses that an answer's record bears out, in order; the clause of evidence if there is none."""
    said = F.array(
        F.when((level >= 1) | has_manifest, F.lit(EVIDENCE)), F.when((level >= 2) | has_chain, F.lit(PROVENANCE)), F.when(task.isin(*TOOL_TASKS), F.lit(GATE))
    )
    found = F.array_compact(said)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(EVIDENCE)))


def curriculum_marks(text: Column, task: Column, has_ids: Column, has_reasoning: Column, has_context: Column) -> Column:
    """(ready, tag): fit for work on latent steps (structure, reasoning, 101 to 7,999 characters, no notes to fill in), and fit for the tag
    (any of these signals, over 50 characters, no notes and no mock)."""
    up, n = F.upper(F.coalesce(text, F.lit(""))), F.length(F.coalesce(text, F.lit("")))
    noted = F.contains(up, F.lit("TODO")) | F.contains(up, F.lit("PLACEHOLDER"))
    ready = ((task.isin(*TOOL_TASKS) & has_ids) | has_context) & has_reasoning & (n > 100) & (n < 8000) & ~noted
    tag = (has_reasoning | has_ids | has_context) & (n > 50) & ~noted & ~F.contains(up, F.lit("MOCK"))
    return F.struct(F.coalesce(ready, F.lit(False)).alias("ready"), F.coalesce(tag, F.lit(False)).alias("tag"))


def compact_spec(s: Column) -> Column:
    """One line that says tier, budget and scope of a working spec."""
    w = working_spec(s)
    return F.format_string("tier=%d files<=%d loc<=%d in=%s out=%s", w["risk_tier"], w["budget"]["max_files"], w["budget"]["max_loc"], F.array_join(w["scope"]["in"], ","), F.array_join(w["scope"]["out"], ","))
