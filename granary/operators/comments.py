"""Comments of source texts: extraction, open-work marks, attachment of stubs to the comment before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as X

# Marks of open work by confidence, and paths of generated files.
EXPLICIT = r"(?i)\b(TODO|FIXME|HACK|XXX)\b"
LIKELY = r"(?i)\b(not (yet )?implemented|placeholder|stub|temporary|for now|workaround)\b"
POSSIBLE = r"(?i)\b(simplified|could be|should be improved|hardcoded)\b"
GENERATED = r"(?i)\.next\b|generated|build/|dist/|target/|node_modules|\.min\.|\.bundle\.|\.chunk\."
STUB = r"^\s*(pass|\.\.\.|raise NotImplementedError\b.*|throw new Error\(.*\);?)\s*$"


def lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, line number from 1, line."""
    return files.select(F.col(path).alias("path"), F.posexplode(F.split(text, "\n", -1)).alias("i", "line")).select("path", (F.col("i") + 1).alias("line_number"), "line")


def extract(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, line_number, comment: lines that start a comment in their file's language, and lines within /* */."""
    rows = lines(files, path, text)
    hash_ = F.col("path").rlike(r"\.(py|pyi|rb|sh|bash|yml|yaml|toml)$")
    w = Window.partitionBy("path").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    opens, closes = F.col("line").rlike(r"^\s*/\*").cast("int"), F.col("line").rlike(r"\*/").cast("int")
    inside = (F.sum(opens).over(w) - F.sum(closes).over(w) + closes) > 0
    marked = rows.withColumn("inside", inside & ~hash_)
    single = F.when(hash_, F.col("line").rlike(r"^\s*#")).otherwise(F.col("line").rlike(r"^\s*//"))
    body = X.strip(F.regexp_replace("line", r"^\s*(#+|//+|/\*+|\*+(?!/))\s?|\*/\s*$", ""))
    return marked.where(single | F.col("inside")).select("path", "line_number", body.alias("comment")).where("comment <> ''")


def confidence(comment: Column, path: Column) -> Column:
    """Confidence that a comment marks open work, lowered in generated files and for short texts; null without a mark."""
    context = F.when(comment.rlike(EXPLICIT), 0.3).otherwise(0.0) - F.when(path.rlike(GENERATED), 0.4).otherwise(0.0) - F.when((F.length(comment) < 20) & ~comment.rlike(EXPLICIT), 0.2).otherwise(0.0)
    clamp = lambda base, share: F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.lit(base) + context * share))
    return F.round(F.when(comment.rlike(EXPLICIT), clamp(1.0, 0.3)).when(comment.rlike(LIKELY), clamp(0.9, 0.2)).when(comment.rlike(POSSIBLE), clamp(0.6, 0.1)), 4)


def attach_stubs(files: DataFrame, reach: int = 3, path: str = "path", text: str = "text") -> DataFrame:
    """Stub lines with the nearest comment on the same or an earlier line within `reach` lines, else their own line."""
    found = extract(files, path, text).select("path", "line_number", F.lit(True).alias("is_comment"))
    rows = lines(files, path, text).select("path", "line_number", F.col("line").rlike(STUB).alias("is_stub")).join(found, ["path", "line_number"], "left")
    w = Window.partitionBy("path").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    near = F.last(F.when(F.col("is_comment"), F.col("line_number")), ignorenulls=True).over(w)
    stubs = rows.withColumn("near", near).where("is_stub")
    return stubs.select("path", "line_number", F.when(F.col("line_number") - F.col("near") <= reach, F.col("near")).otherwise(F.col("line_number")).alias("at_line"))


def summary(comments: DataFrame, least: float = 0.6) -> DataFrame:
    """Marked comments by extension and confidence band."""
    c = comments.withColumn("confidence", confidence(F.col("comment"), F.col("path"))).where(F.col("confidence") >= least)
    band = F.when(F.col("confidence") >= 0.9, "high").when(F.col("confidence") >= 0.6, "medium").otherwise("low")
    return c.groupBy(F.regexp_extract("path", r"\.(\w+)$", 1).alias("extension"), band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def dependencies(text: Column) -> Column:
    """Names of a `DEPENDENCIES:` section, required and optional, and whether the text says that it blocks others."""
    section = F.regexp_extract(text, r"(?is)DEPENDENCIES:\s*\n(.*?)(?:\n\s*\n|$)", 1)
    items = F.filter(F.transform(F.split(section, "\n"), lambda x: X.strip(F.regexp_replace(x, r"^\s*[-*]\s*", ""))), lambda x: x != "")
    optional = lambda x: F.lower(x).contains("(optional)") | F.lower(x).startswith("optional:")
    clean = lambda xs: F.transform(xs, lambda x: X.strip(F.regexp_replace(x, r"(?i)\((required|optional)\)|^(required|optional):", "")))
    return F.struct(clean(F.filter(items, lambda x: ~optional(x))).alias("required"), clean(F.filter(items, optional)).alias("optional"), text.rlike(r"(?i)BLOCKING:\s*(yes|true)|PRIORITY:\s*(high|critical)").alias("blocking"))
