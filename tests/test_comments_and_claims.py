"""Comments of source texts, and claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import claims as C
from granary.operators import comments as O


def test_comments(spark):
    files = spark.createDataFrame([("a.py", "# TODO: write the parser now\nx = 1  # no\ndef f():\n    # not implemented in this version\n\n    pass\n\n\n\n\npass"), ("b.js", "// placeholder until the service is there\n/* one\n * two FIXME\n */\nlet x"), ("dist/c.js", "// hardcoded x")], "path string, text string")
    rows = {(r["path"], r["line_number"]): r["comment"] for r in O.extract(files).collect()}
    assert rows == {("a.py", 1): "TODO: write the parser now", ("a.py", 4): "not implemented in this version", ("b.js", 1): "placeholder until the service is there", ("b.js", 2): "one", ("b.js", 3): "two FIXME", ("dist/c.js", 1): "hardcoded x"}
    assert sorted((r["line_number"], r["at_line"]) for r in O.attach_stubs(files).collect()) == [(6, 4), (11, 11)]
    got = {(r["extension"], r["band"]): r["n"] for r in O.summary(O.extract(files)).collect()}
    assert got == {("py", "high"): 2, ("js", "high"): 2}


def test_dependencies(spark):
    t = "TODO x\nDEPENDENCIES:\n- parser (Required)\n- cache (optional)\n\nBLOCKING: Yes"
    r = spark.createDataFrame([(t,)], "t string").select(O.dependencies(F.col("t")).alias("d")).first()["d"]
    assert (r["required"], r["optional"], r["blocking"]) == (["parser"], ["cache"], True)


def test_claims(spark):
    df = spark.createDataFrame([("I think the build took 12 minutes in May 3, 2024.",), ("it could be nice",), ("The server returns 5 items.",)], "t string")
    rows = df.select(C.verifiability(F.col("t")).alias("v"), C.without_opinion(F.col("t")).alias("w"), C.elements(F.col("t")).alias("e")).collect()
    assert rows[0]["v"] == 0.5 and rows[1]["v"] == 0.0 and rows[2]["v"] > 0.3
    assert rows[0]["w"] == "the build took 12 minutes in May 3, 2024." and rows[2]["w"] is None
    assert rows[2]["e"].asDict() == {"subject": "The server", "predicate": "returns", "object": "5 items.", "quantity": "5 items", "negation": False}
    cover = lambda e: df.where("t like 'The server%'").select(C.coverage(F.lit(e), C.elements(F.col("t")))).first()[0]
    assert cover("The server returns 5 items. Always.") == 1.0 and cover("nothing of it") == 0.0 and cover("the server never returns 5 items.") == 0.75
    a = df.select(C.ambiguities(F.col("t"), F.array().cast("array<string>")).alias("a")).collect()
    assert [x["kind"] for x in a[1]["a"]] == ["referential"] and a[1]["a"][0]["confidence"] == 0.2
    assert spark.range(1).select(C.with_hints(F.lit("x"), F.array(F.lit("b"), F.lit("a"), F.lit("b")))).first()[0] == "x [a; b]"
