"""Dataset rows and order statistics against plain expectations."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import quantiles as Q
from granary.operators import samples as S


def test_order_statistics_with_hot_values_and_groups(spark):
    rng = random.Random(5)
    rows = [("hot", 7.0)] * 800 + [("hot", rng.gauss(0, 9)) for _ in range(900)] + [("one", 3.5), (None, 1.0), (None, 2.0), ("none", None)] + [("few", float(rng.randrange(4))) for _ in range(50)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r for r in Q.order_statistics(df, ["g"], F.col("v"), {"least": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "top": lambda n: n - 1, "past": lambda n: n}, parts=8).collect()}
    lin = {r["g"]: r for r in Q.interpolated(df, ["g"], F.col("v"), {"a": 0.37, "b": 0.9}).collect()}
    assert set(got) == {"hot", "one", "few", None}
    for g in got:
        v = sorted(x for k, x in rows if k == g)
        assert (got[g]["n"], got[g]["least"], got[g]["mid"], got[g]["top"], got[g]["past"]) == (len(v), v[0], v[len(v) // 2], v[-1], None)
        assert (lin[g]["a"], lin[g]["b"]) == (pytest.approx(np.quantile(v, 0.37)), pytest.approx(np.quantile(v, 0.9)))
    assert Q.order_statistics(df.limit(0), ["g"], F.col("v"), {"mid": lambda n: n}).count() == 0


def test_issues(spark):
    w = spark.createDataFrame([("Write a short list of words.", "x" * 30, "s", "plain_kd", 0, False, False), ("  ", None, "s", "odd", 2, True, False), ("Do it. " * 4, "", "synthetic", "tool_use", 1, False, True)],
                              "p string, a string, s string, t string, l int, c boolean, e boolean")
    c = F.col
    got = [r["i"] for r in w.select(S.worker_issues(c("p"), c("a"), c("s"), c("t"), c("l"), c("c"), c("e")).alias("i")).collect()]
    assert got == [[], ["Very short prompt", "Empty prompt", "Prompt lacks clear structure", "Missing teacher_text", "caws_level=2 but missing evidence/provenance", "Invalid task_type: odd"], ["caws_level=1 but missing CAWS context"]]
    j = spark.createDataFrame([("p" * 20, "a" * 10, "a" * 10, ["GATE_INTEGRITY", "ODD"], None, "c"), ("p" * 20, "a" * 10, "b" * 10, [], ["GATE_INTEGRITY"], "tie")], "p string, a string, b string, x array<string>, y array<string>, w string")
    got = [r["i"] for r in j.select(S.judge_issues(*map(c, j.columns)).alias("i")).collect()]
    assert got == [["Invalid clauses: ['ODD']", "Invalid winner: c", "a.text and b.text are identical"], []]
    d = spark.createDataFrame([("p" * 20, "x" * 2001, 5), ("p", "", None), ("p" * 20, "x" * 60, 400)], "p string, a string, b int")
    got = d.select(S.drafter_issues(*map(c, d.columns)).alias("i")).withColumn("s", S.issue_score(c("i"))).collect()
    assert [(r["i"], r["s"]) for r in got] == [(["Too long for Drafter: 2001 chars", "Invalid length bucket: 5"], 6), (["Very short prompt", "Empty teacher_text", "Invalid length bucket: None"], 4), ([], 10)]


def test_ids_and_traces(spark):
    raw = spark.createDataFrame([('{"working_spec":{"id":"a"},"caws_context":{"working_spec":{"id":"b"}},"provenance":{"hash":"h"}}',), ('{"working_spec":3,"caws_context":{"working_spec":{"id":"b"}}}',), ("{}",), (None,)], "r string")
    assert [(r[0], r[1]) for r in raw.select(S.working_id(F.col("r")), S.provenance_hash(F.col("r"))).collect()] == [("a", "h"), ("b", None), (None, None), (None, None)]
    a, b = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "id string"), spark.createDataFrame([("y",), ("z",)], "id string")
    assert tuple(S.linkage(a, b, "id").first()) == (2, 2, 1, 1, 1)
    t = spark.createDataFrame([([("f", '{"q":1}', '{"k":1,"z":"u"}'), (None, None, "[1]"), ("g", None, '{"k":2}')],), ([],)], "t array<struct<name:string,arguments:string,result:string>>")
    got = t.select(S.trace_calls(F.col("t")).alias("c"), S.result_fields(F.col("t")).alias("f")).collect()
    assert [tuple(c) for c in got[0]["c"]] == [("f", '{"q":1}'), ("", "{}"), ("g", "{}")]
    assert got[0]["f"] == {"k": "2", "z": "u"} and got[1]["f"] == {} and got[1]["c"] == []
    s = spark.createDataFrame([("The Summary of data. Then output", [(0, 20), (20, 32)])], "t string, s array<struct<start:int,end:int>>")
    assert s.select(S.integrated_fields(F.col("t"), F.col("s"))).first()[0] == ["summary", "data", "output"]


def test_presence_vectors_and_scenarios(spark):
    p = spark.createDataFrame([("x tool.call{", "tool.call{"), ("tool.call{", "words"), ("tool.call{", "<a> <b>"), ("no", "ok"), ("no", None)], "t string, s string")
    r = S.presence_f1(p, F.col("t"), F.col("s")).first()
    assert (r["tp"], r["fp"], r["fn"]) == (1.5, 1.0, 1.5) and r["f1"] == pytest.approx(2 * 0.6 * 0.5 / 1.1)
    v = spark.createDataFrame([([float("nan"), 1.0],), ([0.0, 1e-13],), ([],)], "v array<double>")
    assert [tuple(x["b"]) for x in v.select(S.broken_vector(F.col("v")).alias("b")).collect()] == [(True, False), (False, True), (False, True)]
    call = '<bot>{"name":"f"}</bot>'
    o = spark.createDataFrame([(call, None, False), (call.replace("f", "g"), None, False), (call * 11, None, False), ("{x}", "judge_model", False), ("", "functional_test", True), ("", "functional_test", False), ("", "other", False)], "o string, k string, s boolean")
    got = [x["r"] for x in o.select(S.scenario_result(F.col("o"), F.col("k"), F.array(F.lit("f")), F.col("s"), F.lit(None).cast("int")).alias("r")).collect()]
    assert [x["result"] for x in got] == ["inconclusive", "fail", "fail", "fail", "fail", "inconclusive", "fail"]
    assert got[1]["errors"] == ["Unexpected tool: g"] and got[4]["errors"] == ["Functional test not implemented"] and got[0]["score"] == 0.5
