"""Reports, validators, spans and generators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from granary.functions import spans as P
from granary.operators import reports as R
from granary.operators import validators as V
from granary.sources import generators as N


def test_distribution_and_balance(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("a", 1)], "x string, y int")
    got = {(r["key"], r["value"]): (r["n"], r["share"]) for r in R.distribution(df, ["x", "y"]).collect()}
    assert got == {("x", "a"): (3, 0.75), ("x", "b"): (1, 0.25), ("y", "1"): (3, 0.75), ("y", "2"): (1, 0.25)}
    assert R.balance(df, "x").first().asDict() == {"imbalance": 50.0, "warn": False}
    pairs = spark.createDataFrame([(["p", "q"], ["p"])], "a array<string>, b array<string>")
    assert {r["clause"]: r["share"] for r in R.clause_share(pairs, "a", "b").collect()} == {"p": 1.0, "q": 0.5}
    bands = spark.createDataFrame([(0,), (199,), (200,), (1999,), (2000,)], "t int").select(R.length_histogram(F.col("t")).alias("b"))
    assert [r["b"] for r in bands.collect()] == ["<200", "<200", "<400", "<2000", ">=2000"]


def test_summary_gates_and_comparison(spark):
    rows = [(True, 1.0, 1.0, 1.0, True, True, False), (True, 0.5, 0.5, 0.5, True, False, False), (False, 0.0, 0.0, 0.0, True, True, True)]
    s = R.summarize(spark.createDataFrame(rows, "eligible boolean, f1 double, precision double, recall double, privacy_ok boolean, args_ok boolean, control_hit boolean"))
    r = s.first()
    assert (r["total"], r["n_eligible"], r["macro_f1"], r["micro_f1"], r["controls_hit"]) == (3, 2, 0.75, 0.75, 1)
    g = {x["gate"]: x["passed"] for x in R.gates(s, {"macro_f1": 0.7, "args_rate": 0.98}, {"controls_hit": 0}).collect()}
    assert g == {"macro_f1": True, "args_rate": False, "controls_hit": False}
    old, new = spark.createDataFrame([(1.0, 5.0, 2.0)], "a double, b double, c double"), spark.createDataFrame([(1.005, 4.0, 9.0)], "a double, b double, d double")
    got = {x["metric"]: x["status"] for x in R.compare_reports(old, new, higher_is_better=("b",)).collect()}
    assert got == {"a": "same", "b": "worse", "c": "removed", "d": "added"}


def test_profiles_budgets_rates(spark, tmp_path):
    m = spark.createDataFrame([("M1 Max", 64), ("M1", 8), ("other", 9)], "chip string, memory_gb int")
    assert [r["profile"] for r in R.match_profile(m, [("max", "Max", 32), ("base", "^M", 8)]).collect()] == ["max", "base", "default"]
    specs, waivers = spark.createDataFrame([("a", 1), ("b", 9)], "id string, tier int"), spark.createDataFrame([("a", True, 2, 10), ("a", False, 9, 9), ("a", True, 1, 1)], "id string, active boolean, files int, loc int")
    assert {r["id"]: (r["max_files"], r["max_loc"]) for r in R.budgets(specs, {1: (10, 100)}, waivers).collect()} == {"a": (13, 111), "b": (25, 1000)}
    models = spark.createDataFrame([(1, 0.5), (2, 0.75)], "n int, score double")
    assert sorted(r["score_delta"] for r in R.with_baseline(models, "n", ["score"]).collect()) == [0.0, 0.25]
    log = spark.createDataFrame([("hit",), ("miss",), ("version",), ("hit",)], "status string")
    assert R.hit_rates(log).first()["hit_rate"] == pytest.approx(2 / 3)
    assert R.markdown(models, "Models").startswith("# Models\n\n| n | score |")
    assert spark.range(1).select(R.readiness(F.lit(1.0), F.lit(0.5), F.lit(1.0), F.lit(0.0))).first()[0] == 70.0
    assert spark.range(1).select(R.cost(F.lit(1_000_000), F.lit(0), F.lit(True))).first()[0] == pytest.approx(0.15)
    for i, name in enumerate(("t_seed1_a.json", "t_seed1_b.json", "t_seed2_a.json")):
        (tmp_path / name).write_text('{"v": %d}' % i)
    assert "seed1" in R.find_baseline(spark, str(tmp_path), "t", 1).first()["path"]
    assert R.read_reports(spark, str(tmp_path)).count() == 3
    values = R.dispersion(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "v double").withColumn("g", F.lit("x")), ["g"], "v").first()
    assert (values["p25"], values["median"], values["p75"]) == (1.5, 2.0, 2.5)


def test_validators(spark):
    w = spark.createDataFrame([("p", "a", "plain", 1, [1]), ("", None, "odd", 5, [-1]), ("p", "a", "tool_use", 0, [])], "prompt string, answer string, task_type string, level int, token_ids array<int>")
    errors = w.select(V.worker_errors(w).alias("e"))
    assert [r["e"] for r in errors.collect()] == [[], ["empty:prompt", "empty:answer", "enum:task_type", "range:level", "vocabulary:token_ids"], ["supervision:token_ids"]]
    assert {r["error"]: r["n"] for r in V.histogram(errors, "e").collect()} == {"empty": 2, "enum": 1, "range": 1, "vocabulary": 1, "supervision": 1}
    s = "struct<E:double,B:double,G:double,P:double,total:double>"
    j = spark.createDataFrame([("a", "verdict", (1.0, 1.0, 1.0, 1.0, 1.0), (1.0, 0.0, 0.0, 0.0, 0.5))], f"winner string, stage string, a {s}, b {s}")
    assert j.select(V.judge_errors(j)).first()[0] == ["total:b"]
    raw = spark.createDataFrame([('{"a":null,"b":1}',)], "r string")
    assert raw.select(V.presence_errors(F.col("r"), ("a", "b", "c"))).first()[0] == ["null:a", "missing:c"]
    paths = spark.createDataFrame([(["src/a.py"], ["src/*"], ["src/x*"]), (["src/x.py"], ["src/*"], ["src/x*"]), (["lib/a"], [], [])], "p array<string>, i array<string>, o array<string>")
    assert [r[0] for r in paths.select(V.in_scope(F.col("p"), F.col("i"), F.col("o"))).collect()] == [True, False, True]
    assert spark.range(1).select(V.verdict(F.lit(False), F.lit(True), F.lit(True), F.lit(True))).first()[0] == "WAIVER_REQUIRED"
    assert spark.createDataFrame([("5",), ("x",), ("50",)], "v string").select(V.clean_number(F.col("v"), 0, 10).alias("v")).collect()[0]["v"] == 5.0


def test_identical_sides_are_replaced(spark):
    rows = spark.createDataFrame([(1, "same text here", "same text here"), (2, "one", "two")], "id long, a string, b string")
    pool = spark.createDataFrame([("other text now",)], "text string")
    got = {r["id"]: (r["b"], r["replaced"]) for r in V.replace_identical(rows, "id", "a", "b", pool).collect()}
    assert got == {1: ("other text now", True), 2: ("two", False)}


def test_spans(spark):
    t = 'x {"a": {"b": "}"}} y {broken} {"c": 1}'
    df = spark.createDataFrame([(t, ["o", "c", "o", "o", "c", "o"], [(0, 5), (5, 8), (10, 12)])], "t string, k array<string>, s array<struct<start:int,end:int>>")
    r = df.select(P.json_spans(F.col("t")).alias("j"), P.match_spans(F.col("t"), "[ab]").alias("m"), P.marked_spans(F.col("k"), "o", "c").alias("k2"), P.merge(F.col("s")).alias("s2")).first()
    assert [t[a:b] for a, b in r["j"]] == ['{"a": {"b": "}"}}', '{"c": 1}']
    assert [tuple(x) for x in r["m"]][:2] == [(4, 5), (10, 11)]
    assert [tuple(x) for x in r["k2"]["spans"]] == [(0, 2), (3, 5)] and r["k2"]["unclosed"]
    assert [tuple(x) for x in r["s2"]] == [(0, 8), (10, 12)]
    assert spark.createDataFrame([("é\r\nx\r",), (None,)], "t string").select(P.normal_form(F.col("t")).alias("n")).collect()[0]["n"] == "é\nx\n"


def test_generators(spark):
    c = N.cells(spark, 60)
    rows = c.collect()
    assert len(rows) == 60 and len({r["cell"] for r in rows}) == 60 and {r["structure"] for r in rows} == set(N.STRUCTURES)
    assert sum(r["control"] for r in rows) == 6 and {(s, k) for s, v in N.GRID.items() for k, n in zip(N.COMPLEXITY, v) if n} <= {(r["scenario"], r["complexity"]) for r in rows}
    for r in N.prompts(c).collect():
        if not r["control"]:
            assert r["answer"][r["integration_span"]["start"] : r["integration_span"]["end"]].endswith("items")
    assert len({r["sample_id"] for r in N.prompts(c).collect()}) == 60
    assert N.judged_pairs(spark, 9).where("winner = 'tie'").count() == 3 and N.toy_rows(spark, 4).count() == 4
    assert spark.range(1).select(F.length(N.long_context(F.lit("abc")))).first()[0] >= 24_000
