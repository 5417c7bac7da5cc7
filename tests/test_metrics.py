"""Metrics, claim verification and scans against plain expectations."""

from __future__ import annotations

import json
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from granary.functions import judging as G
from granary.operators import metrics as M
from granary.operators import verification as W
from granary.sources import stages as T


def test_preferences_and_clauses(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 0), (0, 0), (-1, -1), (-1, 0), (1, -1)], "s int, w int")
    got = {t: M.preference_accuracy(df, F.col("s"), F.col("w"), t).first() for t in ("exclude", "penalize", "count_as_correct")}
    assert {t: (r["accuracy"], r["n"]) for t, r in got.items()} == {"exclude": (0.6, 5), "penalize": (3 / 8, 8), "count_as_correct": (0.5, 8)}
    assert got["exclude"]["precision_macro"] == pytest.approx((2 / 3 + 1 / 2) / 2)
    with pytest.raises(ValueError):
        M.preference_accuracy(df, F.col("s"), F.col("w"), "odd")
    c = spark.createDataFrame([(["a", "a", "b"], ["a"]), (["b"], ["b", "c"]), (None, ["a"])], "p array<string>, q array<string>")
    rows = {r["clause"]: (r["tp"], r["fp"], r["fn"], r["support"]) for r in M.clause_scores(c, F.col("p"), F.col("q")).collect()}
    assert rows == {"a": (1, 0, 1, 2), "b": (1, 1, 0, 1), "c": (0, 0, 1, 1), None: (2, 1, 2, 4)}


def test_claim_scores(spark):
    found = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, "x")], "id int, statement string")
    gold = spark.createDataFrame([(1, "x"), (9, "w"), (2, "y")], "id int, statement string")
    results = spark.createDataFrame([(1, "VERIFIED"), (2, "UNVERIFIED"), (3, "VERIFIED")], "claim_id int, status string")
    r = M.claim_scores(found, gold, results).first()
    assert (r["extraction_precision"], r["extraction_recall"]) == (pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert (r["verification_precision"], r["verification_recall"], r["coverage"]) == (0.5, pytest.approx(1 / 3), pytest.approx(1 / 3))
    empty = M.claim_scores(found.limit(0), gold.limit(0), results.limit(0)).first()
    assert set(empty.asDict().values()) == {0.0}


def test_curve_and_area(spark):
    rng = random.Random(3)
    rows = [(round(rng.random(), 2), rng.random() < 0.4) for _ in range(400)] + [(1.0, True), (0.0, False)]
    c = M.roc_curve(spark.createDataFrame(rows, "s double, p boolean"), F.col("s"), F.col("p"), parts=16)
    pos, neg = [s for s, p in rows if p], [s for s, p in rows if not p]
    got = {r["threshold"]: (r["fpr"], r["tpr"]) for r in c.collect()}
    assert set(got) == {s for s, _ in rows}
    for t, (x, y) in got.items():
        assert (x, y) == (pytest.approx(sum(s >= t for s in neg) / len(neg)), pytest.approx(sum(s >= t for s in pos) / len(pos)))
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert M.curve_area(c).first()[0] == pytest.approx(want)
    one = M.roc_curve(spark.createDataFrame([(0.5, True)], "s double, p boolean"), F.col("s"), F.col("p"))
    assert M.curve_area(one).first()[0] is None


def test_best_calibration_equals_all_points(spark):
    rows = [("the red fox runs", "fox runs red", "support"), ("a fox never runs", "fox runs", "contradict"), ("blue sky", "green grass", "insufficient"), ("one two three", "two three", "support"), ("x", "", "insufficient")]
    df = spark.createDataFrame(rows, "e string, c string, l string")
    ts, bs = (0.5, 1.0), (-0.4, 0.0, 0.4)
    best = M.best_calibration(df, F.col("e"), F.col("c"), F.col("l"), ts, bs).first()
    share = {n: sum(r[2] == n for r in rows) / len(rows) for n in ("support", "contradict", "insufficient")}
    results = []
    for t in ts:
        for a in bs:
            for b in bs:
                for d in bs:
                    p = df.select(G.triage(F.col("e"), F.col("c"), t, (a, b, d), tuple(share.values())).alias("t"), "l") if t == best["temperature"] and (a, b, d) == (best["support"], best["contradict"], best["insufficient"]) else None
                    if p is not None:
                        results = [-math.log(r["t"][r["l"]]) for r in p.collect()]
    assert best["mean_nll"] == pytest.approx(sum(results) / 5) and best["p50_nll"] == pytest.approx(statistics.median(results)) and best["p95_nll"] == pytest.approx(sorted(results)[3])
    grids = [M.best_calibration(df, F.col("e"), F.col("c"), F.col("l"), (t,), (b,)).first()["mean_nll"] for t in ts for b in bs]
    assert best["mean_nll"] <= min(grids) + 1e-12


def test_gates(spark):
    r = spark.createDataFrame([(100, False, True, True), (50, True, False, True), (None, False, False, False)], "tokens_total int, leak boolean, used_code boolean, eligible boolean")
    g = M.code_gates(r, 200.0).first()
    assert (g["tokens"], g["leaks"], g["gain"], g["rate"], g["tokens_gate"], g["leak_gate"], g["use_gate"], g["passed"]) == (150, 1, 0.25, 0.5, True, False, False, False)
    assert M.code_gates(r.limit(0), None).first()["passed"]
    s = "struct<ttft_p50:double,ttft_p95:double,tps_p50:double,tps_p95:double,ttfa_p95:double,share:double>"
    base = (100.0, 0.0, 50.0, 50.0, 20.0, 0.95)
    runs = spark.createDataFrame([((105.0, 9.0, 47.6, 47.0, 26.0, 0.81), base, True), ((999.0, 0.0, 0.0, 0.0, None, 0.1), base, False), (base, None, True), ((1.0, 1.0, 60.0, 60.0, None, None), base, True)], f"n {s}, b {s}, h boolean")
    got = [x["e"] for x in runs.select(M.speed_errors(F.col("n"), F.col("b"), F.col("h")).alias("e")).collect()]
    assert got == [["tps_p95", "ttfa_p95", "share_drop"], [], [], ["ttfa_p95"]]


def test_baseline_file(spark, tmp_path):
    s = M.run_summary(spark.createDataFrame([(0.5, 10, 2.0, 1), (1.0, 30, 4.0, 3)], "a double, t int, m double, l int"), "a", "t", "m", "l")
    M.save_baseline(s, str(tmp_path / "b"), "r1", 7, "task")
    r = spark.read.json(str(tmp_path / "b")).first()
    assert (r["run_id"], r["seed"], r["metrics"]["mean_accuracy"], r["metrics"]["std_tokens"], r["metrics"]["mean_loops"]) == ("r1", 7, 0.75, 10.0, 2.0)


def test_verification(spark):
    c = spark.createDataFrame([(1, "The fox is red", "The fox is red", []), (2, "The best fox", "The best fox", []), (3, "zebra quagga", "zebra quagga", []), (4, "The fox is blue", "The fox is blue", []), (5, "It has 45 ms", "It has 45 ms", ["bench_json"]), (6, "It has 45 ms", "It has 45 ms", [])],
                              "claim_id int, claim string, full string, kinds array<string>")
    e = spark.createDataFrame([(1, "Indeed the fox is red today"), (2, "a fox is not blue, the fox"), (3, "It has 45 ms")], "evidence_id int, evidence string")
    got = {r["claim_id"]: r for r in W.verify(c, e, {"QUANT": ("bench_json", "eval_report")}).collect()}
    assert (got[1]["status"], got[1]["outcome"], got[1]["coverage"]) == ("VERIFIED", 1, 1.0)
    assert (got[2]["outcome"], got[2]["violations"], got[2]["status"]) == (6, ["superlative_terms"], "INSUFFICIENT_EVIDENCE")
    assert (got[3]["outcome"], got[3]["insufficient"]) == (7, 1.0)
    assert got[5]["status"] == "VERIFIED" and got[6]["violations"] == ["artifact:type:bench_json", "artifact:type:eval_report"]
    assert W.verify(spark.createDataFrame([(1, "fox red", "fox red", [])], c.schema), e).first()["coverage"] == 0.5
    assert all(r["support"] + r["contradict"] + r["insufficient"] == pytest.approx(1) for r in got.values())


def test_scans(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"__header__":{"v":1}}\n\n{"prompt":"p","teacher_text":"t"}\n{odd\n{"prompt":" ","teacher_text":"t"}\n')
    assert [(r["line"], r["value"]) for r in T.numbered_lines(spark, str(f)).orderBy("line").collect()][1:3] == [(2, ""), (3, '{"prompt":"p","teacher_text":"t"}')]
    assert [r["line"] for r in T.broken_lines(spark, str(f)).collect()] == [4]
    assert T.read_some(spark, str(f)).count() == 2 and T.read_some(spark, str(f), 1).count() == 1
    with pytest.raises(Exception, match="not JSON"):
        T.read_every_line(spark, str(f), "prompt string").collect()
    rows = spark.createDataFrame([("p", "t", None), (" ", "t", "secret"), ("q", "\n", None)], "prompt string, teacher_text string, teacher_reasoning_content string")
    assert [tuple(r) for r in T.training_rows(rows).collect()] == [("p", "t")]
    with pytest.raises(Exception, match="teacher_reasoning_content"):
        T.training_rows(rows.fillna("why")).select("teacher_text").collect()
    s = tmp_path / "s.jsonl"
    s.write_text(json.dumps({"input": {"system": "s", "tools": ["f"], "history": [{"role": "user", "content": "c"}]}, "target": "t"}) + "\n\n{odd\n")
    assert [(r["target"], r["input"]["history"][0]["content"]) for r in T.read_stage(spark, str(s), False).collect()] == [("t", "c")]
    with pytest.raises(Exception):
        T.read_stage(spark, str(s), True).collect()
    o = tmp_path / "o.jsonl"
    o.write_text('{"id":1,"role":"worker"}\n{"id":2,"role":"judge"}\n')
    assert [r["id"] for r in T.read_scenarios(spark, str(o), "id int, role string", "judge").collect()] == [2]
    ev = spark.createDataFrame([("/x/a.raw", 2, "end"), ("/x/a.raw", 1, "start"), ("/x/b.raw", 1, "start")], "f string, at int, k string")
    meta = spark.createDataFrame([("/x/a.meta.json", "m1")], "f string, model string")
    t = {r["trace"]: r for r in T.traces(ev, meta, "f", "at", F.col("k"), F.lit("{}")).collect()}
    assert [e["type"] for e in t["/x/a"]["events"]] == ["start", "end"] and t["/x/a"]["meta"]["model"] == "m1" and t["/x/b"]["meta"] is None
