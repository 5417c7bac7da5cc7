"""Golden rows of nested records, sources and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from granary.functions import judging as G
from granary.functions import text as X
from granary.operators import datasets as D
from granary.operators import ordered as O
from granary.operators import records as R
from granary.operators import tools as T
from granary.operators.filters import cascade_reasons
from granary.sources import ndjson as N
from granary.streaming import windows as S

SIDE = "struct<text:string,clauses:array<string>,change_diff:string,rationale:string,evidence_manifest:struct<claims:array<string>,verification_status:string,evidence_references:array<string>>,provenance_chain:struct<steps:array<string>,audit_trail:string>>"


def one(spark, value, expression, ddl="x string"):
    return spark.createDataFrame([(value,)], ddl).select(expression.alias("r")).first()["r"]


@pytest.mark.parametrize("text,cut", [("a b c", True), ("done.", False), ("wait...", True), ("**bold**", True), ("x" * 60, False), ("", False), (None, False), ("one two…", True)])
def test_truncation(spark, text, cut):
    assert one(spark, text, X.is_truncated(F.col("x"))) is cut


def test_cascade_counts_the_first_reason(spark):
    rows = [(1, ""), (2, ""), (3, "short."), (4, "A longer text."), (5, "A longer text."), (6, None), (7, "open end of text")]
    got = cascade_reasons(spark.createDataFrame(rows, "doc_id long, text string"), min_length=8, remove_truncated=True, dedupe=True)
    assert [r["reason"] for r in got.orderBy("doc_id").collect()] == ["empty", "empty", "min_length", "passed", "duplicate", "empty", "truncated"]


@pytest.mark.parametrize("tokens,bucket", [(0, 200), (200, 200), (201, 400), (400, 400), (401, 800), (5000, 800)])
def test_buckets(spark, tokens, bucket):
    assert one(spark, tokens, X.length_bucket(F.col("x")), "x int") == bucket


@pytest.mark.parametrize("args,errors", [("{}", ["missing:q"]), ('{"q":"a","top_k":11}', ["max:top_k"]), ('{"q":"a","site":"x"}', ["enum:site"]), ('{"q":"a","more":1}', []), ('{"q":1}', ["type:q"]), ('{"q":"a","top_k":true}', [])])
def test_arguments(spark, args, errors):
    assert one(spark, args, T.argument_errors(F.col("x"), *T.REGISTRY["web.search"])) == errors


def test_lookup_normalises(spark):
    fixtures = spark.createDataFrame([("web.search", '{"q":"what is rope","top_k":3}', "r1")], "name string, key string, result string")
    calls = spark.createDataFrame([("web_search", '{"top_k":3,"q":"  What   IS rope ","z":null}'), ("web.search", '{"q":"what is rope","top_k":4}')], "name string, args string")
    got = [(r["hit"], r["result"]) for r in T.lookup(calls, fixtures).orderBy("name").collect()]
    assert sorted(got) == [(False, "fixture_miss"), (True, "r1")]


def test_key_match(spark):
    registry = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x", "z"]), ("c", ["p", "q", "r", "s", "t"])], "tool string, properties array<string>")
    rows = spark.createDataFrame([(["x", "y"],), (["x"],), (["y"],), (["p"],), ([],), (["nope"],)], "keys array<string>")
    got = {tuple(r["keys"]): r["match"] for r in T.match_by_keys(rows, "keys", registry).collect()}
    assert got == {("x", "y"): "exact", ("x",): "ambiguous", ("y",): "partial", ("p",): "none", (): "none", ("nope",): "none"}


@pytest.mark.parametrize("a,b,same", [(1.0, 1.0000005, True), (0.0, 2e-6, False)])
def test_close(spark, a, b, same):
    assert spark.range(1).select(D.close(F.lit(a), F.lit(b)).alias("r")).first()["r"] is same


@pytest.fixture(scope="module")
def pairs(spark):
    side = lambda text, clauses, diff=None, claims=None, steps=None: (text, clauses, diff, "why" if diff else None, (claims, "verified", ["r"]) if claims else None, (steps, "git log") if steps else None)
    rows = [(i, "rate", side("tests fail", ["BUDGET_ADHERENCE", "X"], "30 files", ["all tests pass"], ["1", "2", "3"]), side("ok", ["X", "GATE_INTEGRITY"]), "a", "Solution A beats solution B") for i in range(20)]
    rows += [(90, "p", side("t", []), side("u", []), "b", "r"), (91, "Publish it", side("t", []), side("u", []), "odd", "r")]
    return spark.createDataFrame(rows, f"id long, prompt string, a {SIDE}, b {SIDE}, winner string, reasons string")


def test_pairs(spark, pairs):
    r = R.swap_sides(pairs).where("id = 0").first()
    assert (r["winner"], r["reasons"], r["a"]["text"]) == ("b", "Solution B beats solution A", "ok")
    t = R.as_tie(pairs).where("id = 0").first()
    assert t["winner"] == "tie" and t["reasons"].startswith("Both sides meet: X.")
    n = {r["winner"]: r["count"] for r in R.balance_winners(pairs, "id").groupBy("winner").count().collect()}
    assert n == {"a": 10, "b": 8, "tie": 3}


def test_side_scores(spark, pairs):
    r = pairs.where("id = 0").select(R.side_scores(F.col("a"), F.lit(25), F.lit(1000)).alias("left"), R.side_scores(F.col("b"), F.lit(25), F.lit(1000)).alias("right"), R.stage(F.col("prompt"), F.col("a"), F.col("b"), F.lit(True)).alias("s")).first()
    assert r["left"].asDict() == {"E": 0.9, "B": 0.4, "G": 0.3, "P": 0.9, "total": 0.63}
    assert r["right"].asDict() == {"E": 0.0, "B": 1.0, "G": 1.0, "P": 0.0, "total": 0.5}
    assert r["s"] == "pleading"
    assert pairs.where("id = 91").select(R.stage(F.col("prompt"), F.col("a"), F.col("b"), F.lit(False))).first()[0] == "publication"


def test_grounding(spark):
    df = spark.createDataFrame([("Integration: found 12 files in total. Then\nIntegration: nothing here. ", {"count": "12", "z": ""})], "t string, f map<string,string>")
    r = df.select(R.span_texts(F.col("t")).alias("s"), R.grounding_f1(R.span_texts(F.col("t")), F.col("f")).alias("i"), R.verify(F.lit('{"header":{"tier":1,"max_files":1,"max_loc":1,"cov":1,"mut":1}}\nx'), F.col("t"), F.col("f"), F.lit(False)).alias("v"), R.verify(F.lit("x"), F.col("t"), F.col("f"), F.lit(True)).alias("c")).first()
    assert r["s"] == ["found 12 files in total", "nothing here"]
    assert [round(x, 4) for x in r["i"]] == [0.5, 1.0, 0.6667]
    assert r["v"]["ok"] and r["v"]["problems"] == []
    assert not r["c"]["ok"] and r["c"]["problems"] == ["control_has_integration", "header"]
    assert not one(spark, "number 123", R.is_grounded(F.col("x"), F.create_map(F.lit("a"), F.lit("12"))))
    assert one(spark, "they favor it", R.is_grounded(F.col("x"), F.create_map(F.lit("a"), F.lit("prefer"))))


def test_run_scores(spark):
    calls = [("web.search", '{"q": 1}', "twelve files were found there")]
    df = spark.createDataFrame([("p", "Integration: found 12 files. Then twelve files were found there", calls, {"n": "12"}, ["web.search"])], "p string, o string, c array<struct<name:string,arguments:string,result:string>>, f map<string,string>, w array<string>")
    r = df.select(R.score(F.col("p"), F.col("o"), F.col("c"), F.col("f"), F.col("w"), F.lit(False)).alias("s")).first()["s"]
    assert r["eligible"] and r["calls_match"] and r["args_ok"] and r["leak"] and r["privacy_ok"] and r["used_tools"]
    assert (r["integration"]["f1"], r["n_spans"], r["over_cap"], r["control_hit"]) == (1.0, 1, False, False)


def test_diff(spark):
    diff = "--- a/x.py\t1\n+++ b/x.py\n@@ -1,1 +1,6 @@\n+a\n+b\n+c\n+d\n+e\n+f\n@@ -9,2 +14,2 @@\n-u\n+v\n w"
    rows = spark.createDataFrame([(1, diff), (2, ""), (3, None)], "k int, d string")
    got = {r["k"]: (r["added"], r["removed"], r["files"]) for r in R.diff_stats(rows, "k", "d").collect()}
    assert got == {1: (7, 3, 1), 2: (0, 0, 1), 3: (0, 0, 1)}


def test_outcomes(spark):
    t = lambda s, c, i: F.struct(F.lit(s).alias("support"), F.lit(c).alias("contradict"), F.lit(i).alias("insufficient"))
    yes, no, none = t(0.8, 0.1, 0.1), t(0.1, 0.8, 0.1), t(0.1, 0.1, 0.8)
    cases = [(False, no, yes, yes, 5), (True, yes, yes, none, 1), (False, yes, yes, yes, 2), (False, yes, yes, none, 3), (False, none, yes, yes, 4), (False, none, none, yes, 6), (False, none, none, none, 7)]
    for same, a, b, c, want in cases:
        assert spark.range(1).select(G.outcome(F.lit(same), a, b, c)).first()[0] == want


def test_triage_prefers_evidence(spark):
    df = spark.createDataFrame([("the sky is blue today", "sky is blue"), ("the sky is not blue", "sky is blue"), ("cats", "sky is blue")], "e string, c string")
    assert [r[0] for r in df.select(G.top_label(G.triage(F.col("e"), F.col("c")))).collect()] == ["support", "contradict", "insufficient"]


def test_tags_and_arrays(spark):
    df = spark.range(30).withColumnRenamed("id", "k")
    got = R.tag_by_priority(df, [("five", F.col("k") % 5 == 0), ("even", F.col("k") % 2 == 0)], 10, "k").where("tag is not null").collect()
    assert sorted((r["tag"] for r in got)) == ["even"] * 4 + ["five"] * 6
    assert one(spark, ["a", "b", "c"], R.latent_slots(F.col("x"), F.lit("z"), 2, 2), "x array<string>") == "<bot>\n\n<bot>\n\n<eot>\n\nc\n\nz"
    r = one(spark, [1, 2, 3], R.shift_labels(F.col("x"), 4), "x array<int>")
    assert (r["inputs"], r["labels"]) == ([1, 2], [2, 3, -100, -100])
    spans = [(0, 3), (3, 7), (7, 9)]
    assert tuple(one(spark, spans, R.token_span(F.col("x"), F.lit(2), F.lit(7)), "x array<struct<start:int,end:int>>")) == (0, 2)
    assert one(spark, spans, R.token_span(F.col("x"), F.lit(20), F.lit(30)), "x array<struct<start:int,end:int>>") is None


def test_intervals_merge_and_stay(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 10, 12), (2, 1, 2)], "u int, a int, b int")
    once = O.merge_intervals(df, ["u"], "a", "b")
    assert sorted(map(tuple, once.collect())) == [(1, 0, 8, 2), (1, 10, 12, 1), (2, 1, 2, 1)]
    assert sorted(r[:3] for r in O.merge_intervals(once.drop("n_spans"), ["u"], "a", "b").collect()) == [(1, 0, 8), (1, 10, 12), (2, 1, 2)]


def test_redaction_leaves_no_mail(spark):
    t = "mail a.b@c.de, 555-123-4567, 550e8400-e29b-41d4-a716-446655440000 and 4111-1111-1111-1111"
    out = one(spark, t, X.redact(F.col("x")))
    assert "@" not in out and "REDACTED_UUID" in out and "REDACTED_PHONE" in out and one(spark, out, X.count_matches(F.col("x"), X.EMAIL)) == 0


def test_gap_fill_marks_rules(spark):
    r = D.fill_gaps(spark.createDataFrame([(None, 2)], "a int, b int"), [("a", F.lit(1), "one"), ("b", F.lit(9), "nine")]).first()
    assert (r["a"], r["b"], r["filled"]) == (1, 2, {"a": "one"})


def test_ndjson(spark, tmp_path):
    lines = ['{"__header__": {"v": 1}}', '{"id": "a", "n": 1}', "", "{broken", '{"id": "a", "n": 2}', '{"id": null, "n": 3}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    path = str(tmp_path / "x.jsonl")
    rows = N.read_tolerant(spark, path, "id string, n int")
    assert sorted(r["n"] for r in rows.collect()) == [1, 2, 3]
    assert json.loads(N.read_header(spark, path).first()["header"]) == {"v": 1}
    assert N.load_statistics(spark, path).first().asDict() == {"lines": 6, "blank": 1, "malformed": 1, "headers": 1}
    assert [r["n"] for r in N.last_by_id(rows.withColumn("_pos", F.col("n"))).collect()] == [2]
    with pytest.raises(Exception):
        N.read_strict(spark, path, "id string, n int").collect()
    N.write_with_manifest(rows.select("id", "n"), str(tmp_path / "out"), {"least": "1"})
    assert spark.read.json(str(tmp_path / "out/manifest")).first().asDict() == {"least": "1", "rows": 3}
    (tmp_path / "p").write_text('{"prompt":"one"}\n{"text":"two"}\n"three"\n')
    assert [r["prompt"] for r in N.read_prompts(spark, str(tmp_path / "p")).collect()] == ["one", "two", "three"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "web.open.jsonl").write_text('{"key":{"url":"u"},"result":{"ok":true}}\n')
    assert N.read_fixtures(spark, str(tmp_path / "f")).first().asDict() == {"name": "web_open", "key": '{"url":"u"}', "result": '{"ok":true}'}
    cache = spark.createDataFrame([("one",)], "prompt string").select(F.sha2("prompt", 256).alias("key"))
    assert [r["prompt"] for r in N.missing_from_cache(N.read_prompts(spark, str(tmp_path / "p")), cache).collect()] == ["two", "three"]


def test_capture_and_alerts(spark):
    lines = spark.createDataFrame([('data: {"type":"assistant.final","text":"hi"}',), ("free text",), ('{"type":"other"}',), ("",)], "value string")
    assert [(r["type"], r["text"]) for r in S.parse_capture(lines).collect()] == [("assistant.final", "hi"), ("assistant.delta", "free text")]
    points = spark.createDataFrame([("a", 5.0), ("a", 1.0), ("b", 9.0)], "event_type string, value double")
    assert [r["value"] for r in S.alerts(points, {"a": 2.0}).collect()] == [5.0]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    last = events.limit(1).withColumn("ts", F.lit("2100-01-01 00:00:00").cast("timestamp_ntz"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = S.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    got = S.run_available(spark, stream, "counts")
    key = lambda df: sorted((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert key(got) == key(S.windowed_counts(events))
