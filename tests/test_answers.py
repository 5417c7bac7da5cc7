"""Stores, shells, mixes and tool inference against plain expectations."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from granary.functions import steps as P
from granary.functions import vectors as V
from granary.operators import inference as I
from granary.operators import mixing as M
from granary.operators import ordered as O
from granary.operators import records as R
from granary.operators import shells as H
from granary.sources import ndjson, stores


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_resume_goes_on_where_it_stopped(spark, tmp_path):
    path = str(tmp_path / "out")
    todo = spark.range(10).select("id", F.lit(2).alias("cost"))
    assert stores.resume(spark, todo, "id", path, lambda d: d, batch=4) == 4
    assert stores.resume(spark, todo, "id", path, lambda d: d, batch=4) == 4
    assert stores.resume(spark, todo, "id", path, lambda d: d, budget=16, cost=F.col("cost")) == 0
    assert stores.resume(spark, todo, "id", path, lambda d: d) == 2
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(10))
    assert stores.resume(spark, todo, "id", path, lambda d: d) == 0


def test_metrics_fingerprints_and_versions(spark, tmp_path):
    path = str(tmp_path / "m")
    for i in range(2):
        stores.append_metrics(spark.createDataFrame([(i, None)], "step int, loss double"), path)
    assert sorted(r["value"] for r in spark.read.text(path).collect()) == ['{"step":0,"loss":null}', '{"step":1,"loss":null}']
    lines = ['{"__header__": {"v": 1}}', '{"a": "has \\"__header__\\" in it"}', "not json"]
    file = tmp_path / "d.jsonl"
    file.write_text("\n".join(lines) + "\n")
    assert stores.file_fingerprint(spark, str(file)) == hashlib.sha256(("\n".join(lines[1:]) + "\n").encode()).hexdigest()
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    digest = stores.table_fingerprint(df).first()
    assert stores.table_fingerprint(df.orderBy(F.desc("id"))).first() == digest != stores.table_fingerprint(df.limit(1)).first()
    out = stores.promote(df, str(tmp_path / "v"), "1.0", True)
    assert spark.read.parquet(f"{out}/data").count() == 2
    for version, passed in (("1.0", True), ("1.1", False)):
        with pytest.raises(ValueError):
            stores.promote(df, str(tmp_path / "v"), version, passed)


def test_configuration_registry_and_validation(spark, tmp_path):
    assert stores.deep_merge({"a": {"x": 1, "y": [1]}, "b": 2}, {"a": {"y": [2], "z": 3}, "b": {"c": 1}}) == {"a": {"x": 1, "y": [2], "z": 3}, "b": {"c": 1}}
    (tmp_path / "base.json").write_text('{"a": {"x": 1}}')
    (tmp_path / "more.json").write_text('{"a": {"y": 2}}')
    assert stores.load_config(spark, str(tmp_path / "base.json"), str(tmp_path / "more.json")) == {"a": {"x": 1, "y": 2}}
    assert stores.config_fingerprint({"a": 1, "b": 2}) == stores.config_fingerprint({"b": 2, "a": 1})
    folder = tmp_path / "schemas"
    folder.mkdir()
    (folder / "open.json").write_text(json.dumps({"title": "web.open", "required": ["url"], "properties": {"url": {"type": "string"}, "n": {"type": "integer", "minimum": 1}}}))
    registry = stores.load_registry(spark, str(folder))
    rows = spark.createDataFrame([('{"url": "u"}',), ('{"n": 0}',), ("{",), (None,)], "r string")
    errors = [r["_validation_error"] for r in stores.with_validation_errors(rows, F.col("r"), registry["web.open"]).collect()]
    assert errors == [None, "missing:url,min:n", "not JSON", "not JSON"]


def test_header_is_a_key_not_a_word(spark, tmp_path):
    file = tmp_path / "d.jsonl"
    file.write_text('{"__header__": {"v": 1}}\n{"t": "the \\"__header__\\" word"}\n\n{bad\n')
    assert [r["t"] for r in ndjson.read_tolerant(spark, str(file), "t string").collect()] == ['the "__header__" word']
    assert ndjson.load_statistics(spark, str(file)).first()["headers"] == 1


def test_audit_rows(spark):
    calls = spark.sql("SELECT 'read' AS tool, '{}' AS args, timestamp'2024-01-01 00:00:00' AS s, timestamp'2024-01-01 00:00:01.5' AS e, CAST(NULL AS string) AS err")
    row = stores.audit_rows(calls, "tool", F.col("args"), F.col("s"), F.col("e"), F.col("err")).first()
    assert (row["latency_ms"], row["status"]) == (1500.0, "ok")


def test_strict_grounding_needs_a_keyed_field(spark):
    fields = F.create_map(F.lit("summary"), F.lit("Big  News"), F.lit("count"), F.lit("1234.5"), F.lit("other"), F.lit("zebra"), F.lit("lines"), F.lit("https://www.Example.com/docs/a"))
    none = F.array().cast("array<string>")
    for span, want in (("some big news", True), ("a zebra", False), ("1234,5", True), ("1 234.5 in all", True), ("at example.com/docs", True), ("123450 percent", True), ("", False)):
        assert one(spark, R.is_grounded_strictly(F.lit(span), fields, none)) == want, span
    assert one(spark, R.is_grounded_strictly(F.lit("the fourth"), F.create_map(F.lit("a"), F.lit("b")), F.array(*[F.lit(x) for x in ("first", "second", "third", "fourth")]))) is False


def test_steps_answers_and_prompts(spark):
    text = "First look\nat it\n\nnow\nThen go\nFinal answer: 7 \n"
    assert one(spark, P.steps(F.lit(text))) == ["First look at it", "now", "Then go Final answer: 7"]
    assert one(spark, P.steps(F.lit(" \n "))) == [" \n "]
    assert one(spark, P.answer(F.lit(text))) == "7" and one(spark, P.answer(F.lit("a\n b "))) == "b"
    assert tuple(one(spark, P.prompt_parts(F.lit("no system here\nx")))) == ("", "no system here\nx")


def test_calls_slices_and_shells(spark):
    assert one(spark, I.json_slice(F.lit('ab {"a": {"b": 1}} c'), F.lit(2), F.lit(18))) == '{"a": {"b": 1}}'
    assert one(spark, I.json_slice(F.lit("ab {a c"), F.lit(0), F.lit(7))) is None
    assert one(spark, I.named_tool(F.lit("use READ_file or read_files"), ["read_file", "write"])) == "read_file"
    spec = one(spark, H.working_spec(F.from_json(F.lit('{"budget": {"max_loc": 9}}'), H.SPEC)))
    assert (spec["id"], spec["budget"]["max_files"], spec["budget"]["max_loc"], spec["scope"]["in"]) == ("UNKNOWN", 0, 9, [])
    judges = H.fill_judge(spark.createDataFrame([(None,), ("odd",)], "winner string").withColumn("debate_scores", F.lit(None)))
    assert [(r["winner"], r["filled"][0]) for r in judges.collect()] == [("tie", "winner"), ("odd", "debate_scores")]
    assert one(spark, H.compact_spec(F.from_json(F.lit('{"risk_tier": 2, "scope": {"in": ["a", "b"]}}'), H.SPEC))) == "tier=2 files<=0 loc<=0 in=a,b out="


def test_small_tables_of_mixes_and_ranks(spark):
    empty = spark.createDataFrame([], "id int, part string, t string")
    assert M.random_pairs(empty, "id", "t", 5).count() == 0
    assert M.ratio_mix(empty, "part", "id", {"a": 0.5, "b": 0.5}, 10).count() == 0
    few = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z")], "id int, part string, t string")
    mixed = M.ratio_mix(few, "part", "id", {"a": 0.5, "b": 0.5}, 10)
    assert sorted(r["place"] for r in mixed.collect()) == list(range(10)) and mixed.where("part = 'b'").count() == 1
    hot = spark.range(5000).select("id", (F.col("id") % 7 == 0).alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    ranked = O.exact_ranks(hot, F.col("h"), F.col("id"), digits=2, group="g").groupBy("g").agg(F.min("_rank").alias("a"), F.max("_rank").alias("b"), F.countDistinct("_rank").alias("n"), F.count(F.lit(1)).alias("m"))
    assert all(r["a"] == 1 and r["b"] == r["n"] == r["m"] for r in ranked.collect())


def test_vectors_and_unequal_predictions(spark):
    p = one(spark, V.softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0))))
    assert sum(p) == pytest.approx(1) and p[1] == p[2] > p[0]
    assert one(spark, V.spread(F.array(F.lit(1.0), F.lit(3.0)))) == 1.0
    a = spark.createDataFrame([(1, [0.1]), (2, [0.2])], "k int, v array<double>")
    with pytest.raises(ValueError):
        I.compare_predictions(a, a.limit(1).withColumnRenamed("v", "w"), "k", "v", "w")
