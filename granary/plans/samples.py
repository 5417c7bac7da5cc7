"""Queries over dataset rows: issues, links, traces, presence, scenarios, stage datasets, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import samples as S
from granary.plans.catalog import query
from granary.session import read_table


@query(
    r"""WITH d AS (SELECT doc_id, substr(text, 1, 40) AS p, text AS a, source, lang, doc_id % 4 AS level, doc_id % 3 = 0 AS ctx FROM documents),
i AS (SELECT unnest(list_distinct(list_filter([CASE WHEN length(p) < 20 THEN 'Very short prompt' END, CASE WHEN NOT regexp_matches(p, '\S') THEN 'Empty prompt' END, CASE WHEN NOT regexp_matches(p, '[?.]') THEN 'Prompt lacks clear structure' END,
CASE WHEN a <> '' AND length(a) < 20 THEN 'Very short teacher_text' END, CASE WHEN length(a) > 50000 THEN 'Very long teacher_text' END, CASE WHEN a = '' AND source <> 'src0' THEN 'Missing teacher_text' END,
CASE WHEN level = 2 AND NOT ctx THEN 'caws_level=2 but missing evidence/provenance' WHEN level >= 1 AND NOT ctx THEN 'caws_level=' || level || ' but missing CAWS context' END,
CASE WHEN lang <> 'en' THEN 'Invalid task_type: ' || lang END], lambda x: x IS NOT NULL))) AS issue FROM d) SELECT 'worker' AS kind, issue, count(*) AS n FROM i GROUP BY issue"""
)
def worker_issue_report(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    source, task = F.when(F.col("source") == "src0", "synthetic").otherwise(F.col("source")), F.when(F.col("lang") == "en", "plain_kd").otherwise(F.col("lang"))
    has = F.col("doc_id") % 3 == 0
    issues = S.worker_issues(F.substring("text", 1, 40), F.col("text"), source, task, (F.col("doc_id") % 4).cast("int"), has, has)
    return S.issue_report(d, issues, F.lit("worker"))


@query(
    """WITH t AS (SELECT conv_id, max(text) FILTER (turn = 0) AS p, max(text) FILTER (turn = 1) AS a, max(text) FILTER (turn = 3) AS b, max(role) FILTER (turn = 1) AS w FROM conversations GROUP BY conv_id),
i AS (SELECT unnest(list_filter([CASE WHEN length(coalesce(p, '')) < 20 THEN 'Very short prompt' END, CASE WHEN length(coalesce(p, '')) > 20000 THEN 'Very long prompt' END, CASE WHEN length(coalesce(a, '')) < 10 THEN 'Very short a.text' END, CASE WHEN length(coalesce(b, '')) < 10 THEN 'Very short b.text' END,
CASE WHEN conv_id % 3 > 0 THEN 'Both a and b have no clauses' END, CASE WHEN conv_id % 3 = 0 AND conv_id % 2 = 0 THEN 'Invalid clauses: [''' || 'ODD' || ''']' END, CASE WHEN coalesce(w, '') NOT IN ('a', 'b', 'tie') THEN 'Invalid winner: ' || coalesce(w, '') END,
CASE WHEN coalesce(a, '') = coalesce(b, '') THEN 'a.text and b.text are identical' END], lambda x: x IS NOT NULL)) AS issue FROM t) SELECT 'judge' AS kind, issue, count(*) AS n FROM i GROUP BY issue"""
)
def judge_issue_report(spark, sf_dir):
    """Conversations as judge rows: the second and fourth turn are the sides."""
    at = lambda n, c: F.max(F.when(F.col("turn") == n, F.col(c)))
    t = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(at(0, "text").alias("p"), at(1, "text").alias("a"), at(3, "text").alias("b"), at(1, "role").alias("w"))
    good, odd = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("GATE_INTEGRITY"))), F.when((F.col("conv_id") % 3 == 0) & (F.col("conv_id") % 2 == 0), F.array(F.lit("ODD")))
    return S.issue_report(t, S.judge_issues(F.col("p"), F.col("a"), F.col("b"), good, odd, F.col("w")), F.lit("judge"))


@query(
    """SELECT conv_id, turn, greatest(0, 10 - 2 * ((length(text) = 0)::int + (length(text) > 2000)::int + (length(text) > 0 AND length(text) < 50)::int + (turn % 4 = 3)::int))::int AS score FROM conversations WHERE role = 'assistant' AND text IS NOT NULL"""
)
def drafter_scores(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations").where("role = 'assistant' and text is not null")
    bucket = F.get(F.array(F.lit(200), F.lit(400), F.lit(800), F.lit(7)), (F.col("turn") % 4).cast("int"))
    return c.select("conv_id", "turn", S.issue_score(S.drafter_issues(F.lit("a prompt of twenty letters"), F.col("text"), bucket)).alias("score"))


@query(
    """WITH a AS (SELECT DISTINCT json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'view'), b AS (SELECT DISTINCT json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'error')
SELECT (SELECT count(k) FROM a) AS first_ids, (SELECT count(k) FROM b) AS second_ids, (SELECT count(*) FROM a JOIN b USING (k)) AS shared_ids, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS first_only, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS second_only"""
)
def dataset_linkage(spark, sf_dir):
    """Events as rows of two datasets; the id sits in the row itself or, for odd users, in its context."""
    k = F.get_json_object("props", "$.k")
    own, nested = F.concat(F.lit('{"working_spec":{"id":"'), k, F.lit('"}}')), F.concat(F.lit('{"working_spec":{"id":""},"caws_context":{"working_spec":{"id":"'), k, F.lit('"}}}'))
    e = read_table(spark, sf_dir, "events").select("event_type", S.working_id(F.when(F.col("user_id") % 2 == 0, own).otherwise(nested)).alias("id"))
    return S.linkage(e.where("event_type = 'view'"), e.where("event_type = 'error'"), "id")


@query(
    """WITH l AS (SELECT user_id, arg_max(json_extract_string(props, '$.k'), (ts, event_id)) AS k, max(event_id::bigint) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id),
n AS (SELECT user_id, list(CASE WHEN event_type = 'click' THEN '' ELSE event_type END ORDER BY ts, event_id) AS c FROM events GROUP BY user_id)
SELECT user_id, k, errors IS NOT NULL AS has_error, array_to_string(c, '>') AS calls FROM l JOIN n USING (user_id)"""
)
def trace_fields(spark, sf_dir):
    """Each user's events as a trace of calls whose results are their properties and, for errors, one field more."""
    result = F.when(F.col("event_type") == "error", F.concat(F.lit('{"error":1,'), F.substring("props", 2, 1 << 20))).otherwise(F.col("props"))
    call = F.struct("ts", "event_id", F.when(F.col("event_type") != "click", F.col("event_type")).alias("name"), F.lit(None).cast("string").alias("arguments"), result.alias("result"))
    t = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(call)).alias("t"))
    f = t.select("user_id", S.result_fields(F.col("t")).alias("f"), S.trace_calls(F.col("t")).alias("c"))
    return f.select("user_id", F.col("f")["k"].alias("k"), F.map_contains_key("f", "error").alias("has_error"), F.array_join(F.transform("c", lambda c: c["name"]), ">").alias("calls"))


@query(
    """WITH p AS (SELECT contains(u.text, 'tion') AS w, contains(a.text, 'tion') OR contains(a.text, 'sch') OR contains(a.text, 'ing') AS g, regexp_matches(a.text, '\\S') AS x FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND u.turn = 0 AND a.turn = 1),
s AS (SELECT sum(CASE WHEN w AND g THEN 1.0 WHEN w AND x THEN 0.5 ELSE 0 END)::double AS tp, sum(CASE WHEN g AND NOT w THEN 1 ELSE 0 END)::double AS fp, sum(CASE WHEN w AND NOT g THEN CASE WHEN x THEN 0.5 ELSE 1.0 END ELSE 0 END)::double AS fn FROM p)
SELECT tp, fp, fn, round(2 * (tp/(tp+fp)) * (tp/(tp+fn)) / (tp/(tp+fp) + tp/(tp+fn)), 6) AS f1 FROM s"""
)
def presence_scores(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    both = c.where("turn = 0").select("conv_id", F.col("text").alias("wanted")).join(c.where("turn = 1").select("conv_id", F.col("text").alias("said")), "conv_id")
    return S.presence_f1(both, F.col("wanted"), F.col("said"), "tion", ("sch", "ing")).withColumn("f1", F.round("f1", 6))


@query("SELECT vec_id, list_bool_or(list_transform(embedding, lambda x: isnan(x))) AS has_nan, list_bool_and(list_transform(embedding, lambda x: abs(x) < 1e-12)) AS all_zero FROM embeddings")
def broken_vectors(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").select("vec_id", S.broken_vector(F.col("embedding")).alias("b")).select("vec_id", "b.*")


@query(
    """SELECT CASE WHEN event_id % 16 = 0 OR user_id % 5 = 4 THEN 'fail' WHEN event_id % 3 = 0 AND event_type = 'error' THEN 'fail' WHEN event_id % 3 = 1 AND value > 50 THEN 'fail' ELSE 'inconclusive' END AS result, count(*) AS n FROM events GROUP BY 1"""
)
def scenario_results(spark, sf_dir):
    """Events as outputs of scenarios: calls of their kind, some repeated, some broken, under three rubrics."""
    call = F.concat(F.lit('<bot>{"name": "'), F.col("event_type"), F.lit('"}</bot>'))
    out = F.concat(F.repeat(call, F.when(F.col("event_id") % 16 == 0, 12).otherwise(1)), F.when(F.col("user_id") % 5 == 4, " {odd}").otherwise(" done"))
    kind = F.get(F.array(F.lit(None).cast("string"), F.lit("functional_test"), F.lit("judge_model")), (F.col("event_id") % 3).cast("int"))
    tools = F.array(*[F.lit(t) for t in ("view", "click", "purchase", "signup", "scroll")])
    r = read_table(spark, sf_dir, "events").select(S.scenario_result(out, kind, tools, F.col("value") > 50, F.lit(None).cast("int")).alias("r"))
    return r.groupBy(F.col("r.result").alias("result")).agg(F.count(F.lit(1)).alias("n"))
