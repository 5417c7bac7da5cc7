"""Queries over metrics of judgements and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import metrics as M
from granary.plans.catalog import query
from granary.plans.judging import _RATED, _items, _rated
from granary.session import read_table

_TIED = f"SELECT CASE WHEN n_chars % 7 = 0 THEN -1 ELSE pred END AS s, CASE WHEN n_chars % 5 = 0 THEN -1 ELSE quality END AS w FROM ({_RATED})"
_SCORED = "round((a/nullif(a+b,0)::double + d/nullif(d+c,0)::double)/2, 6) AS precision_macro, round((a/nullif(a+c,0)::double + d/nullif(d+b,0)::double)/2, 6) AS recall_macro"


def _tied(spark, sf_dir):
    tie = lambda n, c: F.when(F.col("n_chars") % n == 0, -1).otherwise(F.col(c))
    return _rated(spark, sf_dir).select(tie(7, "pred").alias("s"), tie(5, "quality").alias("w"))


@query(
    f"""WITH t AS ({_TIED}), c AS (SELECT count(*) FILTER (s=0 AND w=0) AS a, count(*) FILTER (s=0 AND w=1) AS b, count(*) FILTER (s=1 AND w=0) AS c, count(*) FILTER (s=1 AND w=1) AS d, count(*) AS n, count(*) FILTER (s=-1 AND w=-1) AS z FROM t),
m AS (SELECT *, {_SCORED} FROM c) SELECT ties, round(x, 6) AS accuracy, precision_macro, recall_macro FROM (SELECT 'exclude' AS ties, (a+d)/(a+b+c+d)::double AS x, precision_macro, recall_macro FROM m
UNION ALL SELECT 'penalize', (a+d)/n::double, precision_macro, recall_macro FROM m UNION ALL SELECT 'count_as_correct', (a+d+z)/n::double, precision_macro, recall_macro FROM m)"""
)
def tie_strategies(spark, sf_dir):
    """Preferences against labels under the three ways to take ties."""
    rows = None
    for ties in ("exclude", "penalize", "count_as_correct"):
        one = M.preference_accuracy(_tied(spark, sf_dir), F.col("s"), F.col("w"), ties).select(F.lit(ties).alias("ties"), *[F.round(c, 6).alias(c) for c in ("accuracy", "precision_macro", "recall_macro")])
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query(
    f"""WITH r AS ({_RATED}), g AS (SELECT 'bad' AS c, pred=0 AS p, quality=0 AS q FROM r UNION ALL SELECT 'long', n_chars>3000, toxic=1 FROM r UNION ALL SELECT 'plain', lang='en', lang IN ('en','fr') FROM r),
n AS (SELECT CASE WHEN grouping(c) = 0 THEN c END AS clause, count(*) FILTER (p AND q) AS tp, count(*) FILTER (p AND NOT q) AS fp, count(*) FILTER (q AND NOT p) AS fn FROM g GROUP BY GROUPING SETS ((c), ()))
SELECT clause, round(coalesce(tp/nullif(tp+fp,0)::double,0),6) AS precision, round(coalesce(tp/nullif(tp+fn,0)::double,0),6) AS recall, round(coalesce(2*tp/nullif(2*tp+fp+fn,0)::double,0),6) AS f1, tp+fn AS support FROM n"""
)
def clause_scores(spark, sf_dir):
    some = lambda *xs: F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in xs]))
    p = some((F.col("pred") == 0, "bad"), (F.col("n_chars") > 3000, "long"), (F.col("lang") == "en", "plain"))
    q = some((F.col("quality") == 0, "bad"), (F.col("toxic") == 1, "long"), (F.col("lang").isin("en", "fr"), "plain"))
    return M.clause_scores(_rated(spark, sf_dir), p, q).select("clause", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    """WITH f AS (SELECT doc_id AS id, md5(text) AS s FROM documents WHERE doc_id % 3 > 0), g AS (SELECT doc_id AS id, md5(text) AS s FROM documents WHERE doc_id % 2 = 0), v AS (SELECT doc_id AS id FROM labels WHERE quality = 1),
e AS (SELECT (SELECT count(DISTINCT s) FROM f) AS nf, (SELECT count(DISTINCT s) FROM g) AS ng, (SELECT count(*) FROM (SELECT s FROM f INTERSECT SELECT s FROM g)) AS tp),
m AS (SELECT f.s IN (SELECT s FROM g) AS hit, f.id IN (SELECT id FROM v) AS ok FROM f), k AS (SELECT count(*) FILTER (hit AND ok) AS a, count(*) FILTER (NOT hit AND ok) AS b, count(*) FILTER (hit AND NOT ok) AS c FROM m),
h AS (SELECT count(*) AS n, count(*) FILTER (s IN (SELECT s FROM f) AND id IN (SELECT id FROM v)) AS good FROM g)
SELECT round(tp/nf::double,6) AS extraction_precision, round(tp/ng::double,6) AS extraction_recall, round(2*tp/(nf+ng)::double,6) AS extraction_f1, round(a/(a+b)::double,6) AS verification_precision, round(a/(a+c)::double,6) AS verification_recall,
round(2*a/(2*a+b+c)::double,6) AS verification_f1, round(good/n::double,6) AS coverage FROM e, k, h"""
)
def claim_scores(spark, sf_dir):
    """Digests of documents as statements: two overlapping sets, verified where the label is good."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("statement"))
    results = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("claim_id"), F.when(F.col("quality") == 1, "VERIFIED").otherwise("UNVERIFIED").alias("status"))
    s = M.claim_scores(d.where("id % 3 > 0"), d.where("id % 2 = 0"), results)
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query(
    """WITH s AS (SELECT event_id, value / 100 AS c, event_type = 'error' OR value > 70 AS p FROM events), u AS (SELECT c, count(*) FILTER (p) AS pos, count(*) FILTER (NOT p) AS neg FROM s GROUP BY c),
w AS (SELECT *, sum(pos) OVER (ORDER BY c DESC) AS cp, sum(neg) OVER (ORDER BY c DESC) AS cn, sum(pos) OVER () AS tp, sum(neg) OVER () AS tn FROM u)
SELECT round(c, 6) AS threshold, round(cn/tn::double, 6) AS fpr, round(cp/tp::double, 6) AS tpr, round(sum(neg * (cp - pos/2.0::double)) OVER () / (tp * tn)::double, 6) AS auc FROM w"""
)
def roc_points(spark, sf_dir):
    """Points of the curve of event values, with the area under it."""
    c = M.roc_curve(read_table(spark, sf_dir, "events"), F.col("value") / 100, (F.col("event_type") == "error") | (F.col("value") > 70))
    return c.join(F.broadcast(M.curve_area(c))).select(*[F.round(x, 6).alias(x) for x in ("threshold", "fpr", "tpr", "auc")])


@query(
    """SELECT round(avg(20 * (1 - value/100) + (event_id % 90) * value/100), 4) AS expected_length, round(avg(20 * (1 - value/100) + (event_id % 90) * value/100)/20, 6) AS length_ratio, round(avg(value/100), 6) AS mean, round(stddev_pop(value/100), 6) AS std, count(*) AS n FROM events WHERE value < 100"""
)
def halt_lengths(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").where("value < 100")
    h = M.halt_summary(e, F.col("value") / 100, (F.col("event_id") % 90).cast("double"), F.lit(20.0))
    return h.select(F.round("expected_length", 4).alias("expected_length"), *[F.round(c, 6).alias(c) for c in ("length_ratio", "mean", "std")], "n")


@query(
    """WITH r AS (SELECT length(text) AS t, toxic = 1 AS leak, lang = 'en' AS used, quality = 1 AS eligible FROM documents JOIN labels USING (doc_id)), s AS (SELECT sum(t)::bigint AS tokens, count(*) FILTER (leak) AS leaks, count(*) FILTER (eligible AND used) AS adopted, count(*) FILTER (eligible) AS eligible FROM r)
SELECT tokens, leaks, adopted, eligible, round((1e7 - tokens)/1e7, 6) AS gain, round(adopted/greatest(eligible, 1)::double, 6) AS rate, (1e7 - tokens)/1e7 >= 0.25 AS tokens_gate, leaks = 0 AS leak_gate, eligible = 0 OR adopted/eligible::double >= 0.6 AS use_gate,
(1e7 - tokens)/1e7 >= 0.25 AND leaks = 0 AND (eligible = 0 OR adopted/eligible::double >= 0.6) AS passed FROM s"""
)
def code_gates(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").join(read_table(spark, sf_dir, "labels"), "doc_id")
    r = d.select(F.length("text").alias("tokens_total"), (F.col("toxic") == 1).alias("leak"), (F.col("lang") == "en").alias("used_code"), (F.col("quality") == 1).alias("eligible"))
    return M.code_gates(r, 1e7).withColumns({"gain": F.round("gain", 6), "rate": F.round("rate", 6)})


@query(
    """WITH m AS (SELECT user_id, avg(value) FILTER (event_id % 2 = 0) AS b, avg(value) FILTER (event_id % 2 = 1) AS n, count(*) AS c FROM events GROUP BY user_id HAVING count(DISTINCT event_id % 2) = 2)
SELECT user_id, array_to_string(list_filter([CASE WHEN (n-b)/b > 0.05 THEN 'ttft_p50' END, CASE WHEN (b-n)/b > 0.05 THEN 'tps_p50' END, CASE WHEN n > 25 THEN 'ttfa_p95' END, CASE WHEN n/100 < 0.2 THEN 'share' END, CASE WHEN (b-n)/b > 0.1 THEN 'share_drop' END], lambda x: x IS NOT NULL), ',') AS errors FROM m WHERE user_id % 4 > 0
UNION ALL SELECT user_id, '' FROM m WHERE user_id % 4 = 0"""
)
def speed_errors(spark, sf_dir):
    """Users as runs: even events are the baseline, odd ones the run; every fourth ran on other hardware."""
    mean = lambda r: F.avg(F.when(F.col("event_id") % 2 == r, F.col("value")))
    m = read_table(spark, sf_dir, "events").groupBy("user_id").agg(mean(0).alias("b"), mean(1).alias("n")).where("b is not null and n is not null")
    run = lambda c: F.struct(F.col(c).alias("ttft_p50"), F.lit(1.0).alias("ttft_p95"), F.col(c).alias("tps_p50"), F.lit(1.0).alias("tps_p95"), F.col(c).alias("ttfa_p95"), (F.col(c) / 100).alias("share"))
    errors = M.speed_errors(run("n"), run("b"), F.col("user_id") % 4 > 0, least_share=0.2)
    return m.select("user_id", F.array_join(errors, ",").alias("errors"))


@query()
def best_calibration(spark, sf_dir):
    """Benchmark items against the next item as evidence; the label is a rule of the id."""
    e = _items(spark, sf_dir, "e", "evidence").select((F.col("e_id") - F.col("e_id") % 2 + 1 - F.col("e_id") % 2).alias("c_id"), "evidence")
    rows = _items(spark, sf_dir, "c", "claim").join(e, "c_id")
    label = F.when(F.col("c_id") % 3 == 0, "support").when(F.col("c_id") % 3 == 1, "contradict").otherwise("insufficient")
    b = M.best_calibration(rows, F.col("evidence"), F.col("claim"), label, (0.4, 0.6, 0.8, 1.0, 1.2), (-0.5, 0.0, 0.5))
    return b.select("temperature", "support", "contradict", "insufficient", *[F.round(c, 6).alias(c) for c in ("mean_nll", "p50_nll", "p95_nll")])


@query()
def claim_verification(spark, sf_dir):
    """First sentences of benchmark items against all items; some with superlatives or numbers, every third with an artifact."""
    from granary.operators import verification as W

    first = F.get(F.split("text", r"(?<=\.)\s"), 0)
    b = read_table(spark, sf_dir, "benchmark")
    claim = F.when(F.col("item_id") % 4 == 0, F.concat(first, F.lit(" It is not the best"))).when(F.col("item_id") % 4 == 1, F.concat(first, F.lit(" with 45 ms"))).otherwise(first)
    claims = b.select(F.col("item_id").alias("claim_id"), claim.alias("claim"), F.when(F.col("item_id") % 2 == 0, claim).otherwise(F.concat(claim, F.lit(" [time: now]"))).alias("full"), F.when(F.col("item_id") % 3 == 0, F.array(F.lit("bench_json"))).otherwise(F.array().cast("array<string>")).alias("kinds"))
    v = W.verify(claims, b.select(F.col("item_id").alias("evidence_id"), F.col("text").alias("evidence")), {"QUANT": ("bench_json", "eval_report")})
    return v.select("claim_id", "status", "outcome", F.round("coverage", 4).alias("coverage"), F.array_join("violations", ",").alias("violations"), *[F.round(c, 6).alias(c) for c in ("support", "contradict", "insufficient")])
