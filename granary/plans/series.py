"""Queries over events, conversations and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions import judging as G
from granary.functions import text as X
from granary.functions import vectors as V
from granary.operators.inference import compare_predictions
from granary.operators.ordered import merge_intervals
from granary.operators.quantiles import interpolated, order_statistics
from granary.plans.catalog import query
from granary.session import read_table
from granary.streaming import windows as S


@query("SELECT event_type, round(quantile_cont(value,0.5),6) AS p50, round(quantile_cont(value,0.9),6) AS p90, round(quantile_cont(value,0.95),6) AS p95 FROM events WHERE value IS NOT NULL AND isfinite(value) GROUP BY event_type")
def speed_percentiles(spark, sf_dir):
    v = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    e = interpolated(read_table(spark, sf_dir, "events"), ["event_type"], v, {"p50": 0.5, "p90": 0.9, "p95": 0.95})
    return e.select("event_type", *[F.round(n, 6).alias(n) for n in ("p50", "p90", "p95")])


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(max(value) FILTER (i = floor(0.5*n)),6) AS p50, round(max(value) FILTER (i = CASE WHEN n > 20 THEN floor(0.95*n) ELSE n-1 END),6) AS p95, round(max(value) FILTER (i = CASE WHEN n > 100 THEN floor(0.99*n) ELSE n-1 END),6) AS p99,
max(value) FILTER (i = floor(0.5*n)) <= 50 AS meets FROM r GROUP BY event_type"""
)
def latency_targets(spark, sf_dir):
    """Nearest-rank percentiles against a target, by rank and count."""
    at = lambda share, least: lambda n: F.when(n > least, F.floor(n * share)).otherwise(n - 1)
    e = order_statistics(read_table(spark, sf_dir, "events"), ["event_type"], F.col("value"), {"p50": at(0.5, 0), "p95": at(0.95, 20), "p99": at(0.99, 100)})
    return e.select("event_type", *[F.round(n, 6).alias(n) for n in ("p50", "p95", "p99")], (F.col("p50") <= 50).alias("meets"))


@query(
    """WITH a AS (SELECT event_type, quantile_cont(value,0.5) AS base FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type, quantile_cont(value,0.5) AS now FROM events WHERE user_id % 2 = 1 GROUP BY 1)
SELECT event_type, round(base,6) AS base, round(now,6) AS now, (now-base)/base <= 0.05 AS passed FROM a JOIN b USING (event_type)"""
)
def speed_gate(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    half = lambda r, n: interpolated(e.where(F.col("user_id") % 2 == r), ["event_type"], F.col("value"), {n: 0.5}).drop("n")
    both = half(0, "base").join(half(1, "now"), "event_type")
    return both.select("event_type", F.round("base", 6).alias("base"), F.round("now", 6).alias("now"), G.speed_gate(F.col("now"), F.col("base")).alias("passed"))


@query("SELECT event_type, round(avg(value),6) AS mean, round(stddev_pop(value),6) AS std, round(greatest(0,least(1,(100-avg(value))/100)),6) AS reduction FROM events GROUP BY event_type")
def efficiency_aggregates(spark, sf_dir):
    return read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.round(G.reduction(F.lit(100.0), F.avg("value")), 6).alias("reduction"))


@query("SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS latest FROM events GROUP BY event_type")
def metric_summary(spark, sf_dir):
    o = F.struct("ts", "event_id")
    return read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.min_by("value", o).alias("first_value"), F.max_by("value", o).alias("latest"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_metric(spark, sf_dir):
    return read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT event_id, event_type FROM events WHERE ts >= (SELECT min(ts) FROM events) + INTERVAL 1 HOUR AND json_extract_string(props,'$.k')::int = 7")
def time_range(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    start = e.agg(F.min("ts").alias("start"))
    return e.crossJoin(F.broadcast(start)).where((F.col("ts") >= F.col("start") + F.expr("INTERVAL 1 HOUR")) & (F.get_json_object("props", "$.k").cast("int") == 7)).select("event_id", "event_type")


@query(
    """WITH e AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id)
SELECT user_id, round(list_reduce(v, lambda a, x: a * (1 - 2.0::double / 11) + x * (2.0::double / 11)), 6) AS ewma, len(v) AS n FROM e"""
)
def ewma(spark, sf_dir):
    """Last exponentially weighted mean of each user's values, seeded with the first, in closed form over ranks."""
    alpha = 2.0 / 11
    w = Window.partitionBy("user_id")
    e = read_table(spark, sf_dir, "events").select("user_id", "value", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))).alias("back"), F.count(F.lit(1)).over(w).alias("n"))
    weight = F.when(F.col("back") == F.col("n"), F.pow(F.lit(1 - alpha), F.col("back") - 1)).otherwise(alpha * F.pow(F.lit(1 - alpha), F.col("back") - 1))
    return e.groupBy("user_id").agg(F.round(F.sum(F.col("value") * weight), 6).alias("ewma"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, min(value) OVER w AS low, max(value) OVER w AS high, value <= min(value) OVER w AS improving FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING)")
def loss_trend(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    return read_table(spark, sf_dir, "events").select("event_id", F.min("value").over(w).alias("low"), F.max("value").over(w).alias("high"), (F.col("value") <= F.min("value").over(w)).alias("improving"))


@query(
    """WITH s AS (SELECT user_id, ts AS a, ts + INTERVAL 600 MINUTE AS b FROM events), m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT user_id, epoch_us(min(a)) AS a, epoch_us(max(b)) AS b, count(*) AS n_spans FROM i GROUP BY user_id, island"""
)
def interval_merge(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("a"))
    return merge_intervals(e.withColumn("b", F.col("a") + 600 * 60 * 1_000_000), ["user_id"], "a", "b")


@query(
    """WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type='error'), o AS (SELECT event_id, user_id, ts FROM events WHERE event_type<>'error')
SELECT e.event_id, CASE WHEN e.ts - o.ts <= INTERVAL 30 HOUR THEN o.event_id END AS before_id FROM e ASOF LEFT JOIN o ON e.user_id=o.user_id AND e.ts >= o.ts"""
)
def asof_nearest_preceding(spark, sf_dir):
    """Errors with the nearest earlier other event of their user, within a tolerance: one pass over the union."""
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    other = F.when(F.col("event_type") != "error", F.struct("ts", "event_id"))
    w = Window.partitionBy("user_id").orderBy("ts", (F.col("event_type") == "error").cast("int"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    near = e.withColumn("near", F.last(other, ignorenulls=True).over(w)).where("event_type = 'error'")
    return near.select("event_id", F.when(F.unix_micros("ts") - F.unix_micros("near.ts") <= 30 * 3600 * 1_000_000, F.col("near.event_id")).alias("before_id"))


@query("SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS prompt_md5, count(*) AS turns FROM conversations GROUP BY conv_id")
def render_conversation(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return c.select("conv_id", F.md5(F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")).alias("prompt_md5"), F.size("t").cast("bigint").alias("turns"))


@query(
    """WITH t AS (SELECT conv_id, list(length(text) ORDER BY turn) AS v, conv_id // 8 AS batch FROM conversations GROUP BY conv_id), m AS (SELECT *, max(len(v)) OVER (PARTITION BY batch) AS n FROM t)
SELECT conv_id, array_to_string(list_concat(v, list_transform(range((n - len(v))::bigint), lambda x: -100)), ',') AS padded FROM m"""
)
def pad_batch(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda t: t["n"]).alias("v"))
    c = c.withColumn("batch", F.floor(F.col("conv_id") / 8)).withColumn("n", F.max(F.size("v")).over(Window.partitionBy("batch")))
    return c.select("conv_id", F.array_join(F.concat("v", F.array_repeat(F.lit(-100), F.col("n") - F.size("v"))).cast("array<string>"), ",").alias("padded"))


@query(
    """WITH l AS (SELECT event_id, row_number() OVER w AS loops, value, lag(value) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, loops, CASE WHEN loops >= 5 THEN 'max_loops' WHEN value >= 90 THEN 'score' WHEN abs(value - before) < 1 THEN 'shrinking' ELSE 'continue' END AS state FROM l"""
)
def halt_state(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read_table(spark, sf_dir, "events").select("event_id", F.row_number().over(w).cast("bigint").alias("loops"), "value", F.lag("value").over(w).alias("before"))
    state = F.when(F.col("loops") >= 5, "max_loops").when(F.col("value") >= 90, "score").when(F.abs(F.col("value") - F.col("before")) < 1, "shrinking").otherwise("continue")
    return e.select("event_id", "loops", state.alias("state"))


@query("SELECT conv_id AS trace_id, count(*) AS events, count(*) FILTER (role='assistant') AS answers, sum(length(text)//4)::bigint AS tokens, string_agg(role, '>' ORDER BY turn) AS path FROM conversations GROUP BY conv_id")
def trace_build(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("trace_id"))
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"]), ">")
    return c.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("role") == "assistant").alias("answers"), F.sum(X.estimated_tokens(F.col("text"))).alias("tokens"), path.alias("path"))


@query(
    r"""SELECT conv_id, turn, len(regexp_extract_all(lower(text), '\b(it|this|that|they|he|she)\b')) AS pronouns, len(regexp_extract_all(lower(text), '\b(now|recently|soon|later|today)\b')) AS temporal FROM conversations WHERE role='user'"""
)
def ambiguity_counts(spark, sf_dir):
    low = F.lower("text")
    return read_table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", X.count_matches(low, r"\b(it|this|that|they|he|she)\b").alias("pronouns"), X.count_matches(low, r"\b(now|recently|soon|later|today)\b").alias("temporal"))


def _vector_pairs(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").alias("a"), "label").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"), F.col("label").alias("other")), "vec_id")


_SHARES = "list_transform({0}, lambda x: exp(x - list_max({0})) / list_sum(list_transform({0}, lambda y: exp(y - list_max({0})))))"
_POSITIVE = "list_transform({0}, lambda x: (x + 1e-10) / (list_sum({0}) + 1e-10 * len({0})))"


@query(
    f"""WITH v AS (SELECT vec_id, embedding::double[] AS e, label FROM embeddings), n AS (SELECT count(*) AS n FROM v),
p AS (SELECT a.label, b.label AS other, a.e AS a, b.e AS b, {_SHARES.format("a.e")} AS p, {_SHARES.format("b.e")} AS q FROM v a, n JOIN v b ON b.vec_id = (a.vec_id * 7 + 3) % n.n),
k AS (SELECT label, other, a, b, p, {_POSITIVE.format("p")} AS s, {_POSITIVE.format("q")} AS t FROM p)
SELECT label, count(*) AS n, round(avg((label = other)::int), 6) AS exact, round(avg(list_distance(a, b)), 4) AS l2, round(avg(list_sum(list_transform(range(1, len(s) + 1), lambda i: s[i] * ln(s[i] / t[i])))), 4) AS kl,
 round(avg(list_sum(list_transform(p, lambda x: -x * ln(x)))), 4) AS entropy, round(avg(list_max(p)), 4) AS confidence, round(avg((list_position(a, list_max(a)) = list_position(b, list_max(b)))::int), 6) AS agreement FROM k GROUP BY label"""
)
def prediction_drift(spark, sf_dir):
    """Two sets of predictions by key: exact matches of labels, distance, divergence, entropy and agreement."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    total = e.agg(F.count(F.lit(1)).alias("n"))
    other = e.select(F.col("vec_id").alias("at"), F.col("embedding").alias("second"), F.col("label").alias("other"))
    keyed = e.join(F.broadcast(total)).select("vec_id", "embedding", "label", ((F.col("vec_id") * 7 + 3) % F.col("n")).alias("at"))
    p = compare_predictions(keyed, other, "at", "embedding", "second")
    return p.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == F.col("other")).cast("int")), 6).alias("exact"), F.round(F.avg("l2"), 4).alias("l2"), F.round(F.avg("kl"), 4).alias("kl"),
        F.round(F.avg("entropy"), 4).alias("entropy"), F.round(F.avg("confidence"), 4).alias("confidence"), F.round(F.avg(F.col("agrees").cast("int")), 6).alias("agreement"),
    )


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 4) AS cosine, round(list_distance(a.embedding::double[], b.embedding::double[]), 4) AS l2 FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id")
def cosine_compare(spark, sf_dir):
    p = _vector_pairs(spark, sf_dir)
    return p.select("vec_id", F.round(V.cosine(F.col("a"), F.col("b")), 4).alias("cosine"), F.round(V.l2(F.col("a"), F.col("b")), 4).alias("l2"))


@query(
    """WITH u AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding,1) - 1 AS i FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, i) AS r FROM u)
SELECT vec_id, string_agg(i::varchar, ',' ORDER BY r) AS dims FROM r WHERE r <= 5 GROUP BY vec_id"""
)
def topk_dims(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(V.top_parts(F.col("embedding"), 5).cast("array<string>"), ",").alias("dims"))


@query("SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """Hourly windows; the same plan runs on a stream (tests)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return S.windowed_counts(spark.read.schema(schema).parquet(f"{sf_dir}/events.parquet")).select(F.unix_micros("start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH r AS (SELECT lang, source, length(text) AS v, row_number() OVER (PARTITION BY lang, source ORDER BY length(text)) - 1 AS i, count(*) OVER (PARTITION BY lang, source) AS n FROM documents WHERE text IS NOT NULL)
SELECT lang, source, round(avg(v), 4) AS mean, max(v) FILTER (i = least(floor(n * 0.5), n - 1)) AS p50, max(v) FILTER (i = least(floor(n * 0.95::double), n - 1)) AS p95 FROM r GROUP BY lang, source"""
)
def coverage_stats(spark, sf_dir):
    """Mean and nearest-rank quantiles of the text lengths of each language and source."""
    d = read_table(spark, sf_dir, "documents").select("lang", "source", F.length("text").alias("v")).where("v is not null")
    at = lambda share: lambda n: F.least(F.floor(n * share), n - 1)
    q = order_statistics(d, ["lang", "source"], F.col("v"), {"p50": at(0.5), "p95": at(0.95)}).alias("q")
    m = d.groupBy("lang", "source").agg(F.round(F.avg("v"), 4).alias("mean")).alias("m")
    same = F.col("q.lang").eqNullSafe(F.col("m.lang")) & F.col("q.source").eqNullSafe(F.col("m.source"))
    return q.join(m, same).select("q.lang", "q.source", "mean", F.col("p50").cast("bigint").alias("p50"), F.col("p95").cast("bigint").alias("p95"))
