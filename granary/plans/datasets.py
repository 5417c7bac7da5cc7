"""Queries over whole datasets: joins, comparisons, samples, tools, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import hashing as H
from granary.functions import json_text as J
from granary.functions import text as X
from granary.operators import datasets as D
from granary.operators import tools as T
from granary.operators.filters import rejection_reason
from granary.plans.catalog import query
from granary.session import read_table


@query(
    """SELECT doc_id, CASE WHEN quality IS NOT NULL THEN 'tool_use' WHEN length(text) > 8000 THEN 'long_context' ELSE 'plain' END AS task_type,
CASE WHEN toxic = 1 AND quality = 1 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END AS level, coalesce(source,'default') AS source FROM documents LEFT JOIN labels USING (doc_id)"""
)
def normalize_defaults(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    task = F.when(F.col("quality").isNotNull(), "tool_use").when(F.length("text") > 8000, "long_context").otherwise("plain")
    level = F.when((F.col("toxic") == 1) & (F.col("quality") == 1), 2).when(F.col("quality") == 1, 1).otherwise(0)
    return docs.join(labels, "doc_id", "left").select("doc_id", task.alias("task_type"), level.alias("level"), F.coalesce("source", F.lit("default")).alias("source"))


@query(
    """SELECT doc_id, coalesce(quality,0) AS quality, coalesce(toxic, CASE WHEN lang='en' THEN 0 END) AS toxic,
(CASE WHEN quality IS NULL THEN 'quality:unknown ' ELSE '' END) || (CASE WHEN toxic IS NULL AND lang='en' THEN 'toxic:english' ELSE '' END) AS filled FROM documents LEFT JOIN labels USING (doc_id)"""
)
def gap_fill(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang").join(read_table(spark, sf_dir, "labels"), "doc_id", "left")
    out = D.fill_gaps(docs, [("quality", F.lit(0), "unknown"), ("toxic", F.when(F.col("lang") == "en", 0), "english")])
    said = lambda k, v: F.when(F.map_contains_key("filled", k), F.lit(v)).otherwise("")
    return out.select("doc_id", "quality", "toxic", F.concat(said("quality", "quality:unknown "), said("toxic", "toxic:english")).alias("filled"))


@query("SELECT key, count(*) AS n, round(count(*)/(SELECT count(*) FROM events)::double, 6) AS presence FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def field_presence_profile(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    total = events.agg(F.count(F.lit(1)).alias("total"))
    keys = events.select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return keys.crossJoin(F.broadcast(total)).select("key", "n", F.round(F.col("n") / F.col("total"), 6).alias("presence"))


@query(
    """
WITH k AS (SELECT event_type, unnest(json_keys(props)) AS key FROM events), a AS (SELECT key, count(*)::double/(SELECT count(*) FROM events WHERE event_type='view') AS p FROM k WHERE event_type='view' GROUP BY key),
b AS (SELECT key, count(*)::double/(SELECT count(*) FROM events WHERE event_type='click') AS p FROM k WHERE event_type='click' GROUP BY key)
SELECT key, CASE WHEN b.p IS NULL THEN 'removed' WHEN a.p IS NULL THEN 'added' WHEN abs(a.p-b.p) > 0.05 THEN 'changed' ELSE 'same' END AS status FROM a FULL OUTER JOIN b USING (key)"""
)
def schema_drift(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")

    def profile(kind: str, name: str):
        own = events.where(F.col("event_type") == kind)
        total = own.agg(F.count(F.lit(1)).alias("total"))
        keys = own.select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        return keys.crossJoin(F.broadcast(total)).select("key", (F.col("n") / F.col("total")).alias(name))

    both = profile("view", "a").join(profile("click", "b"), "key", "full_outer")
    status = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(F.abs(F.col("a") - F.col("b")) > 0.05, "changed").otherwise("same")
    return both.select("key", status.alias("status"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (json_valid(props)) AS valid, count(*) FILTER (NOT json_valid(props)) AS broken FROM events GROUP BY event_type")
def json_validity(spark, sf_dir):
    ok = J.is_valid(F.col("props"))
    return read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("broken"))


_OBJECTS = r"regexp_extract_all(html, '\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}')"


@query(
    rf"""WITH o AS (SELECT {_OBJECTS} AS o FROM pages), f AS (SELECT o, len(list_filter(o, lambda x: json_valid(x))) > 0 AS ok, coalesce(json_valid(regexp_replace(replace(o[1], chr(39), chr(34)), ',\s*([}}\]])', '\1', 'g')), false) AS mended FROM o)
SELECT count(*) AS total, count(*) FILTER (len(o) > 0) AS has_json, count(*) FILTER (ok) AS valid, count(*) FILTER (mended AND NOT ok) AS needs_repair FROM f"""
)
def repair_stats(spark, sf_dir):
    t = F.col("html")
    return read_table(spark, sf_dir, "pages").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size(J.objects(t)) > 0).alias("has_json"), F.count_if(J.has_valid(t)).alias("valid"), F.count_if(J.needs_repair(t)).alias("needs_repair"))


@query(
    f"""WITH o AS (SELECT page_id, list_filter({_OBJECTS}, lambda x: CASE WHEN json_valid(x) THEN json_extract_string(x, '$.name') IS NOT NULL ELSE false END) AS o FROM pages) SELECT page_id, len(o)::int AS n_calls, o[1] AS first_call FROM o"""
)
def tool_call_extract(spark, sf_dir):
    """The first object with a name in every page."""
    calls = F.filter(J.objects(F.col("html")), lambda o: F.get_json_object(o, "$.name").isNotNull())
    return read_table(spark, sf_dir, "pages").select("page_id", F.size(calls).alias("n_calls"), F.get(calls, 0).alias("first_call"))


@query(
    """SELECT event_id, CASE WHEN json_extract_string(props,'$.k') IS NULL THEN 'missing:k' ELSE array_to_string(list_filter([CASE WHEN (json_extract_string(props,'$.k'))::int < 10 THEN 'min:k' END,
CASE WHEN (json_extract_string(props,'$.k'))::int > 50 THEN 'max:k' END], lambda x: x IS NOT NULL), ',') END AS errors FROM events"""
)
def args_validate(spark, sf_dir):
    errors = T.argument_errors(F.col("props"), ("k",), {"k": ("integer", None, 10, 50)})
    return read_table(spark, sf_dir, "events").select("event_id", F.array_join(errors, ",").alias("errors"))


@query(
    """SELECT event_type, count(*) AS calls, count(*) FILTER (event_type IN ('view','click') AND json_extract_string(props,'$.k')::int BETWEEN 0 AND 20) AS hits FROM events GROUP BY event_type"""
)
def broker_join(spark, sf_dir):
    calls = read_table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("name"), F.col("props").alias("args"))
    rows = [(name, f'{{ "k" : {k}, "gone": null }}', f"{name}-{k}") for name in ("view", "click") for k in range(21)]
    fixtures = spark.createDataFrame(rows, "name string, key string, result string")
    return T.lookup(calls, fixtures).groupBy(F.col("name").alias("event_type")).agg(F.count(F.lit(1)).alias("calls"), F.count_if("hit").alias("hits"))


@query("SELECT CASE WHEN json_extract_string(props,'$.k') IS NULL THEN 'none' ELSE 'partial' END AS match, count(*) AS n FROM events GROUP BY 1")
def key_set_match(spark, sf_dir):
    registry = spark.createDataFrame([("counter", ["k", "unit"]), ("other", ["a", "b"])], "tool string, properties array<string>")
    events = read_table(spark, sf_dir, "events").select("event_id", J.keys(F.col("props")).alias("keys"))
    return T.match_by_keys(events, "keys", registry).groupBy("match").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT coalesce(reason,'accepted') AS reason, count(*) AS n FROM (SELECT CASE WHEN event_type NOT IN ('view','click','purchase') THEN 'unknown_tool' WHEN NOT json_valid(props) THEN 'malformed_json'
WHEN value > 50 AND user_id % 2 = 1 THEN 'inconsistent_tier' END AS reason FROM events) GROUP BY 1"""
)
def rejection_cascade(spark, sf_dir):
    none = F.array().cast("array<int>")
    reason = rejection_reason(F.col("event_type"), F.col("props"), ("view", "click", "purchase"), F.when(F.col("value") > 50, 1).otherwise(0), F.col("user_id") % 2 == 0, none, none)
    return read_table(spark, sf_dir, "events").select(F.coalesce(reason, F.lit("accepted")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN d.source ELSE 'labelled' END AS source, CASE WHEN l.doc_id IS NULL THEN d.n_chars ELSE l.quality END AS n_chars FROM documents d LEFT JOIN labels l USING (doc_id)")
def upsert_backfill(spark, sf_dir):
    main = read_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    changes = read_table(spark, sf_dir, "labels").select("doc_id", F.lit("labelled").alias("source"), F.col("quality").cast("bigint").alias("n_chars"))
    return D.upsert(main, changes, "doc_id")


@query(
    """SELECT 'both' AS side, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL
SELECT 'documents', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"""
)
def linkage_semi_anti(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id"), read_table(spark, sf_dir, "labels").select("doc_id")
    count = lambda df, name: df.agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("n")).select("side", "n")
    return count(docs.join(labels, "doc_id", "left_semi"), "both").unionByName(count(docs.join(labels, "doc_id", "left_anti"), "documents")).unionByName(count(labels.join(docs, "doc_id", "left_anti"), "labels"))


_REVERSED = "||".join(f"substr(sha256(doc_id::varchar),{2 * i + 1},2)" for i in range(7, -1, -1))


@query(f"SELECT doc_id, (('0x' || {_REVERSED})::ubigint % 7)::int AS shard FROM documents")
def shard_assign(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", H.stable_shard(F.col("doc_id"), 7).alias("shard"))


@query("SELECT 0::bigint AS missing, 0::bigint AS extra, 0::bigint AS in_several, count(*) AS total FROM documents")
def shard_completeness(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    shards = docs.withColumn("shard", H.stable_shard(F.col("doc_id"), 7))
    per = shards.groupBy("doc_id").agg(F.count_distinct("shard").alias("n"))
    both = docs.withColumn("a", F.lit(1)).join(per.withColumn("b", F.lit(1)), "doc_id", "full_outer")
    return both.agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"), F.count_if(F.col("n") > 1).alias("in_several"), F.count(F.lit(1)).alias("total"))


@query(
    """WITH a AS (SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END AS lang, n_chars FROM documents WHERE doc_id % 3 <> 0)
SELECT status, count(*) AS n FROM (SELECT CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'extra' WHEN a.lang IS NOT DISTINCT FROM b.lang AND a.n_chars IS NOT DISTINCT FROM b.n_chars THEN 'same' ELSE 'mismatch' END AS status FROM a FULL OUTER JOIN b USING (doc_id)) GROUP BY status"""
)
def full_outer_compare(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    a = docs.where("doc_id % 5 <> 0")
    b = docs.where("doc_id % 3 <> 0").withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang")))
    return D.compare_rows(a, b, "doc_id").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH s AS (SELECT event_type AS metric, count(*) FILTER (user_id % 2 = 0) AS a, count(*) FILTER (user_id % 2 = 1) AS b FROM events GROUP BY 1)
SELECT metric, a, b, b - a AS delta, abs(a-b) <= greatest(1e-6, 0.05*greatest(a,b)) AS close FROM s"""
)
def report_diff(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    side = lambda r, name: events.where(F.col("user_id") % 2 == r).groupBy(F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).alias(name))
    both = side(0, "a").join(side(1, "b"), "metric", "full_outer").fillna(0, ["a", "b"])
    return both.select("metric", "a", "b", (F.col("b") - F.col("a")).alias("delta"), D.close(F.col("a").cast("double"), F.col("b").cast("double"), 1e-6, 0.05).alias("close"))


_SEEDED = "sha256(doc_id::varchar || '|42')"


@query(
    f"""WITH t AS (SELECT * FROM (VALUES ('en',300),('fr',50),('de',200)) v(lang,want)), r AS (SELECT doc_id, lang, want, row_number() OVER (PARTITION BY lang ORDER BY {_SEEDED}, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS size FROM documents JOIN t USING (lang))
SELECT doc_id, lang, unnest(range(((want - r)//size + 1)::bigint))::int AS copy FROM r WHERE r <= want"""
)
def stratified_sample(spark, sf_dir):
    return D.stratified_sample(read_table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", {"en": 300, "fr": 50, "de": 200})


@query(
    f"""WITH c AS (SELECT count(*) AS total, count(*) FILTER (lang='fr') AS fr, count(*) FILTER (lang='de') AS de, count(*) FILTER (lang='en') AS en FROM documents),
m AS (SELECT greatest(0, least(en, floor(total*0.25)-fr)) AS a, en, total, de FROM c), m2 AS (SELECT a, greatest(0, least(en - a, floor(total*0.2)-de)) AS b FROM m),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_SEEDED}, doc_id) AS r FROM documents)
SELECT doc_id, lang, CASE WHEN lang='en' AND r <= a THEN 'fr' WHEN lang='en' AND r <= a+b THEN 'de' ELSE lang END AS balanced FROM r, m2"""
)
def balance_labels(spark, sf_dir):
    return D.rebalance(read_table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", "en", {"fr": 0.25, "de": 0.2})


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_SEEDED}, doc_id) <= floor((SELECT count(*) FROM documents)*0.15) THEN 'val' ELSE 'train' END AS split FROM documents")
def train_val_split(spark, sf_dir):
    return D.split_exactly(read_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.15)


@query(
    """WITH u AS (SELECT text, 'documents' AS origin, doc_id AS id, lang FROM documents UNION ALL SELECT text, 'benchmark', item_id, NULL FROM benchmark UNION ALL SELECT text, 'documents', doc_id, lang FROM documents WHERE n_chars < 1000),
k AS (SELECT origin, row_number() OVER (PARTITION BY sha256(text) ORDER BY origin, id) AS r, lang FROM u) SELECT origin, coalesce(lang,'none') AS lang, count(*) AS n FROM k WHERE r = 1 GROUP BY 1, 2"""
)
def merge_union(spark, sf_dir):
    from granary.operators.ordered import keep_first

    docs = read_table(spark, sf_dir, "documents")
    own = docs.select("text", F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "lang")
    items = read_table(spark, sf_dir, "benchmark").select("text", F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"))
    short = docs.where("n_chars < 1000").select("text", F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "lang")
    rows = own.unionByName(items, allowMissingColumns=True).unionByName(short).select("origin", "id", "lang", F.sha2("text", 256).alias("digest"))
    kept = keep_first(rows, [F.col("digest")], [F.col("origin"), F.col("id")])
    return kept.groupBy("origin", F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, sum((length(text)//4)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS tokens_so_far, sum((length(text)//4)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) * 6 > 1000000 AS over_budget FROM documents")
def running_budget(spark, sf_dir):
    from granary.operators.ordered import running_sum

    docs = read_table(spark, sf_dir, "documents").select("doc_id", X.estimated_tokens(F.col("text")).alias("tokens"))
    out = running_sum(docs, "doc_id", F.col("tokens"), "tokens_so_far")
    return out.select("doc_id", "tokens_so_far", (F.col("tokens_so_far") * 6 > 1000000).alias("over_budget"))


@query(
    f"""WITH r AS (SELECT doc_id, source, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY {_SEEDED}, doc_id) AS r FROM documents)
SELECT a.source, a.doc_id AS a_id, b.doc_id AS b_id, CASE WHEN a.n > 1.2*b.n THEN 'a' WHEN b.n > 1.2*a.n THEN 'b' ELSE 'tie' END AS winner FROM r a JOIN r b ON a.source=b.source AND a.r + 1 = b.r AND a.r % 2 = 1"""
)
def pair_build(spark, sf_dir):
    """Neighbours of a seeded order within a source are pairs; the clearly longer text wins."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(H.seeded(F.col("doc_id"), 42), "doc_id")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("n"))
    docs = docs.withColumn("r", F.row_number().over(w)).withColumn("b_id", F.lead("doc_id").over(w)).withColumn("m", F.lead("n").over(w))
    winner = F.when(F.col("n") > 1.2 * F.col("m"), "a").when(F.col("m") > 1.2 * F.col("n"), "b").otherwise("tie")
    return docs.where("r % 2 = 1 and b_id is not null").select("source", F.col("doc_id").alias("a_id"), "b_id", winner.alias("winner"))
