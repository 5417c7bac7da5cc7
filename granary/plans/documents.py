"""Queries over document texts: filters, duplicates, personal data, quality, claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import hashing as H
from granary.functions import text as X
from granary.operators.filters import cascade_reasons
from granary.operators.ordered import keep_first
from granary.plans.catalog import query
from granary.plans.judging import _CONFIDENCE, _MARKED, _SPLIT_WORDS, _VERIFIABLE
from granary.session import read_spread, read_table

# SQL pieces of the texts' rules.
_STRIP = r"regexp_replace(coalesce(text,''), '^\s+|\s+$', '', 'g')"
_TRUNCATED = rf"""({_STRIP} <> '' AND ((NOT regexp_matches({_STRIP}, '[.!?]$') AND contains(substr({_STRIP}, greatest(length({_STRIP}) - 49, 1)), ' '))
  OR ends_with({_STRIP}, '...') OR ends_with({_STRIP}, '…') OR ends_with({_STRIP}, '*')))"""
_N_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"


@query(
    rf"""
WITH r AS (SELECT doc_id, text, CASE WHEN {_STRIP} = '' THEN 'empty' WHEN length(text) < 200 THEN 'min_length' WHEN length(text) > 20000 THEN 'max_length'
  WHEN {_TRUNCATED} THEN 'truncated' END AS reason FROM documents),
d AS (SELECT coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY reason, sha256(text) ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'passed' END) AS reason FROM r)
SELECT reason, count(*) AS n FROM d GROUP BY reason"""
)
def filter_cascade(spark, sf_dir):
    docs = read_spread(spark, sf_dir, "documents", "doc_id", "text")
    return cascade_reasons(docs, min_length=200, max_length=20000, remove_truncated=True, dedupe=True).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, {_TRUNCATED} AS truncated FROM documents")
def truncation_flags(spark, sf_dir):
    return read_spread(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", X.is_truncated(F.col("text")).alias("truncated"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents GROUP BY sha256(text)")
def dedupe_exact(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return keep_first(docs, [F.col("digest")], [F.col("doc_id")]).select("doc_id", "digest")


@query("SELECT max(doc_id) AS doc_id, substr(sha256(substr(source,1,500) || chr(10) || substr(text,1,500)),1,16) AS digest FROM documents GROUP BY 2")
def dedupe_prefix_hash(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", H.short_hash(F.substring("source", 1, 500), F.substring("text", 1, 500)).alias("digest"))
    return keep_first(docs, [F.col("digest")], [F.col("doc_id")], last=True).select("doc_id", "digest")


@query("SELECT doc_id, 'data-worker-' || substr(sha256('{\"prompt\": \"' || source || '\", \"text\": \"' || text || '\"}'),1,16) AS sample_id FROM documents")
def sample_hash_ids(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    body = F.concat(F.lit('{"prompt": "'), "source", F.lit('", "text": "'), "text", F.lit('"}'))
    return docs.select("doc_id", F.concat_ws("-", F.lit("data"), F.lit("worker"), F.substring(F.sha2(body, 256), 1, 16)).alias("sample_id"))


@query("SELECT CASE WHEN length(text)//4 <= 200 THEN 200 WHEN length(text)//4 <= 400 THEN 400 ELSE 800 END AS bucket, count(*) AS n, sum(length(text)//4) AS tokens FROM documents GROUP BY 1")
def length_buckets(spark, sf_dir):
    t = X.estimated_tokens(F.col("text"))
    return read_table(spark, sf_dir, "documents").select(t.alias("t"), X.length_bucket(t).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("tokens"))


@query(
    """
WITH h AS (SELECT doc_id, text, substr(text,1,1600) AS head FROM documents),
p AS (SELECT *, CASE WHEN instr(head,'.')>0 THEN 1601 - instr(reverse(head),'.') - (1600-length(head)) ELSE 0 END AS dot, CASE WHEN instr(head,chr(10))>0 THEN 1601 - instr(reverse(head),chr(10)) - (1600-length(head)) ELSE 0 END AS nl FROM h)
SELECT doc_id, md5(CASE WHEN length(text)<=1600 THEN text WHEN greatest(dot,nl)-1 > 1280 THEN CASE WHEN dot > nl THEN substr(head,1,dot) ELSE substr(head,1,nl-1) END ELSE head END) AS draft_md5 FROM p"""
)
def draft_segments(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(X.draft_segment(F.col("text"))).alias("draft_md5"))


def _sql_quantile(p: float) -> str:
    """Linear and exclusive quantile of text lengths."""
    at = "(SELECT n FROM s WHERE r = {})".format
    j = f"greatest(1, least((SELECT max(c) FROM s) - 1, floor({p} * ((SELECT max(c) FROM s) + 1))))::bigint"
    low = at(j)
    return f"SELECT 'p{round(p * 100)}' AS measure, (SELECT round(quantile_cont(n, {p}), 4) FROM s) AS linear, round({low} + ({p}::double * ((SELECT max(c) FROM s) + 1) - {j}) * ({at(j + ' + 1')} - {low}), 4) AS exclusive"


@query("WITH s AS (SELECT length(text) AS n, row_number() OVER (ORDER BY length(text)) AS r, count(*) OVER () AS c FROM documents) " + " UNION ALL ".join(map(_sql_quantile, (0.1, 0.25, 0.5, 0.75, 0.9))))
def length_profile(spark, sf_dir):
    """Quantiles of text lengths, linear and exclusive; lengths are counted before they are ordered."""
    from granary.operators.quantiles import exclusive_and_linear

    return exclusive_and_linear(read_table(spark, sf_dir, "documents").select(F.length("text").cast("bigint").alias("v")), [0.1, 0.25, 0.5, 0.75, 0.9])


@query(
    """
SELECT source, lang, count(*) AS n, grouping(source) AS g_source, grouping(lang) AS g_lang, round(100.0*count(*)/(SELECT count(*) FROM documents),4) AS pct
FROM documents GROUP BY GROUPING SETS ((source),(lang),())"""
)
def source_lang_distribution(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("source", "lang")
    sets = docs.groupingSets([["source"], ["lang"], []], "source", "lang").agg(F.count(F.lit(1)).alias("n"), F.grouping("source").alias("g_source"), F.grouping("lang").alias("g_lang"))
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    return sets.crossJoin(F.broadcast(total)).select("source", "lang", "n", F.col("g_source").cast("bigint").alias("g_source"), F.col("g_lang").cast("bigint").alias("g_lang"), F.round(F.lit(100.0) * F.col("n") / F.col("total"), 4).alias("pct"))


_BUCKET = "CASE WHEN length(text)//4 <= 200 THEN 'b200' WHEN length(text)//4 <= 400 THEN 'b400' ELSE 'b800' END"


@query(f"SELECT lang, count(*) FILTER ({_BUCKET}='b200') AS b200, count(*) FILTER ({_BUCKET}='b400') AS b400, count(*) FILTER ({_BUCKET}='b800') AS b800 FROM documents GROUP BY lang")
def stratification_heatmap(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("lang", F.concat(F.lit("b"), X.length_bucket(X.estimated_tokens(F.col("text"))).cast("string")).alias("bucket"))
    out = docs.groupBy("lang").pivot("bucket", ["b200", "b400", "b800"]).count()
    return out.select("lang", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("b200", "b400", "b800")])


@query(
    f"""
WITH g AS (SELECT l.lang, b.bucket, b.least FROM (SELECT unnest(['en','fr','de','es','it']) AS lang) l, (SELECT unnest(['b200','b400','b800']) AS bucket, unnest([50,40,30]) AS least) b),
c AS (SELECT lang, {_BUCKET} AS bucket, count(*) AS n FROM documents GROUP BY 1,2)
SELECT g.lang, g.bucket, least, coalesce(n,0) AS n FROM g LEFT JOIN c USING (lang,bucket) WHERE coalesce(n,0) < least"""
)
def missing_cells(spark, sf_dir):
    grid = spark.createDataFrame([(g, b, n) for g in ("en", "fr", "de", "es", "it") for b, n in (("b200", 50), ("b400", 40), ("b800", 30))], "lang string, bucket string, least int")
    docs = read_table(spark, sf_dir, "documents").select("lang", F.concat(F.lit("b"), X.length_bucket(X.estimated_tokens(F.col("text"))).cast("string")).alias("bucket"))
    counts = docs.groupBy("lang", "bucket").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["lang", "bucket"], "left").select("lang", "bucket", "least", F.coalesce("n", F.lit(0)).alias("n")).where("n < least")


@query("SELECT count(*) AS total, count(*) FILTER (length(text)+length(source)>8000) AS long_context, count(lang) AS with_lang, count(*) FILTER (contains(text,'{')) AS with_json, count(DISTINCT text) AS unique_texts FROM documents")
def dataset_stats(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.length("text") + F.length("source") > 8000).alias("long_context"), F.count("lang").alias("with_lang"),
        F.count_if(F.contains("text", F.lit("{"))).alias("with_json"), F.countDistinct(F.sha2("text", 256)).alias("unique_texts"),
    )


_E, _U, _P, _C = r"[\w\.-]+@[\w\.-]+", X.UUID, X.PHONE_US, X.CARD_GROUPS


def _sql_redact(c: str) -> str:
    for pattern, mark in ((X.EMAIL, "EMAIL"), (X.UUID, "UUID"), (X.PHONE_US, "PHONE"), (X.PHONE_INTERNATIONAL, "PHONE"), (X.CARD_GROUPS, "CC"), (X.CARD_DIGITS, "CC")):
        c = f"regexp_replace({c}, '{pattern}', '[REDACTED_{mark}]', 'g')"
    return c


@query(f"SELECT doc_id, md5({_sql_redact('text')}) AS redacted_md5 FROM documents")
def pii_redact(spark, sf_dir):
    return read_spread(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(X.redact(F.col("text"))).alias("redacted_md5"))


def _sql_count(p: str, c: str = "text") -> str:
    return f"len(regexp_extract_all({c}, '{p}'))"


@query(f"SELECT doc_id, {_sql_count(_E)} AS emails, {_sql_count(_U)} AS uuids, {_sql_count(_P)} AS phones, {_sql_count(_C)} AS cards FROM documents")
def pii_counts(spark, sf_dir):
    t = F.col("text")
    return read_spread(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", X.count_matches(t, _E).alias("emails"), X.count_matches(t, _U).alias("uuids"), X.count_matches(t, _P).alias("phones"), X.count_matches(t, _C).alias("cards"))


_ADDRESSES = rf"list_concat(regexp_extract_all(text, '{X.EMAIL}'), regexp_extract_all(text, '{X.PHONE_BOUNDED}'))"
_AROUND = "lower(substr(text, greatest(strpos(text, x) - 30, 1), strpos(text, x) + length(x) + 30 - greatest(strpos(text, x) - 30, 1)))"
_HOSTS_OF_TEXT = r"list_transform(regexp_extract_all(text, 'https?://([^/\s]+)', 1), lambda h: regexp_replace(lower(h), '^www\.', ''))"


@query(
    rf"""WITH a AS (SELECT *, list_transform({_ADDRESSES}, lambda x: CASE WHEN regexp_matches({_AROUND}, 'invoice|ssn|patient|claim|medical|financial') THEN 'high' WHEN regexp_matches({_AROUND}, 'contact|support|careers|press|help|info') THEN 'contextual' ELSE 'medium' END) AS k,
len(regexp_extract_all(text, '{X.UUID}')) AS uuids, {_HOSTS_OF_TEXT} AS hosts FROM documents), b AS (SELECT *, len(list_filter(hosts, lambda h: h NOT IN ('example.com','example.org','example.net'))) = 0 AS ok FROM a)
SELECT doc_id, len(regexp_extract_all(text, '{X.EMAIL}')) AS emails_found, uuids AS uuids_found, len(hosts) AS urls_found, ok AS url_allowlist_ok, len(list_filter(k, lambda x: x = 'high')) AS high_severity, len(list_filter(k, lambda x: x = 'medium')) AS medium_severity,
len(list_filter(k, lambda x: x = 'contextual')) AS contextual, len(k) = 0 AND uuids = 0 AND ok AS privacy_ok FROM b"""
)
def privacy_severity(spark, sf_dir):
    return read_spread(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", X.privacy(F.col("text")).alias("p")).select("doc_id", "p.*")


_HOSTS = r"list_transform(regexp_extract_all(html, 'https?://([^/\s]+)', 1), lambda h: regexp_replace(lower(h), '^www\.', ''))"


@query(f"SELECT page_id, len({_HOSTS}) AS n_urls, len(list_filter({_HOSTS}, lambda h: h NOT IN ('example.com','example.org','example.net'))) = 0 AS allowed FROM pages")
def url_allowlist(spark, sf_dir):
    h = F.col("html")
    return read_table(spark, sf_dir, "pages").select("page_id", F.size(X.hosts(h)).cast("bigint").alias("n_urls"), X.urls_allowed(h).alias("allowed"))


@query(
    rf"""
WITH e AS (SELECT unnest(list_filter([CASE WHEN source NOT IN ('src0','src1','src2','src3') THEN 'unknown_source' END, CASE WHEN lang NOT IN ('en','fr') THEN 'license_missing' END,
  CASE WHEN regexp_matches(text, '\b\d{{3}}-\d{{2}}-\d{{4}}\b') THEN 'ssn' END, CASE WHEN regexp_matches(text, '{X.EMAIL}') THEN 'email' END], lambda x: x IS NOT NULL)) AS error FROM documents)
SELECT error, count(*) AS n FROM e GROUP BY error"""
)
def provenance_whitelist(spark, sf_dir):
    from granary.operators.filters import provenance_errors

    docs = read_table(spark, sf_dir, "documents")
    errors = provenance_errors(F.col("source"), F.col("lang"), F.col("text"), ("src0", "src1", "src2", "src3"), ("en", "fr"))
    return docs.select(F.explode(errors).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


_UNIQUE = r"len(list_distinct(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')))"
_HEUR = rf"""CASE WHEN {_STRIP} = '' THEN 0.0 ELSE greatest(0.0, least(1.0, 0.5::double
 + CASE WHEN contains(text,'```') OR (contains(text,'{{') AND contains(text,'}}')) THEN 0.2 WHEN contains(substr(text,1,200),'- ') OR contains(substr(text,1,200),'1. ') OR contains(text,'##') THEN 0.1 ELSE 0.0 END::double
 + CASE WHEN {_N_WORDS} BETWEEN 50 AND 500 THEN 0.15 WHEN {_N_WORDS} BETWEEN 20 AND 49 THEN 0.05 WHEN {_N_WORDS} < 10 THEN -0.3 WHEN {_N_WORDS} > 2000 THEN -0.1 ELSE 0.0 END::double
 + CASE WHEN {_N_WORDS} > 10 THEN CASE WHEN {_UNIQUE}/{_N_WORDS}::double < 0.3 THEN -0.2 WHEN {_UNIQUE}/{_N_WORDS}::double > 0.7 THEN 0.05 ELSE 0.0 END ELSE 0.0 END::double
 + CASE WHEN contains(lower(text),'undefined')::int + contains(lower(text),'error:')::int + contains(lower(text),'exception:')::int + contains(lower(text),'failed')::int + contains(lower(text),'cannot')::int > 2 THEN -0.2 ELSE 0.0 END::double)) END"""


@query(f"SELECT doc_id, round({_HEUR}, 4)::double AS score FROM documents")
def quality_heuristic(spark, sf_dir):
    return read_spread(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.round(X.heuristic_quality(F.col("text")), 4).alias("score"))


_STRUCT = rf"""CASE WHEN {_STRIP} = '' THEN 0.0 ELSE least(1.0,
 (contains(lower(html_text),'working spec')::int + contains(lower(html_text),'invariants')::int + contains(lower(html_text),'acceptance')::int)/3.0::double*0.4
 + contains(html_text,'```')::int*0.1::double + (regexp_matches(html_text,'\{{[^{{}}]*\}}')::int*0.15::double + regexp_matches(html_text,'(?m)^[\s]*[-*]|\d+\.')::int*0.1::double + regexp_matches(html_text,'(?m)^#+\s')::int*0.1::double)*0.2
 + CASE WHEN {_N_WORDS} > 50 THEN 0.7 WHEN {_N_WORDS} < 10 THEN 0.2 ELSE 0.5 END::double*0.2) END"""


@query("SELECT doc_id, round(" + _STRUCT.replace("html_text", "text") + ", 4)::double AS score FROM documents")
def structure_score(spark, sf_dir):
    return read_spread(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.round(X.structure_score(F.col("text")), 4).alias("score"))


_OBJECTS = r"regexp_extract_all(text, '\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}')"
_FENCED = r"regexp_extract_all(text, '(?s)```(\w+)?\n(.*?)```', {0})"


@query(
    rf"""WITH d AS (SELECT doc_id, {_HEUR} AS h, {_OBJECTS} AS o, {_FENCED.format(2)} AS codes, {_FENCED.format(1)} AS names FROM documents),
b AS (SELECT *, CASE WHEN len(o) = 0 THEN 0.0 ELSE len(list_filter(o, lambda x: json_valid(x)))/len(o)::double END AS v, coalesce(list_sum(list_transform(codes, lambda x: CASE WHEN len(string_split(x, chr(10))) BETWEEN 5 AND 100 THEN 0.1 WHEN len(string_split(x, chr(10))) < 2 THEN -0.1 ELSE 0.0 END)), 0) AS parts FROM d)
SELECT doc_id, round(h::double*0.6::double + v::double*0.2::double + CASE WHEN len(codes) = 0 THEN 0.0 ELSE least(1.0, (0.5 + CASE WHEN len(list_filter(names, lambda x: x <> '')) > 0 THEN 0.2 ELSE 0.0 END + parts)/len(codes)) END::double*0.2::double, 4) AS score FROM b"""
)
def composite_quality(spark, sf_dir):
    """Weighted heuristic, JSON and code-block scores."""
    from granary.functions.json_text import validity_score

    t = F.col("text")
    score = X.heuristic_quality(t) * 0.6 + validity_score(t) * 0.2 + X.code_block_score(t) * 0.2
    return read_spread(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.round(score, 4).alias("score"))


def _sql_bounds(p: str) -> str:
    """The pattern with word bounds of all letters: this dialect's own know ASCII only."""
    return p.replace(r"\b(", r"(^|[^\p{L}\p{N}_])(").replace(r")\b", r")($|[^\p{L}\p{N}_])")


@query(
    "SELECT category, count(*) AS n FROM (SELECT unnest(list_filter(["
    + ",".join(f"CASE WHEN regexp_matches(text, '{_sql_bounds(p)}') THEN '{k}' END" for k, p in X.CATEGORIES.items())
    + "], lambda x: x IS NOT NULL)) AS category FROM documents) GROUP BY category"
)
def claim_categories(spark, sf_dir):
    return read_spread(spark, sf_dir, "documents", "doc_id", "text").select(F.explode(X.categories(F.col("text"))).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


_BLANKS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_SENTENCES = r"regexp_split_to_array(text, '[.!?]\s+')"
_PARTS = rf"list_filter(list_transform(regexp_split_to_array(text, '\s+(?:and|or|but)\s+|\s*,\s+'), lambda x: trim(x, {_BLANKS})), lambda x: x <> '' AND lower(x) NOT IN ('and','or','but',','))"
_CLAIMS = f"""s AS (SELECT doc_id, unnest({_SENTENCES}) AS raw, generate_subscripts({_SENTENCES}, 1) AS si FROM documents), u AS (SELECT *, {_SPLIT_WORDS} FROM (SELECT doc_id, si, trim(raw, {_BLANKS}) AS text FROM s) WHERE text <> ''),
v AS (SELECT doc_id, si, text FROM (SELECT {_MARKED} FROM u) WHERE {_VERIFIABLE} AND NOT hedged), a AS (SELECT doc_id, si, CASE WHEN len({_PARTS}) <= 1 THEN [text] ELSE {_PARTS} END AS parts FROM v),
x AS (SELECT doc_id, si, unnest(parts) AS text, generate_subscripts(parts, 1) AS ai FROM a)"""


@query(
    f"""WITH {_CLAIMS}, y AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY si, ai) - 1)::int AS pos, text, {_SPLIT_WORDS} FROM x), z AS (SELECT {_MARKED} FROM y) SELECT doc_id, pos, text AS statement, {_CONFIDENCE} AS confidence FROM z"""
)
def claim_extract(spark, sf_dir):
    """Claims of every document with their confidence."""
    docs = read_spread(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode(X.claims(F.col("text"))).alias("pos", "statement"))
    return docs.select("doc_id", "pos", "statement", F.round(X.claim_confidence(F.col("statement")), 4).alias("confidence"))


@query(
    f"""WITH {_CLAIMS}, c AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id), t AS (SELECT doc_id, len(list_filter({_SENTENCES}, lambda x: trim(x, {_BLANKS}) <> ''))::int AS total FROM documents)
SELECT doc_id, coalesce(n, 0)::int AS n_claims, total AS n_sentences, CASE WHEN total > 0 THEN least(1.0, coalesce(n, 0)/total::double) ELSE 0.0 END::double AS success_rate FROM t LEFT JOIN c USING (doc_id)"""
)
def claim_metrics(spark, sf_dir):
    """Claims and sentences of a text, and their ratio."""
    docs = read_spread(spark, sf_dir, "documents", "doc_id", "text")
    n = F.size(X.claims(F.col("text")))
    total = F.size(F.filter(F.split("text", r"[.!?]\s+"), lambda s: X.strip(s) != ""))
    return docs.select("doc_id", n.alias("n_claims"), total.alias("n_sentences"), F.when(total > 0, F.least(F.lit(1.0), n / total)).otherwise(0.0).alias("success_rate"))


@query(f"SELECT lang, count(*) AS n, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END),6) AS good_rate, round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END),6) AS toxic_rate FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def category_rates(spark, sf_dir):
    d, lab = read_table(spark, sf_dir, "documents").select("doc_id", "lang"), read_table(spark, sf_dir, "labels")
    rate = lambda c: F.round(F.avg(F.when(F.col(c) == 1, 1.0).otherwise(0.0)), 6)
    return d.join(lab, "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), rate("quality").alias("good_rate"), rate("toxic").alias("toxic_rate"))
