"""Queries over records built from the tables: pairs, validators, reports, spans, captures."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import spans as P
from granary.functions import text as X
from granary.operators import records as R
from granary.operators import reports as Q
from granary.operators import validators as V
from granary.plans.catalog import query
from granary.session import Scratch, read_table
from granary.sources import generators as N
from granary.sources import ndjson
from granary.streaming import windows as S

_PAIRS = "SELECT doc_id, CASE WHEN n_chars % 4 < 2 THEN 'a' WHEN n_chars % 4 = 2 THEN 'b' ELSE 'tie' END AS winner FROM documents"


def _pairs(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    side = lambda name: F.struct(F.lit(f"text {name}").alias("text"), F.array(F.lit("GATE_INTEGRITY")).alias("clauses"))
    m = F.col("n_chars") % 4
    return d.select("doc_id", side("a").alias("a"), side("b").alias("b"), F.when(m < 2, "a").when(m == 2, "b").otherwise("tie").alias("winner"), F.lit("Solution A is better").alias("reasons"))


@query(
    f"""WITH p AS ({_PAIRS}), c AS (SELECT count(*) AS n, count(*) FILTER (winner='a') AS a, count(*) FILTER (winner='b') AS b, count(*) FILTER (winner='tie') AS t FROM p),
m AS (SELECT *, greatest(0, least(a, floor(n*0.42)::bigint - b)) AS x FROM c), k AS (SELECT *, greatest(0, least(a - x, floor(n*0.16)::bigint - t)) AS y FROM m)
SELECT 'a' AS winner, a - x - y AS n FROM k UNION ALL SELECT 'b', b + x FROM k UNION ALL SELECT 'tie', t + y FROM k"""
)
def winner_balance(spark, sf_dir):
    return R.balance_winners(_pairs(spark, sf_dir), "doc_id").groupBy("winner").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT winner, CASE winner WHEN 'a' THEN 'Solution B is better' ELSE 'Solution B is better' END AS reasons, count(*) AS n FROM (SELECT CASE winner WHEN 'a' THEN 'b' WHEN 'b' THEN 'a' ELSE 'tie' END AS winner FROM ({_PAIRS})) GROUP BY 1, 2"""
)
def swapped_pairs(spark, sf_dir):
    return R.swap_sides(_pairs(spark, sf_dir)).groupBy("winner", "reasons").agg(F.count(F.lit(1)).alias("n"))


_SIDE = "struct<text:string,clauses:array<string>,change_diff:string,rationale:string,evidence_manifest:struct<claims:array<string>,verification_status:string,evidence_references:array<string>>,provenance_chain:struct<steps:array<string>,audit_trail:string>>"


@query(
    """WITH d AS (SELECT doc_id, lower(text) AS p FROM documents)
SELECT doc_id, CASE WHEN contains(p,'pleading') OR contains(p,'submits change') OR contains(p,'evidence manifest') THEN 'pleading' WHEN contains(p,'examination') OR contains(p,'examine') OR contains(p,'budget and scope') THEN 'examination'
WHEN contains(p,'deliberation') OR contains(p,'deliberate') OR contains(p,'gate integrity') THEN 'deliberation' WHEN contains(p,'verdict') OR contains(p,'pass') OR contains(p,'fail') THEN 'verdict'
WHEN contains(p,'publication') OR contains(p,'publish') OR contains(p,'git') THEN 'publication' ELSE 'verdict' END AS stage FROM d"""
)
def stage_classify(spark, sf_dir):
    empty = F.from_json(F.lit('{"text":"","clauses":[]}'), _SIDE)
    d = read_table(spark, sf_dir, "documents").withColumn("side", empty)
    return d.select("doc_id", R.stage(F.col("text"), F.col("side"), F.col("side"), F.lit(False)).alias("stage"))


@query(
    """SELECT doc_id, round(0.4::double*e + 0.3::double*b + 0.2::double*g + 0.1::double*p, 2) AS total, e, b, g, p FROM (SELECT doc_id,
CASE WHEN doc_id % 2 = 0 THEN 0.9 ELSE 0.0 END::double AS e, CASE WHEN n_chars % 40 > 25 THEN 0.4 WHEN doc_id % 3 = 0 THEN 0.6 ELSE 1.0 END::double AS b, CASE WHEN doc_id % 3 = 0 THEN 0.6 ELSE 0.5 END::double AS g, CASE WHEN doc_id % 5 < 3 THEN CASE doc_id % 5 WHEN 0 THEN 0.2 WHEN 1 THEN 0.6 ELSE 0.8 END ELSE 0.9 END::double AS p FROM documents)"""
)
def side_scores(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    claims = F.array(F.lit("a claim"))
    manifest = F.when(F.col("doc_id") % 2 == 0, F.struct(claims.alias("claims"), F.lit("verified").alias("verification_status"), claims.alias("evidence_references")))
    chain = F.struct(F.slice(F.array(*[F.lit(f"s{i}") for i in range(5)]), 1, (F.col("doc_id") % 5).cast("int")).alias("steps"), F.lit("log").alias("audit_trail"))
    clauses = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("WAIVER_JUSTIFICATION"))).otherwise(F.array().cast("array<string>"))
    side = F.struct(F.lit("x").alias("text"), clauses.alias("clauses"), F.concat((F.col("n_chars") % 40).cast("string"), F.lit(" files")).alias("change_diff"), F.lit("").alias("rationale"), manifest.alias("evidence_manifest"), chain.alias("provenance_chain"))
    s = d.withColumn("side", side).select("doc_id", R.side_scores(F.col("side"), F.lit(25), F.lit(1000)).alias("s"))
    return s.select("doc_id", F.col("s.total").alias("total"), F.col("s.E").alias("e"), F.col("s.B").alias("b"), F.col("s.G").alias("g"), F.col("s.P").alias("p"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END::double AS f1, doc_id % 2 = 0 AS ok FROM documents")
def grounding_check(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Integration: it has "), (F.col("n_chars") + 1000).cast("string"), F.lit(" characters. Next")).alias("t"), F.create_map(F.lit("count"), (F.col("n_chars") + 1000 + F.col("doc_id") % 2).cast("string")).alias("f"))
    v = d.select("doc_id", R.verify(F.lit("x"), F.col("t"), F.col("f"), F.lit(False)).alias("v"))
    return v.select("doc_id", F.col("v.integration.f1").alias("f1"), F.col("v.ok").alias("ok"))


@query("SELECT doc_id, (doc_id % 4 + 1)::bigint AS added, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 2 END::bigint AS removed, 1 AS files FROM documents")
def diff_budget(spark, sf_dir):
    """A hunk that replaces one line by several: the old line counts once by the header, once by the net change."""
    k = (F.col("doc_id") % 4 + 1).cast("int")
    diff = F.concat(F.lit("--- a/x\n+++ b/x\n@@ -1,1 +1,"), k.cast("string"), F.lit(" @@\n"), F.array_join(F.array_repeat(F.lit("+y"), k), "\n"))
    return R.diff_stats(read_table(spark, sf_dir, "documents").select("doc_id", diff.alias("d")), "doc_id", "d").select("doc_id", "added", "removed", "files")


@query(
    """WITH p AS (SELECT doc_id, CASE WHEN lang='de' THEN 0 WHEN n_chars > 5000 THEN 1 END AS p FROM documents), r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY p ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY p) AS n FROM p WHERE p IS NOT NULL),
c AS (SELECT coalesce((SELECT count(*) FROM p WHERE p=0),0) AS a) SELECT doc_id, CASE p WHEN 0 THEN 'german' ELSE 'long' END AS tag FROM r, c WHERE (p = 0 AND r <= 30) OR (p = 1 AND r <= 30 - least(30, a))"""
)
def priority_tags(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return R.tag_by_priority(d, [("german", F.col("lang") == "de"), ("long", F.col("n_chars") > 5000)], 30, "doc_id").where("tag is not null").select("doc_id", "tag")


@query("SELECT doc_id, md5('<bot>' || chr(10) || chr(10) || '<eot>' || chr(10) || chr(10) || array_to_string(list_concat(list_slice(string_split(text, chr(10)), 2, 1000000), ['end']), chr(10) || chr(10))) AS stitched FROM documents")
def latent_curriculum(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(R.latent_slots(F.split("text", "\n", -1), F.lit("end"), 1, 1)).alias("stitched"))


@query("SELECT doc_id, CASE WHEN length(text) >= 5 THEN 1 END AS first_token, CASE WHEN length(text) >= 5 THEN least(4, ceil(length(text)/4.0)::int) END AS end_token FROM documents WHERE length(text) >= 1")
def token_spans(spark, sf_dir):
    """The tokens of four characters that overlap characters 4 to 12, and that the text has."""
    d = read_table(spark, sf_dir, "documents").where("length(text) >= 1").select("doc_id", F.ceil(F.least(F.length("text"), F.lit(40)) / 4).cast("int").alias("n"))
    offsets = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct((i * 4).alias("start"), (i * 4 + 4).alias("end")))
    s = d.select("doc_id", R.token_span(offsets, F.lit(4), F.lit(13)).alias("s"))
    return s.select("doc_id", F.col("s.start").alias("first_token"), F.col("s.end").alias("end_token"))


_LOW = "lower(text)"


@query(
    rf"""SELECT doc_id, round(CASE WHEN len(regexp_extract_all(text,'<bot>')) <> len(regexp_extract_all(text,'<eot>')) THEN 1.0 ELSE 0.0 END::double, 6) AS budget,
round(CASE WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 50 THEN 1.0 ELSE 0.0 END::double + 0.1::double*(contains({_LOW},'however')::int + contains({_LOW},'but')::int + contains({_LOW},'contrary')::int + contains({_LOW},'despite')::int + contains({_LOW},'although')::int)
 + CASE WHEN regexp_matches({_LOW}, 'answer|conclusion|result|therefore') THEN 0.0 ELSE 0.2 END::double, 6) AS quality FROM documents"""
)
def output_penalties(spark, sf_dir):
    p = read_table(spark, sf_dir, "documents").select("doc_id", R.output_penalties(F.col("text")).alias("p"))
    return p.select("doc_id", F.round("p.budget", 6).alias("budget"), F.round("p.quality", 6).alias("quality"))


@query("WITH u AS (SELECT 'source' AS key, source AS value FROM documents UNION ALL SELECT 'lang', lang FROM documents) SELECT key, value, count(*) AS n, round(count(*)/(sum(count(*)) OVER (PARTITION BY key))::double, 6) AS share FROM u GROUP BY key, value")
def distribution_report(spark, sf_dir):
    return Q.distribution(read_table(spark, sf_dir, "documents"), ["source", "lang"]).withColumn("share", F.round("share", 6))


@query("SELECT CASE WHEN t < 200 THEN '<200' WHEN t < 400 THEN '<400' WHEN t < 800 THEN '<800' WHEN t < 1200 THEN '<1200' WHEN t < 2000 THEN '<2000' ELSE '>=2000' END AS band, count(*) AS n FROM (SELECT length(text)//4 AS t FROM documents) GROUP BY 1")
def drafter_histogram(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").groupBy(Q.length_histogram(X.estimated_tokens(F.col("text"))).alias("band")).agg(F.count(F.lit(1)).alias("n"))


_RESULTS = "SELECT doc_id, n_chars >= 500 AS eligible, CASE WHEN quality=1 THEN 1.0 ELSE 0.5 END::double AS p, CASE WHEN toxic=0 THEN 1.0 ELSE 0.0 END::double AS r, lang='en' AS privacy_ok, quality=1 AS args_ok, toxic=1 AS control_hit FROM documents JOIN labels USING (doc_id)"


def _results(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read_table(spark, sf_dir, "labels"), "doc_id")
    p, r = F.when(F.col("quality") == 1, 1.0).otherwise(0.5), F.when(F.col("toxic") == 0, 1.0).otherwise(0.0)
    return d.select((F.col("n_chars") >= 500).alias("eligible"), p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r)).alias("f1"), (F.col("lang") == "en").alias("privacy_ok"), (F.col("quality") == 1).alias("args_ok"), (F.col("toxic") == 1).alias("control_hit"))


@query(
    f"""WITH x AS ({_RESULTS}), s AS (SELECT count(*) AS total, count(*) FILTER (eligible) AS n_eligible, avg(2*p*r/(p+r)) FILTER (eligible) AS f, avg(p) FILTER (eligible) AS p, avg(r) FILTER (eligible) AS r, avg(privacy_ok::int) AS pr, avg(args_ok::int) AS ar, count(*) FILTER (control_hit) AS c FROM x)
SELECT total, n_eligible, round(f,6) AS macro_f1, round(2*p*r/(p+r),6) AS micro_f1, round(pr,6) AS privacy_rate, round(ar,6) AS args_rate, c AS controls_hit FROM s"""
)
def evaluation_summary(spark, sf_dir):
    s = Q.summarize(_results(spark, sf_dir))
    return s.select("total", "n_eligible", *[F.round(c, 6).alias(c) for c in ("macro_f1", "micro_f1", "privacy_rate", "args_rate")], "controls_hit")


@query(
    f"""WITH x AS ({_RESULTS}), s AS (SELECT avg(2*p*r/(p+r)) FILTER (eligible) AS f, avg(args_ok::int) AS a, count(*) FILTER (control_hit) AS c FROM x)
SELECT 'macro_f1' AS gate, f >= 0.9 AS passed FROM s UNION ALL SELECT 'args_rate', a >= 0.5 FROM s UNION ALL SELECT 'controls_hit', c <= 0 FROM s"""
)
def evaluation_gates(spark, sf_dir):
    return Q.gates(Q.summarize(_results(spark, sf_dir)), {"macro_f1": 0.9, "args_rate": 0.5}, {"controls_hit": 0}).select("gate", "passed")


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '#[12]') AND p_size >= 30 THEN 'large' WHEN regexp_matches(p_brand, '#') AND p_size >= 10 THEN 'usual' ELSE 'default' END AS profile FROM part")
def hardware_profile(spark, sf_dir):
    return Q.match_profile(read_table(spark, sf_dir, "part"), [("large", "#[12]", 30), ("usual", "#", 10)], "p_brand", "p_size").select("p_partkey", "profile")


@query(
    """SELECT n_nationkey AS id, (CASE n_regionkey WHEN 1 THEN 10 WHEN 2 THEN 50 ELSE 25 END + coalesce(f,0))::bigint AS max_files, (CASE n_regionkey WHEN 1 THEN 100 WHEN 2 THEN 500 ELSE 1000 END + coalesce(l,0))::bigint AS max_loc
FROM nation LEFT JOIN (SELECT s_nationkey AS k, count(*) AS f, sum(s_suppkey % 7) AS l FROM supplier WHERE s_acctbal > 0 GROUP BY 1) ON k = n_nationkey"""
)
def tier_budgets(spark, sf_dir):
    specs = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("tier"))
    waivers = read_table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id"), (F.col("s_acctbal") > 0).alias("active"), F.lit(1).alias("files"), (F.col("s_suppkey") % 7).alias("loc"))
    b = Q.budgets(specs, {1: (10, 100), 2: (50, 500)}, waivers)
    return b.select("id", F.col("max_files").cast("bigint").alias("max_files"), F.col("max_loc").cast("bigint").alias("max_loc"))


@query("WITH m AS (SELECT lang, avg(n_chars) AS mean FROM documents GROUP BY lang) SELECT lang, round(mean - (SELECT mean FROM m ORDER BY lang LIMIT 1), 4) AS mean_delta FROM m")
def baseline_comparison(spark, sf_dir):
    m = read_table(spark, sf_dir, "documents").groupBy("lang").agg(F.avg("n_chars").alias("mean"))
    return Q.with_baseline(m, "lang", ["mean"]).select("lang", F.round("mean_delta", 4).alias("mean_delta"))


@query("SELECT count(*) FILTER (event_type='view') AS hits, count(*) FILTER (event_type='click') AS misses, round(count(*) FILTER (event_type='view')/count(*) FILTER (event_type IN ('view','click'))::double, 6) AS hit_rate FROM events")
def cache_hit_rate(spark, sf_dir):
    status = F.when(F.col("event_type") == "view", "hit").when(F.col("event_type") == "click", "miss").otherwise("version")
    return Q.hit_rates(read_table(spark, sf_dir, "events").select(status.alias("status"))).withColumn("hit_rate", F.round("hit_rate", 6))


@query("SELECT event_type, round(quantile_cont(value,0.25),6) AS p25, round(quantile_cont(value,0.5),6) AS median, round(quantile_cont(value,0.75),6) AS p75, round(var_pop(value)/power(quantile_cont(value,0.5),2),4) AS cv FROM events GROUP BY event_type")
def dispersion(spark, sf_dir):
    d = Q.dispersion(read_table(spark, sf_dir, "events"), ["event_type"], "value")
    return d.select("event_type", *[F.round(c, 6).alias(c) for c in ("p25", "median", "p75")], F.round("cv", 4).alias("cv"))


@query(
    """WITH e AS (SELECT unnest(list_filter([CASE WHEN text IS NULL OR trim(text)='' THEN 'empty' END, CASE WHEN source='src0' THEN 'enum' END, CASE WHEN n_chars % 5 > 2 THEN 'range' END, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 AND source <> 'src0' THEN 'supervision' END], lambda x: x IS NOT NULL)) AS error FROM documents)
SELECT error, count(*) AS n FROM e GROUP BY error"""
)
def worker_validation(spark, sf_dir):
    ids = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    d = read_table(spark, sf_dir, "documents").select(F.lit("p").alias("prompt"), F.col("text").alias("answer"), F.when(F.col("source") == "src0", "odd").when(F.col("doc_id") % 2 == 0, "tool_use").otherwise("plain").alias("task_type"), (F.col("n_chars") % 5).alias("level"), ids.alias("token_ids"))
    return V.histogram(d.select(V.worker_errors(d).alias("errors")), "errors")


@query("SELECT event_id, CASE WHEN list_contains(json_keys(props),'k') THEN 'missing:z' ELSE 'missing:k,missing:z' END AS errors FROM events")
def presence_validation(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", F.array_join(V.presence_errors(F.col("props"), ("k", "z")), ",").alias("errors"))


@query("SELECT doc_id, regexp_matches(source, '^src1') AND NOT regexp_matches(source, '^src13') AS inside FROM documents")
def scope_validation(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", V.in_scope(F.array("source"), F.array(F.lit("src1*")), F.array(F.lit("src13"))).alias("inside"))


@query("SELECT CASE WHEN n_chars < 5000 AND quality=1 AND lang='en' THEN 'APPROVED' WHEN toxic=1 THEN 'WAIVER_REQUIRED' ELSE 'REJECTED' END AS verdict, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def compliance_verdict(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read_table(spark, sf_dir, "labels"), "doc_id")
    v = V.verdict(F.col("n_chars") < 5000, F.col("quality") == 1, F.col("lang") == "en", F.col("toxic") == 1)
    return d.groupBy(v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query()
def identical_sides(spark, sf_dir):
    d = read_table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("a"), F.col("text").alias("b"))
    return V.replace_identical(d, "item_id", "a", "b", read_table(spark, sf_dir, "benchmark"))


@query("SELECT event_id, 0 AS start, length(props) AS stop FROM events WHERE json_valid(props)")
def json_object_spans(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("event_id", F.inline(P.json_spans(F.col("props"))))
    return e.select("event_id", "start", F.col("end").cast("bigint").alias("stop"))


@query("SELECT doc_id, md5(nfc_normalize(text)) AS digest FROM documents")
def normal_forms(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(P.normal_form(F.col("text"))).alias("digest"))


@query(
    """WITH t AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS i FROM conversations),
s AS (SELECT conv_id, role, i, max(i) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY i) AS u, max(i) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM t),
p AS (SELECT conv_id, u, i + 1 AS e, lag(i + 1) OVER (PARTITION BY conv_id ORDER BY i) AS le FROM s WHERE role = 'assistant' AND u > coalesce(a, -1)),
n AS (SELECT conv_id, count(*) AS n, count(*) FILTER (le IS NULL OR u > le) AS m FROM p GROUP BY conv_id), l AS (SELECT conv_id, max(i) FILTER (role = 'user') AS u, max(i) FILTER (role = 'assistant') AS a FROM t GROUP BY conv_id)
SELECT conv_id, coalesce(n, 0)::int AS n_spans, coalesce(m, 0)::int AS n_merged, u IS NOT NULL AND u > coalesce(a, -1) AS unclosed FROM l LEFT JOIN n USING (conv_id)"""
)
def marked_spans(spark, sf_dir):
    """Spans from a user turn to the next assistant turn, by conversation."""
    c = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"]).alias("roles"))
    s = c.select("conv_id", P.marked_spans(F.col("roles"), "user", "assistant").alias("s"))
    return s.select("conv_id", F.size("s.spans").alias("n_spans"), F.size(P.merge(F.col("s.spans"))).alias("n_merged"), "s.unclosed")


@query("SELECT count(*) AS n, sum(event_id)::bigint AS ids, count(DISTINCT event_type) AS kinds FROM events")
def ndjson_round_trip(spark, sf_dir):
    """Events written as NDJSON and read back by the tolerant reader."""
    scratch = Scratch(spark, "ndjson")
    ndjson.write(read_table(spark, sf_dir, "events").select("event_id", "event_type", "value"), f"{scratch.root}/events")
    rows = ndjson.read_tolerant(spark, f"{scratch.root}/events", "event_id bigint, event_type string, value double")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.count_distinct("event_type").alias("kinds"))


@query("SELECT CASE event_type WHEN 'view' THEN 'assistant.final' ELSE 'assistant.delta' END AS type, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1")
def capture_lines(spark, sf_dir):
    line = F.when(F.col("event_type") == "view", F.lit('data: {"type": "assistant.final", "text": "x"}')).when(F.col("event_type") == "click", F.lit('{"type": "other"}')).otherwise(F.col("event_type"))
    return S.parse_capture(read_table(spark, sf_dir, "events").select(line.alias("value"))).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id FROM events WHERE (event_type='error' AND value > 20) OR (event_type='purchase' AND value > 90)")
def metric_alerts(spark, sf_dir):
    return S.alerts(read_table(spark, sf_dir, "events"), {"error": 20.0, "purchase": 90.0}).select("event_id")


@query()
def generated_prompts(spark, sf_dir):
    return N.prompts(N.cells(spark, 120))


@query()
def generated_pairs(spark, sf_dir):
    return N.judged_pairs(spark, 90)


def _sources(spark, sf_dir):
    """Documents as source files: every line a Python comment, with a mark in some."""
    mark = F.when(F.col("doc_id") % 3 == 0, F.lit("# TODO finish this part\n    pass")).when(F.col("doc_id") % 3 == 1, F.lit("# placeholder for the real thing")).otherwise("# plain words of no weight")
    return read_table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.concat(mark, F.lit("\nx = 1")).alias("text"))


@query("SELECT 'py' AS extension, 'high' AS band, count(*) AS n FROM documents WHERE doc_id % 3 < 2")
def comment_summary(spark, sf_dir):
    from granary.operators import comments as O

    return O.summary(O.extract(_sources(spark, sf_dir)))


@query("SELECT 'f' || doc_id || '.py' AS path, 2 AS line_number, 1 AS at_line FROM documents WHERE doc_id % 3 = 0")
def stub_attachment(spark, sf_dir):
    from granary.operators import comments as O

    return O.attach_stubs(_sources(spark, sf_dir))


@query()
def claim_verifiability(spark, sf_dir):
    from granary.functions import claims as C

    t = F.col("text")
    return read_table(spark, sf_dir, "benchmark").select("item_id", C.verifiability(t).alias("score"), F.coalesce(C.without_opinion(t), t).alias("rewritten"), F.size(C.ambiguities(t, F.array().cast("array<string>"))).alias("n_ambiguities"), F.round(C.coverage(t, C.elements(t)), 4).alias("own_coverage"))
