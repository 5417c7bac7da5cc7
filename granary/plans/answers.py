"""Queries over answers and their records: named and marked tools, shells, mixes, random pairs, steps, lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import steps as P
from granary.operators import inference as I
from granary.operators import mixing as M
from granary.operators import ordered as O
from granary.operators import records as R
from granary.operators import shells as H
from granary.plans.catalog import query
from granary.session import read_table
from granary.sources import stores

_WORDS = ("the", "und", "les", "los", "des")
_NAMED = ", ".join(f"CASE WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9_]){w}($|[^A-Za-z0-9_])') THEN '{w}' END" for w in _WORDS)


@query(f"WITH n AS (SELECT doc_id, list_filter([{_NAMED}], lambda x: x IS NOT NULL) AS n FROM documents) SELECT doc_id, CASE WHEN len(n) = 1 THEN n[1] END AS tool FROM n")
def named_tools(spark, sf_dir):
    """Common words in the place of tools: the one that a text names, if it names one."""
    return read_table(spark, sf_dir, "documents").select("doc_id", I.named_tool(F.col("text"), list(_WORDS)).alias("tool"))


@query(
    """WITH e AS (SELECT event_id, event_type, json_extract_string(props, '$.k')::int AS k FROM events)
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN CASE WHEN event_id % 2 = 0 THEN event_type END WHEN event_type IN ('click', 'view') THEN event_type WHEN k < 40 THEN 'counter' WHEN k % 3 = 0 THEN 'counter' WHEN k % 3 = 1 THEN 'click' END AS inferred,
 CASE WHEN event_id % 11 = 0 THEN 'original' WHEN event_type IN ('click', 'view') THEN 'api' WHEN k < 40 THEN 'schema' WHEN k % 3 = 0 THEN 'mask+schema' WHEN k % 3 = 1 THEN 'heuristic' END AS source,
 CASE WHEN event_id % 11 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'exact' END WHEN event_type = 'click' THEN 'partial' WHEN event_type = 'view' THEN 'exact' WHEN k < 40 OR k % 3 = 0 THEN 'partial' WHEN k % 3 = 1 THEN 'low' END AS confidence FROM e"""
)
def tool_inference(spark, sf_dir):
    """Events as samples of each kind: with a tool, with a call, with JSON in the text, with broken JSON, with a name in words."""
    e = read_table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    call = F.when(F.col("event_type").isin("click", "view"), F.struct(F.col("event_type").alias("name"), F.when(F.col("event_type") == "click", F.col("props")).otherwise("{}").alias("arguments")))
    said = F.when(F.col("k") < 40, F.concat(F.lit("It is "), F.col("props"))).when(F.col("k") % 3 == 0, F.concat(F.lit("It is {'k': "), F.col("k").cast("string"), F.lit(",}"))).when(F.col("k") % 3 == 1, "try a Click here").otherwise("click or view")
    e = e.select("event_id", "event_type", call.alias("call"), said.alias("said"))
    registry = spark.createDataFrame([("counter", ["k", "unit"]), ("other", ["a", "b"])], "tool string, properties array<string>")
    own = F.when(F.col("event_id") % 2 == 0, F.col("event_type"))
    none = F.lit(None).cast("string")
    return I.infer_tool(e, registry, F.col("event_id") % 11 == 0, own, F.col("call"), none, F.col("said"), F.lit(True), ["click", "view"]).select("event_id", "inferred", "source", "confidence")


@query(
    """SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END ELSE 0 END AS n_calls, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type END AS first_name,
 CASE WHEN event_type IN ('view', 'click', 'purchase') THEN (json_extract_string(props, '$.k'))::int END AS k FROM events"""
)
def marked_calls(spark, sf_dir):
    """Calls in a tag, with a comma too many on odd events, and in a fence on every third one."""
    call = F.concat(F.lit('{"name": "'), F.col("event_type"), F.lit('", "arguments": '), F.col("props"), F.when(F.col("event_id") % 2 == 1, ",").otherwise(""), F.lit("}"))
    fence = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("\n```json\n{\"name\": \""), F.col("event_type"), F.lit('"}\n```'))).otherwise("")
    text = F.concat(F.lit("so <tool_call>"), call, F.lit("</tool_call> TOOL_CALL: {\"name\": \"nothing\"}"), fence)
    e = read_table(spark, sf_dir, "events").select("event_id", I.marked_calls(text, ["view", "click", "purchase"]).alias("c"))
    return e.select("event_id", F.size("c").alias("n_calls"), F.get("c", 0)["name"].alias("first_name"), F.get_json_object(F.get("c", 0)["arguments"], "$.k").cast("int").alias("k"))


@query(
    """WITH e AS (SELECT event_id % 5 <> 0 AS valid, event_id % 10 = 5 AS mended, event_type, event_id FROM events), r AS (SELECT *, (valid OR mended) AND event_type <> 'error' AND event_id % 4 <> 0 AS chosen FROM e)
SELECT count(*) AS n, round(avg(valid::int), 6) AS json_validity, round(avg(chosen::int), 6) AS tool_selection, round(avg(mended::int), 6) AS repair, round(avg((valid AND chosen)::int), 6) AS success FROM r"""
)
def tool_use_rates(spark, sf_dir):
    call = F.concat(F.lit('{"name": "'), F.when(F.col("event_id") % 4 == 0, "other").otherwise(F.col("event_type")), F.lit('"'), F.when(F.col("event_id") % 10 == 5, ",}").when(F.col("event_id") % 10 == 0, "").otherwise("}"))
    r = I.use_rates(read_table(spark, sf_dir, "events"), call, F.col("event_type"), ["view", "click", "purchase", "signup", "login", "logout", "search"])
    return r.select("n", *[F.round(c, 6).alias(c) for c in r.columns[1:]])


@query(
    """WITH s AS (SELECT doc_id, n_chars::double AS v, CASE doc_id % 4 WHEN 0 THEN 'It has ' || n_chars || ' characters' WHEN 1 THEN 'about ' || (n_chars * 100) || ' percent of it' WHEN 2 THEN n_chars || ',0 in all' ELSE 'it has ' || (n_chars + 1) || ' lines' END AS span FROM documents),
d AS (SELECT *, try_cast(regexp_replace(span, '[^0-9.]', '', 'g') AS double) AS x, try_cast(replace(regexp_replace(span, '[^0-9,]', '', 'g'), ',', '.') AS double) AS y, contains(span, 'percent') AS pct, regexp_matches(span, '(^|[^0-9A-Za-z_])' || v::bigint || '($|[^0-9A-Za-z_])') AS word FROM s)
SELECT doc_id, coalesce(word, false) OR coalesce(abs(v - x) <= 1e-6, false) OR coalesce(abs(v - y) <= 1e-6, false) OR (pct AND (coalesce(abs(v - x / 100) <= 1e-6, false) OR coalesce(abs(v - y / 100) <= 1e-6, false))) AS grounded FROM d"""
)
def strict_grounding(spark, sf_dir):
    n, i = F.col("n_chars"), F.col("doc_id") % 4
    text = lambda c: c.cast("string")
    span = F.when(i == 0, F.concat(F.lit("It has "), text(n), F.lit(" characters"))).when(i == 1, F.concat(F.lit("about "), text(n * 100), F.lit(" percent of it"))).when(i == 2, F.concat(text(n), F.lit(",0 in all"))).otherwise(F.concat(F.lit("it has "), text(n + 1), F.lit(" lines")))
    fields = F.create_map(F.lit("count"), text(n), F.lit("other"), text(n + 1))
    return read_table(spark, sf_dir, "documents").select("doc_id", R.is_grounded_strictly(span, fields, F.array().cast("array<string>")).alias("grounded"))


_SEEDED = "sha256({} || '|42')"


@query(
    f"""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_SEEDED.format('doc_id')}, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IN ('src0', 'src1', 'src2')),
w AS (SELECT source, n, any_value(least(n, CASE source WHEN 'src0' THEN 50 WHEN 'src1' THEN 30 ELSE 20 END * 3)) AS w FROM r GROUP BY source, n), t AS (SELECT sum(w) AS taken, max(n) FILTER (source = 'src0') AS n0 FROM w),
own AS (SELECT doc_id, r.source, count(*) AS copies FROM r JOIN w USING (source) WHERE r <= w GROUP BY 1, 2),
more AS (SELECT doc_id, source, count(*) AS copies FROM r, t, generate_series(0, 400) g(k) WHERE source = 'src0' AND g.k * n0 + r <= 300 - taken GROUP BY 1, 2)
SELECT doc_id, source, sum(copies)::bigint AS copies FROM (SELECT * FROM own UNION ALL SELECT * FROM more) GROUP BY 1, 2"""
)
def prompt_mix(spark, sf_dir):
    """Three sources by 50, 30 and 20 percent of 300 rows, topped up from the first."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return M.ratio_mix(d, "source", "doc_id", {"src0": 0.5, "src1": 0.3, "src2": 0.2}, 300).groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("copies"))


@query(f"SELECT doc_id, text FROM documents ORDER BY {_SEEDED.format('doc_id')}, doc_id LIMIT 20")
def random_sample(spark, sf_dir):
    return M.sample_rows(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 20)


_POINT = "(('0x' || substr(sha256(event_id || '|7'), 1, 8))::bigint / 4294967296.0::double)"


@query(f"SELECT CASE WHEN {_POINT} < 0.5 THEN 512 WHEN {_POINT} < 0.8 THEN 1024 ELSE 2048 END AS length, count(*) AS n FROM events GROUP BY 1")
def weighted_lengths(spark, sf_dir):
    c = M.weighted_choice(F.col("event_id"), {512: 5.0, 1024: 3.0, 2048: 2.0}, 7)
    return read_table(spark, sf_dir, "events").select(c.alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("n"))


_DRAW = "('0x' || substr(sha256(id || '|42|{}'), 1, 12))::bigint % n + 1"


@query(
    f"""WITH r AS (SELECT doc_id, substr(text, 1, 100) AS t, row_number() OVER (ORDER BY {_SEEDED.format('doc_id')}, doc_id) AS r, count(*) OVER () AS n FROM documents), c AS (SELECT count(*) AS n FROM documents),
d AS (SELECT id, {_DRAW.format('a')} AS a, {_DRAW.format('b')} AS b FROM c, generate_series(0, 899) g(id)), p AS (SELECT id, x.doc_id AS a_id, y.doc_id AS b_id, coalesce(x.t, '') AS s, coalesce(y.t, '') AS t FROM d JOIN r x ON x.r = d.a JOIN r y ON y.r = d.b WHERE d.a <> d.b)
SELECT a_id, b_id FROM (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY id) AS k FROM p) WHERE k = 1 ORDER BY id LIMIT 300"""
)
def random_pairs(spark, sf_dir):
    return M.random_pairs(read_table(spark, sf_dir, "documents"), "doc_id", "text", 300)


@query(
    """SELECT doc_id, CASE WHEN l >= 2 THEN 'EVIDENCE_COMPLETENESS,PROVENANCE_CLARITY' WHEN quality = 1 AND chain THEN 'EVIDENCE_COMPLETENESS,PROVENANCE_CLARITY' WHEN chain THEN 'PROVENANCE_CLARITY' WHEN quality = 1 OR NOT tool THEN 'EVIDENCE_COMPLETENESS' ELSE '' END
 || CASE WHEN tool THEN CASE WHEN l >= 2 OR quality = 1 OR chain THEN ',' ELSE '' END || 'GATE_INTEGRITY' ELSE '' END AS clauses FROM (SELECT doc_id, quality, quality * (1 + toxic) AS l, toxic = 1 AS chain, doc_id % 3 = 0 AS tool FROM labels)"""
)
def inferred_clauses(spark, sf_dir):
    q, x = F.col("quality"), F.col("toxic")
    return read_table(spark, sf_dir, "labels").select("doc_id", F.array_join(H.inferred_clauses(q * (x + 1), q == 1, x == 1, F.when(F.col("doc_id") % 3 == 0, "tool_use").otherwise("plain")), ",").alias("clauses"))


@query(
    """WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, upper(coalesce(text, '')) AS u, doc_id % 4 = 0 AS tool, doc_id % 3 = 0 AS ids, coalesce(doc_id % 2 = 0, false) AS why, lang = 'de' AS ctx FROM documents)
SELECT doc_id, coalesce(((tool AND ids) OR ctx) AND why AND n > 100 AND n < 8000 AND NOT contains(u, 'TODO') AND NOT contains(u, 'PLACEHOLDER'), false) AS ready, coalesce((why OR ids OR ctx) AND n > 50 AND NOT contains(u, 'TODO') AND NOT contains(u, 'PLACEHOLDER') AND NOT contains(u, 'MOCK'), false) AS tag FROM d"""
)
def curriculum_marks(spark, sf_dir):
    i = F.col("doc_id")
    m = H.curriculum_marks(F.col("text"), F.when(i % 4 == 0, "tool_use").otherwise("plain"), i % 3 == 0, i % 2 == 0, F.col("lang") == "de")
    return read_table(spark, sf_dir, "documents").select("doc_id", m.alias("m")).select("doc_id", "m.ready", "m.tag")


@query(
    """WITH e AS (SELECT event_id, event_type, user_id % 3 AS u FROM events), f AS (SELECT unnest(list_filter([CASE WHEN u = 0 THEN 'working_spec' END, 'evidence_manifest', 'provenance_chain', CASE WHEN event_type = 'error' THEN 'role' END, CASE WHEN u = 1 THEN 'task_type' END], lambda x: x IS NOT NULL)) AS field FROM e),
g AS (SELECT unnest(list_filter([CASE WHEN u = 2 THEN 'process_supervision' END, CASE WHEN u = 0 THEN 'working_spec' END], lambda x: x IS NOT NULL)) AS field FROM e)
SELECT 'fill' AS step, field, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'repair', field, count(*) FROM g GROUP BY 2"""
)
def gap_shells(spark, sf_dir):
    """Worker records of events with missing parts: what is filled, and what the dependencies add."""
    u = F.col("user_id") % 3
    spec = F.when(u != 0, F.from_json(F.lit('{"id":"w","budget":{"max_files":3}}'), H.SPEC))
    null = lambda kind: F.lit(None).cast(kind)
    e = read_table(spark, sf_dir, "events").select("event_id", spec.alias("working_spec"), null(H.MANIFEST).alias("evidence_manifest"), null(H.CHAIN).alias("provenance_chain"), null(H.SUPERVISION).alias("process_supervision"),
        F.when(F.col("event_type") != "error", "worker").alias("role"), F.when(u == 2, "tool_use").when(u == 0, "plain_kd").alias("task_type"), F.lit("lite").alias("caws_level"))
    filled = H.fill_counts(H.fill_worker(e)).select(F.lit("fill").alias("step"), "field", "n")
    return filled.unionByName(H.fill_counts(H.repair_dependencies(e), "repaired").select(F.lit("repair").alias("step"), "field", "n"))


@query("SELECT conv_id, min(turn) OVER (PARTITION BY conv_id) AS first, turn AS again FROM conversations QUALIFY turn > first")
def repeated_ids(spark, sf_dir):
    return O.repeated_keys(read_table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 50")
def latest_points(spark, sf_dir):
    return O.last_rows(read_table(spark, sf_dir, "events"), "event_type", [F.col("ts"), F.col("event_id")], 50).select("event_type", "event_id")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def longest_texts(spark, sf_dir):
    return O.offenders(read_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), F.col("n_chars"), "doc_id", 25)


_LINES = r"array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ \t\r\n\f\v]+|[ \t\r\n\f\v]+$', '', 'g')), chr(10))"


@query(
    rf"""WITH c AS (SELECT conv_id, turn, text, regexp_replace(regexp_replace({_LINES}, '\n\n+', chr(1), 'g'), '\n(Step|1\.|2\.|3\.|First|Then|Finally)', chr(1) || '\1', 'g') AS c FROM conversations WHERE role = 'assistant'),
s AS (SELECT *, list_filter(list_transform(string_split(c, chr(1)), lambda x: trim(replace(x, chr(10), ' '))), lambda x: x <> '') AS s FROM c)
SELECT conv_id, turn, CASE WHEN len(s) = 0 THEN 1 ELSE len(s) END AS n_steps, md5(CASE WHEN len(s) = 0 THEN text ELSE s[1] END) AS first_md5, md5(trim(string_split(text, chr(10))[-1])) AS answer_md5 FROM s"""
)
def answer_steps(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", P.steps(F.col("text")).alias("s"), P.answer(F.col("text")).alias("a"))
    return c.select("conv_id", "turn", F.size("s").cast("bigint").alias("n_steps"), F.md5(F.get("s", 0)).alias("first_md5"), F.md5("a").alias("answer_md5"))


@query(
    """WITH p AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User' ELSE 'Said' END || ': ' || text, chr(10) ORDER BY turn) AS t, min(turn) AS m FROM conversations GROUP BY conv_id HAVING arg_min(role, turn) = 'user'),
q AS (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'x' || chr(10) || 'System: be brief' || chr(10) || t WHEN 1 THEN 'You are a helpful and careful machine.' || chr(10) || t ELSE 'Some words' || chr(10) || 'more' || chr(10) || t END AS t, conv_id % 3 AS k, t AS rest FROM p)
SELECT conv_id, CASE k WHEN 0 THEN 'System: be brief' WHEN 1 THEN 'You are a helpful and careful machine.' ELSE 'Some words' || chr(10) || 'more' END AS system, md5(CASE k WHEN 0 THEN 'x' || chr(10) || chr(10) || rest ELSE rest END) AS user_md5 FROM q"""
)
def prompt_parts(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    said = F.array_join(F.transform("t", lambda x: F.concat(F.when(x["role"] == "user", "User").otherwise("Said"), F.lit(": "), x["text"])), "\n")
    c = c.where(F.get("t", 0)["role"] == "user")
    k = F.col("conv_id") % 3
    head = F.when(k == 0, "x\nSystem: be brief\n").when(k == 1, "You are a helpful and careful machine.\n").otherwise("Some words\nmore\n")
    p = c.select("conv_id", P.prompt_parts(F.concat(head, said)).alias("p"))
    return p.select("conv_id", F.col("p.system").alias("system"), F.md5("p.user").alias("user_md5"))


@query("SELECT event_id, 'It is ' || CASE user_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE '' END || CASE WHEN user_id % 4 < 2 THEN ' ' ELSE '' END || 'and maybe' AS said FROM events")
def placeholder_labels(spark, sf_dir):
    text = F.concat(F.lit("It  is <token_"), (F.col("user_id") % 4).cast("string"), F.lit(">\nand <MAYBE> "))
    return read_table(spark, sf_dir, "events").select("event_id", P.label_placeholders(text, {"<MAYBE>": "maybe"}, {0: "yes", 1: "no"}).alias("said"))


@query("SELECT event_type, count(*) FILTER (value >= 50) AS passed, count(*) FILTER (value < 20) AS failed, count(*) FILTER (value >= 20 AND value < 50) AS inconclusive, round(avg((value >= 50)::int), 6) AS pass_rate, round(avg(value), 4) AS avg_score FROM events WHERE event_type = 'view' GROUP BY 1")
def outcome_counts(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").where("event_type = 'view'").withColumn("outcome", F.when(F.col("value") >= 50, "pass").when(F.col("value") < 20, "fail").otherwise("inconclusive"))
    o = I.outcome_counts(e, "outcome", "value")
    return o.select(F.lit("view").alias("event_type"), "passed", "failed", "inconclusive", F.round("pass_rate", 6).alias("pass_rate"), F.round("avg_score", 4).alias("avg_score"))


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 36 HOUR")
def recent_rows(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    last = e.agg(F.max("ts").alias("now"))
    return stores.without_old(e.join(F.broadcast(last)), "ts", F.col("now"), 1.5).select("event_id")


@query(
    """SELECT event_id, CASE WHEN json_extract_string(props, '$.k')::int < 10 THEN 'min:k' WHEN json_extract_string(props, '$.k')::int > 80 THEN 'max:k' END AS _validation_error FROM events"""
)
def trace_validation(spark, sf_dir):
    entry = (("k",), {"k": ("integer", None, 10, 80)})
    return stores.with_validation_errors(read_table(spark, sf_dir, "events"), F.col("props"), entry).select("event_id", "_validation_error")
