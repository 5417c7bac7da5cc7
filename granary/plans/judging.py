"""Queries over judgements: metrics, pairs of claims and evidence, scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions import judging as G
from granary.functions import text as X
from granary.operators import pairs as P
from granary.plans.catalog import query
from granary.session import read_spread, read_table


def _rated(spark, sf_dir):
    """Labels with a rule's prediction: no shouting and no symbols is good."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    rule = F.when(F.contains("text", F.lit("!!")) | F.contains("text", F.lit("###")) | F.contains("text", F.lit("$$$")), 0).otherwise(1)
    return docs.select("doc_id", "lang", F.length("text").alias("n_chars"), rule.alias("pred")).join(read_table(spark, sf_dir, "labels"), "doc_id")


_RATED = "SELECT doc_id, lang, length(text) AS n_chars, CASE WHEN contains(text,'!!') OR contains(text,'###') OR contains(text,'$$$') THEN 0 ELSE 1 END AS pred, quality, toxic FROM documents JOIN labels USING (doc_id)"


@query(
    f"""WITH r AS ({_RATED}), c AS (SELECT count(*) FILTER (pred=0 AND quality=0) AS tp0, count(*) FILTER (pred=0 AND quality=1) AS fp0, count(*) FILTER (pred=1 AND quality=0) AS fn0, count(*) FILTER (pred=1 AND quality=1) AS tp1, count(*) AS n FROM r),
m AS (SELECT *, (tp0/(tp0+fp0)::double + tp1/(tp1+fn0)::double)/2 AS p, (tp0/(tp0+fn0)::double + tp1/(tp1+fp0)::double)/2 AS q FROM c)
SELECT round((tp0+tp1)/n::double,6) AS accuracy, round(p,6) AS precision_macro, round(q,6) AS recall_macro, round(2*p*q/(p+q),6) AS f1 FROM m"""
)
def pairwise_accuracy(spark, sf_dir):
    r = _rated(spark, sf_dir)
    n = lambda p, q: F.count_if((F.col("pred") == p) & (F.col("quality") == q))
    c = r.agg(n(0, 0).alias("a"), n(0, 1).alias("b"), n(1, 0).alias("c"), n(1, 1).alias("d"), F.count(F.lit(1)).alias("n"))
    part = lambda x, y: F.when(F.col(x) + F.col(y) > 0, F.col(x) / (F.col(x) + F.col(y))).otherwise(0.0)
    c = c.withColumn("p", (part("a", "b") + part("d", "c")) / 2).withColumn("q", (part("a", "c") + part("d", "b")) / 2)
    f1 = F.when(F.col("p") + F.col("q") > 0, 2 * F.col("p") * F.col("q") / (F.col("p") + F.col("q"))).otherwise(0.0)
    return c.select(F.round((F.col("a") + F.col("d")) / F.col("n"), 6).alias("accuracy"), F.round("p", 6).alias("precision_macro"), F.round("q", 6).alias("recall_macro"), F.round(f1, 6).alias("f1"))


@query(
    f"""WITH r AS ({_RATED}), e AS (SELECT *, CASE WHEN pred=quality THEN 1.0 ELSE 0.5 END AS p, CASE WHEN toxic=0 THEN 1.0 ELSE 0.25 END AS q FROM r WHERE n_chars >= 500)
SELECT round(avg(2*p*q/(p+q)),6) AS macro_f1, round(2*avg(p)*avg(q)/(avg(p)+avg(q)),6) AS micro_f1, count(*) AS eligible FROM e"""
)
def macro_micro_f1(spark, sf_dir):
    """Mean of row F1, and harmonic mean of mean precision and mean recall, over eligible rows."""
    e = _rated(spark, sf_dir).where("n_chars >= 500").withColumn("p", F.when(F.col("pred") == F.col("quality"), 1.0).otherwise(0.5)).withColumn("q", F.when(F.col("toxic") == 0, 1.0).otherwise(0.25))
    s = e.agg(F.avg(2 * F.col("p") * F.col("q") / (F.col("p") + F.col("q"))).alias("f"), F.avg("p").alias("p"), F.avg("q").alias("q"), F.count(F.lit(1)).alias("eligible"))
    return s.select(F.round("f", 6).alias("macro_f1"), F.round(2 * F.col("p") * F.col("q") / (F.col("p") + F.col("q")), 6).alias("micro_f1"), "eligible")


@query(f"WITH r AS ({_RATED}) SELECT lang, round(avg(CASE WHEN pred=quality THEN 1.0 ELSE 0.0 END),3) AS lax, round(avg(CASE WHEN pred=quality AND toxic=0 THEN 1.0 ELSE 0.0 END),3) AS strict, count(*) AS n FROM r GROUP BY lang")
def per_group_deltas(spark, sf_dir):
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 3)
    good = F.col("pred") == F.col("quality")
    return _rated(spark, sf_dir).groupBy("lang").agg(share(good).alias("lax"), share(good & (F.col("toxic") == 0)).alias("strict"), F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH r AS ({_RATED}), g AS (SELECT list_filter([CASE WHEN pred=0 THEN 'bad' END, CASE WHEN n_chars>3000 THEN 'long' END, CASE WHEN lang='en' THEN 'plain' END], lambda x: x IS NOT NULL) AS p,
list_filter([CASE WHEN quality=0 THEN 'bad' END, CASE WHEN toxic=1 THEN 'long' END, CASE WHEN lang IN ('en','fr') THEN 'plain' END], lambda x: x IS NOT NULL) AS q FROM r),
s AS (SELECT c, list_contains(p,c) AS inp, list_contains(q,c) AS inq FROM g, (SELECT unnest(['bad','long','plain']) AS c))
SELECT c AS clause, count(*) FILTER (inp AND inq) AS tp, count(*) FILTER (inp AND NOT inq) AS fp, count(*) FILTER (inq AND NOT inp) AS fn FROM s WHERE inp OR inq GROUP BY c"""
)
def clause_f1(spark, sf_dir):
    """Counts of each clause from the set differences of predicted and true clauses."""
    some = lambda *xs: F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in xs]))
    r = _rated(spark, sf_dir)
    p = some((F.col("pred") == 0, "bad"), (F.col("n_chars") > 3000, "long"), (F.col("lang") == "en", "plain"))
    q = some((F.col("quality") == 0, "bad"), (F.col("toxic") == 1, "long"), (F.col("lang").isin("en", "fr"), "plain"))
    r = r.select(p.alias("p"), q.alias("q"))
    kind = lambda arr, name: F.transform(arr, lambda c: F.struct(c.alias("clause"), F.lit(name).alias("kind")))
    marks = r.select(F.explode(F.concat(kind(F.array_intersect("p", "q"), "tp"), kind(F.array_except("p", "q"), "fp"), kind(F.array_except("q", "p"), "fn"))).alias("m"))
    return marks.groupBy(F.col("m.clause").alias("clause")).agg(*[F.count_if(F.col("m.kind") == k).alias(k) for k in ("tp", "fp", "fn")])


@query(
    f"""WITH r AS ({_RATED}), t AS (SELECT n_chars//100 AS s, count(*) FILTER (quality=1) AS pos, count(*) FILTER (quality=0) AS neg FROM r GROUP BY 1),
w AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS below FROM t)
SELECT round(sum(pos*(below + neg*0.5::double))/(sum(pos)*sum(neg)),6) AS auc, sum(pos)::bigint AS positives, sum(neg)::bigint AS negatives FROM w"""
)
def roc_auc(spark, sf_dir):
    """Area under the curve from counts by score; the ordered part is the distinct scores."""
    r = _rated(spark, sf_dir).select(F.floor(F.col("n_chars") / 100).alias("s"), "quality")
    t = r.groupBy("s").agg(F.count_if(F.col("quality") == 1).alias("pos"), F.count_if(F.col("quality") == 0).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("below", below).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") * 0.5)).alias("x"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    return t.select(F.round(F.col("x") / (F.col("positives") * F.col("negatives")), 6).alias("auc"), "positives", "negatives")


def _items(spark, sf_dir, prefix: str, text: str):
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias(f"{prefix}_id"), F.col("text").alias(text))


_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '[^0-9A-Za-z_]+'), lambda x: x <> ''))"


@query(
    f"""WITH w AS (SELECT item_id, {_WORDS} AS ws FROM benchmark), e AS (SELECT item_id, len(ws) AS n, unnest(ws) AS word FROM w),
p AS (SELECT a.item_id AS claim_id, b.item_id AS evidence_id, count(*) AS shared, any_value(a.n) AS n FROM e a JOIN e b USING (word) WHERE a.item_id <> b.item_id GROUP BY 1,2),
r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY shared DESC, evidence_id) AS r FROM p) SELECT claim_id, evidence_id, shared, round(shared/n::double,6) AS overlap FROM r WHERE r <= 6"""
)
def evidence_overlap_topk(spark, sf_dir):
    pairs = P.sharing_words(_items(spark, sf_dir, "claim", "t"), _items(spark, sf_dir, "evidence", "t"), "claim_id", "evidence_id", "t", "t").where("claim_id <> evidence_id")
    w = Window.partitionBy("claim_id").orderBy(F.desc("shared"), "evidence_id")
    return pairs.withColumn("r", F.row_number().over(w)).where("r <= 6").select("claim_id", "evidence_id", "shared", F.round(F.col("shared") / F.col("a_words"), 6).alias("overlap"))


@query()
def evidence_retrieval(spark, sf_dir):
    return P.retrieve(_items(spark, sf_dir, "claim", "claim"), _items(spark, sf_dir, "evidence", "evidence"))


@query(
    f"""WITH a AS (SELECT item_id, lower(text) AS t, {_WORDS} AS ws FROM benchmark), b AS (SELECT doc_id, lower(text) AS t, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT item_id FROM a, b WHERE contains(b.t, a.t) OR (b.t <> '' AND contains(a.t, b.t)) OR len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))::double > 0.3"""
)
def claim_support_semijoin(spark, sf_dir):
    """Benchmark items that a document supports: Jaccard above .3 of the words, or one text inside the other."""
    d = read_spread(spark, sf_dir, "documents", "doc_id", "text")
    items = _items(spark, sf_dir, "item", "claim")
    some = read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.lit(True).alias("some")).limit(1)
    blank = items.where("claim = ''").crossJoin(some)  # an empty claim is in every text, as the SQL has it
    return P.supported(items, d, "item_id", "doc_id", "claim", "text").select("item_id").unionByName(blank.select("item_id")).distinct()


# The triage of evidence `e` and claim `c` (aliases of rows with text and ws), as logits and shares.
_AGAINST = "regexp_matches({e}.text, '" + G.NEGATIONS.replace("'", "''") + "') AND len(list_filter(list_sort({c}.ws)[1:5], lambda k: contains(lower({e}.text), k))) > 0"
_OVERLAP = "CASE WHEN len({c}.ws) = 0 THEN 0.0 ELSE len(list_intersect({e}.ws, {c}.ws))/len({c}.ws)::double END::double"
_RAW = (
    f"CASE WHEN len({{c}}.ws) = 0 THEN [-1.0, -2.0, 1.0]::double[] WHEN {_AGAINST} THEN [-2.0, 2.0, -1.0]::double[] ELSE [({_OVERLAP})*3-1, -2.0, (1-({_OVERLAP}))*2-1]::double[] END"
)
_SHARES = "list_transform([0.33, 0.33, 0.34]::double[], lambda p, i: exp({r}[i]/{t}::double) / (exp({r}[1]/{t}::double) + exp({r}[2]/{t}::double) + exp({r}[3]/{t}::double)) * 0.5::double + 0.5::double*p)"
_TOP = "CASE WHEN {x}[2] >= 0.5 THEN 'contradict' WHEN {x}[1] >= 0.5 THEN 'support' WHEN {x}[3] >= 0.5 THEN 'insufficient' WHEN {x}[1] = list_max({x}) THEN 'support' WHEN {x}[2] = list_max({x}) THEN 'contradict' ELSE 'insufficient' END"
_BEST = f"""w AS (SELECT item_id AS id, text, {_WORDS} AS ws FROM benchmark), k AS (SELECT a.id AS c_id, b.id AS e_id, len(list_intersect(a.ws, b.ws)) AS shared FROM w a JOIN w b ON a.id <> b.id),
b AS (SELECT c_id, arg_max(e_id, (shared, -e_id)) AS e_id FROM k WHERE shared > 0 GROUP BY c_id)"""


def _triaged(spark, sf_dir):
    """Every item against its best other item as evidence."""
    pairs = P.sharing_words(_items(spark, sf_dir, "c", "t"), _items(spark, sf_dir, "e", "t"), "c_id", "e_id", "t", "t").where("c_id <> e_id")
    best = pairs.groupBy("c_id").agg(F.max_by("e_id", F.struct("shared", -F.col("e_id"))).alias("e_id"))
    return best.join(_items(spark, sf_dir, "c", "claim"), "c_id").join(_items(spark, sf_dir, "e", "evidence"), "e_id")


@query(
    f"""WITH {_BEST}, r AS (SELECT c_id, e_id, {_RAW.format(e="e", c="c")} AS r FROM b JOIN w c ON c.id = c_id JOIN w e ON e.id = e_id), s AS (SELECT c_id, e_id, {_SHARES.format(r="r", t="0.6")} AS x FROM r)
SELECT c_id, e_id, round(x[1], 6) AS support, round(x[2], 6) AS contradict, round(x[3], 6) AS insufficient, {_TOP.format(x="x")} AS label FROM s"""
)
def entailment_triage(spark, sf_dir):
    t = _triaged(spark, sf_dir).withColumn("t", G.triage(F.col("evidence"), F.col("claim")))
    return t.select("c_id", "e_id", *[F.round(f"t.{n}", 6).alias(n) for n in ("support", "contradict", "insufficient")], G.top_label(F.col("t")).alias("label"))


@query(
    rf"""WITH {_BEST}, z AS (SELECT id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')[1:12], ' ') AS text FROM w), h AS (SELECT id, text, {_WORDS} AS ws FROM z),
r AS (SELECT c.text AS long, h.text AS short, {_RAW.format(e="e", c="c")} AS rc, {_RAW.format(e="e", c="h")} AS rm, {_RAW.format(e="c", c="h")} AS rx FROM b JOIN w c ON c.id = c_id JOIN w e ON e.id = e_id JOIN h ON h.id = c_id),
s AS (SELECT lower(trim(long, chr(32)||chr(9)||chr(10)||chr(13))) = lower(short) AS same, {_SHARES.format(r="rc", t="0.6")} AS xc, {_SHARES.format(r="rm", t="0.6")} AS xm, {_SHARES.format(r="rx", t="0.6")} AS xx FROM r),
l AS (SELECT same, greatest(xc[2], xm[2], xx[2]) >= 0.5 AS against, {_TOP.format(x="xc")} AS a, {_TOP.format(x="xm")} AS b, {_TOP.format(x="xx")} AS m FROM s),
o AS (SELECT CASE WHEN against THEN 5 WHEN same AND a = 'support' THEN 1 WHEN a = 'support' AND b = 'support' AND m = 'support' THEN 2 WHEN a = 'support' AND m <> 'support' THEN 3 WHEN b = 'support' AND a <> 'support' THEN 4 WHEN a = 'insufficient' AND b = 'insufficient' AND m = 'insufficient' THEN 7 ELSE 6 END AS outcome FROM l)
SELECT outcome, count(*) AS n, outcome IN (1, 2, 4, 7) AS desirable FROM o GROUP BY outcome"""
)
def claim_outcomes(spark, sf_dir):
    """Outcomes 1 to 7 and the share of desirable ones."""
    t = _triaged(spark, sf_dir)
    short = F.array_join(F.slice(X.words(F.col("claim")), 1, 12), " ")
    c, m, x = G.triage(F.col("evidence"), F.col("claim")), G.triage(F.col("evidence"), short), G.triage(F.col("claim"), short)
    got = t.withColumn("c", c).withColumn("m", m).withColumn("x", x).select(G.outcome(F.lower(X.strip(F.col("claim"))) == F.lower(X.strip(short)), F.col("c"), F.col("m"), F.col("x")).alias("outcome"))
    return got.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("outcome").isin(1, 2, 4, 7)).alias("desirable"))


@query(
    f"""WITH {_BEST}, r AS (SELECT {_RAW.format(e="e", c="c")} AS r FROM b JOIN w c ON c.id = c_id JOIN w e ON e.id = e_id), t AS (SELECT unnest([0.4, 0.6, 0.8, 1.0, 1.2])::double AS temperature),
m AS (SELECT temperature, round(avg(-ln(greatest(({_SHARES.format(r="r", t="temperature")})[1], 1e-9))), 6) AS mean_nll FROM r, t GROUP BY temperature) SELECT temperature, mean_nll, mean_nll = min(mean_nll) OVER () AS best FROM m"""
)
def calibration_grid(spark, sf_dir):
    """Mean negative log-likelihood of the label `support` for every temperature; the least one is marked."""
    t = _triaged(spark, sf_dir)
    parts = [t.select(F.lit(T).alias("temperature"), (-F.log(F.greatest(G.triage(F.col("evidence"), F.col("claim"), T)["support"], F.lit(1e-9)))).alias("nll")) for T in (0.4, 0.6, 0.8, 1.0, 1.2)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    means = rows.groupBy("temperature").agg(F.round(F.avg("nll"), 6).alias("mean_nll"))
    return means.withColumn("best", F.col("mean_nll") == F.min("mean_nll").over(Window.partitionBy()))


@query(
    """WITH s AS (SELECT doc_id, least(1.0::double, (length(text)//100)/40.0::double) AS e, CASE WHEN lang='en' THEN 1.0 ELSE 0.5 END::double AS b, (doc_id % 5)/4.0::double AS g, CASE WHEN source='src0' THEN 1.0 ELSE 0.0 END::double AS p FROM documents)
SELECT doc_id, round(e*0.4::double+b*0.3::double+g*0.2::double+p*0.1::double, 2) AS total FROM s"""
)
def debate_scores(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    # Steps of a fortieth keep totals on whole hundredths, where engines round alike.
    e, b = F.least(F.lit(1.0), F.floor(F.length("text") / 100) / 40.0), F.when(F.col("lang") == "en", 1.0).otherwise(0.5)
    return d.select("doc_id", G.total_score(e, b, (F.col("doc_id") % 5) / 4.0, F.when(F.col("source") == "src0", 1.0).otherwise(0.0)).alias("total"))


def _any(patterns, joined=" OR "):
    return "(" + joined.join(f"regexp_matches(text, '(?i){p}')" + ("" if joined == " OR " else "::int") for p in patterns) + ")"


_FACTS = f"""(list_has_any(ws, {list(X.FACT_VERBS)}) AND len(list_filter(ws, lambda x: length(x) > 3 AND x NOT IN {X.PLAIN_WORDS})) >= CASE WHEN list_has_any(ws, {list(X.PARTICIPLES)}) THEN 1 ELSE 2 END)"""


_MARKED = f"*, {_FACTS} AS fact, {_any(X.HEDGES)} AS hedged, {_any(X.VERIFIABLE, ' + ')} AS n, contains(text,'```') AS fence, contains(text,'{{') AS brace, contains(text,'[') AS bracket"
_VERIFIABLE = f"NOT regexp_matches(lower(trim(text)), '{X.GENERIC}') AND (fence OR brace OR bracket OR n > 0 OR fact)"
_CONFIDENCE = """round(greatest(0.0, least(1.0, 0.5::double + least(n*0.1::double, 0.3::double) + CASE WHEN fence THEN 0.1 ELSE 0.0 END::double + CASE WHEN brace AND contains(text,'}') THEN 0.1 ELSE 0.0 END::double + CASE WHEN bracket AND contains(text,']') THEN 0.05 ELSE 0.0 END::double
 + CASE WHEN fact THEN 0.1 ELSE 0.0 END::double - CASE WHEN hedged THEN 0.2 ELSE 0.0 END::double)), 4)"""
_SPLIT_WORDS = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS ws"


@query(f"WITH w AS (SELECT item_id, text, {_SPLIT_WORDS} FROM benchmark), t AS (SELECT {_MARKED} FROM w) SELECT item_id, {_VERIFIABLE} AS verifiable, hedged, fact AS fact_structure, {_CONFIDENCE} AS confidence FROM t")
def verifiable_score(spark, sf_dir):
    t = F.col("text")
    return read_table(spark, sf_dir, "benchmark").select("item_id", X.is_verifiable(t).alias("verifiable"), X.is_hedged(t).alias("hedged"), X.has_fact_structure(t).alias("fact_structure"), F.round(X.claim_confidence(t), 4).alias("confidence"))
