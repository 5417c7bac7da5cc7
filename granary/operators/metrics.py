"""Metrics of judgements and runs: preferences, clauses, claims, curves, calibration, gates."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import judging as G
from granary.operators.quantiles import order_statistics


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _f1(p: Column, r: Column) -> Column:
    return _ratio(2 * p * r, p + r)


def preference_accuracy(df: DataFrame, said: Column, wanted: Column, ties: str = "exclude") -> DataFrame:
    """One row: accuracy, macro precision and recall of preferences 0 and 1, and F1 of those; -1 is a tie.

    Rows with a tie on either side are left out (`exclude`), wrong (`penalize`), or right where both are ties (`count_as_correct`).
    """
    if ties not in ("exclude", "penalize", "count_as_correct"):
        raise ValueError(ties)
    tied = (said == -1) | (wanted == -1)
    counted = ~tied if ties == "exclude" else F.lit(True)
    right = (said == wanted) & (F.lit(ties == "count_as_correct") | ~tied)
    n = lambda x, y: F.count_if((said == x) & (wanted == y))
    c = df.agg(F.count_if(counted & right).alias("right"), F.count_if(counted).alias("n"), n(0, 0).alias("a"), n(0, 1).alias("b"), n(1, 0).alias("c"), n(1, 1).alias("d"))
    part = lambda x, y: _ratio(F.col(x), F.col(x) + F.col(y))
    c = c.withColumns({"precision_macro": (part("a", "b") + part("d", "c")) / 2, "recall_macro": (part("a", "c") + part("d", "b")) / 2})
    return c.select(_ratio(F.col("right"), F.col("n")).alias("accuracy"), "precision_macro", "recall_macro", _f1(F.col("precision_macro"), F.col("recall_macro")).alias("f1"), "n")


def clause_scores(df: DataFrame, said: Column, wanted: Column) -> DataFrame:
    """Precision, recall, F1 and support of each clause, and of all together (clause null); sets, so repeated clauses count once."""
    mark = lambda arr, kind: F.transform(arr, lambda c: F.struct(c.alias("clause"), F.lit(kind).alias("kind")))
    none = F.array().cast("array<string>")
    p, q = F.coalesce(said, none), F.coalesce(wanted, none)
    marks = df.select(F.explode(F.concat(mark(F.array_intersect(p, q), "tp"), mark(F.array_except(p, q), "fp"), mark(F.array_except(q, p), "fn"))).alias("m"))
    counts = marks.groupBy(F.col("m.clause").alias("clause")).agg(*[F.count_if(F.col("m.kind") == k).alias(k) for k in ("tp", "fp", "fn")])
    total = counts.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("tp", "fp", "fn")]).select(F.lit(None).cast("string").alias("clause"), "tp", "fp", "fn")
    both = counts.unionByName(total).withColumns({"precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return both.select("clause", "tp", "fp", "fn", "precision", "recall", _f1(F.col("precision"), F.col("recall")).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def claim_scores(found: DataFrame, gold: DataFrame, results: DataFrame) -> DataFrame:
    """One row of extraction and verification scores. `found`, `gold`: (id, statement); `results`: (claim_id, status), one for each id.

    Extraction compares the distinct statements. A found claim counts in verification by its status: verified ones are right if gold has
    their statement, unverified ones are missed then, each once. Coverage: gold claims whose statement was found and whose id is verified.
    """
    ok = results.where("status = 'VERIFIED'").select(F.col("claim_id").alias("_ok")).distinct()
    side = lambda df, n: df.select(F.coalesce("statement", F.lit("")).alias("statement"), F.lit(n).alias("_side"))
    sets = side(found, 1).unionByName(side(gold, 2)).groupBy("statement").agg(F.bit_or("_side").alias("_in"))
    e = sets.agg(F.count_if(F.col("_in") == 3).alias("tp"), F.count_if(F.col("_in") == 1).alias("fp"), F.count_if(F.col("_in") == 2).alias("fn"))
    mine = found.join(ok, found["id"] == ok["_ok"], "left").select(F.coalesce("statement", F.lit("")).alias("statement"), F.col("_ok").isNotNull().alias("verified"))
    mine = mine.groupBy("statement").agg(F.count(F.lit(1)).alias("n"), F.count_if("verified").alias("good")).join(sets.where("_in in (1, 3)"), "statement")
    v = mine.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for n, x in (("vtp", F.when(F.col("_in") == 3, F.col("good"))), ("vfp", F.when(F.col("_in") == 1, F.col("good"))), ("vfn", F.when(F.col("_in") == 3, F.col("n") - F.col("good"))))])
    theirs = gold.join(ok, gold["id"] == ok["_ok"], "left").groupBy(F.coalesce("statement", F.lit("")).alias("statement")).agg(F.count(F.lit(1)).alias("n"), F.count("_ok").alias("good"))
    g = theirs.join(sets.where("_in in (2, 3)"), "statement").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("gold"), F.coalesce(F.sum(F.when(F.col("_in") == 3, F.col("good"))), F.lit(0)).alias("covered"))
    one = e.join(F.broadcast(v)).join(F.broadcast(g))
    ratios = {"extraction_precision": ("tp", "fp"), "extraction_recall": ("tp", "fn"), "verification_precision": ("vtp", "vfp"), "verification_recall": ("vtp", "vfn")}
    one = one.withColumns({k: _ratio(F.col(a), F.col(a) + F.col(b)) for k, (a, b) in ratios.items()})
    f1 = lambda k: _f1(F.col(f"{k}_precision"), F.col(f"{k}_recall")).alias(f"{k}_f1")
    return one.select(*ratios, f1("extraction"), f1("verification"), _ratio(F.col("covered"), F.col("gold")).alias("coverage"))


def roc_curve(df: DataFrame, score: Column, positive: Column, parts: int = 1024) -> DataFrame:
    """threshold, fpr, tpr of each distinct score in [0, 1], from the highest: the shares of rows at or above it. Rows are counted by
    score, then summed in two levels (ranges of scores, then within), so no task orders all scores."""
    t = df.select(score.cast("double").alias("threshold"), positive.cast("boolean").alias("_p")).where("threshold is not null and _p is not null")
    t = t.groupBy("threshold").agg(F.count_if("_p").alias("_pos"), F.count_if(~F.col("_p")).alias("_neg")).withColumn("_range", F.floor(F.col("threshold") * parts))
    sums = t.groupBy("_range").agg(F.sum("_pos").alias("_rp"), F.sum("_neg").alias("_rn"))
    above = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_range", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(n) for c, n in (("_rp", "_bp"), ("_rn", "_bn"))])
    total = sums.agg(F.sum("_rp").alias("_tp"), F.sum("_rn").alias("_tn"))
    within = Window.partitionBy("_range").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    both = t.withColumns({"_cp": F.sum("_pos").over(within), "_cn": F.sum("_neg").over(within)}).join(bases, "_range").join(F.broadcast(total))
    return both.select("threshold", _ratio(F.col("_bn") + F.col("_cn"), F.col("_tn")).alias("fpr"), _ratio(F.col("_bp") + F.col("_cp"), F.col("_tp")).alias("tpr"), _ratio(F.col("_neg"), F.col("_tn")).alias("_dx"), _ratio(F.col("_pos"), F.col("_tp")).alias("_dy"))


def curve_area(curve: DataFrame) -> DataFrame:
    """One row: the area under a roc_curve by trapezoids; each point has its step, so no order is needed. Null without both classes."""
    x, y = F.sum("_dx"), F.sum("_dy")
    return curve.agg(F.when((x > 0.5) & (y > 0.5), F.sum(F.col("_dx") * (F.col("tpr") - F.col("_dy") / 2))).alias("auc"))


def halt_summary(df: DataFrame, chance: Column, length: Column, reference: Column) -> DataFrame:
    """One row: mean expected length (between reference and full length by the chance to halt), its ratio, mean and deviation of the chance."""
    s = df.agg(F.avg(reference * (1 - chance) + length * chance).alias("expected_length"), F.avg(reference).alias("reference_length"), F.avg(chance).alias("mean"), F.stddev_pop(chance).alias("std"), F.count(F.lit(1)).alias("n"))
    return s.select("expected_length", "reference_length", _ratio(F.col("expected_length"), F.col("reference_length")).alias("length_ratio"), "mean", "std", "n")


def best_calibration(df: DataFrame, evidence: Column, claim: Column, label: Column, temperatures: tuple[float, ...], biases: tuple[float, ...] = (0.0,)) -> DataFrame:
    """The grid's point of least mean negative log-likelihood (the first of equal ones): temperature, the three biases, mean, median and
    95th percentile of the losses. Priors are the labels' shares.

    Every row meets every point, the means are summed within tasks, and only the best point's losses are ordered.
    """
    names = ("support", "contradict", "insufficient")
    prior = df.agg(F.count(label).alias("_n"), *[F.count_if(label == n).alias(f"_p{i}") for i, n in enumerate(names)])
    rows = df.select(F.size(G.token_words(claim)).alias("_w"), G.overlap_ratio(evidence, claim).alias("_o"), G.contradicts(evidence, claim).alias("_c"), label.alias("_l")).where(F.col("_l").isin(*names))
    points = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("temperature", *names), p)], F.lit(i).alias("place")) for i, p in enumerate(product(temperatures, biases, biases, biases))])
    losses = rows.join(F.broadcast(prior)).withColumn("_g", F.explode(points))
    e = [F.exp(r / F.col("_g.temperature") + F.col(f"_g.{n}")) for r, n in zip(G.overlap_logits(F.col("_o"), F.col("_c"), F.col("_w") == 0), names)]
    chance = [x / (e[0] + e[1] + e[2]) * 0.5 + 0.5 * F.col(f"_p{i}") / F.col("_n") for i, x in enumerate(e)]
    own = F.coalesce(*[F.when(F.col("_l") == n, c) for n, c in zip(names, chance)])
    losses = losses.select("_g", (-F.log(F.greatest(own, F.lit(1e-9)))).alias("nll"))
    best = losses.groupBy("_g").agg(F.avg("nll").alias("mean_nll")).agg(F.min(F.struct(F.round("mean_nll", 12), F.col("_g.place"))).alias("_b"), F.min_by("_g", F.struct(F.round("mean_nll", 12), F.col("_g.place"))).alias("_g"), F.min_by("mean_nll", F.struct(F.round("mean_nll", 12), F.col("_g.place"))).alias("mean_nll")).drop("_b")
    own_losses = losses.join(F.broadcast(best.select(F.col("_g.place").alias("_at"))), F.col("_g.place") == F.col("_at")).withColumn("_one", F.lit(1))
    half = {"_a": lambda n: F.floor((n - 1) / 2), "_b": lambda n: F.floor(n / 2), "p95_nll": lambda n: F.greatest(F.floor(n * 0.95) - 1, F.lit(0))}
    q = order_statistics(own_losses, ["_one"], F.col("nll"), half)
    return best.join(F.broadcast(q)).select(*[F.col(f"_g.{n}").alias(n) for n in ("temperature", *names)], "mean_nll", ((F.col("_a") + F.col("_b")) / 2).alias("p50_nll"), "p95_nll")


def code_gates(df: DataFrame, baseline_tokens: float | None, least_gain: float = 0.25, least_rate: float = 0.6) -> DataFrame:
    """One row over rows of tokens_total, leak, used_code, eligible: sums, rate of use among eligible rows, and three gates. A gate that has
    nothing to compare with (no baseline, no eligible row) passes."""
    s = df.agg(
        F.coalesce(F.sum("tokens_total"), F.lit(0)).alias("tokens"), F.count_if("leak").alias("leaks"), F.count_if(F.col("eligible") & F.col("used_code")).alias("adopted"), F.count_if("eligible").alias("eligible")
    )
    gain = F.lit(None).cast("double") if not baseline_tokens else (F.lit(float(baseline_tokens)) - F.col("tokens")) / F.lit(float(baseline_tokens))
    s = s.withColumns({"gain": gain, "rate": F.col("adopted") / F.greatest(F.col("eligible"), F.lit(1))})
    gates = {"tokens_gate": F.coalesce(F.col("gain") >= least_gain, F.lit(True)), "leak_gate": F.col("leaks") == 0, "use_gate": (F.col("eligible") == 0) | (F.col("rate") >= least_rate)}
    return s.withColumns(gates).withColumn("passed", F.col("tokens_gate") & F.col("leak_gate") & F.col("use_gate"))


def speed_errors(now: Column, base: Column, same_hardware: Column, most: float = 0.05, most_first: float = 25.0, least_share: float = 0.8, most_drop: float = 0.1) -> Column:
    """Names of the failed gates of a run: structs of ttft_p50, ttft_p95, tps_p50, tps_p95, ttfa_p95, share (of time on the accelerator).

    Other hardware or no baseline fails nothing. Times may grow and rates fall by `most` of a baseline above zero; a null first-answer count
    fails; a null share is no gate.
    """
    none = F.array().cast("array<string>")
    grown = lambda k: (base[k] > 0) & ((now[k] - base[k]) / base[k] > most)
    fallen = lambda k: (base[k] > 0) & ((base[k] - now[k]) / base[k] > most)
    tests = [(k, grown(k)) for k in ("ttft_p50", "ttft_p95")] + [(k, fallen(k)) for k in ("tps_p50", "tps_p95")]
    tests += [("ttfa_p95", F.coalesce(now["ttfa_p95"] > most_first, F.lit(True))), ("share", now["share"] < least_share), ("share_drop", (base["share"] > 0) & ((base["share"] - now["share"]) / base["share"] > most_drop))]
    failed = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests]))
    return F.when(base.isNull() | ~F.coalesce(same_hardware, F.lit(False)), none).otherwise(failed)


def run_summary(runs: DataFrame, accuracy: str, tokens: str, ms: str, loops: str) -> DataFrame:
    """One row: means and deviations of a run's accuracy, tokens, time and loops, to be kept as its baseline."""
    parts = {"accuracy": accuracy, "tokens": tokens, "time_ms": ms, "loops": loops}
    return runs.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{p}_{k}") for k, c in parts.items() for p, f in (("mean", F.avg), ("std", F.stddev_pop))])


def save_baseline(summary: DataFrame, path: str, run_id: str, seed: int, task: str) -> None:
    """Write a run's one-row summary with its id, seed and task as JSON."""
    own = summary.select(F.lit(run_id).alias("run_id"), F.lit(seed).alias("seed"), F.lit(task).alias("task_name"), F.struct(*summary.columns).alias("metrics"), F.current_timestamp().cast("string").alias("timestamp"))
    own.coalesce(1).write.mode("errorifexists").json(path)
