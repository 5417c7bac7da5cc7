"""Language identification by mixtures of languages.

A document is a bag of character trigrams of its lower-cased letters (other characters are one blank). Each learned language gives
every trigram bucket a smoothed probability. For a set of languages, expectation-maximisation estimates the document's proportions;
the set starts with the single best language and takes in languages, or leaves them out again, while the penalised log-likelihood (half
a log of the number of trigrams for each further language, and one) grows; it may come to hold all learned languages. The language of
the largest proportion is predicted; its proportion is the score.

Training counts come from a bounded sample: about `rows_per_language` different labelled texts of each language, chosen by a hash of the
text (how many there are is counted by a sketch); copies of a text count once. No id is read. The model has at most BUCKETS numbers per
language, so it is sent to every task.

Defined results: a null text, or one without a letter, is `und` with score 0; rows without a language are not learned from but are
predicted; without any labelled row everything is `und`; ties go to the language first in order; repeated rows have equal predictions;
an empty table gives no row; new columns whose names are taken get a number; the law of a text does not depend on other columns. Very
long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.held import alone, small_batches
from granary.session import fresh, ship_package

BUCKETS, ROWS_PER_LANGUAGE, SMOOTH = 1 << 15, 10_000, 0.5
EM_STEPS, TOLERANCE, PENALTY = 40, 1e-3, 1.0


_classes: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Lower-cased code point for letters, 0 for other characters."""
    global _classes
    if _classes is None:
        t = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _classes = t
    return _classes


def _codes(text: str) -> np.ndarray:
    return letter_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def trigram_buckets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's trigrams and their counts; empty without a letter."""
    c = _codes(text)
    c = c[(c != 0) | np.concatenate(([False], c[:-1] != 0))] if len(c) else c
    if not c.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.concatenate((np.zeros(1, np.uint32), c, np.zeros(1, np.uint32)))
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h >>= np.uint32(17)
    if len(h) < 600:
        return np.unique(h, return_counts=True)
    n = np.bincount(h, minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, n[at]


@alone
def _train_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            at, n = trigram_buckets(text)
            total.setdefault(lang, np.zeros(BUCKETS, np.int64))[at] += n
    for lang in sorted(total):
        at = np.flatnonzero(total[lang])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[lang][at], pa.int64())], ["lang", "bucket", "n"])


class Model:
    """Probabilities and their logs, one row per bucket and one column per language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.p = (counts + SMOOTH) / (counts.sum(0) + SMOOTH * BUCKETS)
        self.log_p = np.log(self.p)


def train(spark: SparkSession, labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, text: str = "text", lang: str = "lang") -> Model:
    """Learn from rows with a text and a language."""
    ship_package(spark)
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("hash")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("hash", 0.02).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(int(min(1.0, rows_per_language / max(1, n)) * (1 << 30))))])
    sample = rows.where(F.pmod(F.xxhash64("hash"), F.lit(1 << 30)) < share[F.col("lang")]).dropDuplicates(["lang", "hash"])
    counted = sample.select("lang", "text").mapInArrow(_train_batches, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(sizes)
    column = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((BUCKETS, len(languages)))
    if counted.num_rows:
        np.add.at(counts, (counted["bucket"].to_numpy(), np.array([column[x] for x in counted["lang"].to_pylist()])), counted["n"].to_numpy())
    return Model(languages, counts)


def _fit(q: np.ndarray, weight: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions by EM from a first guess, and their log-likelihood."""
    total = weight.sum()
    for _ in range(EM_STEPS):
        old = pi
        pi = pi * ((weight / (q @ pi)) @ q) / total
        if abs(pi - old).max() < TOLERANCE:
            break
    return pi, weight @ np.log(q @ pi)


def mixture(p: np.ndarray, log_p: np.ndarray, n: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The chosen languages and their proportions; p and log_p: (trigrams, languages), n: counts.

    The likelihood is concave in the proportions, so its slope towards a further language bounds what that language can gain: EM runs
    only where the bound exceeds the penalty. A language that later ones have made idle goes again.
    """
    weight = n.astype(np.float64)
    total = weight.sum()
    penalty = PENALTY * 0.5 * np.log(total + 1) + 1.0
    single = weight @ log_p
    chosen = [int(np.argmax(single))]
    best, pi = single[chosen[0]], np.ones(1)
    while True:
        slope = (weight / (p[:, chosen] @ pi)) @ p - total
        slope[chosen] = -np.inf
        extra = int(np.argmax(slope))
        if slope[extra] <= penalty:
            return chosen, pi
        new, gained = _fit(p[:, [*chosen, extra]], weight, np.append(pi * 0.8, 0.2))
        if gained - best <= penalty:
            return chosen, pi
        chosen, pi, best = [*chosen, extra], new, gained
        while len(chosen) > 2:
            fits = []
            for i in range(len(chosen) - 1):
                left = np.delete(pi, i) + 1e-3
                fits.append(_fit(p[:, chosen[:i] + chosen[i + 1 :]], weight, left / left.sum()))
            i = max(range(len(fits)), key=lambda x: fits[x][1])
            if best - fits[i][1] >= penalty:
                break
            pi, best = fits[i]
            del chosen[i]


def predict(model: Model, text: str | None) -> tuple[str, float, list[str], list[float]]:
    """Language, score, languages of the mixture and their proportions."""
    at, n = trigram_buckets(text) if text and model.languages else ((), ())
    if not len(at):
        return "und", 0.0, [], []
    chosen, pi = mixture(model.p[at], model.log_p[at], n)
    order = sorted(range(len(chosen)), key=lambda i: (-pi[i], chosen[i]))
    return model.languages[chosen[order[0]]], float(min(1.0, pi[order[0]])), [model.languages[chosen[i]] for i in order], [float(pi[i]) for i in order]


_OUT = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())), ("proportions", pa.list_(pa.float64()))])


def predictor(spark: SparkSession, model: Model):
    """A function of a text column that gives lang_pred, score, languages and proportions."""
    ship_package(spark)
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, languages array<string>, proportions array<double>")
    @alone
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        for batch in batches:
            yield pa.array([dict(zip(("lang_pred", "score", "languages", "proportions"), predict(m, x.as_py()))) for x in batch], _OUT)

    return run


def identify(spark: SparkSession, docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with the prediction in new columns."""
    (r,) = fresh(docs, "_language")
    names = ["lang_pred", "score", "languages", "proportions"]
    new = [F.col(f"{r}.{n}").alias(c) for n, c in zip(names, fresh(docs, *names))]
    return docs.withColumn(r, predictor(spark, model)(F.col(text))).select(*docs.columns, *new)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2
