"""Quality classification by compression.

Two zstandard dictionaries are built, from chunks of good and of bad labelled texts. Every chunk of a text is compressed with both, and
the text's normalised difference is (bytes with the bad dictionary - bytes with the good one) / (sum of both): above zero where the
text is more like the good ones. Logistic regression on labelled texts that built no dictionary calibrates the difference to the score.

Bounds: the dictionaries are built from about SAMPLE_CHUNKS chunks of each class, chosen by a hash of the text and the chunk's place, and
the regression from about CALIBRATION_ROWS texts, chosen by a hash of the text; copies of a text count once; a dictionary has at most
DICT_BYTES bytes. A hash of the text says which half a text is in. If a class has texts in one half only, both steps use all of them.

Defined results: a null text is empty, and an empty text has difference 0; several labels of one text count as bad if any is bad; null
labels are ignored; if a class has no labelled text that isn't empty, every score is the share of good labels (1 without any label);
repeated rows and equal texts have equal scores, and a score at THRESHOLD counts as good; an empty table gives no row; texts are
compressed whole, in chunks; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import Scratch, ship_package

CHUNK, LEVEL, DICT_BYTES = 2048, 3, 65_536
SAMPLE_CHUNKS, CALIBRATION_ROWS, THRESHOLD = 2500, 8000, 0.3


def chunks(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]


class Model:
    """Two dictionaries, and the weights of the regression."""

    def __init__(self, good: bytes, bad: bytes, base: float):
        self.good, self.bad, self.base = good, bad, base
        self.weights: list[float] | None = None
        self._ready: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def difference(self, text: str | None) -> float:
        """The normalised difference of compressed sizes of the whole text."""
        if self._ready is None:
            made = []
            for d in (self.good, self.bad):
                x = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO)
                x.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=x, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
            self._ready = tuple(made)
        good, bad = self._ready
        pieces = chunks(text)
        g, b = sum(len(good(c)) for c in pieces), sum(len(bad(c)) for c in pieces)
        return (b - g) / (b + g) if pieces else 0.0

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.base
        return logistic(self.weights, np.array([[self.difference(text)]]))[0].item()


def logistic(weights: list[float], x: np.ndarray) -> np.ndarray:
    mean, scale, w = (np.array(weights[i::3]) for i in range(3))
    z = ((x - mean[1:]) / scale[1:]) @ w[1:] + w[0]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> list[float]:
    """Newton's method on standardised features; returns (mean, scale, weight) for the constant and each feature."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    penalty = np.diag([0.0] + [ridge] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - p) - penalty @ w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w)), grad)
        w = w + step
        if abs(step).max() < 1e-8:
            break
    return [float(v) for trio in zip([0.0, *mean], [1.0, *scale], w) for v in trio]


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of few samples, their own bytes."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:] or b"\0" * 8


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of each text at the given places."""
    for batch in batches:
        labels, out = [], []
        for y, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            data = text.as_py().encode("utf-8", "surrogatepass")
            labels += [y] * len(places)
            out += [data[p * CHUNK : (p + 1) * CHUNK] for p in places]
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(out, pa.binary())], ["y", "chunk"])


def _difference_column(model: Model):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([model.difference(x.as_py()) for x in batch], pa.float64())

    return F.arrow_udf(run, "double")


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id_col: str = "doc_id") -> Model:
    """Learn from the documents that have a label. Ids only join labels to texts."""
    ship_package(spark)
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label).cast("int")).alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    # Texts are counted and chosen by narrow columns; only the chosen ones, of a bounded number, meet the texts.
    half = F.pmod(F.xxhash64("hash", F.lit(5)), F.lit(2))
    narrow = texts.select("id", "hash", F.ceil(F.octet_length("text") / CHUNK).cast("long").alias("chunks")).join(marks, "id")
    narrow = narrow.groupBy("hash").agg(F.min("y").alias("y"), F.max("chunks").alias("chunks")).withColumn("half", half)
    known = {(r["y"], r["half"]): (r["n"], r["chunks"]) for r in narrow.groupBy("y", "half").agg(F.count(F.lit(1)).alias("n"), F.sum("chunks").alias("chunks")).collect()}
    n = {y: sum(v[0] for k, v in known.items() if k[0] == y) for y in (0, 1)}
    base = n[1] / (n[0] + n[1]) if n[0] + n[1] else 1.0
    if not all(known.get((y, 0), (0, 0))[1] + known.get((y, 1), (0, 0))[1] for y in (0, 1)):
        return Model(b"", b"", base)
    split = all(known.get((y, h), (0, 0))[1] for y in (0, 1) for h in (0, 1))
    builds, calibrates = (F.col("half") == 0, F.col("half") == 1) if split else (F.lit(True), F.lit(True))
    pieces = {y: sum(v[1] for k, v in known.items() if k[0] == y and (k[1] == 0 or not split)) for y in (0, 1)}
    second = sum(v[0] for k, v in known.items() if k[1] == 1 or not split)
    below = lambda share: F.least(share, F.lit(1.0)) * (1 << 30)
    share = F.when(F.col("y") == 1, F.lit(SAMPLE_CHUNKS / pieces[1])).otherwise(F.lit(SAMPLE_CHUNKS / pieces[0]))
    every = F.when(builds & (F.col("chunks") > 0), F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array().cast("array<bigint>"))
    places = F.filter(every, lambda p: F.pmod(F.xxhash64("hash", p), F.lit(1 << 30)) < below(share))
    used = calibrates & (F.pmod(F.xxhash64("hash", F.lit(9)), F.lit(1 << 30)) < below(F.lit(CALIBRATION_ROWS / max(1, second))))
    chosen = narrow.select("hash", "y", places.alias("places"), used.alias("used")).where((F.size("places") > 0) | F.col("used"))
    some = texts.join(F.broadcast(chosen), "hash").select("hash", "y", "places", "used", "text").dropDuplicates(["hash"])
    scratch = Scratch(spark, "labelled")
    some = scratch.write(some, "some")
    cut = some.where(F.size("places") > 0).select("y", "text", "places").mapInArrow(_chunk_batches, "y int, chunk binary")
    sample = sorted((r["y"], bytes(r["chunk"])) for r in cut.collect())
    model = Model(_dictionary([c for y, c in sample if y == 1]), _dictionary([c for y, c in sample if y == 0]), base)
    got = np.array(sorted((r["y"], r["d"]) for r in some.where("used").select("y", _difference_column(model)(F.col("text")).alias("d")).collect()))
    if len(got) and 0 < got[:, 0].mean() < 1:
        model.weights = fit_logistic(got[:, 1:], got[:, 0])
    scratch.close()
    return model


def scorer(spark: SparkSession, model: Model):
    """A function of a text column that gives the score."""
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([sent.value.score(x.as_py()) for x in batch], pa.float64())

    return F.arrow_udf(run, "double")


def classify(spark: SparkSession, docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: score and predicted."""
    scored = docs.select(F.col(id_col), scorer(spark, model)(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


__all__ = ["Model", "classify", "fit_logistic", "held_out", "logistic", "scorer", "train"]
