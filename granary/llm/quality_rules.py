r"""Quality rules with distribution divergence.

Words are runs of bytes other than space, tab, newline, vertical tab, form feed and carriage return. Base features: word_chars (code
points in words), n_symbols (characters of ``#*$%&|<>``), n_dup_lines (lines with a word that equal an earlier line), n_repeat_words
(words covered by 8-word windows that occur twice or more in the text). base_failed: n_words < 20 or 100 * n_repeat_words > 30 * n_words.

References: every language's histograms over all documents of that language, one of character classes and one of its common words
(each with at least COMMON_SHARE of the language's words, so at most 1 / COMMON_SHARE of them) with the rest as one bin. Common words
are found in two passes: tasks pass on only words with a tenth of that share in what they hold, which no common word can slip through,
and then those that may be common are counted exactly. A document is measured by the Jensen-Shannon distance (base 2, 0 to 1) to the
nearest reference (the least sum of both distances; of equal ones the language first in order), so a wrong language label doesn't matter.

Limits come from the documents themselves: of each distance, less a sampling allowance SLACK / sqrt(words), the median and the median
absolute deviation over all documents that are measured. A document fails if one of its distances is an outlier above, by the usual rule
of modified z-scores (over OUTLIER; deviations under LEAST_SPREAD count as that). So the limits hold where most documents are sound.
SLACK is about the distance that sampling alone gives to a dozen evenly filled bins, sqrt(12 / (8 ln 2)). Guard: texts with fewer than
MIN_WORDS words are left to the base rules.

Defined results: a null text has no words and fails; rows without a language count in no reference; without any reference only the
base rules decide; repeated rows are rows of their own; an empty table gives no row; texts are read whole; only the named columns are
read, so others may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import Scratch, ship_package

WINDOW = 8
COMMON_SHARE, MIN_WORDS = 0.002, 50
#: Modified z-scores are 0.6745 times the distance from the median in median absolute deviations; above 3.5 is an outlier.
OUTLIER, SLACK, LEAST_SPREAD = 3.5 / 0.6745, 1.5, 0.01
#: Words that a task holds before it passes its counts on.
HELD_WORDS = 200_000
_SYMBOLS = "#*$%&|<>"

CLASSES = ("lower", "upper", "digit", "blank", "stop", "quote", "symbol", "other", "letter")


def _byte_classes() -> np.ndarray:
    """Class of a UTF-8 byte; continuation bytes have the extra class at the end, which isn't counted."""
    t = np.full(256, CLASSES.index("other"), dtype=np.uint8)
    for name, chars in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("blank", " \t\n\r\x0b\x0c"), ("stop", ".,;:?"), ("quote", "'\"()-"), ("symbol", _SYMBOLS + "!@^_=+~\\/[]{}`")):
        for c in chars:
            t[ord(c)] = CLASSES.index(name)
    t[0xC0:] = CLASSES.index("letter")
    t[0x80:0xC0] = len(CLASSES)
    return t


_BYTES = _byte_classes()
_SYMBOL_BYTES = np.isin(np.arange(256), [ord(c) for c in _SYMBOLS])


def class_counts(data: bytes) -> np.ndarray:
    return np.bincount(_BYTES[np.frombuffer(data, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]


def repeated_words(words: list[bytes]) -> int:
    """Words in 8-word windows that occur twice or more; equality is exact, by ranks of 2, 4 and 8 words."""
    n = len(words)
    if n <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    rank = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    # Windows that are equal have equal hashes, so without equal hashes there is no repeat.
    mixed = (rank.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    h = np.zeros(n - WINDOW + 1, np.uint64)
    for i in range(WINDOW):
        h = h * np.uint64(0xD1342543DE82EF95) + mixed[i : n - WINDOW + 1 + i]
    h.sort()
    if not (h[1:] == h[:-1]).any():
        return 0
    for step in (1, 2, 4):
        m = len(rank) - step
        rank = np.unique(rank[:m] * np.int64(n + 1) + rank[step:], return_inverse=True)[1]
    twice = np.bincount(rank)[rank] > 1
    cover = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + WINDOW, -1)
    return int((cover.cumsum()[:n] > 0).sum())


def base_features(text: str | None) -> tuple[list[bytes], np.ndarray, dict]:
    """Words, character-class counts and base features."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    arr = np.frombuffer(data, np.uint8)
    classes = class_counts(data)
    points = int((arr & 0xC0 != 0x80).sum()) if len(arr) else 0
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    n_rep = repeated_words(words)
    n = len(words)
    return words, classes, {
        "n_words": n,
        "word_chars": points - int(classes[CLASSES.index("blank")]),
        "n_symbols": int(_SYMBOL_BYTES[arr].sum()),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": n_rep,
        "base_failed": n < 20 or 100 * n_rep > 30 * n,
    }


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language: kind 0 are character classes, kind 1 words that may be common, kind 2 all words."""
    words: dict[str, Counter] = {}
    classes: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang in sorted(words):
            cls, total = classes[lang], sum(words[lang].values())
            c = {w: n for w, n in words[lang].items() if n >= COMMON_SHARE / 10 * total}
            keys = [str(i).encode() for i in range(len(cls))] + list(c) + [b""]
            kinds = [0] * len(cls) + [1] * len(c) + [2]
            counts = [*cls.tolist(), *c.values(), total]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(kinds, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.int64())], ["lang", "kind", "key", "n"])
        words.clear()
        classes.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            data = text.as_py().encode("utf-8", "surrogatepass")
            key = lang.as_py()
            words.setdefault(key, Counter()).update(data.split())
            classes[key] = classes.get(key, 0) + class_counts(data)
            if sum(map(len, words.values())) > HELD_WORDS:
                yield from flush()
    yield from flush()


def _exact_batches(wanted: dict[str, set[bytes]]):
    """Counts of the wanted words of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = wanted.get(lang, ())
                counts.update((lang, w) for w in text.as_py().encode("utf-8", "surrogatepass").split() if w in own)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.binary()), pa.array(counts.values(), pa.int64())], ["lang", "key", "n"])

    return run


class References:
    """Per language: shares of character classes, common words and their shares."""

    def __init__(self, rows: list[tuple[str, int, bytes, int]]):
        self.languages = sorted({r[0] for r in rows})
        self.classes: dict[str, np.ndarray] = {}
        self.words: dict[str, dict[bytes, int]] = {}
        self.shares: dict[str, np.ndarray] = {}
        for lang in self.languages:
            own = [r for r in rows if r[0] == lang]
            c = np.zeros(len(CLASSES))
            for _, kind, key, n in own:
                if kind == 0:
                    c[int(key)] = n
            self.classes[lang] = c / max(1.0, c.sum())
            total = max(1, sum(n for _, kind, _, n in own if kind == 2))
            common = sorted((bytes(key), n) for _, kind, key, n in own if kind == 1)
            self.words[lang] = {w: i for i, (w, _) in enumerate(common)}
            shares = np.array([n / total for _, n in common])
            self.shares[lang] = np.append(shares, max(0.0, 1 - shares.sum()))


def references(spark: SparkSession, docs: DataFrame, text: str = "text", lang: str = "lang") -> References:
    """Histograms over all documents with a text and a language."""
    ship_package(spark)
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    scratch = Scratch(spark, "histograms")
    counts = scratch.write(rows.mapInArrow(_count_batches, "lang string, kind int, key binary, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "counts")
    total = F.broadcast(counts.where("kind = 2").select("lang", F.col("n").alias("total")))
    # What tasks kept back of a word is under a tenth of COMMON_SHARE of all words.
    may = counts.join(total, "lang").where((F.col("kind") != 1) | (F.col("n") >= 0.9 * COMMON_SHARE * F.col("total")))
    found = [(r["lang"], r["kind"], bytes(r["key"]), r["n"]) for r in may.select("lang", "kind", "key", "n").collect()]
    totals = {lang: n for lang, kind, _, n in found if kind == 2}
    wanted: dict[str, set[bytes]] = {}
    for lang_, kind, key, _ in found:
        if kind == 1:
            wanted.setdefault(lang_, set()).add(key)
    exact = rows.mapInArrow(_exact_batches(wanted), "lang string, key binary, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).collect()
    common = [(r["lang"], 1, bytes(r["key"]), r["n"]) for r in exact if r["n"] >= COMMON_SHARE * totals[r["lang"]]]
    scratch.close()
    return References([r for r in found if r[1] != 1] + common)


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum()
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum()
    return float(np.sqrt(max(0.0, (a + b) / 2)))


def divergence(refs: References, words: list[bytes], classes: np.ndarray) -> tuple[float, float]:
    """Distances of classes and words to the reference whose sum of both is least."""
    p = classes / max(1, classes.sum())
    best = (np.inf, np.inf)
    counted = Counter(words)
    for lang in refs.languages:
        index = refs.words[lang]
        q = np.zeros(len(index) + 1)
        for w in counted.keys() & index.keys():
            q[index[w]] = counted[w]
        q[-1] = len(words) - q.sum()
        found = (js_distance(p, refs.classes[lang]), js_distance(q / max(1, len(words)), refs.shares[lang]))
        if sum(found) < sum(best):
            best = found
    return best


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_OUT = pa.struct([(n, pa.int64()) for n in _NAMES] + [("base_failed", pa.bool_()), ("class_distance", pa.float64()), ("word_distance", pa.float64())])


def rule_column(spark: SparkSession, refs: References):
    """A function of a text column that gives features, base_failed and, for texts that are measured, distances."""
    ship_package(spark)
    sent = spark.sparkContext.broadcast(refs)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for x in batch:
                words, classes, row = base_features(x.as_py())
                measured = len(words) >= MIN_WORDS and sent.value.languages
                a, b = divergence(sent.value, words, classes) if measured else (None, None)
                rows.append(row | {"class_distance": a, "word_distance": b})
            yield pa.array(rows, _OUT)

    return F.arrow_udf(run, ", ".join(f"{n} long" for n in _NAMES) + ", base_failed boolean, class_distance double, word_distance double")


def limits(measured: DataFrame) -> tuple[float, float]:
    """Limits of both distances, less the allowance, from all measured documents; infinite without one."""
    less = lambda c: F.col(c) - SLACK / F.sqrt("n_words")
    names = ["class_distance", "word_distance"]
    middle = measured.agg(*[F.percentile_approx(less(c), 0.5, 10_000).alias(c) for c in names]).first()
    if middle[names[0]] is None:
        return float("inf"), float("inf")
    spread = measured.agg(*[F.percentile_approx(F.abs(less(c) - middle[c]), 0.5, 10_000).alias(c) for c in names]).first()
    return tuple(middle[c] + OUTLIER * max(LEAST_SPREAD, spread[c]) for c in names)


def apply_rules(spark: SparkSession, docs: DataFrame, refs: References, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document with its features, distances and verdict."""
    rows = Scratch(spark, "rules").write(docs.select(F.col(id_col), rule_column(spark, refs)(F.col(text)).alias("_r")).select(id_col, "_r.*"), "rules")
    by_class, by_word = limits(rows.where("class_distance is not null"))
    outlier = F.greatest(F.col("class_distance") - by_class, F.col("word_distance") - by_word) > SLACK / F.sqrt("n_words")
    kept = ~F.col("base_failed") & ~F.coalesce(outlier, F.lit(False))
    return rows.select(id_col, *_NAMES, "base_failed", kept.alias("kept"), "class_distance", "word_distance")
