r"""Secret scan: fixed patterns and a battery of randomness tests.

Base kinds (leftmost, non-overlapping, per kind): ``assign`` (a keyword, a separator and a value of 12 or more characters), ``access``
(``AKIA`` and capitals or digits, 18 or more characters), ``hex`` (16 or more of 0-9a-f). A match that is too short is dropped.

Kind ``random``: runs of 20 or more characters of ``[A-Za-z0-9+/_-]``, outside base spans (a run is cut at them). The smallest usual
alphabet that holds the run is its inferred encoding. A run with signs of both base64 alphabets fits none: it is cut once at the signs
of the one and once at those of the other, and each part of 20 or more characters is a run of its own; where random parts overlap, the
span is all of them.

Three tests look for departures from randomness over that alphabet: chi-squared uniformity, runs of one character class (lower case,
capitals, digits, signs), lag-1 serial correlation. The battery's statistic is Fisher's sum of their p-values. A secret is a discovery against the hypothesis that
a run was written (words, numbers, identifiers): its p-value is the chance that a written run of this alphabet and this length has a
statistic as small. The statistic of written runs grows with their length, so the same randomness says more in a longer run. That law
is simulated once, from a chain of character classes with letter shares that fall as 1 / (rank + 2) (two letters are equal
with a chance of 0.061, in European languages of 0.065 and more), and its cube root is taken as normal below the median. Benjamini-Hochberg at FDR over a document's runs with an inferred encoding decides;
others, such as plain words, are no hypotheses. A discovery must also be random itself: Fisher's own p-value is at least RANDOM_P.

Offsets are code points, ends exclusive. Defined results: a null text is empty; a text without a match has the digest of the empty
string; an empty table gives no row; repeated rows are rows of their own; equal p-values go together, by the rule of the largest rank;
texts are read whole, in time that follows their length; only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.held import alone, small_batches
from granary.session import ship_package

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = 20
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
_SIGNS, _URL_SIGNS = re.compile("[+/]"), re.compile("[_-]")
_WITHOUT_SIGNS, _WITHOUT_URL_SIGNS = re.compile(r"[A-Za-z0-9_-]{20,}"), re.compile(r"[A-Za-z0-9+/]{20,}")
KINDS = ("assign", "access", "hex", "random")
RANDOM_P, FDR = 0.001, 0.01
#: Lengths and number of the runs from which the law of written runs is simulated.
LAW_LENGTHS, LAW_RUNS = (20, 26, 34, 45, 60, 90, 150, 300), 1000

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = [
    ("hex", _DIGITS + "abcdef"),
    ("HEX", _DIGITS + "ABCDEF"),
    ("base32", _UPPER + "234567"),
    ("base36", _DIGITS + _LOWER),
    ("BASE36", _DIGITS + _UPPER),
    ("base62", _UPPER + _LOWER + _DIGITS),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
]
#: Codes follow the order of the characters themselves, in which capitals, digits and lower case lie apart.
_INDEX = [(name, {c: i for i, c in enumerate(sorted(chars))}) for name, chars in ALPHABETS]
_CLASS = {c: k for k, chars in enumerate((_LOWER, _UPPER, _DIGITS, "+/_-")) for c in chars}
#: How written words, numbers and identifiers go on, from and to lower case, capitals, digits and signs; first classes are even.
_GOES_ON = ((0.80, 0.12, 0.04, 0.04), (0.60, 0.32, 0.04, 0.04), (0.06, 0.06, 0.80, 0.08), (0.40, 0.25, 0.25, 0.10))


def infer_encoding(run: str) -> tuple[str, dict[str, int]] | None:
    """The smallest alphabet that holds the run; none for plain words and numbers."""
    seen = set(run)
    if len({_CLASS[c] for c in seen} - {3}) < 2:
        return None
    return next(((name, index) for name, index in _INDEX if seen <= index.keys()), None)


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def batteries(codes: np.ndarray, k: int, groups: np.ndarray | None = None) -> np.ndarray:
    """p-values of chi-squared uniformity, runs and serial correlation for each line of codes, which are 0 to k-1.

    A run is a stretch of one of `groups` (a number for each code; by default the lower and the upper half of the alphabet).
    """
    m, n = codes.shape
    counts = np.bincount((np.arange(m)[:, None] * k + codes).ravel(), minlength=m * k).reshape(m, k)
    chi = (counts.astype(np.float64) ** 2).sum(1) * k / n - n
    d = k - 1
    z_chi = (np.cbrt(np.maximum(chi, 0.0) / d) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d))
    # Shares and moments are those of the alphabet, not of the run: a run all in one corner of it isn't random.
    groups = 2 * np.arange(k) // k if groups is None else groups
    shares = np.bincount(groups) / k
    change, twice = 1 - (shares**2).sum(), (shares**2).sum() ** 2
    # Neighbouring changes share a character; their covariance is that of two equalities.
    joint = (shares**3).sum() - twice
    var = (n - 1) * change * (1 - change) + 2 * max(0, n - 2) * joint
    own = groups[codes]
    z_runs = ((own[:, 1:] != own[:, :-1]).sum(1) - (n - 1) * change) / math.sqrt(max(var, 1e-9))
    centred = codes - (k - 1) / 2
    z_serial = (centred[:, 1:] * centred[:, :-1]).sum(1) / ((k * k - 1) / 12) / math.sqrt(n - 1)
    upper = lambda z: np.array([_upper(x) for x in z.tolist()])
    return np.stack([upper(z_chi), np.minimum(1.0, 2 * upper(abs(z_runs))), np.minimum(1.0, 2 * upper(abs(z_serial)))], 1)


def battery(codes: list[int], k: int, groups: np.ndarray | None = None) -> tuple[float, float, float]:
    """The p-values of one run."""
    return tuple(batteries(np.array([codes]), k, groups)[0].tolist())


def fisher_sum(ps: np.ndarray) -> np.ndarray:
    """Minus the sum of the logs of each line."""
    return -np.log(np.maximum(ps, 1e-300)).sum(-1)


def fisher(ps: tuple[float, ...]) -> float:
    """Survival of Fisher's sum, chi-squared with 2 degrees of freedom for each p-value."""
    x = float(fisher_sum(np.array(ps)))
    term = total = 1.0
    for i in range(1, len(ps)):
        term *= x / i
        total += term
    return min(1.0, math.exp(-x) * total)


@functools.cache
def groups_of(name: str) -> np.ndarray:
    """Character class of each code of an alphabet."""
    return np.array([_CLASS[c] for c in sorted(dict(ALPHABETS)[name])])


@functools.cache
def written_law(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For written runs of an alphabet: logs of some lengths, and there median and lower spread of the cube root of Fisher's sum."""
    of = groups_of(name)
    classes = np.unique(of)
    members = [np.flatnonzero(of == c) for c in classes]
    go = np.array(_GOES_ON)[np.ix_(classes, classes)]
    upto = (go / go.sum(1, keepdims=True)).cumsum(1)
    rng = np.random.default_rng(11)
    medians, spreads = [], []
    for n in LAW_LENGTHS:
        cls = np.empty((LAW_RUNS, n), np.int64)
        cls[:, 0] = rng.integers(0, len(classes), LAW_RUNS)
        for i in range(1, n):
            cls[:, i] = (rng.random(LAW_RUNS)[:, None] > upto[cls[:, i - 1], :-1]).sum(1)
        cls = cls[(cls != cls[:, :1]).any(1)]  # of one class alone nothing is inferred
        codes = np.zeros_like(cls)
        for c, own in enumerate(members):
            # Each run has its own order of frequent and rare letters. Digits and signs are all equal.
            weights = 1 / (np.arange(len(own)) + 3.0) if len(own) > 10 else np.ones(len(own))
            rank = np.searchsorted((weights / weights.sum()).cumsum()[:-1], rng.random(cls.shape))
            letters = own[np.argsort(rng.random((len(cls), len(own))), 1)]
            codes = np.where(cls == c, np.take_along_axis(letters, rank, 1), codes)
        x = np.cbrt(fisher_sum(batteries(codes, len(of), of)))
        median = np.median(x)
        medians.append(median)
        spreads.append(math.sqrt(((x[x < median] - median) ** 2).mean()))
    return np.log(LAW_LENGTHS), np.array(medians), np.array(spreads)


def written_p(ps: tuple[float, ...], n: int, name: str) -> float:
    """Chance that a written run of `n` characters is as random as these p-values say, or more."""
    lengths, medians, spreads = written_law(name)
    x = math.log(n)
    median, spread = float(np.interp(x, lengths, medians)), float(np.interp(x, lengths, spreads))
    return _upper((median - math.cbrt(float(fisher_sum(np.array(ps))))) / spread)


def runs(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Spans of the runs to be tested, outside `taken` (sorted by starts); those of one run may overlap."""
    k = ahead = 0
    for m in RUN.finditer(text):
        s, end = m.span()
        free = []
        while k < len(taken) and taken[k][0] < end:
            if taken[k][0] > max(s, ahead):
                free.append((max(s, ahead), taken[k][0]))
            ahead = max(ahead, taken[k][1])
            k += 1
        free.append((max(s, ahead), end))
        for a, b in free:
            if b - a < LEAST:
                continue
            part = text[a:b]
            if not (_SIGNS.search(part) and _URL_SIGNS.search(part)):
                yield a, b
                continue
            for one in (_WITHOUT_SIGNS, _WITHOUT_URL_SIGNS):
                for x in one.finditer(text, a, b):
                    yield x.span()


def random_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of random runs outside `taken` under false-discovery control."""
    tested = []
    for s, e in sorted(set(runs(text, taken))):
        run = text[s:e]
        found = infer_encoding(run)
        if not found:
            continue
        name, index = found
        ps = battery([index[c] for c in run], len(index), groups_of(name))
        tested.append((written_p(ps, e - s, name) if fisher(ps) >= RANDOM_P else 1.0, s, e))
    tested.sort()
    keep = max((i for i, (p, _, _) in enumerate(tested, 1) if p <= FDR * i / len(tested)), default=0)
    spans: list[tuple[int, int]] = []
    for s, e in sorted((s, e) for _, s, e in tested[:keep]):
        if spans and s < spans[-1][1]:
            spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
        else:
            spans.append((s, e))
    return spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of one text."""
    text = text or ""
    base = base_spans(text)
    more = random_spans(text, [(s, e) for s, _, e in base])
    return base, sorted(base + [(s, 3, e) for s, e in more]) if more else base


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


_FIELDS = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


@alone
def _scan_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        rows = []
        for x in batch:
            base, spans = scan(x.as_py())
            kinds = [k for _, k, _ in base]
            rows.append({"n_assign": kinds.count(0), "n_access": kinds.count(1), "n_hex": kinds.count(2), "base_sha256": hashlib.sha256(_joined(base).encode()).hexdigest(), "spans": _joined(spans)})
        yield pa.array(rows, _FIELDS)


@alone
def _redact_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        out = []
        for x in batch:
            text = x.as_py()
            spans = scan(text)[1]
            if spans:
                parts, at = [], 0
                for s, k, e in spans:
                    if e > at:
                        parts += [text[at : max(s, at)], f"[{KINDS[k]}]" if s >= at else ""]
                        at = e
                text = "".join(parts) + text[at:]
            out.append(text)
        yield pa.array(out, pa.string())


def scan_secrets(spark: SparkSession, docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts of base kinds, digest of base spans, all spans."""
    ship_package(spark)
    return docs.select(F.col(id_col), span_column(F.col(text)).alias("_r")).select(id_col, "_r.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with every span replaced by its kind in brackets; all rows and columns stay."""
    ship_package(spark)
    small_batches(spark)
    return docs.withColumn(text, F.arrow_udf(_redact_batches, "string")(F.col(text)))


def span_column(c: Column) -> Column:
    """The scan of one text column, for use in other plans."""
    return F.arrow_udf(_scan_batches, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")(c)

