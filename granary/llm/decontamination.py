"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased words without ASCII punctuation; letters of scripts that are written without blanks are tokens of their own.
Rolling Karp-Rabin hashes of SEED tokens join documents and benchmark items on shared seeds; only items whose shared seeds could cover
enough of them are tiled. Tiling marks the longest match of unmarked tokens, again and again (ties: the first place in the item, then in
the document), until none has SEED tokens. Its length is searched by halving, with Karp-Rabin hashes of that length over the unmarked
stretches of both sides, so no list of pairs of places is ever made; hashes are checked by the tokens, so a collision gives no match. As
tiles may lie in any order, a passage with its parts moved about is found too. An item is in a document if its tiles cover COVERAGE of
it. An item of fewer than SEED tokens can't be told from chance inside a text; it is in a document whose tokens are exactly its own.

The items go to every task in blocks of at most BLOCK_TOKENS tokens or, if that is larger, one item: flat arrays of 16 bytes a token
and the distinct words, about 150 MB at worst. Each block is one pass over the documents; a benchmark of usual size is one block.

Defined results: null and empty texts match nothing, and null, empty and wordless items neither; repeated rows are rows of their own, as
are repeated items; an empty table gives no row; only the named columns are read, so others may have any name; texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.held import alone, small_batches
from granary.session import fresh, ship_package

SEED, COVERAGE, BLOCK_TOKENS = 5, 0.5, 1 << 20

_PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Thai, Lao, Myanmar, Khmer, kana, Han.
_NO_BLANKS = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


def tokens(text: str | None) -> list[bytes]:
    low = (text or "").lower()
    if not low.isascii():
        low = _NO_BLANKS.sub(r" \1 ", low)
    return low.encode("utf-8", "surrogatepass").translate(_PUNCTUATION).split()


def rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows."""
    n = len(ids) - length + 1
    h = np.zeros(max(0, n), np.uint64)
    for i in range(length if n > 0 else 0):
        h = h * _BASE + ids[i : i + n].astype(np.uint64)
    return h


class Index:
    """Seeds of benchmark items, in flat arrays."""

    def __init__(self, items: list[tuple[int, str]], seed: int = SEED):
        self.seed = seed
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        self.short: dict[tuple[bytes, ...], list[int]] = {}
        hashes, owners, places = [], [], []
        for item_id, text in items:
            words = tokens(text)
            if len(words) < seed:
                if words:
                    self.short.setdefault(tuple(words), []).append(item_id)
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.int32)
            hashes.append(rolling(ids, seed))
            owners.append(np.full(len(hashes[-1]), len(self.items), np.int32))
            places.append(np.arange(len(hashes[-1]), dtype=np.int32))
            self.items.append((item_id, ids))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        h = join(hashes, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.owners, self.places = h[order], join(owners, np.int32)[order], join(places, np.int32)[order]

    def _seeds(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the document with a seed of some item, and the first entry of that seed in the index."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = len(ids) - self.seed + 1
        if n <= 0 or not len(self.hashes):
            return none
        known = (ids > 0).cumsum()
        at = np.flatnonzero(known[self.seed - 1 :] - np.concatenate(([0], known[: n - 1])) == self.seed)
        if not len(at):
            return none
        h = np.zeros(len(at), np.uint64)
        for i in range(self.seed):
            h = h * _BASE + ids[at + i].astype(np.uint64)
        first = np.searchsorted(self.hashes, h)
        hit = first < len(self.hashes)
        hit[hit] = self.hashes[first[hit]] == h[hit]
        return at[hit], first[hit]

    def matches(self, text: str | None, coverage: float = COVERAGE) -> list[dict]:
        """Items whose tiles cover enough of them."""
        words = tokens(text)
        out = []
        if len(words) < self.seed:
            for item_id in self.short.get(tuple(words), []):
                out.append({"item_id": item_id, "item_tokens": len(words), "matched_tokens": len(words), "n_tiles": 1, "coverage": 1.0})
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words], dtype=np.int32)
        at, first = self._seeds(ids)
        if not len(at):
            return out
        # Each different seed of the document once, with all its places in items.
        entry = np.unique(first)
        last = np.searchsorted(self.hashes, self.hashes[entry], side="right")
        sizes = last - entry
        every = np.repeat(entry - np.concatenate(([0], sizes.cumsum()[:-1])), sizes) + np.arange(sizes.sum())
        order = np.lexsort((self.places[every], self.owners[every]))
        owner, place = self.owners[every][order], self.places[every][order]
        for item in np.unique(owner).tolist():
            item_id, own = self.items[item]
            need = coverage * len(own)
            lo, hi = np.searchsorted(owner, (item, item + 1))
            reach = np.zeros(len(own) + 1, np.int64)
            starts = place[lo:hi]
            np.add.at(reach, starts, 1)
            np.add.at(reach, starts + self.seed, -1)
            covered = reach.cumsum()[:-1] > 0
            if covered.sum() < need:  # tiles can't cover more than all seeds do
                continue
            mine = np.isin(self.hashes[first], rolling(own, self.seed))
            reach = np.zeros(len(ids) + 1, np.int64)
            np.add.at(reach, at[mine], 1)
            np.add.at(reach, at[mine] + self.seed, -1)
            near = reach.cumsum()[:-1] > 0
            tiles = tile(own, ids, self.seed, covered, near)
            matched = sum(t[2] for t in tiles)
            if matched >= need:
                out.append({"item_id": item_id, "item_tokens": len(own), "matched_tokens": matched, "n_tiles": len(tiles), "coverage": matched / len(own)})
        return out


class _Side:
    """One side of a tiling: which tokens are unmarked, and Karp-Rabin hashes of windows of any length by one running sum."""

    def __init__(self, ids: np.ndarray, free: np.ndarray):
        # Only stretches that may match are kept; a blocked token stands between them.
        keep = free | np.concatenate(([False], free[:-1]))
        self.place = np.flatnonzero(keep)
        self.ids = ids[self.place]
        self.free = free[self.place].copy()
        n = len(self.ids)
        mixed = (self.ids.astype(np.uint64) + _BASE) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        self.up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BASE, np.uint64))))
        down = np.uint64(pow(int(_BASE), -1, 1 << 64))
        self.down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, down, np.uint64))))
        self.upto = np.concatenate(([np.uint64(0)], np.cumsum(mixed * self.up[:n], dtype=np.uint64)))

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the unmarked windows of a length, and their hashes."""
        n = len(self.ids) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        blocked = np.concatenate(([0], (~self.free).cumsum()))
        at = np.flatnonzero(blocked[length:] == blocked[:n])
        return at, (self.upto[at + length] - self.upto[at]) * self.down[at]


def tile(a: np.ndarray, b: np.ndarray, least: int, free_a: np.ndarray | None = None, free_b: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, length), longest first, ties by place in a, then in b.

    `free_a`, `free_b`: the tokens that may be in a match; by default all.
    """
    x = _Side(a, np.ones(len(a), bool) if free_a is None else free_a)
    y = _Side(b, np.ones(len(b), bool) if free_b is None else free_b)

    def shared(length: int) -> bool:
        return bool(np.isin(x.windows(length)[1], y.windows(length)[1]).any())

    tiles: list[tuple[int, int, int]] = []
    most = min(len(x.ids), len(y.ids))
    while most >= least and shared(least):
        low, high = least, most  # a match of some length has matches of all smaller ones inside it
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if shared(middle) else (low, middle - 1)
        at_x, h_x = x.windows(low)
        at_y, h_y = y.windows(low)
        in_both = np.isin(h_x, h_y)
        of_y: dict[int, list[int]] = {}
        useful = np.isin(h_y, h_x[in_both])
        for j, h in zip(at_y[useful][::-1].tolist(), h_y[useful][::-1].tolist()):
            of_y.setdefault(h, []).append(j)  # the first place is last
        for i, h in zip(at_x[in_both].tolist(), h_x[in_both].tolist()):
            if not x.free[i : i + low].all():
                continue
            left = of_y[h]
            while left:
                j = left.pop()
                if not y.free[j : j + low].all():
                    continue
                if not (x.ids[i : i + low] == y.ids[j : j + low]).all():  # a collision of hashes
                    continue
                x.free[i : i + low] = y.free[j : j + low] = False
                tiles.append((int(x.place[i]), int(y.place[j]), low))
                break
        most = low - 1
    return tiles


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", seed: int = SEED, block_tokens: int | None = None) -> Iterator[Index]:
    """Indexes over all items, each of a bounded size."""
    rows = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // (2 * (block_tokens or BLOCK_TOKENS)))  # a token has two bytes at least, with its blank
    for b in range(n):
        own = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        yield Index(sorted(((r["item"], r["text"]) for r in own.collect()), key=lambda x: (x[0] is None, x)), seed)


_FIELDS = pa.list_(pa.struct([("item_id", pa.int64()), ("item_tokens", pa.int64()), ("matched_tokens", pa.int64()), ("n_tiles", pa.int64()), ("coverage", pa.float64())]))
_DDL = "array<struct<item_id:bigint,item_tokens:bigint,matched_tokens:bigint,n_tiles:bigint,coverage:double>>"


def _match_column(spark: SparkSession, index: Index, coverage: float):
    sent = spark.sparkContext.broadcast(index)

    @alone
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([sent.value.matches(x.as_py(), coverage) for x in batch], _FIELDS)

    return F.arrow_udf(run, _DDL)


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each document and item that is in it."""
    ship_package(spark)
    out = None
    for index in blocks(benchmark):
        found = docs.select(F.col(id_col), _match_column(spark, index, coverage)(F.col(text)).alias("_m")).where(F.size("_m") > 0).select(id_col, F.inline("_m"))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.select(F.col(id_col), F.inline(F.array().cast(_DDL))).limit(0)


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text: str = "text") -> DataFrame:
    """`docs` without those that hold an item; all columns stay."""
    ship_package(spark)
    small_batches(spark)
    for index in blocks(benchmark):
        (m,) = fresh(docs, "_match")
        docs = docs.withColumn(m, _match_column(spark, index, coverage)(F.col(text))).where(F.size(m) == 0).drop(m)
    return docs
