"""Byte-level BPE encoding and decoding.

Texts are cut to pieces by the vocabulary's pattern. The ranked merges are folded over the byte array of every distinct piece: each step
takes the least rank among neighbouring pairs, from a rank map, and joins that pair. The ids of a document are those of its pieces in
order; decoding looks up the bytes of every id and concatenates them. Nothing is shuffled.

Two forms give the same rows. `encode` folds in Arrow functions and remembers folded pieces, up to a bound. In `encode_with_expressions`
the pieces of a block of documents (one row, of bounded size) are numbered and Spark higher-order functions fold them with a rank map
that is a literal of the plan: a hash table in one array, `pair << 17 | merged id` at one of two places of the pair (cuckoo hashing).
That form takes about ten times the CPU time (README), so the queries use the first.

Defined results: a null text is empty and has no id; repeated rows are rows of their own; only the id and text columns are read; texts
are read whole; a piece of more than LONG_PIECE bytes is merged with a heap, by the same ranks, because the fold is quadratic in a
piece's length.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.held import give_back, held, small_batches
from granary.session import ship_package

BLOCK_CHARS, LONG_PIECE = 6 << 20, 128
#: Folded pieces that a task remembers.
HELD_PIECES = 300_000
_NONE = 1 << 30
_MULTIPLIERS = (40503, 60493)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """(left id << 16 | right id) to merged id, for all ways to split a token into two tokens."""
    out = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                out[left << 16 | right] = rank
    return out


def _places(key: int, bits: int) -> tuple[int, int]:
    left, right = key >> 16, key & 0xFFFF
    mask = (1 << bits) - 1
    return tuple((left * m + right * (m ^ 0x55AA) + (left ^ right)) & mask for m in _MULTIPLIERS)


def cuckoo_table(pairs: dict[int, int]) -> list[int]:
    """A table in which every pair stands at one of its two places."""
    bits = max(4, (2 * len(pairs)).bit_length())
    while True:
        table, ok = [-1] * (1 << bits), True
        for key, value in pairs.items():
            entry, at = key << 17 | value, None
            for _ in range(500):
                a, b = _places(entry >> 17, bits)
                if table[a] < 0 or table[b] < 0:
                    table[a if table[a] < 0 else b] = entry
                    break
                at = b if at == a else a
                table[at], entry = entry, table[at]
            else:
                ok = False
                break
        if ok:
            return table
        bits += 1


class Vocabulary:
    """Ranks, pattern, and what the plan needs of them."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern
        ranks = load_ranks(path)
        self.first = [ranks[bytes([b])] for b in range(256)]
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self._ranks = ranks
        self.hex_text = ",".join(t.hex() for t in self.tokens)


    def table(self) -> tuple[str, int]:
        """The rank map as text, and its number of bits."""
        table = cuckoo_table(pair_ranks(self._ranks))
        return ",".join(map(str, table)), len(table).bit_length() - 1


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rank(table: Column, bits: int, left: Column, right: Column) -> Column:
    """Merged id of a pair, or _NONE."""
    mask = (1 << bits) - 1

    def place(m: int) -> Column:
        return F.get(table, (a * m + b * (m ^ 0x55AA) + a.bitwiseXOR(b)).bitwiseAND(F.lit(mask).cast("bigint")).cast("int"))

    a, b = left.cast("bigint"), right.cast("bigint")
    key = F.shiftleft(a, 16) + b
    low = lambda e: e.bitwiseAND(F.lit((1 << 17) - 1)).cast("int")
    return _let(place(_MULTIPLIERS[0]), lambda e: F.when(F.shiftright(e, 17) == key, low(e)).otherwise(_let(place(_MULTIPLIERS[1]), lambda g: F.when(F.shiftright(g, 17) == key, low(g)).otherwise(F.lit(_NONE)))))


def fold_merges(ids: Column, table: Column, bits: int) -> Column:
    """The ids of one piece after all merges; `ids` are those of its bytes."""
    rank = lambda a, b: _rank(table, bits, a, b)
    start = F.struct(ids.alias("ids"), F.zip_with(F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))), F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))), rank).alias("ranks"))

    def join(acc: Column, best: Column, i: Column) -> Column:
        old, ranks = acc["ids"], acc["ranks"]
        n = F.size(ranks)
        left = F.when(i > 1, F.concat(F.slice(ranks, 1, i - 2), F.array(rank(F.get(old, i - 2), best)))).otherwise(F.array().cast("array<int>"))
        right = F.when(i < n, F.concat(F.array(rank(best, F.get(old, i + 1))), F.slice(ranks, i + 2, n))).otherwise(F.array().cast("array<int>"))
        return F.struct(F.concat(F.slice(old, 1, i - 1), F.array(best), F.slice(old, i + 2, n)).alias("ids"), F.concat(left, right).alias("ranks"))

    def step(acc: Column, _: Column) -> Column:
        return _let(
            F.array_min(acc["ranks"]),
            lambda best: F.when(best < _NONE, _let(F.array_position(acc["ranks"], best).cast("int"), lambda i: join(acc, best, i))).otherwise(acc),
        )

    folded = F.aggregate(F.sequence(F.lit(2), F.size(ids)), start, step)["ids"]
    return F.when(F.size(ids) > 1, folded).otherwise(ids)


def merge_long(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """The same merges with a heap over linked places."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(m, i) for i in range(n - 1) if (m := pairs.get(ids[i] << 16 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        m, i = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j >= n or pairs.get(ids[i] << 16 | ids[j]) != m:
            continue
        ids[i], ids[j] = m, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (m := pairs.get(ids[k] << 16 | ids[after[k]])) is not None:
                heapq.heappush(heap, (m, k))
    return [x for x in ids if x >= 0]


_pairs: dict[str, dict[int, int]] = {}


def _cut_blocks(path: str, pattern: str, first: list[int], id_type: pa.DataType):
    """Blocks of documents: their ids, the distinct pieces as byte ids, and each document's pieces by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        to_id = np.array(first, dtype=np.int32)

        def block(keys: list, numbers: list[np.ndarray], known: dict[str, int]) -> pa.RecordBatch:
            data = [w.encode("utf-8", "surrogatepass") for w in known]
            lengths = np.array([len(w) for w in data], dtype=np.int64)
            if len(data) and lengths.max() > LONG_PIECE:
                if path not in _pairs:
                    _pairs[path] = pair_ranks(load_ranks(path))
                words = pa.array([merge_long(to_id[np.frombuffer(w, np.uint8)].tolist(), _pairs[path]) if len(w) > LONG_PIECE else to_id[np.frombuffer(w, np.uint8)] for w in data], pa.list_(pa.int32()))
            else:
                words = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], lengths.cumsum())), pa.int32()), pa.array(to_id[np.frombuffer(b"".join(data), np.uint8)], pa.int32()))
            of = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in numbers]))), pa.int32()), pa.array(np.concatenate(numbers) if numbers else np.zeros(0, np.int32), pa.int32()))
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays([one(pa.array(keys, id_type)), one(of), one(words)], ["keys", "pieces", "words"])

        keys: list = []
        numbers: list[np.ndarray] = []
        known: dict[str, int] = {}
        size = 0
        for batch in batches:
            for key, x in zip(batch.column(0), batch.column(1)):
                text = x.as_py() or ""
                keys.append(key.as_py())
                numbers.append(np.array([known.setdefault(w, len(known)) for w in find(text)], dtype=np.int32))
                size += len(text)
                if size >= BLOCK_CHARS:
                    yield block(keys, numbers, known)
                    keys, numbers, known, size = [], [], {}, 0
        if keys:
            yield block(keys, numbers, known)

    return run


def merge(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """The fold of one piece: the pair of least rank is joined, the leftmost of equal ones, until none has a rank."""
    if len(ids) > LONG_PIECE:
        return merge_long(ids, pairs)
    get = pairs.get
    found = [get(a << 16 | b, _NONE) for a, b in zip(ids, ids[1:])]
    while found:
        best = min(found)
        if best == _NONE:
            break
        i = found.index(best)
        ids[i] = best
        del ids[i + 1], found[i]
        if i < len(found):
            found[i] = get(best << 16 | ids[i + 1], _NONE)
        if i:
            found[i - 1] = get(ids[i - 1] << 16 | best, _NONE)
    return ids


class Encoder:
    """Ranks of one file, and the pieces folded so far."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        ranks = load_ranks(path)
        self.pairs = pair_ranks(ranks)
        self.first = [ranks[bytes([b])] for b in range(256)]
        # The token and the decimal form of every id.
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.decimals = [str(i) for i in range(len(self.tokens))]
        self._known: dict[str, tuple[int, ...]] = {}

    def piece(self, word: str) -> tuple[int, ...]:
        """The ids of a piece; they are objects of the rank map, so a held piece is little more than its text."""
        if len(self._known) >= HELD_PIECES:
            self._known.clear()
        out = tuple(merge([self.first[b] for b in word.encode("utf-8", "surrogatepass")], self.pairs))
        if len(word) <= LONG_PIECE:
            self._known[word] = out
        return out

    def ids(self, text: str | None) -> list[int]:
        known, piece, out = self._known, self.piece, []
        for w in self.find(text or ""):
            out += known[w] if w in known else piece(w)
        return out


def _encode_column(path: str, pattern: str, with_ids: bool):
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * with_ids

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = held(("bpe", path, pattern), lambda: Encoder(path, pattern))
        decimals, tokens = encoder.decimals, encoder.tokens
        for batch in batches:
            upto, said, decoded, flat = [0], [], [], array("i")
            for x in batch:
                ids = encoder.ids(x.as_py())
                said.append(hashlib.sha256(",".join([decimals[i] for i in ids]).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([tokens[i] for i in ids])).hexdigest())
                upto.append(upto[-1] + len(ids))
                if with_ids:
                    flat.extend(ids)
            columns = [pa.array(np.diff(upto), pa.int64()), pa.array(said, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(np.array(flat, np.int32), pa.int32())))
            yield pa.StructArray.from_arrays(columns, names)
        give_back()

    return F.arrow_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids)


def encode(spark: SparkSession, docs: DataFrame, vocabulary: Vocabulary, text: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the decoded bytes), and with
    `with_ids` the ids themselves. The fold runs in Arrow functions."""
    ship_package(spark)
    small_batches(spark)
    done = _encode_column(vocabulary.path, vocabulary.pattern, with_ids)(F.col(text))
    return docs.select(F.col(id_col), done.alias("_r")).select(id_col, "_r.*")


def encode_with_expressions(spark: SparkSession, docs: DataFrame, vocabulary: Vocabulary, text: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """The same rows; the fold and the decoding are Spark higher-order functions."""
    from pyspark.sql.pandas.types import to_arrow_type

    ship_package(spark)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("keys", T.ArrayType(id_type)), T.StructField("pieces", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("words", T.ArrayType(T.ArrayType(T.IntegerType())))])
    cut = _cut_blocks(vocabulary.path, vocabulary.pattern, vocabulary.first, to_arrow_type(id_type))
    blocks = docs.select(id_col, text).mapInArrow(cut, schema)
    table_text, bits = vocabulary.table()
    table = F.split(F.lit(table_text), ",").cast("array<bigint>")
    hexes = F.split(F.lit(vocabulary.hex_text), ",")

    def said(e: Column, hexes: Column) -> Column:
        return F.struct(F.size(e).alias("n"), F.array_join(e.cast("array<string>"), ",").alias("ids"), F.array_join(F.transform(e, lambda i: F.get(hexes, i)), "").alias("hex"))

    def document(z: Column, known: Column) -> Column:
        own = z["pieces"]
        ids = F.array_join(F.transform(own, lambda k: F.get(known, k)["ids"]), ",")
        return F.struct(
            z["keys"].alias("key"),
            F.aggregate(own, F.lit(0).cast("bigint"), lambda a, k: a + F.get(known, k)["n"]).alias("n_tokens"),
            ids.alias("ids"),
            F.sha2(F.unhex(F.array_join(F.transform(own, lambda k: F.get(known, k)["hex"]), "")), 256).alias("decoded_sha256"),
        )

    encoded = F.transform(F.array(table), lambda t: F.transform("words", lambda w: fold_merges(w, t, bits)))[0]
    per_word = F.transform(F.array(hexes), lambda h: F.transform(encoded, lambda e: said(e, h)))[0]
    rows = blocks.select(F.inline(_let(per_word, lambda known: F.transform(F.arrays_zip("keys", "pieces"), lambda z: document(z, known)))))
    out = rows.select(F.col("key").alias(id_col), "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), "decoded_sha256", *([F.when(F.col("ids") == "", F.array().cast("array<int>")).otherwise(F.split("ids", ",").cast("array<int>")).alias("token_ids")] if with_ids else []))
    return out
