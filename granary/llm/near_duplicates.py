"""N-gram Jaccard join with Bayesian candidate pruning.

A text is the set of its five-word shingles (words between white space; a text of fewer words is one shingle). Texts with equal sets
are one node, so copies are never paired with each other. The join finds all pairs of nodes with Jaccard similarity of at least
`threshold`, without giving out the pairs:

1. One pass over the texts gives every document its node and the node's MinHash signature, which is written once (BANDS bands of ROWS
   values; a pair at 0.8 misses all bands with a probability of 3e-6). All bands are those of nodes, so copies add nothing to them.
2. Bands that two nodes or more share are counted out first; a bitmap of them lets only nodes with a shared band go on. Every member of
   a band's bucket is linked to the least one, and connected components of these links are found by hooking and pointer jumping, in
   written tables. No bucket is gathered anywhere.
3. Components of up to TILE nodes are compared as one tile. A larger one is cut to tiles along its buckets, and two tiles meet only if
   they share a band; only nodes of such tiles are sent. Within tiles only pairs with a common band are compared: MinHash values STEP at
   a time; a pair goes when the posterior probability (uniform prior) that its similarity reaches the threshold falls below TOLERANCE.
   What is left is verified on the whole sets, by exact intersections.
4. A tile returns sums for each of its nodes (links, and documents behind them) and a spanning forest of the links found, a row for
   each node at most. Sums add up to the number of links; components of the forest are the classes.

Texts are shuffled only for nodes that share a band, and in `keep_one` for rows that are to go: bitmaps of bounded size let all others
pass, and what they let through by chance is sorted out exactly. Joins on a key that many rows may have (a label, a node, a band)
broadcast the rows of hot keys, of which there are at most HOT.

Result, one row per document: doc_id, class_key (which class it is in; the least node of the class, in hexadecimal), class_id (least
doc_id of its class, to be shown: several classes have the same one where ids are null or repeated), copy_id (least doc_id of its
node), n_links (other nodes linked to its node), n_linked_docs (other documents at the threshold or above, copies included).

Defined results: texts without words (null, empty, blank) are linked with nothing but their exact copies (null counts as empty);
repeated rows are copies; ids may be null or repeated; of equal ids the least MD5 of the text comes first; an empty table gives no row;
only the id and text columns are read, so others may have any name; texts are read whole.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.held import alone, give_back, release, small_batches
from granary.session import Scratch, fresh, ship_package

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
STEP, TOLERANCE = 16, 1e-7
TILE, UNIT_NODES = 512, 1500
#: Bytes of texts that a tile, and a unit of small clusters, is planned for.
TILE_BYTES = 16 << 20
#: Characters hashed at once, the longest word in the common way, and cells of one dense block of intersections.
BLOCK_CHARS, LONG_WORD, CELLS = 1 << 17, 4096, 4_000_000
#: Most hot keys of a join, and most bits of a bitmap (128 MB).
HOT, MOST_BITS = 1000, 1 << 30

_rng = np.random.default_rng(20240501)
_MULTIPLY = _rng.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


_SPACE = np.zeros(0x110000, bool)
_SPACE[[c for c in range(0x3001) if chr(c).isspace()]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GAP = re.compile(r"\s")


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(BLOCK_CHARS, x, np.uint64)))) for x in (_BASE, _INVERSE))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _block_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a block: differences of one running sum over all characters."""
    import xxhash

    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = ~_SPACE[points]
    edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers()
    upto = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_mixed(points.astype(np.uint64) + _BASE) * up[: len(points)], out=upto[1:])
    out = _mixed((upto[ends] - upto[starts]) * down[starts])
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(text[starts[i] : ends[i]].encode("utf-8", "surrogatepass"))
    return out


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text, in order; a long text goes block by block, cut at white space."""
    import xxhash

    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + BLOCK_CHARS)
        if end < len(text) and not text[end].isspace() and not text[end - 1].isspace():
            cut = end - len(text[at:end].rsplit(None, 1)[-1])
            if cut == at:  # one word, longer than a block
                gap = _GAP.search(text, end)
                end = gap.start() if gap else len(text)
                out.append(np.array([xxhash.xxh3_64_intdigest(text[at:end].encode("utf-8", "surrogatepass"))], np.uint64))
                at = end
                continue
            end = cut
        out.append(_block_hashes(text[at:end]))
        at = end
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles_of(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    h = word_hashes(text or "")
    if not len(h):
        return h
    n, width = max(1, len(h) - words + 1), min(len(h), words)
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = (out ^ h[i : i + n]) * _BASE
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a set that isn't empty."""
    x = (shingles ^ (shingles >> np.uint64(29))).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(low, (x[i : i + 1024, None] * _MULTIPLY + _ADD).min(0), out=low)
    return low


def node_of(shingles: np.ndarray, text: str | None) -> bytes:
    data = shingles.tobytes() if len(shingles) else b"\0text:" + (text or "").encode("utf-8", "surrogatepass")
    return hashlib.blake2b(data, digest_size=16).digest()


@alone
def _node_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("node", pa.binary()), ("sig", pa.binary())])
    for batch in batches:
        rows = []
        for x in batch:
            text = x.as_py()
            s = shingles_of(text)
            rows.append({"node": node_of(s, text), "sig": signature(s).tobytes() if len(s) else None})
        yield pa.array(rows, kind)


def band_hashes(sig: Column) -> Column:
    """The band hashes of a written signature."""
    width = 4 * ROWS
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(sig, i * width + 1, F.lit(width))))


class Members:
    """A bitmap of 64-bit hashes: says no only for hashes that are not in it. Its size is bounded, whatever their number."""

    def __init__(self, spark: SparkSession, hashes: DataFrame, count: int):
        """`hashes`: a table of one column `h`."""
        self.bits = min(MOST_BITS, max(1 << 16, 1 << (16 * max(1, count)).bit_length()))
        at = F.pmod("h", F.lit(self.bits))
        words = hashes.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(pmod(h, {self.bits}L), 64) as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        map_ = np.zeros(self.bits >> 6, np.int64)
        map_[words["word"].to_numpy()] = words["bits"].to_numpy()
        self.sent = spark.sparkContext.broadcast(map_)

    def _filter(self):
        bits, sent = self.bits, self.sent

        def may(h: np.ndarray) -> np.ndarray:
            at = h & (bits - 1)
            return (sent.value[at >> 6] >> (at & 63)) & 1 == 1

        return may

    def may_hold(self, h: Column) -> Column:
        may = self._filter()

        @alone
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.array(may(batch.to_numpy(zero_copy_only=False).astype(np.int64)))

        return F.arrow_udf(run, "boolean")(h)

    def those_of(self, hashes: Column) -> Column:
        """Of an array of hashes, those that may be in it."""
        may = self._filter()

        @alone
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                values, offsets = batch.flatten(), np.concatenate(([0], np.cumsum(np.diff(batch.offsets.to_numpy()))))
                keep = may(values.to_numpy(zero_copy_only=False).astype(np.int64))
                upto = np.concatenate(([0], keep.cumsum()))
                yield pa.ListArray.from_arrays(pa.array(upto[offsets], pa.int32()), values.filter(pa.array(keep)))

        return F.arrow_udf(run, "array<bigint>")(hashes)


def spread_join(left: DataFrame, right: DataFrame, key: str, own: Column, value: list[str], n_rows: int, how: str = "left") -> DataFrame:
    """`left` with the columns `value` of `right`, which has one row for each `key`; hot keys of `left` don't meet in one task.

    A key with more than 1 / HOT of the rows of `left` is hot, so there are at most HOT of them: their rows of `right` are broadcast.
    Other rows are joined by the key. Rows that are done take part under `own`, which is theirs alone and of the key's type, so that they
    are spread; whatever they meet there is not used.
    """
    hot_keys = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(8, n_rows // HOT)).select(key)
    hot = right.join(F.broadcast(hot_keys), key).select(F.col(key).alias("_hot"), F.struct(*value).alias("_near"))
    marked = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_by", F.when(F.col("_hot").isNotNull(), own).otherwise(F.col(key)))
    far = right.select(F.col(key).alias("_far_key"), F.struct(*value).alias("_far"))
    joined = marked.join(far, F.col("_by") == F.col("_far_key"), "left").withColumn("_found", F.when(F.col("_hot").isNotNull(), F.col("_near")).otherwise(F.col("_far")))
    if how == "inner":
        joined = joined.where(F.col("_found").isNotNull())
    return joined.select(*left.columns, *[F.col("_found")[v].alias(v) for v in value])


def least_matches(threshold: float) -> list[int]:
    """For STEP, 2 STEP, ... compared values: matches below which the posterior of reaching the threshold is under TOLERANCE."""
    grid = (np.arange(4000) + 0.5) / 4000
    above = grid >= threshold
    out = []
    for m in range(STEP, HASHES + 1, STEP):
        k = np.arange(m + 1)[:, None]
        log = k * np.log(grid) + (m - k) * np.log1p(-grid)
        p = np.exp(log - log.max(1, keepdims=True))
        posterior = p[:, above].sum(1) / p.sum(1)
        out.append(int(np.argmax(posterior >= TOLERANCE)))
    return out


def prune(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i in a, j in b) that survive all steps."""
    matches = np.zeros(len(i), np.int32)
    for step, need in enumerate(least):
        at = slice(step * STEP, (step + 1) * STEP)
        matches += (a[i, at] == b[j, at]).sum(1, dtype=np.int32)
        live = matches >= need
        if not live.all():
            i, j, matches = i[live], j[live], matches[live]
        if not len(i):
            break
    return i, j


def intersections(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the pairs."""
    if len(i) < 40:
        return np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i, j)], dtype=np.int64)
    of_a, of_b = np.unique(i), np.unique(j)
    flat = np.concatenate([a[x] for x in of_a] + [b[y] for y in of_b])
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    new = np.cumsum(count > 1) - 1  # shingles of one set only are in no intersection
    row = np.repeat(np.arange(len(of_a) + len(of_b)), [len(a[x]) for x in of_a] + [len(b[y]) for y in of_b])
    shared = count[number] > 1
    row, col = row[shared], new[number[shared]]
    width = int(new[-1]) + 1 if len(new) else 0
    total = np.zeros((len(of_a), len(of_b)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    block = max(256, CELLS // max(1, len(of_a) + len(of_b)))
    for start in range(0, width, block):
        lo, hi = np.searchsorted(col, (start, start + block))
        dense = np.zeros((len(of_a) + len(of_b), min(block, width - start)), np.float32)
        dense[row[lo:hi], col[lo:hi] - start] = 1
        total += dense[: len(of_a)] @ dense[len(of_a) :].T
    return total[np.searchsorted(of_a, i), np.searchsorted(of_b, j)].astype(np.int64)


class Forest:
    """Union-find over the rows of a tile."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def bands_of(sig: np.ndarray) -> np.ndarray:
    """One number for each band of each signature."""
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.zeros((len(sig), 1), np.uint64)
    values = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    for i in range(ROWS):
        h = (h ^ values[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def compare_tile(tiles: np.ndarray, docs: np.ndarray, sets: list[np.ndarray], sig: np.ndarray, same: bool, threshold: float, least: list[int]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Links and linked documents of each node, and its root; pairs within one tile, or between two (0 and 1 in `tiles`)."""
    n = len(sets)
    links, weights, forest = np.zeros(n, np.int64), np.zeros(n, np.int64), Forest(n)
    sizes = np.array([len(s) for s in sets])
    bands = bands_of(sig)
    left = np.arange(n) if same else np.flatnonzero(tiles == 0)
    right = np.arange(n) if same else np.flatnonzero(tiles == 1)
    for start in range(0, len(left), 64):
        own = left[start : start + 64]
        i, j = (x.ravel() for x in np.meshgrid(own, right, indexing="ij"))
        small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        may = (small >= threshold * large - 1e-9) & ((i < j) if same else True)
        i, j = i[may], j[may]
        common_band = np.zeros(len(i), bool)
        for k in range(BANDS):
            common_band |= bands[i, k] == bands[j, k]
        i, j = prune(sig, sig, i[common_band], j[common_band], least)
        if not len(i):
            continue
        common = intersections(sets, sets, i, j)
        linked = common >= threshold * (sizes[i] + sizes[j] - common) - 1e-9
        i, j = i[linked], j[linked]
        for x, y in ((i, j), (j, i)):
            np.add.at(links, x, 1)
            np.add.at(weights, x, docs[y])
        for x, y in zip(i.tolist(), j.tolist()):
            forest.join(x, y)
    return links, weights, [forest.find(x) for x in range(n)]


def _unit(threshold: float):
    least = least_matches(threshold)
    fields = pa.schema([("node", pa.binary()), ("links", pa.int64()), ("linked_docs", pa.int64()), ("root", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        release()
        out = compare(table)
        give_back()
        return out

    def compare(table: pa.Table) -> pa.Table:
        groups: dict[tuple, list[int]] = {}
        cols = {c: table.column(c).to_pylist() for c in ("first", "second", "node", "tile", "docs", "text", "sig")}
        for r in range(table.num_rows):
            groups.setdefault((cols["first"][r], cols["second"][r]), []).append(r)
        out: dict[str, list] = {f.name: [] for f in fields}
        for (first, second), rows in groups.items():
            rows.sort(key=lambda r: cols["node"][r])
            nodes = [cols["node"][r] for r in rows]
            sets = [shingles_of(cols["text"][r]) for r in rows]
            sig = np.frombuffer(b"".join([cols["sig"][r] for r in rows]), np.uint32).reshape(len(rows), HASHES)
            tiles = np.array([0 if cols["tile"][r] == first else 1 for r in rows])
            links, weights, roots = compare_tile(tiles, np.array([cols["docs"][r] for r in rows]), sets, sig, first == second, threshold, least)
            for k, node in enumerate(nodes):
                if links[k]:
                    out["node"].append(node)
                    out["links"].append(int(links[k]))
                    out["linked_docs"].append(int(weights[k]))
                    out["root"].append(nodes[roots[k]])
        return pa.table(out, schema=fields)

    return run


def components(spark: SparkSession, scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for all nodes of the edges; the label is the least node of the component.

    Each round a node takes the least label around it, then its label's label; rounds are logarithmic in the longest path.
    """
    both = scratch.write(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).where("x <> y").distinct(), "edges")
    n_edges = both.count()
    labels = scratch.write(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")), "labels")
    n_nodes = labels.count()
    while n_edges:
        around = spread_join(both, labels.select(F.col("node").alias("y"), F.col("label").alias("near")), "y", F.col("x"), ["near"], n_edges).groupBy("x").agg(F.min("near").alias("near"))
        hooked = labels.join(around, labels["node"] == around["x"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # The old root follows its tree to the new label.
        roots = hooked.groupBy(F.col("old").alias("node")).agg(F.min("label").alias("moved"))
        jumped = scratch.write(hooked.join(roots, "node", "left").select("node", "old", F.least("label", F.coalesce("moved", "label")).alias("label")), "jumped")
        up = jumped.select(F.col("node").alias("label"), F.col("label").alias("above"))
        after = scratch.write(spread_join(jumped, up, "label", F.col("node"), ["above"], n_nodes).select("node", "old", F.coalesce("above", "label").alias("label")), "labels")
        changed = after.where("label <> old").limit(1).count()
        scratch.drop(labels, jumped)
        labels = after
        if not changed:
            break
    scratch.drop(both)
    return labels.select("node", "label")


def place_in_tiles(scratch: Scratch, members: DataFrame, banded: DataFrame, n_members: int) -> tuple[DataFrame, DataFrame]:
    """`members` with their tile, and the pairs of tiles (first, second) to be compared; a tile is paired with itself too.

    Members of one bucket tend to get one tile: a large component's nodes are dealt by their least hub, and a tile that is still too
    large is dealt by node. Two tiles are paired if a band has nodes in both.
    """
    parts = lambda n, size: F.greatest(F.ceil(F.col(n) / TILE), F.ceil(F.col(size) / TILE_BYTES)).cast("long")
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.sum("n_bytes").alias("bytes")).select("label", parts("size", "bytes").alias("tiles"))
    sized = spread_join(members, sizes, "label", F.col("node"), ["tiles"], n_members)
    sized = sized.withColumn("area", F.when(F.col("tiles") > 1, F.xxhash64("label", F.pmod(F.xxhash64("home"), "tiles"))).otherwise(F.xxhash64("label")))
    areas = sized.where("tiles > 1").groupBy("area").agg(F.count(F.lit(1)).alias("size"), F.sum("n_bytes").alias("bytes")).select("area", parts("size", "bytes").alias("parts"))
    dealt = spread_join(sized, areas, "area", F.xxhash64("node", F.lit(3)), ["parts"], n_members)
    tile = F.when(F.col("parts") > 1, F.xxhash64("area", F.pmod(F.xxhash64("node", F.lit(2)), "parts"))).otherwise(F.col("area"))
    placed = scratch.write(dealt.withColumn("tile", tile).withColumn("large", F.col("tiles") > 1).drop("area", "tiles", "parts", "home"), "placed")
    in_large = banded.join(placed.where("large").select("node", "tile"), "node").select("band", "tile").distinct()
    other = in_large.select("band", F.col("tile").alias("second"))
    meet = in_large.join(other, "band").where("tile < second").select(F.col("tile").alias("first"), "second").distinct()
    own = placed.select(F.col("tile").alias("first"), F.col("tile").alias("second")).distinct()
    return placed, own.unionByName(meet)


def find(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", id_col: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, text_md5 (binary), class_key, class_id, copy_id, n_links, n_linked_docs."""
    ship_package(spark)
    small_batches(spark)
    scratch = scratch or Scratch(spark, "near-duplicates")
    whole = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).withColumn("text_md5", F.unhex(F.md5(whole.cast("binary"))))
    made = plain.select("doc_id", "text_md5", F.octet_length(whole).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("at"), F.arrow_udf(_node_batches, "node binary, sig binary")(F.col("text")).alias("r"))
    rows = scratch.write(made.select("doc_id", "text_md5", "n_bytes", "at", "r.node", "r.sig"), "documents")
    n_rows = rows.count()
    # Signatures are equal within a node, so any will do; a row is the node's own if it has the least (doc_id, text_md5).
    own = F.min(F.struct("doc_id", "text_md5", "n_bytes")).alias("own")
    grouped = rows.groupBy("node").agg(own, F.count(F.lit(1)).alias("docs"), F.max("sig").alias("sig"))
    nodes = scratch.write(grouped.select("node", F.col("own.doc_id").alias("copy_id"), F.col("own.text_md5").alias("own_md5"), F.col("own.n_bytes").alias("n_bytes"), "docs", "sig"), "nodes")
    of_nodes = nodes.where("sig is not null").select("node", band_hashes(F.col("sig")).alias("bands"))
    shared = scratch.write(of_nodes.select(F.explode("bands").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "shared")
    filter_ = Members(spark, shared, shared.count())
    banded = scratch.write(of_nodes.select("node", F.explode(filter_.those_of(F.col("bands"))).alias("band")), "banded")
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("far")).where("hub <> far").select("band", "hub")
    linked_bands = scratch.write(spread_join(banded, hubs, "band", F.xxhash64("node"), ["hub"], banded.count(), "inner"), "buckets")
    clusters = components(spark, scratch, linked_bands.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    homes = linked_bands.groupBy("node").agg(F.min("hub").alias("home"))
    members = scratch.write(clusters.join(homes, "node").join(nodes, "node"), "members")
    total = members.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes")).first()
    units = max(1, -(-total["n"] // UNIT_NODES), -(-total["bytes"] // TILE_BYTES))
    placed, pairs = place_in_tiles(scratch, members, linked_bands, total["n"])
    # Texts of the members only; equal keys are equal texts.
    wanted = Members(spark, members.select(F.xxhash64("copy_id", "own_md5").alias("h")), total["n"])
    some = plain.where(wanted.may_hold(F.xxhash64("doc_id", "text_md5"))).groupBy(F.col("doc_id").alias("copy_id"), F.col("text_md5").alias("own_md5")).agg(F.first("text").alias("text"))
    found = scratch.write(placed.join(some, [placed["copy_id"].eqNullSafe(some["copy_id"]), placed["own_md5"] == some["own_md5"]]).select("node", "docs", "sig", "tile", "large", "text"), "texts")
    ends = pairs.where("first <> second")
    meeting = ends.select(F.col("first").alias("tile"), "first", "second").unionByName(ends.select(F.col("second").alias("tile"), "first", "second"))
    sent = found.select("node", "docs", "sig", "text", "tile", F.col("tile").alias("first"), F.col("tile").alias("second"), F.when(F.col("large"), F.xxhash64("tile", F.lit(0))).otherwise(F.pmod(F.xxhash64("tile"), F.lit(units))).alias("unit"), "large")
    sent = sent.unionByName(found.where("large").join(meeting, "tile").select("node", "docs", "sig", "text", "tile", "first", "second", F.xxhash64("first", "second").alias("unit"), "large"))
    linked = scratch.write(sent.groupBy("unit", "large").applyInArrow(_unit(threshold), "node binary, links long, linked_docs long, root binary"), "links")
    sums = linked.groupBy("node").agg(F.sum("links").alias("n_links"), F.sum("linked_docs").alias("linked_docs"))
    classes = components(spark, scratch, linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of_class = classes.join(nodes, "node").groupBy("label").agg(F.min("copy_id").alias("class_id"))
    named = spread_join(classes, of_class, "label", F.col("node"), ["class_id"], total["n"])
    known = nodes.drop("sig").join(sums, "node", "left").join(named, "node", "left")
    known = known.select("node", "copy_id", F.coalesce("label", "node").alias("class_node"), F.when(F.col("label").isNull(), F.col("copy_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.coalesce("linked_docs", F.lit(0)) + F.col("docs") - 1).alias("n_linked_docs"))
    known = scratch.write(known, "known")
    own_row = F.col("at").cast("string").cast("binary")
    all_ = spread_join(rows.drop("sig", "n_bytes"), known, "node", own_row, ["copy_id", "class_node", "class_id", "n_links", "n_linked_docs"], n_rows)
    out = scratch.write(all_.select("doc_id", "text_md5", F.lower(F.hex("class_node")).alias("class_key"), "class_id", "copy_id", "n_links", "n_linked_docs"), "result")
    scratch.close(keep=out)
    return out


def keep_one(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """`docs` with one document of each class: the one of least (doc_id, MD5 of the text); all columns stay."""
    scratch = Scratch(spark, "one-of-each")
    found = find(spark, docs, threshold, text, id_col, scratch)
    keys = scratch.write(found.groupBy("doc_id", "text_md5", "class_key").agg(F.count(F.lit(1)).alias("n")), "keys")
    firsts = keys.groupBy("class_key").agg(F.min(F.struct("doc_id", "text_md5")).alias("own"))
    judged = spread_join(keys, firsts, "class_key", F.concat_ws("|", F.hex("text_md5"), F.col("doc_id").cast("string")), ["own"], keys.count())
    stays = F.col("doc_id").eqNullSafe(F.col("own.doc_id")) & (F.col("text_md5") == F.col("own.text_md5"))
    # Rows that go, and rows that are there more than once; all other rows pass without a shuffle.
    suspects = scratch.write(judged.select("doc_id", "text_md5", stays.alias("stays"), "n").where("not stays or n > 1"), "suspects")
    filter_ = Members(spark, suspects.select(F.xxhash64("doc_id", "text_md5").alias("h")), suspects.count())
    md5, key, left, may = fresh(docs, "_md5", "_key", "_id", "_may")
    marked = docs.withColumn(md5, F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    marked = marked.withColumn(may, filter_.may_hold(F.xxhash64(id_col, md5)))
    gone = suspects.where("not stays").select(F.col("doc_id").alias(left), F.col("text_md5").alias(key))
    rest = marked.where(F.col(may)).dropDuplicates([id_col, md5])
    rest = rest.join(gone, [rest[id_col].eqNullSafe(gone[left]), rest[md5] == gone[key]], "left_anti")
    return marked.where(~F.col(may)).select(*docs.columns).unionByName(rest.select(*docs.columns))
