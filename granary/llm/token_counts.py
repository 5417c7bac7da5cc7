"""Token counts by a tokenizer compiled to finite-state transducers.

The tokenizer file (byte-level BPE in the `tokenizers` JSON layout, with the usual pattern of contractions, letters, numbers, other
signs and blanks) is compiled to two deterministic transducers. That of the pattern runs over character classes; a transition carries
its next state and where it ends a piece: before the character, before the character read last, or both. That of the merges
(`Transducer`) runs over the bytes of a piece; a transition carries its next state and the number of tokens it emits, and a state the
number that the end of a piece emits. Counts are sums over transitions; no piece is looked up by a hash.

All texts of a batch are one string of classes, with a class of their own between texts that leads every state back to the start. It
is cut into chunks of equal length, whatever the texts' lengths. Each chunk is run from all states at once, which gives its state map;
a parallel prefix scan composes the maps, which gives every chunk's entry state; then all chunks run again from there and cut pieces.
The pieces run side by side through the second transducer, and running sums of what they emit give each text's count.

Special strings inside texts are found first, as the library does, and count as one token each.

Defined results: a null or empty text has no token; an empty table gives no row; over_limit is n_tokens > LIMIT; repeated rows are rows
of their own; only the id and text columns are read, so others may have any name; a text of more than SLICE_CHARS characters is run by
slices that hand on both states, so neither long texts nor long pieces need more memory than a slice.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import ship_package

LIMIT, CHUNK, HEAD = 512, 512, 24
#: Characters that are run at once; a longer text is run by slices.
SLICE_CHARS = 1 << 20
#: Compiled states that a process holds, and bytes from which a piece is run by itself.
MOST_STATES, SIDE_BY_SIDE = 400_000, 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ZERO = 512

# Character classes.
END, LETTER, NUMBER, SPACE, BLANK, QUOTE, SIGN, C_STMD, C_R, C_V, C_L, C_E = range(12)
# States: what the piece in progress looks like.
START, S_LETTER, S_NUMBER, S_SIGN, S_SPACE, S_BLANK, S_RUN_SPACE, S_RUN_BLANK, S_QUOTE, S_QUOTE_R, S_QUOTE_V, S_QUOTE_L, S_DONE = range(13)
_NONE = 1 << 60
HERE, LAST = 1, 2  # a piece ends before this character; before the character read last

_LETTERS = (LETTER, C_STMD, C_R, C_V, C_L, C_E)


def compile_pattern() -> tuple[np.ndarray, np.ndarray]:
    """next[state, class] and ends[state, class] of the pattern."""
    nxt = np.zeros((13, 12), np.uint8)
    ends = np.zeros((13, 12), np.uint8)
    fresh = {END: START, NUMBER: S_NUMBER, SPACE: S_SPACE, BLANK: S_BLANK, QUOTE: S_QUOTE, SIGN: S_SIGN} | dict.fromkeys(_LETTERS, S_LETTER)
    for state in range(13):
        for c in range(12):
            to, end = fresh[c], HERE
            if state == START:
                end = 0
            elif c == END:
                end = HERE | (LAST if state in (S_QUOTE_R, S_QUOTE_V, S_QUOTE_L) else 0)
            elif state == S_LETTER and c in _LETTERS or state == S_NUMBER and c == NUMBER:
                end = 0
            elif state == S_SIGN and c in (SIGN, QUOTE):
                to, end = S_SIGN, 0
            elif state in (S_SPACE, S_BLANK, S_RUN_SPACE, S_RUN_BLANK):
                if c in (SPACE, BLANK):
                    to, end = (S_RUN_SPACE if c == SPACE else S_RUN_BLANK), 0
                elif state == S_SPACE:  # the space belongs to what follows
                    to, end = (S_SIGN if c == QUOTE else to), 0
                elif state == S_RUN_SPACE:
                    to, end = (S_SIGN if c == QUOTE else to), LAST
                elif state == S_RUN_BLANK:
                    end = HERE | LAST
            elif state == S_QUOTE:
                if c == C_STMD:
                    to, end = S_DONE, 0
                elif c in (C_R, C_V, C_L):
                    to, end = {C_R: S_QUOTE_R, C_V: S_QUOTE_V, C_L: S_QUOTE_L}[c], 0
                elif c in (SIGN, QUOTE):
                    to, end = S_SIGN, 0
            elif state in (S_QUOTE_R, S_QUOTE_V, S_QUOTE_L):
                if c == (C_L if state == S_QUOTE_L else C_E):
                    to, end = S_DONE, 0
                elif c in _LETTERS:
                    to, end = S_LETTER, LAST
                else:
                    end = HERE | LAST
            nxt[state, c], ends[state, c] = to, end
    return nxt, ends


NEXT, ENDS = compile_pattern()
_NEXT_FLAT, _ENDS_FLAT = NEXT.reshape(-1), ENDS.reshape(-1)

_table: np.ndarray | None = None


def class_table() -> np.ndarray:
    """Class of every code point."""
    global _table
    if _table is None:
        t = np.full(0x110000, SIGN, np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            if kind == "L":
                t[c] = LETTER
            elif kind == "N":
                t[c] = NUMBER
        t[[*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
        t[0x20], t[0x27] = SPACE, QUOTE
        for chars, c in (("stmd", C_STMD), ("r", C_R), ("v", C_V), ("l", C_L), ("e", C_E)):
            t[[ord(x) for x in chars]] = c
        _table = t
    return _table


def run_states(classes: np.ndarray, entry: int = START) -> np.ndarray:
    """Entry state of every position, by chunk maps and a prefix scan of their composition."""
    n = len(classes)
    rows = -(-n // CHUNK)
    grid = np.zeros(rows * CHUNK, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    maps = np.repeat(np.arange(13, dtype=np.uint8)[:, None], rows, 1)
    for c in grid[:HEAD]:  # all chunks, from all states
        maps = _NEXT_FLAT[maps * np.uint8(12) + c]
    # Where all states have met, one lane says the rest.
    met = (maps == maps[0]).all(0)
    lane, wide = maps[0, met], maps[:, ~met]
    for c in grid[HEAD:]:
        lane = _NEXT_FLAT[lane * np.uint8(12) + c[met]]
        if wide.shape[1]:
            wide = _NEXT_FLAT[wide * np.uint8(12) + c[~met]]
    maps[:, met], maps[:, ~met] = lane, wide
    # Hillis-Steele scan: after it, maps[:, i] is the composition of the maps of chunks 0 to i.
    step = 1
    while step < rows:
        maps = np.concatenate((maps[:, :step], np.take_along_axis(maps[:, step:], maps[:, :-step], 0)), 1)
        step *= 2
    state = np.full(rows, entry, np.uint8)
    state[1:] = maps[entry, :-1]
    out = np.empty((CHUNK, rows), np.uint8)
    for i, c in enumerate(grid):
        out[i] = state
        state = _NEXT_FLAT[state * np.uint8(12) + c]
    return out.T.reshape(-1)[:n]


class Transducer:
    """The merges as a deterministic transducer over the bytes of a piece.

    A prefix of a piece has one last token: the one whose removal leaves a prefix with a last token that may stand before it (two
    tokens may stand together if the merges of their bytes give them back). So a prefix of i bytes has one token more than the prefix
    that its last token leaves. A next token can't begin before the longest suffix that begins some token; so a state is that suffix,
    with the last token at each place of it. A transition's tokens are the change of the count at the suffix's start (below zero where a
    longer token takes the place of two); a state's flush is the rest, when a piece ends there. States and transitions are compiled when
    first met, by the file alone.
    """

    START = 0

    def __init__(self, vocab: dict[str, int], merges: list):
        letters = byte_letters()
        to_byte = {c: b for b, c in letters.items()}
        first = [vocab[letters[b]] for b in range(256)]
        self._first = first
        #: (left id, right id) to (rank, merged id), in one number each.
        self._merges: dict[int, int] = {}
        self._of: dict[bytes, int] = {bytes([b]): first[b] for b in range(256)}
        self._bytes: dict[int, bytes] = {i: x for x, i in self._of.items()}
        for rank, m in enumerate(merges):
            left, right = m.split(" ") if isinstance(m, str) else m
            token = bytes(to_byte[c] for c in left + right)
            i = vocab[left + right]
            self._merges[vocab[left] << 20 | vocab[right]] = rank << 20 | i
            self._of[token], self._bytes[i] = i, token
        self._prefixes = {t[:k] for t in self._of for k in range(1, len(t) + 1)} | {b""}
        self._together: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        self._states: dict[tuple, int] = {}
        self._keys: list[tuple] = []
        self.flush: list[int] = []
        self._edges: dict[int, int] = {}  # state << 8 | byte to next state << 10 | tokens emitted + _ZERO
        self._size = 1 << 16
        self._table = np.full((2, self._size), -1, np.int64)
        #: The empty prefix: no suffix, no last token (-1), no tokens.
        self._state((b"", (-1,), (0,)))

    def _state(self, key: tuple) -> int:
        found = self._states.get(key)
        if found is None:
            found = self._states[key] = len(self._keys)
            self._keys.append(key)
            self.flush.append(key[2][-1])
        return found

    def merge(self, ids: list[int]) -> list[int]:
        """Tokens left when no pair can be merged; the pair of least rank goes first, the leftmost of equal ones."""
        get = self._merges.get
        while len(ids) > 1:
            best, i = min((get(a << 20 | b, _NONE), i) for i, (a, b) in enumerate(zip(ids, ids[1:])))
            if best == _NONE:
                break
            ids[i : i + 2] = [best & 0xFFFFF]
        return ids

    def _may_follow(self, left: int, right: int) -> bool:
        key = left << 20 | right
        found = self._together.get(key)
        if found is None:
            if len(self._together) >= MOST_STATES:
                self._together.clear()
            joined = self.merge([self._first[b] for b in self._bytes[left] + self._bytes[right]])
            found = self._together[key] = joined == [left, right]
        return found

    def _compile(self, state: int, byte: int) -> int:
        """The transition of a state by a byte; it is entered in both tables."""
        suffix, lasts, counts = self._keys[state]
        text = suffix + bytes([byte])
        for k in range(len(text)):
            token = self._of.get(text[k:])
            if token is not None and (lasts[k] < 0 or self._may_follow(lasts[k], token)):
                break
        lasts, counts = (*lasts, token), (*counts, counts[k] + 1)
        drop = 0
        while text[drop:] not in self._prefixes:
            drop += 1
        emitted = counts[drop]
        after = self._state((text[drop:], lasts[drop:], tuple(c - emitted for c in counts[drop:])))
        key, value = state << 8 | byte, after << 10 | emitted + _ZERO
        self._edges[key] = value
        if 2 * len(self._edges) > self._size:
            self._size *= 4
            self._table = np.full((2, self._size), -1, np.int64)
            for k, v in self._edges.items():
                self._enter(k, v)
        else:
            self._enter(key, value)
        return value

    def _enter(self, key: int, value: int) -> None:
        at = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 32 & (self._size - 1)
        keys = self._table[0]
        while keys[at] >= 0:
            at = (at + 1) & (self._size - 1)
        self._table[:, at] = key, value

    def _follow(self, keys: np.ndarray) -> np.ndarray:
        """Transitions of many (state << 8 | byte); -1 where there is none yet."""
        mask = self._size - 1
        at = ((keys.astype(np.uint64) * _BASE) >> np.uint64(32)).astype(np.int64) & mask
        seen = self._table[0, at]
        out = np.where(seen == keys, self._table[1, at], -1)
        left = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(left):
            at[left] = (at[left] + 1) & mask
            seen = self._table[0, at[left]]
            out[left[seen == keys[left]]] = self._table[1, at[left[seen == keys[left]]]]
            left = left[(seen != keys[left]) & (seen >= 0)]
        return out

    def reset_if_large(self) -> None:
        """Forget the compiled states if they are many. Not between the parts of one piece."""
        if len(self._keys) > MOST_STATES:
            self._clear()

    def run_one(self, data: bytes, state: int) -> tuple[int, int]:
        """(state, tokens emitted) after `data`, byte by byte."""
        get, total = self._edges.get, 0
        for b in data:
            found = get(state << 8 | b)
            if found is None:
                found = self._compile(state, b)
            state = found >> 10
            total += (found & 0x3FF) - _ZERO
        return state, total

    def run(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, first: int = START) -> tuple[np.ndarray, np.ndarray]:
        """(states, tokens emitted) after each piece of `data`, all pieces side by side. The first piece begins in the state `first`."""
        lengths = stops - starts
        state, total = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        if len(starts):
            state[0] = first
        order = np.argsort(-lengths, kind="stable")
        wide = np.searchsorted(-lengths[order], -SIDE_BY_SIDE, side="left")
        for i in order[:wide].tolist():
            state[i], total[i] = self.run_one(data[starts[i] : stops[i]].tobytes(), int(state[i]))
        order = order[wide:]
        at, left = starts[order], lengths[order]
        s, n, k = state[order], np.zeros(len(order), np.int64), 0
        live = int(np.searchsorted(-left, 0, side="left"))
        while live:
            keys = s[:live] << 8 | data[at[:live] + k]
            found = self._follow(keys)
            new = np.flatnonzero(found < 0)
            if len(new):
                for key in np.unique(keys[new]).tolist():
                    self._compile(key >> 8, key & 0xFF)
                found[new] = self._follow(keys[new])
            s[:live], k = found >> 10, k + 1
            n[:live] += (found & 0x3FF) - _ZERO
            live = int(np.searchsorted(-left, -k, side="left"))
        state[order], total[order] = s, n
        return state, total


class Counter:
    """Token counts by the compiled tokenizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.transducer = Transducer(data["model"]["vocab"], data["model"]["merges"])
        self.specials = sorted((x["content"] for x in data["added_tokens"]), key=len, reverse=True)

    def _segments(self, text: str) -> list[str]:
        own = [text]
        for special in self.specials:
            if special in text:
                own = [x for part in own for x in part.split(special)]
        return own

    def texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        out = [0] * len(texts)
        held: list[str] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if held:
                for i, n in zip(owner, self._together(held)):
                    out[i] += n
            held.clear()
            owner.clear()
            size = 0

        for i, text in enumerate(texts):
            own = self._segments(text)
            out[i] = len(own) - 1
            for segment in own:
                if len(segment) > SLICE_CHARS:
                    out[i] += self._long(segment)
                    continue
                held.append(segment)
                owner.append(i)
                size += len(segment) + 1
                if size >= SLICE_CHARS:
                    flush()
        flush()
        return out

    def _together(self, segments: list[str]) -> list[int]:
        """Tokens of each of some short segments, as one string with a class END after each."""
        self.transducer.reset_if_large()
        joined = "\0".join(segments) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = class_table()[points]
        ends = np.cumsum([len(s) + 1 for s in segments]) - 1
        classes[ends] = END
        cut = cuts(classes, run_states(classes))
        cut[ends], cut[ends + 1], cut[0] = True, True, True
        bounds = np.flatnonzero(cut)
        starts, stops = bounds[:-1], bounds[1:]
        real = classes[starts] != END
        starts, stops = starts[real], stops[real]
        at = byte_places(points)
        state, total = self.transducer.run(np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8), at[starts], at[stops])
        total += np.array(self.transducer.flush, np.int64)[state]
        # Tokens of a segment: the difference of the running sum at its bounds.
        upto = np.concatenate(([0], total.cumsum()))
        return np.diff(upto[np.searchsorted(starts, ends)], prepend=0).tolist()

    def _long(self, text: str) -> int:
        """Tokens of one long segment, by slices that hand on the pattern's state and, inside a piece, the transducer's.

        A slice's last character is read again by the next one, because the character after it may still end a piece before it.
        """
        t, total = self.transducer, 0
        entry, inside, at = START, None, 0
        while at < len(text):
            if inside is None or inside == t.START:
                t.reset_if_large()
            end = min(len(text), at + SLICE_CHARS)
            final = end == len(text)
            part = text[at:end]
            points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            classes = class_table()[points]
            if final:
                classes = np.append(classes, np.uint8(END))
            state = run_states(classes, entry)
            cut = cuts(classes, state)
            upto = len(part) if final else len(part) - 1
            fresh_start = inside is None or bool(cut[0])
            if inside is not None and fresh_start:
                total += t.flush[inside]
            cut[0] = True
            bounds = np.append(np.flatnonzero(cut[:upto]), upto)
            places = byte_places(points)
            data = np.frombuffer(part.encode("utf-8", "surrogatepass"), np.uint8)
            after, emitted = t.run(data, places[bounds[:-1]], places[bounds[1:]], t.START if fresh_start else inside)
            total += int(emitted.sum()) + sum(t.flush[x] for x in after[:-1].tolist())
            inside = int(after[-1])
            if final:
                return total + t.flush[inside]
            entry, at = int(state[upto]), at + upto
        return total


def byte_places(points: np.ndarray) -> np.ndarray:
    """UTF-8 place of every code point, and the end."""
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    return np.concatenate(([0], width.cumsum()))


def cuts(classes: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Where pieces begin, by the transitions' marks; one place more than characters."""
    emitted = _ENDS_FLAT[state * np.uint8(12) + classes]
    cut = np.zeros(len(classes) + 1, bool)
    cut[:-1] = emitted & HERE != 0
    last = np.flatnonzero(emitted & LAST) - 1
    cut[last[last >= 0]] = True
    return cut


def byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies: printable bytes stand for themselves, others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The compiled tokenizer of this process."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _count_column(path: str):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = counter(path)
        for batch in batches:
            yield pa.array(c.texts([x.as_py() or "" for x in batch]), pa.int64())

    return F.arrow_udf(run, "long")


def count_tokens(spark: SparkSession, docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: n_bytes, n_tokens, over_limit. `path`: a tokenizer file that every worker can open."""
    ship_package(spark)
    counted = docs.select(F.col(id_col), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), _count_column(path)(F.col(text)).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
