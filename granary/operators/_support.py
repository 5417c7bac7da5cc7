"""An index of claims for the tasks that read evidence: which claims has some evidence with similar words, inside it, or around it."""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

_WORD, _GAP = re.compile(r"\w+", re.A), re.compile(r"\W+", re.A)
#: Short texts of evidence that a task remembers.
HELD_TEXTS = 100_000


def _grams(text: str, n: int) -> set[str]:
    return {text[i : i + n] for i in range(len(text) - n + 1)}


class Index:
    """Claims in lower case, none of them empty."""

    def __init__(self, claims: Iterable[str], above: float):
        self.claims, self.above = list(claims), above
        self.longest = max(map(len, self.claims), default=0)
        own = [set(_WORD.findall(t)) for t in self.claims]
        self.sizes = np.array([len(w) for w in own], dtype=np.int64)
        self.most = int(self.sizes.max(initial=0))
        having: dict[str, list[int]] = {}
        for i, words in enumerate(own):
            for w in words:
                having.setdefault(w, []).append(i)
        self.having = {w: np.array(x, dtype=np.int32) for w, x in having.items()}
        # A claim is looked for where its rarest inner word is; one without inner words where its rarest characters are.
        self.by_word: dict[str, list[int]] = {}
        self.by_gram: dict[int, dict[str, list[int]]] = {}
        short: list[int] = []
        for i, t in enumerate(self.claims):
            inner = [w for w in _GAP.split(t)[1:-1] if w]
            if inner:
                self.by_word.setdefault(min(inner, key=lambda w: (len(having[w]), -len(w), w)), []).append(i)
            else:
                short.append(i)
        grams = {i: _grams(self.claims[i], min(3, len(self.claims[i]))) for i in short}
        seen: dict[str, int] = {}
        for own_grams in grams.values():
            for g in own_grams:
                seen[g] = seen.get(g, 0) + 1
        for i, own_grams in grams.items():
            g = min(own_grams, key=lambda g: (seen[g], g))
            self.by_gram.setdefault(len(g), {}).setdefault(g, []).append(i)


class Search:
    """The claims of an index that some evidence so far supports."""

    def __init__(self, index: Index):
        self.index = index
        self.found = np.zeros(len(index.claims), bool)
        self.left = len(index.claims)
        self._held: set[str] = set()

    def _mark(self, at: list[int]) -> None:
        for i in at:
            if not self.found[i]:
                self.found[i] = True
                self.left -= 1

    def read(self, text: str | None) -> None:
        """One text of evidence, in lower case."""
        if not text or not self.left:
            return
        x, found = self.index, self.found
        words = set(_WORD.findall(text))
        # Similarity is the size of the smaller set over that of the larger one at most.
        if words and x.most / len(words) > x.above:
            places = [x.having[w] for w in words if w in x.having]
            if places:
                shared = np.bincount(np.concatenate(places), minlength=len(x.claims))
                self._mark(np.flatnonzero((shared / np.maximum(1, x.sizes + len(words) - shared) > x.above) & ~found).tolist())
        inside = [i for w in words if w in x.by_word for i in x.by_word[w]]
        for n, known in x.by_gram.items():
            inside += [i for g in _grams(text, n) if g in known for i in known[g]]
        self._mark([i for i in inside if not found[i] and x.claims[i] in text])
        if len(text) <= x.longest:
            self._mark(self._around(text))

    def _around(self, text: str) -> list[int]:
        """Claims that hold the text: its inner words are words of the claim."""
        x = self.index
        inner = [w for w in _GAP.split(text)[1:-1] if w]
        if inner:
            if any(w not in x.having for w in inner):
                return []
            maybe = min((x.having[w] for w in inner), key=len).tolist()
        else:
            if text in self._held:
                return []
            if len(self._held) >= HELD_TEXTS:
                self._held.clear()
            self._held.add(text)
            maybe = np.flatnonzero(~self.found).tolist()
        return [i for i in maybe if not self.found[i] and text in x.claims[i]]
