"""Joins of short texts against brute force."""

from __future__ import annotations

import random
import re

import pytest

from granary.operators import pairs as P


def words(t):
    return {w for w in re.split(r"[^0-9A-Za-z_]+", t.lower()) if w}


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(11)
    vocabulary = ["the", "of", "a"] * 8 + [f"w{i}" for i in range(25)] + ["Ab-cd", "x", "(y)"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    b = [(i, text(rng.randrange(0, 14))) for i in range(60)] + [(60, None), (61, "")]
    a = [(i, text(rng.randrange(0, 9))) for i in range(60)]
    # Parts cut from the other side, within words too, and texts of one to three characters.
    for i, (_, t) in enumerate(b[:40]):
        if t:
            at = rng.randrange(len(t))
            a.append((100 + i, t[at : at + rng.choice([1, 2, 3, 9, 20])].upper()))
    a += [(200, None), (201, ""), (202, "..."), (203, "zebra of the")]
    return a, b, spark.createDataFrame(a, "x long, s string"), spark.createDataFrame(b, "y long, t string")


def test_similar(sides):
    a, b, left, right = sides
    want = {}
    for x, s in a:
        for y, t in b:
            p, q = words(s or ""), words(t or "")
            if p and q and len(p & q) / len(p | q) > 0.3:
                want[x, y] = len(p & q) / len(p | q)
    got = {(r["x"], r["y"]): r["jaccard"] for r in P.similar(left, right, "x", "y", "s", "t", 0.3).collect()}
    assert len(want) > 100 and got == pytest.approx(want)


def test_contained_and_supported(sides):
    a, b, left, right = sides
    want = {(x, y) for x, s in a for y, t in b if s and t is not None and s.lower() in t.lower()}
    got = [(r["x"], r["y"]) for r in P.contained(left, right, "x", "y", "s", "t").collect()]
    assert len(want) > 60 and len(got) == len(set(got)) and set(got) == want
    near = {r["x"] for r in P.similar(left, right, "x", "y", "s", "t", 0.3).collect()}
    around = {x for x, s in a for y, t in b if t and s and t.lower() in s.lower()}
    kept = {r["x"] for r in P.supported(left, right, "x", "y", "s", "t").collect()}
    assert kept == near | {x for x, _ in want} | around and not {200, 201} & kept
    assert P.supported(left.limit(0), right, "x", "y", "s", "t").count() == 0 == P.supported(left, right.limit(0), "x", "y", "s", "t").count()
