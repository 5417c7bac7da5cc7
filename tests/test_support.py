"""Claims and the evidence that supports them, without a shuffle of the evidence."""

from __future__ import annotations

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from granary.operators import pairs as P


@pytest.fixture(scope="module")
def tables():
    """Odd texts: cut within words, without words, with letters outside ASCII, null, empty, repeated."""
    rng = random.Random(5)
    words = ["the", "of"] * 6 + [f"w{i}" for i in range(40)] + ["Ñandú", "été", "(y)", "--", "a_b", "İx"]
    text = lambda n: rng.choice([" ", "\n", ", "]).join(rng.choice(words) for _ in range(n))
    docs = [text(rng.randrange(0, 30)) for _ in range(80)] + [None, "", "...", "é", "w1"]
    claims = [text(rng.randrange(0, 12)) for _ in range(60)] + [None, "...", "zebra", "of the zebra", "-", "é"]
    for d in docs[:60]:
        if d:
            at = rng.randrange(len(d))
            claims.append(d[at : at + rng.choice([1, 2, 3, 5, 9, 25])].upper())
    claims += claims[:5] + [" ".join(rng.choice(words[:2] + [f"v{i}" for i in range(50)]) for _ in range(8)) for _ in range(30)]
    return [(i if i % 17 else None, t) for i, t in enumerate(claims)], list(enumerate(docs))


def test_blocks_are_the_joins(spark, tables, monkeypatch):
    a, b = tables
    left, right = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(a)], "x long, s string"), spark.createDataFrame(b, "y long, t string")
    rows = lambda df: sorted(r["x"] for r in df.collect())
    want = rows(P.supported_by_joins(left, right, "x", "y", "s", "t"))
    got = P.supported(left, right, "x", "y", "s", "t")
    assert got.columns == left.columns and rows(got) == want and 20 < len(want) < len(a) - 20
    monkeypatch.setattr(P, "BLOCK_BYTES", 400)
    assert rows(P.supported(left, right, "x", "y", "s", "t")) == want
    monkeypatch.setattr(P, "MOST_BLOCKS", 1)
    assert rows(P.supported(left, right, "x", "y", "s", "t")) == want


def test_evidence_is_not_shuffled(spark, tables):
    a, b = tables
    left, right = spark.createDataFrame(a, "x long, s string"), spark.createDataFrame(b, "y long, t string")
    plan = P.supported(left, right.where(F.col("t") != "of all evidence"), "x", "y", "s", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("of all evidence") == 1 and "explode" not in plan


@pytest.mark.parametrize("empty_claim", [False, True])
def test_query_is_its_sql(spark, tables, tmp_path, empty_claim):
    from granary.plans import catalog

    a, b = tables
    a = a + [(1000, "")] * empty_claim
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in a], pa.int64()), "text": pa.array([t for _, t in a], pa.string())}), tmp_path / "benchmark.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in b], pa.int64()), "text": pa.array([t for _, t in b], pa.string())}), tmp_path / "documents.parquet")
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    key = lambda x: (x is None, x or 0)
    want = sorted((r[0] for r in con.execute(catalog.oracle_sql()["claim_support_semijoin"]).fetchall()), key=key)
    got = sorted((r[0] for r in catalog.queries()["claim_support_semijoin"](spark, str(tmp_path)).collect()), key=key)
    assert got == want and (1000 in got) == empty_claim
