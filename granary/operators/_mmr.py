"""Greedy choice of one claim's evidence."""

from __future__ import annotations

import pandas as pd


def choose(pdf: pd.DataFrame, k: int, diversity: float) -> pd.DataFrame:
    rows = sorted(zip(pdf["evidence_id"], pdf["overlap"], map(frozenset, pdf["words"])))
    taken: list[tuple] = []
    near = [0.0] * len(rows)  # greatest similarity to the rows taken
    left = set(range(len(rows)))
    while left and len(taken) < k:
        i = max(left, key=lambda j: ((1 - diversity) * rows[j][1] - diversity * near[j], -j))
        left.remove(i)
        taken.append((pdf["claim_id"].iloc[0], rows[i][0], len(taken) + 1, rows[i][1]))
        for j in left:
            a, b = rows[i][2], rows[j][2]
            near[j] = max(near[j], len(a & b) / len(a | b) if a | b else 0.0)
    return pd.DataFrame(taken, columns=["claim_id", "evidence_id", "rank", "overlap"])
