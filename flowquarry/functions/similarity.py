"""Jaro-Winkler similarity, in Arrow batches; each distinct pair of a batch is computed once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(max(la, lb) // 2 - 1, 0)
    used, hit = [False] * lb, []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hit.append(c)
                break
    m = len(hit)
    if not m:
        return 0.0
    other = [b[j] for j in range(lb) if used[j]]
    swaps = sum(x != y for x, y in zip(hit, other, strict=True)) // 2
    return (m / la + m / lb + (m - swaps) / m) / 3


def jaro_winkler_text(a: str, b: str, weight: float = 0.1, least: float = 0.7) -> float:
    """Jaro with a bonus for up to four equal first letters, given above ``least``."""
    s = jaro(a, b)
    if s <= least:
        return s
    n = 0
    while n < min(4, len(a), len(b)) and a[n] == b[n]:
        n += 1
    return s + n * weight * (1 - s)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict[tuple, float | None] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in seen:
            seen[pair] = None if pair[0] is None or pair[1] is None else jaro_winkler_text(*pair)
        out.append(seen[pair])
    return pd.Series(out, dtype="float64")
