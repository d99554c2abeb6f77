"""Vector distances as expressions, and string similarity as an Arrow-batched function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two numeric arrays in doubles; null if either is null or lengths differ."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), d)


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, f in zip(b, free) if not f]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3.0


def jaro_winkler_text(a: str | None, b: str | None) -> float | None:
    """Jaro similarity raised for a common prefix of up to four characters, from 0.7 on; null for nulls."""
    if a is None or b is None:
        return None
    s = jaro(a, b)
    if s > 0.7:
        prefix = 0
        for x, y in zip(a[:4], b[:4]):
            if x != y:
                break
            prefix += 1
        s += prefix * 0.1 * (1.0 - s)
    return s


def _plain_pairs(a: pd.Series, b: pd.Series) -> np.ndarray:
    """jaro_winkler_text of ASCII texts that are not empty, by DuckDB's function, which goes by bytes."""
    import duckdb

    pairs = pd.DataFrame({"a": a, "b": b})  # noqa: F841
    con = duckdb.connect(config={"threads": "1"})
    try:
        return con.execute("SELECT jaro_winkler_similarity(a, b) AS s FROM pairs").fetchnumpy()["s"]
    finally:
        con.close()


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    plain = np.array([bool(x and y) and x.isascii() and y.isascii() for x, y in zip(a, b)], dtype=bool)
    out = np.full(len(a), np.nan)
    if plain.any():
        out[plain] = _plain_pairs(a[plain], b[plain])
    other = np.flatnonzero(~plain)
    out[other] = [jaro_winkler_text(x, y) for x, y in zip(a.iloc[other], b.iloc[other])]
    return pd.Series(out).where(a.notna().to_numpy() & b.notna().to_numpy(), None)
