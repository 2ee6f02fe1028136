"""String similarities as Arrow UDFs, from their published definitions; null with anything gives null."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits of one integer."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def indel(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 1.0 if n == 0 else 2 * lcs(a, b) / n


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_a or not only_b):
        return 1.0
    left, right = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    return max(indel(left, right), *((indel(both, left), indel(both, right)) if both else (0.0,)))


def partial(a: str, b: str) -> float:
    """The best indel ratio of the shorter string against windows of its length in the longer.

    A window that begins (at the left edge: ends) with a letter the shorter one lacks is left out, as the next shorter
    or shifted one is at least as good.
    """
    a, b = sorted((a, b), key=len)
    if not a:
        return 1.0 if not b else 0.0
    n, where = len(a), {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, best = (1 << n) - 1, 0.0
    for i in range(1 - n, len(b)):
        w = b[max(0, i) : i + n]
        if (w[0] if i >= 0 else w[-1]) not in where or 2 * min(n, len(w)) / (n + len(w)) <= best:
            continue
        v = full
        for c in w:
            u = v & where.get(c, 0)
            v = ((v + u) | (v - u)) & full
        best = max(best, 2 * (n - v.bit_count()) / (n + len(w)))
    return best


def weighted(a: str, b: str) -> float:
    """The greatest of plain, token and, for unlike lengths, partial ratios, the latter with their usual weights."""
    return _weighted(a, b)[0]


def _weighted(a: str, b: str) -> tuple[float, float, float | None]:
    """The weighted ratio, the token sort ratio, and the partial one if it was needed."""
    if not a or not b:
        return 0.0, token_sort(a, b), None
    base, by_sort = indel(a, b), token_sort(a, b)
    tokens = max(by_sort, token_set(a, b))
    ratio = max(len(a), len(b)) / min(len(a), len(b))
    if ratio < 1.5:
        return max(base, 0.95 * tokens), by_sort, None
    scale, part = 0.9 if ratio <= 8 else 0.6, partial(a, b)
    return max(base, scale * part, 0.95 * scale * tokens), by_sort, part


def best_ratio(a: str, b: str) -> float:
    """The greatest of the weighted, the token sort and 0.95 of the partial ratio; the latter only where it can be it."""
    w, by_sort, part = _weighted(a, b)
    best = max(w, by_sort)
    return best if best >= 0.95 else max(best, 0.95 * (partial(a, b) if part is None else part))


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [c for j, c in enumerate(b) if used[j]]
    m, t = len(hits), sum(x != y for x, y in zip(hits, other)) // 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    j = jaro(a, b)
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return j + same * 0.1 * (1 - j) if j > 0.7 else j


def _udf(f):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


SIMILARITIES = {"indel": indel, "token_sort": token_sort, "token_set": token_set, "partial": partial, "weighted": weighted, "jaro_winkler": jaro_winkler, "best": best_ratio}
UDFS = {k: _udf(f) for k, f in SIMILARITIES.items()}
