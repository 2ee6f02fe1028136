"""Pairs of two sets of folded strings that can reach a weighted ratio, without meeting on common words.

The weighted ratio (`functions.similarity.weighted`) reaches 0.9 or more in four ways only: by the plain ratio or that
of sorted words, which need letters in common (`near`); by words of which one side has all but a few short ones
(`by_words`); or, from 1.5 times the length, by one string inside the other (`inside`).
"""

from __future__ import annotations

from collections import Counter
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgraph.sources.tables import stage

#: From here on the bounds of this module hold; below, windows that are not equal count too.
LEAST = 0.9
_SLACK = 1e-9


def pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b): every a of `left` (s) and b of `right` (s) with `weighted` of `least` (0.9 or more), and some others. Strings are folded: words of letters and digits, single spaces; equal ones are left out."""
    if least < LEAST:
        raise ValueError(f"a bound under {LEAST} is not met by these rules")
    both = near(left, right, least)
    if least / 0.95 <= 1:
        both = both.unionByName(by_words(left, right, least)).unionByName(by_words(right, left, least).select(F.col("b").alias("a"), F.col("a").alias("b")))
    if least <= 0.9:
        both = both.unionByName(inside(left, right)).unionByName(inside(right, left).select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.where("a <> b").distinct()


# Letters in common


def near(left: DataFrame, right: DataFrame, least: float, tile: int = 6000, wide: int = 40_000) -> DataFrame:
    """(a, b) whose plain ratio is `least` or whose letters allow a ratio of words that weighs as much.

    Every two strings meet, but only as counts of letters of like lengths: tiles of `left` and wider ones of `right`
    by hash meet in a task of their own, a byte a letter and pair.
    """
    def tiled(df, n):
        return df.select("s", F.expr(f"cast(pmod(xxhash64(s), {n}) as int)").alias("g"))

    n, m = (max(1, ceil(df.count() / size)) for df, size in ((left, tile), (right, wide)))
    l = tiled(left, n).select(F.col("g").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"), "s")
    r = tiled(right, m).select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"), F.col("g").alias("h"), "s")

    def run(key, x, y):
        a, b = (t["s"].to_pylist() for t in (x, y))
        got = like(a, b, least)
        return pa.table({"a": pa.array([a[p] for p, _ in got], pa.string()), "b": pa.array([b[q] for _, q in got], pa.string())})

    return l.groupBy("i", "j").cogroup(r.groupBy("k", "h")).applyInArrow(run, "a string, b string")


def forms(s: str) -> list[str]:
    """The string, and its different words where it repeats one: what word ratios compare has the letters of either."""
    words = s.split()
    once = set(words)
    return [s] if len(once) == len(words) else [s, " ".join(sorted(once))]


def like(a: list[str], b: list[str], least: float) -> list[tuple[int, int]]:
    """Places (in a, in b) of the pairs that `near` gives."""
    x, y = ([(f, i, k) for i, s in enumerate(side) for k, f in enumerate(forms(s)) if f] for side in (a, b))
    short = lambda side: [t for t in side if len(t[0]) <= 64]
    got = _like_short(short(x), short(y), least)
    for many, few, turned in ((y, [t for t in x if len(t[0]) > 64], False), (short(x), [t for t in y if len(t[0]) > 64], True)):
        counts = [(len(s), Counter(s), i) for s, i, _ in many] if few else []
        for s, i, _ in few:
            n, c = len(s), Counter(s)
            for m, d, j in counts:
                if 2 * min(n, m) + _SLACK >= least * (n + m) and 2 * sum(min(v, d[k]) for k, v in c.items()) + _SLACK >= least * (n + m):
                    got.add((j, i) if turned else (i, j))
    return sorted(got)


def _like_short(x: list, y: list, least: float, batch: int = 200_000) -> set[tuple[int, int]]:
    """Pairs of strings of 64 letters at most: letters in common by counts, then the longest common subsequence in bits."""
    if not x or not y:
        return set()
    y = sorted(y, key=lambda t: len(t[0]))
    codes = lambda side: np.array([t[0] for t in side], dtype="U64").view(np.uint32).reshape(len(side), 64)
    cy, ny = codes(y), np.array([len(t[0]) for t in y])
    letters = np.unique(cy)
    letters = letters[letters > 0]
    place = {chr(c): k for k, c in enumerate(letters)}
    cy = np.where(cy > 0, np.searchsorted(letters, cy), len(letters)).astype(np.int32)
    count = np.zeros((len(letters) + 1, len(y)), np.uint8)
    bits = np.zeros((len(letters) + 1, len(y)), np.uint64)
    at = np.arange(len(y))
    for i in range(int(ny[-1])):
        count[cy[:, i], at] += 1
        bits[cy[:, i], at] |= np.uint64(1 << i)
    bits[-1] = 0
    worth = least / 0.95
    ends: dict[int, tuple] = {}
    got: set[tuple[int, int]] = set()
    wait: list[tuple[int, np.ndarray, np.ndarray]] = []

    def settle():
        p = np.repeat(np.array([w[0] for w in wait]), [len(w[1]) for w in wait])
        q, common = np.concatenate([w[1] for w in wait]), np.concatenate([w[2] for w in wait])
        n = np.array([len(t[0]) for t in x])[p] + ny[q]
        few, back = np.unique(p, return_inverse=True)
        text = np.full((len(few), 64), len(letters), np.int32)
        for k, i in enumerate(few.tolist()):
            text[k, : len(x[i][0])] = [place.get(c, len(letters)) for c in x[i][0]]
        v = np.full(len(p), ~np.uint64(0))
        for i in range(max(len(x[k][0]) for k in few.tolist())):
            u = v & bits[text[back, i], q]
            v = (v + u) | (v - u)
        lcs = 64 - np.bitwise_count(v).astype(np.int64)
        keep = (2 * lcs + _SLACK >= least * n) | (2 * common + _SLACK >= worth * n)
        got.update((x[i][1], y[j][1]) for i, j in zip(p[keep].tolist(), q[keep].tolist()))
        wait.clear()

    pending = 0
    for k, (s, _, _) in enumerate(x):
        n = len(s)
        if n not in ends:
            lo, hi = np.searchsorted(ny, ceil(n * least / (2 - least) - _SLACK)), np.searchsorted(ny, int(n * (2 - least) / least + _SLACK), "right")
            ends[n] = lo, hi, np.ceil(least * (n + ny[lo:hi]) / 2 - _SLACK).astype(np.uint8)
        lo, hi, need = ends[n]
        if lo >= hi:
            continue
        common = np.zeros(hi - lo, np.uint8)
        for c, m in Counter(s).items():
            if c in place:
                common += np.minimum(count[place[c], lo:hi], np.uint8(m))
        q = np.flatnonzero(common >= need)
        if len(q):
            wait.append((k, q + lo, common[q].astype(np.int64)))
            pending += len(q)
        if pending >= batch:
            settle()
            pending = 0
    if wait:
        settle()
    return got


# Words in common


def by_words(few: DataFrame, many: DataFrame, least: float) -> DataFrame:
    """(a, b): all words of a of `few` that are too long to be left out are in b of `many`, by the one that fewest of `many` have."""
    worth = least / 0.95
    spare = (2 - 2 * worth) / (2 - worth)

    w = F.array_distinct(F.split("s", " "))
    long_ = F.filter("w", lambda x: F.length(x) > F.length(F.array_join("w", " ")) * spare - 1 + _SLACK)
    one = F.size(long_) > 0
    asked = few.select("s", w.alias("w")).select("s", one.alias("one"), F.explode(F.when(one, long_).otherwise(F.col("w"))).alias("w"))
    words = stage(many.select("s", F.explode(F.array_distinct(F.split("s", " "))).alias("w")), "words")
    df = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    seen = stage(asked.join(df, "w", "left").withColumn("n", F.coalesce("n", F.lit(0))), "asked")
    best = seen.where("one").groupBy("s").agg(F.min(F.struct("n", "w")).alias("x")).select("s", F.col("x.w").alias("w"))
    keys = best.unionByName(seen.where("not one").select("s", "w"))
    p = keys.withColumnRenamed("s", "a").join(words.withColumnRenamed("s", "b"), "w")
    return p.where("2 * greatest(length(a), length(b)) < 3 * least(length(a), length(b))").select("a", "b").distinct()


def inside(few: DataFrame, many: DataFrame, gram: int = 5) -> DataFrame:
    """(a, b): a of `few` stands in b of `many`, which is 1.5 to 8 times as long.

    A string of `gram` letters or more is looked for by that of its grams that fewest of `many` have; a shorter one by
    its only word of two letters or more, which must be one of the other's or one of its words without a letter.
    """
    def grams(df):
        return df.where(F.length("s") >= gram).select("s", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("s") - gram + 1), lambda i: F.substr("s", i, F.lit(gram))))).alias("w"))

    index = stage(grams(many), "grams")
    df = index.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    asked = grams(few).join(df, "w", "left")
    keys = asked.groupBy("s").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("w"))).alias("x")).select(F.col("s").alias("a"), F.col("x.w").alias("w"))
    p = keys.join(index.withColumnRenamed("s", "b"), "w")
    small = few.where(F.length("s") < gram).select(F.col("s").alias("a"), F.explode(F.filter(F.split("s", " "), lambda x: F.length(x) > 1)).alias("w"))
    words = many.select(F.col("s").alias("b"), F.explode(F.filter(tokens("s"), lambda x: F.length(x) < gram)).alias("w"))
    p = p.unionByName(small.join(words, "w").select(*p.columns))
    return p.where("contains(b, a) and 2 * length(b) >= 3 * length(a) and length(b) <= 8 * length(a)").select("a", "b").distinct()


def tokens(c: str):
    """Words of two letters or more of a folded string, and those of five or more without each one letter."""
    w = F.filter(F.split(c, " "), lambda x: F.length(x) > 1)
    short = F.flatten(F.transform(F.filter(w, lambda x: F.length(x) >= 5), lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))))
    return F.array_distinct(F.concat(w, short))
