"""Consolidating pairwise matches into groups: which pairs count, and their groups.

The union-find in partitions and the merging of forests are the core's (`operators.components`), as its own clustering
needs them as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgraph.operators.components import connected_groups

__all__ = ["accepted", "connected_groups"]


def accepted(pairs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """The accepted pairs: both ends present (not null, not blank) and different, score at least `threshold`."""
    there = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c)) != "")
    return pairs.where(there("a") & there("b") & (F.col("a") != F.col("b")) & (F.col("score") >= threshold)).select("a", "b")
