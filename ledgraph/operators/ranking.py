"""Ordered numbering of keys of any size.

A plain row_number() sorts a whole key in one task. Here each key is cut into time buckets; rows are
numbered inside a bucket and the buckets' counts, one row each, give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str) -> DataFrame:
    """`df` with the 1-based position `name` of each row in its key.

    `bucket` must not decrease along `order`. Null keys form a key of their own. Rows equal in `order`
    are numbered in any order, so `order` should be total.
    """
    b, n, off = f"_{name}_b", f"_{name}_n", f"_{name}_o"
    cut = df.withColumn(b, bucket)
    sizes = cut.groupBy(*keys, b).agg(F.count(F.lit(1)).alias(n))
    before = F.coalesce(F.sum(n).over(W.partitionBy(*keys).orderBy(b).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(b).alias(f"{b}2"), before.alias(off))
    inside = F.row_number().over(W.partitionBy(*keys, b).orderBy(*order))
    ranked = cut.withColumn(n, inside)
    on = F.lit(True)
    for k in keys:
        on = on & ranked[k].eqNullSafe(F.col(f"_k_{k}"))
    on = on & ranked[b].eqNullSafe(F.col(f"{b}2"))
    return (
        ranked.join(offsets, on, "inner")
        .withColumn(name, (F.col(n) + F.col(off)).cast("long"))
        .drop(b, n, off, f"{b}2", *[f"_k_{k}" for k in keys])
    )
