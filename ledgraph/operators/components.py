"""Connected components: union-find in partitions, spanning forests merged level by level."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgraph.sources.tables import stage

STAR = pa.schema([("u", pa.string()), ("v", pa.string())])


def _stars(u: pa.ChunkedArray, v: pa.ChunkedArray):
    """The spanning forest of the edges as stars (member, smallest member of its tree), roots left out."""
    both = pa.chunked_array([*u.chunks, *v.chunks]).combine_chunks()
    coded = both.dictionary_encode()
    names = coded.dictionary
    order = pc.sort_indices(names).to_numpy()
    rank = [0] * len(order)
    for r, i in enumerate(order.tolist()):
        rank[i] = r
    ids, n = coded.indices.to_pylist(), len(u)
    parent = list(range(len(names)))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i in range(n):
        a, b = root(rank[ids[i]]), root(rank[ids[n + i]])
        if a < b:
            parent[b] = a
        elif b < a:
            parent[a] = b
    names = names.take(pa.array(order))
    roots = [root(x) for x in range(len(parent))]
    keep = [x for x in range(len(parent)) if roots[x] != x]
    return pa.RecordBatch.from_arrays([names.take(pa.array(keep, pa.int64())), names.take(pa.array([roots[x] for x in keep], pa.int64()))], schema=STAR)


def _forest(limit: int):
    """Per partition: union-find over at most about `limit` edges at a time; a fuller partition gives several forests."""

    def run(batches):
        held, rows = [], 0
        for b in batches:
            held.append(pa.RecordBatch.from_arrays([b.column(0), b.column(1)], schema=STAR))
            rows += b.num_rows
            if rows >= 2 * limit:
                t = pa.Table.from_batches(held)
                star = _stars(t.column(0), t.column(1))
                if star.num_rows >= limit:
                    yield star
                    held, rows = [], 0
                else:
                    held, rows = [star], star.num_rows
        if rows:
            t = pa.Table.from_batches(held)
            yield _stars(t.column(0), t.column(1))

    return run


def forest(edges: DataFrame, limit: int) -> DataFrame:
    return edges.select(F.col(edges.columns[0]).alias("u"), F.col(edges.columns[1]).alias("v")).mapInArrow(_forest(limit), "u string, v string")


def _size(edges: DataFrame) -> tuple[int, int]:
    """How many edges there are, and in how many partitions."""
    each = edges.select(F.spark_partition_id().alias("p")).groupBy("p").count()
    return tuple(each.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first())


def connected_groups(edges: DataFrame, limit: int = 1_000_000, fan_in: int = 8) -> DataFrame:
    """(group_id, member) of every end of `edges` (two string columns); group_id is the smallest member.

    Edges with a null end and loops are left out; turned, repeated and chained edges change nothing. No edges
    give no rows. A task holds at most about twice `limit` edges: partitions reduce their edges to spanning
    forests, and `fan_in` forests at a time are merged by the next level. While the forests together hold more
    than `limit` edges, a contraction first replaces each node by its neighbour of least hash, which keeps
    components and shrinks the nodes by a constant factor, and is undone by joins at the end.
    """
    a, b = edges.columns[:2]
    clean = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(a, b)
    now = stage(forest(clean, limit), "forest")
    (n, parts), last = _size(now), None
    undo: list[DataFrame] = []
    while n > limit:
        parts = max(2, -(-n // limit))
        if last is None or n < last * 0.7:  # merging alone still shrinks it
            last = n
            merged = stage(forest(now.repartition(max(1, parts // fan_in) if parts > fan_in else parts, "v"), limit), "forest")
        else:
            last, salt = None, len(undo)
            h = lambda c: F.xxhash64(F.lit(salt), F.col(c))
            sides = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            near = sides.groupBy("u").agg(F.min(F.struct(h("v").alias("h"), F.col("v"))).alias("m"))
            near = stage(near.where(F.col("m.h") < h("u")).select(F.col("u").alias("was"), F.col("m.v").alias("now")), "contract")
            undo.append(near)
            x = now.join(near, F.col("u") == F.col("was"), "left").select(F.coalesce("now", "u").alias("u"), "v")
            x = x.join(near, F.col("v") == F.col("was"), "left").select("u", F.coalesce("now", "v").alias("v"))
            merged = stage(forest(x.where("u <> v"), limit), "forest")
        now = merged
        n, parts = _size(now)
    while parts > 1:
        parts = max(1, parts // fan_in)
        now = forest(now.coalesce(parts), limit) if parts > 1 else forest(now.repartition(1), 2 * limit + 1)
    if not undo:
        tree = stage(now, "groups")
        roots = tree.select(F.col("v").alias("group_id")).distinct()
        return tree.select(F.col("v").alias("group_id"), F.col("u").alias("member")).unionByName(roots.select("group_id", F.col("group_id").alias("member")))
    label = stage(now.select(F.col("u").alias("x"), F.col("v").alias("c")), "label")
    for near in reversed(undo):
        back = near.join(label, F.col("now") == F.col("x"), "left").select(F.col("was").alias("x"), F.coalesce("c", "now").alias("c"))
        label = stage(label.unionByName(back), "label")
    members = label.unionByName(label.select(F.col("c").alias("x"), "c")).distinct()
    least = members.groupBy("c").agg(F.min("x").alias("group_id"))
    return members.join(least, "c").select("group_id", F.col("x").alias("member"))
