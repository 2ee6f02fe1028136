"""Attributes as known at event time, by path-copied persistent search trees.

For each shard (head, relation, a range of starts) one tree over the facts in order of start is built. Each moment
at which something becomes known or is withdrawn makes a new root that shares all but one path with the one before.
A lookup picks the root of its moment, then the last visible fact at or before that moment.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgraph.sources.tables import micros


class PersistentTree:
    """Versions of a set of ranks 0..n-1; node 0 is the empty subtree, node 1 a present leaf."""

    def __init__(self, n: int):
        self.span = 1
        while self.span < max(1, n):
            self.span *= 2
        self.left, self.right = [0, 0], [0, 0]

    def put(self, root: int, rank: int, present: bool) -> int:
        path, node, lo, span = [], root, 0, self.span
        while span > 1:
            span //= 2
            go = rank >= lo + span
            path.append((node, go))
            node = self.right[node] if go else self.left[node]
            lo += span if go else 0
        made = 1 if present else 0
        for node, go in reversed(path):
            a, b = (self.left[node], made) if go else (made, self.right[node])
            if a == b == 0:
                made = 0
                continue
            self.left.append(a)
            self.right.append(b)
            made = len(self.left) - 1
        return made

    def last_before(self, root: int, bound: int) -> int:
        """The greatest present rank under `bound`, or -1."""
        stack, best = [(root, 0, self.span)], -1
        while stack:
            node, lo, span = stack.pop()
            if not node or lo >= bound:
                continue
            if span == 1:
                return lo
            half = span // 2
            stack.append((self.left[node], lo, half))
            stack.append((self.right[node], lo + half, half))
        return best


class Shard:
    """The facts (start, recorded, withdrawn or None, id) of one shard and the roots by known time."""

    def __init__(self, facts: list[tuple]):
        self.facts = sorted(facts, key=lambda f: f[:2] + (f[3],))
        self.starts = [f[0] for f in self.facts]
        tree = self.tree = PersistentTree(len(facts))
        told = []
        for rank, (_, rec, gone, _) in enumerate(self.facts):
            if gone is None or gone > rec:
                told.append((rec, rank, True))
                if gone is not None:
                    told.append((gone, rank, False))
        told.sort()
        self.times, self.roots, root = [], [0], 0
        for at, rank, present in told:
            root = tree.put(root, rank, present)
            self.times.append(at)
            self.roots.append(root)

    def find(self, at: int):
        root = self.roots[bisect_right(self.times, at)]
        rank = self.tree.last_before(root, bisect_right(self.starts, at))
        return self.facts[rank] if rank >= 0 else None


FOUND = pa.schema([("lookup_id", pa.int64()), ("start", pa.int64()), ("rec", pa.int64()), ("fact_id", pa.string())])


def _search(batches):
    """Rows sorted by head, relation, part, kind: the facts of a shard come before its lookups."""
    key = shard = None
    facts: list[tuple] = []
    for batch in batches:
        out: list[list] = [[], [], [], []]
        cols = [batch.column(c).to_pylist() for c in ("head", "relation", "part", "kind", "t", "rec", "gone", "fact_id", "lookup_id")]
        for head, rel, part, kind, t, rec, gone, fid, lid in zip(*cols):
            if key != (head, rel, part):
                key, facts, shard = (head, rel, part), [], None
            if kind == 0:
                facts.append((t, rec, gone, fid))
            elif facts:
                if shard is None:
                    shard = Shard(facts)
                hit = shard.find(t)
                if hit:
                    for o, v in zip(out, (lid, hit[0], hit[1], hit[3])):
                        o.append(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(out, FOUND)], schema=FOUND)


def known_at(lookups: DataFrame, facts: DataFrame, shard_rows: int = 100_000, block_rows: int = 200_000) -> DataFrame:
    """(lookup_id, fact_id): the fact known and held valid at each lookup's asked_at.

    A fact is visible at t if recorded_at and its start (valid_from, else recorded_at) are at or before t and it
    isn't withdrawn at or before t. The one with the latest start wins, then the latest recorded_at, then the
    greatest fact_id. Lookups with a null head, relation or asked_at, facts with a null head, relation, fact_id or
    recorded_at, and lookups without a visible fact give no row; repeated rows count once.

    A key with more than `shard_rows` facts is cut into ranges of starts. A range that has a fact which is never
    withdrawn answers each later moment from that fact's recording on, so a lookup visits its own range and the
    earlier ones back to the first such range only. A key with more than `block_rows` lookups has its facts
    repeated for each block of them.
    """
    keys = ["head", "relation"]
    f = (
        facts.where("head is not null and relation is not null and recorded_at is not null and fact_id is not null")
        .withColumn("start", F.coalesce("valid_from", "recorded_at"))
        .select(*keys, micros("start").alias("t"), micros("recorded_at").alias("rec"), F.when(F.col("superseded_by").isNull(), micros("superseded_at")).alias("gone"), "fact_id")
        .groupBy(*keys, "fact_id", "t", "rec")
        .agg(F.min("gone").alias("gone"))
    )
    q = (
        lookups.where("head is not null and relation is not null and asked_at is not null and lookup_id is not null")
        .select(*keys, micros("asked_at").alias("t"), F.col("lookup_id").cast("long").alias("lookup_id"))
        .distinct()
    )
    hour = F.floor(F.col("t") / 3_600_000_000)
    large = f.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows).select(*keys)
    slots = f.join(large, keys, "left_semi").groupBy(*keys, hour.alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.min(F.when(F.col("gone").isNull(), F.col("rec"))).alias("sure")
    )
    before = F.sum("n").over(W.partitionBy(*keys).orderBy("slot").rowsBetween(W.unboundedPreceding, -1))
    slots = slots.withColumn("shard", F.floor(F.coalesce(before, F.lit(0)) / shard_rows).cast("int"))
    f = f.withColumn("slot", hour).join(slots.select(*keys, "slot", "shard"), [*keys, "slot"], "left").withColumn("shard", F.coalesce("shard", F.lit(0)))
    ranges = slots.groupBy(*keys, "shard").agg(F.min("lo").alias("lo"), F.min("sure").alias("sure"))
    ranges = ranges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("shard", "lo", "sure"))).alias("ranges"))
    crowded = q.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows).select(*keys, F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    q = q.join(ranges, keys, "left").join(crowded, keys, "left")
    own = F.expr("array_max(transform(filter(ranges, r -> r.lo <= t), r -> r.shard))")
    back = F.expr("coalesce(array_max(transform(filter(ranges, r -> r.shard < own and r.sure <= t), r -> r.shard)), 0)")
    q = q.withColumn("own", F.when(F.col("ranges").isNull(), 0).otherwise(own)).where("own is not null")
    q = q.withColumn("shard", F.explode(F.when(F.col("ranges").isNull(), F.array(F.lit(0))).otherwise(F.sequence(back, F.col("own")))))
    q = q.withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.expr("cast(pmod(xxhash64(lookup_id), blocks) as int)")))
    f = f.join(crowded, keys, "left").withColumn("block", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.expr("sequence(0, blocks - 1)"))))
    part = F.struct("shard", "block")
    both = f.select(*keys, part.alias("p"), F.lit(0).alias("kind"), "t", "rec", "gone", "fact_id", F.lit(None).cast("long").alias("lookup_id")).unionByName(
        q.select(*keys, part.alias("p"), F.lit(1).alias("kind"), "t", F.lit(None).cast("long").alias("rec"), F.lit(None).cast("long").alias("gone"), F.lit(None).cast("string").alias("fact_id"), "lookup_id")
    )
    both = both.withColumn("part", F.concat_ws("/", "p.shard", "p.block")).drop("p")
    hits = both.repartition(*keys, "part").sortWithinPartitions(*keys, "part", "kind").mapInArrow(_search, "lookup_id long, start long, rec long, fact_id string")
    best = hits.groupBy("lookup_id").agg(F.max(F.struct("start", "rec", "fact_id")).alias("b"))
    return best.select("lookup_id", F.col("b.fact_id").alias("fact_id"))
