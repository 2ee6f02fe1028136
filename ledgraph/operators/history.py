"""History of changing attributes by differencing consecutive snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgraph.operators.ranking import numbered


def fact_snapshots(facts: DataFrame, policy: DataFrame) -> DataFrame:
    """The snapshots of each single-valued head and relation: one row per moment at which something was said.

    Leaves out withdrawn facts (superseded_at without superseded_by), relations whose policy isn't `single`,
    and rows whose head, relation or start is null. Of facts with the same start the one recorded last counts
    (null recorded_at first), then the greater fact_id. Repeated rows count once.
    """
    single = policy.where(F.col("policy") == "single").select("relation").distinct()
    live = facts.where(~(F.col("superseded_at").isNotNull() & F.col("superseded_by").isNull()))
    started = live.select("head", "relation", "tail", "fact_id", "recorded_at", F.coalesce("valid_from", "recorded_at").alias("start"))
    started = started.where(F.col("head").isNotNull() & F.col("start").isNotNull()).join(single, "relation", "left_semi")
    last = started.groupBy("head", "relation", "start").agg(F.max(F.struct("recorded_at", "fact_id", "tail")).alias("v"))
    return last.select("head", "relation", "start", "v.tail", "v.fact_id", "v.recorded_at")


def history(snapshots: DataFrame, keys: list[str], at: str, value: str, row_id: str, bucket: str = "month") -> DataFrame:
    """Versions of `value` per key with half-open validity, from any table of snapshots (keys, at, value, row_id).

    `at` must be unique in a key. Snapshot k of a key is held against snapshot k - 1 by a null-safe full outer
    join: a key without a predecessor is inserted, one with another value changed, one without a successor
    deleted. A null `value` is a value of its own. Inserted and changed events open a version; lead over them
    gives valid_until and the row that replaced it (null for the open version, also where the key ends).
    A busy key is spread over its time buckets, so no task holds all of it.
    """
    slot = F.date_trunc(bucket, F.col(at))
    cur = numbered(snapshots.select(*keys, at, value, row_id), keys, [F.col(at)], slot, "_pos")
    prev = cur.select(*[F.col(k).alias(f"p_{k}") for k in keys], (F.col("_pos") + 1).alias("p_pos"), F.col(value).alias("p_value"))
    on = cur["_pos"] == prev["p_pos"]
    for k in keys:
        on = on & cur[k].eqNullSafe(prev[f"p_{k}"])
    diff = cur.join(prev, on, "full_outer").withColumn(
        "change",
        F.when(F.col("p_pos").isNull(), "inserted").when(F.col("_pos").isNull(), "deleted").when(F.col(value).eqNullSafe(F.col("p_value")), "same").otherwise("changed"),
    )
    events = diff.where(F.col("change").isin("inserted", "changed")).select(*keys, at, value, row_id, "change")
    versions = numbered(events, keys, [F.col(at)], slot, "version_no")
    nxt = versions.select(*[F.col(k).alias(f"n_{k}") for k in keys], (F.col("version_no") - 1).alias("n_no"), F.col(at).alias("valid_until"), F.col(row_id).alias("replaced_by"))
    on = versions["version_no"] == nxt["n_no"]
    for k in keys:
        on = on & versions[k].eqNullSafe(nxt[f"n_{k}"])
    return versions.join(nxt, on, "left").select(*keys, "version_no", value, F.col(at).alias("valid_from"), "valid_until", F.col(row_id), "replaced_by", "change")


def fact_history(facts: DataFrame, policy: DataFrame) -> DataFrame:
    """Gapless history of the `single` relations of `facts`."""
    return history(fact_snapshots(facts, policy), ["head", "relation"], "start", "tail", "fact_id")
