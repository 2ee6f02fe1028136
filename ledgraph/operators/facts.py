"""The bi-temporal fact store: folds, points in time, contradictions, and what a prompt is told."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgraph.operators.ranking import numbered
from ledgraph.sources.tables import stage


def start():
    return F.coalesce("valid_from", "recorded_at")


def unique_facts(facts: DataFrame) -> DataFrame:
    """Each fact_id once: the copy of greatest support, then confidence, then the greatest of the rest; no row is put together from two."""
    rest = [c for c in facts.columns if c not in ("fact_id", "support", "confidence")]
    best = facts.groupBy("fact_id").agg(F.max(F.struct("support", "confidence", *rest)).alias("_b"))
    return best.select("fact_id", "_b.*").select(*facts.columns)


def current(facts: DataFrame, head: str | None = None) -> DataFrame:
    f = facts.where("superseded_at is null")
    return f if head is None else f.where((F.col("head") == head) | (F.lower("head_name") == head.lower()))


def as_of(facts: DataFrame, valid_at=None, known_at=None) -> DataFrame:
    """Facts valid at `valid_at` (half-open, a null valid_from starts at recorded_at) and believed at `known_at`."""
    f = facts
    if valid_at is not None:
        t = F.lit(valid_at).cast("timestamp_ntz")
        f = f.where((start() <= t) & (F.col("valid_until").isNull() | (F.col("valid_until") > t)))
    if known_at is not None:
        t = F.lit(known_at).cast("timestamp_ntz")
        f = f.where((F.col("recorded_at") <= t) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > t)))
    return f


def accumulate(facts: DataFrame) -> DataFrame:
    """The fold of relations that take many values: one row for each (head, relation, tail), repeats corroborate."""
    return facts.groupBy("head", "relation", "tail").agg(
        F.max("confidence").alias("confidence"), F.sum("support").cast("long").alias("support"), F.min(start()).alias("valid_from"), F.max(start()).alias("last_seen"), F.countDistinct("episode_id").alias("n_episodes")
    )


def islands(facts: DataFrame, keys: list[str], bucket: str = "month") -> DataFrame:
    """The fold of relations of one value at a time: runs of equal tails collapse, the next run's start ends one.

    Facts are numbered in their key through time buckets, so a busy key is spread; each is held against the one before
    by a join, and the runs are numbered the same way. Facts without a start are left out.
    """
    f = facts.withColumn("s", start()).where("s is not null").withColumn("slot", F.date_trunc(bucket, F.col("s")))
    f = stage(numbered(f.select(*keys, "s", "slot", "recorded_at", "tail", "fact_id", "confidence", "support"), keys, [F.col("s"), F.col("recorded_at"), F.col("tail"), F.col("fact_id")], F.col("slot"), "pos"), "numbered")
    same = lambda l, r, on: on & functools.reduce(lambda c, k: c & l[k].eqNullSafe(r[f"_{k}"]), keys, F.lit(True))
    before = f.select(*[F.col(k).alias(f"_{k}") for k in keys], (F.col("pos") + 1).alias("_pos"), F.col("tail").alias("_tail"))
    opens = f.join(before, same(f, before, f["pos"] == before["_pos"]), "left").where(F.col("_pos").isNull() | ~F.col("tail").eqNullSafe(F.col("_tail"))).select(*keys, "s", "slot", "tail", "pos")
    runs = stage(numbered(opens, keys, [F.col("pos")], F.col("slot"), "run"), "runs")
    nxt = runs.select(*[F.col(k).alias(f"_{k}") for k in keys], (F.col("run") - 1).alias("_run"), F.col("pos").alias("until"), F.col("s").alias("valid_until"))
    runs = runs.join(nxt, same(runs, nxt, runs["run"] == nxt["_run"]), "left").select(*keys, "run", "pos", "until", "tail", F.col("s").alias("valid_from"), "valid_until")
    # The run of a fact: the last one of its slot that opened at or before it, else the last run of an earlier slot.
    r = runs.select(*[F.col(k).alias(f"_{k}") for k in keys], "run", F.col("pos").alias("lo"), F.coalesce("until", F.lit(2**62)).alias("hi"))
    slots = f.groupBy(*keys, "slot").agg(F.min("pos").alias("p0"), F.max("pos").alias("p1"))
    meets = slots.join(r, same(slots, r, (F.col("lo") <= F.col("p1")) & (F.col("hi") > F.col("p0")))).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("slot").alias("_slot"), "run", "lo", "hi")
    m = f.join(meets, same(f, meets, f["slot"].eqNullSafe(meets["_slot"]) & (F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi"))))
    sums = m.groupBy(*keys, "run").agg(F.max("confidence").alias("confidence"), F.sum("support").cast("long").alias("support")).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("run").alias("_run"), "confidence", "support")
    return runs.join(sums, same(runs, sums, runs["run"] == sums["_run"])).select(*keys, "tail", "valid_from", "confidence", "support", "valid_until")


def contradictions(facts: DataFrame) -> DataFrame:
    """(old, new, head, relation): superseded facts with the facts that replaced them; dangling references give none."""
    n = facts.select(F.col("fact_id").alias("new")).distinct()
    return facts.where("superseded_by is not null").select(F.col("fact_id").alias("old"), F.col("superseded_by").alias("new"), "head", "relation").distinct().join(n, "new").select("old", "new", "head", "relation")


def fold_group(pdf: pd.DataFrame, policy: str, alternatives: set[tuple[str, str]] | None) -> tuple[list[dict], list[tuple]]:
    """The facts of one head and relation asserted in order of recording; also the undecided pairs of tails.

    A repeat of a current tail corroborates and never closes a window; it is looked for before any conflict. A
    conflict ends the older fact: valid_until is when the new one began, superseded_at when it was recorded.
    """
    store: list[dict] = []
    undecided: list[tuple] = []
    replayed: set = set()
    for r in pdf.sort_values(["recorded_at", "fact_id"], kind="stable").to_dict("records"):
        if r["fact_id"] in replayed:
            continue
        replayed.add(r["fact_id"])
        r |= {"valid_until": None, "superseded_at": None, "superseded_by": None}
        live = [x for x in store if x["superseded_at"] is None]
        same = next((x for x in live if x["tail"] == r["tail"]), None)
        if same is not None:
            same["support"] += r["support"]
            same["confidence"] = max(same["confidence"], r["confidence"])
            continue
        for x in live:
            known = alternatives is not None and ((x["tail"], r["tail"]) in alternatives or (r["tail"], x["tail"]) in alternatives)
            if policy == "single" or policy == "alternatives" and known:
                x["valid_until"] = r["valid_from"] if not pd.isna(r["valid_from"]) else x["valid_until"]
                x["superseded_at"], x["superseded_by"] = r["recorded_at"], r["fact_id"]
            elif policy == "alternatives" and alternatives is None:
                undecided.append((x["tail"], r["tail"]))
        store.append(r)
    return store, undecided


FOLDED = "fact_id string, head string, relation string, tail string, confidence double, support long, valid_from timestamp, valid_until timestamp, recorded_at timestamp, superseded_at timestamp, superseded_by string"
_COLS = [c.split()[0] for c in FOLDED.split(", ")]


def assert_facts(facts: DataFrame, policy: DataFrame, alternatives: DataFrame | None = None) -> DataFrame:
    """The store after asserting `facts` in order of recorded_at, by each relation's policy (single, alternatives, accumulate).

    `alternatives` (a, b) holds pairs of tails that exclude each other, read once and bounded by the vocabulary of a
    relation's values. The order within a head and relation matters for alternatives, so a group is one task, for which
    this fold is only meant where a head has thousands of facts at most; `islands` and `accumulate`, the closed forms
    of the other policies, spread a busy head over many tasks. Undecided pairs are those of `candidate_pairs`.
    """
    pairs = None if alternatives is None else {(r.a, r.b) for r in alternatives.distinct().toLocalIterator()}
    f = unique_facts(facts).join(policy.select("relation", "policy").distinct(), "relation", "left").select(
        "fact_id", "head", "relation", "tail", "confidence", F.col("support").cast("long").alias("support"), F.col("valid_from").cast("timestamp").alias("valid_from"), F.col("recorded_at").cast("timestamp").alias("recorded_at"), F.coalesce("policy", F.lit("accumulate")).alias("policy")
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(fold_group(pdf, pdf["policy"].iloc[0], pairs)[0], columns=_COLS)
        return out.astype({c: "datetime64[us]" for c in ("valid_from", "valid_until", "recorded_at", "superseded_at")})

    return f.groupBy("head", "relation").applyInPandas(run, FOLDED)


def integrity(facts: DataFrame) -> DataFrame:
    """One row of counts that should stay put under a replay, and of references that lead nowhere."""
    ids = facts.select(F.col("fact_id").alias("superseded_by")).distinct()
    dangling = facts.where("superseded_by is not null").join(ids, "superseded_by", "left_anti").agg(F.count(F.lit(1)).alias("dangling"))
    total = facts.agg(F.countDistinct("fact_id").alias("n_facts"), F.sum("support").cast("long").alias("support"), F.count_if(F.col("superseded_at").isNull()).alias("n_current"))
    return total.join(dangling)  # one row each


def memory_prompt(facts: DataFrame, per_relation: int = 3) -> DataFrame:
    """(head, prompt): a line for each relation with its current values by confidence, `per_relation` at most."""
    v = current(facts).groupBy("head", "relation", "tail_name").agg(F.max("confidence").alias("c"))
    v = v.withColumn("rn", F.row_number().over(W.partitionBy("head", "relation").orderBy(F.col("c").desc(), "tail_name"))).where(F.col("rn") <= per_relation)
    line = v.groupBy("head", "relation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "tail_name"))), lambda x: x["tail_name"]), ", ").alias("vals"))
    return line.groupBy("head").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "relation", "vals"))), "\n").alias("prompt"))


def graph_alternatives(edges: DataFrame, entities: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b): names that exclude each other, both ways, as edges of type `replaces` say."""
    n = entities.groupBy("canon_id").agg(F.min(F.lower("canonical")).alias("name"))
    e = edges.where((F.col("type") == "replaces") & (F.col("confidence") >= least)).select("head", "tail").distinct()
    p = e.join(n.select(F.col("canon_id").alias("head"), F.col("name").alias("a")), "head").join(n.select(F.col("canon_id").alias("tail"), F.col("name").alias("b")), "tail").select("a", "b")
    return p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def explicit_alternatives(groups: DataFrame) -> DataFrame:
    """(name, group_no) of groups (group_no, names): two names exclude each other if they stand in one group; of several the last counts."""
    return groups.select("group_no", F.explode("names").alias("n")).groupBy(F.lower("n").alias("name")).agg(F.max("group_no").alias("group_no"))


def vector_alternatives(vectors: DataFrame, least: float = 0.55, k: int = 50) -> DataFrame:
    """(a, b), both ways: names of vectors (name, kind, vector) of one kind with a cosine of `least` or more, among each one's `k` nearest."""
    from ledgraph.operators.resolution import knn_pairs

    p = knn_pairs(vectors, "name", "vector", "kind", k).where(F.col("cosine") >= least).select("a", "b")
    return p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b")))


def candidate_pairs(facts: DataFrame, policy: DataFrame) -> DataFrame:
    """(head, relation, old, new, same_type): the queue of current values that may exclude each other, undecided.

    Of relations of policy `alternatives` or `single` with several current tails: each tail with the one that began
    before it (by start, then tail), which links all of them without all their pairs.
    """
    f = current(facts).join(policy.where("policy <> 'accumulate'").select("relation").distinct(), "relation", "left_semi")
    t = f.groupBy("head", "relation", "tail").agg(F.min(start()).alias("s"), F.min("tail_type").alias("kind"))
    w = W.partitionBy("head", "relation").orderBy("s", "tail")
    return t.select("head", "relation", F.lag("tail").over(w).alias("old"), F.col("tail").alias("new"), (F.lag("kind").over(w) == F.col("kind")).alias("same_type")).where("old is not null")


def revived(facts: DataFrame) -> DataFrame:
    """(head, relation, tail) that were superseded and are current again."""
    k = ["head", "relation", "tail"]
    return facts.where("superseded_at is not null").select(*k).distinct().join(current(facts).select(*k).distinct(), k, "left_semi")


def by_episode(edges: DataFrame) -> DataFrame:
    """(episode_id, head, type, tail, confidence, support): evidence of edges with `evidence` (array of structs with doc_id and confidence) put back in its episodes."""
    e = edges.select("head", "type", "tail", F.explode("evidence").alias("e"))
    return e.groupBy(F.col("e.doc_id").alias("episode_id"), "head", "type", "tail").agg(F.max("e.confidence").alias("confidence"), F.count(F.lit(1)).alias("support"))


def ingest_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: facts inserted, corroborated and superseded between two states of a store."""
    b = before.select("fact_id", F.col("support").alias("s0"), F.col("superseded_at").alias("e0"))
    j = after.select("fact_id", "support", "superseded_at").join(b, "fact_id", "left")
    return j.agg(
        F.count_if(F.col("s0").isNull()).alias("inserted"), F.count_if(F.col("support") > F.col("s0")).alias("corroborated"), F.count_if(F.col("superseded_at").isNotNull() & F.col("e0").isNull()).alias("superseded")
    )


def open_conflicts(facts: DataFrame, policy: DataFrame) -> DataFrame:
    """(head, relation, n_tails): single-valued keys that hold several current tails."""
    single = policy.where("policy = 'single'").select("relation")
    return current(facts).join(single, "relation", "left_semi").groupBy("head", "relation").agg(F.countDistinct("tail").alias("n_tails")).where("n_tails > 1")


def reified(facts: DataFrame) -> dict[str, DataFrame]:
    """Facts as nodes: fact_nodes, subject_of, has_object, asserted_in; each edge view is a projection."""
    return {
        "fact_nodes": facts.select("fact_id", "relation", "confidence", "support", "valid_from", "valid_until"),
        "subject_of": facts.select(F.col("head").alias("entity"), "fact_id"),
        "has_object": facts.select("fact_id", F.col("tail").alias("entity")),
        "asserted_in": facts.select("fact_id", "episode_id"),
    }


def fold_stream(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """applyInPandasWithState function of the `single` policy: emits a row whenever a key's value changes.

    The state holds the current tail, its start and fact; late facts (a start before the current one) change nothing.
    """
    cur = state.get if state.exists else (None, None, None)
    rows = []
    for pdf in batches:
        for r in pdf.sort_values(["start", "fact_id"]).itertuples():
            at = r.start.value // 1000
            if cur[1] is None or (at >= cur[1] and r.tail != cur[0]):
                rows.append((key[0], key[1], r.tail, r.start, r.fact_id, cur[2]))
                cur = (r.tail, at, r.fact_id)
    if cur[1] is not None:
        state.update(cur)
    yield pd.DataFrame(rows, columns=["head", "relation", "tail", "valid_from", "fact_id", "replaced"])
