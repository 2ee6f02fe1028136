"""Scores of clusterings, triples, rankings and blocking."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bcubed(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """precision, recall, f1, n over the ids both have, of pred (id, cluster) and gold (id, cluster).

    Ids are counted by (pred, gold) cell first, so no cluster is gathered.
    """
    j = pred.select("id", F.col("cluster").alias("p")).distinct().join(gold.select("id", F.col("cluster").alias("g")).distinct(), "id")
    cell = j.groupBy("p", "g").agg(F.count(F.lit(1)).alias("n"))
    full = cell.join(cell.groupBy("p").agg(F.sum("n").alias("np")), "p").join(cell.groupBy("g").agg(F.sum("n").alias("ng")), "g")
    s = full.agg((F.sum(F.col("n") * F.col("n") / F.col("np")) / F.sum("n")).alias("precision"), (F.sum(F.col("n") * F.col("n") / F.col("ng")) / F.sum("n")).alias("recall"), F.sum("n").alias("n"))
    return s.select("precision", "recall", (2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).alias("f1"), "n")


def blocking_report(candidates: DataFrame, gold: DataFrame, n_items: DataFrame) -> DataFrame:
    """Pair completeness and reduction ratio of candidates (a, b), a < b, against gold (id, cluster).

    Gold pairs are counted by cluster size, not listed; `n_items` holds the column n.
    """
    g = gold.select("id", "cluster").distinct()
    gold_pairs = g.groupBy("cluster").count().agg(F.sum(F.expr("count * (count - 1) div 2")).alias("gold_pairs"))
    c = candidates.select("a", "b").distinct()
    hit = c.join(g.select(F.col("id").alias("a"), F.col("cluster").alias("ca")), "a").join(g.select(F.col("id").alias("b"), F.col("cluster").alias("cb")), "b").agg(F.count_if(F.col("ca") == F.col("cb")).alias("found"))
    n = c.agg(F.count(F.lit(1)).alias("candidates"))
    all_ = n_items.select(F.expr("n * (n - 1) div 2").alias("all_pairs"))
    one = gold_pairs.join(hit).join(n).join(all_)  # one row each
    return one.select("candidates", "gold_pairs", "found", (F.col("found") / F.col("gold_pairs")).alias("completeness"), (1 - F.col("candidates") / F.col("all_pairs")).alias("reduction"))


def key_blocking_report(df: DataFrame, id_col: str, keys: list[str], cluster: str) -> DataFrame:
    """The `blocking_report` of the pairs of rows that agree on any of `keys`, from group sizes only; no pair is listed.

    Pairs that agree on any key are counted by inclusion and exclusion over the sets of keys. That holds if each id
    has one row; otherwise it raises.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(cluster).alias("cluster"), *keys).distinct()
    if rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        raise ValueError("an id has several different rows")
    within = lambda by: rows.na.drop(subset=by).groupBy(*by).count().agg(F.coalesce(F.sum(F.expr("count * (count - 1) div 2")), F.lit(0)).alias("n"))
    parts = []
    for k in range(1, len(keys) + 1):
        for some in combinations(keys, k):
            for what, by in (("candidates", [*some]), ("found", [*some, "cluster"])):
                parts.append(within(by).select(F.lit(what).alias("what"), (F.col("n") * (-1) ** (k + 1)).alias("n")))
    sums = reduce(DataFrame.unionByName, parts).agg(*[F.sum(F.when(F.col("what") == w, F.col("n"))).alias(w) for w in ("candidates", "found")])
    gold_pairs = rows.groupBy("cluster").count().agg(F.sum(F.expr("count * (count - 1) div 2")).alias("gold_pairs"))
    all_ = rows.agg(F.count(F.lit(1)).alias("n")).select(F.expr("n * (n - 1) div 2").alias("all_pairs"))
    one = sums.join(gold_pairs).join(all_)  # one row each
    return one.select("candidates", "gold_pairs", "found", (F.col("found") / F.col("gold_pairs")).alias("completeness"), (1 - F.col("candidates") / F.col("all_pairs")).alias("reduction"))


def triple_score(pred: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one exact matching of rows equal in `keys`: matched, spurious, missed, precision, recall, f1."""
    p, g = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("p")), gold.groupBy(*keys).agg(F.count(F.lit(1)).alias("g"))
    j = p.join(g, keys, "full").select(F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("g", F.lit(0)).alias("g"))
    s = j.agg(F.sum(F.least("p", "g")).alias("matched"), F.sum(F.greatest(F.col("p") - F.col("g"), F.lit(0))).alias("spurious"), F.sum(F.greatest(F.col("g") - F.col("p"), F.lit(0))).alias("missed"))
    pr, rc = F.col("matched") / (F.col("matched") + F.col("spurious")), F.col("matched") / (F.col("matched") + F.col("missed"))
    return s.withColumn("precision", pr).withColumn("recall", rc).withColumn("f1", 2 * pr * rc / (pr + rc))


def undirected(triples: DataFrame) -> DataFrame:
    """`triples` (head, relation, tail) with their ends in order, so that scoring them counts a turned one as a match."""
    return triples.withColumns({"head": F.least("head", "tail"), "tail": F.greatest("head", "tail")})


def scores_of(counts: DataFrame) -> DataFrame:
    """matched, spurious, missed with precision, recall and f1."""
    pr, rc = F.try_divide("matched", F.col("matched") + F.col("spurious")), F.try_divide("matched", F.col("matched") + F.col("missed"))
    return counts.withColumn("precision", pr).withColumn("recall", rc).withColumn("f1", F.try_divide(2 * pr * rc, pr + rc))


FUZZY = "relation string, matched long, loosened long, spurious long, missed long"


def fuzzy_triple_score(pred: DataFrame, gold: DataFrame, least: float = 0.85, directed: bool = True) -> DataFrame:
    """matched, loosened, spurious, missed, precision, recall, f1 of one-to-one matching, exact first, then by likeness.

    Rows are (seq, head, relation, tail); predictions are taken in order of seq. What matches exactly is counted by
    joins; only predictions and gold left over meet in a task for each relation, of which an ontology has a bounded
    number: a gold list is written by hand.
    """
    from ledgraph.functions.similarity import token_set

    def run(key, p: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        left = [(r.head, r.tail) for r in g.sort_values("seq").itertuples()]
        exact = loose = spurious = 0
        for r in p.sort_values("seq").itertuples():
            ends = [(r.head, r.tail)] if directed else [(r.head, r.tail), (r.tail, r.head)]
            hit = next((i for i, x in enumerate(left) if x in ends), None)
            if hit is None:
                best = [(min(token_set(r.head, h), token_set(r.tail, t)), -i) for i, (h, t) in enumerate(left)]
                top = max((b for b in best if b[0] >= least), default=None)
                hit = None if top is None else -top[1]
                loose += hit is not None
            if hit is None:
                spurious += 1
            else:
                exact += 1
                left.pop(hit)
        return pd.DataFrame([(key[0], exact, loose, spurious, len(left))], columns=["relation", "matched", "loosened", "spurious", "missed"])

    cols = ["seq", "head", "relation", "tail"]
    got = pred.select(*cols).groupBy("relation").cogroup(gold.select(*cols).groupBy("relation")).applyInPandas(run, FUZZY)
    return scores_of(got.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("matched", "loosened", "spurious", "missed")]))


def entity_score(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Scores of distinct names (name) found against those that there are."""
    p, g = pred.select("name").distinct().withColumn("p", F.lit(1)), gold.select("name").distinct().withColumn("g", F.lit(1))
    j = p.join(g, "name", "full")
    return scores_of(j.agg(F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("matched"), F.count_if(F.col("g").isNull()).alias("spurious"), F.count_if(F.col("p").isNull()).alias("missed")))


def error_attribution(gold_pairs: DataFrame, clusters: DataFrame, proposed: DataFrame, judged: DataFrame) -> DataFrame:
    """(proposed, judged, n): pairs (a, b), a < b, that are the same thing but in different clusters (id, cluster), by how far they came."""
    c = clusters.select("id", "cluster")
    j = gold_pairs.join(c.select(F.col("id").alias("a"), F.col("cluster").alias("ca")), "a").join(c.select(F.col("id").alias("b"), F.col("cluster").alias("cb")), "b").where("ca <> cb").select("a", "b")
    flag = lambda df, n: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn(n, F.lit(True))
    j = j.join(flag(proposed, "proposed"), ["a", "b"], "left").join(flag(judged, "judged"), ["a", "b"], "left").fillna(False, ["proposed", "judged"])
    return j.groupBy("proposed", "judged").agg(F.count(F.lit(1)).alias("n"))


def split_groups(groups: DataFrame, clusters: DataFrame) -> DataFrame:
    """(group_id, n_clusters): groups of surfaces (group_id, surface) that stand in more than one cluster (surface, cluster)."""
    j = groups.select("group_id", "surface").distinct().join(clusters.select("surface", "cluster").distinct(), "surface")
    return j.groupBy("group_id").agg(F.countDistinct("cluster").alias("n_clusters")).where("n_clusters > 1")


def duplication_report(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row: nodes, distinct_names, nodes_in_alias_table, real_entities_covered, split_entities, surplus_nodes.

    `names` (name) are stored nodes, `aliases` (surface, canonical) says which names are one thing; both are compared
    whatever the case.
    """
    a = aliases.groupBy(F.lower(F.trim("surface")).alias("k")).agg(F.max("canonical").alias("canonical"))
    d = names.select("name").distinct().withColumn("k", F.lower(F.trim("name"))).join(a, "k").groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))
    one = names.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("name").alias("distinct_names"))
    two = d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes_in_alias_table"), F.count(F.lit(1)).alias("real_entities_covered"), F.count_if(F.col("n") > 1).alias("split_entities"))
    return one.join(two).withColumn("surplus_nodes", F.col("nodes_in_alias_table") - F.col("real_entities_covered"))  # one row each


def scoreboard(triples: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each `system` of triples (system, *keys): n, matched, spurious, missed, precision, recall, f1 against one gold list, by exact one-to-one matching."""
    p = triples.groupBy("system", *keys).agg(F.count(F.lit(1)).alias("p"))
    g = gold.groupBy(*keys).agg(F.count(F.lit(1)).alias("g"))
    total = gold.agg(F.count(F.lit(1)).alias("total"))
    m = p.join(g, keys, "left").groupBy("system").agg(F.sum("p").alias("n"), F.sum(F.least("p", F.coalesce("g", F.lit(0)))).alias("matched"))
    m = m.join(total).select("system", "n", "matched", (F.col("n") - F.col("matched")).alias("spurious"), (F.col("total") - F.col("matched")).alias("missed"))  # total is one row
    return scores_of(m)


def relation_histogram(triples: DataFrame, systems: list[str]) -> DataFrame:
    """(relation, a column for each system): predictions side by side."""
    return triples.groupBy("relation").pivot("system", systems).agg(F.count(F.lit(1))).fillna(0)


def comparison(scores: DataFrame) -> DataFrame:
    """Score rows of systems, the best f1 first, rounded to four places."""
    return scores.select("system", "n", "matched", "spurious", "missed", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")]).orderBy(F.col("f1").desc_nulls_last(), "system")


def clusters_at(pairs: DataFrame, cuts: list[float]) -> DataFrame:
    """(threshold, clusters, clustered, largest): scored pairs (a, b, score) grouped again at each cut; the cuts are a short list."""
    from ledgraph.operators.resolution import components

    out = None
    for cut in cuts:
        c = components(pairs.where(F.col("score") >= cut).select("a", "b")).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        row = c.agg(F.lit(cut).alias("threshold"), F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("clustered"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
        out = row if out is None else out.unionByName(row)
    return out


def auc(scored: DataFrame) -> DataFrame:
    """Mann-Whitney AUC of (score double, positive boolean), tied ranks averaged; nulls are left out.

    Ranks are summed over distinct scores in order, of which there may be many: they are cut into buckets of equal
    width first, and the running counts of the buckets are added to those inside.
    """
    v = scored.where("score is not null and positive is not null").groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    v = v.withColumn("bucket", F.floor(F.col("score") * 1000))
    b = v.groupBy("bucket").agg(F.sum("n").alias("bn"))
    before = F.coalesce(F.sum("bn").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    b = b.select("bucket", before.alias("below"))
    inside = F.coalesce(F.sum("n").over(W.partitionBy("bucket").orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    w = v.withColumn("inside", inside).join(b, "bucket")
    s = w.agg(F.sum(F.col("p") * (F.col("below") + F.col("inside") + F.col("n") / 2)).alias("wins"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    return s.select("positives", "negatives", (F.col("wins") / (F.col("positives") * F.col("negatives"))).alias("auc"))


def fit_cuts(scored: DataFrame, keep: float = 0.95) -> DataFrame:
    """reject: the greatest score of a negative; accept: the score that a share `keep` of the positives reach."""
    return scored.where("score is not null").agg(F.max(F.when(~F.col("positive"), F.col("score"))).alias("max_negative"), F.expr(f"percentile_disc({1 - keep}) within group (order by if(positive, score, null))").alias("accept_cut"), F.max(F.when(F.col("positive"), F.col("score"))).alias("max_positive"))


def cluster_audit(members: DataFrame, limit: int) -> DataFrame:
    """Clusters of more than `limit` members: size and distinct forms of (component, id, text)."""
    return members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("n_forms")).where(F.col("n") > limit)


def separation(scored: DataFrame) -> DataFrame:
    s = scored.groupBy("positive").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return s.agg(F.max(F.when(F.col("positive"), F.col("lo"))).alias("pos_min"), F.max(F.when(~F.col("positive"), F.col("hi"))).alias("neg_max")).withColumn("overlap", F.col("neg_max") >= F.col("pos_min"))


def split_pairs(must_split: DataFrame, clusters: DataFrame) -> DataFrame:
    """(a, b) of surfaces that must not share a cluster but do; clusters has (surface, cluster)."""
    c = clusters.select("surface", "cluster").distinct()
    j = must_split.join(c.select(F.col("surface").alias("a"), "cluster"), "a").join(c.select(F.col("surface").alias("b"), F.col("cluster").alias("cb")), "b")
    return j.where("cluster = cb").select("a", "b").distinct()
