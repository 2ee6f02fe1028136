"""Blocking, scoring, clustering and canonicalisation of mentions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgraph.functions.names import ORG_TYPES, PERSON_TYPES, is_acronym_of
from ledgraph.functions.similarity import UDFS
from ledgraph.operators.components import connected_groups
from ledgraph.sources.tables import stage

#: The order in which a pair's block is named.
BLOCKS = ("head", "tail", "last", "init", "exact", "alias", "ann")


def block_keys(forms: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(id, type, block, value) of each normalised form (id, type, norm): the keys it is compared under."""
    n = F.col("norm")
    keys = [F.struct(F.lit("exact").alias("block"), n["key"].alias("value")), F.struct(F.lit("head").alias("block"), n["tokens"][0].alias("value")), F.struct(F.lit("tail").alias("block"), F.element_at(n["tokens"], F.lit(-1)).alias("value"))]
    person = F.col("type").isin(*PERSON_TYPES)
    keys.append(F.struct(F.lit("last").alias("block"), F.when(person & (n["last"] != ""), F.lower(n["last"])).alias("value")))
    first_letters = F.array_join(F.transform(n["tokens"], lambda t: F.substring(t, 1, 1)), "")
    keys.append(F.struct(F.lit("init").alias("block"), F.when(n["is_acronym"], F.lower(n["display"])).when(F.size(n["tokens"]) > 1, first_letters).alias("value")))
    out = forms.where("norm.key <> '' and size(norm.tokens) > 0").select("id", "type", F.explode(F.array(*keys)).alias("k")).select("id", "type", "k.block", "k.value")
    if aliases is not None:
        both = aliases.select(F.col("long_form").alias("value"), F.col("long_form").alias("to")).unionByName(aliases.select(F.col("short_form").alias("value"), F.col("long_form").alias("to"))).distinct()
        exact = out.where("block = 'exact'")
        out = out.unionByName(exact.join(both, "value").select("id", "type", F.lit("alias").alias("block"), F.col("to").alias("value")))
    return out.where("value is not null and value <> ''").distinct()


def left_out(keys: DataFrame, most: int = 60, spare: str = "exact") -> DataFrame:
    """(type, block, value, n): the keys that `candidate_pairs` leaves out as too common."""
    return keys.where(F.col("block") != spare).groupBy("type", "block", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)


def with_neighbours(pairs: DataFrame, vectors: DataFrame, k: int = 12) -> tuple[DataFrame, DataFrame]:
    """(pairs, embed): the pairs with those of each vector's `k` nearest of its type under block `ann`, and the cosines of all of them.

    `vectors` has (id, type, vector). A pair keeps the block that names it first; `embed` (a, b, embed) goes to
    `score_pairs`, negative cosines as 0.
    """
    near = knn_pairs(vectors, "id", "vector", "type", k).select("a", "b", F.col("block").alias("type"), F.lit("ann").alias("block"))
    rank = F.expr("array_position(array(" + ",".join(f"'{b}'" for b in BLOCKS) + "), block)")
    both = pairs.select("a", "b", "type", "block").unionByName(near).groupBy("a", "b", "type").agg(F.min_by("block", rank).alias("block"))
    v = vectors.select("id", "vector")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    j = both.join(v.select(F.col("id").alias("a"), F.col("vector").alias("x")), "a").join(v.select(F.col("id").alias("b"), F.col("vector").alias("y")), "b")
    cos = F.try_divide(dot("x", "y"), F.sqrt(dot("x", "x") * dot("y", "y")))
    return both, j.select("a", "b", F.greatest(F.lit(0.0), F.coalesce(cos, F.lit(0.0))).alias("embed"))


def candidate_pairs(keys: DataFrame, most: int = 60, spare: str = "exact") -> DataFrame:
    """(a, b, type, block) with a < b: forms that share a key of their type. Null types match none.

    Keys other than `spare` with more than `most` forms propose no pairs: the guard of the blocking rules. A `spare`
    key of any size is a chain, each form with the next, which links the whole bucket without all its pairs.
    """
    by = W.partitionBy("type", "block", "value")
    sized = keys.withColumn("n", F.count(F.lit(1)).over(by))
    few = sized.where((F.col("n") <= most) & (F.col("n") > 1) & (F.col("block") != spare)).drop("n")
    r = few.select(F.col("id").alias("b"), "type", "block", "value")
    pairs = few.withColumnRenamed("id", "a").join(r, ["type", "block", "value"]).where("a < b").select("a", "b", "type", "block")
    chain = keys.where(F.col("block") == spare).withColumn("b", F.lead("id").over(by.orderBy("id"))).where("b is not null").select(F.col("id").alias("a"), "b", "type", "block")
    rank = F.expr("array_position(array(" + ",".join(f"'{b}'" for b in BLOCKS) + "), block)")
    return pairs.unionByName(chain).groupBy("a", "b", "type").agg(F.min_by("block", rank).alias("block"))


def _cells(rows: DataFrame, key: str, per: int) -> DataFrame:
    """Rows (id, ...) with their `key` as value, those of a value in `s` groups `g` of about `per` rows by the hash of the id."""
    rows = rows.withColumn("value", F.col(key)).where("value is not null")
    large = rows.groupBy("value").agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias("s")).where("s > 1")
    return rows.join(large, "value", "left").withColumn("s", F.coalesce("s", F.lit(1))).withColumn("g", F.expr("cast(pmod(xxhash64(id), s) as int)"))


def _rule_pairs(rows: DataFrame, rule: int, per: int) -> DataFrame:
    """Pairs (a, b) of rows (id, k0, k1, ...), one for each id, that agree on the key `rule` and on none before it."""
    before = [f"k{i}" for i in range(rule)]
    groups = stage(_cells(rows, f"k{rule}", per).groupBy("value", "s", "g").agg(F.collect_list(F.struct("id", *before) if before else F.col("id")).alias("ids")), "groups")
    pairs = groups.groupBy("value").agg(F.sum(F.size("ids").cast("double")).alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0] or 0
    tasks = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs / 1e6)), min(4000, int(pairs / 5e7)))  # by the pairs, as the rows say little about them
    l = groups.select("value", F.col("ids").alias("xs"), F.col("g").alias("i"), F.explode(F.expr("sequence(g, s - 1)")).alias("j")).repartition(tasks, "value", "i", "j")
    r = groups.select("value", F.col("ids").alias("ys"), F.col("g").alias("j"), F.explode(F.expr("sequence(0, g)")).alias("i")).repartition(tasks, "value", "i", "j")
    met = l.join(r, ["value", "i", "j"]).select("i", "j", "ys", F.explode("xs").alias("x")).select("i", "j", "x", F.explode("ys").alias("y"))
    x, y = (F.col("x.id"), F.col("y.id")) if before else (F.col("x"), F.col("y"))
    met = met.where((F.col("i") < F.col("j")) | (x < y))
    for k in before:
        met = met.where(~F.coalesce(F.col(f"x.{k}") == F.col(f"y.{k}"), F.lit(False)))
    return met.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))


def or_blocking(df: DataFrame, id_col: str, keys: list[Column], per: int = 1000) -> DataFrame:
    """Pairs (a, b), a < b, that agree on any of `keys`: a union of equi-joins, without a limit to a key's rows.

    A key of more than `per` rows is split into groups of about `per` by the hash of the id, and each two of its
    groups, and each with itself, meet in a cell of their own, so that no task holds all pairs of a large key. A group
    is one value, so rows aren't moved one by one for each cell. A pair is given under the first key it agrees on, so
    pairs aren't compared with each other, but for those of ids that have several different rows.
    """
    rows = df.select(F.col(id_col).alias("id"), *[k.cast("string").alias(f"k{i}") for i, k in enumerate(keys)]).where("id is not null").distinct()
    rows = stage(rows.withColumn("many", F.count(F.lit(1)).over(W.partitionBy("id")) > 1), "rows")
    out = None
    for i in range(len(keys)):
        pairs = _rule_pairs(rows.where("not many"), i, per)
        out = pairs if out is None else out.unionByName(pairs)
    if rows.where("many").isEmpty():
        return out
    rest = None
    for i in range(len(keys)):
        c = _cells(rows, f"k{i}", per)
        l = c.where("many").select("value", F.col("id").alias("x"), F.col("g").alias("i"), F.explode(F.expr("sequence(0, s - 1)")).alias("j"))
        r = c.select("value", F.col("id").alias("y"), F.col("many").alias("many_y"), F.col("g").alias("j"), F.explode(F.expr("sequence(0, s - 1)")).alias("i"))
        pairs = l.join(r, ["value", "i", "j"]).where("x < y or not many_y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        rest = pairs if rest is None else rest.unionByName(pairs)
    return out.unionByName(rest.distinct())


def score_pairs(pairs: DataFrame, forms: DataFrame, embed: DataFrame | None = None, w_fuzz: float = 0.45, w_embed: float = 0.40, w_context: float = 0.15, min_entropy: float = 2.5, penalty: float = 0.25) -> DataFrame:
    """(a, b, type, block, fuzz, embed, context, rule, score, reason) of candidate pairs over forms (id, norm, entropy, context).

    Exact keys, declared aliases (block `alias`) and acronyms settle a pair; only the rest reaches the similarity
    UDFs, each two keys once however many forms have them. A missing embedding counts 0 and its weight isn't given to
    the others.
    """
    l = forms.select(F.col("id").alias("a"), F.col("norm").alias("x"), F.col("entropy").alias("ex"), F.coalesce("context", F.lit("")).alias("cx"))
    r = forms.select(F.col("id").alias("b"), F.col("norm").alias("y"), F.col("entropy").alias("ey"), F.coalesce("context", F.lit("")).alias("cy"))
    p = pairs.join(l, "a").join(r, "b")
    if embed is not None:
        p = p.join(embed.select("a", "b", "embed"), ["a", "b"], "left")
    else:
        p = p.withColumn("embed", F.lit(0.0))
    p = p.withColumn("embed", F.coalesce("embed", F.lit(0.0)))
    acro = (F.col("x.is_acronym") != F.col("y.is_acronym")) & F.when(F.col("x.is_acronym"), is_acronym_of(F.col("x.display"), F.col("y.tokens"))).otherwise(is_acronym_of(F.col("y.display"), F.col("x.tokens")))
    settled = F.when(F.col("x.key") == F.col("y.key"), F.struct(F.lit(1.0).alias("s"), F.lit("exact normalised match").alias("why"))).when(
        F.col("block") == "alias", F.struct(F.lit(1.0).alias("s"), F.lit("alias declared in corpus text").alias("why"))
    ).when(acro, F.struct(F.lit(0.97).alias("s"), F.lit("acronym expansion").alias("why")))
    p = stage(p.withColumn("set", settled), "pairs")
    done = p.where("set is not null").select("a", "b", "type", "block", F.col("set.s").alias("fuzz"), "embed", F.lit(0.0).alias("context"), F.col("set.s").alias("rule"), F.col("set.s").alias("score"), F.col("set.why").alias("reason"))
    open_ = p.where("set is null")
    keys = open_.select(F.least("x.key", "y.key").alias("k"), F.greatest("x.key", "y.key").alias("l")).distinct()
    keys = keys.withColumn("fuzz", UDFS["best"]("k", "l"))
    open_ = open_.withColumn("k", F.least("x.key", "y.key")).withColumn("l", F.greatest("x.key", "y.key")).join(keys, ["k", "l"])
    ctx = F.when((F.col("cx") == "") | (F.col("cy") == ""), 0.0).otherwise(UDFS["token_set"]("cx", "cy"))
    open_ = open_.withColumn("context", ctx)
    nx, ny = F.size("x.tokens"), F.size("y.tokens")
    same_last = F.lower("x.last") == F.lower("y.last")
    same_first = F.lower("x.first") == F.lower("y.first")
    person = F.when(same_last & ((F.least(nx, ny) == 1) | same_first), 0.9).when(same_first & (F.least(nx, ny) == 1), 0.5).otherwise(0.0)
    short, long_ = F.when(nx <= ny, F.col("x.tokens")).otherwise(F.col("y.tokens")), F.when(nx <= ny, F.col("y.tokens")).otherwise(F.col("x.tokens"))
    prefix = (F.size(short) > 0) & (F.slice(long_, 1, F.size(short)) == short)
    org = F.when(prefix, F.when(F.greatest("embed", "context") >= 0.60, 0.92).otherwise(0.88)).otherwise(0.0)
    rule = F.when(F.col("type").isin(*PERSON_TYPES), person).when(F.col("type").isin(*ORG_TYPES), org).otherwise(0.0)
    open_ = open_.withColumn("rule", rule)
    blended = F.greatest(w_fuzz * F.col("fuzz") + w_embed * F.col("embed") + w_context * F.col("context"), F.col("rule"))
    low = (F.least("ex", "ey") < min_entropy) & (F.col("rule") < 0.9)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), blended - F.when(low, penalty).otherwise(0.0)))
    reason = F.when(F.col("rule") >= 0.9, F.when(F.col("type").isin(*PERSON_TYPES), "same surname").otherwise("name prefix, shared context")).when(F.col("rule") > 0, "partial name rule").when(low, "low entropy").otherwise("blended")
    rest = open_.select("a", "b", "type", "block", "fuzz", "embed", "context", "rule", score.alias("score"), reason.alias("reason"))
    return done.unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of edges (a, b); the component is its smallest id. Loops and null ends are left out."""
    return connected_groups(edges.select(*[F.col(c).cast("string") for c in edges.columns[:2]])).select(F.col("member").alias("id"), F.col("group_id").alias("component"))


def canonical_entities(members: DataFrame) -> DataFrame:
    """One row for each component of members (component, id, type, text, confidence, doc_id, suffix).

    The canonical surface is the best by (has a suffix, length, confidence), ties to the smaller text; the type is
    the most frequent, ties to the smaller. The other surfaces are counted here and are the rows of `entity_aliases`,
    so that a component of any size is never one value. Null texts name nothing.
    """
    t = members.groupBy("component", "type").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.min_by("type", F.struct(-F.col("n"), F.col("type"))).alias("type"))
    rank = F.struct(-(F.coalesce("suffix", F.lit("")) != "").cast("int"), -F.length("text"), -F.coalesce("confidence", F.lit(0.0)), F.col("text"))
    surf = members.where("text is not null").groupBy("component").agg(F.min_by("text", rank).alias("canonical"), (F.countDistinct("text") - 1).alias("n_aliases"))
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("n_mentions"), F.countDistinct("doc_id").alias("n_docs"))
    return surf.join(t, "component").join(size, "component").select("component", "type", "canonical", "n_aliases", "n_mentions", "n_docs")


def entity_aliases(members: DataFrame, entities: DataFrame) -> DataFrame:
    """(component, alias): the distinct surfaces of each component but its canonical one."""
    return members.where("text is not null").select("component", F.col("text").alias("alias")).distinct().join(entities.select("component", F.col("canonical").alias("alias")), ["component", "alias"], "left_anti")


def review_band(scored: DataFrame, low: float, high: float) -> DataFrame:
    return scored.where((F.col("score") >= low) & (F.col("score") < high))


def knn_pairs(vectors: DataFrame, id_col: str, vec: str, block: str, k: int = 12, tile: int = 2000) -> DataFrame:
    """(a, b, block, cosine): the union of each vector's k nearest of its block, a < b. Exact; null and zero vectors are left out.

    A block is cut into tiles of about `tile` vectors by the hash of the id; each two of its tiles meet in a task of
    their own, which multiplies two matrices and keeps the k best of each row. So no task holds a whole block.
    """
    ids = dict(vectors.dtypes)[id_col]
    v = vectors.where(F.col(vec).isNotNull() & F.col(block).isNotNull()).select(F.col(id_col).alias("id"), F.col(block).alias("block"), F.col(vec).cast("array<double>").alias("x"))
    parts = v.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("s"))
    v = v.join(parts, "block").withColumn("g", F.expr("cast(pmod(xxhash64(id), s) as int)"))
    l = v.withColumn("j", F.explode(F.expr("sequence(0, s - 1)"))).select("block", F.col("g").alias("i"), "j", "id", "x")
    r = v.select("block", F.explode(F.expr("sequence(0, s - 1)")).alias("i"), F.col("g").alias("j"), "id", "x")
    l, r = (df.select(*[F.col(c).alias(f"{side}_{c}" if c in ("block", "i", "j") else c) for c in df.columns]) for side, df in (("l", l), ("r", r)))

    def matrix(t):
        t = t.sort_by("id")
        m = np.array(t["x"].to_pylist(), dtype=np.float64).reshape(t.num_rows, -1)
        n = np.linalg.norm(m, axis=1)
        keep = n > 0
        return t["id"].filter(pa.array(keep)).combine_chunks(), m[keep] / n[keep, None]

    def run(key, left, right):
        (a, x), (b, y) = matrix(left), matrix(right)
        rows, cols, cos = [], [], []
        if len(a) and len(b):
            c = x @ y.T
            other = {i: n for n, i in enumerate(b.to_pylist())}
            for n, i in enumerate(a.to_pylist()):
                if i in other:
                    c[n, other[i]] = -np.inf
                row = c[n]
                last = np.partition(row, -k)[-k] if len(row) > k else -np.inf
                got = np.flatnonzero((row >= last) & (row > -np.inf))  # all that tie with the last one
                rows += [n] * len(got)
                cols += got.tolist()
                cos += row[got].tolist()
        blk = pa.array([key[0].as_py()] * len(rows), key[0].type)
        return pa.table({"a": a.take(pa.array(rows, pa.int64())), "b": b.take(pa.array(cols, pa.int64())), "block": blk, "cosine": pa.array(cos, pa.float64())})

    j = l.groupBy("l_block", "l_i", "l_j").cogroup(r.groupBy("r_block", "r_i", "r_j")).applyInArrow(run, f"a {ids}, b {ids}, block {dict(vectors.dtypes)[block]}, cosine double")
    top = j.withColumn("rn", F.row_number().over(W.partitionBy("a").orderBy(F.col("cosine").desc(), F.col("b")))).where(F.col("rn") <= k)
    return top.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "block", "cosine").groupBy("a", "b", "block").agg(F.max("cosine").alias("cosine"))


def fellegi_sunter(pairs: DataFrame, levels: dict[str, list[tuple[Column, float, float]]], prior: float = 0.001) -> DataFrame:
    """`pairs` with match_weight and match_probability: for each field the first level that holds gives log2(m/u)."""
    total = F.lit(0.0)
    for rules in levels.values():
        w = F.lit(0.0)
        for cond, m, u in reversed(rules):
            w = F.when(cond, F.log2(F.lit(m / u))).otherwise(w)
        total = total + w
    odds = F.log2(F.lit(prior / (1 - prior))) + total
    return pairs.withColumn("match_weight", total).withColumn("match_probability", F.pow(F.lit(2.0), odds) / (1 + F.pow(F.lit(2.0), odds)))


def estimate_mu(pairs: DataFrame, fields: list[str], rounds: int = 30, prior: float = 0.1, still: float = 1e-3) -> DataFrame:
    """(field, level, m, u) by expectation-maximisation over pairs whose columns `fields` hold agreement levels.

    It goes on until no m or u moves by `still`; after `rounds` it raises instead of giving unfinished values.
    """
    cells = pairs.groupBy(*fields).agg(F.count(F.lit(1)).alias("n"))
    cells = stage(cells.withColumn("cell", F.xxhash64(*fields)), "cells")
    long_ = cells.select("cell", "n", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("int").alias("level")) for f in fields])).alias("x")).select("cell", "n", "x.field", "x.level")
    top = long_.groupBy("field").agg(F.max("level").alias("top"))
    mu = long_.select("field", "level").distinct().join(top, "field").select("field", "level", F.when(F.col("level") == F.col("top"), 0.8).otherwise(0.2).alias("m"), F.when(F.col("level") == F.col("top"), 0.2).otherwise(0.8).alias("u"))
    for _ in range(rounds):
        post = long_.join(mu, ["field", "level"]).groupBy("cell", "n").agg(F.sum(F.log(F.col("m") / F.col("u"))).alias("w"))
        post = post.select("cell", (1 / (1 + (1 - prior) / prior * F.exp(-F.col("w")))).alias("p"))
        e = long_.join(post, "cell")
        num = e.groupBy("field", "level").agg((F.sum(F.col("n") * F.col("p")) + 0.5).alias("a"), (F.sum(F.col("n") * (1 - F.col("p"))) + 0.5).alias("b"))
        all_ = num.groupBy("field").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
        now = stage(num.join(all_, "field").select("field", "level", (F.col("a") / F.col("ta")).alias("m"), (F.col("b") / F.col("tb")).alias("u")), "mu")
        moved = now.join(mu.select("field", "level", F.col("m").alias("m0"), F.col("u").alias("u0")), ["field", "level"]).agg(F.max(F.greatest(F.abs(F.col("m") - F.col("m0")), F.abs(F.col("u") - F.col("u0"))))).first()[0]
        mu = now
        if moved is None or moved < still:
            return mu
    raise RuntimeError(f"no standstill after {rounds} rounds")
