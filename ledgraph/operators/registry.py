"""A registry of entities that grows episode by episode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgraph.functions.names import normalized, slug
from ledgraph.operators.resolution import block_keys, candidate_pairs, canonical_entities, components, score_pairs
from ledgraph.sources.tables import stage

#: What marks the id of a registered entity that stands in as a mention.
ANCHOR = "__registry__:"
#: The mentions of a key that `candidate_pairs` pairs, at most.
MOST = 60
#: The words of a name whose parts are looked up one by one, at most; their number doubles with each word.
LONG = 8
REGISTRY = "canon_id string, type string, canonical string, aliases array<string>, first_seen string, last_seen string"


def anchors(registry: DataFrame, names: int = 6) -> DataFrame:
    """Registered entities as forms (id, type, text, context): the context is their first `names` aliases."""
    also = F.slice(F.array_sort(F.coalesce("aliases", F.array().cast("array<string>"))), 1, names)
    return registry.where("canonical is not null").select(F.concat(F.lit(ANCHOR), "canon_id").alias("id"), "type", F.col("canonical").alias("text"), F.array_join(also, ", ").alias("context"))


def _scored(registry: DataFrame, mentions: DataFrame, threshold: float) -> DataFrame:
    """Accepted pairs of the new mentions with each other and with the registered entities that share a blocking key with one of them."""
    new = normalized(mentions.where("text is not null and type is not null").groupBy(F.col("mention_id").alias("id"), "type", "text").agg(F.min("context").alias("context")))
    new = stage(new.select("id", "type", "text", "norm", "entropy", "context"), "forms")
    keys = block_keys(new)
    known = normalized(anchors(registry))
    met = block_keys(known).join(keys.select("type", "block", "value").distinct(), ["type", "block", "value"], "left_semi").select("id").distinct()
    forms = stage(new.unionByName(known.join(met, "id", "left_semi").select(*new.columns)), "forms")
    pairs = candidate_pairs(block_keys(forms))
    return score_pairs(pairs, forms).where(F.col("score") >= threshold)


def add_episode(registry: DataFrame, mentions: DataFrame, episode: str, threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(registry, map): the registry after the mentions (mention_id, type, text, context, confidence, doc_id) of one episode, and (mention_id, canon_id).

    Mentions and the known entities that share a key with them are resolved together. A group that holds known
    entities goes to the one seen first, then the smaller id; others of the group are merged into it with their
    aliases and dates. A group without one makes an entity named by its best surface; an id that is taken gets `-2`
    for each time it is. Null texts and types are left out. Only entities the episode mentions get its id as last_seen.
    """
    seen = mentions.where("mention_id is not null and text is not null and type is not null").dropDuplicates(["mention_id"])
    links = components(_scored(registry, seen, threshold).select("a", "b"))
    every = seen.select(F.col("mention_id").alias("id")).join(links, "id", "full").select("id", F.coalesce("component", "id").alias("component"))
    every = stage(every, "members")
    known = every.where(F.col("id").startswith(ANCHOR)).select("component", F.substr("id", F.lit(len(ANCHOR) + 1)).alias("canon_id"))
    known = known.join(registry.select("canon_id", "first_seen"), "canon_id")
    target = known.groupBy("component").agg(F.min_by("canon_id", F.struct(F.coalesce("first_seen", F.lit("")), F.col("canon_id"))).alias("target"))
    fresh = every.where(~F.col("id").startswith(ANCHOR)).join(seen.select(F.col("mention_id").alias("id"), "type", "text", "confidence", "doc_id"), "id").withColumn("suffix", F.lit(""))
    made = canonical_entities(fresh.join(target, "component", "left_anti")).select("component", "type", "canonical", F.concat_ws(":", "type", slug(F.col("canonical"))).alias("base"))
    taken = registry.select(F.regexp_replace("canon_id", "(-2)+$", "").alias("base")).groupBy("base").agg(F.count(F.lit(1)).alias("had"))
    turn = F.row_number().over(W.partitionBy("base").orderBy("component")) - 1
    made = made.join(taken, "base", "left").withColumn("target", F.concat("base", F.repeat(F.lit("-2"), (turn + F.coalesce("had", F.lit(0))).cast("int"))))
    target = stage(target.unionByName(made.select("component", "target")), "targets")
    mapped = fresh.join(target, "component").select(F.col("id").alias("mention_id"), F.col("target").alias("canon_id"), "text")
    # Everything that is said of an entity of the new registry, folded once.
    moved = known.join(target, "component").select("canon_id", "target")
    old = registry.join(moved, "canon_id", "left").select(F.coalesce("target", "canon_id").alias("id"), "type", "canonical", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "first_seen", "last_seen", (F.coalesce("target", "canon_id") == F.col("canon_id")).cast("int").alias("own"))
    new = made.select(F.col("target").alias("id"), "type", "canonical", F.array().cast("array<string>").alias("aliases"), F.lit(episode).alias("first_seen"), F.lit(episode).alias("last_seen"), F.lit(1).alias("own"))
    said = mapped.select(F.col("canon_id").alias("id"), F.trim("text").alias("alias")).distinct()
    both = old.unionByName(new)
    head = both.groupBy("id").agg(F.max_by("type", "own").alias("type"), F.max_by("canonical", "own").alias("canonical"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    alias = both.select("id", F.explode(F.concat("aliases", F.when(F.col("own") == 0, F.array("canonical")).otherwise(F.array().cast("array<string>")))).alias("alias")).unionByName(said).where("alias is not null").distinct()
    alias = alias.join(head.select("id", F.col("canonical").alias("alias")), ["id", "alias"], "left_anti").groupBy("id").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    now = said.select("id").distinct().withColumn("now", F.lit(episode))
    out = head.join(alias, "id", "left").join(now, "id", "left").select(
        F.col("id").alias("canon_id"), "type", "canonical", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("first_seen", "now").alias("first_seen"), F.coalesce("now", "last_seen").alias("last_seen")
    )
    return stage(out, "registry"), mapped.select("mention_id", "canon_id")


def known_candidates(registry: DataFrame, mentions: DataFrame, k: int = 5, rarest: int | None = 3) -> DataFrame:
    """(mention_id, canon_id, score, arm): known entities a new mention may be: those of its type with its exact key, and the `k` that share the words of most weight.

    The score of the second arm is the sum of the shared words' inverse document frequencies over that of all the
    mention's words; the exact arm has 1. Of a mention and an entity the greater score counts. The index is read by
    the `rarest` words of a mention and no others count as shared; None, as in the query, reads it by all of them.
    """
    m = mentions.where("text is not null and type is not null").select("mention_id", "type", "text").dropDuplicates(["mention_id"])
    return m.join(_known_names(registry, m.select("type", "text").distinct(), k, rarest), ["type", "text"]).select("mention_id", "canon_id", "score", "arm")


def _known_names(registry: DataFrame, asked_names: DataFrame, k: int, rarest: int | None = None) -> DataFrame:
    """(type, text, canon_id, score, arm): `known_candidates` of different names (type, text)."""
    asks = stage(normalized(asked_names).select("type", "text", F.col("norm.key").alias("key"), F.array_distinct("norm.tokens").alias("tokens")), "asks")
    names = registry.select("canon_id", "type", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("text")).where("text is not null").distinct()
    e = stage(normalized(names).select("canon_id", "type", F.col("norm.key").alias("key"), F.col("norm.tokens").alias("tokens")), "names")
    exact = asks.select("type", "text", "key").join(e.select("canon_id", "type", "key").distinct(), ["type", "key"]).select("type", "text", "canon_id", F.lit(1.0).alias("score"), F.lit("exact").alias("arm"))
    has = stage(e.groupBy("type", "canon_id").agg(F.array_distinct(F.flatten(F.collect_set("tokens"))).alias("has")), "index")
    words = has.select("type", "canon_id", "has", F.explode("has").alias("w"))
    idf = words.groupBy("type", "w").agg(F.count(F.lit(1)).alias("df")).join(registry.groupBy("type").agg(F.count(F.lit(1)).alias("n")), "type").select("type", "w", F.log(1 + F.col("n") / F.col("df")).alias("idf"))
    weight = lambda ws: F.aggregate(ws, F.lit(0.0), lambda a, x: a + x["idf"])
    mine = asks.select("type", "text", F.explode("tokens").alias("w")).join(idf, ["type", "w"]).groupBy("type", "text").agg(F.sort_array(F.collect_list(F.struct("w", "idf"))).alias("ws"))
    mine = mine.withColumn("total", weight("ws"))
    if rarest is not None:
        first = F.slice(F.array_sort(F.transform("ws", lambda x: F.struct((-x["idf"]).alias("n"), x["w"].alias("w")))), 1, rarest)
        mine = mine.withColumn("ws", F.sort_array(F.transform(first, lambda x: F.struct(x["w"].alias("w"), (-x["n"]).alias("idf")))))
    # Names with the same words of the index ask once.
    mine = stage(mine, "asked")
    sets = stage(mine.groupBy("type", "ws", "total").agg(F.min("text").alias("rep")), "sets")
    # Of the entities that have all of some words only the `k` smallest ids can be among the best `k`: the others have as good a score at most and a greater id.
    part = F.expr("transform(sequence(1, shiftleft(1, size(ws)) - 1), m -> filter(ws, (x, i) -> (shiftright(m, i) & 1) = 1))")
    parts = sets.where(F.size("ws") <= LONG).select("type", "rep", "total", F.explode(part).alias("part")).select("type", "rep", "total", F.col("part.w").alias("ws"), weight("part").alias("s"), F.array_max(F.transform("part", lambda x: F.struct(x["idf"], x["w"])))["w"].alias("w"))
    parts = stage(parts, "parts")
    found = parts.select("type", "w", "ws").distinct().join(words, ["type", "w"]).where(F.forall("ws", lambda x: F.array_contains("has", x))).select("type", "ws", "canon_id")
    found = found.withColumn("rn", F.row_number().over(W.partitionBy("type", "ws").orderBy("canon_id"))).where(F.col("rn") <= k).drop("rn")
    met = parts.join(found, ["type", "ws"]).groupBy("type", "rep", "total", "canon_id").agg(F.max("s").alias("s"))
    # Names of more words have too many parts: all that share a word with them are scored.
    long_ = sets.where(F.size("ws") > LONG).select("type", "rep", "total", F.explode("ws").alias("x")).select("type", "rep", "total", "x", F.col("x.w").alias("w"))
    long_ = long_.join(words.drop("has"), ["type", "w"]).groupBy("type", "rep", "total", "canon_id").agg(weight(F.sort_array(F.collect_list("x"))).alias("s"))
    hit = met.unionByName(long_).select("type", "rep", "canon_id", F.round(F.col("s") / F.col("total"), 9).alias("score"))
    top = hit.withColumn("rn", F.row_number().over(W.partitionBy("type", "rep").orderBy(F.col("score").desc(), "canon_id"))).where(F.col("rn") <= k).drop("rn")
    top = mine.join(sets, ["type", "ws", "total"]).select("type", "text", "rep").join(stage(top, "best"), ["type", "rep"]).select("type", "text", "canon_id", "score", F.lit("words").alias("arm"))
    return exact.unionByName(top).groupBy("type", "text", "canon_id").agg(F.max("score").alias("score"), F.min("arm").alias("arm"))


def live_resolve(registry: DataFrame, mentions: DataFrame, threshold: float = 0.9, k: int = 5) -> DataFrame:
    """(mention_id, canon_id, pass_no, score): the first pass attaches a mention to the best known entity it may be, the second resolves the rest among themselves.

    A known entity must reach `threshold` by the rule chain; ties go to the smaller id. What the second pass puts
    together without a known entity is named by the group's smallest mention (`new:` before it).

    Names are scored, not mentions: a context only adds to a score, so that of a mention is asked for where its name
    alone isn't settled. In the second pass mentions of one name are one group, and only those in blocks that have
    other names and not too many mentions meet one by one. A mention in differing rows has the greatest.
    """
    if threshold > 1:
        raise ValueError("no score is above 1")
    m = mentions.where("mention_id is not null and text is not null and type is not null").groupBy("mention_id").agg(F.max(F.struct("type", "text", "context")).alias("m"))
    m = stage(m.select("mention_id", "m.*"), "mentions")
    names = m.groupBy("type", "text").agg(F.min("mention_id").alias("rep"))
    names = stage(normalized(names).select("rep", "type", "text", "norm", "entropy"), "names")
    known = stage(normalized(anchors(registry)).select("id", "type", "text", "norm", "entropy", "context"), "known")
    cand = stage(_known_names(registry, names.select("type", "text"), k).select("type", "text", F.concat(F.lit(ANCHOR), "canon_id").alias("a"), F.when(F.col("arm") == "exact", "exact").otherwise("head").alias("block")), "candidates")

    def good(forms: DataFrame, pairs: DataFrame) -> DataFrame:
        """(id, x) of forms: the best known entity as (-score, canon_id)."""
        scored = score_pairs(pairs.select("a", "b", "type", "block"), forms.unionByName(known.select(*forms.columns))).where(F.col("score") >= threshold)
        return scored.groupBy(F.col("b").alias("id")).agg(F.min(F.struct((-F.col("score")).alias("n"), F.substr("a", F.lit(len(ANCHOR) + 1)).alias("canon_id"))).alias("x"))

    plain = names.select(F.col("rep").alias("id"), "norm", "entropy", F.lit(None).cast("string").alias("context"))
    by_name = good(plain, cand.join(names.select("type", "text", F.col("rep").alias("b")), ["type", "text"]))
    by_name = stage(names.select("type", "text", F.col("rep").alias("id")).join(by_name, "id").select("type", "text", "x"), "by-name")
    # Where an entity has a context, it may count: but not for a name that has an entity at 1 already.
    more = cand.join(known.where("context <> ''").select(F.col("id").alias("a")), "a", "left_semi").join(by_name.where("x.n = -1").select("type", "text"), ["type", "text"], "left_anti")
    more = stage(more, "with-context")
    own = m.where("context <> ''").join(more.select("type", "text").distinct(), ["type", "text"], "left_semi").groupBy("type", "text", "context").agg(F.min("mention_id").alias("id"))
    own = stage(own, "contexts")
    by_own = good(own.join(names.select("type", "text", "norm", "entropy"), ["type", "text"]).select("id", "norm", "entropy", "context"), more.join(own.select("type", "text", F.col("id").alias("b")), ["type", "text"]))
    by_own = own.join(by_own, "id").select("type", "text", "context", F.col("x").alias("y"))
    best = m.join(by_name, ["type", "text"], "left").join(by_own, ["type", "text", "context"], "left").withColumn("z", F.least("x", "y"))
    best = stage(best.select("mention_id", "type", "text", F.when(F.col("z").isNull(), F.col("context")).alias("context"), "z"), "first")
    first = best.where("z is not null").select("mention_id", F.col("z.canon_id").alias("canon_id"), F.lit(1).alias("pass_no"), (-F.col("z.n")).alias("score"))
    # The rest: all mentions of a key are one group, as the chain of an exact key would make them.
    rest = best.where("z is null").select("mention_id", "type", "text", "context")
    left = rest.groupBy("type", "text").agg(F.min("mention_id").alias("id"), F.count(F.lit(1)).alias("n"))
    left = stage(left.join(names.drop("rep"), ["type", "text"]), "left")
    keys = stage(block_keys(left).join(left.select("id", "n", F.col("norm.key").alias("key")), "id"), "keys")
    chain = candidate_pairs(keys.where("block = 'exact'").select("id", "type", "block", "value")).select("a", "b")
    mixed = keys.where("block <> 'exact'").groupBy("type", "block", "value").agg(F.sum("n").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).where(f"n <= {MOST} and lo <> hi")
    near = keys.join(mixed.select("type", "block", "value"), ["type", "block", "value"], "left_semi").select(F.col("id").alias("rep"), "type", "block", "value")
    near = stage(near, "near")
    few = left.join(near.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("type", "text", F.col("id").alias("rep"), "norm", "entropy")
    few = stage(rest.join(few, ["type", "text"]).select(F.col("mention_id").alias("id"), "rep", "norm", "entropy", "context"), "few")
    pairs = candidate_pairs(near.join(few.select("id", "rep"), "rep").select("id", "type", "block", "value"), MOST)
    met = score_pairs(pairs, few.drop("rep")).where(F.col("score") >= threshold).select("a", "b")
    met = met.join(few.select(F.col("id").alias("a"), F.col("rep").alias("x")), "a").join(few.select(F.col("id").alias("b"), F.col("rep").alias("y")), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    linked = components(chain.unionByName(met.distinct()))
    group = left.join(linked, "id", "left").join(keys.select("id").distinct().withColumn("keyed", F.lit(True)), "id", "left")
    group = group.select("type", "text", F.when(F.col("keyed"), F.coalesce("component", "id")).alias("component"))
    second = rest.join(group, ["type", "text"]).select("mention_id", F.concat(F.lit("new:"), F.coalesce("component", "mention_id")).alias("canon_id"), F.lit(2).alias("pass_no"), F.lit(None).cast("double").alias("score"))
    return first.unionByName(second)
