"""Controlled-vocabulary linking, gold labels, and joins by place in a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgraph.functions.names import casefold, folded
from ledgraph.functions.similarity import UDFS
from ledgraph.operators import likeness
from ledgraph.sources.tables import stage


def link(surfaces: DataFrame, vocabulary: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """`surfaces` (mention_id, type, text) with key, how, score: code, then name, alias, code in parentheses.

    `vocabulary` has key, code, canonical, kind, aliases. Each rung is a left join on distinct surfaces; of several
    keys for one surface the smallest is taken. `kinds` asks for a kind by mention type; another kind is no link.
    """
    v = vocabulary.select("key", "code", "canonical", "kind", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    rung = lambda df, how: df.where("x is not null and x <> ''").groupBy("x").agg(F.min("key").alias(how))
    code = rung(v.select(F.col("code").alias("x"), "key"), "by_code")
    name = rung(v.select(folded(F.col("canonical")).alias("x"), "key"), "by_name")
    alias = rung(v.select(F.explode("aliases").alias("a"), "key").select(folded(F.col("a")).alias("x"), "key"), "by_alias")
    s = surfaces.where("text is not null").select("text").distinct()
    s = s.withColumn("c", F.trim("text")).withColumn("f", folded(F.col("text"))).withColumn("p", F.trim(F.regexp_extract("text", r"\(([^)]{2,8})\)", 1)))
    s = s.join(code.withColumnRenamed("x", "c"), "c", "left").join(name.withColumnRenamed("x", "f"), "f", "left").join(alias.withColumnRenamed("x", "f"), "f", "left")
    s = s.join(code.select(F.col("x").alias("p"), F.col("by_code").alias("by_inner")), "p", "left")
    how = F.when(F.col("by_code").isNotNull(), "code").when(F.col("by_name").isNotNull(), "name").when(F.col("by_alias").isNotNull(), "alias").when(F.col("by_inner").isNotNull(), "code")
    s = s.select("text", F.coalesce("by_code", "by_name", "by_alias", "by_inner").alias("key"), how.alias("how")).where("key is not null")
    out = surfaces.join(s, "text", "left").join(v.select("key", "kind"), "key", "left")
    if kinds:
        want = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("type")]
        bad = want.isNotNull() & (F.col("kind") != want)
        out = out.withColumns({"key": F.when(~F.coalesce(bad, F.lit(False)), F.col("key")), "how": F.when(~F.coalesce(bad, F.lit(False)), F.col("how"))})
    return out.select("mention_id", "type", "text", "key", "how", F.when(F.col("key").isNotNull(), 1.0).alias("score"))


def coverage(links: DataFrame) -> DataFrame:
    """One row: considered, linked, by rung, distinct keys, and the first twelve surfaces that stay unlinked."""
    miss = links.where("key is null and text is not null").select("text").distinct().orderBy("text").limit(12).agg(F.array_sort(F.collect_list("text")).alias("unlinked"))
    n = lambda how: F.count_if(F.col("how") == how).alias(f"by_{how}")
    return links.agg(F.count(F.lit(1)).alias("considered"), F.count("key").alias("linked"), n("code"), n("name"), n("alias"), F.countDistinct("key").alias("keys")).join(miss)  # one row each


def gold_by_alias(mentions: DataFrame, groups: DataFrame) -> DataFrame:
    """(mention_id, gold) of mentions whose trimmed text stands in exactly one group (group_id, names)."""
    g = groups.select("group_id", F.explode("names").alias("t")).distinct().groupBy("t").agg(F.min("group_id").alias("gold"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return mentions.select("mention_id", F.trim("text").alias("t")).join(g, "t").select("mention_id", "gold")


def near_spans(left: DataFrame, right: DataFrame, by: list[str], at: str, tolerance: int, order: Column, key: str = "mention_id") -> DataFrame:
    """The first row of `right` by `order` for each row of `left` (id `key`) with equal `by` and `at` within `tolerance`; a band join by cells."""
    near = spans_within(left, right, by, at, tolerance)
    return near.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(order))).where("rn = 1").drop("rn")


def spans_within(left: DataFrame, right: DataFrame, by: list[str], at: str, tolerance: int) -> DataFrame:
    """All rows of `right` with equal `by` and `at` (as r_at) within `tolerance` of a row of `left`, by cells of that width."""
    cell = F.floor(F.col(at) / (tolerance + 1))
    l = left.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    r = right.withColumn("cell", cell).withColumnRenamed(at, "r_at")
    return l.join(r, [*by, "cell"]).where(F.abs(F.col(at) - F.col("r_at")) <= tolerance).drop("cell")


def overlapping(spans: DataFrame, units: DataFrame) -> DataFrame:
    """`spans` (doc_id, lo, hi) with each unit (doc_id, unit_no, unit_start, unit_end) that has a character in common."""
    return spans.join(units, "doc_id").where("unit_end > lo and unit_start < hi")


def edge_windows(edges: DataFrame, units: DataFrame, docs: DataFrame) -> DataFrame:
    """(edge_id, window): the text of the sentences that the span from an edge's first to its last end (doc_id, edge_id, lo, hi) touches."""
    w = overlapping(edges, units).groupBy("doc_id", "edge_id").agg(F.min("unit_start").alias("a"), F.max("unit_end").alias("b"))
    return w.join(docs.select("doc_id", "text"), "doc_id").select("edge_id", F.expr("substring(text, a + 1, b - a)").alias("window"))


def alias_table(df: DataFrame, col: str, aliases: DataFrame, out: str) -> DataFrame:
    """`df` with `out`: the canonical name of a surface by a table (surface, canonical), the surface itself where it has none."""
    a = aliases.groupBy(F.lower(F.trim("surface")).alias("_s")).agg(F.min("canonical").alias("_c"))
    return df.withColumn("_s", F.lower(F.trim(col))).join(a, "_s", "left").withColumn(out, F.coalesce("_c", col)).drop("_s", "_c")


def fuzzy(unlinked: DataFrame, vocabulary: DataFrame, least: float = 0.9) -> DataFrame:
    """(text, key, score): for surfaces that no exact rung links, the name or alias most like it, of `least` or more.

    Surfaces meet names that share a word or, with a letter left out, one of five letters or more, so a typo in any
    word but a short one is met. Ties go to the smaller key. Folded forms are compared, each two once; from a `least`
    of 0.9 on, they are found by what the score needs and not by words that many names have.
    """
    names = vocabulary.select("key", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).where("name is not null")
    v = stage(names.select("key", folded(F.col("name")).alias("s")).where("s <> ''").groupBy("s").agg(F.min("key").alias("key")), "names")
    t = stage(unlinked.where("text is not null").select("text").distinct().select("text", folded(F.col("text")).alias("s")).where("s <> ''"), "surfaces")
    s = t.select("s").distinct()
    met = F.size(likeness.tokens("s")) > 0
    same = s.join(v, "s").where(met).select("s", "key", F.lit(1.0).alias("score"))  # nothing else has a score of 1
    s = s.join(v.select("s"), "s", "left_anti")
    if least >= likeness.LEAST:
        p = likeness.pairs(stage(s, "open"), v.select("s"), least).where(F.arrays_overlap(likeness.tokens("a"), likeness.tokens("b")))
    else:
        l, r = (df.select(F.col("s").alias(c), F.explode(likeness.tokens("s")).alias("t")) for df, c in ((s, "a"), (v, "b")))
        p = l.join(r, "t").select("a", "b").distinct()
    p = stage(p, "likely").withColumn("score", UDFS["weighted"]("a", "b")).where(F.col("score") >= least)
    best = p.join(v.withColumnRenamed("s", "b"), "b").groupBy(F.col("a").alias("s")).agg(F.min(F.struct((-F.col("score")).alias("n"), F.col("key"))).alias("b"))
    best = best.select("s", F.col("b.key").alias("key"), (-F.col("b.n")).alias("score")).unionByName(same)
    return t.join(best, "s").where(F.col("score") >= least).select("text", "key", "score")


def pins(links: DataFrame, prefix: str = "") -> DataFrame:
    """(mention_id, canon_id) of the linked mentions: where the graph is to put them."""
    return links.where("key is not null").select("mention_id", F.concat(F.lit(prefix), "key").alias("canon_id")).distinct()


def widened(mentions: DataFrame) -> DataFrame:
    """(a, b): pairs of different types with an acronym-shaped text at one end that may stand for the other's, or of equal folded text.

    An acronym meets the mentions of another type that begin with its first letter, not all of them: else the pairs
    would be as many as acronyms times mentions. A pair is given under the first rule and end that give it, so pairs
    aren't compared with each other, but for those of ids that have several different rows.
    """
    m = mentions.where("text is not null and type is not null").select("mention_id", "type", "text").distinct()
    m = m.select(
        F.col("mention_id").alias("id"), "type", F.col("text").rlike("^[A-Z][A-Z&.]{1,5}$").alias("acro"), F.lower(F.substring(F.trim("text"), 1, 1)).alias("letter"), casefold(F.col("text")).alias("low"),
        (F.count(F.lit(1)).over(W.partitionBy("mention_id")) > 1).alias("many"),
    )
    m = stage(m, "widened")
    several = m.groupBy("low").agg(F.count_distinct("type").alias("n")).where("n > 1").select("low")
    same = stage(m.join(several, "low", "left_semi"), "same")
    side = lambda df, k, x: df.select(F.col(k).alias("k"), F.col("id").alias(x), F.col("type").alias(f"t{x}"), F.col("acro").alias(f"a{x}"), F.col("letter").alias(f"l{x}"))
    pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]

    def by_letter(l, r):
        return crossed(side(m.where("acro").where(l), "letter", "x").drop("ax", "lx"), side(m.where(r), "letter", "y").drop("ly"))

    def by_text(l, r):
        return crossed(side(same.where(l), "low", "x"), side(same.where(r), "low", "y"))

    once = by_letter("not many", "not many").where("not ay or x < y").select(*pair)
    once = once.unionByName(by_text("not many", "not many").where("x < y and not ((ax or ay) and lx = ly)").select("x", "y").toDF("a", "b"))
    if m.where("many").isEmpty():
        return once
    rest = [f(l, r) for f in (by_letter, by_text) for l, r in (("many", "true"), ("not many", "many"))]
    rest = [df.where("x <> y").select(*pair) for df in rest]
    return once.unionByName(rest[0].unionByName(rest[1]).unionByName(rest[2]).unionByName(rest[3]).distinct())


def crossed(left: DataFrame, right: DataFrame, per: int = 1000, wide: int = 20_000, task: int = 2_000_000) -> DataFrame:
    """Each row of `left` (k, x, tx and more) with each of `right` (k, y, ty and more) of equal k and another type.

    A key's rows are cut by the hash of the id into `per` and `wide` rows; each two of these groups meet in a cell of
    their own, the ids of `left` as one array for each type. There are as many tasks as pairs ask for, not bytes; a
    task's share of the arrays is small, and hashing it gives pairs faster than merging sorted rows.
    """
    count = lambda df, n: df.groupBy("k").agg(F.count(F.lit(1)).alias(n))
    sizes = stage(count(left, "n").join(count(right, "m"), "k").withColumns({"p": F.ceil(F.col("n") / per).cast("int"), "q": F.ceil(F.col("m") / wide).cast("int")}), "sizes")
    total, rows = sizes.agg(F.sum(F.col("n").cast("double") * F.col("m")), F.sum(F.col("n") + F.col("m"))).first()
    tasks = int(min(4096, (total or 0) // task) + (rows or 0) // 200_000 + 1)
    cut = sizes.select("k", "p", "q")
    l = left.join(cut, "k").withColumn("i", F.expr("cast(pmod(xxhash64(x), p) as int)"))
    l = l.groupBy("k", "q", "i", *[c for c in left.columns if c not in ("k", "x")]).agg(F.collect_list("x").alias("xs")).withColumn("j", F.explode(F.expr("sequence(0, q - 1)"))).drop("q")
    r = right.join(cut, "k").withColumn("j", F.expr("cast(pmod(xxhash64(y), q) as int)")).withColumn("i", F.explode(F.expr("sequence(0, p - 1)"))).drop("p", "q")
    met = l.repartition(tasks, "k", "i", "j").hint("shuffle_hash").join(r.repartition(tasks, "k", "i", "j"), ["k", "i", "j"]).where("tx <> ty").drop("k", "i", "j", "tx", "ty")
    return met.withColumn("x", F.explode("xs")).drop("xs")


def contained(mentions: DataFrame, units: DataFrame) -> DataFrame:
    """Mentions with the unit (doc_id, unit_no, unit_start, unit_end) that holds their whole span."""
    return mentions.join(units, "doc_id").where("span_start >= unit_start and span_end <= unit_end")
