"""The evidence-backed graph: collapsed edges, views of them, paths, and checks against an ontology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgraph.sources.tables import stage

EDGE = ["head", "type", "tail"]


def resolve_edges(edges: DataFrame, mention_to_canon: DataFrame, pins: DataFrame | None = None) -> DataFrame:
    """`edges` with both ends (mention ids) replaced by canonical ids; pinned mentions go to their pin.

    Edges with an end that isn't resolved, and self-loops that resolution makes, are dropped.
    """
    m = mention_to_canon.select("mention_id", "canon_id")
    if pins is not None:
        m = m.join(pins.select("mention_id", F.col("canon_id").alias("pin")), "mention_id", "full").select("mention_id", F.coalesce("pin", "canon_id").alias("canon_id"))
    m = m.dropDuplicates(["mention_id"])
    h, t = m.select(F.col("mention_id").alias("head"), F.col("canon_id").alias("h")), m.select(F.col("mention_id").alias("tail"), F.col("canon_id").alias("t"))
    rest = [c for c in edges.columns if c not in ("head", "tail")]
    return edges.join(h, "head").join(t, "tail").where("h <> t").select(F.col("h").alias("head"), F.col("t").alias("tail"), *rest)


def collapse_edges(evidence: DataFrame, top: int = 3) -> DataFrame:
    """One row for each (head, type, tail) of occurrences (head, type, tail, doc_id, confidence, derived).

    Confidence is the greatest, support counts occurrences, n_docs distinct documents; `derived` holds only if all
    occurrences are derived. `docs` are the documents of the `top` strongest occurrences, ties to the smaller doc_id;
    only the strongest per partition are kept while aggregating documents first.
    """
    per_doc = evidence.groupBy(*EDGE, "doc_id").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"), F.min(F.col("derived").cast("int")).alias("d"))
    rn = F.row_number().over(W.partitionBy(*EDGE).orderBy(F.col("confidence").desc(), F.col("doc_id")))
    ranked = per_doc.withColumn("rn", rn)
    best = F.array_sort(F.collect_list(F.when(F.col("rn") <= top, F.struct("rn", "doc_id"))))
    return ranked.groupBy(*EDGE).agg(
        F.max("confidence").alias("confidence"), F.sum("n").alias("support"), F.count("doc_id").alias("n_docs"), (F.min("d") == 1).alias("derived"), F.transform(best, lambda x: x["doc_id"]).alias("docs")
    )


SPAN = ("doc_id", "confidence", "snippet", "span_start", "span_end")


def build_graph(edges: DataFrame, mention_to_canon: DataFrame, pins: DataFrame | None = None, top: int = 3) -> DataFrame:
    """Canonical edges with evidence from occurrences (head, type, tail: mention ids; doc_id, confidence, derived, snippet, span_start, span_end)."""
    return evidence_edges(resolve_edges(edges, mention_to_canon, pins), top)


def evidence_edges(occurrences: DataFrame, top: int = 3) -> DataFrame:
    """`collapse_edges` with `evidence`: the `top` strongest occurrences as structs (confidence, doc_id, snippet, span_start, span_end).

    All occurrences stay in `occurrences`, which `evidence_of` reads; an edge carries a bounded number of them, so
    an edge of any support is a small row. Ties go to the smaller doc_id and span.
    """
    rn = F.row_number().over(W.partitionBy(*EDGE).orderBy(F.col("confidence").desc_nulls_last(), "doc_id", "span_start", "span_end", "snippet"))
    best = occurrences.withColumn("rn", rn).where(F.col("rn") <= top).groupBy(*EDGE).agg(F.array_sort(F.collect_list(F.struct("rn", *SPAN))).alias("e"))
    best = best.select(*EDGE, F.expr(f"transform(e, x -> named_struct({', '.join(f'{chr(39)}{c}{chr(39)}, x.{c}' for c in SPAN)}))").alias("evidence"))
    return collapse_edges(occurrences, top).join(best, EDGE)


def evidence_of(occurrences: DataFrame, entities: DataFrame, head: str, relation: str, tail: str) -> DataFrame:
    """The occurrences of one edge, its ends given by canonical name or alias whatever the case, strongest first."""
    h, t = find(entities, head).select(F.col("canon_id").alias("head")), find(entities, tail).select(F.col("canon_id").alias("tail"))
    return occurrences.where(F.col("type") == relation).join(h, "head", "left_semi").join(t, "tail", "left_semi").orderBy(F.col("confidence").desc(), "doc_id")


def pinned_entities(members: DataFrame, pin_names: DataFrame) -> DataFrame:
    """Members (component, id, ...) of pinned components under their pin: (component, ..., canon_id, canonical); pin_names has (mention_id, canon_id, name)."""
    pin = members.join(pin_names.select(F.col("mention_id").alias("id"), "canon_id", "name"), "id").groupBy("component").agg(F.min(F.struct("canon_id", "name")).alias("p"))
    return members.join(pin, "component").select(*members.columns, F.col("p.canon_id").alias("canon_id"), F.col("p.name").alias("canonical"))


def folded_facts(occurrences: DataFrame, snippets: int = 2) -> DataFrame:
    """(head, type, tail, confidence, support, quotes) of occurrences: what is written to a fact store, `replaces` first, then by confidence."""
    distinct = occurrences.groupBy(*EDGE, "snippet").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"))
    rn = F.row_number().over(W.partitionBy(*EDGE).orderBy(F.col("confidence").desc(), "snippet"))
    r = distinct.withColumn("rn", F.when(F.col("snippet").isNotNull(), rn))
    f = r.groupBy(*EDGE).agg(F.max("confidence").alias("confidence"), F.sum("n").alias("support"), F.array_sort(F.collect_list(F.when(F.col("rn") <= snippets, F.struct("rn", "snippet")))).alias("q"))
    return f.select(*EDGE, "confidence", "support", F.col("q.snippet").alias("quotes")).orderBy(F.col("type") != "replaces", F.col("confidence").desc(), *EDGE)


def by_attr(entities: DataFrame, attr: str, value: str) -> DataFrame:
    """Entities whose map `attrs` has `value` under `attr`, be it a plain value or an object in JSON with a `label`."""
    v = F.col("attrs")[attr]
    return entities.where((v == value) | (F.get_json_object(v, "$.label") == value))


def out_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("id").alias("head")).distinct(), "head", "left_semi")


def in_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("id").alias("tail")).distinct(), "tail", "left_semi")


def grounded(edges: DataFrame, mentions: DataFrame, unreal: tuple[str, ...] = ("hypothetical", "negated", "forecast")) -> DataFrame:
    """Edges (ends are mention ids) without one whose mention has an unreal `modality`."""
    bad = mentions.where(F.col("modality").isin(*unreal)).select("mention_id").distinct()
    return edges.join(bad.withColumnRenamed("mention_id", "head"), "head", "left_anti").join(bad.withColumnRenamed("mention_id", "tail"), "tail", "left_anti")


#: Relations that tie the graph to its texts and tell nothing of the world.
LEXICAL = ("MENTIONED_IN", "FROM_CHUNK", "FROM_DOCUMENT", "NEXT_CHUNK", "PART_OF_DOCUMENT")


def knowledge_edges(edges: DataFrame, lexical: bool = False) -> DataFrame:
    """The edges that tell of the world, or those that tie it to texts."""
    of_text = F.upper("type").isin(*LEXICAL)
    return edges.where(of_text if lexical else ~of_text)


def document_links(mentions: DataFrame, mention_to_canon: DataFrame, documents: DataFrame) -> DataFrame:
    """(canon_id, doc_id, n): the MENTIONED_IN links to known documents."""
    m = mentions.select("mention_id", "doc_id").distinct().join(mention_to_canon, "mention_id")
    return m.join(documents.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("canon_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))


def together(links: DataFrame, most: int | None = None) -> DataFrame:
    """(a, b, n_docs): entities of links (canon_id, doc_id) in the same documents; with `most`, documents of more entities than that are left out and must be reported by the caller."""
    d = links.select("canon_id", "doc_id").distinct()
    if most is not None:
        d = d.join(d.groupBy("doc_id").count().where(F.col("count") <= most).select("doc_id"), "doc_id", "left_semi")
    p = d.withColumnRenamed("canon_id", "a").join(d.withColumnRenamed("canon_id", "b"), "doc_id").where("a < b")
    return p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_docs"))


def strong(edges: DataFrame, confidence: float = 0.0, support: int = 1, relation: str | None = None) -> DataFrame:
    keep = edges.where((F.col("confidence") >= confidence) & (F.col("support") >= support))
    return keep if relation is None else keep.where(F.col("type") == relation)


def find(entities: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """Entities whose canonical name or any alias is `name`, whatever the case."""
    x = F.lit(name.lower())
    hit = (F.lower("canonical") == x) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a) == x)
    return entities.where(hit if kind is None else hit & (F.col("type") == kind))


def neighbors(edges: DataFrame) -> DataFrame:
    """(id, neighbor) over both directions, distinct."""
    return edges.select(F.col("head").alias("id"), F.col("tail").alias("neighbor")).unionByName(edges.select(F.col("tail").alias("id"), F.col("head").alias("neighbor"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return neighbors(edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def subgraph(edges: DataFrame, confidence: float, support: int, max_nodes: int) -> DataFrame:
    """Edges of strength between the `max_nodes` nodes of greatest degree among them, ties to the smaller id."""
    kept = strong(edges, confidence, support)
    top = degrees(kept).orderBy(F.col("degree").desc(), "id").limit(max_nodes).select("id")
    return kept.join(top.withColumnRenamed("id", "head"), "head", "left_semi").join(top.withColumnRenamed("id", "tail"), "tail", "left_semi")


def named_triples(edges: DataFrame, entities: DataFrame) -> DataFrame:
    n = entities.select("canon_id", "canonical").dropDuplicates(["canon_id"])
    return edges.join(n.select(F.col("canon_id").alias("head"), F.col("canonical").alias("head_name")), "head").join(n.select(F.col("canon_id").alias("tail"), F.col("canonical").alias("tail_name")), "tail").select("head_name", "type", "tail_name", "confidence", "support")


def namespaced(df: DataFrame, domain: str, *cols: str) -> DataFrame:
    return df.withColumns({c: F.concat_ws(":", F.lit(domain), c) for c in cols})


def schema_patterns(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(head_type, type, tail_type, n): the patterns that occur."""
    t = entities.select("canon_id", F.col("type").alias("kind")).dropDuplicates(["canon_id"])
    typed = edges.join(t.select(F.col("canon_id").alias("head"), F.col("kind").alias("head_type")), "head").join(t.select(F.col("canon_id").alias("tail"), F.col("kind").alias("tail_type")), "tail")
    return typed.groupBy("head_type", "type", "tail_type").agg(F.count(F.lit(1)).alias("n"))


def legality(typed: DataFrame, patterns: DataFrame, legal: bool) -> DataFrame:
    """Typed edges (head_type, type, tail_type, ...) that the patterns permit, or that they don't."""
    return typed.join(patterns.select("head_type", "type", "tail_type").distinct(), ["head_type", "type", "tail_type"], "left_semi" if legal else "left_anti")


def never_fired(patterns: DataFrame, edges: DataFrame) -> DataFrame:
    return patterns.select("type").distinct().join(edges.select("type").distinct(), "type", "left_anti")


def chains(edges: DataFrame, hops: int) -> DataFrame:
    """(start, end, path, length): paths of 1..`hops` edges without a repeated node, by joins; filter edges first."""
    e = edges.select(F.col("head").alias("s"), F.col("tail").alias("t")).distinct()
    now = e.where("s <> t").select(F.col("s").alias("start"), F.col("t").alias("end"), F.array("s", "t").alias("path"))
    out = now
    for _ in range(hops - 1):
        now = now.join(e, F.col("end") == F.col("s")).where(~F.array_contains("path", F.col("t"))).select("start", F.col("t").alias("end"), F.concat("path", F.array("t")).alias("path"))
        out = out.unionByName(now)
    return out.withColumn("length", F.size("path") - 1)


def from_roots(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths whose start nobody holds: no edge leads into it."""
    return paths.join(edges.where("head <> tail").select(F.col("tail").alias("start")).distinct(), "start", "left_anti")


def exposure(edges: DataFrame, names: int = 3, per: int = 1000) -> DataFrame:
    """(a, b, via, through): pairs a < b that share neighbours, how many, and the first `names` of these.

    Over distinct undirected edges. A node of more than `per` neighbours is split into groups of about `per` by hash,
    and each two of its groups, and each with itself, meet in a cell of their own, so no task holds all pairs of a hub.
    """
    n = neighbors(edges).select(F.col("id").alias("mid"), F.col("neighbor").alias("x"))
    hubs = n.groupBy("mid").agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias("s")).where("s > 1")
    n = n.join(hubs, "mid", "left").withColumn("s", F.coalesce("s", F.lit(1))).withColumn("g", F.expr("cast(pmod(xxhash64(x), s) as int)"))
    l = n.select("mid", F.col("x").alias("p"), F.col("g").alias("i"), F.explode(F.expr("sequence(g, s - 1)")).alias("j"))
    r = n.select("mid", F.col("x").alias("q"), F.col("g").alias("j"), F.explode(F.expr("sequence(0, g)")).alias("i"))
    two = l.join(r, ["mid", "i", "j"]).where("i < j or p < q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "mid")
    two = two.groupBy("a", "b").agg(F.count(F.lit(1)).alias("via"), F.array_sort(F.expr(f"collect_set(mid)")).alias("all"))
    return two.select("a", "b", "via", F.slice("all", 1, names).alias("through"))


def two_hops_to(edges: DataFrame, marked: DataFrame) -> DataFrame:
    """(id, hops): nodes one or two undirected hops from a marked one (column id), itself left out."""
    n = neighbors(edges).where("id <> neighbor")
    one = n.join(marked.select("id").distinct(), "id", "left_semi").select(F.col("neighbor").alias("id")).distinct().join(marked.select("id"), "id", "left_anti")
    two = n.join(one, "id", "left_semi").select(F.col("neighbor").alias("id")).distinct().join(marked.select("id"), "id", "left_anti").join(one, "id", "left_anti")
    return one.withColumn("hops", F.lit(1)).unionByName(two.withColumn("hops", F.lit(2)))


def shortest_paths(edges: DataFrame, sources: DataFrame, most: int = 5) -> DataFrame:
    """(source, id, path, distance): one shortest undirected path, the smallest by its nodes, to each node within `most` hops.

    Each round every new node keeps the smallest path that reached it, by a map-side minimum.
    """
    n = stage(neighbors(edges), "neighbors")
    seen = front = sources.select(F.col("id").alias("source"), F.col("id"), F.array("id").alias("path")).distinct()
    for _ in range(most):
        step = front.withColumnRenamed("id", "at").join(n.withColumnRenamed("id", "at"), "at").groupBy("source", F.col("neighbor").alias("id")).agg(F.min(F.concat("path", F.array("neighbor"))).alias("path"))
        front = stage(step.join(seen.select("source", "id"), ["source", "id"], "left_anti"), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.withColumn("distance", F.size("path") - 1)


def distances(edges: DataFrame, sources: DataFrame, most: int = 5) -> DataFrame:
    """(source, id, distance): breadth-first over undirected edges from each source (column id), up to `most` hops."""
    n = stage(neighbors(edges), "neighbors")
    seen = front = sources.select(F.col("id").alias("source"), F.col("id").alias("id"), F.lit(0).alias("distance")).distinct()
    for d in range(1, most + 1):
        step = front.select("source", F.col("id").alias("at")).join(n.withColumnRenamed("id", "at"), "at").select("source", F.col("neighbor").alias("id")).distinct()
        front = stage(step.join(seen, ["source", "id"], "left_anti").withColumn("distance", F.lit(d)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def set_of_edges(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """`union` (the left row of a key stands), `intersect`, or `only_left` of two edge sets by (head, type, tail)."""
    if how == "intersect":
        return left.join(right.select(*EDGE).distinct(), EDGE, "left_semi")
    if how == "only_left":
        return left.join(right.select(*EDGE).distinct(), EDGE, "left_anti")
    return left.unionByName(right.join(left.select(*EDGE).distinct(), EDGE, "left_anti"))


def merge_nodes(edges: DataFrame, survivors: DataFrame) -> DataFrame:
    """Edges after node merges (id, survivor): support adds up, confidence is the greatest, self-loops go."""
    s = survivors.select("id", "survivor").dropDuplicates(["id"])
    x = edges.join(s.select(F.col("id").alias("head"), F.col("survivor").alias("h")), "head", "left").join(s.select(F.col("id").alias("tail"), F.col("survivor").alias("t")), "tail", "left")
    x = x.select(F.coalesce("h", "head").alias("head"), "type", F.coalesce("t", "tail").alias("tail"), "confidence", "support").where("head <> tail")
    return x.groupBy(*EDGE).agg(F.max("confidence").alias("confidence"), F.sum("support").alias("support"))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def legal_pairs(mentions: DataFrame, patterns: DataFrame, within: int = 200) -> DataFrame:
    """(doc_id, type, head, tail) of ordered mention pairs of a document at most `within` characters apart that a pattern permits.

    Different texts only; each pair of texts once in a document and relation, the first standing. Mentions meet
    those of the same and the two next cells of `within` characters, so a long document isn't crossed with itself.
    """
    m = mentions.where("doc_id is not null and text is not null and span_start is not null").dropDuplicates(["mention_id"]).select("doc_id", "mention_id", "type", "text", "span_start", F.floor(F.col("span_start") / within).alias("cell"))
    l = m.select("doc_id", F.col("mention_id").alias("head"), F.col("type").alias("head_type"), F.col("text").alias("head_text"), F.col("span_start").alias("s"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    r = m.select("doc_id", F.col("mention_id").alias("tail"), F.col("type").alias("tail_type"), F.col("text").alias("tail_text"), F.col("span_start").alias("t"), "cell")
    p = l.join(r, ["doc_id", "cell"]).where((F.col("head") != F.col("tail")) & (F.abs(F.col("s") - F.col("t")) <= within) & (F.col("head_text") != F.col("tail_text")))
    p = p.join(F.broadcast(patterns.select("head_type", "type", "tail_type").distinct()), ["head_type", "tail_type"])  # an ontology's size
    first = F.row_number().over(W.partitionBy("doc_id", "type", "head_text", "tail_text").orderBy("s", "t", "head", "tail"))
    return p.withColumn("rn", first).where("rn = 1").select("doc_id", "type", "head", "tail")


def retype_clones(mentions: DataFrame, opinions: DataFrame, cut: float) -> DataFrame:
    """`mentions` (mention_id, type, text) and a clone `id~type` for each other type that opinions (mention_id, label, p) give at least `cut`."""
    o = opinions.where(F.col("p") >= cut).select("mention_id", "label")
    c = mentions.join(o, "mention_id").where("label <> type").select(F.concat_ws("~", "mention_id", "label").alias("mention_id"), F.col("label").alias("type"), "text")
    return mentions.select("mention_id", "type", "text").unionByName(c.distinct())


def fold_clones(members: DataFrame) -> DataFrame:
    """(component, mention_id) with clones counted as the mention they were made of."""
    return members.select("component", F.split("id", "~")[0].alias("mention_id")).distinct()
