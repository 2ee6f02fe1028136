"""Queries for evidence, documents, alternatives, scores, labels and views of the graph, each with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgraph.functions import names
from ledgraph.functions import text as texts
from ledgraph.operators import conversation, evaluate, facts, graph, judgments, linking, registry, resolution, retrieval, slots
from ledgraph.plans.graph_queries import _ACC, _ED, _ENT, _PAT, _accepted, _edges, _patterns
from ledgraph.plans.text_queries import _AT, _F, _facts, _turns
from ledgraph.sources.graphs import remove_partition
from ledgraph.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Evidence

_OCC = "occ AS (SELECT DISTINCT ON (fact_id) head, relation AS type, tail, episode_id AS doc_id, confidence, tail_name AS snippet FROM facts WHERE head IS NOT NULL AND tail IS NOT NULL AND relation IS NOT NULL)"


def _occurrences(spark, d):
    f = table(spark, d, "facts").where("head is not null and tail is not null and relation is not null").dropDuplicates(["fact_id"])
    none = F.lit(None).cast("int")
    return f.select("head", F.col("relation").alias("type"), "tail", F.col("episode_id").alias("doc_id"), "confidence", F.lit(False).alias("derived"), F.col("tail_name").alias("snippet"), none.alias("span_start"), none.alias("span_end"))


@query(f"""WITH {_OCC}, r AS (SELECT *, row_number() OVER (PARTITION BY head, type, tail ORDER BY confidence DESC NULLS LAST, doc_id, snippet) AS rn FROM occ)
SELECT head, type, tail, max(confidence) AS confidence, count(*) AS support, string_agg(doc_id || '=' || snippet, ';' ORDER BY rn) FILTER (rn <= 3) AS evidence FROM r GROUP BY 1, 2, 3""")
def edges_with_evidence(spark, d):
    e = graph.evidence_edges(_occurrences(spark, d))
    return e.select("head", "type", "tail", "confidence", "support", F.array_join(F.transform("evidence", lambda x: F.concat_ws("=", x["doc_id"], x["snippet"])), ";").alias("evidence"))


@query(f"""WITH {_OCC}, r AS (SELECT *, row_number() OVER (PARTITION BY head, type, tail ORDER BY confidence DESC NULLS LAST, doc_id, snippet) AS rn FROM occ)
SELECT doc_id AS episode_id, head, type, tail, max(confidence) AS confidence, count(*) AS support FROM r WHERE rn <= 3 GROUP BY 1, 2, 3, 4""")
def evidence_by_episode(spark, d):
    return facts.by_episode(graph.evidence_edges(_occurrences(spark, d)))


@query(f"""WITH {_OCC}, g AS (SELECT head, type, tail, snippet, max(confidence) AS c, count(*) AS n FROM occ GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY head, type, tail ORDER BY c DESC, snippet) AS rn FROM g)
SELECT head, type, tail, max(c) AS confidence, sum(n)::BIGINT AS support, string_agg(snippet, ';' ORDER BY rn) FILTER (rn <= 2) AS quotes FROM r GROUP BY 1, 2, 3""")
def folded_facts(spark, d):
    return graph.folded_facts(_occurrences(spark, d)).withColumn("quotes", F.array_join("quotes", ";"))


_GOLD = """gold AS (SELECT DISTINCT mention_id, g AS canon_id FROM mentions JOIN (SELECT t, min(gid) AS g FROM (SELECT DISTINCT canon_id AS gid, unnest(list_append(coalesce(aliases, []), canonical)) AS t FROM (SELECT DISTINCT ON (canon_id) * FROM entities)) GROUP BY 1 HAVING count(*) = 1) ON t = trim(text, ' '))"""
_LEGAL = """m AS (SELECT DISTINCT ON (mention_id) * FROM mentions WHERE doc_id IS NOT NULL AND text IS NOT NULL AND span_start IS NOT NULL),
lp AS (SELECT l.doc_id, pat.type, l.mention_id AS head, r.mention_id AS tail, l.span_start AS s, least(l.confidence, r.confidence) AS confidence, row_number() OVER (PARTITION BY l.doc_id, pat.type, l.text, r.text ORDER BY l.span_start, r.span_start, l.mention_id, r.mention_id) AS rn
FROM m l JOIN m r ON l.doc_id = r.doc_id AND l.mention_id <> r.mention_id AND abs(l.span_start - r.span_start) <= 200 AND l.text <> r.text JOIN pat ON pat.head_type = l.type AND pat.tail_type = r.type)"""


def _gold(spark, d):
    e = table(spark, d, "entities").dropDuplicates(["canon_id"]).select(F.col("canon_id").alias("group_id"), F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("canonical")).alias("names"))
    return linking.gold_by_alias(table(spark, d, "mentions"), e).distinct().withColumnRenamed("gold", "canon_id")


@query(f"""WITH {_GOLD}, {_PAT}, {_LEGAL}, e AS (SELECT h.canon_id AS head, lp.type, t.canon_id AS tail, lp.doc_id FROM lp JOIN gold h ON h.mention_id = lp.head JOIN gold t ON t.mention_id = lp.tail WHERE rn = 1 AND h.canon_id <> t.canon_id)
SELECT head, type, tail, count(*) AS support, count(DISTINCT doc_id) AS n_docs FROM e GROUP BY 1, 2, 3""")
def build_graph(spark, d):
    """Mention pairs that a pattern permits as occurrences, their ends rewritten to entities, with the heads' contexts as evidence."""
    m = table(spark, d, "mentions").dropDuplicates(["mention_id"]).select(F.col("mention_id").alias("head"), "confidence", F.col("context").alias("snippet"), "span_start", "span_end")
    occ = graph.legal_pairs(table(spark, d, "mentions"), _patterns(spark)).join(m, "head").withColumn("derived", F.lit(False))
    return graph.build_graph(occ, _gold(spark, d)).select("head", "type", "tail", "support", "n_docs")


@query(f"WITH {_GOLD} SELECT canon_id, doc_id, count(DISTINCT mention_id) AS n FROM gold JOIN (SELECT DISTINCT mention_id, doc_id FROM mentions) USING (mention_id) WHERE doc_id IN (SELECT doc_id FROM documents) GROUP BY 1, 2")
def document_links(spark, d):
    return graph.document_links(table(spark, d, "mentions"), _gold(spark, d), table(spark, d, "documents"))


@query(f"""WITH {_GOLD}, l AS (SELECT DISTINCT canon_id, doc_id FROM gold JOIN (SELECT DISTINCT mention_id, doc_id FROM mentions) USING (mention_id) WHERE doc_id IN (SELECT doc_id FROM documents))
SELECT x.canon_id AS a, y.canon_id AS b, count(*) AS n_docs FROM l x JOIN l y ON x.doc_id = y.doc_id AND x.canon_id < y.canon_id GROUP BY 1, 2""")
def entities_together(spark, d):
    return graph.together(graph.document_links(table(spark, d, "mentions"), _gold(spark, d), table(spark, d, "documents")))


# Views of the graph


@query(f"WITH {_ED}, n AS (SELECT head AS x, tail AS y FROM ed WHERE head <> tail UNION SELECT tail, head FROM ed WHERE head <> tail), s AS (SELECT DISTINCT canon_id AS id FROM entities WHERE type = 'project'), o AS (SELECT DISTINCT y AS id FROM n WHERE x IN (FROM s) AND y NOT IN (FROM s)), t AS (SELECT DISTINCT y AS id FROM n WHERE x IN (FROM o) AND y NOT IN (FROM s) AND y NOT IN (FROM o)) SELECT id, 1 AS hops FROM o UNION ALL SELECT id, 2 FROM t")
def two_hops_to_projects(spark, d):
    return graph.two_hops_to(_edges(spark, d), table(spark, d, "entities").where("type = 'project'").select(F.col("canon_id").alias("id")))


@query(f"""WITH RECURSIVE {_ED}, e AS (SELECT DISTINCT head AS s, tail AS t FROM ed WHERE type = 'subsidiary_of'), p(start_id, end_id, path, n) AS (SELECT s, t, [s, t], 1 FROM e WHERE s <> t UNION ALL SELECT start_id, t, list_append(path, t), n + 1 FROM p JOIN e ON end_id = s WHERE n < 3 AND NOT list_contains(path, t))
SELECT array_to_string(path, '>') AS path FROM p WHERE start_id NOT IN (SELECT t FROM e WHERE s <> t)""")
def chains_from_roots(spark, d):
    e = graph.strong(_edges(spark, d), relation="subsidiary_of")
    return graph.from_roots(graph.chains(e, 3), e).select(F.array_join("path", ">").alias("path"))


@query(f"""WITH RECURSIVE {_ED}, n AS (SELECT head AS x, tail AS y FROM ed WHERE type <> 'located_in' UNION SELECT tail, head FROM ed WHERE type <> 'located_in'), src AS (SELECT min(head) AS id FROM ed WHERE type <> 'located_in'),
r(id, d) AS (SELECT id, 0 FROM src UNION SELECT y, d + 1 FROM r JOIN n ON x = id WHERE d < 5) SELECT id, min(d)::INTEGER AS distance FROM r GROUP BY 1""")
def shortest_path_lengths(spark, d):
    e = _edges(spark, d).where("type <> 'located_in'")
    return graph.shortest_paths(e, e.agg(F.min("head").alias("id")), 5).select("id", "distance")


@query(f"WITH {_ED}, s AS (SELECT DISTINCT canon_id AS id FROM entities WHERE type = 'organization') SELECT 'out' AS side, head, type, tail FROM ed WHERE head IN (FROM s) UNION ALL SELECT 'in', head, type, tail FROM ed WHERE tail IN (FROM s)")
def edges_of_organizations(spark, d):
    e, ids = _edges(spark, d).select("head", "type", "tail"), table(spark, d, "entities").where("type = 'organization'").select(F.col("canon_id").alias("id"))
    return graph.out_edges(e, ids).select(F.lit("out").alias("side"), "head", "type", "tail").unionByName(graph.in_edges(e, ids).select(F.lit("in").alias("side"), "head", "type", "tail"))


@query(f"""WITH {_PAT}, {_LEGAL}, bad AS (SELECT mention_id FROM mentions WHERE confidence < 0.8) SELECT type, head, tail FROM lp WHERE rn = 1 AND head NOT IN (FROM bad) AND tail NOT IN (FROM bad)""")
def grounded_edges(spark, d):
    m = table(spark, d, "mentions")
    unreal = m.withColumn("modality", F.when(F.col("confidence") < 0.8, "hypothetical").otherwise("asserted"))
    return graph.grounded(graph.legal_pairs(m, _patterns(spark)), unreal).select("type", "head", "tail")


@query(f"WITH {_ED}, {_GOLD}, a AS (SELECT head, type, tail FROM ed UNION ALL SELECT DISTINCT canon_id, 'MENTIONED_IN', doc_id::VARCHAR FROM gold JOIN mentions USING (mention_id) WHERE doc_id IN (SELECT doc_id FROM documents)) SELECT type <> 'MENTIONED_IN' AS knowledge, type, count(*) AS n FROM a GROUP BY ALL")
def knowledge_and_lexical(spark, d):
    links = graph.document_links(table(spark, d, "mentions"), _gold(spark, d), table(spark, d, "documents")).select(F.col("canon_id").alias("head"), F.lit("MENTIONED_IN").alias("type"), F.col("doc_id").cast("string").alias("tail"))
    a = _edges(spark, d).select("head", "type", "tail").unionByName(links)
    n = lambda lexical: graph.knowledge_edges(a, lexical).groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(not lexical).alias("knowledge"), "type", "n")
    return n(False).unionByName(n(True))


@query(f"WITH {_ED} SELECT head, type, tail FROM ed WHERE NOT starts_with(head, 'person:') AND NOT starts_with(tail, 'person:')")
def without_a_domain(spark, d):
    return remove_partition(_edges(spark, d).select("head", "type", "tail"), "person", "head", "tail")


_HITS = "h AS (SELECT doc_id AS query_id, doc_id AS id FROM documents WHERE doc_id % 20 = 0), md AS (SELECT DISTINCT doc_id, canon_id FROM gold JOIN mentions USING (mention_id))"


def _hits(spark, d):
    h = table(spark, d, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("id"))
    return h, _gold(spark, d).join(table(spark, d, "mentions").select("mention_id", "doc_id").distinct(), "mention_id").select("doc_id", "canon_id").distinct()


@query(f"""WITH {_ED}, {_GOLD}, {_HITS}, n AS (SELECT head AS c, tail AS n FROM ed UNION SELECT tail, head FROM ed), r AS (SELECT c, n, row_number() OVER (PARTITION BY c ORDER BY n) AS rn FROM n), g AS (SELECT c, string_agg(n, ',' ORDER BY n) AS ns FROM r WHERE rn <= 10 GROUP BY 1)
SELECT DISTINCT query_id, id, canon_id, coalesce(ns, '') AS neighbours FROM h JOIN md ON md.doc_id = h.id LEFT JOIN g ON g.c = canon_id""")
def neighbourhoods_of_documents(spark, d):
    h, m = _hits(spark, d)
    return retrieval.around_hits(h, m, _edges(spark, d)).withColumn("neighbours", F.array_join("neighbours", ","))


@query(f"WITH {_ED}, {_GOLD}, {_HITS}, e AS (SELECT DISTINCT query_id, canon_id FROM h JOIN md ON md.doc_id = h.id) SELECT x.query_id, head, type, tail FROM ed JOIN e x ON x.canon_id = head JOIN e y ON y.canon_id = tail AND y.query_id = x.query_id")
def context_subgraphs(spark, d):
    h, m = _hits(spark, d)
    return retrieval.context_subgraph(h, m, _edges(spark, d))


# Facts


@query(f"WITH {_ED}, {_ENT}, p AS (SELECT lower(h.canonical) AS a, lower(t.canonical) AS b FROM ed JOIN ent h ON h.canon_id = head JOIN ent t ON t.canon_id = tail WHERE ed.type = 'collaborates_with' AND confidence >= 0.5) SELECT a, b FROM p UNION SELECT b, a FROM p")
def alternatives_of_edges(spark, d):
    e = _edges(spark, d).where("type = 'collaborates_with'").withColumn("type", F.lit("replaces"))
    return facts.graph_alternatives(e, table(spark, d, "entities"))


@query("SELECT lower(relation) AS name, max(policy) AS group_no FROM relation_policy GROUP BY 1")
def alternatives_of_groups(spark, d):
    g = table(spark, d, "relation_policy").groupBy(F.col("policy").alias("group_no")).agg(F.collect_list("relation").alias("names"))  # eight rows, fixed
    return facts.explicit_alternatives(g)


@query("""WITH v AS (SELECT vec_id, label, embedding FROM embeddings), p AS (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS c FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS rn FROM p), k AS (SELECT DISTINCT a, b FROM r WHERE rn <= 5 AND c >= 0.25) SELECT a, b FROM k UNION SELECT b, a FROM k""")
def alternatives_of_vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("name"), F.col("label").alias("kind"), F.col("embedding").alias("vector"))
    return facts.vector_alternatives(v, 0.25, 5)


@query(f"""WITH {_F}, t AS (SELECT head, relation, tail, min(coalesce(valid_from, recorded_at)) AS s, min(tail_type) AS kind FROM f WHERE superseded_at IS NULL AND relation IN (SELECT relation FROM relation_policy WHERE policy <> 'accumulate') GROUP BY 1, 2, 3),
l AS (SELECT head, relation, lag(tail) OVER w AS old, tail AS new, lag(kind) OVER w = kind AS same_type FROM t WINDOW w AS (PARTITION BY head, relation ORDER BY s, tail)) SELECT * FROM l WHERE old IS NOT NULL""")
def undecided_facts(spark, d):
    return facts.candidate_pairs(_facts(spark, d), table(spark, d, "relation_policy"))


@query(f"WITH {_F} SELECT DISTINCT head, relation, tail FROM f WHERE superseded_at IS NOT NULL AND EXISTS (FROM f g WHERE g.superseded_at IS NULL AND g.head = f.head AND g.relation = f.relation AND g.tail = f.tail)")
def revived_facts(spark, d):
    return facts.revived(_facts(spark, d))


@query(f"WITH {_F}, b AS (SELECT fact_id, support - 1 AS s0, NULL AS e0 FROM f WHERE recorded_at <= TIMESTAMP '{_AT}'), j AS (SELECT f.support AS s, f.superseded_at AS e, b.s0 FROM f LEFT JOIN b USING (fact_id)) SELECT count(*) FILTER (s0 IS NULL) AS inserted, count(*) FILTER (s > s0) AS corroborated, count(*) FILTER (e IS NOT NULL) AS superseded FROM j")
def ingest_report(spark, d):
    f = _facts(spark, d)
    before = f.where(F.col("recorded_at") <= F.lit(_AT).cast("timestamp_ntz")).withColumn("support", F.col("support") - 1).withColumn("superseded_at", F.lit(None).cast("timestamp_ntz"))
    return facts.ingest_report(before, f)


# Scores


@query("""WITH u AS (SELECT relation, least(head, tail) AS h, greatest(head, tail) AS t, confidence, support FROM facts), p AS (SELECT relation, h, t, count(*) AS n FROM u WHERE confidence >= 0.6 GROUP BY ALL), g AS (SELECT relation, h, t, count(*) AS m FROM u WHERE support >= 2 GROUP BY ALL),
j AS (SELECT coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM p FULL JOIN g ON p.relation IS NOT DISTINCT FROM g.relation AND p.h IS NOT DISTINCT FROM g.h AND p.t IS NOT DISTINCT FROM g.t) SELECT sum(least(n, m))::BIGINT AS matched, sum(greatest(n - m, 0))::BIGINT AS spurious, sum(greatest(m - n, 0))::BIGINT AS missed FROM j""")
def undirected_match(spark, d):
    f = evaluate.undirected(table(spark, d, "facts").where("head is not null and relation is not null and tail is not null").select("head", "relation", "tail", "confidence", "support"))
    return evaluate.triple_score(f.where("confidence >= 0.6"), f.where("support >= 2"), ["relation", "head", "tail"]).select("matched", "spurious", "missed")


@query("""WITH p AS (SELECT DISTINCT head_name AS name FROM facts WHERE confidence >= 0.8), g AS (SELECT DISTINCT canonical AS name FROM entities WHERE canonical IS NOT NULL), s AS (SELECT count(*) FILTER (p.name IS NOT NULL AND g.name IS NOT NULL) AS matched, count(*) FILTER (g.name IS NULL) AS spurious, count(*) FILTER (p.name IS NULL) AS missed FROM p FULL JOIN g ON p.name = g.name)
SELECT *, round(matched / (matched + spurious), 6) AS precision, round(matched / (matched + missed), 6) AS recall FROM s""")
def entity_match(spark, d):
    p = table(spark, d, "facts").where("confidence >= 0.8").select(F.col("head_name").alias("name"))
    g = table(spark, d, "entities").where("canonical is not null").select(F.col("canonical").alias("name"))
    return evaluate.entity_score(p, g).select("matched", "spurious", "missed", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


_SYS = """sy AS (SELECT 'confident' AS system, head, relation, tail FROM f WHERE confidence >= 0.8 UNION ALL SELECT 'supported', head, relation, tail FROM f WHERE support >= 2), g AS (SELECT head, relation, tail, count(*) AS g FROM f WHERE superseded_at IS NULL GROUP BY ALL)"""


def _systems(spark, d):
    f = _facts(spark, d)
    s = f.where("confidence >= 0.8").select(F.lit("confident").alias("system"), "head", "relation", "tail").unionByName(f.where("support >= 2").select(F.lit("supported").alias("system"), "head", "relation", "tail"))
    return s, f.where("superseded_at is null")


@query(f"""WITH {_F}, {_SYS}, p AS (SELECT *, count(*) AS p FROM sy GROUP BY ALL), m AS (SELECT system, sum(p)::BIGINT AS n, sum(least(p, coalesce(g, 0)))::BIGINT AS matched FROM p LEFT JOIN g USING (head, relation, tail) GROUP BY 1), t AS (SELECT sum(g)::BIGINT AS t FROM g)
SELECT system, n, matched, n - matched AS spurious, t - matched AS missed, round(matched / n, 4) AS precision, round(matched / t, 4) AS recall, round(2 * matched / (n + t), 4) AS f1 FROM m, t""")
def scoreboard(spark, d):
    s, g = _systems(spark, d)
    return evaluate.comparison(evaluate.scoreboard(s, g, ["head", "relation", "tail"]))


@query(f"WITH {_F}, {_SYS} SELECT relation, count(*) FILTER (system = 'confident') AS confident, count(*) FILTER (system = 'supported') AS supported FROM sy GROUP BY 1")
def relation_histogram(spark, d):
    return evaluate.relation_histogram(_systems(spark, d)[0], ["confident", "supported"])


@query("""WITH n AS (SELECT DISTINCT text AS name FROM mentions WHERE text IS NOT NULL), a AS (SELECT lower(trim(s, ' ')) AS k, max(c) AS c FROM (SELECT canonical AS c, unnest(list_append(coalesce(aliases, []), canonical)) AS s FROM entities WHERE canonical IS NOT NULL) GROUP BY 1),
d AS (SELECT c, count(*) AS n FROM n JOIN a ON a.k = lower(trim(name, ' ')) GROUP BY 1) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM n) AS distinct_names, sum(n)::BIGINT AS nodes_in_alias_table, count(*) AS real_entities_covered, count(*) FILTER (n > 1) AS split_entities, sum(n)::BIGINT - count(*) AS surplus_nodes FROM d""")
def duplication_report(spark, d):
    e = table(spark, d, "entities").where("canonical is not null")
    a = e.select(F.col("canonical"), F.explode(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("canonical"))).alias("surface"))
    return evaluate.duplication_report(table(spark, d, "mentions").where("text is not null").select(F.col("text").alias("name")).distinct(), a)


@query(f"""WITH RECURSIVE {_ACC}, c AS (SELECT DISTINCT text AS surface, component AS cluster FROM comp JOIN mentions ON mention_id = id), g AS (SELECT DISTINCT canon_id AS group_id, unnest(list_append(coalesce(aliases, []), canonical)) AS surface FROM entities)
SELECT group_id, count(DISTINCT cluster) AS n_clusters FROM g JOIN c USING (surface) GROUP BY 1 HAVING count(DISTINCT cluster) > 1""")
def split_groups(spark, d):
    c = resolution.components(_accepted(spark, d)).join(table(spark, d, "mentions").select(F.col("mention_id").alias("id"), F.col("text").alias("surface")), "id").select("surface", F.col("component").alias("cluster"))
    g = table(spark, d, "entities").select(F.col("canon_id").alias("group_id"), F.explode(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("canonical"))).alias("surface"))
    return evaluate.split_groups(g, c)


@query("""WITH r AS (SELECT DISTINCT record_id, canon_id, lower(canonical) AS n, located_in AS l, source AS s FROM entity_records), g AS (SELECT x.record_id AS a, y.record_id AS b, coalesce(x.l = y.l, false) AS proposed, coalesce(x.s = y.s, false) AS judged FROM r x JOIN r y ON x.canon_id = y.canon_id AND x.record_id < y.record_id AND x.n <> y.n)
SELECT proposed, judged, count(*) AS n FROM (SELECT a, b, bool_or(proposed) AS proposed, bool_or(judged) AS judged FROM g GROUP BY 1, 2) GROUP BY 1, 2""")
def error_attribution(spark, d):
    r = table(spark, d, "entity_records").select("record_id", "canon_id", F.lower("canonical").alias("n"), F.col("located_in").alias("l"), F.col("source").alias("s")).distinct()
    x, y = r.select(*[F.col(c).alias(f"x_{c}") for c in r.columns]), r.select(*[F.col(c).alias(f"y_{c}") for c in r.columns])
    g = x.join(y, F.col("x_canon_id") == F.col("y_canon_id")).where("x_record_id < y_record_id").withColumnsRenamed({"x_record_id": "a", "y_record_id": "b"})
    c = r.where("n is not null").select(F.col("record_id").alias("id"), F.col("n").alias("cluster"))
    return evaluate.error_attribution(g.select("a", "b").distinct(), c, g.where("x_l = y_l").select("a", "b"), g.where("x_s = y_s").select("a", "b"))


@query("""WITH RECURSIVE c AS (SELECT unnest([0.9, 0.95])::DOUBLE AS t), e AS (SELECT t, a, b FROM scored_pairs, c WHERE a <> b AND trim(a) <> '' AND trim(b) <> '' AND score >= t), s AS (SELECT t, a, b FROM e UNION SELECT t, b, a FROM e),
r(t, x, y) AS (SELECT t, a, a FROM s UNION SELECT r.t, r.x, s.b FROM r JOIN s ON s.a = r.y AND s.t = r.t), k AS (SELECT t, x, min(y) AS c FROM r GROUP BY 1, 2), n AS (SELECT t, c, count(*) AS n FROM k GROUP BY 1, 2) SELECT t AS threshold, count(*) AS clusters, sum(n)::BIGINT AS clustered, max(n) AS largest FROM n GROUP BY 1""")
def clusters_at_thresholds(spark, d):
    p = table(spark, d, "scored_pairs").where("trim(a) <> '' and trim(b) <> ''")
    return evaluate.clusters_at(p, [0.9, 0.95])


# Labels, links, judgments


@query("SELECT relation, trim(lower(regexp_replace(regexp_replace(relation, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))) AS label, upper(regexp_replace(relation, '[^A-Za-z0-9]+', '_', 'g')) AS relation_label, regexp_replace(lower(relation), '[^a-z0-9]', '', 'g') AS key FROM relation_policy")
def label_forms(spark, d):
    r = F.col("relation")
    return table(spark, d, "relation_policy").select("relation", names.type_label(r).alias("label"), names.relation_label(r).alias("relation_label"), names.label_key(r).alias("key"))


@query("SELECT DISTINCT f.relation, p.relation AS name FROM facts f LEFT JOIN relation_policy p ON regexp_replace(lower(p.relation), '[^a-z0-9]', '', 'g') = regexp_replace(lower(f.relation), '[^a-z0-9]', '', 'g')")
def canonical_relations(spark, d):
    return names.canonical_label(table(spark, d, "facts").select("relation").distinct(), "relation", table(spark, d, "relation_policy").select(F.col("relation").alias("name")), "name")


@query("""WITH a AS (SELECT lower(trim(s, ' ')) AS k, min(c) AS c FROM (SELECT canonical AS c, unnest(aliases) AS s FROM entities WHERE canonical IS NOT NULL) GROUP BY 1) SELECT DISTINCT text, coalesce(c, text) AS canonical FROM mentions LEFT JOIN a ON a.k = lower(trim(text, ' '))""")
def alias_table_join(spark, d):
    e = table(spark, d, "entities").where("canonical is not null").select("canonical", F.explode("aliases").alias("surface"))
    return linking.alias_table(table(spark, d, "mentions").select("text").distinct(), "text", e, "canonical")


@query("""WITH m AS (SELECT DISTINCT mention_id, type, text FROM mentions WHERE text IS NOT NULL AND type IS NOT NULL), a AS (SELECT *, lower(text[1]) AS k FROM m WHERE regexp_full_match(text, '[A-Z][A-Z&.]{1,5}')), r AS (SELECT *, lower(trim(text, ' ')[1]) AS k FROM m),
p AS (SELECT a.mention_id AS x, r.mention_id AS y FROM a JOIN r USING (k) WHERE a.type <> r.type UNION ALL SELECT l.mention_id, q.mention_id FROM m l JOIN m q ON replace(replace(lower(l.text), 'ß', 'ss'), 'ς', 'σ') = replace(replace(lower(q.text), 'ß', 'ss'), 'ς', 'σ') AND l.type <> q.type) SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM p WHERE x <> y""")
def widened_candidates(spark, d):
    return linking.widened(table(spark, d, "mentions"))


@query(f"WITH {_GOLD} SELECT mention_id, 'kb:' || canon_id AS canon_id FROM gold")
def pinned_mentions(spark, d):
    return linking.pins(_gold(spark, d).withColumnRenamed("canon_id", "key"), "kb:")


@query("""WITH m AS (SELECT DISTINCT mention_id, doc_id, text FROM mentions) SELECT mention_id, CASE WHEN instr(t.text, m.text) > 0 AND length(m.text) > 0 THEN instr(t.text, m.text) - 1 ELSE -1 END::INTEGER AS span_start FROM m LEFT JOIN documents t USING (doc_id) WHERE m.doc_id IS NOT NULL UNION ALL SELECT mention_id, -1 FROM m WHERE doc_id IS NULL""")
def located_mentions(spark, d):
    m = table(spark, d, "mentions").select("mention_id", "doc_id", "text").distinct()
    return slots.located(m, table(spark, d, "documents")).select("mention_id", F.coalesce(F.col("span_start").cast("int"), F.lit(-1)).alias("span_start"))


@query("SELECT doc_id, CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN 0 ELSE len(string_split_regex(trim(text, ' '), '[ \\t\\n\\r\\x0B\\f]+')) END::INTEGER AS n_words FROM documents")
def long_documents(spark, d):
    return slots.too_long(table(spark, d, "documents")).select("doc_id", "n_words")


@query()
def word_chunks(spark, d):
    return slots.word_chunks(table(spark, d, "documents"))


@query()
def rule_extraction(spark, d):
    """Mentions that the extractor without a model finds for the registered projects, a bounded vocabulary."""
    found = [(r.canonical, r.type) for r in table(spark, d, "entities").where("type = 'project' and canonical is not null").select("canonical", "type").distinct().limit(100_001).toLocalIterator()]
    got = slots.extract(table(spark, d, "documents"), slots.RuleExtractor(found, {"part of": "part_of"}))
    return slots.mentions_of(got, table(spark, d, "documents")).select("mention_id", "doc_id", "type", "text", "span_start", "span_end")


@query("""WITH l(label, name) AS (VALUES ('Person', 'human'), ('ORGANIZATION', 'org'), ('place', 'site')) SELECT 'mapped' AS what, name AS label, count(*) AS n FROM mentions JOIN l ON lower(l.label) = lower(type) GROUP BY 2 UNION ALL SELECT 'missing', type, count(*) FROM mentions WHERE lower(type) NOT IN (SELECT lower(label) FROM l) GROUP BY 2""")
def tagger_labels(spark, d):
    l = spark.createDataFrame([("Person", "human"), ("ORGANIZATION", "org"), ("place", "site")], "label string, name string")
    got, missing = slots.mapped_types(table(spark, d, "mentions").where("type is not null"), l)
    return got.groupBy(F.col("type").alias("label")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("mapped").alias("what"), "label", "n").unionByName(missing.select(F.lit("missing").alias("what"), "label", "n"))


@query("""WITH p AS (SELECT DISTINCT a, b, reason, fuzz, embed, context FROM scored_pairs WHERE fuzz IS NOT NULL AND embed IS NOT NULL AND context IS NOT NULL), m AS (SELECT *, greatest(fuzz, embed, context) AS top FROM p)
SELECT DISTINCT a, b, reason, CASE WHEN context = top THEN 'context' WHEN embed = top THEN 'embed' ELSE 'fuzz' END AS label, top AS p FROM m""")
def likeliest_reason(spark, d):
    p = table(spark, d, "scored_pairs").where("fuzz is not null and embed is not null and context is not null").select("a", "b", "reason", "fuzz", "embed", "context").distinct()
    q = p.withColumn("probs", F.create_map(F.lit("fuzz"), F.col("fuzz"), F.lit("embed"), F.col("embed"), F.lit("context"), F.col("context")))
    return slots.likeliest(q).select("a", "b", "reason", "label", "p").distinct()


@query("""WITH p AS (SELECT a, b, max(fuzz) AS f, max(embed) AS g FROM scored_pairs WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2) SELECT a, b, f >= 0.5 AS fact, g >= 0.5 AS agrees, f >= 0.5 AND g >= 0.5 AS keep, f BETWEEN 0.4 AND 0.6 OR g BETWEEN 0.4 AND 0.6 AS unsure FROM p""")
def two_questions(spark, d):
    p = table(spark, d, "scored_pairs").where("a is not null and b is not null").groupBy("a", "b").agg(F.max("fuzz").alias("p_fact"), F.max("embed").alias("p_agree"))
    return judgments.two_questions(p).select("a", "b", "fact", "agrees", "keep", (F.col("p_fact").between(0.4, 0.6) | F.col("p_agree").between(0.4, 0.6)).alias("unsure"))


@query("""WITH p AS (SELECT a, b, type, max(score) AS s FROM scored_pairs WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2, 3) SELECT a AS head, b AS tail, type, max(s) AS confidence FROM p WHERE s >= 0.95 GROUP BY 1, 2, 3""")
def picked_edges(spark, d):
    p = table(spark, d, "scored_pairs").where("a is not null and b is not null").select(F.lit(0).alias("doc_id"), "type", F.col("a").alias("head"), F.col("b").alias("tail"), F.col("score").alias("p"))
    return slots.picked(p).select("head", "tail", "type", "confidence")


@query("""WITH t AS (SELECT text, type, CASE WHEN count(*) > 5 THEN 'common' ELSE type END AS nt FROM mentions WHERE text IS NOT NULL AND type IS NOT NULL GROUP BY 1, 2) SELECT DISTINCT mention_id, m.text, coalesce(nt, m.type) AS type, coalesce(nt <> m.type, false) AS changed FROM mentions m LEFT JOIN t ON t.text = m.text AND t.type = m.type""")
def retyped_mentions(spark, d):
    m = table(spark, d, "mentions").select("mention_id", "text", "type")
    t = m.where("text is not null and type is not null").groupBy("text", "type").agg(F.count(F.lit(1)).alias("n")).select("text", "type", F.when(F.col("n") > 5, "common").otherwise(F.col("type")).alias("new_type"))
    return judgments.retyped(m, t).distinct()


@query(f"""WITH RECURSIVE {_ACC}, v AS (SELECT DISTINCT x.component AS p, y.component AS q FROM scored_pairs s JOIN comp x ON x.id = s.a JOIN comp y ON y.id = s.b WHERE s.score >= 0.85 AND x.component <> y.component), w AS (SELECT p, q FROM v UNION SELECT q, p FROM v),
z(x, y) AS (SELECT p, p FROM w UNION SELECT z.x, w.q FROM z JOIN w ON w.p = z.y), k AS (SELECT x, min(y) AS c FROM z GROUP BY 1) SELECT id, coalesce(c, component) AS cluster FROM comp LEFT JOIN k ON k.x = component""")
def verdicts_applied(spark, d):
    c = resolution.components(_accepted(spark, d))
    p = table(spark, d, "scored_pairs").where("score >= 0.85").select("a", "b").join(c.select(F.col("id").alias("a"), F.col("component").alias("p")), "a").join(c.select(F.col("id").alias("b"), F.col("component").alias("q")), "b")
    return judgments.applied(c.select("id", F.col("component").alias("cluster")), p.where("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct())


@query("""SELECT DISTINCT mention_id FROM mentions WHERE type = 'person' AND trim(text, ' ') <> '' AND (lower(trim(text, ' ')) = (SELECT lower(min(canonical)) FROM entities WHERE type = 'person') OR list_contains(string_split_regex((SELECT lower(min(canonical)) FROM entities WHERE type = 'person'), '\\s+'), lower(trim(text, ' '))))""")
def user_mentions(spark, d):
    who = table(spark, d, "entities").where("type = 'person'").agg(F.min("canonical")).first()[0]
    return conversation.user_mentions(table(spark, d, "mentions"), who or "")


@query()
def coreference_layers(spark, d):
    """The rule layers one after another: first person, given names of the roster, leading pronouns."""
    t = _turns(spark, d)
    people = conversation.recent_people(t.where("speaker is not null").select("session_id", "turn", F.col("speaker").alias("name")))
    return conversation.bound_pronouns(conversation.full_names(conversation.first_person(t), conversation.roster(t)), people)


@query()
def edge_windows(spark, d):
    """The sentences around each legal pair of mentions."""
    m = table(spark, d, "mentions").dropDuplicates(["mention_id"]).select("mention_id", "span_start", "span_end")
    p = graph.legal_pairs(table(spark, d, "mentions"), _patterns(spark)).join(m.select(F.col("mention_id").alias("head"), F.col("span_start").alias("a0"), F.col("span_end").alias("a1")), "head").join(m.select(F.col("mention_id").alias("tail"), F.col("span_start").alias("b0"), F.col("span_end").alias("b1")), "tail")
    spans = p.select("doc_id", F.concat_ws("|", "head", "type", "tail").alias("edge_id"), F.least("a0", "b0").alias("lo"), F.greatest("a1", "b1").alias("hi"))
    return linking.edge_windows(spans, texts.sentences(table(spark, d, "documents")), table(spark, d, "documents"))


@query()
def fuzzy_links(spark, d):
    e = table(spark, d, "entities").dropDuplicates(["canon_id"]).select(F.col("canon_id").alias("key"), "canonical", "aliases")
    return linking.fuzzy(table(spark, d, "mentions").where("type = 'organization'"), e, 0.9)


@query()
def registry_episode(spark, d):
    """The registry after the mentions of projects and facilities are added as one episode."""
    r = table(spark, d, "entities").dropDuplicates(["canon_id"]).select("canon_id", "type", "canonical", "aliases", F.col("first_seen").cast("string").alias("first_seen"), F.col("last_seen").cast("string").alias("last_seen"))
    return registry.add_episode(r, table(spark, d, "mentions").where("type in ('project', 'facility')"), "9999")[0]


@query()
def live_resolution(spark, d):
    r = table(spark, d, "entities").dropDuplicates(["canon_id"]).select("canon_id", "type", "canonical", "aliases")
    return registry.live_resolve(r, table(spark, d, "mentions").where("type in ('project', 'facility')"))


@query()
def known_candidates(spark, d):
    r = table(spark, d, "entities").dropDuplicates(["canon_id"]).select("canon_id", "type", "canonical", "aliases")
    return registry.known_candidates(r, table(spark, d, "mentions"), rarest=None)
