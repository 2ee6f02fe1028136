"""The pN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgraph.llm import arrivals, groups, packing, pieces, replay, survivor, truncation, variants
from ledgraph.sources.tables import table


def _oversized(spark, d):
    lim = table(spark, d, "size_limits")
    docs = table(spark, d, "documents").select(F.lit("document").alias("item_kind"), F.col("doc_id").cast("string").alias("item_id"), "text")
    talk = table(spark, d, "rendered_sessions").select(F.lit("session").alias("item_kind"), F.col("session_id").alias("item_id"), "text")
    return docs.unionByName(talk).join(F.broadcast(lim), "item_kind")  # two rows, fixed


def p1_found(spark, d):
    return variants.attribute(table(spark, d, "mentions"), table(spark, d, "entities"))


def p1_spellings(spark, d):
    return variants.spellings_of(table(spark, d, "mentions"), table(spark, d, "entities"))


def p2_found(spark, d):
    got = pieces.split_items(_oversized(spark, d), with_text=False)
    return got.groupBy("item_kind", "item_id").agg(F.when(F.max("forced"), "forced").otherwise("natural").alias("cut"))


def p2_pieces(spark, d):
    return pieces.split_items(_oversized(spark, d))


def p3_found(spark, d):
    return arrivals.repeats(table(spark, d, "incoming_mentions"), table(spark, d, "entities"))


def p5_found(spark, d):
    return survivor.survivors(table(spark, d, "entity_records"), table(spark, d, "source_trust"))


def p5_records(spark, d):
    return survivor.built(table(spark, d, "entity_records"), table(spark, d, "source_trust"))


def p5_truths(spark, d):
    return survivor.truths(table(spark, d, "entity_records"))


def p5_agreement(spark, d):
    return survivor.agreement(table(spark, d, "entity_records"), table(spark, d, "source_trust"))


def p6_found(spark, d):
    return groups.connected_groups(groups.accepted(table(spark, d, "scored_pairs"))).select("group_id", F.col("member").alias("mention_id"))


def p8_ids(spark, d):
    return replay.token_ids(table(spark, d, "documents"), "doc_id", "text")


def p9_containers(spark, d):
    return packing.pack(table(spark, d, "documents"))


def p9_fill(spark, d):
    return packing.fill_rate(packing.pack(table(spark, d, "documents")))


def p10_found(spark, d):
    return truncation.truncated(table(spark, d, "documents")).select("doc_id")


def p10_shares(spark, d):
    return truncation.share_by_source(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_spellings, p2_found, p2_pieces, p3_found, p5_found, p5_records, p5_truths, p5_agreement, p6_found, p8_ids, p9_containers, p9_fill, p10_found, p10_shares)}
ORACLE = {
    "p2_found": """
WITH i AS (SELECT 'document' AS item_kind, doc_id::VARCHAR AS item_id, text FROM documents UNION ALL SELECT 'session', session_id, text FROM rendered_sessions)
SELECT item_kind, item_id, CASE WHEN list_max(list_transform(string_split_regex(regexp_replace(text, '([。！？])', '\\1 ', 'g'), '[\\p{Z}\\t\\n\\x0B\\f\\r\\x{1C}-\\x{1F}\\x{85}]'), lambda x: length(x))) > max_chars THEN 'forced' ELSE 'natural' END AS cut
FROM i JOIN size_limits USING (item_kind) WHERE length(text) > max_chars""",
    "p5_records": """
WITH r AS (SELECT DISTINCT ON (e.canon_id, e.record_id) e.*, coalesce(t.trust_rank, 2147483647) AS tr FROM entity_records e LEFT JOIN source_trust t ON t.source = e.source),
l AS (SELECT *, list_distinct(list_filter(list_transform(aliases, lambda y: regexp_replace(y, '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g')), lambda z: z <> '')) AS al, list_distinct(list_filter(list_transform(mentions, lambda y: regexp_replace(y, '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g')), lambda z: z <> '')) AS ml FROM r),
c AS (SELECT canon_id, record_id, tr, updated_at, 'canonical' AS f, canonical AS v, 1 AS n, NULL AS vs FROM l UNION ALL SELECT canon_id, record_id, tr, updated_at, 'located_in', located_in, 1, NULL FROM l
  UNION ALL SELECT canon_id, record_id, tr, updated_at, 'aliases', 'x1', len(al), list_sort(al) FROM l UNION ALL SELECT canon_id, record_id, tr, updated_at, 'mentions', 'x1', len(ml), list_sort(ml) FROM l),
ok AS (SELECT * FROM c WHERE v IS NOT NULL AND n > 0 AND regexp_matches(v, '[\\p{L}\\p{N}]') AND lower(trim(v)) NOT IN ('n/a', 'na', 'n.a.', 'none', 'null', 'nil', 'unknown', 'tbd', 'tba')),
b AS (SELECT *, row_number() OVER (PARTITION BY canon_id, f ORDER BY n DESC, tr, updated_at DESC NULLS LAST, record_id) AS rn FROM ok)
SELECT canon_id, regexp_replace(max(v) FILTER (f = 'canonical'), '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g') AS canonical, regexp_replace(max(v) FILTER (f = 'located_in'), '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g') AS located_in,
  max(vs) FILTER (f = 'aliases') AS aliases, max(vs) FILTER (f = 'mentions') AS mentions, count(DISTINCT record_id) AS n_records
FROM b WHERE rn = 1 AND canon_id IN (SELECT canon_id FROM entity_records GROUP BY canon_id HAVING count(DISTINCT record_id) > 1) GROUP BY 1""",
    "p5_found": """
WITH r AS (
  SELECT DISTINCT ON (e.canon_id, e.record_id) e.*, coalesce(t.trust_rank, 2147483647) AS tr FROM entity_records e LEFT JOIN source_trust t ON t.source = e.source
), c AS (
  SELECT canon_id, record_id, tr, updated_at, 'canonical' AS field_name, canonical AS v, 1 AS n FROM r
  UNION ALL SELECT canon_id, record_id, tr, updated_at, 'located_in', located_in, 1 FROM r
  UNION ALL SELECT canon_id, record_id, tr, updated_at, 'aliases', 'x1', len(list_distinct(list_filter(list_transform(aliases, lambda y: regexp_replace(y, '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g')), lambda z: z <> ''))) FROM r
  UNION ALL SELECT canon_id, record_id, tr, updated_at, 'mentions', 'x1', len(list_distinct(list_filter(list_transform(mentions, lambda y: regexp_replace(y, '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g')), lambda z: z <> ''))) FROM r
), ok AS (
  SELECT * FROM c WHERE v IS NOT NULL AND n > 0 AND regexp_matches(v, '[\\p{L}\\p{N}]') AND lower(trim(v)) NOT IN ('n/a', 'na', 'n.a.', 'none', 'null', 'nil', 'unknown', 'tbd', 'tba')
), best AS (
  SELECT *, row_number() OVER (PARTITION BY canon_id, field_name ORDER BY n DESC, tr, updated_at DESC NULLS LAST, record_id) AS rn FROM ok
)
SELECT canon_id, field_name, record_id FROM best
WHERE rn = 1 AND canon_id IN (SELECT canon_id FROM entity_records GROUP BY canon_id HAVING count(DISTINCT record_id) > 1)""",
    "p6_found": """
WITH RECURSIVE e AS (
  SELECT a, b FROM scored_pairs WHERE a <> b AND trim(a) <> '' AND trim(b) <> '' AND score >= 0.9
), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(x, y) AS (SELECT a, a FROM s UNION SELECT r.x, s.b FROM r JOIN s ON s.a = r.y)
SELECT min(y) AS group_id, x AS mention_id FROM r GROUP BY x""",
}
