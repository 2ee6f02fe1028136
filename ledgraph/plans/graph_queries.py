"""Queries for resolution, graph and evaluation operators over the test tables, each with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgraph.functions import names
from ledgraph.operators import evaluate, graph, resolution
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


def _evidence(spark, d):
    f = table(spark, d, "facts").where("head is not null and tail is not null and relation is not null").dropDuplicates(["fact_id"])
    return f.select("head", F.col("relation").alias("type"), "tail", F.col("episode_id").alias("doc_id"), "confidence", F.lit(False).alias("derived"))


def _edges(spark, d):
    return graph.collapse_edges(_evidence(spark, d))


_EV = "ev AS (SELECT DISTINCT ON (fact_id) head, relation AS type, tail, episode_id AS doc_id, confidence FROM facts WHERE head IS NOT NULL AND tail IS NOT NULL AND relation IS NOT NULL)"
_ED = _EV + ", ed AS (SELECT head, type, tail, max(confidence) AS confidence, count(*) AS support, count(DISTINCT doc_id) AS n_docs FROM ev GROUP BY 1, 2, 3)"
_ENT = "ent AS (SELECT DISTINCT ON (canon_id) * FROM entities)"


_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower({0}), 'ß', 'ss'), 'ς', 'σ'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\b(inc|incorporated|corp|corporation|llc|ltd|plc|co|company|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT DISTINCT c_name AS name, {_CLEAN.format('c_name')} AS clean FROM customer UNION SELECT DISTINCT p_name, {_CLEAN.format('p_name')} FROM part")
def clean_names(spark, d):
    n = table(spark, d, "customer").select(F.col("c_name").alias("name")).unionByName(table(spark, d, "part").select(F.col("p_name").alias("name"))).distinct()
    return n.withColumn("clean", names.clean_name(F.col("name")))


def _words(xs):
    return "(" + ", ".join("'" + x + "'" for x in xs) + ")"


#: The normal form in SQL. SQL here has no compatibility folding; of the forms it would change, fractions and the trade mark are spelt out.
_NORM = rf"""f0 AS (SELECT type, text, min(mention_id) AS id FROM mentions WHERE text IS NOT NULL AND type IS NOT NULL GROUP BY 1, 2),
f1 AS (SELECT *, trim(regexp_replace(regexp_replace(nfc_normalize(replace(replace(replace(replace(text, '¼', '1⁄4'), '½', '1⁄2'), '¾', '3⁄4'), '™', 'TM')), '[\x{{200B}}-\x{{200F}}\x{{FEFF}}]', '', 'g'), '[\s\p{{Z}}\x{{85}}\x{{1C}}-\x{{1F}}\x0B]+', ' ', 'g'), ' ') AS r0 FROM f0),
f2 AS (SELECT *, regexp_replace(trim(rtrim(ltrim(r0, '"''“‘(['), '"''”’)]'), ' '), '[''’]s($|[^\p{{L}}\p{{N}}_])', '\1', 'g') AS raw FROM f1),
f3 AS (SELECT *, regexp_extract_all(raw, '[^ ,]+') AS t0 FROM f2),
f4 AS (SELECT *, t0[coalesce(list_filter(range(1, len(t0) + 1), lambda i: lower(t0[i]) NOT IN {_words(names.DETERMINERS)})[1], len(t0) + 1):] AS t1 FROM f3),
f5 AS (SELECT *, CASE WHEN type IN {_words(names.ORG_TYPES)} THEN greatest(least(1, len(t1)), coalesce(list_max(list_filter(range(1, len(t1) + 1), lambda i: lower(trim(t1[i], '.,')) NOT IN {_words(names.LEGAL_SUFFIXES)})), 0))
 WHEN type IN {_words(names.PERSON_TYPES)} THEN coalesce(list_max(list_filter(range(1, len(t1) + 1), lambda i: lower(t1[i]) NOT IN {_words(names.PERSON_SUFFIXES)})), 0) ELSE len(t1) END AS hi,
 CASE WHEN type IN {_words(names.PERSON_TYPES)} THEN coalesce(list_filter(range(1, len(t1) + 1), lambda i: lower(t1[i]) NOT IN {_words(names.PERSON_TITLES)})[1], len(t1) + 1) ELSE 1 END AS lo FROM f4),
f6 AS (SELECT *, t1[lo:hi] AS toks, CASE WHEN type IN {_words(names.ORG_TYPES)} THEN array_to_string(list_transform(t1[hi + 1:], lambda t: trim(t, '.,')), ' ') ELSE '' END AS suffix FROM f5),
f7 AS (SELECT *, coalesce(nullif(array_to_string(toks, ' '), ''), raw) AS display, array_to_string(toks, '') AS joined FROM f6),
f8 AS (SELECT *, trim(regexp_replace(regexp_replace(replace(replace(lower(display), 'ß', 'ss'), 'ς', 'σ'), '[^\p{{L}}\p{{N}}_ ]', '', 'g'), ' +', ' ', 'g'), ' ') AS k FROM f7),
norm AS (SELECT id, type, text, coalesce(nullif(k, ''), lower(display)) AS key, display, list_transform(toks, lambda t: replace(replace(lower(t), 'ß', 'ss'), 'ς', 'σ')) AS tokens, suffix,
 CASE WHEN type IN {_words(names.PERSON_TYPES)} AND len(toks) > 0 THEN toks[1] ELSE '' END AS first, CASE WHEN type IN {_words(names.PERSON_TYPES)} AND len(toks) > 0 THEN toks[-1] ELSE '' END AS last,
 joined = upper(joined) AND joined <> lower(joined) AND length(joined) BETWEEN 2 AND 6 AS is_acronym FROM f8)"""


@query(f"""WITH {_NORM.replace("text IS NOT NULL AND type IS NOT NULL", "text IS NOT NULL")}, ch AS (SELECT DISTINCT key FROM norm), x AS (SELECT key, unnest(string_split(key, '')) AS c FROM ch), n AS (SELECT key, c, count(*) AS n FROM x WHERE c <> '' GROUP BY 1, 2), t AS (SELECT key, sum(n) AS t FROM n GROUP BY 1),
e AS (SELECT key, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM n JOIN t USING (key) GROUP BY 1)
SELECT type, text, key, display, tokens, suffix, first, last, is_acronym, coalesce(entropy, 0.0) AS entropy, array_to_string(list_transform(tokens, lambda w: substr(w, 1, 1)), '') AS initials FROM norm LEFT JOIN e USING (key)
UNION ALL SELECT DISTINCT type, text, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM mentions WHERE text IS NULL""")
def normalize_names(spark, d):
    m = table(spark, d, "mentions").select("type", "text").distinct()
    n = names.normalized(m)
    return n.select("type", "text", "norm.*", F.round("entropy", 6).alias("entropy"), names.initials(F.col("norm.tokens")).alias("initials"))


@query("""WITH c AS (SELECT canon_id, lower(canonical) AS k FROM (SELECT DISTINCT canon_id, canonical FROM entities WHERE canonical IS NOT NULL)),
x AS (SELECT canon_id, k, unnest(string_split(k, '')) AS ch FROM c), n AS (SELECT canon_id, ch, count(*) AS n FROM x WHERE ch <> '' GROUP BY 1, 2),
t AS (SELECT canon_id, sum(n) AS t FROM n GROUP BY 1) SELECT canon_id, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM n JOIN t USING (canon_id) GROUP BY 1""")
def name_entropy(spark, d):
    e = table(spark, d, "entities").where("canonical is not null").select("canon_id", "canonical").distinct()
    return e.select("canon_id", F.round(names.entropy(F.lower("canonical")), 6).alias("entropy"))


@query("""SELECT canon_id, array_to_string(list_transform(list_filter(string_split_regex(lower(canonical), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), lambda w: substr(w, 1, 1)), '') AS initials,
coalesce(nullif(regexp_replace(regexp_replace(lower(canonical), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unnamed') AS slug FROM (SELECT DISTINCT canon_id, canonical FROM entities WHERE canonical IS NOT NULL)""")
def name_initials(spark, d):
    e = table(spark, d, "entities").where("canonical is not null").select("canon_id", "canonical").distinct()
    return e.select("canon_id", names.initials(names.tokens_of(F.col("canonical"))).alias("initials"), names.slug(F.col("canonical")).alias("slug"))


@query("""WITH a AS (SELECT DISTINCT text FROM mentions WHERE type = 'organization' AND regexp_full_match(text, '[A-Z]{2,6}')),
o AS (SELECT DISTINCT canonical FROM entities WHERE type = 'organization'), w AS (SELECT canonical, list_filter(list_transform(string_split_regex(lower(canonical), '[^\\p{L}\\p{N}]+'), lambda t: regexp_replace(t, '[^a-z]', '', 'g')), lambda t: t <> '') AS ws FROM o)
SELECT a.text AS short_form, w.canonical FROM a JOIN w ON lower(a.text[1]) = w.ws[1][1]
WHERE regexp_matches(array_to_string(w.ws, ''), '^' || array_to_string(string_split(lower(a.text), ''), '.*')) AND
CASE WHEN len(w.ws) = 1 THEN length(a.text) >= 3 ELSE list_has_any(string_split(lower(a.text[2:]), ''), list_transform(w.ws[2:], lambda t: t[1])) END""")
def acronym_candidates(spark, d):
    a = table(spark, d, "mentions").where("type = 'organization' and text rlike '^[A-Z]{2,6}$'").select(F.col("text").alias("short_form")).distinct().withColumn("i", F.lower(F.substring("short_form", 1, 1)))
    o = table(spark, d, "entities").where("type = 'organization'").select("canonical").distinct().withColumn("ts", names.tokens_of(F.col("canonical"))).withColumn("i", F.substring(F.col("ts")[0], 1, 1))
    return a.join(o, "i").where(names.is_acronym_of(F.col("short_form"), F.col("ts"))).select("short_form", "canonical")


@query()
def alias_pairs(spark, d):
    return names.declared_aliases(table(spark, d, "documents"))


@query("""SELECT DISTINCT m.mention_id, trim(regexp_replace(substr(t.text, greatest(m.span_start - 90, 0) + 1, m.span_end + 90 - greatest(m.span_start - 90, 0)), '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g'), ' ') AS ctx
FROM mentions m JOIN documents t USING (doc_id) WHERE t.text IS NOT NULL AND m.span_start IS NOT NULL""")
def context_window(spark, d):
    m = table(spark, d, "mentions").where("span_start is not null").select("mention_id", "doc_id", "span_start", "span_end").distinct()
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("t"))
    return m.join(t, "doc_id").select("mention_id", names.context_window(F.col("t"), F.col("span_start"), F.col("span_end")).alias("ctx")).distinct()


@query("SELECT type, lower(trim(text)) AS key, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM mentions WHERE text IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def exact_groups(spark, d):
    m = table(spark, d, "mentions").where("text is not null")
    return m.groupBy("type", F.lower(F.trim("text")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs")).where("n > 1")


def _forms(spark, d):
    m = table(spark, d, "mentions").where("text is not null and type is not null")
    f = m.groupBy("type", "text").agg(F.min("mention_id").alias("id"), F.min("context").alias("context"))
    return names.normalized(f).select("id", "type", "text", "norm", "entropy", "context")


@query()
def blocking_pairs(spark, d):
    return resolution.candidate_pairs(resolution.block_keys(_forms(spark, d), names.declared_aliases(table(spark, d, "documents"))))


_KEYS = f"""keys AS (SELECT DISTINCT id, type, block, value FROM (
  SELECT id, type, 'exact' AS block, key AS value FROM norm WHERE key <> '' AND len(tokens) > 0 UNION ALL SELECT id, type, 'head', tokens[1] FROM norm WHERE key <> '' AND len(tokens) > 0
  UNION ALL SELECT id, type, 'tail', tokens[-1] FROM norm WHERE key <> '' AND len(tokens) > 0 UNION ALL SELECT id, type, 'last', lower(last) FROM norm WHERE key <> '' AND type IN {_words(names.PERSON_TYPES)}
  UNION ALL SELECT id, type, 'init', CASE WHEN is_acronym THEN lower(display) WHEN len(tokens) > 1 THEN array_to_string(list_transform(tokens, lambda w: substr(w, 1, 1)), '') END FROM norm WHERE key <> '' AND len(tokens) > 0) WHERE value IS NOT NULL AND value <> ''),
sized AS (SELECT *, count(*) OVER (PARTITION BY type, block, value) AS n FROM keys),
prop AS (SELECT x.id AS a, y.id AS b, x.type, x.block FROM sized x JOIN sized y ON x.type = y.type AND x.block = y.block AND x.value = y.value AND x.id < y.id WHERE x.n <= 60 AND x.block <> 'exact'
  UNION ALL SELECT id, nx, type, block FROM (SELECT *, lead(id) OVER (PARTITION BY type, value ORDER BY id) AS nx FROM keys WHERE block = 'exact') WHERE nx IS NOT NULL),
cand AS (SELECT a, b, type, arg_min(block, list_position(['head', 'tail', 'last', 'init', 'exact'], block)) AS block FROM prop GROUP BY 1, 2, 3)"""


@query(f"WITH {_NORM}, {_KEYS} SELECT a, b, type, block FROM cand")
def key_blocking_pairs(spark, d):
    return resolution.candidate_pairs(resolution.block_keys(_forms(spark, d)))


@query(f"WITH {_NORM}, {_KEYS} SELECT type, block, value, count(*) AS n FROM keys WHERE block <> 'exact' GROUP BY 1, 2, 3 HAVING count(*) > 60")
def common_blocking_keys(spark, d):
    return resolution.left_out(resolution.block_keys(_forms(spark, d)))


def _is_acronym_sql(short, tokens):
    letters = f"regexp_replace(lower({short}), '[^a-z]', '', 'g')"
    ws = f"list_filter(list_transform({tokens}, lambda t: regexp_replace(lower(t), '[^a-z]', '', 'g')), lambda t: t <> '')"
    return f"""(length({letters}) >= 2 AND len({ws}) > 0 AND regexp_matches(array_to_string({ws}, ''), '^' || array_to_string(string_split({letters}, ''), '.*')) AND
CASE WHEN len({ws}) = 1 THEN length({letters}) >= 3 ELSE list_has_any(string_split({letters}[2:], ''), list_transform(({ws})[2:], lambda t: t[1])) END)"""


@query(f"""WITH {_NORM}, {_KEYS}, j AS (SELECT c.a, c.b, c.type, x.key AS kx, y.key AS ky, x.is_acronym AS ax, y.is_acronym AS ay, x.display AS dx, y.display AS dy, x.tokens AS tx, y.tokens AS ty FROM cand c JOIN norm x ON x.id = c.a JOIN norm y ON y.id = c.b)
SELECT a, b, type, CASE WHEN kx = ky THEN 1.0 ELSE 0.97 END::DOUBLE AS score, CASE WHEN kx = ky THEN 'exact normalised match' ELSE 'acronym expansion' END AS reason FROM j
WHERE kx = ky OR (ax <> ay AND CASE WHEN ax THEN {_is_acronym_sql('dx', 'ty')} ELSE {_is_acronym_sql('dy', 'tx')} END)""")
def settled_pairs(spark, d):
    """The pairs of `key_blocking_pairs` that the first rules settle."""
    f = _forms(spark, d)
    s = resolution.score_pairs(resolution.candidate_pairs(resolution.block_keys(f)), f)
    return s.where("reason in ('exact normalised match', 'acronym expansion')").select("a", "b", "type", "score", "reason")


_PART = "p AS (SELECT p_partkey AS id, p_brand AS cluster, CAST(p_size AS VARCHAR) AS k1, split_part(p_name, ' ', 1) || '|' || p_type AS k2 FROM part)"
_OR = """cells AS (SELECT id, 0 AS rule, k1 AS value FROM p UNION ALL SELECT id, 1, k2 FROM p), c AS (SELECT * FROM cells),
pairs AS (SELECT DISTINCT x.id AS a, y.id AS b FROM c x JOIN c y ON x.rule = y.rule AND x.value = y.value AND x.id < y.id)"""


def _part(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("cluster"), F.col("p_size").cast("string").alias("k1"), F.concat_ws("|", F.split("p_name", " ")[0], "p_type").alias("k2"))


@query(f"WITH {_PART}, {_OR} SELECT a, b FROM pairs")
def or_blocking(spark, d):
    return resolution.or_blocking(_part(spark, d), "id", [F.col("k1"), F.col("k2")])


@query(f"""WITH {_PART}, {_OR}, g AS (SELECT sum(n * (n - 1) // 2)::BIGINT AS gold_pairs FROM (SELECT count(*) AS n FROM p GROUP BY cluster)),
f AS (SELECT count(*) FILTER (x.cluster = y.cluster) AS found, count(*) AS candidates FROM pairs JOIN p x ON x.id = a JOIN p y ON y.id = b)
SELECT candidates, gold_pairs, found, round(found / gold_pairs, 6) AS completeness, round(1 - candidates / (SELECT count(*) * (count(*) - 1) // 2 FROM p), 6) AS reduction FROM g, f""")
def blocking_report(spark, d):
    r = evaluate.key_blocking_report(_part(spark, d), "id", ["k1", "k2"], "cluster")
    return r.select("candidates", "gold_pairs", "found", F.round("completeness", 6).alias("completeness"), F.round("reduction", 6).alias("reduction"))


@query()
def scored_mention_pairs(spark, d):
    f = _forms(spark, d)
    p = resolution.candidate_pairs(resolution.block_keys(f, names.declared_aliases(table(spark, d, "documents"))))
    return resolution.score_pairs(p, f)


#: DuckDB's distances count bytes, so in a pair each letter outside ASCII is first made a capital, which no lower-case name has.
_ONE_BYTE = "translate({0}, array_to_string(list_distinct(list_filter(string_split(xn || yn, ''), lambda c: ord(c) > 127)), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


@query(f"""WITH e AS (SELECT DISTINCT canon_id, type, lower(canonical) AS n, split_part(lower(canonical), ' ', 1) AS k FROM entities WHERE canonical IS NOT NULL),
p AS (SELECT x.canon_id AS a, y.canon_id AS b, x.n AS xn, y.n AS yn FROM e x JOIN e y ON x.type = y.type AND x.k = y.k AND x.canon_id < y.canon_id)
SELECT a, b, round(jaro_winkler_similarity({_ONE_BYTE.format('xn')}, {_ONE_BYTE.format('yn')}), 6) AS jw, levenshtein({_ONE_BYTE.format('xn')}, {_ONE_BYTE.format('yn')})::INTEGER AS lev FROM p""")
def name_similarity(spark, d):
    from ledgraph.functions.similarity import UDFS

    e = table(spark, d, "entities").where("canonical is not null").select("canon_id", "type", F.lower("canonical").alias("n")).distinct()
    p = resolution.or_blocking(e.withColumn("k", F.concat("type", F.lit("|"), F.split("n", " ")[0])), "canon_id", [F.col("k")])
    n = e.select("canon_id", "n")
    j = p.join(n.select(F.col("canon_id").alias("a"), F.col("n").alias("x")), "a").join(n.select(F.col("canon_id").alias("b"), F.col("n").alias("y")), "b")
    return j.select("a", "b", F.round(UDFS["jaro_winkler"]("x", "y"), 6).alias("jw"), F.levenshtein("x", "y").alias("lev"))


def _accepted(spark, d, t=0.9):
    return table(spark, d, "scored_pairs").where(f"a is not null and b is not null and trim(a) <> '' and trim(b) <> '' and a <> b and score >= {t}").select("a", "b")


_ACC = """e AS (SELECT a, b FROM scored_pairs WHERE a <> b AND trim(a) <> '' AND trim(b) <> '' AND score >= 0.9), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(x, y) AS (SELECT a, a FROM s UNION SELECT r.x, s.b FROM r JOIN s ON s.a = r.y), comp AS (SELECT x AS id, min(y) AS component FROM r GROUP BY x)"""


@query(f"WITH RECURSIVE {_ACC} SELECT id, component FROM comp")
def components(spark, d):
    return resolution.components(_accepted(spark, d))


@query("""SELECT t AS threshold, count(*) AS pairs, count(DISTINCT least(a, b) || '|' || greatest(a, b)) AS distinct_pairs FROM scored_pairs, (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9, 0.95]) AS t) WHERE a <> b AND score >= t GROUP BY 1""")
def threshold_sweep(spark, d):
    cuts = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95]
    p = table(spark, d, "scored_pairs").where("a <> b and score is not null")
    x = p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.explode(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("score"))).alias("threshold"))
    return x.groupBy("threshold").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("a", "b").alias("distinct_pairs")).withColumn("threshold", F.round("threshold", 2))


ORACLE["threshold_sweep"] = ORACLE["threshold_sweep"].replace("SELECT t AS threshold", "SELECT round(t::DOUBLE, 2) AS threshold")


@query("SELECT a, b, score, reason FROM scored_pairs WHERE score >= 0.6 AND score < 0.9")
def review_band(spark, d):
    return resolution.review_band(table(spark, d, "scored_pairs"), 0.6, 0.9).select("a", "b", "score", "reason")


_MEM = """m AS (SELECT DISTINCT ON (mention_id) * FROM mentions ORDER BY mention_id), mem AS (SELECT c.component, c.id, m.type, m.text, m.confidence, m.doc_id FROM comp c JOIN m ON m.mention_id = c.id)"""


def _members(spark, d):
    m = table(spark, d, "mentions").dropDuplicates(["mention_id"])
    return resolution.components(_accepted(spark, d)).join(m, F.col("id") == F.col("mention_id")).select("component", "id", "type", "text", "confidence", "doc_id", F.lit("").alias("suffix"))


@query(f"""WITH RECURSIVE {_ACC}, {_MEM},
tt AS (SELECT component, type, row_number() OVER (PARTITION BY component ORDER BY count(*) DESC, type) AS rn FROM mem GROUP BY 1, 2),
b AS (SELECT component, text AS canonical, row_number() OVER (PARTITION BY component ORDER BY length(text) DESC, coalesce(confidence, 0) DESC, text) AS rn FROM mem WHERE text IS NOT NULL),
n AS (SELECT component, list_sort(list_distinct(list(text) FILTER (text IS NOT NULL))) AS al, count(*) AS n_mentions, count(DISTINCT doc_id) AS n_docs FROM mem GROUP BY 1)
SELECT n.component, tt.type, b.canonical, len(list_filter(al, lambda x: x <> b.canonical)) AS n_aliases, n_mentions, n_docs FROM n JOIN tt ON tt.component = n.component AND tt.rn = 1 JOIN b ON b.component = n.component AND b.rn = 1""")
def canonical_entities(spark, d):
    c = resolution.canonical_entities(_members(spark, d))
    return c.select("component", "type", "canonical", "n_aliases", "n_mentions", "n_docs")


@query(f"""WITH RECURSIVE {_ACC}, {_MEM} SELECT component, count(*) AS n, count(DISTINCT text) AS n_forms FROM mem GROUP BY 1 HAVING count(*) > 5""")
def overmerge_audit(spark, d):
    return evaluate.cluster_audit(_members(spark, d), 5)


@query(f"""WITH RECURSIVE {_ACC}, {_MEM}, j AS (SELECT component AS p, lower(text) AS g FROM mem WHERE text IS NOT NULL), x AS (SELECT count(*) OVER (PARTITION BY p, g) AS pg, count(*) OVER (PARTITION BY p) AS np, count(*) OVER (PARTITION BY g) AS ng FROM j)
SELECT round(avg(pg / np), 6) AS precision, round(avg(pg / ng), 6) AS recall, round(2 * avg(pg / np) * avg(pg / ng) / (avg(pg / np) + avg(pg / ng)), 6) AS f1, count(*) AS n FROM x""")
def bcubed(spark, d):
    m = _members(spark, d).where("text is not null")
    s = evaluate.bcubed(m.select("id", F.col("component").alias("cluster")), m.select("id", F.lower("text").alias("cluster")))
    return s.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "n")


@query(f"WITH {_ED} SELECT head, type, tail, confidence, support, n_docs FROM ed")
def collapse_edges(spark, d):
    return _edges(spark, d).select("head", "type", "tail", "confidence", "support", "n_docs")


@query(f"""WITH {_EV}, pd AS (SELECT head, type, tail, doc_id, max(confidence) AS c FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY head, type, tail ORDER BY c DESC, doc_id) AS rn FROM pd)
SELECT head, type, tail, string_agg(doc_id, ',' ORDER BY rn) AS docs FROM r WHERE rn <= 3 GROUP BY 1, 2, 3""")
def edge_top_evidence(spark, d):
    return _edges(spark, d).select("head", "type", "tail", F.array_join("docs", ",").alias("docs"))


@query(f"WITH {_ED}, {_ENT} SELECT h.canonical AS head_name, ed.type, t.canonical AS tail_name, ed.confidence, support FROM ed JOIN ent h ON h.canon_id = head JOIN ent t ON t.canon_id = tail WHERE confidence >= 0.7 AND support >= 2")
def strong_triples(spark, d):
    return graph.named_triples(graph.strong(_edges(spark, d), 0.7, 2), table(spark, d, "entities"))


@query(f"WITH {_ED} SELECT DISTINCT head AS id, tail AS neighbor FROM ed UNION SELECT tail, head FROM ed")
def neighbors(spark, d):
    return graph.neighbors(_edges(spark, d))


@query(f"""WITH {_ED}, k AS (SELECT * FROM ed WHERE confidence >= 0.6), n AS (SELECT head AS id, tail AS o FROM k UNION SELECT tail, head FROM k), top AS (SELECT id FROM n GROUP BY 1 ORDER BY count(*) DESC, id LIMIT 50)
SELECT head, type, tail, confidence, support FROM k WHERE head IN (FROM top) AND tail IN (FROM top)""")
def top_degree_subgraph(spark, d):
    return graph.subgraph(_edges(spark, d), 0.6, 1, 50).select("head", "type", "tail", "confidence", "support")


@query(f"WITH {_ED}, {_ENT} SELECT h.type AS head_type, ed.type, t.type AS tail_type, count(*) AS n FROM ed JOIN ent h ON h.canon_id = head JOIN ent t ON t.canon_id = tail GROUP BY 1, 2, 3")
def schema_summary(spark, d):
    return graph.schema_patterns(_edges(spark, d), table(spark, d, "entities"))


#: The ontology of the test tables' relations.
PATTERNS = [("person", "works_at", "organization"), ("person", "located_in", "place"), ("organization", "located_in", "place"), ("person", "officer_of", "organization"), ("organization", "subsidiary_of", "organization"), ("project", "part_of", "organization"), ("person", "collaborates_with", "person"), ("person", "mentors", "person")]
_PAT = "pat(head_type, type, tail_type) AS (VALUES " + ", ".join(str(p) for p in PATTERNS) + ")"


def _patterns(spark):
    return spark.createDataFrame(PATTERNS, "head_type string, type string, tail_type string")


def _typed(spark, d):
    t = table(spark, d, "entities").select("canon_id", "type").dropDuplicates(["canon_id"])
    e = _edges(spark, d).select("head", "type", "tail")
    return e.join(t.select(F.col("canon_id").alias("head"), F.col("type").alias("head_type")), "head").join(t.select(F.col("canon_id").alias("tail"), F.col("type").alias("tail_type")), "tail")


@query(f"WITH {_ED}, {_ENT}, {_PAT} SELECT head, ed.type, tail FROM ed JOIN ent h ON h.canon_id = head JOIN ent t ON t.canon_id = tail WHERE NOT EXISTS (FROM pat WHERE pat.head_type = h.type AND pat.type = ed.type AND pat.tail_type = t.type)")
def ontology_violations(spark, d):
    return graph.legality(_typed(spark, d), _patterns(spark), False).select("head", "type", "tail")


@query(f"WITH {_ED}, {_PAT} SELECT DISTINCT type FROM pat WHERE type NOT IN (SELECT type FROM ed)")
def never_fired(spark, d):
    return graph.never_fired(_patterns(spark), _edges(spark, d))


@query(f"""WITH RECURSIVE {_ED}, e AS (SELECT head AS s, tail AS t FROM ed WHERE type = 'subsidiary_of' AND head <> tail),
p(start_id, end_id, path, n) AS (SELECT s, t, [s, t], 1 FROM e UNION ALL SELECT start_id, t, list_append(path, t), n + 1 FROM p JOIN e ON end_id = s WHERE n < 3 AND NOT list_contains(path, t))
SELECT start_id, end_id, array_to_string(path, '>') AS path, n::INTEGER AS length FROM p""")
def ownership_chains(spark, d):
    c = graph.chains(graph.strong(_edges(spark, d), relation="subsidiary_of"), 3)
    return c.select(F.col("start").alias("start_id"), F.col("end").alias("end_id"), F.array_join("path", ">").alias("path"), "length")


@query(f"""WITH {_ED}, k AS (SELECT * FROM ed WHERE type IN ('subsidiary_of', 'officer_of')), n AS (SELECT head AS m, tail AS x FROM k UNION SELECT tail, head FROM k)
SELECT p.x AS a, q.x AS b, count(*) AS via, array_to_string(list_sort(list(p.m))[1:3], ',') AS through FROM n p JOIN n q ON p.m = q.m AND p.x < q.x GROUP BY 1, 2""")
def two_hop_exposure(spark, d):
    x = graph.exposure(_edges(spark, d).where("type in ('subsidiary_of', 'officer_of')"))
    return x.withColumn("through", F.array_join("through", ","))


@query(f"""WITH RECURSIVE {_ED}, k AS (SELECT * FROM ed WHERE type <> 'located_in'), n AS (SELECT head AS x, tail AS y FROM k UNION SELECT tail, head FROM k), src AS (SELECT min(head) AS source FROM k),
r(source, id, d) AS (SELECT source, source, 0 FROM src UNION SELECT source, y, d + 1 FROM r JOIN n ON x = id WHERE d < 5) SELECT source, id, min(d)::INTEGER AS distance FROM r GROUP BY 1, 2""")
def shortest_distances(spark, d):
    e = _edges(spark, d).where("type <> 'located_in'")
    return graph.distances(e, e.agg(F.min("head").alias("id")), 5)


_HALF = "l AS (SELECT * FROM ed WHERE confidence >= 0.6), q AS (SELECT * FROM ed WHERE support >= 2)"


def _halves(spark, d):
    e = _edges(spark, d).select("head", "type", "tail", "confidence", "support")
    return e.where("confidence >= 0.6"), e.where("support >= 2")


@query(f"WITH {_ED}, {_HALF} SELECT 'union' AS op, head, type, tail FROM (SELECT head, type, tail FROM l UNION SELECT head, type, tail FROM q) UNION ALL SELECT 'intersect', head, type, tail FROM (SELECT head, type, tail FROM l INTERSECT SELECT head, type, tail FROM q) UNION ALL SELECT 'only_left', head, type, tail FROM (SELECT head, type, tail FROM l EXCEPT SELECT head, type, tail FROM q)")
def edge_set_operations(spark, d):
    l, q = _halves(spark, d)
    parts = [graph.set_of_edges(l, q, how).select(F.lit(how).alias("op"), "head", "type", "tail") for how in ("union", "intersect", "only_left")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {_ED}, mg AS (SELECT canon_id AS id, min(canon_id) OVER (PARTITION BY type, split_part(canonical, ' ', 1)) AS survivor FROM (SELECT DISTINCT ON (canon_id) * FROM entities))
SELECT coalesce(h.survivor, head) AS head, type, coalesce(t.survivor, tail) AS tail, max(confidence) AS confidence, sum(support)::BIGINT AS support FROM ed LEFT JOIN mg h ON h.id = head LEFT JOIN mg t ON t.id = tail WHERE coalesce(h.survivor, head) <> coalesce(t.survivor, tail) GROUP BY 1, 2, 3""")
def merge_nodes(spark, d):
    e = table(spark, d, "entities").dropDuplicates(["canon_id"]).withColumn("k", F.split("canonical", " ")[0])
    m = e.groupBy("type", "k").agg(F.min("canon_id").alias("survivor"))
    s = e.join(m, e["type"].eqNullSafe(m["type"]) & e["k"].eqNullSafe(m["k"])).select(F.col("canon_id").alias("id"), "survivor")
    return graph.merge_nodes(_edges(spark, d), s)


@query(f"WITH {_ED} SELECT 'news:' || head AS head, type, 'news:' || tail AS tail FROM ed")
def namespaced_edges(spark, d):
    return graph.namespaced(_edges(spark, d).select("head", "type", "tail"), "news", "head", "tail")


@query(f"""WITH {_PAT}, m AS (SELECT DISTINCT ON (mention_id) * FROM mentions WHERE doc_id IS NOT NULL AND text IS NOT NULL AND span_start IS NOT NULL),
x AS (SELECT l.doc_id, pat.type, l.mention_id AS head, r.mention_id AS tail, row_number() OVER (PARTITION BY l.doc_id, pat.type, l.text, r.text ORDER BY l.span_start, r.span_start, l.mention_id, r.mention_id) AS rn
FROM m l JOIN m r ON l.doc_id = r.doc_id AND l.mention_id <> r.mention_id AND abs(l.span_start - r.span_start) <= 200 AND l.text <> r.text JOIN pat ON pat.head_type = l.type AND pat.tail_type = r.type) SELECT doc_id, type, head, tail FROM x WHERE rn = 1""")
def legal_candidate_pairs(spark, d):
    return graph.legal_pairs(table(spark, d, "mentions"), _patterns(spark))


@query("""WITH m AS (SELECT DISTINCT ON (mention_id) mention_id, type, text, confidence FROM mentions), o AS (SELECT mention_id, CASE WHEN type = 'person' THEN 'user' ELSE 'company' END AS label FROM m WHERE type IN ('person', 'organization') AND 1 - confidence >= 0.2)
SELECT mention_id, type, text FROM m UNION ALL SELECT m.mention_id || '~' || label, label, text FROM m JOIN o USING (mention_id)""")
def clone_and_fold(spark, d):
    m = table(spark, d, "mentions").dropDuplicates(["mention_id"])
    o = m.where("type in ('person', 'organization')").select("mention_id", F.when(F.col("type") == "person", "user").otherwise("company").alias("label"), (1 - F.col("confidence")).alias("p"))
    return graph.retype_clones(m, o, 0.2)


@query("""WITH s AS (SELECT score, reason = 'same key' AS positive FROM scored_pairs WHERE score IS NOT NULL AND reason IS NOT NULL), v AS (SELECT score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM s GROUP BY 1),
w AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v) SELECT sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives, round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS auc FROM w""")
def auc(spark, d):
    s = table(spark, d, "scored_pairs").select("score", (F.col("reason") == "same key").alias("positive"))
    return evaluate.auc(s).withColumn("auc", F.round("auc", 6))


@query("""SELECT max(score) FILTER (reason <> 'same key') AS max_negative, quantile_disc(score, 0.05) FILTER (reason = 'same key') AS accept_cut, max(score) FILTER (reason = 'same key') AS max_positive FROM scored_pairs WHERE score IS NOT NULL AND reason IS NOT NULL""")
def fit_cuts(spark, d):
    return evaluate.fit_cuts(table(spark, d, "scored_pairs").where("reason is not null").select("score", (F.col("reason") == "same key").alias("positive")), 0.95)


@query("""WITH s AS (SELECT score, reason = 'same key' AS positive FROM scored_pairs WHERE score IS NOT NULL AND reason IS NOT NULL), m AS (SELECT min(score) FILTER (positive) AS pos_min, max(score) FILTER (NOT positive) AS neg_max FROM s) SELECT *, neg_max >= pos_min AS overlap FROM m""")
def score_separation(spark, d):
    return evaluate.separation(table(spark, d, "scored_pairs").where("reason is not null and score is not null").select("score", (F.col("reason") == "same key").alias("positive")))


@query("""WITH p AS (SELECT head, relation, tail, count(*) AS n FROM facts WHERE confidence >= 0.6 GROUP BY ALL), g AS (SELECT head, relation, tail, count(*) AS m FROM facts WHERE support >= 2 GROUP BY ALL),
j AS (SELECT coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM p FULL JOIN g USING (head, relation, tail)), s AS (SELECT sum(least(n, m))::BIGINT AS matched, sum(greatest(n - m, 0))::BIGINT AS spurious, sum(greatest(m - n, 0))::BIGINT AS missed FROM j)
SELECT *, round(matched / (matched + spurious), 6) AS precision, round(matched / (matched + missed), 6) AS recall, round(2 * matched / (2 * matched + spurious + missed), 6) AS f1 FROM s""")
def one_to_one_match(spark, d):
    f = table(spark, d, "facts")
    s = evaluate.triple_score(f.where("confidence >= 0.6"), f.where("support >= 2"), ["head", "relation", "tail"])
    return s.select("matched", "spurious", "missed", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT lower(canonical) AS name, count(DISTINCT canon_id) AS n_ids, count(DISTINCT type) AS n_types FROM (SELECT canon_id, type, canonical FROM entities UNION ALL SELECT canon_id, type, unnest(aliases) FROM entities) WHERE canonical IS NOT NULL GROUP BY 1 HAVING count(DISTINCT canon_id) > 1")
def duplicate_names(spark, d):
    e = table(spark, d, "entities")
    n = e.select("canon_id", "type", "canonical").unionByName(e.select("canon_id", "type", F.explode("aliases").alias("canonical"))).where("canonical is not null")
    return n.groupBy(F.lower("canonical").alias("name")).agg(F.countDistinct("canon_id").alias("n_ids"), F.countDistinct("type").alias("n_types")).where("n_ids > 1")


@query("""WITH v AS (SELECT vec_id, label, embedding FROM embeddings), p AS (SELECT x.vec_id AS a, y.vec_id AS b, x.label AS block, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS c FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS rn FROM p) SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, CAST(block AS INTEGER) AS block FROM r WHERE rn <= 5""")
def knn_join(spark, d):
    return resolution.knn_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", "label", 5).select("a", "b", F.col("block").cast("int").alias("block"))


@query(f"""WITH e AS (SELECT DISTINCT record_id, lower(trim(canonical, ' ')) AS n, lower(located_in) AS l, canon_id FROM entity_records), p AS (SELECT x.record_id AS a, y.record_id AS b, x.n AS xn, y.n AS yn, x.l AS xl, y.l AS yl FROM e x JOIN e y ON x.canon_id = y.canon_id AND x.record_id < y.record_id)
SELECT a, b, round(CASE WHEN xn = yn THEN log2(0.9 / 0.01) WHEN levenshtein({_ONE_BYTE.format('xn')}, {_ONE_BYTE.format('yn')}) <= 3 THEN log2(0.08 / 0.02) ELSE log2(0.02 / 0.97) END + CASE WHEN xl = yl THEN log2(0.7 / 0.1) WHEN xl IS NOT NULL AND yl IS NOT NULL THEN log2(0.3 / 0.9) ELSE 0 END, 6) AS match_weight FROM p""")
def fellegi_sunter_fixed(spark, d):
    e = table(spark, d, "entity_records").select("record_id", "canon_id", F.lower(F.trim("canonical")).alias("n"), F.lower("located_in").alias("l")).distinct()
    x, y = e.select(F.col("record_id").alias("a"), "canon_id", F.col("n").alias("xn"), F.col("l").alias("xl")), e.select(F.col("record_id").alias("b"), "canon_id", F.col("n").alias("yn"), F.col("l").alias("yl"))
    p = x.join(y, "canon_id").where("a < b")
    c = F.col
    levels = {
        "name": [(c("xn") == c("yn"), 0.9, 0.01), (F.levenshtein("xn", "yn") <= 3, 0.08, 0.02), (F.lit(True), 0.02, 0.97)],
        "place": [(c("xl") == c("yl"), 0.7, 0.1), (c("xl").isNotNull() & c("yl").isNotNull(), 0.3, 0.9)],
    }
    return resolution.fellegi_sunter(p, levels).select("a", "b", F.round("match_weight", 6).alias("match_weight"))
