"""Queries for facts, conversations, linking, retrieval and judgments over the test tables, each with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgraph.functions import text as texts
from ledgraph.operators import conversation, facts, graph, judgments, linking, retrieval
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


def _facts(spark, d):
    return facts.unique_facts(table(spark, d, "facts"))


_F = "f AS (SELECT DISTINCT ON (fact_id) * FROM facts ORDER BY fact_id, support DESC, confidence DESC)"
_AT = "2025-01-01 00:00:00"


@query(f"WITH {_F} SELECT fact_id FROM f WHERE superseded_at IS NULL")
def current_facts(spark, d):
    return facts.current(_facts(spark, d)).select("fact_id")


@query(f"WITH {_F} SELECT fact_id FROM f WHERE coalesce(valid_from, recorded_at) <= TIMESTAMP '{_AT}' AND (valid_until IS NULL OR valid_until > TIMESTAMP '{_AT}')")
def as_of_valid(spark, d):
    return facts.as_of(_facts(spark, d), valid_at=_AT).select("fact_id")


@query(f"WITH {_F} SELECT fact_id FROM f WHERE recorded_at <= TIMESTAMP '{_AT}' AND (superseded_at IS NULL OR superseded_at > TIMESTAMP '{_AT}')")
def as_of_known(spark, d):
    return facts.as_of(_facts(spark, d), known_at=_AT).select("fact_id")


@query(f"WITH {_F} SELECT head, relation, tail, max(confidence) AS confidence, sum(support)::BIGINT AS support, min(coalesce(valid_from, recorded_at)) AS valid_from, max(coalesce(valid_from, recorded_at)) AS last_seen, count(DISTINCT episode_id) AS n_episodes FROM f GROUP BY 1, 2, 3")
def accumulate_facts(spark, d):
    return facts.accumulate(_facts(spark, d))


def _islands_sql(keys):
    return f"""WITH {_F}, g AS (SELECT *, coalesce(valid_from, recorded_at) AS s FROM f WHERE coalesce(valid_from, recorded_at) IS NOT NULL),
n AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(tail) OVER w IS NOT DISTINCT FROM tail THEN 0 ELSE 1 END AS nw FROM g WINDOW w AS (PARTITION BY {keys} ORDER BY s, recorded_at, tail, fact_id)),
r AS (SELECT *, sum(nw) OVER (PARTITION BY {keys} ORDER BY s, recorded_at, tail, fact_id ROWS UNBOUNDED PRECEDING) AS run FROM n),
q AS (SELECT {keys}, run, min(tail) AS tail, min(s) AS valid_from, max(confidence) AS confidence, sum(support)::BIGINT AS support FROM r GROUP BY ALL)
SELECT {keys}, tail, valid_from, confidence, support, lead(valid_from) OVER (PARTITION BY {keys} ORDER BY run) AS valid_until FROM q"""


@query(_islands_sql("head, relation"))
def single_supersession(spark, d):
    return facts.islands(_facts(spark, d), ["head", "relation"])


@query(_islands_sql("head, relation, tail_type"))
def alternatives_grouped(spark, d):
    return facts.islands(_facts(spark, d), ["head", "relation", "tail_type"])


@query(f"WITH {_F} SELECT o.fact_id AS old, n.fact_id AS new, o.head, o.relation FROM f o JOIN f n ON o.superseded_by = n.fact_id")
def contradictions(spark, d):
    return facts.contradictions(_facts(spark, d))


@query(f"WITH {_F} SELECT (SELECT count(*) FROM f WHERE superseded_by IS NOT NULL AND superseded_by NOT IN (SELECT fact_id FROM f)) AS dangling, count(*) AS n_facts, sum(support)::BIGINT AS support, count(*) FILTER (superseded_at IS NULL) AS n_current FROM f")
def store_integrity(spark, d):
    return facts.integrity(_facts(spark, d))


@query(f"""WITH {_F}, v AS (SELECT head, relation, tail_name, max(confidence) AS c FROM f WHERE superseded_at IS NULL GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY head, relation ORDER BY c DESC, tail_name) AS rn FROM v),
l AS (SELECT head, relation || ': ' || string_agg(tail_name, ', ' ORDER BY rn) AS line FROM r WHERE rn <= 3 GROUP BY head, relation) SELECT head, string_agg(line, chr(10) ORDER BY line) AS prompt FROM l GROUP BY 1""")
def memory_prompt(spark, d):
    return facts.memory_prompt(_facts(spark, d))


@query(f"WITH {_F} SELECT head, relation, count(DISTINCT tail) AS n_tails FROM f WHERE superseded_at IS NULL AND relation IN (SELECT relation FROM relation_policy WHERE policy = 'single') GROUP BY 1, 2 HAVING count(DISTINCT tail) > 1")
def candidate_conflicts(spark, d):
    return facts.open_conflicts(_facts(spark, d), table(spark, d, "relation_policy"))


@query()
def assert_fact_fold(spark, d):
    return facts.assert_facts(table(spark, d, "facts"), table(spark, d, "relation_policy"))


@query(f"WITH {_F} SELECT fact_id, head AS subject, tail AS object, episode_id FROM f")
def reified_facts(spark, d):
    r = facts.reified(_facts(spark, d))
    return r["subject_of"].withColumnRenamed("entity", "subject").join(r["has_object"].withColumnRenamed("entity", "object"), "fact_id").join(r["asserted_in"], "fact_id")


_TURN = r"""l AS (SELECT session_id, list_filter(string_split_regex(text, '\r\n|\r|\n'), lambda x: trim(x, ' ') <> '') AS ls FROM rendered_sessions WHERE text IS NOT NULL),
t0 AS (SELECT session_id, unnest(range(len(ls)))::INTEGER AS turn, unnest(ls) AS line FROM l),
t AS (SELECT session_id, turn, nullif(regexp_extract(line, '^\s*([^:]{1,40}):\s', 1), '') AS speaker, CASE WHEN regexp_matches(line, '^\s*[^:]{1,40}:\s') THEN regexp_replace(line, '^\s*[^:]{1,40}:\s+', '') ELSE line END AS said FROM t0)"""


def _turns(spark, d):
    return conversation.turns(table(spark, d, "rendered_sessions"))


@query(f"WITH {_TURN} SELECT session_id, turn, speaker, length(said)::INTEGER AS n_chars FROM t")
def session_turns(spark, d):
    return _turns(spark, d).select("session_id", "turn", "speaker", F.length("said").alias("n_chars"))


@query(f"""WITH {_TURN}, n AS (SELECT session_id, count(*) AS n FROM t GROUP BY 1), s AS (SELECT session_id, n, unnest(list_distinct(list_concat(range(0, greatest(n - 3, 1), 3), CASE WHEN (greatest(n - 4, 0) // 3) * 3 + 4 < n THEN [n - 4] ELSE [] END))) AS st FROM n)
SELECT s.session_id || ':w' || CASE WHEN length(st::VARCHAR) < 2 THEN lpad(st::VARCHAR, 2, '0') ELSE st::VARCHAR[1:2] END AS doc_id, s.session_id, st::INTEGER AS turn_start, count(*) AS n_turns FROM s JOIN t ON t.session_id = s.session_id AND turn >= st AND turn < st + 4 GROUP BY ALL""")
def episode_windows(spark, d):
    return conversation.episodes(_turns(spark, d)).select("doc_id", "session_id", "turn_start", "n_turns")


ORACLE["episode_windows"] = ORACLE["episode_windows"].replace("ELSE st::VARCHAR[1:2] END", "ELSE st::VARCHAR END")


@query(f"""WITH {_TURN}, p AS (SELECT session_id, turn, speaker AS name FROM t WHERE speaker IS NOT NULL), w AS (SELECT a.session_id, a.turn, min(b.name) AS person, count(DISTINCT b.name) AS n FROM p a JOIN p b ON a.session_id = b.session_id AND b.turn BETWEEN a.turn - 3 AND a.turn GROUP BY 1, 2)
SELECT session_id, turn, person FROM w WHERE n = 1""")
def recency_people(spark, d):
    return conversation.recent_people(_turns(spark, d).where("speaker is not null").select("session_id", "turn", F.col("speaker").alias("name")))


@query()
def first_person_turns(spark, d):
    return conversation.first_person(_turns(spark, d))


def _vocab(spark, d):
    e = table(spark, d, "entities").dropDuplicates(["canon_id"])
    return e.select(F.col("canon_id").alias("key"), F.lit(None).cast("string").alias("code"), "canonical", F.col("type").alias("kind"), "aliases")


def _links(spark, d):
    return linking.link(table(spark, d, "mentions").select("mention_id", "type", "text").distinct(), _vocab(spark, d), {"person": "person", "organization": "organization"})


_FOLD = "trim(regexp_replace(replace(replace(lower(strip_accents({0})), 'ß', 'ss'), 'ς', 'σ'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')"
_LINK = f"""e AS (SELECT DISTINCT ON (canon_id) * FROM entities), nm AS (SELECT {_FOLD.format('canonical')} AS x, min(canon_id) AS k FROM e GROUP BY 1), al AS (SELECT {_FOLD.format('a')} AS x, min(canon_id) AS k FROM (SELECT canon_id, unnest(aliases) AS a FROM e) GROUP BY 1),
m AS (SELECT DISTINCT mention_id, type, text FROM mentions), j AS (SELECT m.*, coalesce(nm.k, al.k) AS k0, CASE WHEN nm.k IS NOT NULL THEN 'name' WHEN al.k IS NOT NULL THEN 'alias' END AS h0 FROM m LEFT JOIN nm ON nm.x = {_FOLD.format('m.text')} AND nm.x <> '' LEFT JOIN al ON al.x = {_FOLD.format('m.text')} AND al.x <> ''),
lk AS (SELECT j.mention_id, j.type, j.text, CASE WHEN j.type IN ('person', 'organization') AND e.type <> j.type THEN NULL ELSE k0 END AS key, CASE WHEN j.type IN ('person', 'organization') AND e.type <> j.type THEN NULL ELSE h0 END AS how FROM j LEFT JOIN e ON e.canon_id = k0)"""


@query(f"WITH {_LINK} SELECT mention_id, type, text, key, how FROM lk")
def gazetteer_link(spark, d):
    return _links(spark, d).select("mention_id", "type", "text", "key", "how")


@query(f"WITH {_LINK} SELECT count(*) AS considered, count(key) AS linked, count(*) FILTER (how = 'name') AS by_name, count(*) FILTER (how = 'alias') AS by_alias, count(DISTINCT key) AS keys FROM lk")
def gazetteer_coverage(spark, d):
    return linking.coverage(_links(spark, d)).select("considered", "linked", "by_name", "by_alias", "keys")


@query("""WITH g AS (SELECT canon_id, unnest(list_append(coalesce(aliases, []), canonical)) AS t FROM (SELECT DISTINCT ON (canon_id) * FROM entities)), u AS (SELECT t, min(canon_id) AS gold FROM (SELECT DISTINCT canon_id, t FROM g) GROUP BY 1 HAVING count(*) = 1)
SELECT DISTINCT mention_id, gold FROM mentions JOIN u ON u.t = trim(text, ' ')""")
def gold_labels(spark, d):
    e = table(spark, d, "entities").dropDuplicates(["canon_id"]).select(F.col("canon_id").alias("group_id"), F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("canonical")).alias("names"))
    return linking.gold_by_alias(table(spark, d, "mentions"), e).distinct()


@query("""WITH m AS (SELECT DISTINCT ON (mention_id) doc_id, mention_id, type, span_start FROM mentions WHERE span_start IS NOT NULL) SELECT a.mention_id, b.mention_id AS other FROM m a JOIN m b ON a.doc_id = b.doc_id AND abs(a.span_start - b.span_start) <= 30 AND a.mention_id < b.mention_id""")
def tolerance_join(spark, d):
    m = table(spark, d, "mentions").where("span_start is not null").dropDuplicates(["mention_id"])
    l, r = m.select("doc_id", "mention_id", "span_start"), m.select("doc_id", F.col("mention_id").alias("other"), "span_start")
    return linking.spans_within(l, r, ["doc_id"], "span_start", 30).where("mention_id < other").select("mention_id", "other")


@query("""WITH m AS (SELECT DISTINCT ON (mention_id) doc_id, mention_id, type, span_start FROM mentions WHERE span_start IS NOT NULL), p AS (SELECT a.mention_id, b.mention_id AS other, row_number() OVER (PARTITION BY a.mention_id ORDER BY abs(a.span_start - b.span_start), b.mention_id) AS rn
FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.type = b.type AND abs(a.span_start - b.span_start) <= 200 AND a.mention_id <> b.mention_id) SELECT mention_id, other FROM p WHERE rn = 1""")
def nearest_mention(spark, d):
    m = table(spark, d, "mentions").where("span_start is not null").dropDuplicates(["mention_id"])
    l, r = m.select("doc_id", "type", "mention_id", "span_start"), m.select("doc_id", "type", F.col("mention_id").alias("other"), "span_start")
    near = linking.spans_within(l, r, ["doc_id", "type"], "span_start", 200).where("mention_id <> other")
    return graph.top_per_group(near, ["mention_id"], [F.abs(F.col("span_start") - F.col("r_at")), F.col("other")], 1).select("mention_id", "other")


@query()
def mentions_in_sentences(spark, d):
    m = table(spark, d, "mentions").dropDuplicates(["mention_id"]).select("doc_id", "mention_id", "span_start", "span_end")
    return linking.contained(m, texts.sentences(table(spark, d, "documents"))).select("mention_id", "doc_id", "unit_no", "unit_start", "unit_end")


@query()
def sentence_chunks(spark, d):
    return texts.sentence_chunks(table(spark, d, "documents"))


_QV = "q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 20 = 0)"


def _query_vectors(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(f"WITH {_QV}, s AS (SELECT query_id, vec_id AS id, (1 + list_cosine_similarity(query::DOUBLE[], embedding::DOUBLE[])) / 2 AS score FROM q, embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 10")
def vector_topk(spark, d):
    return retrieval.vector_topk(table(spark, d, "embeddings"), _query_vectors(spark, d), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_BM = """tx AS (SELECT doc_id AS id, concat_ws(' ', title, text) AS w, CASE WHEN trim(title, ' ') <> '' THEN title ELSE text END AS ask FROM documents),
q AS (SELECT DISTINCT id AS query_id, unnest(list_filter(string_split_regex(lower(ask), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS term FROM tx WHERE id % 20 = 0),
tk AS (SELECT id, list_filter(string_split_regex(lower(w), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ts FROM tx), px AS (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM tk), ps AS (SELECT id, term, dl, count(*) AS tf FROM px GROUP BY ALL),
cs AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT id, dl FROM ps)), df AS (SELECT term, count(*) AS df FROM ps GROUP BY 1),
s AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM ps JOIN q USING (term) JOIN df USING (term), cs GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""


def _bm25(spark, d, k):
    """The documents whose id is divisible by 20, by their title or else their text, against title and text of all."""
    docs = table(spark, d, "documents")
    ix = retrieval.word_index(docs.select("doc_id", F.concat_ws(" ", "title", "text").alias("words")), "doc_id", "words")
    words = F.when(F.trim("title") != "", F.col("title")).otherwise(F.col("text"))
    return retrieval.bm25(ix, docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), words.alias("words")), k)


@query(f"WITH {_BM} SELECT query_id, id, round(score, 5) AS score, rank::INTEGER AS rank FROM rk WHERE rank <= 10")
def bm25_topk(spark, d):
    return _bm25(spark, d, 10).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


@query(f"""WITH {_BM}, {_QV}, v0 AS (SELECT query_id, vec_id AS id, (1 + list_cosine_similarity(query::DOUBLE[], embedding::DOUBLE[])) / 2 AS score FROM (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 20 = 0), embeddings),
v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM v0), x AS (SELECT query_id, id, score / max(score) OVER (PARTITION BY query_id) AS x FROM v WHERE rank <= 50), y AS (SELECT query_id, id, score / max(score) OVER (PARTITION BY query_id) AS y FROM rk WHERE rank <= 50),
h AS (SELECT query_id, id, 0.5 * coalesce(x, 0) + 0.5 * coalesce(y, 0) AS score FROM x FULL JOIN y USING (query_id, id)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM h) SELECT query_id, id, round(score, 5) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 10""".replace(f", {_QV}", ""))
def hybrid_topk(spark, d):
    words = _bm25(spark, d, 50)
    vec = retrieval.vector_topk(table(spark, d, "embeddings"), _query_vectors(spark, d), 50)
    return retrieval.hybrid(vec, words, 0.5, 10).withColumn("score", F.round("score", 5))


@query()
def facts_of_hits(spark, d):
    m = linking.gold_by_alias(table(spark, d, "mentions"), table(spark, d, "entities").select(F.col("canon_id").alias("group_id"), F.array("canonical").alias("names")))
    m = m.join(table(spark, d, "mentions").select("mention_id", "doc_id").distinct(), "mention_id").select("doc_id", F.col("gold").alias("canon_id"))
    return retrieval.facts_of_hits(_bm25(spark, d, 10), m, _facts(spark, d), 5)


@query("""SELECT canon_id, type || ': ' || canonical || CASE WHEN len(aliases) > 0 THEN ' (also known as ' || array_to_string(list_sort(aliases), ', ') || ')' ELSE '' END AS text FROM (SELECT DISTINCT ON (canon_id) * FROM entities)""")
def entity_texts(spark, d):
    return retrieval.entity_text(table(spark, d, "entities").dropDuplicates(["canon_id"]))


@query("""WITH p AS (SELECT DISTINCT a, b, block FROM scored_pairs WHERE a IS NOT NULL AND b IS NOT NULL AND score >= 0.8 AND block IN ('exact', 'alias')) SELECT a, b FROM p GROUP BY 1, 2 HAVING count(DISTINCT block) = 2""")
def pass_agreement(spark, d):
    p = table(spark, d, "scored_pairs").where("a is not null and b is not null and score >= 0.8 and block in ('exact', 'alias')")
    return judgments.agreed(p.withColumn("pass_no", F.col("block")), ["a", "b"], 2)


@query("""SELECT CASE WHEN score >= 0.9 THEN 'merge' WHEN score <= 0.5 THEN 'keep_apart' ELSE 'review' END AS route, count(*) AS n, round(avg(score), 6) AS mean FROM scored_pairs WHERE score IS NOT NULL GROUP BY 1""")
def route_levels(spark, d):
    return table(spark, d, "scored_pairs").where("score is not null").groupBy(judgments.route(F.col("score"), 0.5, 0.9).alias("route")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query("""WITH f AS (SELECT a, b, min(score) AS p FROM scored_pairs WHERE a IS NOT NULL AND b IS NOT NULL AND score IS NOT NULL GROUP BY 1, 2), s AS (SELECT a, b, max(embed) AS q FROM scored_pairs WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2)
SELECT a, b, CASE WHEN p BETWEEN 0.6 AND 0.9 THEN coalesce(q, p) ELSE p END AS p, (p BETWEEN 0.6 AND 0.9 AND q IS NOT NULL) AS escalated FROM f LEFT JOIN s USING (a, b)""")
def judgment_cascade(spark, d):
    p = table(spark, d, "scored_pairs").where("a is not null and b is not null")
    fast = p.where("score is not null").groupBy("a", "b").agg(F.min("score").alias("p"))
    slow = p.groupBy("a", "b").agg(F.max("embed").alias("p"))
    return judgments.cascade(fast, slow, ["a", "b"], 0.6, 0.9).select("a", "b", "p", "escalated")


@query(f"WITH {_F} SELECT episode_id, fact_id, (row_number() OVER (PARTITION BY episode_id ORDER BY fact_id) - 1)::INTEGER // 2 AS batch_no FROM f")
def question_batches(spark, d):
    return judgments.question_batches(_facts(spark, d), "episode_id", "fact_id", 2).select("episode_id", "fact_id", "batch_no")


@query("""WITH c AS (SELECT session_id, count(*) AS n, sum(length(coalesce(channel, ''))) AS z FROM lookups GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, session_id) AS k FROM c) SELECT k::INTEGER AS k, session_id, sum(n) OVER (ORDER BY k)::BIGINT AS cumulative FROM r""")
def escalation_curve(spark, d):
    from ledgraph.operators.ranking import numbered

    c = table(spark, d, "lookups").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    r = numbered(c.withColumn("one", F.lit(1)), ["one"], [F.col("n").desc(), F.col("session_id")], -F.col("n"), "k")
    per = r.groupBy("n").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum(F.col("n") * F.col("m")).over(W.orderBy(F.col("n").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.select("n", "first", before.alias("before"))
    return r.join(per, "n").select(F.col("k").cast("int").alias("k"), "session_id", (F.col("before") + F.col("n") * (F.col("k") - F.col("first") + 1)).cast("long").alias("cumulative"))


@query("SELECT kind, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY 1")
def pivot_status(spark, d):
    p = table(spark, d, "documents").groupBy("kind").pivot("lang", ["en", "de", "fr"]).agg(F.count(F.lit(1)))
    return p.fillna(0).select("kind", "en", "de", "fr")


@query("SELECT relation, count(*) AS n, min(confidence) AS lo, max(confidence) AS hi, round(avg(confidence), 6) AS mean, round(stddev_samp(confidence), 6) AS sd FROM facts GROUP BY 1")
def confidence_stats(spark, d):
    c = F.col("confidence")
    return table(spark, d, "facts").groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("sd"))


@query("""WITH m AS (SELECT doc_id, count(DISTINCT mention_id) AS n FROM mentions GROUP BY 1), e AS (SELECT CAST(ltrim(substr(episode_id, 2), '0') AS BIGINT) AS doc_id, count(DISTINCT fact_id) AS k FROM facts GROUP BY 1) SELECT doc_id, n, coalesce(k, 0) AS k, round(coalesce(k, 0) / n, 6) AS ratio FROM m LEFT JOIN e USING (doc_id)""")
def escalation_score(spark, d):
    m = table(spark, d, "mentions").groupBy("doc_id").agg(F.countDistinct("mention_id").alias("n"))
    e = table(spark, d, "facts").groupBy(F.substring("episode_id", 2, 20).cast("long").alias("doc_id")).agg(F.countDistinct("fact_id").alias("k"))
    return m.join(e, "doc_id", "left").select("doc_id", "n", F.coalesce("k", F.lit(0)).alias("k"), F.round(F.coalesce("k", F.lit(0)) / F.col("n"), 6).alias("ratio"))


@query("""WITH f AS (SELECT head, min(episode_id) AS first FROM facts GROUP BY 1), x AS (SELECT DISTINCT head, episode_id FROM facts) SELECT episode_id, count(*) FILTER (first = episode_id) AS n_new, count(*) FILTER (first <> episode_id) AS n_known FROM x JOIN f USING (head) GROUP BY 1""")
def new_and_known(spark, d):
    f = table(spark, d, "facts").where("head is not null")
    first = f.groupBy("head").agg(F.min("episode_id").alias("first"))
    return f.select("head", "episode_id").distinct().join(first, "head").groupBy("episode_id").agg(F.count_if(F.col("first") == F.col("episode_id")).alias("n_new"), F.count_if(F.col("first") != F.col("episode_id")).alias("n_known"))


@query("""SELECT t AS cut, count(*) FILTER (least(fuzz, embed, context) >= t) AS auto, count(*) FILTER (least(fuzz, embed, context) >= t AND score < 0.9) AS errors FROM scored_pairs, (SELECT unnest([0.2, 0.4, 0.6, 0.8])::DOUBLE AS t) WHERE score IS NOT NULL GROUP BY 1""")
def confidence_routing(spark, d):
    p = table(spark, d, "scored_pairs").where("score is not null").select("score", F.least("fuzz", "embed", "context").alias("w"))
    x = p.select("score", "w", F.explode(F.array(*[F.lit(c) for c in (0.2, 0.4, 0.6, 0.8)])).alias("cut"))
    return x.groupBy("cut").agg(F.count_if(F.col("w") >= F.col("cut")).alias("auto"), F.count_if((F.col("w") >= F.col("cut")) & (F.col("score") < 0.9)).alias("errors"))


@query("SELECT head, relation, tail, confidence, rank::INTEGER AS rank FROM (SELECT head, relation, tail, confidence, row_number() OVER (PARTITION BY head ORDER BY confidence DESC, fact_id) AS rank FROM (SELECT DISTINCT ON (fact_id) * FROM facts)) WHERE rank <= 3")
def top_per_group(spark, d):
    return graph.top_per_group(_facts(spark, d), ["head"], [F.col("confidence").desc(), F.col("fact_id")], 3).select("head", "relation", "tail", "confidence", "rank")
