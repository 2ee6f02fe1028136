"""Retrieval by vector, by words, by both, and from hits into the graph."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgraph.functions.names import tokens_of
from ledgraph.sources.tables import stage


def cosine(x, y):
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, id, score): exact top `k` of all vectors for each query (query_id, query), score (1 + cos) / 2.

    `queries` is a stated set and is read against all rows; its few rows are broadcast by the planner if it finds
    them small. Each task keeps its own best before the rest is shuffled.
    """
    j = vectors.where(F.col(vec).isNotNull()).join(queries.select("query_id", "query"), F.lit(True)).select("query_id", F.col(id_col).alias("id"), ((1 + cosine(F.col("query"), F.col(vec))) / 2).alias("score"))
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def word_index(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, dl, terms): the hashed words of each document, with repeats; its length counts all of them. Copies are one row, no words none."""
    t = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.transform(tokens_of(F.col(text)), lambda w: F.xxhash64(w)).alias("terms"))
    t = t.where("size(terms) > 0").groupBy("id", F.size("terms").alias("dl")).agg(F.flatten(F.collect_list("terms")).alias("terms"))
    return stage(t, "words")


def bm25(index: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, shard: int = 20_000, block: int = 20_000) -> DataFrame:
    """(query_id, id, score, rank): the exact top `k` of all documents of a `word_index` for queries (query_id, words).

    Each shard of documents meets each block of queries in a task of its own. There a query's words are added up over
    an array of the shard's documents, so that pairs of a query and a document are never rows; what may be among the
    `k` best of the shard goes on.
    """
    n, avgdl = index.agg(F.count(F.lit(1)), F.avg("dl")).first()
    q = queries.select("query_id", F.explode(F.array_distinct(tokens_of(F.col("words")))).alias("w")).select("query_id", F.xxhash64("w").alias("term")).distinct()
    df = index.select(F.explode(F.array_distinct("terms")).alias("term"), "id").join(q.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df.select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    q = stage(q.join(idf, "term").groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("idf").alias("idfs")), "asked")
    shards, blocks = max(1, -(-n // shard)), max(1, -(-q.count() // block))
    l = index.withColumns({"s": F.expr(f"cast(pmod(xxhash64(id), {shards}) as int)"), "q": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    r = q.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), F.expr(f"cast(pmod(xxhash64(query_id), {blocks}) as int)").alias("q"), "query_id", "terms", "idfs")

    def flat(t, name):
        c = t[name].combine_chunks()
        return c.flatten().to_numpy(zero_copy_only=False), np.diff(c.offsets.to_numpy())

    def run(left, right):
        asked, hits, scores = [], [], []
        if left.num_rows and right.num_rows:
            ids, row = np.unique(left["id"].to_numpy(), return_inverse=True)
            size, (terms, sizes), (wanted, per) = len(ids), flat(left, "terms"), flat(right, "terms")
            vocabulary, at, code = np.unique(wanted, return_index=True, return_inverse=True)
            weight = flat(right, "idfs")[0][at] * (k1 + 1)
            known = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
            keep = vocabulary[known] == terms
            cell, tf = np.unique(known[keep] * left.num_rows + np.repeat(np.arange(left.num_rows), sizes)[keep], return_counts=True)
            term, doc = np.divmod(cell, left.num_rows)
            w = weight[term] * tf / (tf + k1 * (1 - b + b * left["dl"].to_numpy()[doc] / avgdl))
            cell, part = np.unique(term * size + row[doc], return_inverse=True)  # an id's texts of several lengths add up
            w, (term, doc) = np.bincount(part, w), np.divmod(cell, size)
            starts, ends = (np.searchsorted(term, np.arange(len(vocabulary)), side).tolist() for side in ("left", "right"))
            dense: dict = {}
            for t, (lo, hi) in enumerate(zip(starts, ends)):
                if hi - lo > size // 16:  # a common word: its weights for all documents
                    dense[t] = np.bincount(doc[lo:hi], w[lo:hi], size)
            code, begin = code.tolist(), 0
            for no, m in zip(right["query_id"].to_pylist(), per.tolist()):
                got = np.zeros(size)
                for t in code[begin : begin + m]:
                    have = dense.get(t)
                    if have is None:
                        got[doc[starts[t] : ends[t]]] += w[starts[t] : ends[t]]
                    else:
                        got += have
                begin += m
                least = np.partition(got, -k)[-k] - 1e-8 if size > k else 0.0  # ties are told apart after rounding
                best = np.flatnonzero((got >= least) & (got > 0))
                asked += [no] * len(best)
                hits += ids[best].tolist()
                scores += got[best].tolist()
        return pa.table({"query_id": pa.array(asked, kind), "id": pa.array(hits, of), "score": pa.array(scores, pa.float64())})

    kind, of = (to_arrow_type(d.schema[c].dataType) for d, c in ((q, "query_id"), (index, "id")))
    got = l.groupBy("s", "q").cogroup(r.groupBy("s", "q")).applyInArrow(run, f"query_id {dict(q.dtypes)['query_id']}, id {dict(index.dtypes)['id']}, score double")
    got = got.withColumn("score", F.round("score", 9))  # copies are equal in whatever order it was summed
    return got.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))).where(F.col("rank") <= k)


def hybrid(a: DataFrame, b: DataFrame, alpha: float | None, k: int) -> DataFrame:
    """Fusion of two hit lists (query_id, id, score), each divided by its query's greatest score.

    Without `alpha` the greater of both counts, else alpha of the first and the rest of the second.
    """
    top = lambda d, n: d.select("query_id", "id", (F.col("score") / F.max("score").over(W.partitionBy("query_id"))).alias(n))
    j = top(a, "x").join(top(b, "y"), ["query_id", "id"], "full").fillna(0.0, ["x", "y"])
    s = F.greatest("x", "y") if alpha is None else alpha * F.col("x") + (1 - alpha) * F.col("y")
    j = j.withColumn("score", F.round(s, 9))
    return j.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def facts_of_hits(hits: DataFrame, mentions: DataFrame, facts: DataFrame, per_hit: int) -> DataFrame:
    """From document hits (query_id, id) over their entities (doc_id, canon_id) to facts, the strongest `per_hit` of each."""
    ents = hits.join(mentions.select(F.col("doc_id").alias("id"), "canon_id").distinct(), "id")
    f = ents.join(facts.select(F.col("head").alias("canon_id"), "fact_id", "support", "confidence").distinct(), "canon_id").select("query_id", "id", "fact_id", "support", "confidence").distinct()
    w = W.partitionBy("query_id", "id").orderBy(F.col("support").desc(), F.col("confidence").desc(), "fact_id")
    return f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_hit)


def entity_text(entities: DataFrame) -> DataFrame:
    """(canon_id, text): what of an entity is embedded, `type: name (also known as ...)`."""
    also = F.array_join(F.array_sort(F.coalesce("aliases", F.array().cast("array<string>"))), ", ")
    return entities.select("canon_id", F.concat(F.col("type"), F.lit(": "), F.col("canonical"), F.when(also != "", F.concat(F.lit(" (also known as "), also, F.lit(")"))).otherwise("")).alias("text"))


def around_hits(hits: DataFrame, mentions: DataFrame, edges: DataFrame, per_hit: int = 10) -> DataFrame:
    """(query_id, id, canon_id, neighbours): each hit's entities with their first `per_hit` neighbours; entities without edges have none."""
    e = hits.select("query_id", "id").distinct().join(mentions.select(F.col("doc_id").alias("id"), "canon_id").distinct(), "id")
    n = edges.select(F.col("head").alias("canon_id"), F.col("tail").alias("n")).unionByName(edges.select(F.col("tail").alias("canon_id"), F.col("head").alias("n"))).distinct()
    n = n.withColumn("rn", F.row_number().over(W.partitionBy("canon_id").orderBy("n"))).where(F.col("rn") <= per_hit)
    n = n.groupBy("canon_id").agg(F.array_sort(F.collect_list("n")).alias("neighbours"))
    return e.join(n, "canon_id", "left").select("query_id", "id", "canon_id", F.coalesce("neighbours", F.array().cast("array<string>")).alias("neighbours"))


def context_subgraph(hits: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, head, type, tail): the edges of which both ends stand in the documents a query hit."""
    e = hits.select("query_id", "id").distinct().join(mentions.select(F.col("doc_id").alias("id"), "canon_id").distinct(), "id").select("query_id", "canon_id").distinct()
    j = edges.select("head", "type", "tail").distinct().join(e.withColumnRenamed("canon_id", "head"), "head")
    return j.join(e.withColumnRenamed("canon_id", "tail"), ["query_id", "tail"], "left_semi").select("query_id", "head", "type", "tail")


#: What a plan that only reads may be made of.
READS = {"Project", "Filter", "Aggregate", "Join", "Sort", "GlobalLimit", "LocalLimit", "SubqueryAlias", "UnresolvedRelation", "With", "CTERelationDef", "UnresolvedWith", "Distinct", "Union", "UnresolvedHaving", "UnresolvedSubqueryColumnAliases", "OneRowRelation", "UnresolvedInlineTable", "Window", "WithWindowDefinition", "Except", "Intersect", "Offset", "LateralJoin", "Generate"}


def reads_only(spark: SparkSession, sql: str, views: set[str]) -> bool:
    """Whether a generated query only reads, and only `views`: its parsed plan is held against lists of what is allowed.

    What can't be parsed, commands, functions that reach outside, and other tables are refused.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception:
        return False
    ctes = {m.lower() for m in re.findall(r"(?i)(?:\bwith|,)\s*(\w+)\s+as\s*\(", sql)}
    if re.search(r"(?i)\b(reflect|java_method|try_reflect|read_files|input_file_name)\b", sql):
        return False
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() not in READS:
            return False
        if node.nodeName() == "UnresolvedRelation" and node.tableName().lower().replace("`", "") not in {v.lower() for v in views} | ctes:
            return False
        for seq in (node.children(), node.innerChildren(), node.subqueries()):
            it = seq.iterator()
            while it.hasNext():
                todo.append(it.next())
    return True


def ask_tables(spark: SparkSession, question: str, write_query: Callable[[str], str], views: set[str], most: int = 100) -> DataFrame:
    """The rows of the query that a model writes for a question, at most `most`; what doesn't only read `views` raises."""
    sql = write_query(question)
    if not reads_only(spark, sql, views):
        raise PermissionError("the generated query isn't a plain read of the views it may use")
    return spark.sql(sql).limit(most)


def routed(questions: DataFrame, tools: dict[str, Callable[[DataFrame], DataFrame]], default: str) -> dict[str, DataFrame]:
    """The answers of each tool to the questions (query_id, question, tool) that a model sent it; unknown tools fall to `default`."""
    named = questions.withColumn("tool", F.when(F.col("tool").isin(list(tools)), F.col("tool")).otherwise(default))
    return {n: f(named.where(F.col("tool") == n)) for n, f in tools.items()}
