"""Model answers as tables: keys and caches, gates, routes, cascades; and slots where a model is called."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgraph.operators.resolution import components
from ledgraph.sources.tables import listing, stage


def cache_key(*parts: Column) -> Column:
    """The content address of a model call."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def through_cache(asked: DataFrame, cache: DataFrame, call: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """Answers of `asked` (cache_key, ...): from `cache`, and from `call` (a mapInArrow function) once for each new key."""
    new = asked.dropDuplicates(["cache_key"]).join(cache.select("cache_key").distinct(), "cache_key", "left_anti")
    fresh = new.mapInArrow(call, schema)
    return cache.select(*fresh.columns).unionByName(fresh)


def gate(edges: DataFrame, judgments: DataFrame, keys: list[str]) -> DataFrame:
    """Edges whose occurrence a judgment keeps (fact and agree)."""
    return edges.join(judgments.where("keep").select(*keys).distinct(), keys, "left_semi")


def best_judgment(judgments: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return judgments.groupBy(*keys).agg(F.max(F.struct(*order)).alias("b")).select(*keys, "b.*")


def cascade(fast: DataFrame, slow: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """The slow model's answer where the fast one's p lies between `low` and `high`, else the fast one's."""
    s = slow.select(*keys, F.col("p").alias("q")).dropDuplicates(keys)
    unsure = F.col("p").between(low, high)
    return fast.join(s, keys, "left").withColumn("escalated", unsure & F.col("q").isNotNull()).withColumn("p", F.when(unsure, F.coalesce("q", "p")).otherwise(F.col("p"))).drop("q")


def question_batches(questions: DataFrame, by: str, order: str, size: int = 24) -> DataFrame:
    """`questions` with batch_no: at most `size` of one document go to a call."""
    rn = F.row_number().over(W.partitionBy(by).orderBy(order))
    return questions.withColumn("batch_no", F.floor((rn - 1) / size).cast("int"))


def agreed(passes: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Keys that each of `n` passes (pass_no) accepted."""
    return passes.select(*keys, "pass_no").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") == n).select(*keys)


def level_score(probs: Column, n: int) -> Column:
    """The expected level, 0 to 1, of an array of probabilities of `n` ordered levels."""
    return F.aggregate(F.transform(probs, lambda p, i: p * i / (n - 1)), F.lit(0.0), lambda a, x: a + x)


def confidence(probs: Column, n: int) -> Column:
    """How far the likeliest level stands above even odds, 0 to 1."""
    return (n * F.array_max(probs) - 1) / (n - 1)


def route(score: Column, reject: float, accept: float) -> Column:
    return F.when(score >= accept, "merge").when(score <= reject, "keep_apart").otherwise("review")


def call_accounting(calls: DataFrame) -> DataFrame:
    return calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.count_if("cached").alias("hits"), F.sum("cost_usd").alias("cost"), F.avg(F.when(~F.col("cached"), F.col("duration_ms"))).alias("mean_ms"))


CALL = "cache_key string, model string, asked_at timestamp, cached boolean, cost_usd double, duration_ms double, answer string"


def record_calls(answers: DataFrame, path: str) -> None:
    """Add answers (CALL) with where they come from to the cache at `path`; a key that is there already isn't written again."""
    spark = answers.sparkSession
    new = answers.select(*[c.split()[0] for c in CALL.split(", ")]).dropDuplicates(["cache_key"])
    if listing(spark, path):
        new = stage(new.join(spark.read.schema(CALL).parquet(path).select("cache_key"), "cache_key", "left_anti"), "calls")
    new.write.mode("append").parquet(path)


def two_questions(judgments: DataFrame, least: float = 0.5) -> DataFrame:
    """`judgments` (p_fact, p_agree) with the flags fact, agrees and keep, which needs both."""
    return judgments.withColumn("fact", F.col("p_fact") >= least).withColumn("agrees", F.col("p_agree") >= least).withColumn("keep", F.col("fact") & F.col("agrees"))


def edges_in_band(judgments: DataFrame, low: float, high: float) -> DataFrame:
    """Judgments of which either probability is unsure."""
    return judgments.where(F.col("p_fact").between(low, high) | F.col("p_agree").between(low, high))


def retyped(mentions: DataFrame, types: DataFrame) -> DataFrame:
    """`mentions` with the type that each distinct (text, type) was judged to have (text, type, new_type), and `changed`."""
    t = types.groupBy("text", "type").agg(F.min("new_type").alias("new_type"))
    j = mentions.join(t, ["text", "type"], "left")
    return j.withColumn("changed", F.coalesce(F.col("new_type") != F.col("type"), F.lit(False))).withColumn("type", F.coalesce("new_type", "type")).drop("new_type")


def applied(members: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(id, cluster): a clustering (id, cluster) after pairs of clusters (a, b) that were judged the same are put together."""
    c = components(verdicts.select("a", "b"))
    j = members.join(c.withColumnRenamed("id", "cluster"), "cluster", "left")
    return j.select("id", F.coalesce("component", "cluster").alias("cluster"))
