"""Facts and mentions as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgraph.operators.facts import fold_stream
from ledgraph.operators.registry import REGISTRY, add_episode
from ledgraph.sources.tables import listing

CHANGES = "head string, relation string, tail string, valid_from timestamp, fact_id string, replaced string"


def value_changes(stream: DataFrame) -> DataFrame:
    """The changes of single-valued (head, relation) of a stream of facts; the state is one value for each key."""
    s = stream.where("head is not null and relation is not null").select("head", "relation", "tail", "fact_id", F.coalesce("valid_from", "recorded_at").cast("timestamp").alias("start")).where("start is not null")
    return s.groupBy("head", "relation").applyInPandasWithState(fold_stream, CHANGES, "tail string, start long, fact_id string", "append", "NoTimeout")


def resolve_batches(stream: DataFrame, registry_path: str, threshold: float = 0.9):
    """A stream writer that adds each micro-batch of mentions to a registry and writes the registry's next snapshot.

    Batch n reads `registry_path/v=<n - 1>`, an empty registry where there is none, and writes `v=<n>` and the map of
    its mentions `map/v=<n>`, so a batch that is run again gives the same snapshot. The episode is the batch's number.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        have = listing(spark, registry_path)
        old = spark.read.schema(REGISTRY).parquet(f"{registry_path}/v={number - 1}") if f"v={number - 1}" in have else spark.createDataFrame([], REGISTRY)
        new, mapped = add_episode(old, batch, f"{number:09d}", threshold)
        mapped.write.mode("overwrite").parquet(f"{registry_path}/map/v={number}")
        new.write.mode("overwrite").parquet(f"{registry_path}/v={number}")

    return stream.writeStream.foreachBatch(step)
