"""Filling fixed-capacity containers with documents by lexical retrieval."""

from __future__ import annotations

from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgraph.llm.replay import token_ids
from ledgraph.sources.tables import stage


class Bm25:
    """An inverted index over the documents of one shard; terms are token ids."""

    def __init__(self, terms: list[np.ndarray], k1: float = 1.2, b: float = 0.75):
        n = len(terms)
        lens = np.array([len(t) for t in terms])
        doc = np.repeat(np.arange(n), lens)
        flat = np.concatenate(terms) if n else np.zeros(0, np.int32)
        key, tf = np.unique(flat.astype(np.int64) * max(n, 1) + doc, return_counts=True)
        term, doc = key // max(n, 1), key % max(n, 1)
        vocab, first, df = np.unique(term, return_index=True, return_counts=True)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * lens / max(lens.mean() if n else 1, 1e-9))
        self.weight = (np.repeat(idf, df) * tf * (k1 + 1) / (tf + norm[doc])).astype(np.float32)
        self.doc, self.first, self.n = doc.astype(np.int32), np.append(first, len(doc)), n
        order = np.lexsort((term, doc))
        self.row = np.searchsorted(vocab, term)[order]  # the terms of each document, distinct
        self.row_first = np.searchsorted(doc[order], np.arange(n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every document of the shard for all distinct terms of `seed`."""
        rows = self.row[self.row_first[seed] : self.row_first[seed + 1]]
        lo, hi = self.first[rows], self.first[rows + 1]
        size = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


def fill(sizes: list[int], terms: list[np.ndarray], capacity: int) -> list[int]:
    """The container number of each item; sizes must be 1..capacity.

    The largest unused item seeds a container. Its BM25 neighbours are taken in order of score while they fit;
    what then still fits is added largest first, so space stays unused only where no unused item fits.
    """
    index, n = Bm25(terms), len(sizes)
    size = np.array(sizes)
    unused = np.ones(n, bool)
    by_size = sorted((s, -i) for i, s in enumerate(sizes))
    where, number = [-1] * n, 0

    def take(i):
        unused[i] = False
        where[i] = number
        del by_size[bisect_right(by_size, (sizes[i], -i)) - 1]
        return sizes[i]

    while by_size:
        seed = -by_size[-1][1]
        room = capacity - take(seed)
        if by_size and by_size[0][0] <= room:
            score = index.scores(seed)
            near = np.flatnonzero(unused & (size <= room) & (score > 0))
            near = near[np.lexsort((near, -score[near]))]
            while len(near):
                room -= take(int(near[0]))
                near = near[1:]
                near = near[size[near] <= room]
            while by_size and by_size[0][0] <= room:
                room -= take(-by_size[bisect_right(by_size, (room, 1)) - 1][1])
        number += 1
    return where


PACKED = "container_id string, doc_id long, piece_no int, first_token int, n_tokens int"


def pack(docs: DataFrame, capacity: int = 2048, shard_docs: int = 4000, path: str | None = None) -> DataFrame:
    """(container_id, doc_id, piece_no, first_token, n_tokens): every token of every text in exactly one container.

    A text over `capacity` tokens is cut into pieces of `capacity` tokens and a rest; full pieces fill containers
    of their own and the rest is packed as an item. No other text is split. A null or empty text has 0 tokens and
    is given the container_id `none`; repeated texts are items of their own. Documents are spread by the hash of
    their id over shards of about `shard_docs`, each with its own index, so one shard is a bounded task and the
    unused space is at most one container in a shard, over what the sizes force.
    """
    ids = token_ids(docs, "doc_id", "text", path)
    items = ids.select("doc_id", F.size("ids").alias("n"), F.expr(f"slice(ids, 1 + {capacity} * (size(ids) div {capacity}), {capacity})").alias("rest"))
    items = stage(items, "items")
    shards = max(1, -(-items.count() // shard_docs))
    whole = items.where(f"n >= {capacity}").select("doc_id", F.explode(F.expr(f"sequence(0, (n div {capacity}) - 1)")).alias("piece_no"))
    whole = whole.select(
        F.concat_ws(":", F.lit("full"), "doc_id", "piece_no").alias("container_id"), "doc_id", F.col("piece_no").cast("int").alias("piece_no"),
        (F.col("piece_no") * capacity).cast("int").alias("first_token"), F.lit(capacity).alias("n_tokens"),
    )
    nothing = items.where("n = 0").select(F.lit("none").alias("container_id"), "doc_id", F.lit(0).alias("piece_no"), F.lit(0).alias("first_token"), F.lit(0).alias("n_tokens"))

    def one(key, t):
        t = t.sort_by("doc_id")
        doc, n = t["doc_id"].to_pylist(), t["n"].to_pylist()
        terms = [np.asarray(x.values) for x in t["rest"]]
        sizes = [len(x) for x in terms]
        got = fill(sizes, terms, capacity)
        part = key[0].as_py()
        whole_pieces = [x // capacity for x in n]
        return pa.Table.from_pydict({
            "container_id": [f"{part}:{g}" for g in got], "doc_id": pa.array(doc, pa.int64()), "piece_no": pa.array(whole_pieces, pa.int32()),
            "first_token": pa.array([w * capacity for w in whole_pieces], pa.int32()), "n_tokens": pa.array(sizes, pa.int32()),
        })

    rest = items.where("size(rest) > 0").withColumn("shard", F.expr(f"cast(pmod(xxhash64(doc_id), {shards}) as int)"))
    packed = rest.groupBy("shard").applyInArrow(one, PACKED)
    return packed.unionByName(whole).unionByName(nothing)


def fill_rate(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, and the share of their space that is unused."""
    used = packed.where("n_tokens > 0").groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    one = used.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.max("used").alias("fullest"))
    return one.withColumn("unused_share", F.when(F.col("containers") > 0, F.round(1 - F.col("tokens") / (F.col("containers") * capacity), 6)))
