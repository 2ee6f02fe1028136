"""Slots where a model is called, and what its answers become: mentions, edges, labels, kept or dropped and counted.

A slot takes a callable over Arrow batches, so one model is loaded for each worker and asked in batches; no weights are
shipped. `RuleExtractor` is the one that works without a model.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgraph.functions.names import casefold, context_window, label_key

MENTION = "struct<local_id:string,type:string,text:string,span_start:int,span_end:int,confidence:double>"
RELATION = "struct<type:string,head:string,tail:string,confidence:double>"
EXTRACTED = f"doc_id bigint, mentions array<{MENTION}>, edges array<{RELATION}>"


def extract(docs: DataFrame, call: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """(doc_id, mentions, edges) of documents (doc_id, text): what the model found. Null texts aren't asked."""
    return docs.where("text is not null").select("doc_id", "text").mapInArrow(call, EXTRACTED)


def too_long(docs: DataFrame, most: int = 400) -> DataFrame:
    """`docs` with n_words and too_long: texts of more words than a model should get in one piece."""
    n = F.when(F.trim("text") == "", 0).otherwise(F.size(F.split(F.trim("text"), r"\s+")))
    return docs.withColumn("n_words", F.coalesce(n, F.lit(0))).withColumn("too_long", F.col("n_words") > most)


def word_chunks(docs: DataFrame, size: int = 384, overlap: int = 64) -> DataFrame:
    """(doc_id, chunk_no, chunk_start, text): runs of `size` words that overlap by `overlap`, with their place in the text; a short text is one chunk."""
    schema = pa.schema([("doc_id", pa.int64()), ("chunk_no", pa.int32()), ("chunk_start", pa.int32()), ("text", pa.string())])

    def run(batches):
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans = [m.span() for m in re.finditer(r"\S+", t)]
                for no, lo in enumerate(range(0, max(1, len(spans) - overlap), size - overlap)):
                    part = spans[lo : lo + size]
                    if part:
                        for c, v in zip(cols, (d, no, part[0][0], t[part[0][0] : part[-1][1]])):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return docs.where("text is not null").select("doc_id", "text").mapInArrow(run, "doc_id bigint, chunk_no int, chunk_start int, text string")


class RuleExtractor:
    """Finds the names of a vocabulary (name, type) in texts, and a relation wherever two of them stand in one sentence with a cue between.

    `cues` maps a word sequence to a relation. The vocabulary is that of an ontology's registry and is sent to the
    workers, so it must be small: at most `most` names.
    """

    def __init__(self, names: list[tuple[str, str]], cues: dict[str, str], most: int = 100_000):
        if len(names) > most:
            raise ValueError(f"more than {most} names; link them by joins instead")
        self.types = {n.casefold(): t for n, t in names if n}
        self.cues = cues

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        words = [m.span() for m in re.finditer(r"\w[\w'&.-]*\w|\w", text)]
        longest = max((len(n.split()) for n in self.types), default=0)
        out, i = [], 0
        while i < len(words):
            for n in range(min(longest, len(words) - i), 0, -1):
                lo, hi = words[i][0], words[i + n - 1][1]
                kind = self.types.get(text[lo:hi].casefold())
                if kind:
                    out.append((lo, hi, kind))
                    i += n
                    break
            else:
                i += 1
        return out

    def __call__(self, batches):
        for b in batches:
            docs, ments, edges = [], [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = self.spans(t)
                docs.append(d)
                ments.append([{"local_id": f"e{i}", "type": k, "text": t[lo:hi], "span_start": lo, "span_end": hi, "confidence": None} for i, (lo, hi, k) in enumerate(found, 1)])
                rel = []
                for i, (x, y) in enumerate(zip(found, found[1:]), 1):
                    gap = t[x[1] : y[0]]
                    cue = next((c for c in self.cues if c in gap.lower()), None)
                    if cue and not re.search(r"[.!?。！？\n]", gap):
                        rel.append({"type": self.cues[cue], "head": f"e{i}", "tail": f"e{i + 1}", "confidence": None})
                edges.append(rel)
            m = pa.list_(pa.struct([("local_id", pa.string()), ("type", pa.string()), ("text", pa.string()), ("span_start", pa.int32()), ("span_end", pa.int32()), ("confidence", pa.float64())]))
            e = pa.list_(pa.struct([("type", pa.string()), ("head", pa.string()), ("tail", pa.string()), ("confidence", pa.float64())]))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ments, m), pa.array(edges, e)], names=["doc_id", "mentions", "edges"])


def mentions_of(extracted: DataFrame, docs: DataFrame, pad: int = 90) -> DataFrame:
    """(mention_id, doc_id, type, text, span_start, span_end, confidence, context): ids begin with the document's, a missing confidence is 1."""
    m = extracted.select("doc_id", F.inline("mentions")).join(docs.select("doc_id", F.col("text").alias("_t")), "doc_id")
    ctx = F.when(F.col("span_start").isNotNull(), context_window(F.col("_t"), F.col("span_start"), F.col("span_end"), pad)).otherwise("")
    return m.select(F.concat_ws(":", "doc_id", "local_id").alias("mention_id"), "doc_id", "type", "text", "span_start", "span_end", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), ctx.alias("context"))


def edges_of(extracted: DataFrame) -> DataFrame:
    """(doc_id, type, head, tail, confidence): the ends as mention ids."""
    e = extracted.select("doc_id", F.inline("edges"))
    return e.select("doc_id", "type", F.concat_ws(":", "doc_id", "head").alias("head"), F.concat_ws(":", "doc_id", "tail").alias("tail"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


def located(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """`mentions` (doc_id, text, ...) with span_start, span_end where the text first stands in its document; both null where it doesn't."""
    j = mentions.join(docs.select("doc_id", F.col("text").alias("_t")), "doc_id", "left").withColumn("_at", F.expr("instr(_t, text)"))
    found = (F.col("_at") > 0) & (F.length("text") > 0)
    return j.withColumn("span_start", F.when(found, F.col("_at") - 1)).withColumn("span_end", F.when(found, F.col("_at") - 1 + F.length("text"))).drop("_t", "_at")


def judged_labels(entities: DataFrame, relations: DataFrame, types: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a model's labels of chunks come to: entities (chunk_id, type, text, in_text) and relations (chunk_id, type, head, tail) each with `drop`, null where it is kept.

    Entities fall for `unknown type` or `span not in text`; relations for `unknown name`, `endpoint gone` (no kept
    entity of the chunk has that text, whatever the case), `same ends`, `ontology violation`, or `repeated`.
    """
    known = types.select(F.col("name").alias("type")).distinct().withColumn("k", F.lit(True))
    e = entities.join(known, "type", "left").withColumn("drop", F.when(F.col("k").isNull(), "unknown type").when(~F.coalesce("in_text", F.lit(False)), "span not in text")).drop("k")
    ends = e.where("drop is null").groupBy("chunk_id", casefold(F.col("text")).alias("s")).agg(F.min("type").alias("kind"))
    rel = patterns.select("type").distinct().withColumn("k", F.lit(True))
    r = relations.withColumn("h", casefold(F.trim("head"))).withColumn("t", casefold(F.trim("tail"))).join(rel, "type", "left")
    for c in ("h", "t"):
        r = r.join(ends.select("chunk_id", F.col("s").alias(c), F.col("kind").alias(f"{c}_kind")), ["chunk_id", c], "left")
    legal = patterns.select("type", F.col("head_type").alias("h_kind"), F.col("tail_type").alias("t_kind")).distinct().withColumn("ok", F.lit(True))
    r = r.join(legal, ["type", "h_kind", "t_kind"], "left")
    why = F.when(F.col("k").isNull(), "unknown name").when(F.col("h_kind").isNull() | F.col("t_kind").isNull(), "endpoint gone").when(F.col("h") == F.col("t"), "same ends").when(F.col("ok").isNull(), "ontology violation")
    r = r.withColumn("drop", why).withColumn("rn", F.row_number().over(W.partitionBy("chunk_id", "type", "h", "t", "drop").orderBy("head", "tail")))
    r = r.withColumn("drop", F.when(F.col("drop").isNull() & (F.col("rn") > 1), "repeated").otherwise(F.col("drop")))
    return e, r.select("chunk_id", "type", "head", "tail", "drop")


def label_stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(what, drop, n): labels kept (drop null) and dropped by reason, from `judged_labels`."""
    one = lambda d, w: d.groupBy("drop").agg(F.count(F.lit(1)).alias("n")).select(F.lit(w).alias("what"), "drop", "n")
    return one(entities, "entity").unionByName(one(relations, "relation"))


def empty_chunks(chunks: DataFrame, relations: DataFrame, one_in: int) -> DataFrame:
    """Chunks without a kept relation, one in `one_in` of them by the hash of the id: negatives for training, the same on every run."""
    none = chunks.join(relations.where("drop is null").select("chunk_id").distinct(), "chunk_id", "left_anti")
    return none.where(F.expr(f"pmod(xxhash64(chunk_id), {one_in}) = 0"))


def mapped_types(mentions: DataFrame, label_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions of a tagger of its own labels under those of `label_map` (label, name); and (label, n) of labels that have none."""
    m = label_map.groupBy(label_key(F.col("label")).alias("_k")).agg(F.min("name").alias("_n"))
    j = mentions.withColumn("_k", label_key(F.col("type"))).join(m, "_k", "left")
    missing = j.where("_n is null").groupBy(F.col("type").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return j.where("_n is not null").withColumn("type", F.col("_n")).drop("_k", "_n"), missing


def asked_once(questions: DataFrame, keys: list[str], call, schema: str) -> DataFrame:
    """`questions` with a model's answer, each distinct (`keys`) asked once; `schema` holds the keys and the answer's columns."""
    return questions.join(questions.select(*keys).distinct().mapInArrow(call, schema), keys, "left")


def pair_judgments(pairs: DataFrame, call, threshold: float = 0.5) -> DataFrame:
    """(a, b, p, alternative): a symmetric judge's answers on pairs, each unordered one asked once; the table is the log of its decisions.

    `call` gets (a, b) with a < b and gives (a, b, p).
    """
    q = pairs.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return q.mapInArrow(call, "a string, b string, p double").withColumn("alternative", F.col("p") >= threshold)


def picked(answers: DataFrame, least: float = 0.95) -> DataFrame:
    """(doc_id, type, head, tail, confidence): edges of a selection's answers (doc_id, type, head, tail, p) that reach `least`, each once."""
    return answers.where(F.col("p") >= least).groupBy("doc_id", "type", "head", "tail").agg(F.max("p").alias("confidence"))


def likeliest(answers: DataFrame, probs: str = "probs", least: float = 0.0) -> DataFrame:
    """`answers` with label, p and alternatives: of a map label -> p the greatest, ties to the smaller label, and the others of `least` or more in order."""
    ranked = F.array_sort(F.transform(F.map_entries(probs), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("label"))))
    a = answers.withColumn("_r", ranked)
    return a.withColumn("label", F.get("_r", F.lit(0))["label"]).withColumn("p", -F.get("_r", F.lit(0))["n"]).withColumn(
        "alternatives", F.transform(F.filter(F.slice("_r", 2, F.greatest(F.size("_r"), F.lit(1))), lambda x: -x["n"] >= least), lambda x: x["label"])
    ).drop("_r")


def accuracy(predicted: DataFrame, gold: DataFrame, key: str, label: str) -> DataFrame:
    """One row: n, right, accuracy of labels of the keys both have."""
    j = predicted.select(key, F.col(label).alias("_p")).join(gold.select(key, F.col(label).alias("_g")), key)
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_p") == F.col("_g")).alias("right")).withColumn("accuracy", F.try_divide("right", "n"))


#: Pronouns that never stand for a cluster.
PRONOUNS = ("i", "me", "my", "mine", "myself", "you", "your", "yours", "he", "him", "his", "she", "her", "hers", "it", "its", "they", "them", "their", "theirs", "we", "us", "our", "ours", "this", "that")


def substituted(docs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(doc_id, text): texts whose later references are replaced by the words of their cluster.

    `clusters` (doc_id, cluster, span_start, span_end) come from a coreference model; a cluster of one span changes
    nothing. It stands for its longest span that is no pronoun, the first of equal ones; a possessive pronoun gets
    `'s`. Spans inside others are left alone, and texts are rewritten from the right, so places stay true.
    """
    spans = clusters.groupBy("doc_id", "cluster").agg(F.sort_array(F.collect_set(F.struct("span_start", "span_end"))).alias("spans")).where("size(spans) > 1")
    by_doc = spans.groupBy("doc_id").agg(F.collect_list("spans").alias("clusters"))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def one(text, groups):
        edits = []
        for g in groups:
            named = [(s["span_start"], s["span_end"]) for s in g]
            cands = [(lo - hi, lo, hi) for lo, hi in named if text[lo:hi].casefold() not in PRONOUNS]
            if cands:
                _, lo, hi = min(cands)
                edits += [(a, b, text[lo:hi]) for a, b in named if text[a:b].casefold() in PRONOUNS]
        last = len(text) + 1
        for a, b, said in sorted(edits, reverse=True):
            if b <= last:
                own = text[a:b].casefold() in ("my", "mine", "your", "yours", "his", "her", "hers", "its", "their", "theirs", "our", "ours")
                text, last = text[:a] + said + ("'s" if own else "") + text[b:], a
        return text

    def run(batches):
        for b in batches:
            got = [one(t, g) if g else t for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], schema=schema)

    return docs.where("text is not null").select("doc_id", "text").join(by_doc, "doc_id", "left").select("doc_id", "text", "clusters").mapInArrow(run, "doc_id bigint, text string")
