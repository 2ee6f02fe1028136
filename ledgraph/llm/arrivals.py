"""Deduplicating new batches against all history by content-defined chunks.

A rolling hash over the letters of a name sets chunk boundaries, so an edit changes the chunks around it only. A
persistent table maps chunk keys to the records that hold them, another counts them, a third holds the records. A new
batch looks its own keys up in the counts, follows the rare ones to the records that share them, and decides by the
share of bytes in common chunks, which an exact check of the words follows. Its records, chunks and counts are added
as one more part; nothing that was written before is touched.
"""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgraph.llm.arrow import rows
from ledgraph.llm.folding import within, words
from ledgraph.operators.components import connected_groups
from ledgraph.sources.tables import filesystem, listing, shared_dir, stage, staging

#: Boundaries are set once for each seed; a chunk has LEAST to MOST letters, and one in ONE_IN letters ends one.
SEEDS, LEAST, MOST, ONE_IN = (31, 57, 101, 211, 17, 73, 131, 257), 3, 14, 4
#: The share of a new record's bytes that must be common, and by how many letters two spellings may differ in length.
COVER, EDITS = 0.4, 2
#: Up to so many links one task gives the labels.
LINKS = 200_000
_ARTICLES = ("the", "a", "an")


def form_of(kind: str, text: str) -> str:
    """The words of a name in order, folded; articles and a first word that only repeats the type are left out."""
    got = words(text)
    while len(got) > 1 and got[0] in _ARTICLES:
        got = got[1:]
    for i, w in enumerate(got):
        if len(got) > 1 and len(w) > 4 and within(w, kind, 1) <= 1:
            return " ".join(got[:i] + got[i + 1 :])
    if got and len(got[0]) > len(kind) + 3 and got[0].startswith(kind) and len(kind) > 4:
        got = [got[0][len(kind) :], *got[1:]]
    return " ".join(got)


@lru_cache(100_000)
def number_of(form: str) -> str:
    """The numbers of a name in order of size, each with a letter that belongs to it."""
    found = re.findall(r"(\d+)([^\W\d_]*)", form)
    return " ".join(sorted(n + (x if len(x) == 1 else "") for n, x in found))


@lru_cache(100_000)
def bare_of(form: str) -> list[str]:
    """The words of a form without its numbers."""
    out = [re.sub(r"\d+[^\W\d_]$|\d+", "", w) for w in form.split()]
    return [w for w in out if w]


class _Ends(dict):
    """For `str.translate`: 1 for a letter after which a seed's rolling hash ends a chunk, else 0."""

    def __init__(self, seed: int):
        self.seed = seed

    def __missing__(self, c: int) -> str:
        got = self[c] = "1" if ((c * self.seed * 2654435761 + self.seed * 40503 & 0xFFFFFFFF) >> 15) % ONE_IN == 0 else "0"
        return got


_ENDS = [_Ends(s) for s in SEEDS]


def chunks(text: str) -> dict[str, int]:
    """The distinct chunks by all seeds' boundaries, each with the seeds that cut it as bits; an empty text is one empty chunk."""
    out: dict[str, int] = {}
    last = len(text) - LEAST
    for no, table in enumerate(_ENDS):
        ends, start, bit = text.translate(table).find, 0, 1 << no
        while start + LEAST <= last:
            at = ends("1", start + LEAST - 1, min(last, start + MOST - 1)) + 1 or start + MOST
            if at > last:
                break
            c = text[start:at]
            out[c] = out.get(c, 0) | bit
            start = at
        c = text[start:]
        out[c] = out.get(c, 0) | bit
    return out


def _near(a: list[str], b: list[str]) -> bool:
    total = 0
    for x, y in zip(a, b):
        d = within(x, y, 2)
        if d > (0 if min(len(x), len(y)) <= 2 else 1 if min(len(x), len(y)) < 7 else 2):
            return False
        total += d
    return total <= 2


def same(a: str, b: str) -> bool:
    """Whether two forms write one name: equal numbers, and words that differ by few typos, order or joins only."""
    if number_of(a) != number_of(b):
        return False
    x, y = bare_of(a), bare_of(b)
    if sorted(x) == sorted(y) or "".join(x) == "".join(y):
        return True
    if len(x) == len(y):
        if _near(x, y) or _near(x[1:] + x[:1], y) or _near(x[-1:] + x[:-1], y) or _near(sorted(x), sorted(y)):
            return True
        return False
    few, many = sorted((x, y), key=len)
    left = list(few)
    extra = [w for w in many if not (w in left and (left.remove(w) or True))]
    if not left and extra:  # a word more tells them apart
        return False
    if len("".join(many)) < 8:
        return False
    return any(within("".join(v), "".join(many), 1) <= 1 for v in (few, few[1:] + few[:1], few[-1:] + few[:-1]))


def _forms(kinds, texts):
    for k, t in zip(kinds, texts):
        f = form_of(k, t)
        if f:
            yield k, t, f


def _with_forms(told: DataFrame) -> DataFrame:
    """`told` (id, b, type, text) with the form in place of the text; each text of a type is folded once, those without a form are left out."""
    texts = told.select("type", "text").distinct()
    texts = texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "type", "text")  # few bytes, but work for all cores
    return told.join(texts.mapInArrow(*rows("type string, text string, form string", _forms)), ["type", "text"]).select("id", "b", "type", "form")


def letters_of(text: str) -> int:
    """64 bits: which of 32 classes of letters are in a text, and which are in it twice. An insertion or deletion turns one of them at most, another letter in a place two."""
    once = twice = 0
    for c in text:
        bit = 1 << ord(c) % 32
        twice |= once & bit
        once |= bit
    got = once | twice << 32
    return got - (1 << 64) if got >> 63 else got


def _cut(kinds, forms, firsts, batches, labels):
    for k, f, i, b, lab in zip(kinds, forms, firsts, batches, labels):
        if lab is not None:
            yield k, f, i, b, lab, 0, 0, [], [], [], []
            continue
        n, text = number_of(f), "".join(bare_of(f))
        got = chunks(text)
        sizes = [max(1, len(c.encode())) for c in got]  # 56 at most
        totals = [sum(z for z, m in zip(sizes, got.values()) if m >> no & 1) for no in range(len(SEEDS))]
        yield k, f, i, b, None, len(text), letters_of(text), [f"{n}|{c}" for c in got], sizes, list(got.values()), totals


def _rarest(rids, letters, keys, masks, totals, seen, counts):
    """Of each record the keys that must be followed: under each seed's boundaries the rarest, until the rest is under COVER."""
    for rid, size, own, mask, total, known, n in zip(rids, letters, keys, masks, totals, seen, counts):
        often = dict(zip(known, n))
        ranked = sorted(zip(own, mask), key=lambda x: (-often[x[0]], x[0]))
        held, out = [0] * len(total), []
        for key, m in ranked:
            follow = False
            for no in range(len(total)):
                if m >> no & 1:
                    held[no] += key & 63
                    follow = follow or held[no] >= COVER * total[no]
            if follow and often[key] > 1:
                out.append(key)
        for key in out:
            yield rid, size, key


def _decide(nodes, batches, forms, keys, masks, totals, others, o_keys, labels, o_batches):
    for k, b, f, own, mask, total, o, theirs, lab, ob in zip(nodes, batches, forms, keys, masks, totals, others, o_keys, labels, o_batches):
        theirs = set(theirs)
        held = [0] * len(total)
        for key, m in zip(own, mask):
            if key in theirs:
                for no in range(len(total)):
                    if m >> no & 1:
                        held[no] += key & 63
        if any(h >= COVER * t for h, t in zip(held, total)) and same(f, o):
            yield k, b, lab, ob


def _lone(node: str) -> str:
    return "1|" + re.sub("\u0001-?[0-9]+$", "", node[2:])


def _in_order(batches):
    """(node, label) of links (a, b, o, ob) that come in the order of b: what `History._labels` does, in one task."""
    given: dict[str, str] = {}

    def settle(edges):
        parent: dict[str, str] = {}

        def root(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for x, y in edges:
            x, y = sorted((root(x), root(y)))
            parent[y] = x
        got = {x: root(x) for x in list(parent) if x.startswith("2|")}
        given.update((x, _lone(g) if g.startswith("2|") else g) for x, g in got.items())

    now, edges = None, []
    for batch in batches:
        for a, b, o, ob in zip(*(c.to_pylist() for c in batch.columns)):
            if b != now:
                settle(edges)
                now, edges = b, []
            edges.append((a, given.get(o) or _lone(o) if ob is not None and ob < b else o))
    settle(edges)
    if given:
        yield pa.RecordBatch.from_arrays([pa.array(given.keys(), pa.string()), pa.array(given.values(), pa.string())], names=["node", "label"])


#: A key carries the bytes of its chunk in the lowest 6 bits.
_KEYS = "transform(arrays_zip(cs, sizes), x -> (xxhash64(type, x.cs) & ~63L) | x.sizes)"
RECORD = "rid long, type string, form string, size int, letters long, keys array<long>, label string"
POSTING = "key long, size int, letters long, rid long"
COUNT = "key long, n long"
FOUND = "id string, label string, b long"
#: A new form stands for itself under 2|, the id that names it first, and what keeps it apart from another of that id.
_NODE = "concat('2|', first, '\u0001', rid)"
_LONE = "concat('1|', regexp_replace(substring({0}, 3), '\u0001-?[0-9]+$', ''))"


def _names(spec: str) -> list[str]:
    return [c.split()[0] for c in spec.split(", ")]


class History:
    """Everything accepted so far, in a folder that outlives the session; each batch adds one part.

    Tables: `records` (one row for each different form: its chunk keys and its label), `postings` (key to record),
    `counts` (how many records a part added to a key) and `found` (what was said of a batch's mentions), each in parts
    and, but for `found`, in `buckets` by the hash of record or key, so that a small batch reads only the buckets of
    its own keys. A part counts once its mark stands in `done`; what a run that died left behind is written over, and
    a batch that is in it already isn't checked again. `compact` merges the parts into one; older ones stay in place
    until they are deleted by hand.

    Labels: `0|` and the id of a registered entity, `1|` and the id of the mention that named a thing first.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 4):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/ledgraph/history-{uuid.uuid4().hex}"
        kept = [n for n in listing(spark, f"{self.path}/done") if n.startswith("buckets-")]
        self.buckets = int(kept[0].split("-")[1]) if kept else buckets
        if not kept:
            self._mark(f"buckets-{buckets}")

    def _mark(self, name: str) -> None:
        fs, p = filesystem(self.spark, f"{self.path}/done/{name}")
        fs.create(p, True).close()

    def _parts(self) -> list[tuple[int, str]]:
        """(part, what it holds) of the parts that count: those from the last merged one on."""
        every = sorted((int(n.split("-")[1]), n.split("-", 2)[2]) for n in listing(self.spark, f"{self.path}/done") if n.startswith("part-"))
        merged = [i for i, (_, what) in enumerate(every) if what == "merged"]
        return every[merged[-1] :] if merged else every

    def batches(self) -> dict[int, int]:
        """The part of each batch that was checked."""
        names = listing(self.spark, f"{self.path}/done")
        parts = {int(n.split("-")[1]) for n in names if n.startswith("part-")}
        held = [n.split("_") for n in names if n.startswith("batch_")]
        alone = [n.split("-", 2) for n in names if n.startswith("part-")]  # a part of one batch, as it was marked before
        return {int(what[5:]): int(no) for _, no, what in alone if re.fullmatch(r"batch-?\d+", what)} | {int(b): int(no) for _, b, no in held if int(no) in parts}

    def _read(self, what: str, schema: str, touched: list[int] | None = None) -> DataFrame:
        root = f"{self.path}/{what}"
        got = [f"{root}/part={no}" for no, _ in self._parts()]
        if not got:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema + ", part int, bucket int").option("basePath", root).parquet(*got)
        return (df if touched is None else df.where(F.col("bucket").isin(touched))).drop("part", "bucket")

    def _touched(self, keys) -> list[int]:
        """The buckets of a column of keys: at most `buckets` rows come to the driver."""
        return [r[0] for r in keys.select(self._bucket(keys.columns[0]).alias("b")).distinct().collect()]

    def _bucket(self, c: str):
        return F.expr(f"cast(pmod(xxhash64({c}), {self.buckets}) as int)")

    def _write(self, what: str, no: int, df: DataFrame, by: str) -> None:
        b = df.withColumn("bucket", self._bucket(by))
        b.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{what}/part={no}")

    def _append(self, records: DataFrame, found: DataFrame | None, holds: str, numbers: tuple[int, ...] = ()) -> None:
        """Add records (RECORD) as the next part, which holds the batches `numbers`."""
        names = listing(self.spark, f"{self.path}/done")
        no = max([0, *(int(n.split("_")[2]) for n in names if n.startswith("batch_")), *(int(n.split("-")[1]) for n in names if n.startswith("part-"))]) + 1
        posts = self._postings(records)
        with ThreadPoolExecutor(4) as pool:  # four tables, written side by side
            jobs = [
                pool.submit(self._write, "records", no, records, "rid"), pool.submit(self._write, "postings", no, posts, "key"),
                pool.submit(self._write, "counts", no, posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key"),
            ]
            if found is not None:
                jobs.append(pool.submit(found.write.mode("overwrite").parquet, f"{self.path}/found/part={no}"))
            for j in jobs:
                j.result()
        for b in numbers:
            self._mark(f"batch_{b}_{no}")
        self._mark(f"part-{no:06d}-{holds}")

    @staticmethod
    def _postings(records: DataFrame) -> DataFrame:
        return records.select(F.explode("keys").alias("key"), "size", "letters", "rid")

    @staticmethod
    def _cut_forms(firsts: DataFrame) -> DataFrame:
        """Forms (type, form, first, b, label) with the chunk keys of those that have no label yet."""
        spec = "type string, form string, first string, b long, label string, size int, letters long, cs array<string>, sizes array<int>, masks array<int>, totals array<int>"
        c = firsts.select("type", "form", "first", "b", "label").mapInArrow(*rows(spec, _cut))
        return c.select(F.xxhash64("type", "form").alias("rid"), "type", "form", "size", "letters", F.expr(_KEYS).alias("keys"), "masks", "totals", "first", "b", "label")

    def accept_entities(self, entities: DataFrame) -> None:
        """Register entities (canon_id, type, canonical, aliases); null types and names are left out. They count as one part, which is added once."""
        if any(n.endswith("-entities") for n in listing(self.spark, f"{self.path}/done")):
            return
        names = entities.where("canon_id is not null and type is not null").select(F.col("canon_id").alias("id"), "type", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("text"))
        got = names.where("text is not null").select("id", F.lit(0).cast("long").alias("b"), "type", "text")
        forms = _with_forms(got).groupBy("type", "form").agg(F.min("id").alias("first"), F.min("b").alias("b"))
        cut = self._cut_forms(forms.withColumn("label", F.lit(None).cast("string")))
        records = stage(cut.withColumn("label", F.concat(F.lit("0|"), "first")).select(*_names(RECORD)), "records")
        self._append(records, None, "entities")

    def check(self, batch: DataFrame, number: int) -> DataFrame:
        """(id, label) of the mentions (id, type, form) of one batch, which is accepted. A batch checked before is only read."""
        self.check_batches(batch.withColumn("b", F.lit(number).cast("long")), [number])
        return self.found([self.batches()[number]]).where(f"coalesce(b, {number}) = {number}").select("id", "label")

    def check_batches(self, mentions: DataFrame, numbers: list[int]) -> None:
        """Check and accept the mentions (id, b, type, form) of batches as if one came after the other; those checked before are left out.

        A form that is known has its label. A new one is cut into chunks; of these, the rarest by the counts are
        followed to the records of like length that hold them, of its own batch or an earlier one: those left out hold
        less than COVER of the form's bytes, so no record that shares COVER of them is missed. Nor are those that `same`
        accepts by its bound on the letters: EDITS edits, in whatever order the words are. Of each pair met so the
        shared bytes of all chunks decide: under no seed's boundaries COVER of the new one's bytes, and it is none.
        `same` then looks at the words. All this is done for all batches at once; only the labels, which a later batch
        takes from earlier ones, are given in order. Copies of a form are one row from the start.
        """
        done = self.batches()
        numbers = sorted(b for b in numbers if b not in done)
        if not numbers:
            return
        ids = mentions.where(F.col("b").isin(numbers)).select("id", "b", "type", "form", F.xxhash64("type", "form").alias("rid"))
        before = self._parts()
        touched = self._touched(ids.select("rid")) if before else []
        few = len(touched) < self.buckets
        known = self._read("records", RECORD, touched).select("type", "form", "label")
        firsts = ids.groupBy("type", "form").agg(F.min(F.struct("b", "id")).alias("m")).select("type", "form", F.col("m.id").alias("first"), F.col("m.b").alias("b"))
        firsts = stage(self._cut_forms(firsts.join(known, ["type", "form"], "left")), "firsts")
        new = firsts.where("label is null")
        own = new.select(F.explode("keys").alias("key"), "size", "letters", "rid", "b")
        touched = self._touched(own.select("key")) if few and before else None
        counts = own.groupBy("key").agg(F.count(F.lit(1)).alias("own"))
        held = self._read("counts", COUNT, touched).join(counts.select("key"), "key", "left_semi").groupBy("key").agg(F.sum("n").alias("n"))
        counts = counts.join(held, "key", "left").select("key", (F.col("own") + F.coalesce("n", F.lit(0))).alias("n"))
        often = own.join(counts, "key").groupBy("rid").agg(F.collect_list(F.struct("key", "n")).alias("seen"))  # a record's own keys
        often = new.join(often, "rid").select("rid", "size", "keys", "masks", "totals", "seen.key", "seen.n")
        rare = often.mapInArrow(*rows("rid long, size int, key long", _rarest)).join(new.select("rid", "letters", "b"), "rid")
        holders = self._read("postings", POSTING, touched).withColumn("b", F.lit(None).cast("long")).unionByName(own).select("key", F.col("size").alias("o_size"), F.col("letters").alias("o_letters"), F.col("rid").alias("o"), F.col("b").alias("ob"))
        close = F.coalesce(F.bit_count(F.col("letters").bitwiseXOR(F.col("o_letters"))) <= 2 * EDITS, F.lit(True))  # parts written before have no letters
        met = rare.join(holders, "key").where((F.abs(F.col("size") - F.col("o_size")) <= EDITS) & close & (F.col("rid") != F.col("o")) & (F.col("ob").isNull() | (F.col("ob") <= F.col("b")))).select("rid", "o").distinct()
        met = met.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "rid")  # few bytes, but work for all cores
        if few and before:
            met = stage(met, "met")
            touched = self._touched(met.select("o"))
        others = self._read("records", RECORD, touched).withColumn("b", F.lit(None).cast("long")).unionByName(new.withColumn("label", F.expr(_NODE)).select(*_names(RECORD), "b"))
        others = others.select(F.col("rid").alias("o"), F.col("type").alias("o_type"), F.col("form").alias("o_form"), F.col("keys").alias("o_keys"), F.col("label").alias("o_label"), F.col("b").alias("ob"))
        asked = new.select("rid", "type", "form", "keys", "masks", "totals", "b", F.expr(_NODE).alias("node"))
        pairs = met.join(asked, "rid").join(others, "o").where("type = o_type and form <> o_form")
        links = pairs.select("node", "b", "form", "keys", "masks", "totals", "o_form", "o_keys", "o_label", "ob").mapInArrow(*rows("a string, b long, o string, ob long", _decide))
        labels = self._labels(stage(links, "links"))
        got = new.drop("label").withColumn("node", F.expr(_NODE)).join(labels, "node", "left").withColumn("label", F.coalesce("label", F.expr(_LONE.format("node"))))
        records = stage(got.select(*_names(RECORD)), "records")
        told = firsts.where("label is not null").select("type", "form", "label").unionByName(records.select("type", "form", "label"))
        self._append(records, ids.join(told, ["type", "form"]).select("id", "label", "b"), "batches", tuple(numbers))

    def _labels(self, links: DataFrame) -> DataFrame:
        """(node, label) of the new forms with links (a, b, o, ob): a of batch b repeats o, a label or, of batch ob, a form. Batch by batch."""
        root, schema, paths = f"{staging(self.spark)}/labels-{uuid.uuid4().hex}", "node string, label string", []
        if links.count() <= LINKS:
            return stage(links.select("a", "b", "o", "ob").repartition(1).sortWithinPartitions("b").mapInArrow(_in_order, schema), "labels")
        for (b,) in sorted(links.select("b").distinct().collect()):  # a row for each batch
            e = links.where(F.col("b") == b)
            if paths:
                given = self.spark.read.schema(schema).parquet(*paths).select(F.col("node").alias("o"), "label")
                e = e.join(given, "o", "left")
            else:
                e = e.withColumn("label", F.lit(None).cast("string"))
            o = F.when(F.col("ob") < b, F.coalesce("label", F.expr(_LONE.format("o")))).otherwise(F.col("o"))
            groups = connected_groups(e.select("a", o.alias("to")))
            told = F.when(F.col("group_id").startswith("2|"), F.expr(_LONE.format("group_id"))).otherwise(F.col("group_id"))
            paths.append(f"{root}/b={b}")
            groups.where("member like '2|%'").select(F.col("member").alias("node"), told.alias("label")).write.parquet(paths[-1])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def found(self, parts: list[int]) -> DataFrame:
        """(id, label, b) of what was said of the mentions of some parts."""
        return self.spark.read.schema(FOUND).parquet(*[f"{self.path}/found/part={p}" for p in parts])

    def compact(self) -> None:
        """Merge all parts into one; for after many batches. `found` stays in its parts."""
        have = self._parts()
        if len(have) < 2:
            return
        no = have[-1][0] + 1
        for what, schema, by in (("records", RECORD, "rid"), ("postings", POSTING, "key")):
            self._write(what, no, self._read(what, schema), by)
        self._write("counts", no, self._read("counts", COUNT).groupBy("key").agg(F.sum("n").alias("n")), "key")
        self._mark(f"part-{no:06d}-merged")


def repeats(incoming: DataFrame, entities: DataFrame, path: str | None = None) -> DataFrame:
    """(first_id, mention_id) of each incoming mention that repeats an entity or an earlier mention of its type.

    Batches are checked in order, each against the chunks of everything before and of its own, in the history at
    `path` (a new one where it is null); those it holds already are only read. A null batch_no comes last; null
    types, and texts that are null or hold no letter or digit, repeat nothing. Equal numbers are required, and a word
    more or less, other than an article or the type's own name, makes another thing. If a mention links two known
    things, the registered one, else the earlier, is taken.
    """
    history = History(incoming.sparkSession, path)
    history.accept_entities(entities)
    told = incoming.where("mention_id is not null and type is not null and text is not null").select(
        F.col("mention_id").alias("id"), F.coalesce(F.col("batch_no").cast("long"), F.lit(2**31)).alias("b"), "type", "text"
    )
    forms = stage(_with_forms(told), "forms")
    history.check_batches(forms, [no for (no,) in forms.select("b").distinct().collect()])
    parts = sorted(set(history.batches().values()))
    if not parts:
        return incoming.sparkSession.createDataFrame([], "first_id string, mention_id string")
    got = history.found(parts).select(F.expr("substring(label, 3)").alias("first_id"), F.col("id").alias("mention_id"))
    return got.where("first_id <> mention_id").distinct()
