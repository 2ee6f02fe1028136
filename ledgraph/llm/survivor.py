"""Best representative of each duplicate group, field by field.

Two parts share one table of claims: which record says what of which field. `truths` infers each source's
sensitivity and specificity by expectation-maximisation and keeps every value judged true; `survivors` picks the
record whose value of a field survives where an order of precedence is prescribed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgraph.sources.tables import stage

#: Words that stand for a missing value; a value without any letter or digit does as well.
MISSING = ("n/a", "na", "n.a.", "n.a", "none", "null", "nil", "nan", "unknown", "undefined", "unspecified", "not available", "not known", "not applicable", "missing", "tbd", "tba", "tbc", "empty", "blank", "no value", "?", "-", "--")
LISTS, SINGLES = ("aliases", "mentions"), ("canonical", "located_in")
_EDGE = r"(?U)^[\s​﻿]+|[\s​﻿]+$"


def trimmed(c):
    return F.regexp_replace(c, _EDGE, "")


def real(c):
    """Whether a single value is real: not null, blank or a word or sign for a missing value."""
    t = F.lower(trimmed(c))
    return c.isNotNull() & t.rlike(r"[\p{L}\p{N}]") & ~t.isin(*MISSING)


def entries(c):
    """The distinct entries of a list, trimmed, without null and blank ones."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: trimmed(x)), lambda x: x.isNotNull() & (x != "")))


def _records(records: DataFrame) -> DataFrame:
    keep = ["record_id", "canon_id", "source", "updated_at", *SINGLES, *LISTS]
    return records.where("canon_id is not null and record_id is not null").select(*keep).dropDuplicates(["canon_id", "record_id"])


def survivors(records: DataFrame, trust: DataFrame) -> DataFrame:
    """(canon_id, field_name, record_id): the record whose value survives, for groups of two or more record_ids.

    Single values: better trust_rank (unlisted and null sources last), later updated_at (null last), smaller
    record_id, among real values. Lists: most distinct entries first, at least one, then as before. A field
    without a real value gives no row. Rows with null canon_id or record_id are left out, repeated rows count once.
    """
    r = _records(records).join(trust.groupBy("source").agg(F.min("trust_rank").alias("trust_rank")), "source", "left")
    order = [F.coalesce("trust_rank", F.lit(2**31 - 1)), F.coalesce(-F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(2**63 - 1)), F.col("record_id")]

    def field(name):
        n = F.size(entries(F.col(name))) if name in LISTS else F.lit(1)
        ok = (n > 0) if name in LISTS else real(F.col(name))
        return F.struct(F.lit(name).alias("field_name"), F.when(F.coalesce(ok, F.lit(False)), F.struct((-n).alias("n"), *[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("rank"))

    per = r.select("canon_id", F.array(*[field(f) for f in (*SINGLES, *LISTS)]).alias("fields"), "record_id")
    flat = per.select("canon_id", "record_id", F.inline("fields"))
    best = flat.groupBy("canon_id", "field_name").agg(F.min("rank").alias("best"), F.min("record_id").alias("lo"), F.max("record_id").alias("hi"))
    return best.where("lo < hi and best is not null").select("canon_id", "field_name", F.col("best.o2").alias("record_id"))


def built(records: DataFrame, trust: DataFrame) -> DataFrame:
    """One record for each group: canonical, located_in, aliases and mentions from the surviving records."""
    won = survivors(records, trust)
    r = _records(records)
    vals = won.join(r, ["canon_id", "record_id"])
    pick = lambda f, v: F.max(F.when(F.col("field_name") == f, v)).alias(f)
    return vals.groupBy("canon_id").agg(
        *[pick(f, trimmed(F.col(f))) for f in SINGLES], *[pick(f, F.array_sort(entries(F.col(f)))) for f in LISTS], F.countDistinct("record_id").alias("n_records")
    )


def truths(records: DataFrame, rounds: int = 40, keep: float = 0.5, still: float = 0.01) -> DataFrame:
    """(canon_id, field_name, value, posterior, n_sources): the values judged true.

    A source covers a field of an entity if it gives any real value of it; it then denies each value that others
    give and it doesn't. For each source and field, sensitivity (share of true values it gives) and specificity
    (share of false ones it doesn't) are estimated by expectation-maximisation from smoothed starting values. A
    field of many values keeps every value of posterior `keep` or more; a single one its likeliest (then the
    smaller value). Groups without a real value give no rows. It goes on until no sensitivity or specificity moves by
    `still`; after `rounds` it raises instead of giving unfinished values.
    """
    r = _records(records).withColumn("source", F.coalesce("source", F.lit("")))
    one = r.select("canon_id", "source", F.expr("stack(2, 'canonical', canonical, 'located_in', located_in) as (field_name, value)"))
    one = one.where(real(F.col("value"))).withColumn("value", trimmed(F.col("value")))
    many = r.select("canon_id", "source", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), entries(F.col(f)).alias("vs")) for f in LISTS])).alias("x"))
    many = many.select("canon_id", "source", "x.field_name", F.explode("x.vs").alias("value"))
    said = stage(one.unionByName(many).distinct(), "claims")
    cover = said.select("canon_id", "field_name", "source").distinct()
    facts = said.select("canon_id", "field_name", "value").distinct().join(cover, ["canon_id", "field_name"])
    votes = facts.join(said.withColumn("yes", F.lit(1)), ["canon_id", "field_name", "value", "source"], "left").withColumn("yes", F.coalesce("yes", F.lit(0)))
    votes = stage(votes, "votes")
    start = votes.groupBy("canon_id", "field_name", "value").agg(F.avg("yes").alias("p"))
    p, last = start, None
    for no in range(rounds + 1):
        e = votes.join(p, ["canon_id", "field_name", "value"])
        q = e.groupBy("source", "field_name").agg(
            ((F.sum(F.col("p") * F.col("yes")) + 2) / (F.sum("p") + 3)).alias("sens"),
            ((F.sum((1 - F.col("p")) * (1 - F.col("yes"))) + 2) / (F.sum(1 - F.col("p")) + 3)).alias("spec"),
        )
        q = stage(q, "quality")
        if last is not None:
            was = last.select("source", "field_name", F.col("sens").alias("s0"), F.col("spec").alias("p0"))
            moved = q.join(was, ["source", "field_name"]).agg(F.max(F.greatest(F.abs(F.col("sens") - F.col("s0")), F.abs(F.col("spec") - F.col("p0"))))).first()[0]
            if moved is None or moved < still:
                break
        last = q
        if no == rounds:
            raise RuntimeError(f"no standstill after {rounds} rounds")
        odds = F.when(F.col("yes") == 1, F.log(F.col("sens") / (1 - F.col("spec")))).otherwise(F.log((1 - F.col("sens")) / F.col("spec")))
        p = votes.join(q, ["source", "field_name"]).groupBy("canon_id", "field_name", "value").agg((1 / (1 + F.exp(-F.sum(odds)))).alias("p"), F.sum("yes").alias("n_sources"))
    best = p.groupBy("canon_id", "field_name").agg(F.min(F.struct((-F.col("p")).alias("np"), F.col("value"))).alias("b"))
    got = p.join(best, ["canon_id", "field_name"]).where((F.col("field_name").isin(*LISTS) & (F.col("p") >= keep)) | (F.col("value") == F.col("b.value")))
    return got.select("canon_id", "field_name", "value", F.round("p", 6).alias("posterior"), F.col("n_sources").cast("long").alias("n_sources"))


def agreement(records: DataFrame, trust: DataFrame) -> DataFrame:
    """(field_name, n, same, share): for how many surviving single values the likeliest value of `truths` is the same."""
    r = _records(records)
    vals = survivors(records, trust).where(F.col("field_name").isin(*SINGLES)).join(r, ["canon_id", "record_id"])
    vals = vals.select("canon_id", "field_name", trimmed(F.when(F.col("field_name") == "canonical", F.col("canonical")).otherwise(F.col("located_in"))).alias("kept"))
    j = vals.join(truths(records).select("canon_id", "field_name", "value"), ["canon_id", "field_name"])
    return j.groupBy("field_name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kept") == F.col("value")).alias("same")).withColumn("share", F.round(F.col("same") / F.col("n"), 4))
