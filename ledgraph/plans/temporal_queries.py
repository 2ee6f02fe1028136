"""p4 and p7: history and point-in-time knowledge."""

from __future__ import annotations

from ledgraph.operators.asof import known_at
from ledgraph.operators.history import fact_history
from ledgraph.sources.tables import table


def p4_history(spark, d):
    """Each version with its validity and the fact that replaced it."""
    h = fact_history(table(spark, d, "facts"), table(spark, d, "relation_policy"))
    return h.select("head", "relation", "version_no", "tail", "valid_from", "valid_until", "fact_id", "replaced_by")


def p4_found(spark, d):
    return fact_history(table(spark, d, "facts"), table(spark, d, "relation_policy")).select("head", "relation", h_int("version_no"), "fact_id")


def h_int(c):
    from pyspark.sql import functions as F

    return F.col(c).cast("int").alias(c)


def p7_found(spark, d):
    return known_at(table(spark, d, "lookups"), table(spark, d, "facts"))


QUERIES = {"p4_found": p4_found, "p4_history": p4_history, "p7_found": p7_found}

_P4 = """
WITH live AS (
  SELECT head, relation, tail, fact_id, recorded_at, coalesce(valid_from, recorded_at) AS start_at
  FROM facts
  WHERE NOT (superseded_at IS NOT NULL AND superseded_by IS NULL) AND head IS NOT NULL
    AND relation IN (SELECT relation FROM relation_policy WHERE policy = 'single')
), one AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY head, relation, start_at ORDER BY recorded_at DESC NULLS LAST, fact_id DESC) AS rn
                 FROM live WHERE start_at IS NOT NULL) x WHERE rn = 1
), diff AS (
  SELECT *, lag(tail) OVER w AS before, row_number() OVER w AS pos FROM one WINDOW w AS (PARTITION BY head, relation ORDER BY start_at)
), opened AS (SELECT * FROM diff WHERE pos = 1 OR tail IS DISTINCT FROM before)
"""
ORACLE = {
    "p4_found": _P4 + "SELECT head, relation, CAST(row_number() OVER (PARTITION BY head, relation ORDER BY start_at) AS INTEGER) AS version_no, fact_id FROM opened",
    "p4_history": _P4
    + """SELECT head, relation, row_number() OVER w AS version_no, tail, start_at AS valid_from, lead(start_at) OVER w AS valid_until, fact_id,
  lead(fact_id) OVER w AS replaced_by FROM opened WINDOW w AS (PARTITION BY head, relation ORDER BY start_at)""",
    "p7_found": """
SELECT lookup_id, fact_id FROM (
  SELECT l.lookup_id, f.fact_id,
    row_number() OVER (PARTITION BY l.lookup_id ORDER BY coalesce(f.valid_from, f.recorded_at) DESC, f.recorded_at DESC, f.fact_id DESC) AS rn
  FROM (SELECT DISTINCT lookup_id, head, relation, asked_at FROM lookups) l
  JOIN facts f ON f.head = l.head AND f.relation = l.relation AND f.recorded_at <= l.asked_at
    AND coalesce(f.valid_from, f.recorded_at) <= l.asked_at
    AND NOT (f.superseded_at IS NOT NULL AND f.superseded_by IS NULL AND f.superseded_at <= l.asked_at)
) x WHERE rn = 1""",
}
