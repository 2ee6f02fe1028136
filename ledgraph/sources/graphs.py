"""Reading ontologies, graphs and labelled pairs; writing graphs as script, JSON, CSV and diagrams."""

from __future__ import annotations

import json
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgraph.functions.names import cypher_literal, label_for, relation_label
from ledgraph.operators.ranking import numbered
from ledgraph.sources.tables import filesystem, listing

ONTOLOGY = "name string, entities array<struct<name:string,description:string>>, relations array<struct<name:string,head:array<string>,tail:array<string>,description:string,unique_head:boolean,unique_tail:boolean,acyclic:boolean,inverse:string,threshold:double,allow_self:boolean>>"


def json_source(source: str) -> str:
    """The JSON text of a path or of JSON itself."""
    if source.lstrip()[:1] in "{[":
        return source
    with open(source, encoding="utf-8") as f:
        return f.read()


def read_ontology(spark: SparkSession, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entity_types, relation_types, legal patterns (head_type, type, tail_type) of an ontology in JSON; checked."""
    o = json.loads(json_source(source))
    problems = ontology_problems(o)
    if problems:
        raise ValueError("; ".join(problems))
    df = spark.createDataFrame([(json.dumps(o),)], "j string").select(F.from_json("j", ONTOLOGY).alias("o")).select("o.*")
    rel = df.select(F.explode("relations").alias("r")).select("r.*")
    pat = rel.select(F.explode("head").alias("head_type"), F.col("name").alias("type"), "tail").select("head_type", "type", F.explode("tail").alias("tail_type"))
    return df.select(F.explode("entities").alias("e")).select("e.*"), rel, pat


def ontology_problems(o: dict) -> list[str]:
    """Empty and repeated names, undeclared ends, inverses that don't mirror each other."""
    ents, rels = [e["name"] for e in o.get("entities", [])], {r["name"]: r for r in o.get("relations", [])}
    out = [f"empty name among {k}" for k, xs in (("entities", ents), ("relations", rels)) if any(not x for x in xs)]
    out += [f"entity {x} is declared twice" for x in sorted({x for x in ents if ents.count(x) > 1})]
    if len(rels) < len(o.get("relations", [])):
        out.append("a relation is declared twice")
    for n, r in rels.items():
        out += [f"{n}: end {x} isn't declared" for x in [*r["head"], *r["tail"]] if x not in ents]
        inv = rels.get(r.get("inverse") or "")
        if r.get("inverse") and (inv is None or sorted(inv["head"]) != sorted(r["tail"]) or sorted(inv["tail"]) != sorted(r["head"])):
            out.append(f"{n}: inverse {r['inverse']} doesn't mirror it")
    return out


def mermaid(patterns: DataFrame) -> DataFrame:
    """One row, `diagram`: the model as a flow chart; an ontology's size."""
    line = F.format_string("  %s -->|%s| %s", "head_type", "type", "tail_type")
    return patterns.agg(F.concat(F.lit("graph LR\n"), F.array_join(F.array_sort(F.collect_set(line)), "\n")).alias("diagram"))


def labelled_pairs(spark: SparkSession, archive: str, table_a: str, table_b: str, splits: list[str], into: str) -> DataFrame:
    """(id, a, b, known_same, split) of CSV files in a zip: two record tables and files of id pairs with labels, ids by order.

    The archive is a download for one machine; its files are copied to `into` on the shared file system. Pairs are
    numbered by file and line through their partitions, so no task sorts all of them.
    """
    with tempfile.TemporaryDirectory() as local, zipfile.ZipFile(archive) as z:
        for n in (table_a, table_b, *splits):
            fs, p = filesystem(spark, f"{into}/{n}")
            fs.copyFromLocalFile(False, True, filesystem(spark, "file://" + z.extract(n, local))[1], p)
    read = lambda n: spark.read.csv(f"{into}/{n}", header=True)
    pack = lambda df, n: df.select(F.col("id").alias(f"{n}_id"), F.struct(*[c for c in df.columns if c != "id"]).alias(n))
    out = None
    for i, s in enumerate(splits):
        p = read(s).withColumn("o", F.monotonically_increasing_id()).select(F.lit(i).alias("s"), "o", F.col("ltable_id").alias("a_id"), F.col("rtable_id").alias("b_id"), (F.col("label") == "1").alias("known_same"), F.lit(s.split(".")[0]).alias("split"))
        out = p if out is None else out.unionByName(p)
    j = out.join(pack(read(table_a), "a"), "a_id").join(pack(read(table_b), "b"), "b_id").withColumn("one", F.lit(1))
    j = numbered(j, ["one"], [F.col("s"), F.col("o")], F.col("s").cast("long") * 2**40 + F.shiftright("o", 16), "n")
    return j.withColumn("id", F.format_string("c%03d", F.col("n") - 1)).select("id", "a", "b", "known_same", "split")


def write_graph(entities: DataFrame, edges: DataFrame, path: str) -> None:
    """JSON lines: a folder of entities and one of edges with all their columns, evidence included; a hub's edges are many lines, not one."""
    entities.write.mode("overwrite").json(f"{path}/entities")
    edges.write.mode("overwrite").json(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.json(f"{path}/entities"), spark.read.json(f"{path}/edges")


def write_ontology(entity_types: DataFrame, relation_types: DataFrame, path: str) -> None:
    """One JSON object: the counterpart of `read_ontology`; an ontology is a small table of types."""
    e = entity_types.agg(F.array_sort(F.collect_list(F.struct(*entity_types.columns))).alias("entities"))
    r = relation_types.agg(F.array_sort(F.collect_list(F.struct(*relation_types.columns))).alias("relations"))
    e.join(r).select(F.to_json(F.struct("entities", "relations")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def remove_partition(df: DataFrame, domain: str, *cols: str) -> DataFrame:
    """`df` without the rows of a namespace: what is left after a domain is wiped."""
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.coalesce(F.col(c).startswith(f"{domain}:"), F.lit(False))
    return df.where(~bad)


def vertices_and_edges(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pair of tables graph libraries take: vertices by `id`, edges by `src`, `dst`, `relationship`; parallel edges stay."""
    v = entities.withColumnRenamed("canon_id", "id")
    return v, edges.select(F.col("head").alias("src"), F.col("tail").alias("dst"), F.col("type").alias("relationship"), *[c for c in edges.columns if c not in ("head", "tail", "type")])


def mention_cache(spark: SparkSession, path: str, make) -> DataFrame:
    """The mentions kept at `path` as CSV; where there are none, `make()` gives them and they are written first."""
    if not listing(spark, path):
        make().write.mode("overwrite").option("escape", '"').csv(path, header=True)
    return spark.read.option("escape", '"').csv(path, header=True, inferSchema=True, multiLine=True)


def read_settings(text: str) -> dict[str, str]:
    """Settings of a .env text; what the environment holds wins. Comments, `export` and quotes are taken off."""
    out = {}
    for line in text.splitlines():
        name, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and not name.startswith("#"):
            out[name.strip()] = value.strip().strip("\"'")
    return {k: os.environ.get(k, v) for k, v in out.items()}


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with arrays joined by `|`."""
    df.select(*[F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]).write.mode("overwrite").csv(path, header=True)


def cypher(entities: DataFrame, edges: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(ord, line): an idempotent script that makes constraints, nodes, relations with their strongest evidence, and links to documents.

    Edges may have `evidence` (array of structs with snippet); three snippets at most are written. `links` has
    (canon_id, doc_id).
    """
    q, lit = cypher_literal, F.lit
    c = entities.select("type").distinct().select(lit(0).alias("ord"), F.format_string("CREATE CONSTRAINT IF NOT EXISTS FOR (n:%s) REQUIRE n.id IS UNIQUE;", label_for(F.col("type"))).alias("line"))
    n = entities.select(lit(1).alias("ord"), F.concat(lit("MERGE (n:"), label_for(F.col("type")), lit(" {id: "), q(F.col("canon_id")), lit("}) SET n.name = "), q(F.col("canonical")), lit(";")).alias("line"))
    said = lit("")
    if "evidence" in edges.columns:
        said = F.concat(lit(", r.evidence = ["), F.array_join(F.transform(F.slice("evidence", 1, 3), lambda e: q(e["snippet"])), ", "), lit("]"))
    r = edges.select(
        lit(2).alias("ord"),
        F.concat(lit("MATCH (a {id: "), q(F.col("head")), lit("}), (b {id: "), q(F.col("tail")), lit("}) MERGE (a)-[r:"), relation_label(F.col("type")), lit("]->(b) SET r.confidence = "), F.col("confidence").cast("string"), lit(", r.support = "), F.col("support").cast("string"), said, lit(";")).alias("line"),
    )
    out = c.unionByName(n).unionByName(r)
    if links is not None:
        d = F.col("doc_id").cast("string")
        out = out.unionByName(links.select(lit(3).alias("ord"), F.concat(lit("MERGE (d:Document {id: "), q(d), lit("}) WITH d MATCH (a {id: "), q(F.col("canon_id")), lit("}) MERGE (a)-[:MENTIONED_IN]->(d);")).alias("line")))
    return out


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The snapshot after a keyed upsert: rows of `new` replace those of equal keys; a later write of the same rows changes nothing."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.dropDuplicates(keys))


def broken_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once: the constraint holds where there are none."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
