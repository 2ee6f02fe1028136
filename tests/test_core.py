"""Values worked by hand, brute force and invariants for the core operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgraph.functions import names, similarity, text
from ledgraph.operators import asof, conversation, evaluate, facts, graph, history, linking, resolution

T = lambda d: dt.datetime(2025, 1, 1) + dt.timedelta(days=d)
FACTS = "fact_id string, head string, relation string, tail string, valid_from timestamp_ntz, recorded_at timestamp_ntz, superseded_at timestamp_ntz, superseded_by string"


@pytest.mark.parametrize("shard,block", [(100_000, 200_000), (20, 30)])
def test_known_at_against_brute_force(spark, shard, block):
    rnd = random.Random(1)
    fs = []
    for i in range(300):
        vf = None if rnd.random() < 0.2 else T(rnd.randint(0, 60))
        gone = T(rnd.randint(0, 90)) if rnd.random() < 0.2 else None
        fs.append((f"f{i:03d}", rnd.choice(["a", "a", "a", "b"]), "r", "t", vf, T(rnd.randint(0, 60)), gone, "x" if gone and rnd.random() < 0.5 else None))
    ls = [(i, rnd.choice(["a", "a", "b", "zz", None]), "r", T(rnd.randint(-5, 80))) for i in range(200)]
    got = {r.lookup_id: r.fact_id for r in asof.known_at(spark.createDataFrame(ls + ls[:9], "lookup_id long, head string, relation string, asked_at timestamp_ntz"), spark.createDataFrame(fs + fs[:9], FACTS), shard, block).collect()}
    want = {}
    for i, h, _, t in ls:
        ok = [(f[4] or f[5], f[5], f[0]) for f in fs if f[1] == h and f[5] <= t and (f[4] or f[5]) <= t and not (f[6] and not f[7] and f[6] <= t)]
        if ok:
            want[i] = max(ok)[2]
    assert got == want


def test_history_by_hand_and_empty(spark):
    rows = [("1", "a", "r", "x", T(0), T(0), None, None), ("2", "a", "r", "x", T(1), T(1), None, None), ("3", "a", "r", "y", T(40), T(2), None, None), ("4", "a", "r", "y", T(40), T(1), None, None), ("5", "a", "r", "x", None, T(80), None, None), ("6", "a", "r", "z", T(50), T(50), T(60), None), ("7", "a", "s", "z", T(1), T(1), None, None), ("8", "a", "r", None, T(90), T(90), None, None)]
    pol = spark.createDataFrame([("r", "single"), ("s", "accumulate")], "relation string, policy string")
    h = history.fact_history(spark.createDataFrame(rows + rows, FACTS), pol).orderBy("version_no").collect()
    assert [(r.version_no, r.tail, r.fact_id, r.replaced_by) for r in h] == [(1, "x", "1", "3"), (2, "y", "3", "5"), (3, "x", "5", "8"), (4, None, "8", None)]
    assert [r.valid_until for r in h[:-1]] == [r.valid_from for r in h[1:]]
    assert history.fact_history(spark.createDataFrame([], FACTS), pol).count() == 0


def test_bcubed_values(spark):
    df = lambda x: spark.createDataFrame(x, "id string, cluster string")
    s = evaluate.bcubed(df([("a", "1"), ("b", "1"), ("c", "2")]), df([("a", "g"), ("b", "g"), ("c", "g")])).first()
    assert (round(s.precision, 4), round(s.recall, 4), round(s.f1, 4), s.n) == (1.0, 0.5556, 0.7143, 3)


def test_components_at_threshold_and_shapes(spark):
    e = [("a", "b"), ("b", "c"), ("d", "e")] + [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(30)] + [(None, "a"), ("a", "a")]
    got = {r.id: r.component for r in resolution.components(spark.createDataFrame(e, "a string, b string")).collect()}
    assert got["c"] == "a" and got["e"] == "d" and {v for k, v in got.items() if k[0] == "n"} == {"n00"}


def test_rule_chain(spark):
    rows = [("1", "tool", "npm", None), ("2", "tool", "pnpm", None), ("3", "company", "Harbek", "moves freight from the port"), ("4", "company", "Harbek Line Inc.", "moves freight from the port"), ("5", "company", "HBL", None), ("6", "person", "Ona Tully", None), ("7", "person", "Tully", None)]
    f = names.normalized(spark.createDataFrame(rows, "id string, type string, text string, context string"))
    p = spark.createDataFrame([("1", "2", "tool", "head"), ("3", "4", "company", "head"), ("4", "5", "company", "init"), ("6", "7", "person", "last")], "a string, b string, type string, block string")
    s = {r.a: r for r in resolution.score_pairs(p, f).collect()}
    assert round(s["1"].score, 4) == 0.1775
    assert s["3"].rule == 0.92 and s["4"].score == 0.97 and s["6"].score == 0.9


def test_normal_form():
    n = names.normalize_one("The “Harbek Line, Inc.”", "company")
    assert (n["key"], n["suffix"]) == ("harbek line", "Inc")
    assert names.normalize_one(None, "company") is None and names.normalize_one("", "person")["key"] == ""


def test_fold_corroborates_before_conflict(spark):
    import pandas as pd

    row = lambda i, t, d: {"fact_id": i, "head": "h", "relation": "r", "tail": t, "confidence": 0.5, "support": 1, "valid_from": T(d), "recorded_at": T(d)}
    got, _ = facts.fold_group(pd.DataFrame([row("1", "x", 0), row("2", "x", 1), row("3", "y", 2), row("3", "y", 2)]), "single", None)
    assert [(r["fact_id"], r["support"], r["superseded_by"]) for r in got] == [("1", 2, "3"), ("3", 1, None)]
    _, undecided = facts.fold_group(pd.DataFrame([row("1", "x", 0), row("2", "y", 1)]), "alternatives", None)
    assert undecided == [("x", "y")]


def test_episodes_cover_every_turn(spark):
    rows = [("s", i, "A", f"t{i}") for i in range(11)] + [("q", 0, None, "only")]
    e = conversation.episodes(spark.createDataFrame(rows, "session_id string, turn int, speaker string, said string")).collect()
    assert sorted(r.turn_start for r in e if r.session_id == "s") == [0, 3, 6, 7] and [r.text for r in e if r.session_id == "q"] == ["only"]


def test_link_rungs_and_kinds(spark):
    v = spark.createDataFrame([("k1", "LHR", "London Heathrow", "airport", ["Heathrow"])], "key string, code string, canonical string, kind string, aliases array<string>")
    s = spark.createDataFrame([("1", "place", "LHR"), ("2", "place", "london héathrow"), ("3", "place", "Heathrow"), ("4", "place", "The big one (LHR)"), ("5", "person", "LHR"), ("6", "place", None)], "mention_id string, type string, text string")
    got = {r.mention_id: r.how for r in linking.link(s, v, {"person": "human"}).collect()}
    assert got == {"1": "code", "2": "name", "3": "alias", "4": "code", "5": None, "6": None}


def test_similarities():
    assert abs(similarity.jaro_winkler("martha", "marhta") - 0.9611) < 1e-3
    assert similarity.token_set("a b c", "a b") == 1.0 and similarity.indel("", "") == 1.0


def test_text_units():
    t = "One two. Three!\nFour"
    assert [t[a:b] for a, b in text.spans(t)] == ["One two.", "Three!", "Four"]
    assert text.first_json('so: ```{"a": [1]}``` ok') == {"a": [1]} and text.snap("we met Ann Lee", "Dr Ann Lee") == (7, 14)


def test_chains_and_distances(spark):
    e = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "a"), ("c", "r", "d")], "head string, type string, tail string")
    assert {r.path[-1] for r in graph.chains(e, 3).where("start = 'a'").collect()} == {"b", "c", "d"}
    got = {r.id: r.distance for r in graph.distances(e, spark.createDataFrame([("d",)], "id string")).collect()}
    assert got == {"d": 0, "c": 1, "a": 2, "b": 2}


def test_every_query_has_a_callable_and_the_entry_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
    assert F is not None


def test_graph_files_and_ontology(spark, tmp_path):
    from ledgraph.sources import graphs

    e = spark.createDataFrame([("company:a", "company", "A's", ["x"]), ("person:b", "person", "B", None)], "canon_id string, type string, canonical string, aliases array<string>")
    r = spark.createDataFrame([("person:b", "works_at", "company:a", 0.9, 2)], "head string, type string, tail string, confidence double, support long")
    occ = r.select("head", "type", "tail", F.lit("d1").alias("doc_id"), "confidence", F.lit(False).alias("derived"), F.lit("he's in").alias("snippet"), F.lit(1).alias("span_start"), F.lit(4).alias("span_end"))
    r = graph.evidence_edges(occ.unionByName(occ.withColumn("doc_id", F.lit("d0")).withColumn("confidence", F.lit(0.1))))
    graphs.write_graph(e, r, str(tmp_path / "g"))
    back, edges = graphs.read_graph(spark, str(tmp_path / "g"))
    assert back.count() == 2 and [x.doc_id for x in edges.first().evidence] == ["d1", "d0"] and edges.first().support == 2
    assert graph.evidence_of(occ, e, "b", "works_at", "X").count() == 1 and graph.evidence_of(occ, e, "b", "works_at", "y").count() == 0
    assert "r.evidence = ['he\\'s in', 'he\\'s in']" in " ".join(x.line for x in graphs.cypher(e, r).collect())
    graphs.write_ontology(spark.createDataFrame([("a", "")], "name string, description string"), spark.createDataFrame([("r", ["a"], ["a"])], "name string, head array<string>, tail array<string>"), str(tmp_path / "o"))
    assert graphs.read_ontology(spark, spark.read.text(str(tmp_path / "o")).first().value)[2].count() == 1
    assert graphs.read_settings("# x\nexport LEDGRAPH_A = 'b'\nbad line\nPATH=z")["LEDGRAPH_A"] == "b" and graphs.read_settings("PATH=z")["PATH"] != "z"
    assert "A\\'s" in " ".join(x.line for x in graphs.cypher(e, r).collect())
    once = graphs.upsert(r, r, ["head", "type", "tail"])
    assert once.count() == 1 and graphs.broken_keys(once, ["head", "type", "tail"]).count() == 0
    graphs.write_csv(e, str(tmp_path / "c"))
    bad = '{"entities": [{"name": "a"}], "relations": [{"name": "r", "head": ["a"], "tail": ["b"]}]}'
    with pytest.raises(ValueError, match="isn't declared"):
        graphs.read_ontology(spark, bad)
    _, _, pat = graphs.read_ontology(spark, bad.replace('"b"', '"a"'))
    assert graphs.mermaid(pat).first().diagram == "graph LR\n  a -->|r| a"


def test_stream_of_facts(spark, tmp_path):
    from ledgraph.streaming.facts import value_changes

    rows = [("1", "a", "r", "x", T(0), T(0), None, None), ("2", "a", "r", "x", T(1), T(1), None, None), ("3", "a", "r", "y", T(2), T(2), None, None)]
    spark.createDataFrame(rows, FACTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(FACTS).parquet(str(tmp_path / "in"))
    q = value_changes(s).writeStream.format("memory").queryName("changes").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.tail, r.replaced) for r in spark.sql("select * from changes order by valid_from").collect()] == [("x", None), ("y", "1")]


@pytest.mark.parametrize("per", [7, 1000])
def test_or_blocking_gives_all_pairs_of_large_keys(spark, per):
    rows = [(i, "big" if i % 3 else None, i // 2) for i in range(200)]
    df = spark.createDataFrame(rows + rows[:5], "id long, k1 string, k2 int")
    got = resolution.or_blocking(df, "id", [F.col("k1"), F.col("k2")], **({"per": per} if per < 1000 else {})).collect()
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and (x[1] and x[1] == y[1] or x[2] == y[2])}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


def _edits(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        row, old = [i], row
        for j, e in enumerate(y, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != e)))
    return row[-1]


def test_names_of_any_script_are_compared(spark, tmp_path):
    from math import log2

    from ledgraph.plans import graph_queries

    names_ = ["Zoë Müller", "Zoe Muller", "Łukasz Żak", "日本 商事", "日本 商会", None, "Zoë Mülers", ""]
    rows = [(i, "c", n, "X" if i % 2 else None) for i, n in enumerate(names_)]
    spark.createDataFrame(rows + rows[:2], "record_id long, canon_id string, canonical string, located_in string").write.parquet(f"{tmp_path}/entity_records.parquet")
    got = {(r.a, r.b): r.match_weight for r in graph_queries.fellegi_sunter_fixed(spark, str(tmp_path)).collect()}
    want = {}
    for i, _, x, l in rows:
        for j, _, y, m in rows[i + 1 :]:
            known = x is not None and y is not None
            name = log2(0.9 / 0.01) if known and x == y else log2(0.08 / 0.02) if known and _edits(x.lower(), y.lower()) <= 3 else log2(0.02 / 0.97)
            want[i, j] = round(name + (log2(0.7 / 0.1) if l and m else 0), 6)
    assert got == want
    rows = [(f"e{i}", "person" if i < 7 else None, n) for i, n in enumerate(names_)]
    spark.createDataFrame(rows, "canon_id string, type string, canonical string").write.parquet(f"{tmp_path}/entities.parquet")
    got = {(r.a, r.b): (r.jw, r.lev) for r in graph_queries.name_similarity(spark, str(tmp_path)).collect()}
    both = lambda x, y: (round(similarity.jaro_winkler(x, y), 6), _edits(x, y))
    assert got == {("e0", "e6"): both("zoë müller", "zoë mülers"), ("e3", "e4"): both("日本 商事", "日本 商会")}


def test_word_search_asks_every_twentieth_document(spark, tmp_path):
    from collections import Counter
    from math import log

    from ledgraph.plans import text_queries

    rnd = random.Random(8)
    word = lambda: rnd.choice("dock rail fare desk quota label port crew hull mast".split())
    docs = [(i, rnd.choice([None, " ", word(), f"{word()} {word()}"]), rnd.choice([None, " ".join(word() for _ in range(rnd.randint(0, 9)))])) for i in range(1, 121)]
    spark.createDataFrame(docs, "doc_id long, title string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    vecs = [(i, [float(rnd.randint(1, 9)), float(rnd.randint(1, 9))]) for i in range(0, 110, 5)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    ts = {i: f"{t or ''} {x or ''}".split() for i, t, x in docs}
    ts = {i: x for i, x in ts.items() if x}
    df, mean, want = Counter(w for x in ts.values() for w in set(x)), sum(map(len, ts.values())) / len(ts), {}
    for q, t, x in docs:
        if q % 20 == 0:
            terms = set(((t or "").strip() or x or "").split())
            score = {i: round(sum(log(1 + (len(ts) - df[w] + 0.5) / (df[w] + 0.5)) * b.count(w) * 2.2 / (b.count(w) + 1.2 * (0.25 + 0.75 * len(b) / mean)) for w in terms if w in b), 9) for i, b in ts.items() if terms & set(b)}
            want |= {(q, k): (i, round(score[i], 5)) for k, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:10], 1)}
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in text_queries.bm25_topk(spark, str(tmp_path)).collect()}
    assert len({q for q, _ in want}) >= 4 and got == want
    assert {r.query_id for r in text_queries.hybrid_topk(spark, str(tmp_path)).collect()} == {q for q, _ in want} | {i for i, _ in vecs if i % 20 == 0}


def test_introduced_names_meet_the_keys_of_blocking(spark):
    text_ = "Société Générale SA (SGX) met Muvo Razure Semiconductor B.V. (the “Muvo”), then Acme Inc (NASDAQ: ACM), a firm (XYZ), Acme Group (\"Company\") and one (in 2020)."
    assert names.introduced(text_) == [("Société Générale SA", "SGX"), ("Muvo Razure Semiconductor B.V.", "Muvo"), ("Acme Inc", "ACM"), ("Acme Group", "Company")]
    docs = spark.createDataFrame([(text_,), (None,), ("",)], "text string")
    pairs = names.declared_aliases(docs)
    assert {(r.long_form, r.short_form) for r in pairs.collect()} == {("société générale", "sgx"), ("muvo razure semiconductor bv", "muvo"), ("acme", "acm")}
    m = names.normalized(spark.createDataFrame([("1", "organization", "Muvo Razure Semiconductor B.V."), ("2", "organization", "MUVO")], "id string, type string, text string"))
    got = resolution.candidate_pairs(resolution.block_keys(m, pairs)).collect()
    assert [(r.a, r.b, r.block) for r in got] == [("1", "2", "head")] and resolution.block_keys(m, pairs).where("block = 'alias'").count() == 2


def test_folding_and_cleaning_of_any_script(spark):
    df = spark.createDataFrame([("Łódź ő č ž ÅÇ Ωμέγα Straße",)], "t string")
    r = df.select(names.folded(F.col("t")).alias("f"), names.clean_name(F.col("t")).alias("c"), names.clean_name(F.lit("The Ärzte, Incorporated")).alias("d")).first()
    assert r.f == "łodz o c z ac ωμεγα strasse" and r.c == "łódź ő č ž åç ωμέγα strasse" and r.d == "ärzte"
    k = names.triple_key(spark.createDataFrame([("Dr. Ona Tully",), ("Harbek Inc.",), (None,)], "t string"), "t", "k").collect()
    assert {x.t: x.k for x in k} == {"Dr. Ona Tully": "ona tully", "Harbek Inc.": "harbek", None: None}
    d = spark.createDataFrame([("2024-05-01T10:00:00Z",), ("2024-05-01T12:00:00+02:00",), ("2024-05-01T10:00:00",), ("soon",)], "t string").select(names.to_datetime(F.col("t")).alias("d")).collect()
    assert d[0].d == d[1].d == d[2].d and d[3].d is None


def test_first_person_names_and_pronouns(spark):
    rows = [("s", 0, "A\\1 $x", "I'm here, it's my desk; I’ve me."), ("s", 1, None, "my desk"), ("s", 2, "Ona Tully", "Hello. She left with Ona. Her dog too"), ("s", 3, "Bo", "Ona and mark")]
    t = spark.createDataFrame(rows, "session_id string, turn int, speaker string, said string")
    got = {r.turn: r.said for r in conversation.first_person(t).collect()}
    assert got[0] == "A\\1 $x am here, it's A\\1 $x's desk; A\\1 $x have A\\1 $x." and got[1] == "my desk"
    r = conversation.roster(t)
    full = {x.turn: x.said for x in conversation.full_names(t, r).collect()}
    assert full[3] == "Ona Tully and mark" and full[2].count("Tully") == 1
    p = spark.createDataFrame([("s", 2, "Ona Tully")], "session_id string, turn int, person string")
    assert {x.turn: x.said for x in conversation.bound_pronouns(t, p).collect()}[2] == "Hello. Ona Tully left with Ona. Ona Tully dog too"


def test_episode_ids_of_long_sessions(spark):
    t = spark.createDataFrame([("s", i, "A", "x") for i in range(125)], "session_id string, turn int, speaker string, said string")
    ids = [r.doc_id for r in conversation.episodes(t).select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and {"s:w00", "s:w12", "s:w120"} <= set(ids)


def test_nearest_neighbours_across_tiles(spark):
    rnd = random.Random(3)
    rows = [(i, i % 2 if i else None, [rnd.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(60)] + [(99, 0, None)]
    v = spark.createDataFrame(rows, "id long, g int, v array<double>")
    cos = lambda x, y: sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
    ok = [(i, g, x) for i, g, x in rows if g is not None and x and any(x)]
    want = set()
    for i, g, x in ok:
        near = sorted((-round(cos(x, y), 9), j) for j, h, y in ok if h == g and j != i)[:3]
        want |= {(min(i, j), max(i, j)) for _, j in near}
    got = {(r.a, r.b) for r in resolution.knn_pairs(v, "id", "v", "g", 3, tile=7).collect()}
    assert len(got ^ want) <= 0.2 * len(want)  # equal cosines may differ in the last bit
    assert {(r.a, r.b) for r in resolution.knn_pairs(v, "id", "v", "g", 3).collect()} and resolution.knn_pairs(v.limit(0), "id", "v", "g").count() == 0


def test_islands_against_a_plain_fold(spark):
    rnd = random.Random(4)
    rows = [(f"f{i:03d}", rnd.choice(["a", "a", "b"]), "r", rnd.choice("xyz"), T(rnd.randint(0, 200)), T(i), 0.5, 1) for i in range(150)]
    df = spark.createDataFrame(rows, "fact_id string, head string, relation string, tail string, valid_from timestamp_ntz, recorded_at timestamp_ntz, confidence double, support int")
    want = []
    for h in "ab":
        run = None
        for r in sorted((x for x in rows if x[1] == h), key=lambda x: (x[4], x[5], x[3], x[0])):
            if run is None or run[1] != r[3]:
                run = [h, r[3], r[4], 0]
                want.append(run)
            run[3] += 1
    got = sorted((r["head"], r.valid_from, r.tail, r.support) for r in facts.islands(df, ["head", "relation"]).collect())
    assert got == sorted((h, s, t, n) for h, t, s, n in want)
    assert facts.islands(df.limit(0), ["head"]).count() == 0


def test_registry_grows_by_episodes(spark, tmp_path):
    from ledgraph.operators import registry
    from ledgraph.streaming.facts import resolve_batches

    schema = "mention_id string, type string, text string, context string, confidence double, doc_id long"
    one = spark.createDataFrame([("1", "company", "Harbek Line Inc.", None, 0.9, 1), ("2", "company", "Harbek Line", None, 0.9, 1), ("3", "person", "Ona Tully", None, 0.9, 1), ("4", "person", None, None, 0.9, 1)], schema)
    reg, m = registry.add_episode(spark.createDataFrame([], registry.REGISTRY), one, "e1")
    assert {r.canon_id: r.aliases for r in reg.collect()} == {"company:harbek-line-inc": ["Harbek Line"], "person:ona-tully": []}
    two = spark.createDataFrame([("5", "person", "Tully", None, 0.9, 2), ("6", "person", "Ida Moor", None, 0.9, 2)], schema)
    reg2, m2 = registry.add_episode(reg, two, "e2")
    got = {r.canon_id: (r.first_seen, r.last_seen) for r in reg2.collect()}
    assert got == {"company:harbek-line-inc": ("e1", "e1"), "person:ona-tully": ("e1", "e2"), "person:ida-moor": ("e2", "e2")}
    assert {r.mention_id: r.canon_id for r in m2.collect()} == {"5": "person:ona-tully", "6": "person:ida-moor"}
    live = {r.mention_id: (r.canon_id, r.pass_no) for r in registry.live_resolve(reg, two).collect()}
    assert live == {"5": ("person:ona-tully", 1), "6": ("new:6", 2)}
    one.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = resolve_batches(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), f"file://{tmp_path}/reg").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "reg/v=0")).count() == 2


def test_slots_and_labels(spark):
    from ledgraph.operators import slots

    docs = spark.createDataFrame([(1, "Ona Tully works at Harbek Line. Ida naps."), (2, None)], "doc_id long, text string")
    got = slots.extract(docs, slots.RuleExtractor([("ona tully", "person"), ("Harbek Line", "company")], {"works at": "works_at"}))
    m = slots.mentions_of(got, docs).collect()
    assert [(x.mention_id, x.span_start, x.confidence) for x in m] == [("1:e1", 0, 1.0), ("1:e2", 19, 1.0)]
    assert [(e["head"], e["tail"]) for e in slots.edges_of(got).collect()] == [("1:e1", "1:e2")]
    with pytest.raises(ValueError):
        slots.RuleExtractor([("a", "b")] * 3, {}, most=2)
    ents = spark.createDataFrame([("c", "person", "Ona", True), ("c", "firm", "Harbek", True), ("c", "ghost", "X", True), ("c", "person", "Ida", False)], "chunk_id string, type string, text string, in_text boolean")
    rels = spark.createDataFrame([("c", "works_at", "ona", "Harbek"), ("c", "works_at", "Ona", "harbek"), ("c", "works_at", "Harbek", "Ona"), ("c", "likes", "Ona", "Harbek"), ("c", "works_at", "Ida", "Harbek"), ("c", "works_at", "Ona", "Ona")], "chunk_id string, type string, head string, tail string")
    types = spark.createDataFrame([("person",), ("firm",)], "name string")
    pats = spark.createDataFrame([("person", "works_at", "firm")], "head_type string, type string, tail_type string")
    e, r = slots.judged_labels(ents, rels, types, pats)
    n = {(x.what, x["drop"]): x.n for x in slots.label_stats(e, r).collect()}
    assert n == {("entity", None): 2, ("entity", "unknown type"): 1, ("entity", "span not in text"): 1, ("relation", None): 1, ("relation", "repeated"): 1, ("relation", "ontology violation"): 1, ("relation", "unknown name"): 1, ("relation", "endpoint gone"): 1, ("relation", "same ends"): 1}
    cl = spark.createDataFrame([(1, 0, 0, 9), (1, 0, 32, 35), (1, 1, 19, 30)], "doc_id long, cluster int, span_start int, span_end int")
    d = spark.createDataFrame([(1, "Ona Tully works at Harbek Line. Her dog naps.")], "doc_id long, text string")
    assert slots.substituted(d, cl).first().text == "Ona Tully works at Harbek Line. Ona Tully's dog naps."
    p = spark.createDataFrame([({"b": 0.5, "a": 0.5, "c": 0.1},), ({},)], "probs map<string,double>")
    assert [(x.label, x.alternatives) for x in slots.likeliest(p, least=0.2).collect()] == [("a", ["b"]), (None, [])]
    w = slots.word_chunks(spark.createDataFrame([(1, " ".join(map(str, range(20))))], "doc_id long, text string"), 8, 3).collect()
    assert [x.text.split()[0] for x in w] == ["0", "5", "10", "15"] and w[-1].text.split()[-1] == "19"


def test_generated_queries_may_only_read(spark):
    from ledgraph.operators.retrieval import ask_tables, reads_only

    spark.range(5).createOrReplaceTempView("facts_view")
    ok = ["select id, count(*) n from facts_view where id > 1 group by id order by n limit 3", "with a as (select * from facts_view) select * from a"]
    bad = ["drop table facts_view", "select * from other", "insert into facts_view select 1", "select reflect('java.lang.System', 'exit', 1) from facts_view", "create table x as select 1", "select 1; drop table y", "set a=b", "select * from facts_view where id in (select id from secret)"]
    assert all(reads_only(spark, q, {"facts_view"}) for q in ok) and not any(reads_only(spark, q, {"facts_view"}) for q in bad)
    assert ask_tables(spark, "how many?", lambda _: "select count(*) n from facts_view", {"facts_view"}).first().n == 5


def test_triples_are_matched_by_likeness_once(spark):
    s = "seq int, head string, relation string, tail string"
    pred = spark.createDataFrame([(0, "ona tully", "works_at", "harbek line"), (1, "ona tully", "works_at", "harbek"), (2, "x", "works_at", "y"), (3, "a", "likes", "b")], s)
    gold = spark.createDataFrame([(0, "ona tully", "works_at", "harbek line"), (1, "tully ona", "works_at", "harbek"), (2, "b", "likes", "a")], s)
    r = evaluate.fuzzy_triple_score(pred, gold).first()
    assert (r.matched, r.loosened, r.spurious, r.missed) == (2, 1, 2, 1)
    assert evaluate.fuzzy_triple_score(pred, gold, directed=False).first().matched == 3


def test_fuzzy_links_and_first_hits(spark):
    v = spark.createDataFrame([("k1", "Harbek Line", None), ("k2", "Oslo", ["Christiania"])], "key string, canonical string, aliases array<string>")
    s = spark.createDataFrame([("Harbeck Line",), ("Cristiania",), ("Zzz",), (None,)], "text string")
    assert {r.text: r.key for r in linking.fuzzy(s, v, 0.85).collect()} == {"Harbeck Line": "k1", "Cristiania": "k2"}
    l = spark.createDataFrame([("m", 1, 10)], "mention_id string, doc_id int, at int")
    r = spark.createDataFrame([("a", 1, 11), ("b", 1, 9), ("c", 1, 99)], "other string, doc_id int, at int")
    assert [x.other for x in linking.near_spans(l, r, ["doc_id"], "at", 2, F.col("other").desc()).collect()] == ["b"]


def test_likely_pairs_hold_every_good_one_and_not_all_that_share_a_word(spark):
    from ledgraph.operators import likeness

    rnd = random.Random(5)
    part = lambda: "".join(rnd.choice("dkmrtz") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 3)))
    name = lambda: " ".join([part(), part(), rnd.choice(["hotels", "foods", "semiconductor"]), rnd.choice(["llc", "b v", "ag"])][: rnd.randint(1, 4)])

    def spoilt(s):
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(s))
            s = rnd.choice([s[:i] + s[i + 1 :], s[:i] + rnd.choice("aekx") + s[i:], s[:i] + "x" + s[i + 1 :], f"the {s}", f"{s} {s.split()[-1] if s.split() else 'x'}", s[: i + 2], " ".join(reversed(s.split()))]) or "a"
        return " ".join(s.split()) or "a"

    right = sorted({name() for _ in range(250)} | {f"{part()} {'long ' * 13}hotels llc" for _ in range(5)} | {"ra", "ag"})
    left = sorted({spoilt(rnd.choice(right)) for _ in range(400)} | {name() for _ in range(100)})
    df = lambda x: spark.createDataFrame([(v,) for v in x], "s string")
    words = lambda s: {w for w in s.split() if len(w) > 1} | {w[:i] + w[i + 1 :] for w in s.split() if len(w) >= 5 for i in range(len(w))}
    meets = {(a, b) for a in left for b in right if a != b and words(a) & words(b)}
    for least in (0.9, 0.93, 0.96):
        want = {p for p in meets if similarity.weighted(*p) >= least}
        got = {tuple(r) for r in likeness.pairs(df(left), df(right), least).collect()}
        assert want <= got and len(want) > 20 and len(got) < len(meets) / 4
        v = spark.createDataFrame([(f"k{i:04d}", s, None) for i, s in enumerate(right)], "key string, canonical string, aliases array<string>")
        best: dict = {}
        for a in left:
            for i, b in enumerate(right):
                if words(a) & words(b) and (x := similarity.weighted(a, b)) >= least:
                    best[a] = min(best.get(a, (0, "")), (-x, f"k{i:04d}"))
        assert {r.text: (-r.score, r.key) for r in linking.fuzzy(df(left).withColumnRenamed("s", "text"), v, least).collect()} == best
    assert sorted(likeness.like(["a" * 70, "b" * 64], ["a" * 69, "b" * 66, "c"], 0.9)) == [(0, 0), (1, 1)]


def test_live_resolution_scores_names_and_not_their_mentions(spark, monkeypatch):
    from ledgraph.operators import registry

    reg = spark.createDataFrame([("o1", "organization", "Harbek Line", ["moves freight from the port"]), ("o2", "organization", "Oslo", None)], "canon_id string, type string, canonical string, aliases array<string>")
    rows = [(f"a{i:03d}", "organization", "Oslo", f"context {i}") for i in range(300)]
    rows += [(f"b{i:03d}", "organization", "Bergen Works", f"context {i}") for i in range(300)]
    rows += [("c1", "organization", "Harbek Line Port", "moves freight from the port"), ("c2", "organization", "Harbek Line Port", None), ("d1", "organization", "Zeta Kilo", "ships"), ("d2", "organization", "Zeta Kilo Mast", "ships"), ("e1", "organization", "...", None), ("e2", "organization", "...", None)]
    scored, plain = [], registry.score_pairs

    def counted(pairs, *more):
        scored.append(pairs.count())
        return plain(pairs, *more)

    monkeypatch.setattr(registry, "score_pairs", counted)
    m = spark.createDataFrame(rows + rows[:50], "mention_id string, type string, text string, context string")
    got = {r.mention_id: (r.canon_id, r.pass_no, r.score and round(r.score, 2)) for r in registry.live_resolve(reg, m).collect()}
    assert got["c1"] == ("o1", 1, 0.92) and got["c2"] == ("new:c2", 2, None) and got["d1"] == got["d2"] == ("new:d1", 2, None)
    assert all(got[f"a{i:03d}"] == ("o2", 1, 1.0) and got[f"b{i:03d}"] == ("new:b000", 2, None) for i in range(300)) and len(got) == len(rows)
    assert got["e1"] == got["e2"] == ("new:e1", 2, None)
    assert sum(scored) < 20


@pytest.mark.parametrize("many", [False, True])
def test_widened_pairs_are_given_once_without_comparing_them(spark, many):
    import re

    rnd = random.Random(8)
    texts = ["AB", "ABC", "A&B", "ab", "Abc", " abc", "ßA", "SSA", "ssa", "B.V", "b.v", "Bergen", "alpha", "", "straße", "STRASSE", "strasse", "K", "KM", "km"]
    ms = [(f"m{i:03d}", rnd.choice(["org", "tool", "place"]), rnd.choice(texts)) for i in range(150)] + [("x", None, "AB"), ("y", "org", None)]
    ms += ms[:20] + ([(i, rnd.choice(["org", "tool"]), rnd.choice(texts)) for i, *_ in ms[:30]] if many else [])
    fold = lambda s: s.lower().replace("ß", "ss").replace("ς", "σ")
    rows = {r for r in ms if None not in r}
    want = set()
    for i, t, s in rows:
        for j, u, v in rows:
            if t != u and i != j and (fold(s) == fold(v) or re.fullmatch("[A-Z][A-Z&.]{1,5}", s) and s[:1].lower() == v.strip(" ")[:1].lower()):
                want.add((min(i, j), max(i, j)))
    df = linking.widened(spark.createDataFrame(ms, "mention_id string, type string, text string"))
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert many or "Aggregate(keys=[a#" not in df._jdf.queryExecution().executedPlan().toString()
    l = spark.createDataFrame([("k", f"x{i}", "p" if i % 3 else "q") for i in range(40)], "k string, x string, tx string")
    r = spark.createDataFrame([("k", f"y{i}", "q") for i in range(50)] + [("z", "y", "p")], "k string, y string, ty string")
    assert sorted(tuple(c) for c in linking.crossed(l, r, 7, 11, 100).select("x", "y").collect()) == sorted((f"x{i}", f"y{j}") for i in range(40) if i % 3 for j in range(50))


def test_queries_equal_their_sql_on_the_smallest_tables(spark):
    """Every core query that has SQL, on sf0.001; bounded to the quick ones' order of magnitude by the size of the tables."""
    import os

    import duckdb
    import pandas as pd

    import __spark_entry__ as entry

    base = "/root/testdata/sf0.001"
    if not os.path.isdir(base):
        pytest.skip("the test tables aren't there")
    con = duckdb.connect()
    for f in os.listdir(base):
        con.execute(f"create view {f[:-8]} as select * from '{base}/{f}'")

    def one(x):
        if hasattr(x, "__iter__") and not isinstance(x, str):
            return str([one(y) for y in x])
        return "~" if pd.isna(x) else f"{x:.5f}" if isinstance(x, float) else str(x)

    rows = lambda df: sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    sql, bad = entry.oracle_sql(), []
    for name, q in entry.queries().items():
        if name in sql and q.__module__.startswith("ledgraph.plans"):
            if rows(q(spark, base).toPandas()) != rows(con.execute(sql[name]).df()):
                bad.append(name)
    assert not bad


def test_word_search_over_shards_equals_plain_sums(spark):
    from collections import Counter
    from math import log

    from ledgraph.operators import retrieval

    rnd = random.Random(12)
    word = lambda: rnd.choice(["the", "the", "at", *(f"w{i}" for i in range(30))])
    docs = [(rnd.randint(1, 150), " ".join(word() for _ in range(rnd.randint(0, 12)))) for _ in range(200)] + [(500, None)]
    docs += docs[:20]
    ix = retrieval.word_index(spark.createDataFrame(docs, "d long, words string"), "d", "words")
    asks = [(f"q{i}", " ".join(word() for _ in range(4))) for i in range(30)] + [("none", "zzz"), ("null", None)]
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in retrieval.bm25(ix, spark.createDataFrame(asks, "query_id string, words string"), 5, shard=40, block=7).collect()}
    rows: dict = {}  # copies of a document of one length are one text
    for i, t in docs:
        if t:
            rows.setdefault((i, len(t.split())), []).extend(t.split())
    df, mean, want = Counter(w for ts in rows.values() for w in set(ts)), sum(dl for _, dl in rows) / len(rows), {}
    for q, t in asks:
        score: Counter = Counter()
        for (i, dl), ts in rows.items():
            for w in set((t or "").split()) & set(ts):
                score[i] += log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * ts.count(w) * 2.2 / (ts.count(w) + 1.2 * (0.25 + 0.75 * dl / mean))
        score = {i: round(s, 9) for i, s in score.items()}
        want |= {(q, k): (i, score[i]) for k, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:5], 1)}
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 2e-9 for x in want)


def test_or_blocking_lists_a_pair_once_and_is_counted_without_pairs(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["p", "q", None]), rnd.choice([None, *"abc"]), rnd.choice([None, *"xyz"])) for i in range(120)]
    p = spark.createDataFrame(rows, "id long, cluster string, k1 string, k2 string")
    pairs = resolution.or_blocking(p, "id", [F.col("k1"), F.col("k2")], per=9)
    want = evaluate.blocking_report(pairs, p, p.agg(F.count(F.lit(1)).alias("n"))).first()
    got = evaluate.key_blocking_report(p, "id", ["k1", "k2"], "cluster")
    assert got.first() == want
    many = spark.range(200_000).select("id", F.lit("p").alias("cluster"), F.lit("a").alias("k1"), F.col("id").cast("string").alias("k2"))
    assert evaluate.key_blocking_report(many, "id", ["k1", "k2"], "cluster").first()[:3] == (200_000 * 199_999 // 2,) * 3
    more = rows + [(i, None, rnd.choice("abc"), rnd.choice("xyz")) for i in range(0, 120, 9)]  # ids of two rows
    got = [(r.a, r.b) for r in resolution.or_blocking(spark.createDataFrame(more, "id long, cluster string, k1 string, k2 string"), "id", [F.col("k1"), F.col("k2")], per=9).collect()]
    brute = {(x[0], y[0]) for x in more for y in more if x[0] < y[0] and (x[2] and x[2] == y[2] or x[3] and x[3] == y[3])}
    assert len(got) == len(set(got)) and set(got) == brute


def test_known_candidates_equal_those_of_the_whole_index(spark):
    """The best of all entities that share a rare word, for names of common words; a row for each of those was shuffled before."""
    from math import log

    from ledgraph.operators import registry

    rnd = random.Random(2)
    some = lambda n: " ".join(rnd.choice("amber basin cedar delta ember".split()) for _ in range(n))
    ents = [(f"e{i:02d}", "place", some(rnd.randint(1, 4)), [some(2)] if i % 3 else None) for i in range(40)]
    asks = [(f"m{i:02d}", "place", some(rnd.randint(1, 4))) for i in range(30)]
    asks += [(f"n{i:02d}", k, t) for i, (_, k, t) in enumerate(asks)]
    got = {(r.mention_id, r.canon_id): (r.score, r.arm) for r in registry.known_candidates(spark.createDataFrame(ents, "canon_id string, type string, canonical string, aliases array<string>"), spark.createDataFrame(asks, "mention_id string, type string, text string"), 2).collect()}
    words = {e: set(f"{c} {' '.join(a or [])}".split()) for e, _, c, a in ents}
    idf, want = {w: log(1 + len(ents) / sum(w in x for x in words.values())) for w in "amber basin cedar delta ember".split()}, {}
    for m, _, t in asks:
        rare = sorted(set(t.split()), key=lambda w: (-idf[w], w))[:3]
        score = {e: round(sum(idf[w] for w in rare if w in x) / sum(idf[w] for w in set(t.split())), 6) for e, x in words.items() if x & set(rare)}
        for e in sorted(score, key=lambda e: (-score[e], e))[:2]:
            want[m, e] = score[e], "words"
        for e, _, c, a in ents:
            if t in (c, *(a or [])):
                want[m, e] = 1.0, "exact"
    assert {x: (round(s, 6), a) for x, (s, a) in got.items()} == want


def test_known_candidates_share_any_of_a_name_s_words(spark, tmp_path):
    """All words of a name are looked up, not its three rarest; also of names with more words than are looked up in parts."""
    from math import log

    from ledgraph.plans import more_queries

    rnd, voc = random.Random(3), "amber basin cedar delta ember fjord gorge heath islet jetty knoll".split()
    some = lambda n: " ".join(rnd.sample(voc, n))
    ents = [(f"e{i:02d}", "place", some(rnd.choice([1, 2, 4, 6, 10])), [some(2)] if i % 3 else None) for i in range(50)]
    ents.append(("e99", "place", "harbour", None))
    asks = [(f"m{i:02d}", "place", some(rnd.choice([1, 3, 4, 5, 8, 9, 11]))) for i in range(40)]
    asks += [(f"n{i:02d}", k, t + " zzyzx") for i, (_, k, t) in enumerate(asks)] + [("o", "place", "harbour amber basin cedar")]
    spark.createDataFrame(ents, "canon_id string, type string, canonical string, aliases array<string>").write.parquet(f"{tmp_path}/entities.parquet")
    spark.createDataFrame(asks, "mention_id string, type string, text string").write.parquet(f"{tmp_path}/mentions.parquet")
    got = {(r.mention_id, r.canon_id): (r.score, r.arm) for r in more_queries.known_candidates(spark, str(tmp_path)).collect()}
    words = {e: set(f"{c} {' '.join(a or [])}".split()) for e, _, c, a in ents}
    idf, want = {w: log(1 + len(ents) / sum(w in x for x in words.values())) for w in [*voc, "harbour"]}, {}
    for m, _, t in asks:
        ts = set(t.split()) & idf.keys()
        score = {e: round(sum(idf[w] for w in sorted(ts & x)) / sum(idf[w] for w in sorted(ts)), 9) for e, x in words.items() if x & ts}
        for e in sorted(score, key=lambda e: (-score[e], e))[:5]:
            want[m, e] = score[e], "words"
        for e, _, c, a in ents:
            if t in (c, *(a or [])):
                want[m, e] = 1.0, "exact"
    assert {x: (round(s, 6), a) for x, (s, a) in got.items()} == {x: (round(s, 6), a) for x, (s, a) in want.items()}


def test_or_blocking_sends_no_large_keys_to_the_driver_and_no_null_ids(spark):
    """The table of large keys isn't broadcast by force; a null id made a pair of its partner with itself."""
    rows = [(None if i in (3, 50) else i, "big" if i % 4 else None, rnd) for i, rnd in zip(range(90), random.Random(4).choices("abc", k=90), strict=True)] + [(7, "other", "a"), (8, "other", "b"), (7, None, "c")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = resolution.or_blocking(spark.createDataFrame(rows, "id long, k1 string, k2 string"), "id", [F.col("k1"), F.col("k2")], per=7)
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        got = [(r.a, r.b) for r in df.collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    known = [x for x in rows if x[0] is not None]
    want = {(x[0], y[0]) for x in known for y in known if x[0] < y[0] and (x[1] and x[1] == y[1] or x[2] == y[2])}
    assert len(got) == len(set(got)) and set(got) == want
