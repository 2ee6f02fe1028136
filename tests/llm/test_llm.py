"""Small cases and brute force for the training-data operators."""

import random

import pytest

pytest.importorskip("ledgraph.llm.queries")

from ledgraph.llm import arrivals, folding, groups, packing, pieces, replay, survivor, truncation, variants  # noqa: E402


def test_tokens_equal_the_public_encoder_and_empty_texts(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(replay.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    rnd = random.Random(1)
    texts = [None, "", " ", "a  b", "<|endoftext|> x", "日本 語。 x", "don't we'll", "é́ ñ\r\n\r\n x"]
    texts += ["".join(rnd.choice(" \n\ta'sB19.,é語​-") for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", __import__("pyspark").sql.functions.lit("clash"))
    got = {r.doc_id: list(r.ids) for r in replay.token_ids(df, "doc_id", "text").collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in enumerate(texts)}


def _brute_groups(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("limit", [5, 1_000_000])
def test_groups_against_brute_force(spark, limit):
    rnd = random.Random(2)
    edges = [(f"m{i:03d}", f"m{i + 1:03d}") for i in range(40)] + [("z0", f"z{i}") for i in range(1, 30)]
    edges += [(f"r{rnd.randint(0, 60):02d}", f"r{rnd.randint(0, 60):02d}") for _ in range(40)]
    rnd.shuffle(edges)
    df = spark.createDataFrame([*edges, *edges[:5], ("q", "q"), (None, "q")], "a string, b string").repartition(4)
    got = {r.member: r.group_id for r in groups.connected_groups(df, limit=limit, fan_in=2).collect()}
    assert got == {k: v for k, v in _brute_groups([e for e in edges if e[0] != e[1]]).items()}


def test_groups_of_nothing(spark):
    assert groups.connected_groups(spark.createDataFrame([], "a string, b string")).count() == 0


def test_pieces_join_up_and_keep_the_limit():
    rnd = random.Random(3)
    for _ in range(200):
        text = "".join(rnd.choice(["word ", "x" * rnd.randint(1, 60), ". ", "\n\n", "。", " "]) for _ in range(rnd.randint(1, 80)))
        got, forced = pieces.pieces(text, 50, 10)
        assert "".join(text[b:c] for _, b, c in got) == text
        assert all(c - a <= 50 for a, _, c in got)
        runs = __import__("re").split(f"[{pieces.SPACE}]|(?<=[{pieces.MARKS}])", text)
        assert forced == (max(map(len, runs)) > 50)


@pytest.mark.parametrize("size", [30, 44, 60, 200])
def test_every_piece_begins_with_the_overlap(size):
    rnd = random.Random(7)
    for _ in range(100):
        text = "".join(rnd.choice(["word ", "x" * size, "y" * rnd.randint(1, size) + " ", "a b c " * (size // 6) + ". ", "\n\n"]) for _ in range(rnd.randint(4, 60)))
        got, _ = pieces.pieces(text, 50, 12)
        assert "".join(text[b:c] for _, b, c in got) == text and all(c - a <= 50 for a, _, c in got)
        for (a, _, c), (begin, new, _) in zip(got, got[1:]):
            assert new == c and min(9, c - a) <= new - begin <= 12


def test_pieces_of_small_null_and_empty_items(spark):
    df = spark.createDataFrame([("document", "1", None, 5, 1), ("document", "2", "", 5, 1), ("document", "3", "abcdefgh", 5, 1), ("document", "4", "abc", 5, 1)], "item_kind string, item_id string, text string, max_chars int, overlap_chars int")
    rows = pieces.split_items(df).collect()
    assert {r.item_id for r in rows} == {"3"} and all(r.forced and len(r.text) <= 5 for r in rows)


def test_packing_is_whole_and_fits(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["ship", "dock", "fare", "desk"]) for _ in range(rnd.choice([0, 3, 40, 700])))) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(df, capacity=256, shard_docs=20).collect()
    want = {r.doc_id: len(r.ids) for r in replay.token_ids(df, "doc_id", "text").collect()}
    seen: dict = {}
    for r in got:
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.n_tokens
    assert seen == want
    load: dict = {}
    for r in got:
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
    assert max(load.values()) <= 256
    assert {r.container_id for r in got if r.doc_id == 99} == {"none"}


def test_survivors_by_hand(spark):
    rec = spark.createDataFrame(
        [(1, "a", "N/A", ["x", " x ", None, ""], None, "p", "one", None), (2, "a", "Ann", ["x"], ["m"], "q", None, None), (2, "a", "Ann", ["x"], ["m"], "q", None, None), (3, "b", "Bob", None, None, "q", None, None), (4, "c", "-", [], [" "], "q", "?", None), (5, "c", None, None, None, None, "tbd", None)],
        "record_id long, canon_id string, canonical string, aliases array<string>, mentions array<string>, source string, located_in string, updated_at timestamp",
    )
    trust = spark.createDataFrame([("p", 1)], "source string, trust_rank int")
    got = {(r.canon_id, r.field_name): r.record_id for r in survivor.survivors(rec, trust).collect()}
    assert got == {("a", "canonical"): 2, ("a", "located_in"): 1, ("a", "aliases"): 1, ("a", "mentions"): 2}
    assert {(r.field_name, r.value) for r in survivor.truths(rec).where("canon_id = 'a'").collect()} >= {("canonical", "Ann"), ("aliases", "x")}


def test_truncation_finds_a_limit_and_endings(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 9)))
    body = lambda n: (" ".join(word() for _ in range(400)))[:n]
    rows = [(i, "s", body(100)) for i in range(12)] + [(100 + i, "t", body(50 + 7 * i) + ".") for i in range(20)]
    rows += [(200, "t", "Whole sentence.\n\n- a list"), (201, "t", "Whole sentence. Then cut in the mid"), (202, "t", None), (203, "t", " "), (204, None, "It was [")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r.why for r in truncation.truncated(df).collect()}
    assert {i for i, w in got.items() if w == "limit"} == set(range(12))
    assert 201 in got and 200 not in got and 202 not in got and 100 not in got
    assert sum(r.n_docs for r in truncation.share_by_source(df).collect()) == len(rows)


def test_truncation_at_a_limit_outweighs_how_the_last_line_begins(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 9)))
    body = lambda n: (" ".join(word() for _ in range(400)))[:n]
    rows = [(i, "s", body(100)) for i in range(12)] + [(20 + i, "s", (body(40) + ".\n> " + body(90))[:100]) for i in range(6)] + [(30 + i, "s", (body(40) + ".\nx " + body(90))[:100]) for i in range(6)]
    rows += [(40 + i, "t", body(50 + 7 * i) + ".\nSent from my " + word()) for i in range(12)] + [(60, "s", body(79) + ".\nSent from my Nabede")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert len(rows[-1][2]) == 100
    got = {r.doc_id: r.why for r in truncation.truncated(df).collect()}
    assert got == {i: "limit" for i in (*range(12), *range(20, 26), *range(30, 36))}


def test_truncation_reads_whole_lines_and_finds_every_limit(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 9)))
    body = lambda n: (" ".join(word() for _ in range(1200)))[:n]
    rows = [(i, "s", body(300)) for i in range(30)] + [(40 + i, "s", body(700)) for i in range(6)] + [(60 + i, "s", body(rnd.randint(30, 900)) + " done.") for i in range(60)]
    long_list = "- " + body(4998)  # a line of 5,000 characters is a list item, whatever stands near its end
    rows += [(200 + i, "t", f"A sentence.\n- {body(20 + i)}") for i in range(12)] + [(300, "t", f"A sentence.\n{long_list}"), (301, "t", "So it was. " * 450 + "Then it was not as")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    lim = {(r["size"], r.n) for r in truncation.limits(truncation.inspected(df)).where("e = 0").collect()}
    assert lim == {(300, 30), (700, 6)}
    got = {r.doc_id: r.why for r in truncation.truncated(df).collect()}
    assert {i for i, w in got.items() if w == "limit"} == {*range(30), *range(40, 46)} and {i for i in got if i >= 46} == {301}


def test_names_are_attributed_and_strangers_are_not(spark):
    ents = spark.createDataFrame([("person:ann", "person", "Elizabeth Fizigupo", ["Beth Fizigupo"]), ("organization:h", "organization", "Hopo Hafoki Hotels Co.", None), ("person:n", "person", None, None)], "canon_id string, type string, canonical string, aliases array<string>")
    names = ["Elizabeth Fizigupo", "Fizigupo, Elizabeth", "E. Fizigupo", "Elizabeht Fizigupo", "beth.fizigupo", "FIZIGUPO, E.", "Robert Zanatoko", None, "", "🙏"]
    orgs = ["HPHFK", "Hopo Hafoki Htls", "Hotels Hopo Hafoki, Co.", "Hopo Hafoki Freight Co.", "Dina Nugumu Hotels Co."]
    rows = [(f"p{i}", "person", t, None) for i, t in enumerate(names)] + [(f"o{i}", "organization", t, None) for i, t in enumerate(orgs)] + [("p1", "person", names[1], None)]
    m = spark.createDataFrame(rows, "mention_id string, type string, text string, context string")
    got = {r.mention_id for r in variants.attribute(m, ents).collect()}
    assert got == {"p1", "p2", "p3", "p4", "p5", "o0", "o1", "o2"}


def test_arrivals(spark):
    ents = spark.createDataFrame([("product:a", "product", "Fegole Meduda 9 Mini", None)], "canon_id string, type string, canonical string, aliases array<string>")
    rows = [("x1", 1, "product", "fegole-meduda 9 mini"), ("x2", 1, "product", "Fegole Meduda 10 Mini"), ("x3", 2, "product", "Fegole Medudda 10 Mini"), ("x4", 2, "place", "Fegole Meduda 9 Mini"), ("x5", 2, "product", None), ("x6", 3, "place", "New Fegole Meduda 9 Mini"), ("x7", None, "place", "Mini Fegole Meduda 9")]
    inc = spark.createDataFrame(rows, "mention_id string, batch_no int, type string, text string")
    got = {r.mention_id: r.first_id for r in arrivals.repeats(inc, ents).collect()}
    assert got == {"x1": "product:a", "x3": "x2", "x7": "x4"}


def test_a_history_is_opened_again_and_merged(spark, tmp_path):
    ents = spark.createDataFrame([("product:a", "product", "Fegole Meduda 9 Mini", None)], "canon_id string, type string, canonical string, aliases array<string>")
    schema, path = "mention_id string, batch_no int, type string, text string", f"file://{tmp_path}/history"
    first = [("x1", 1, "product", "fegole-meduda 9 mini"), ("x2", 1, "tool", "Sizemuwilu CLI"), ("x3", 1, "tool", None)]
    then = [("x4", 2, "product", "Fegole Medudda 9 Mini"), ("x5", 2, "tool", "Sizemuwiilu CLI"), ("x6", 2, "tool", "Sizemuwilu Sync")]
    got = {(r.mention_id, r.first_id) for r in arrivals.repeats(spark.createDataFrame(first, schema), ents, path).collect()}
    assert got == {("x1", "product:a")}
    later = arrivals.History(spark, path, buckets=3)  # the number of buckets is the one it was made with
    assert later.buckets == 4 and set(later.batches()) == {1}
    later.compact()
    both = {(r.mention_id, r.first_id) for r in arrivals.repeats(spark.createDataFrame(first + then, schema), ents, path).collect()}
    assert both == {("x1", "product:a"), ("x4", "product:a"), ("x5", "x2")}
    parts = arrivals.History(spark, path)._parts()
    assert {r.mention_id for r in arrivals.repeats(spark.createDataFrame(first + then, schema), ents, path).collect()} == {"x1", "x4", "x5"}
    assert arrivals.History(spark, path)._parts() == parts


def test_rare_chunks_miss_no_pair_that_shares_enough(spark):
    rnd = random.Random(9)
    syl = lambda n: "".join(rnd.choice("bdfgk") + rnd.choice("aeiou") for _ in range(n))
    forms = list({f"{syl(3)} {syl(3)} {rnd.choice(['depot', 'annex'])}" for _ in range(150)})
    for f in list(forms):
        i = rnd.randrange(1, len(f) - 7)
        forms.append(f[:i] + f[i + 1 :])
    forms = sorted({" ".join(f.split()) for f in forms})
    rows = [(f"m{i:04d}", i % 3, "place", f) for i, f in enumerate(forms)]
    ents = spark.createDataFrame([], "canon_id string, type string, canonical string, aliases array<string>")
    got = {(r.mention_id, r.first_id) for r in arrivals.repeats(spark.createDataFrame(rows, "mention_id string, batch_no int, type string, text string"), ents).collect()}

    def share(x, y):
        a, b = (arrivals.chunks("".join(arrivals.bare_of(f))) for f in (x, y))
        of = lambda cs, s: sum(len(c) for c in cs if a[c] >> s & 1)
        return max(of([c for c in a if c in b], s) / of(a, s) for s in range(len(arrivals.SEEDS)))

    link = {}
    for i, x in enumerate(forms):
        for j, y in enumerate(forms[:i]):
            late = [p for p, q in (((x, y), i % 3 >= j % 3), ((y, x), j % 3 >= i % 3)) if q]  # the later one asks; of one batch both do
            if abs(len(x) - len(y)) <= 3 and arrivals.same(x, y) and any(share(*p) >= arrivals.COVER for p in late):
                link.setdefault(i, []).append(j)
    linked = {i for i in link} | {j for js in link.values() for j in js}
    told = {int(m[1:]) for m, _ in got} | {int(f[1:]) for _, f in got}
    assert linked and told == linked


def test_folding():
    assert folding.words("François JetÃ¡wave") == ["francois", "jetawave"]
    assert folding.within("abcd", "acbd", 2) == 1 and folding.within("abc", "xyz", 1) == 2


@pytest.mark.parametrize("links", [0, 200_000])
def test_batches_checked_at_once_are_told_as_one_by_one(spark, tmp_path, monkeypatch, links):
    """Labels go from batch to batch, by one task or by joins, and the number of parts doesn't grow with the batches."""
    monkeypatch.setattr(arrivals, "LINKS", links)
    rnd = random.Random(4)
    syl = lambda n: "".join(rnd.choice("bdfgk") + rnd.choice("aeiou") for _ in range(n))
    names = [f"{syl(4)} {syl(4)}" for _ in range(12)]
    typo = lambda s: s[:3] + rnd.choice("lmnp") + s[3:] if rnd.random() < 0.7 else s
    rows = [(f"m{i:03d}", rnd.choice([-1, 2, 3, None]), "place", typo(rnd.choice(names))) for i in range(60)]
    schema = "mention_id string, batch_no int, type string, text string"
    ents = spark.createDataFrame([("place:x", "place", names[0], [typo(names[1])])], "canon_id string, type string, canonical string, aliases array<string>")
    path = f"file://{tmp_path}/history"
    at_once = {(r.mention_id, r.first_id) for r in arrivals.repeats(spark.createDataFrame(rows, schema), ents, path).collect()}
    assert len(arrivals.History(spark, path)._parts()) == 2 and sorted(arrivals.History(spark, path).batches()) == [-1, 2, 3, 2**31]
    history = arrivals.History(spark, f"file://{tmp_path}/other")
    history.accept_entities(ents)
    told = spark.createDataFrame([(i, b if b is not None else 2**31, k, t) for i, b, k, t in rows], "id string, b long, type string, text string")
    forms, apart = arrivals._with_forms(told), set()
    for no in (-1, 2, 3, 2**31):
        apart |= {(r.id, r.label[2:]) for r in history.check(forms.where(f"b = {no}"), no).collect() if r.id != r.label[2:]}
    assert at_once == apart and len(at_once) > 20


def test_letters_of_names_that_are_the_same_differ_by_few_bits():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abdéloq日") for _ in range(rnd.randint(1, 9)))
    near = 0
    for _ in range(4000):
        x = [word() for _ in range(rnd.randint(1, 3))]
        y = [w if rnd.random() < 0.5 else (w[: rnd.randint(0, len(w))] + rnd.choice(["", "x"]) + w[rnd.randint(0, len(w)) :]) or "y" for w in rnd.sample(x, len(x))]
        if arrivals.same(" ".join(x), " ".join(y)):
            near += 1
            assert ((arrivals.letters_of("".join(x)) ^ arrivals.letters_of("".join(y))) & 2**64 - 1).bit_count() <= 2 * arrivals.EDITS
    assert near > 500
