"""Variant spellings of names: noisy-channel attribution of each spelling to a registered entity.

Spellings are counted over all mentions; an entity's prior is the frequency of its own listed spellings. Candidates
come from equi-joins on spelling keys; each candidate gets the log prior plus the log likelihood of the typos,
initials, abbreviations, codes and reorderings that turn its name into the spelling, and the greatest posterior wins.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgraph.llm.arrow import rows
from ledgraph.llm.folding import deletions, plain, skeleton, within, words
from ledgraph.sources.tables import stage

#: Forms of address, words around names, legal forms of organisations.
TITLES = ("mr", "mrs", "ms", "miss", "mx", "dr", "prof", "sir", "dame", "herr", "frau", "mme", "sr", "sra", "jr", "phd")
AROUND = ("the", "group", "people", "company", "team", "and", "und", "et", "y", "folks", "guys", "holding")
LEGAL = ("inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "plc", "gmbh", "ag", "sa", "bv", "nv", "kg", "se", "oy", "ab", "srl", "spa", "llp", "lp", "pty", "as")
_DOTTED = re.compile(r"\b(\w)\.\s?(\w)\.(?:\s?(\w)\.)?")
_POSSESSIVE = re.compile(r"['’]s\b")


_DIGRAPH = re.compile("([cpst])h")


def codes(name_words: list[str], least: int = 4, most: int = 6) -> set[str]:
    """What a name is abbreviated to: the first `least` to `most` of its consonants, a digraph as one letter or two, and its initials."""
    out = {"".join(w[0] for w in name_words)} if len(name_words) > 1 else set()
    joined = "".join(name_words)
    for text in (joined, _DIGRAPH.sub(r"\1", joined)):
        bare = re.sub("[aeiou]", "", text)
        out |= {bare[:n] for n in range(least, most + 1) if len(bare) >= n}
    return out


def parts(kind: str, text: str) -> tuple[list[str], bool, bool]:
    """The words of a spelling that may name somebody, whether it is a handle, and whether it looks like a code."""
    bare = plain(text)
    if kind == "organization":
        coded = bool(re.fullmatch(r"[A-Z]{2,6}", bare))
        bare = _DOTTED.sub(lambda m: "".join(x for x in m.groups() if x), _POSSESSIVE.sub("", bare))
        every = words(bare, numbers=False)
        got = [w for w in every if w not in AROUND]
        while len(got) > 1 and got[-1] in LEGAL:
            got.pop()
        return got, len(every) == 1 or "_" in bare, coded
    handle = bare.startswith("@") or bool(re.fullmatch(r"[^\W\d]+[._][^\W\d]+|[^\W\d_A-Z]+", bare))
    got = [w for w in words(bare.lstrip("@"), numbers=False) if w not in TITLES]
    return got, handle or len(got) == 1, False


def _spelt(w: str) -> set[str]:
    """Keys that two spellings share if one edit or a likeness of look or sound parts them."""
    return {"k:" + skeleton(w), *("n:" + x for x in deletions(w))}


def _tags(kind: str, got: list[str], handle: bool, coded: bool, entity: bool) -> set[str]:
    """Keys of which a spelling and its entity share at least one; short ones carry the letters that limit them."""
    out: set[str] = set()
    if kind == "organization":
        if entity:
            out |= {"c:" + c for c in codes(got)}
        elif coded and got:
            out.add("c:" + got[0])
        for i in range(len(got) - 1):
            if entity and i:
                break
            if len(got[i]) == 1:
                out |= {f"i:{got[i]}:{x}" for x in deletions(got[i + 1])}
            out |= _spelt(got[i] + got[i + 1])
            if entity:
                out.add("n:" + got[i + 1] + got[i])
                out |= {f"i:{got[i][0]}:{x}" for x in deletions(got[i + 1])}
                out |= {f"i:{got[i + 1][0]}:{x}" for x in deletions(got[i])}
        if not entity:
            for w in got:
                if len(w) >= 7:
                    out |= _spelt(w)
        if handle or entity:
            out.add("h:" + "".join(got)[:7])
        return out
    if entity:
        first, last = got[0], got[-1]
        out |= _spelt(last)
        out |= {"f:" + first[0] + x for x in (last[: len(last) // 2], last[-(len(last) // 2) :]) if len(x) > 2}
        out |= {"h:" + first[0] + last, "h:" + first + last, "h:" + last + first}
        return out
    for w in got:
        if len(w) >= 4:
            out |= _spelt(w)
    if len(got) > 1:
        for a, b in ((got[0], got[-1]), (got[-1], got[0])):
            for n in {len(b) // 2, (len(b) - 1) // 2, (len(b) + 1) // 2}:
                if n > 2:
                    out |= {"f:" + a[0] + b[:n], "f:" + a[0] + b[-n:]}
    if handle:
        out.add("h:" + "".join(got))
        if len(got) == 1 and len(got[0]) > 5:
            out |= _spelt(got[0][1:])
    return out


def _typos(a: str, b: str) -> float | None:
    """Log likelihood of writing the word `b` as `a`, or None where it isn't one word misspelt."""
    most = 1 if len(b) < 5 else 2 if len(b) < 12 else 3
    d = within(a, b, most)
    s = within(skeleton(a), skeleton(b), most)
    best = min(d, s + 0.5)
    return None if min(d, s) > most or min(d, s) > 0.34 * max(len(a), len(b)) else -1.8 * best


def _short(a: str, b: str) -> bool:
    """Whether `a` shortens `b`: begins like it and has its letters in order."""
    it = iter(b)
    return bool(a) and a[0] == b[0] and len(a) < len(b) and all(c in it for c in a)


def score_person(got: list[str], handle: bool, ent: list[str]) -> tuple[float, str] | None:
    """(log likelihood, first name that isn't explained or '') of a spelling of first and last name."""
    first, last = ent[0], ent[-1]
    joined = "".join(got)
    if handle and joined in (first + last, last + first):
        return -0.5, ""
    best = None
    for i, w in enumerate(got):
        lp = _typos(w, last)
        if lp is None and handle and len(got) == 1 and w[0] == first[0]:
            lp = _typos(w[1:], last)
            if lp is not None:
                lp -= 0.5
                if best is None or lp > best[0]:
                    best = (lp, "")
            continue
        if lp is None:
            continue
        rest = got[:i] + got[i + 1 :]
        open_ = ""
        if not rest:
            lp -= 1.5
        else:
            full = [r for r in rest if len(r) > 1]
            near = [r for r in full if within(r, first, 2 if len(first) > 4 else 1) <= 2 and _typos(r, first) is not None]
            if near:
                lp += max(_typos(r, first) for r in near)
            elif full:
                lp, open_ = (lp - 2.0, full[0])
            elif rest[0] == first[0] or any(r == first[0] for r in rest):
                lp -= 0.7
            else:
                continue
        if best is None or lp > best[0]:
            best = (lp, open_)
    return best


def score_organization(got: list[str], handle: bool, coded: bool, ent: list[str]) -> float | None:
    """Log likelihood of a spelling of a name whose first two words tell it from others and whose rest says what it does."""
    if coded and len(got) == 1:
        return -1.0 - 0.2 * abs(5 - len(got[0])) if got[0] in codes(ent) else None
    core, trade = ent[0] + (ent[1] if len(ent) > 1 else ""), ent[2:]
    best = None
    for i in range(len(got)):
        for n in (1, 2):
            piece = got[i : i + n]
            if len(piece) < n:
                continue
            lp = _typos("".join(piece), core)
            if n == 2 and len(ent) > 1:
                if lp is None:
                    lp = _typos(piece[1] + piece[0], core)
                    lp = None if lp is None else lp - 0.7
                if len(piece[0]) == 1 and piece[0] == ent[0][0]:
                    t = _typos(piece[1], ent[1])
                    lp = t - 1.2 if t is not None and (lp is None or t - 1.2 > lp) else lp
                if lp is None and len(piece[0]) == 1 and piece[0] == ent[1][0]:
                    t = _typos(piece[1], ent[0])
                    lp = None if t is None else t - 2.0
            if lp is None:
                continue
            rest = got[:i] + got[i + n :]
            bad = False
            for r in rest:
                if r in LEGAL:
                    continue
                if any(_typos(r, t) is not None or _short(r, t) or t.startswith(r) for t in trade):
                    lp -= 0.3
                else:
                    bad = True
            if not bad and (best is None or lp > best):
                best = lp
    if best is None and handle:
        joined = "".join(got)
        lp = _typos(joined, core + "".join(trade)) if len(joined) > 6 else None
        best = None if lp is None else lp - 0.5
    return best


def _spelling_keys(kinds, texts):
    for k, t in zip(kinds, texts):
        got, handle, coded = parts(k, t)
        if got:
            for tag in _tags(k, got, handle, coded, False):
                yield k, t, tag


def _entity_keys(kinds, ids, names):
    for k, i, t in zip(kinds, ids, names):
        got = parts(k, t)[0]
        if got:
            for tag in _tags(k, got, True, False, True):
                yield k, i, t, tag


def _scores(kinds, texts, ids, names):
    for k, t, i, n in zip(kinds, texts, ids, names):
        got, handle, coded = parts(k, t)
        ent = parts(k, n)[0]
        if k == "person":
            s = score_person(got, handle, ent) if ent else None
            if s is not None:
                yield k, t, i, n, s[0], s[1], ent[0], ent[-1]
        else:
            s = score_organization(got, handle, coded, ent) if ent else None
            if s is not None:
                yield k, t, i, n, s, "", "", ""


def attribute(mentions: DataFrame, entities: DataFrame, kinds: tuple[str, ...] = ("person", "organization"), floor: float = -7.0, margin: float = 0.4, weight: float = 1.0) -> DataFrame:
    """(mention_id, canon_id) of each mention whose text is an unlisted spelling of an entity of its type.

    Texts that are exactly a listed name of their type, null or without letters, and texts for which no entity
    reaches the log posterior `floor` (names of nobody) give no row. A first name that isn't a misspelling is a
    nickname if a registered alias uses it so, or if two or more different surnames of entities stand with it.
    If several entities come within `margin`, the one whose listed name stands in the mention's context is taken,
    else the greatest posterior, ties to the smaller canon_id. Mentions delivered twice come out once.

    A spelling is scored once however often it occurs. Keys are joined by shuffle, and an entity meets a spelling
    once, however many keys they share.
    """
    ents = entities.where(F.col("type").isin(*kinds) & F.col("canonical").isNotNull()).select("type", "canon_id", "canonical", "aliases").dropDuplicates(["canon_id"])
    aliases = ents.select("type", "canon_id", F.explode("aliases").alias("text")).where("text is not null")
    listed = ents.select("type", "canon_id", F.col("canonical").alias("text")).unionByName(aliases).distinct()
    seen = mentions.where(F.col("type").isin(*kinds) & F.col("text").isNotNull()).select("mention_id", "type", "text", "context")
    counts = stage(seen.groupBy("type", "text").agg(F.count(F.lit(1)).alias("n")), "counts")
    # Listed spellings ranked by how often they are written give each entity's prior, against the mean of its type.
    written = listed.join(counts, ["type", "text"], "left").groupBy("type", "canon_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    mean = written.groupBy("type").agg(F.avg("n").alias("mean"))
    prior = written.join(mean, "type").select("canon_id", (weight * F.log((F.col("n") + 1) / (F.col("mean") + 1))).alias("prior"))
    spellings = counts.join(listed.select("type", "text").distinct(), ["type", "text"], "left_anti").select("type", "text")
    s_keys = spellings.mapInArrow(*rows("type string, text string, key string", _spelling_keys))
    names = ents.select("type", "canon_id", F.col("canonical").alias("name"))
    e_keys = names.mapInArrow(*rows("type string, canon_id string, name string, key string", _entity_keys))
    pairs = s_keys.join(e_keys, ["type", "key"]).select("type", "text", "canon_id", "name").distinct()
    scored = stage(pairs.mapInArrow(*rows("type string, text string, canon_id string, name string, like double, nick string, first string, last string", _scores)), "scored")
    # Nicknames: told by an alias, or by two or more surnames.
    first_word = lambda c: F.lower(F.regexp_extract(c, r"(?U)^(\w+)", 1))
    told = aliases.where("type = 'person'").join(names.where("type = 'person'").select("canon_id", "name"), "canon_id")
    told = told.select(first_word(F.col("text")).alias("nick"), first_word(F.col("name")).alias("first"))
    nicks = scored.where("nick <> '' and like > -3").groupBy("nick", "first").agg(F.countDistinct("last").alias("n")).where("n >= 2").select("nick", "first")
    names_first = names.where("type = 'person'").select(first_word(F.col("name")).alias("nick")).distinct()
    nicks = nicks.join(names_first, "nick", "left_anti").unionByName(told).distinct().withColumn("known", F.lit(True))
    good = scored.join(nicks, ["nick", "first"], "left").where("nick = '' or known")
    post = good.join(prior, "canon_id", "left").withColumn("post", F.col("like") + F.coalesce("prior", F.lit(0.0)))
    post = stage(post.where(F.col("post") >= floor).select("type", "text", "canon_id", "post"), "posterior")
    best = post.groupBy("type", "text").agg(F.max("post").alias("top"))
    near = post.join(best, ["type", "text"]).where(F.col("post") >= F.col("top") - margin)
    by_entity = listed.groupBy("canon_id").agg(F.collect_set(F.lower("text")).alias("listed"))
    near = near.join(by_entity, "canon_id").groupBy("type", "text").agg(F.collect_list(F.struct("canon_id", "post", "listed")).alias("rivals"))
    near = stage(near, "rivals")
    sure = near.where("size(rivals) = 1").select("type", "text", F.expr("rivals[0].canon_id").alias("canon_id"))
    sure = seen.select("mention_id", "type", "text").join(sure, ["type", "text"]).select("mention_id", "canon_id")
    # Of the rivals' listed names, which stand in the context?
    open_ = seen.join(near.where("size(rivals) > 1"), ["type", "text"])
    ranked = F.expr("transform(rivals, r -> struct(exists(r.listed, x -> contains(lower(coalesce(context, '')), x)) as told, r.post as post, r.canon_id as canon_id))")
    open_ = open_.select("mention_id", ranked.alias("r")).select("mention_id", "r", F.expr("array_max(transform(r, x -> struct(x.told, x.post)))").alias("m"))
    picked = open_.select("mention_id", F.expr("array_min(transform(filter(r, x -> x.told = m.told and x.post = m.post), x -> x.canon_id))").alias("canon_id"))
    return sure.unionByName(picked).groupBy("mention_id").agg(F.min("canon_id").alias("canon_id"))


def spellings_of(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(canon_id, canonical, variants, n_mentions): the attributed spellings of each entity in order."""
    got = attribute(mentions, entities).join(mentions.select("mention_id", "text").distinct(), "mention_id")
    by = got.groupBy("canon_id").agg(F.array_sort(F.collect_set("text")).alias("variants"), F.count(F.lit(1)).alias("n_mentions"))
    return by.join(entities.select("canon_id", "canonical").dropDuplicates(["canon_id"]), "canon_id").select("canon_id", "canonical", "variants", "n_mentions")
