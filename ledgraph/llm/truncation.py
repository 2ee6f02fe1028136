"""Text cut off by field limits or broken transfers.

Lengths are recomputed under the encodings a store may have counted in; a length at which far more different texts
of a source end than around it, most of them unended, is a hidden limit. The endings are then inspected: of texts
at a limit, of texts with a cutter's mark, and of all others against how last lines of their kind usually end, which
is learned from texts that aren't at a limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgraph.sources.tables import stage

#: Marks left by cutting, ends of sentences, and abbreviations whose full stop ends no sentence.
MARKS = r"(?:\.\.\.|…|\[\s*(?:…|\.\.\.|more|truncated|cut)?\s*\]?|\((?:truncated|more|cont\.?|continued)\)|�+|(?i:read more|<truncated>|-- more --))"
STOPS = r"[.!?。！？؟।]"
CLOSERS = "[\"'”’»)\\]}」』*_]"
ABBREVIATIONS = r"(?:^|[\s(])(?:(?:\p{L}\.)+|Inc\.|Corp\.|Co\.|Ltd\.|Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.|No\.|St\.|vs\.|ca\.|Nr\.|Sr\.|Jr\.)$"
MARK_AT_END = rf"(?U)\s*{MARKS}$"
#: A sentence's end, which pictures may follow; an abbreviation's full stop is none.
ENDED = rf"{STOPS}{CLOSERS}*[\s\p{{So}}\p{{Sk}}\uFE0F\u200D]*$"
ABBREVIATED = ABBREVIATIONS.removesuffix("$") + r"[\s\p{So}\p{Sk}\uFE0F\u200D]*$"
#: Stands for the first word of a last line of several sentences.
PROSE = "\n"
ENCODINGS = ("chars", "utf16", "utf8", "html", "html_utf8", "quoted_html", "json", "json_utf8", "crlf", "crlf_utf8", "lf")


WHITE = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\u200b\ufeff"


def _count(*marks: str):
    """How often the ASCII marks stand in the text, by bytes."""
    size = F.octet_length("text")
    one = lambda m: (size - F.octet_length(F.replace("text", F.lit(m), F.lit("")))) / len(m)
    total = one(marks[0])
    for m in marks[1:]:
        total = total + one(m)
    return total


def lengths() -> dict:
    """The text's length as a store would count it, by encoding."""
    n, b = F.length("text"), F.octet_length("text")
    pairs, lines, returns = _count("\r\n"), _count("\n"), _count("\r")
    esc = 4 * _count("&") + 3 * _count("<", ">")
    double = _count('"')
    quotes = 5 * (double + _count("'"))
    slashes = double + _count("\\", "\t") + lines + returns
    crlf = lines + returns - 2 * pairs
    utf16 = F.octet_length(F.encode("text", "UTF-16BE")) / 2
    return dict(zip(ENCODINGS, (n, utf16, b, n + esc, b + esc, n + esc + quotes, n + slashes, b + slashes, n + crlf, b + crlf, n - pairs)))


def inspected(docs: DataFrame) -> DataFrame:
    """One row per text that isn't null or blank: its lengths and how it ends. Written once, as all steps read it.

    Everything is taken from the whole text: its last line and the one before, whatever their length. Patterns that
    look at an end are anchored there, so a long line costs no more than a short one.
    """
    d = docs.select("doc_id", "source", "text").where(F.trim("text", F.lit(WHITE)) != "")
    full = F.translate(F.rtrim("text", F.lit(WHITE)), "\r", "\n")
    d = d.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.xxhash64("text").alias("text_hash"), F.array(*[v.cast("int") for v in lengths().values()]).alias("lens"), full.alias("full"))
    d = d.withColumn("line", F.substring_index("full", "\n", -1))
    cut = F.length("line") - F.length(F.regexp_replace("line", MARK_AT_END, ""))
    d = d.withColumn("cut", cut).withColumn("mark", (F.col("cut") > 0) & (F.col("cut") < F.length("full")))
    d = d.withColumn("tail", F.when(F.col("mark"), F.rtrim(F.expr("left(full, length(full) - cut)"), F.lit(WHITE))).otherwise(F.col("full"))).drop("full", "cut", "line")
    d = d.withColumn("last", F.substring_index("tail", "\n", -1))
    d = d.withColumn("ended", F.rtrim("last", F.lit(WHITE)).rlike(ENDED) & ~F.col("last").rlike(ABBREVIATED))
    d = d.withColumn("before", F.substring_index(F.rtrim(F.expr("left(tail, length(tail) - length(last))"), F.lit(WHITE)), "\n", -1))
    said = F.regexp_replace("last", r"^\s*(?:>\s*)+", "")  # a quoted line is of the kind of what it quotes
    first = F.regexp_replace(F.substring_index(F.trim(said), " ", 1), r"(?U)[\d]+|(?<=:)//.*$", "")
    prose = F.length("last") - F.length(F.regexp_replace("last", r"[.!?。！？](?=\s)", "")) >= 2  # sentences, whatever the first of them begins with
    d = d.withColumn("opening", F.when(prose, PROSE).otherwise(first))
    d = d.withColumn("close", F.when(F.length("last") - F.length(F.replace("last", F.lit(" "), F.lit(""))) >= 3, F.lower(F.substring_index("last", " ", -3))).otherwise(F.lit("")))
    name = F.col("before").rlike(r"^[^.!?。]{1,24}[,，]$") & (F.length("last") < 48)
    only = (F.length("tail") < 80) & (F.col("before") == "") & F.col("last").rlike(r"^(?:[\p{Lu}\p{N}&(\"'#@][^\s]*\s*)+$")
    trailing = F.col("last").rlike(r"(?:\.\.\.|…)\s*[^.!?。…]{2,40}$")  # an ellipsis at both ends is a manner of speech
    d = d.select("doc_id", "source", "text_hash", "lens", "mark", "ended", "opening", "close", name.alias("name"), (only | trailing).alias("whole"), F.xxhash64("last").alias("around"))
    return stage(d, "endings")


def _peaks(texts: DataFrame, total: DataFrame, least: int, ratio: float, around: int, share: float) -> DataFrame:
    """(source, e, size, n): of each source the peaks among the sizes of `texts` with the most texts at them."""
    by = texts.select("source", "open", F.posexplode("lens").alias("e", "size")).groupBy("source", "e", "size").agg(F.count(F.lit(1)).alias("n"), F.sum("open").alias("open"))
    high = by.where(F.col("n") >= least)
    near = high.select("source", "e", "size", "n", "open", F.explode(F.expr(f"sequence(size - {around}, size + {around})")).alias("s"))
    rest = by.select("source", "e", F.col("size").alias("s"), F.col("n").alias("m"))
    dense = near.where("s <> size").join(rest, ["source", "e", "s"], "left").groupBy("source", "e", "size", "n", "open").agg((F.sum(F.coalesce("m", F.lit(0))) / (2 * around)).alias("mean"))
    ok = dense.where((F.col("n") >= ratio * F.col("mean") + least - 1) & (F.col("open") * 3 >= F.col("n")))
    ok = ok.join(total, "source").where(F.col("n") >= share * F.col("all"))
    return ok.join(ok.groupBy("source").agg(F.max("n").alias("top")), "source").where(F.col("n") == F.col("top")).select("source", "e", "size", "n")


def limits(seen: DataFrame, least: int = 3, ratio: float = 6.0, around: int = 24, share: float = 0.02) -> DataFrame:
    """(source, encoding, size, texts): the hidden limits, from all texts.

    Copies of a text count once. A size is a limit if at least `least` different texts and `share` of the source's
    have it, `ratio` times the mean of the sizes within `around`, and at least a third of them don't end a sentence.
    The size with the most texts stands, in whichever encodings have that many; the texts at it are taken out, and the
    rest is looked through again until no size is left, so a source may have several limits, and none is the shadow
    of another in a second encoding.
    """
    texts = stage(seen.groupBy("source", "text_hash").agg(F.first("lens").alias("lens"), F.max((~F.col("ended") | F.col("mark")).cast("int")).alias("open")), "texts")
    total = texts.groupBy("source").agg(F.count(F.lit(1)).alias("all"))
    found = None
    while True:
        got = stage(_peaks(texts, total, least, ratio, around, share), "limits")
        if got.isEmpty():
            return got if found is None else found
        found = got if found is None else found.unionByName(got)
        texts = _at(texts, got).where("not at").drop("at")


def _at(seen: DataFrame, found: DataFrame) -> DataFrame:
    """`seen` with `at`: whether the text has a size of `found`; in bytes up to 3 less, as a character cut in two is dropped."""
    lim = found.groupBy("source").agg(F.collect_list(F.struct("e", "size")).alias("limits"))
    byte = [i for i, e in enumerate(ENCODINGS) if e.endswith("utf8")]
    slack = f"if(x.e in ({', '.join(map(str, byte))}), 3, 0)"
    at = F.coalesce(F.expr(f"exists(limits, x -> lens[x.e] between x.size - {slack} and x.size)"), F.lit(False))
    return seen.join(lim, "source", "left").withColumn("at", at).drop("limits")


def at_limits(seen: DataFrame) -> DataFrame:
    """`seen` with `at`: whether the text has the size of a hidden limit of its source."""
    return _at(seen, limits(seen))


def endings(seen: DataFrame) -> DataFrame:
    """(opening, usual): whether last lines that begin like this usually stop without a full stop.

    The share of unended ones among the last lines with that first word of texts that aren't at a limit (`at`), drawn
    to what the shape suggests while there are few: lists, headings, signatures, links and labels tend to stop so,
    prose doesn't.
    """
    shape = F.when(F.col("opening").rlike(r"^(?:[-*•–—#|]+|https?:)$"), 0.9).when(F.col("opening").rlike(r"^\p{L}+:$"), 0.5).otherwise(0.1)
    one = seen.where("not mark and not at").groupBy("opening", "text_hash").agg(F.max(F.col("ended").cast("int")).alias("e"))
    n = one.groupBy("opening").agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("e")).alias("u"))
    return n.select("opening", ((F.col("u") + 4 * shape) / (F.col("n") + 4) >= 0.5).alias("usual"))


def truncated(docs: DataFrame) -> DataFrame:
    """(doc_id, source, why) of each document whose text was cut inside a word or a sentence.

    Null, empty and blank texts are no cases; copies of a cut text are. A null source is a source of its own,
    given as ''. A text that doesn't end a sentence (a full stop of an abbreviation ends none) is cut unless its last
    line is of a kind that usually stops so, or a name after a greeting, or, where nothing else tells of a cut, the
    text is but a name, or its last words are a formula that follows three or more different sentences. Why: `limit`
    (it has the size of a hidden limit), `mark` (a cutter's mark is at its end), else `ending`.
    """
    seen = at_limits(inspected(docs))
    said = seen.where("not ended and close <> ''").select("close", "around").distinct().groupBy("close").count().where("count >= 3")
    formula = said.select("close", F.lit(True).alias("formula"))
    d = seen.where("not ended").join(endings(seen), "opening", "left").join(formula, "close", "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    open_ = ~F.col("ended") & no(F.col("usual")) & no(F.col("name"))
    why = F.when(F.col("at") & open_, "limit").when(open_ & no(F.col("formula")) & no(F.col("whole")), F.when(F.col("mark"), "mark").otherwise("ending"))
    return d.withColumn("why", why).where("why is not null").select("doc_id", "source", "why")


def share_by_source(docs: DataFrame) -> DataFrame:
    """(source, n_docs, n_cut, cut_share) for every source of the table, null as ''."""
    cut = truncated(docs).groupBy("source").agg(F.count(F.lit(1)).alias("n_cut"))
    n = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    return n.join(cut, "source", "left").select("source", "n_docs", F.coalesce("n_cut", F.lit(0)).alias("n_cut"), F.round(F.coalesce("n_cut", F.lit(0)) / F.col("n_docs"), 6).alias("cut_share"))
