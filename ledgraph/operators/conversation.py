"""Turns, windows over them, and who is meant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def turns(sessions: DataFrame) -> DataFrame:
    """(session_id, turn, speaker, said) of sessions whose text has a turn in each line; blank lines are none."""
    lines = F.filter(F.split("text", r"\r\n|\r|\n"), lambda x: F.trim(x) != "")
    t = sessions.where("text is not null").select("session_id", F.posexplode(lines).alias("turn", "line"))
    speaker = F.regexp_extract("line", r"^\s*([^:]{1,40}):\s", 1)
    return t.select("session_id", "turn", F.when(speaker != "", speaker).alias("speaker"), F.when(speaker != "", F.regexp_replace("line", r"^\s*[^:]{1,40}:\s+", "")).otherwise(F.col("line")).alias("said"))


def episodes(turns_: DataFrame, window: int = 4, stride: int | None = None) -> DataFrame:
    """(doc_id, session_id, turn_start, n_turns, text): overlapping windows that cover every turn.

    Starts are 0, stride, 2 stride ... while a whole window follows (a short session has one), and a last window at
    the end if turns were left over. Each turn goes to its windows by arithmetic, without a join of turns.
    """
    stride = stride or max(1, window - 1)
    t = turns_.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("session_id")))
    last = F.expr(f"(greatest(n - {window}, 0) div {stride}) * {stride}")
    starts = F.expr(f"filter(sequence(greatest(0, ((turn - {window}) div {stride}) * {stride}), turn), s -> s % {stride} = 0 and s <= last and s > turn - {window})")
    tail = F.when((F.col("last") + window < F.col("n")) & (F.col("turn") >= F.col("n") - window), F.array((F.col("n") - window).cast("int"))).otherwise(F.array().cast("array<int>"))
    t = t.withColumn("last", last).withColumn("start", F.explode(F.array_distinct(F.concat(starts.cast("array<int>"), tail))))
    said = F.concat_ws(": ", "speaker", "said")
    w = t.groupBy("session_id", "start").agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("s")))), lambda x: x["s"]), "\n").alias("text"))
    return w.select(F.concat(F.col("session_id"), F.lit(":w"), F.when(F.col("start") < 10, "0").otherwise(""), F.col("start").cast("string")).alias("doc_id"), "session_id", F.col("start").alias("turn_start"), "n_turns", "text")


def recent_people(mentions: DataFrame, back: int = 3) -> DataFrame:
    """(session_id, turn, person): the one person named within the last `back` turns, where it is only one."""
    w = W.partitionBy("session_id").orderBy("turn").rangeBetween(-back, 0)
    m = mentions.withColumn("who", F.collect_set("name").over(w)).where("size(who) = 1")
    return m.select("session_id", "turn", F.col("who")[0].alias("person")).distinct()


def drop_speakers(mentions: DataFrame, edges: DataFrame, speakers: list[str]) -> tuple[DataFrame, DataFrame]:
    """Mentions that aren't speaker labels, and edges both of whose ends stay."""
    kept = mentions.where(~F.lower(F.trim("text")).isin([s.lower() for s in speakers]) | F.col("text").isNull())
    ids = kept.select("mention_id")
    e = edges.join(ids.withColumnRenamed("mention_id", "head"), "head", "left_semi").join(ids.withColumnRenamed("mention_id", "tail"), "tail", "left_semi")
    return kept, e


def roster(turns_: DataFrame) -> DataFrame:
    """(given, full): given names that stand for exactly one full name among the speakers of all sessions."""
    full = turns_.where("speaker is not null").select(F.trim("speaker").alias("full")).distinct().where("full like '% %'")
    return full.withColumn("given", F.split("full", " ")[0]).groupBy("given").agg(F.min("full").alias("full"), F.count(F.lit(1)).alias("n")).where("n = 1").select("given", "full")


#: Words of the first and third person, and contractions that hide them.
SUBJECT, POSSESSIVE = "i|me|myself", "my|mine"
CONTRACTIONS = (("I'm", "I am"), ("I've", "I have"), ("I'll", "I will"), ("I'd", "I would"))
THIRD, THIRD_POSSESSIVE = "he|she|him|her|they|them|his|hers|their|theirs", ("his", "hers", "their", "theirs")


def _literal(c: Column) -> Column:
    """A value as it may stand in a replacement of regexp_replace."""
    return F.regexp_replace(c, r"([\\$])", r"\\$1")


def first_person(turns_: DataFrame) -> DataFrame:
    """Turns whose first person is replaced by the speaker's name; turns without a speaker stay as they are.

    Contractions are opened first; plurals are left alone. All of it runs inside the JVM; a name is never read as a
    pattern or a replacement.
    """
    said = F.replace("said", F.lit("’"), F.lit("'"))
    for short, long_ in CONTRACTIONS:
        said = F.regexp_replace(said, rf"(?U)\b{short}\b", long_)
    who = _literal(F.col("speaker"))
    said = F.regexp_replace(said, F.lit(rf"(?iU)\b(?:{POSSESSIVE})\b(?!'\w)"), F.concat(who, F.lit("'s")))
    said = F.regexp_replace(said, F.lit(rf"(?iU)\b(?:{SUBJECT})\b(?!'\w)"), who)
    return turns_.select("session_id", "turn", "speaker", F.when(F.col("speaker").isNotNull(), said).otherwise(F.col("said")).alias("said"))


def full_names(turns_: DataFrame, names: DataFrame) -> DataFrame:
    """Turns whose capitalised given names of `names` (given, full) become full ones, unless the turn has that full name.

    Each turn meets only the names among its own words, by a join on the word.
    """
    words = turns_.select("session_id", "turn", F.explode(F.array_distinct(F.regexp_extract_all("said", F.lit(r"(?U)\b\p{Lu}\w*"), F.lit(0)))).alias("given"))
    hits = words.join(names.select("given", "full").distinct(), "given").groupBy("session_id", "turn").agg(F.sort_array(F.collect_list(F.struct("given", "full"))).alias("names"))
    t = turns_.join(hits, ["session_id", "turn"], "left")
    one = lambda acc, n: F.when(F.contains(F.lower(acc), F.lower(n["full"])), acc).otherwise(F.regexp_replace(acc, F.concat(F.lit(r"(?U)\b\Q"), n["given"], F.lit(r"\E\b")), _literal(n["full"])))
    said = F.aggregate("names", F.col("said"), one)
    return t.select("session_id", "turn", "speaker", F.when(F.col("names").isNull(), F.col("said")).otherwise(said).alias("said"))


def bound_pronouns(turns_: DataFrame, people: DataFrame) -> DataFrame:
    """Turns whose sentences' leading third-person pronouns become the one person of `people` (session_id, turn, person), where there is one."""
    t = turns_.join(people, ["session_id", "turn"], "left")
    lead, who = r"(?imU)(^|(?<=[.!?]\s))", _literal(F.col("person"))
    said = F.regexp_replace("said", F.lit(rf"{lead}(?:{'|'.join(THIRD_POSSESSIVE)})\b"), F.concat(who, F.lit("'s")))
    said = F.regexp_replace(said, F.lit(rf"{lead}(?:{THIRD})\b"), who)
    return t.select("session_id", "turn", "speaker", F.when(F.col("person").isNull(), F.col("said")).otherwise(said).alias("said"))


def user_mentions(mentions: DataFrame, user: str) -> DataFrame:
    """(mention_id) of mentions of a person that stand for the user: the name itself or a part of it, whatever the case."""
    t, u = F.lower(F.trim("text")), F.lit(user.lower())
    return mentions.where((F.col("type").isin("person", "user")) & (t != "") & ((t == u) | F.array_contains(F.split(u, r"\s+"), t))).select("mention_id").distinct()
