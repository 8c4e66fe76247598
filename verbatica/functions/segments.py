"""Segments of texts, and what the beginning of a session log tells: headers, time, people, subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Speaker marks at the beginning of a line, how many make a text a dialogue, and the groups of lines of a text without paragraphs.
SPEAKERS = [r">[^\S\n]+\S", r"(?:human|user|q)[^\S\n]*:", r"(?:assistant|ai|a|claude|chatgpt)[^\S\n]*:"]
LEAST_TURNS, LONG_LINES, GROUP = 3, 20, 25
#: What shows within the lines after a header that a session goes on, and the beginnings of prompts that are commands.
RESUMED, RESUMED_LINES = ["Ctrl+E", "previous messages"], 6
COMMANDS = ["./", "cd ", "ls ", "python", "bash", "git ", "cat ", "source ", "export ", "claude"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
STAMP = r"⏺\s+(\d{1,2}):(\d{2})\s+([AP]M)\s+\w+,\s+(\w+)\s+(\d{1,2}),\s+(\d{4})"
STAMP_LINES, PEOPLE_LINES, SUBJECT_CHARS, SHORTEST_PROMPT = 50, 100, 60, 6

_MARK = "(?:" + "|".join(SPEAKERS) + ")"


def _trimmed(items: Column) -> Column:
    return F.filter(F.transform(items, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def segments(text: Column) -> Column:
    """Turns of a dialogue of three marks or more, else paragraphs, else groups of 25 lines of a long block; in order.

    A null or blank text has none. Turns keep their blanks, the others are trimmed; empty ones are left out.
    """
    text = F.coalesce(text, F.lit(""))
    lines = F.split(text, "\n")
    n = F.size(F.filter(lines, lambda s: s.rlike(rf"(?i)^\s*{_MARK}")))
    turns = F.split(text, rf"(?i)(?<=\n)(?=[^\S\n]*{_MARK})")
    # a line feed before a turn separates the two and belongs to none
    turns = F.transform(turns, lambda s, i: F.when(i < F.size(turns) - 1, F.regexp_replace(s, r"\n\z", "")).otherwise(s))
    turns = F.filter(turns, lambda s: s != "")
    paragraphs = _trimmed(F.split(text, "\n\n"))
    groups = _trimmed(F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / GROUP).cast("int")), lambda i: F.array_join(F.slice(lines, i * GROUP + 1, F.lit(GROUP)), "\n")))
    return F.when(n >= LEAST_TURNS, turns).when((F.size(paragraphs) <= 1) & (F.size(lines) > LONG_LINES), groups).otherwise(paragraphs)


def session_starts(df: DataFrame, key: str, header: str, text: str = "text") -> DataFrame:
    """(key, line): places of lines with the header, from 0, that no sign of a resumed session follows within six lines, the header's own included."""
    lines = df.select(key, F.split(text, "\n").alias("__l"))
    at = lines.select(key, "__l", F.posexplode("__l").alias("line", "__s")).where(F.col("__s").contains(header))
    near = F.array_join(F.slice("__l", F.col("line") + 1, F.lit(RESUMED_LINES)), "")
    resumed = F.lit(False)
    for sign in RESUMED:
        resumed = resumed | near.contains(sign)
    return at.where(~resumed).select(key, "line")


def _head(text: Column, lines: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")


def stamp(text: Column) -> Column:
    """(stamp, day) of the first time line among the first 50 lines, as 2026-01-31_930AM and 2026-01-31; null without one. An unknown month is 00."""
    line = F.get(F.filter(F.slice(F.split(text, "\n"), 1, STAMP_LINES), lambda s: s.rlike(STAMP)), F.lit(0))
    part = lambda i: F.regexp_extract(line, STAMP, i)
    month = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part(4)), F.lit(0)), F.lit(0)).cast("string")
    day = F.concat_ws("-", part(6), F.lpad(month, 2, "0"), F.lpad(part(5), 2, "0"))
    return F.when(line.isNotNull(), F.struct(F.concat(day, F.lit("_"), part(1), part(2), part(3)).alias("stamp"), day.alias("day")))


def people(df: DataFrame, key: str, known: DataFrame, text: str = "text") -> DataFrame:
    """(key, name): known names (name) of up to three words that stand in the first 100 lines, and those that a user's folder (username) stands for.

    Words of a head become rows once and meet the names in an equality join.
    """
    head = df.select(key, _head(F.col(text), PEOPLE_LINES).alias("h"))
    split = head.select(key, F.filter(F.split(F.lower("h"), r"[^\p{L}\p{N}_]+"), lambda w: w != "").alias("w"))
    beside = lambda k: F.slice("w", F.lit(k), F.greatest(F.size("w"), F.lit(1)))
    each = split.select(key, F.explode(F.arrays_zip("w", beside(2).alias("second"), beside(3).alias("third"))).alias("x")).select(key, "x.*").where("w is not null")
    runs = F.array("w", F.concat_ws(" ", "w", "second"), F.concat_ws(" ", "w", "second", "third"))
    said = each.select(key, F.explode(runs).alias("term")).join(known.select("name", F.lower("name").alias("term")), "term").select(key, "name")
    if "username" not in known.columns:
        return said.distinct()
    home = head.select(key, F.regexp_extract("h", r"/Users/(\w+)/", 1).alias("username")).where("username <> ''")
    return said.union(home.join(known.select("name", "username"), "username").select(key, "name")).distinct()


def subject(text: Column) -> Column:
    """The first prompt (a line that begins with `> `) of over five characters that is no command, fit for a file name; `session` without one."""
    prompts = F.transform(F.filter(F.split(text, "\n"), lambda s: s.startswith("> ")), lambda s: F.regexp_replace(F.substr(s, F.lit(3)), r"^\s+|\s+$", ""))
    command = lambda s: s.rlike("^(" + "|".join(r"\Q" + c + r"\E" for c in COMMANDS) + ")")
    first = F.get(F.filter(prompts, lambda s: (F.char_length(s) >= SHORTEST_PROMPT) & ~command(s)), F.lit(0))
    clean = F.regexp_replace(F.trim(F.regexp_replace(first, r"[^\p{L}\p{N}_\s-]", "")), r"\s+", "-")
    return F.coalesce(F.substring(clean, 1, SUBJECT_CHARS), F.lit("session"))


def themes(df: DataFrame, key: str, stop: list[str], text: str = "text", most: int = 3, least: int = 4) -> DataFrame:
    """(key, themes): the most frequent words of at least four letters, ties by spelling; counts are summed before rows move."""
    found = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}{" + str(least) + r",})"), F.lit(1))).alias("word")).where(~F.col("word").isin(stop)).groupBy(key, "word").agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "word")
    top = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    return top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), ", ").alias("themes"))


def first_words(text: Column, most: int = 2000) -> Column:
    """The first words of a text, one blank between them."""
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, most), " ")
