"""Article profile of texts: counts and readability of prose, with what was set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .quality import syllables

#: Bytes from which a text counts as oversized, sentences that SMOG needs, abbreviations that end no sentence.
MOST_BYTES, SMOG_SENTENCES = 64 * 1024, 30
ABBREVIATIONS = ["mr", "mrs", "ms", "dr", "prof", "st", "vs", "etc", "e.g", "i.e", "fig", "no", "inc", "ltd", "approx"]
WORD = r"([\p{L}\p{N}]+(?:['’.][\p{L}\p{N}]+)*)"


def prose(text: Column) -> Column:
    """Text without fenced code, tables, headers and quotes marks; a list item is a line of prose."""
    bare = F.regexp_replace(text, r"(?s)```.*?(```|\z)", "\n")
    lines = F.filter(F.split(bare, "\n"), lambda s: ~s.rlike(r"^\s*(#|\||>|<[a-z!/])") & ~s.rlike(r"^( {4}|\t)"))
    return F.array_join(F.transform(lines, lambda s: F.regexp_replace(s, r"^\s*([-*+]|\d+[.)])\s+", "")), "\n")


def sentences(text: Column) -> Column:
    """Sentences, with urls, decimals and abbreviations whole."""
    kept = F.regexp_replace(text, r"https?://\S+", "URL")
    kept = F.regexp_replace(kept, r"(?<=\d)\.(?=\d)", "․")
    kept = F.regexp_replace(kept, r"(?i)\b(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\.", "$1․")
    return F.filter(F.transform(F.split(kept, r"(?<=[.!?])\s+|\n{2,}"), F.trim), lambda s: s.rlike(r"[\p{L}\p{N}]"))


def profile(df: DataFrame, text: str = "text", language: Column | None = None) -> DataFrame:
    """df with n_words, n_sentences, words_per_sentence, and for English flesch_reading_ease, and smog from 30 sentences on.

    Whole texts are profiled, whatever their length; oversized tells which have more than 64 KiB, so that a caller may refuse them.
    A null text has no counts.
    """
    english = F.lit(True) if language is None else F.coalesce(language == "en", F.lit(False))
    at = df.withColumn("__p", prose(F.col(text)))
    at = at.withColumn("__s", sentences(F.col("__p"))).withColumn("__y", F.transform(F.regexp_extract_all(F.lower("__p"), F.lit(WORD), F.lit(1)), syllables))
    at = at.withColumns({"n_words": F.size("__y"), "n_sentences": F.size("__s"), "oversized": F.octet_length(text) > MOST_BYTES,
                         "__n": F.aggregate("__y", F.lit(0), lambda a, x: a + x), "__long": F.size(F.filter("__y", lambda x: x >= 3))})
    some = (F.col("n_words") > 0) & (F.col("n_sentences") > 0)
    per = F.col("n_words") / F.col("n_sentences")
    return at.withColumns({
        "words_per_sentence": F.when(some, F.round(per, 4)),
        "flesch_reading_ease": F.when(some & english, F.round(206.835 - 1.015 * per - 84.6 * F.col("__n") / F.col("n_words"), 4)),
        "smog": F.when(some & english & (F.col("n_sentences") >= SMOG_SENTENCES), F.round(1.0430 * F.sqrt(F.col("__long") * 30 / F.col("n_sentences")) + 3.1291, 4)),
    }).drop("__p", "__s", "__y", "__n", "__long")
