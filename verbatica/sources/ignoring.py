"""Ignore files of folders, inherited down a tree of paths: one join of paths with the rules of the folders above them.

Rules of a folder are told in order and the last that fits decides; deeper folders come later.  A folder that is ignored hides everything below it, whatever deeper rules say.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

NAME = ".gitignore"
_RULES = "folder string, ordinal int, pattern string, folders_only boolean, keep boolean"


def _part(text: str) -> str:
    """One path segment with *, ? and [] as a regular expression that both Python and Java read."""
    out, at = "", 0
    while at < len(text):
        c = text[at]
        close = text.find("]", at + 2) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif close > 0:
            body = text[at + 1 : close]
            out += "[" + ("^/" if body[0] == "!" else "") + re.sub(r"([\\\[\]^&~|])", r"\\\1", body[body[0] == "!" :]) + "]"
            at = close
        else:
            out += re.sub(r"([^\w])", r"\\\1", c, flags=re.A) if c.isascii() else c
        at += 1
    return out


def rules(text: str) -> list[tuple[str, bool, bool]]:
    """(pattern, folders_only, keep) of the lines of an ignore file; a pattern is matched against a path that ends with a slash."""
    out = []
    for raw in text.splitlines():
        line = raw.strip()
        if line.startswith("#") or not line:
            continue
        escaped = line[:2] in (r"\#", r"\!")
        line = line[1:] if escaped else line
        keep = line.startswith("!") and not escaped
        line = line[keep:]
        anchored, line = line.startswith("/"), line.lstrip("/") if line.startswith("/") else line
        only, line = line.endswith("/"), line.rstrip("/")
        if not line:
            continue
        parts = line.split("/")
        if anchored or len(parts) > 1:
            body = "^" + "".join("(?:[^/]*/)*" if p == "**" else _part(p) + "/" for p in parts)
        else:
            body = "(?:^|/)" + _part(line) + "/"
        out.append((body, only, keep))
    return out


def rule_files(spark: SparkSession, folder: str) -> DataFrame:
    """(folder, text) of the ignore files below a folder; folder is relative, "" for the top. There is one for a folder at most; Spark's own listing leaves out hidden files."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = fs.getFileStatus(top).getPath().toString().rstrip("/")
    found, listed = [], fs.listFiles(top, True)
    while listed.hasNext():
        path = listed.next().getPath()
        if path.getName() == NAME:
            stream = fs.open(path)
            try:
                text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            found.append((path.getParent().toString().removeprefix(root).strip("/"), text))
    return spark.createDataFrame(found, "folder string, text string")


def table_of(files: DataFrame) -> DataFrame:
    """(folder, ordinal, pattern, folders_only, keep) of ignore files (folder, text)."""
    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [(f or "", i, *rule) for f, t in zip(frame["folder"], frame["text"]) for i, rule in enumerate(rules(t or ""))]
            if rows:
                yield pd.DataFrame(rows, columns=["folder", "ordinal", "pattern", "folders_only", "keep"])

    return files.select("folder", "text").mapInPandas(run, _RULES)


def ignored(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(path, ignored) of each distinct file path (relative, with slashes), by the ignore files (folder, text).

    Each path and each folder above it becomes one row for every folder above, and meets the rules there in an equality join; folders are few next to files.
    """
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    split = paths.select("path").where("path is not null").distinct().withColumn("parts", parts)
    prefix = lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/")
    above = split.select("path", F.explode(F.when(F.size("parts") > 1, F.transform(F.sequence(F.lit(1), F.size("parts") - 1), prefix)).otherwise(F.array().cast("array<string>"))).alias("item"))
    items = above.select("item", F.lit(True).alias("is_folder")).distinct().unionByName(split.select(prefix(F.size("parts")).alias("item"), F.lit(False).alias("is_folder")).distinct())
    at = items.withColumn("parts", F.split("item", "/")).select("item", "is_folder", "parts", F.explode(F.sequence(F.lit(0), F.size("parts") - 1)).alias("depth"))
    at = at.select("item", "is_folder", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("folder"), F.slice("parts", F.col("depth") + 1, F.size("parts")).alias("rest"))
    met = at.join(table_of(files), "folder")
    target = F.when(F.col("folders_only") & ~F.col("is_folder"), F.slice("rest", F.lit(1), F.size("rest") - 1)).otherwise(F.col("rest"))
    fits = met.where(F.size(target) > 0).where(F.rlike(F.concat(F.array_join(target, "/"), F.lit("/")), F.col("pattern")))
    told = fits.groupBy("item", "is_folder").agg(F.max_by(~F.col("keep"), F.struct("depth", "ordinal")).alias("hit")).where("hit")
    hidden = above.join(told.where("is_folder").select("item"), "item", "left_semi").select("path")
    own = split.select("path", prefix(F.size("parts")).alias("item")).join(told.where("not is_folder").select("item"), "item", "left_semi").select("path")
    out = hidden.union(own).distinct().withColumn("hit", F.lit(True))
    return split.select("path").join(out, "path", "left").select("path", F.coalesce("hit", F.lit(False)).alias("ignored"))


def session_projects(lines: DataFrame) -> DataFrame:
    """(name, folder, n_sessions) of folders of session logs (path, value): those whose name begins with a dash, called by the last part of the folder that their records name, else of
    their own name; of equal names the one with most sessions, then the first folder."""
    path = lines.select("path", "value").withColumn("folder", F.regexp_extract("path", r"([^/]+)/[^/]+\.jsonl$", 1)).where("folder like '-%'")
    cwd = F.nullif(F.regexp_extract(F.rtrim(F.get_json_object("value", "$.cwd")), r"([^/]+)/*$", 1), F.lit(""))
    each = path.groupBy("folder").agg(F.countDistinct("path").alias("n_sessions"), F.min(cwd).alias("named"))
    named = each.select("folder", "n_sessions", F.coalesce("named", F.regexp_extract("folder", r"([^-]*)-*$", 1)).alias("name"))
    return named.groupBy("name").agg(F.max_by("folder", F.struct("n_sessions", F.reverse(F.col("folder")))).alias("folder"), F.max("n_sessions").alias("n_sessions")).select("name", "folder", "n_sessions")
