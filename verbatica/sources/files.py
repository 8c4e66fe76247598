"""File sources and sinks: projects, transcripts, diaries, exports and fingerprinted caches."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: File name endings that are read, and the largest file.
TEXT_FILES, MOST_BYTES = ["txt", "md", "py", "js", "ts", "json", "jsonl", "yaml", "yml", "html", "css", "java", "go", "rs", "rb", "sh", "csv", "sql", "toml"], 500 * 1024 * 1024


class Ignore:
    """Ignore rules of a folder: the last rule that matches a path decides; `!` takes it back; a rule with a slash is anchored."""

    def __init__(self, text: str):
        self.rules: list[tuple[bool, re.Pattern]] = []
        for line in text.splitlines():
            rule = line.strip()
            if not rule or rule.startswith("#"):
                continue
            keep, rule = rule.startswith("!"), rule.removeprefix("!")
            anchored, rule = "/" in rule.rstrip("/"), rule.lstrip("/")
            body = "".join(".*" if p == "**" else "[^/]*" if p == "*" else "[^/]" if p == "?" else re.escape(p) for p in re.split(r"(\*\*|\*|\?)", rule.rstrip("/")))
            self.rules.append((keep, re.compile(("^" if anchored else "(^|.*/)") + body + ("/.*" if rule.endswith("/") else "(/.*)?") + "$")))

    def ignores(self, path: str) -> bool:
        out = False
        for keep, pattern in self.rules:
            if pattern.match(path):
                out = not keep
        return out

    def column(self, path: Column) -> Column:
        """The same decision inside the plan."""
        out = F.lit(False)
        for keep, pattern in self.rules:
            out = F.when(path.rlike(pattern.pattern), F.lit(not keep)).otherwise(out)
        return out


def project(spark: SparkSession, folder: str, ignore: str = "", endings: list[str] | None = None) -> DataFrame:
    """(path, text, size, modified) of a project's text files, ignored and oversized ones left out before their content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(endings or TEXT_FILES) + "}").load(folder)
    root = folder.rstrip("/").split("://")[-1]
    relative = F.regexp_extract("path", re.escape(root.rstrip("/")) + "/(.*)$", 1)
    return (files.where(F.col("length") <= MOST_BYTES).where(~Ignore(ignore).column(relative))
            .select(relative.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")))


_BLOCK = "array<struct<type:string,text:string,name:string,content:string>>"


def content_text(raw: Column) -> Column:
    """Text of a message's content: a string, or a list of blocks of which the text ones count."""
    blocks = F.from_json(raw, _BLOCK)
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"].isin("text", "input_text", "output_text")), lambda b: b["text"]), "\n")
    return F.trim(F.when(raw.startswith("["), joined).otherwise(raw))


def session_messages(lines: DataFrame) -> DataFrame:
    """(session_id, ordinal, uuid, ts, role, content) of JSON lines (value, line) with type, timestamp, sessionId and message.

    Other record types, and records without an id, a time, a session or words, are left out.
    """
    get = lambda path: F.get_json_object("value", path)
    read = lines.select("line", get("$.type").alias("type"), F.coalesce(get("$.message.role"), get("$.type")).alias("role"), get("$.timestamp").alias("ts"),
                        F.coalesce(get("$.sessionId"), get("$.session_id")).alias("session_id"), get("$.uuid").alias("uuid"), content_text(get("$.message.content")).alias("content"))
    kept = read.where(F.col("type").isin("user", "assistant") & F.col("role").isin("user", "assistant") & (F.col("content") != "") & F.col("ts").isNotNull() & F.col("uuid").isNotNull() & F.col("session_id").isNotNull())
    return kept.select("session_id", F.col("line").alias("ordinal"), "uuid", "ts", "role", "content")


def rollout_messages(lines: DataFrame) -> DataFrame:
    """(path if there, ordinal, role, content) of JSON lines {type: response_item, payload: {type: message, role, content, channel}}; analysis is left out."""
    get = lambda path: F.get_json_object("value", path)
    read = lines.where((get("$.type") == "response_item") & (get("$.payload.type") == "message")).select(
        *(["path"] if "path" in lines.columns else []), F.col("line").alias("ordinal"), get("$.payload.role").alias("role"), get("$.payload.channel").alias("channel"), content_text(get("$.payload.content")).alias("content"))
    return read.where(F.col("role").isin("user", "assistant") & (F.col("content") != "") & ~((F.col("role") == "assistant") & (F.coalesce("channel", F.lit("")) == "analysis"))).drop("channel")


def export_messages(files: DataFrame) -> DataFrame:
    """(path, conversation, ordinal, role, content) of JSON exports (path, text): one list of messages, or conversations that hold such lists."""
    item = "struct<role:string,sender:string,text:string,content:string>"
    flat = F.from_json(F.when(F.col("text").startswith("["), F.col("text")).otherwise(F.coalesce(F.get_json_object("text", "$.messages"), F.get_json_object("text", "$.chat_messages"))), f"array<{item}>")
    nested = F.from_json("text", f"array<struct<chat_messages:array<{item}>,messages:array<{item}>>>")
    lists = F.filter(F.transform(nested, lambda c: F.coalesce(c["chat_messages"], c["messages"])), lambda m: m.isNotNull())
    told = files.select("path", F.posexplode(F.when(F.size(lists) > 0, lists).otherwise(F.array(flat))).alias("conversation", "m")).select("path", "conversation", F.posexplode("m").alias("ordinal", "x"))
    role = F.coalesce("x.role", "x.sender")
    text = F.coalesce(F.nullif(content_text(F.col("x.content")), F.lit("")), F.col("x.text"))
    return told.select("path", "conversation", "ordinal", F.when(role.isin("user", "human"), "user").when(role.isin("assistant", "ai"), "assistant").alias("role"), text.alias("content")).where("role is not null and content <> ''")


def mapping_messages(files: DataFrame) -> DataFrame:
    """(path, depth, role, content) of exports whose `mapping` is a tree: from the root always to the first child, walked inside the row, as deep as the tree is."""
    node = "struct<id:string,parent:string,children:array<string>,message:struct<author:struct<role:string>,content:struct<parts:array<string>>>>"
    trees = files.select("path", F.from_json(F.get_json_object("text", "$.mapping"), f"map<string,{node}>").alias("m"))
    roots = F.filter(F.map_entries("m"), lambda e: e["value"]["parent"].isNull())
    root = F.array_min(F.transform(roots, lambda e: F.struct(e["value"]["message"]["author"]["role"].isNotNull().alias("told"), e["key"].alias("id"))))["id"]

    def step(walk: Column, _: Column) -> Column:
        here = F.try_element_at("m", walk["id"])
        return F.when(walk["id"].isNotNull() & here.isNotNull(), F.struct(F.get(here["children"], F.lit(0)).alias("id"), F.concat(walk["ids"], F.array(walk["id"])).alias("ids"))).otherwise(
            F.struct(F.lit(None).cast("string").alias("id"), walk["ids"].alias("ids")))

    start = F.struct(root.alias("id"), F.array().cast("array<string>").alias("ids"))
    walked = trees.select("path", "m", F.posexplode(F.aggregate(F.map_keys("m"), start, step)["ids"]).alias("depth", "id")).withColumn("message", F.try_element_at("m", F.col("id"))["message"])
    told = walked.select("path", "depth", F.col("message.author.role").alias("role"), F.array_join("message.content.parts", "\n").alias("content"))
    return told.where(F.col("role").isin("user", "assistant") & (F.col("content") != ""))


def channel_messages(files: DataFrame) -> DataFrame:
    """(path, ordinal, role, content) of channel exports: each new speaker takes the role that the last message had not; content names the speaker."""
    item = "array<struct<type:string,user:string,username:string,text:string>>"
    rows = files.select("path", F.from_json("text", item).alias("m"))
    said = F.filter(F.transform("m", lambda x: F.struct(x["type"].alias("type"), F.trim(F.regexp_replace(F.coalesce(x["user"], x["username"], F.lit("")), r"[\[\]\x00-\x1f]", "_")).alias("who"), F.coalesce(x["text"], F.lit("")).alias("text"))),
                    lambda x: (x["type"] == "message") & (x["who"] != "") & (x["text"] != ""))
    zero = F.struct(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("roles"), F.lit("assistant").alias("last"), F.array().cast("array<struct<role:string,content:string>>").alias("out"))

    def told(s: Column, x: Column) -> Column:
        role = F.coalesce(s["roles"][x["who"]], F.when(s["last"] == "user", "assistant").otherwise("user"))
        roles = F.when(F.map_contains_key(s["roles"], x["who"]), s["roles"]).otherwise(F.map_concat(s["roles"], F.create_map(x["who"], role)))
        line = F.struct(role.alias("role"), F.concat(F.lit("["), x["who"], F.lit("] "), x["text"]).alias("content"))
        return F.struct(roles.alias("roles"), role.alias("last"), F.concat(s["out"], F.array(line)).alias("out"))

    return rows.select("path", F.posexplode(F.aggregate(said, zero, told, lambda s: s["out"])).alias("ordinal", "x")).select("path", "ordinal", "x.role", "x.content")


def diaries(spark: SparkSession, folder: str) -> DataFrame:
    """(day, text, size) of files named YYYY-MM-DD*.md."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9]*.md").load(folder)
    return files.select(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})[^/]*$", 1).alias("day"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("length").alias("size"))


def export(drawers: DataFrame, folder: str, form: str = "markdown") -> DataFrame:
    """Writes drawers by wing and room as text, JSON or CSV, and gives the index: (wing, room, n)."""
    order = drawers.repartition("wing", "room", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("wing", "room", "filed_at", "id")
    if form == "markdown":
        order.select("wing", "room", F.concat(F.lit("## "), "id", F.lit("\n\n"), "text", F.lit("\n")).alias("value")).write.partitionBy("wing", "room").mode("overwrite").text(folder)
    elif form in ("json", "csv"):
        order.select("wing", "room", "id", "filed_at", "text").write.partitionBy("wing", "room").mode("overwrite").format(form).save(folder)
    else:
        raise ValueError(f"unknown form {form}")
    return drawers.groupBy("wing", "room").agg(F.count("*").alias("n"))


def inputs_fingerprint(items: dict) -> str:
    return hashlib.sha256(json.dumps(items, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, inputs: dict, make) -> DataFrame:
    """The table made from those inputs, read again if it is there: a folder named by their fingerprint, complete or absent."""
    path = f"{folder.rstrip('/')}/{inputs_fingerprint(inputs)}"
    try:
        return spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001  Spark says by its error class that there is nothing yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    make().write.parquet(path)
    return spark.read.parquet(path)


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row: number of rows, and a digest that doesn't depend on their order."""
    h = F.xxhash64(*df.columns).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.sha2(F.coalesce(F.sum(h), F.lit(0)).cast("string"), 256).alias("fingerprint"))
