"""Chat transcripts of any known form: which form a file has, the third layout of JSON lines, and tool calls as lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.lineage import cut
from .files import channel_messages, export_messages, mapping_messages, rollout_messages

#: How many quoted lines make a text a transcript already, and how much of a tool's input and output is shown.
QUOTED, INPUT_CHARS, HEAD_LINES, MATCHES, RESULT_CHARS = 3, 200, 20, 20, 2048
#: Tools whose output stands elsewhere, that are cut in the middle, or that give matches.
SILENT, CUT, LISTED = ["Read", "Edit", "Write"], ["Bash"], ["Grep", "Glob"]
ARROW = "→ "


def form(path: Column, text: Column) -> Column:
    """transcript (quoted lines), lines (JSON lines), json (one JSON value) or plain; an empty text is plain."""
    quoted = F.size(F.filter(F.split(text, "\n"), lambda s: s.startswith(">"))) >= QUOTED
    first = F.regexp_extract(text, r"^\s*(\S)", 1)
    looks = F.lower(path).rlike(r"\.jsonl?$") | first.isin("{", "[")
    rows = F.filter(F.split(text, "\n"), lambda s: F.trim(s) != "")
    lines = (F.size(rows) > 1) & F.get(rows, F.lit(0)).rlike(r"^\s*\{.*\}\s*$")
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "plain").when(quoted, "transcript").when(looks & (F.lower(path).endswith(".jsonl") | lines), "lines").when(looks, "json").otherwise("plain")


def started_messages(lines: DataFrame, key: str = "path") -> DataFrame:
    """(key, ordinal, role, content) of JSON lines (key, line, value) that count from a record of type session_metadata on.

    Records of type user and gemini hold blocks with texts; others, records without a text, and files with fewer than two
    messages or without the first record are left out.  One partial minimum a file finds where it starts.
    """
    kind = F.get_json_object("value", "$.type")
    start = lines.where(kind == "session_metadata").groupBy(key).agg(F.min("line").alias("start"))
    texts = F.filter(F.transform(F.from_json(F.get_json_object("value", "$.content"), "array<struct<text:string>>"), lambda b: b["text"]), lambda t: F.coalesce(t.rlike(r"\S"), F.lit(False)))
    told = lines.where(kind.isin("user", "gemini")).select(key, "line", F.when(kind == "user", "user").otherwise("assistant").alias("role"), F.array_join(texts, "\n").alias("content")).where("content <> ''")
    kept = told.join(start, key).where("line > start")
    enough = kept.groupBy(key).agg(F.count("*").alias("n")).where("n >= 2").select(key)
    return kept.join(enough, key, "left_semi").select(key, F.col("line").alias("ordinal"), "role", "content")


def _shortened(text: Column) -> Column:
    return F.when(F.char_length(text) > INPUT_CHARS, F.concat(F.substring(text, 1, INPUT_CHARS), F.lit("..."))).otherwise(text)


def tool_call(name: Column, given: Column) -> Column:
    """One line for a call: the tool, and of its input (a JSON object) what tells most."""
    get = lambda field: F.get_json_object(given, f"$.{field}")
    some = lambda field, other="": F.coalesce(get(field), F.lit(other))
    name = F.coalesce(name, F.lit("Unknown"))
    at, n = get("offset"), get("limit")
    last = F.try_add(at.try_cast("long"), n.try_cast("long"))
    place = F.when(at.isNull() | n.isNull(), F.lit("")).when(last.isNotNull(), F.concat(F.lit(":"), at, F.lit("-"), last.cast("string"))).otherwise(F.concat(F.lit(":"), at, F.lit("+"), n))
    where = F.coalesce(F.nullif(get("path"), F.lit("")), get("glob"), F.lit(""))
    return (F.when(name == "Bash", F.concat(F.lit("[Bash] "), _shortened(some("command"))))
            .when(name == "Read", F.concat(F.lit("[Read "), some("file_path", "?"), place, F.lit("]")))
            .when(name == "Grep", F.concat(F.lit("[Grep] "), some("pattern"), F.lit(" in "), where))
            .when(name == "Glob", F.concat(F.lit("[Glob] "), some("pattern")))
            .when(name.isin("Edit", "Write"), F.concat(F.lit("["), name, F.lit(" "), some("file_path", "?"), F.lit("]")))
            .otherwise(F.concat(F.lit("["), name, F.lit("] "), _shortened(F.coalesce(given, F.lit("{}"))))))


def tool_result(text: Column, name: Column) -> Column:
    """The output of a call with an arrow before each line: head and tail of a command's, the first matches of a search's, the beginning of others'.

    Empty for an empty output and for tools whose output stands elsewhere.
    """
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    lines = F.split(body, "\n")
    n = F.size(lines)
    arrows = lambda a: F.array_join(F.transform(a, lambda s: F.concat(F.lit(ARROW), s)), "\n")
    note = lambda *parts: F.concat(F.lit("\n" + ARROW + "... ["), *parts)
    middle = F.concat(arrows(F.slice(lines, 1, HEAD_LINES)), note((n - 2 * HEAD_LINES).cast("string"), F.lit(" lines omitted] ...\n")), arrows(F.slice(lines, -HEAD_LINES, HEAD_LINES)))
    listed = F.concat(arrows(F.slice(lines, 1, MATCHES)), note((n - MATCHES).cast("string"), F.lit(" more matches]")))
    shown = F.concat(F.lit(ARROW), F.substring(body, 1, RESULT_CHARS), F.lit("... [truncated, "), F.char_length(body).cast("string"), F.lit(" chars]"))
    name = F.coalesce(name, F.lit("Unknown"))
    return (F.when((body == "") | name.isin(SILENT), F.lit(""))
            .when(name.isin(CUT), F.when(n <= 2 * HEAD_LINES, arrows(lines)).otherwise(middle))
            .when(name.isin(LISTED), F.when(n <= MATCHES, arrows(lines)).otherwise(listed))
            .when(F.char_length(body) > RESULT_CHARS, shown).otherwise(F.concat(F.lit(ARROW), body)))


def block_messages(lines: DataFrame, key: str = "path") -> DataFrame:
    """(key, ordinal, role, content) of JSON lines {type, message: {role, content}} with the calls and results of tools rendered in place.

    A result is shown as its call's tool asks for; calls and results meet by their id within the file, in an equality join.
    """
    get = lambda path: F.get_json_object("value", path)
    raw = get("$.message.content")
    block = "array<struct<type:string,text:string,name:string,id:string,input:string,tool_use_id:string,content:string>>"
    whole = F.when(raw.startswith("["), F.from_json(raw, block))
    single = F.array(F.struct(F.lit("text").alias("type"), raw.alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("name", "id", "input", "tool_use_id", "content")]))
    role = F.coalesce(get("$.message.role"), get("$.type"))
    parts = lines.where(role.isin("user", "assistant") & raw.isNotNull()).select(key, "line", role.alias("role"), F.posexplode(F.coalesce(whole, single)).alias("pos", "b")).select(key, "line", "role", "pos", "b.*")
    calls = parts.where("type = 'tool_use' and id is not null").groupBy(key, "id").agg(F.max_by("name", F.struct("line", "pos")).alias("tool")).withColumnRenamed("id", "tool_use_id")
    listed = F.from_json("content", "array<struct<type:string,text:string>>")
    output = F.when(F.col("content").startswith("["), F.array_join(F.transform(F.filter(listed, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")).otherwise(F.col("content"))
    plain = parts.where("type <> 'tool_result' or type is null").withColumn("said", F.when(F.col("type") == "text", F.col("text")).when(F.col("type") == "tool_use", tool_call(F.col("name"), F.col("input"))))
    results = parts.where("type = 'tool_result'").join(calls, [key, "tool_use_id"], "left").withColumn("said", tool_result(output, F.col("tool")))
    told = plain.select(key, "line", "role", "pos", "said").unionByName(results.select(key, "line", "role", "pos", "said")).where("said <> ''")
    # the blocks of one line are one message: a bounded group
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda x: x["said"])
    return told.groupBy(key, "line", "role").agg(F.array_join(ordered, "\n").alias("content")).select(key, F.col("line").alias("ordinal"), "role", "content")


def normalized(files: DataFrame) -> DataFrame:
    """(path, reader, ordinal, role, content) of files (path, text) of any form: the messages of the first reader that finds two at least, else the text as it is (reader plain, no role).

    Readers are tried in the order turns, items, started (JSON lines), export, mapping, channel (one JSON value); a file that is a transcript already, or plain, or broken, stays a text.
    """
    told = files.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("form", form(F.col("path"), F.col("text")))
    lines = told.where("form = 'lines'").select("path", F.posexplode(F.split("text", "\n")).alias("line", "value")).where(F.trim("value") != "")
    whole = told.where("form = 'json' or form = 'lines'").where(F.try_parse_json("text").isNotNull()).select("path", "text")  # a JSON value may stand on one line
    at = F.col("ordinal").cast("long")
    found = [("turns", block_messages(lines), at), ("items", rollout_messages(lines), at), ("started", started_messages(lines), at), ("export", export_messages(whole), F.col("conversation").cast("long") * (1 << 32) + at),
             ("mapping", mapping_messages(whole), F.col("depth").cast("long")), ("channel", channel_messages(whole), at)]
    parts = [df.select("path", F.lit(n).alias("place"), F.lit(name).alias("reader"), order.alias("ordinal"), "role", "content") for n, (name, df, order) in enumerate(found)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = cut(every, "messages")
    first = every.groupBy("path", "place").agg(F.count("*").alias("n")).where("n >= 2").groupBy("path").agg(F.min("place").alias("place"))
    plain = told.join(first, "path", "left_anti").select("path", F.lit("plain").alias("reader"), F.lit(0).cast("long").alias("ordinal"), F.lit(None).cast("string").alias("role"), F.col("text").alias("content"))
    return every.join(first, ["path", "place"]).drop("place").unionByName(plain)
