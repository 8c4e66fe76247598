"""What captured records hold: texts, an account of everything that was left out, and the workspace they speak of.

Records come from ``sources.tailing`` (or any table with its columns).  All of it is columns over one row and sums by (source, generation), so a batch and
a stream share it; ``capture`` writes texts and observations of each micro-batch under its number, so a batch that is run again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tailing import Plans, appended

#: Layouts of records, and channels of an assistant that count as said.
ITEMS, TURNS = "items", "turns"
SAID = ["final", "commentary"]
#: Kinds of blocks that hold text, by layout.
TEXTS = {ITEMS: ["input_text", "output_text", "text"], TURNS: ["text"]}
#: Records that only describe, payloads of inner speech and of tools, events that only describe.
DESCRIBING = ["session_meta", "turn_context", "summary", "progress", "file-history-snapshot", "queue-operation", "system"]
INNER = ["reasoning", "compaction_reasoning"]
TOOLS = ["function_call", "function_call_output", "custom_tool_call", "custom_tool_call_output", "tool_call", "tool_result"]
EVENTS = ["token_count", "task_started", "task_complete", "turn_aborted", "context_compacted", "thread_rolled_back", "rate_limits"]
SPEAKING, THINKING = ["user_message", "agent_message"], ["agent_reasoning", "reasoning"]
#: Kinds of blocks without a text that counts.
TOOL_BLOCKS = ["tool_use", "tool_result", "tool_call", "function_call_output"]
ATTACHED = ["image", "input_image", "document", "input_file", "audio", "input_audio", "video"]
INNER_BLOCKS = ["thinking", "redacted_thinking", "reasoning"]
#: Bytes of a workspace path, and of a piece of text.
PATH_BYTES, PIECE_BYTES = 2048, 65536
COUNTERS = ["processed_records", "indexed_records", "text_blocks", "text_bytes", "metadata_records", "internal_records", "internal_blocks", "tool_records", "tool_blocks",
            "attachment_blocks", "unsupported_records", "unsupported_blocks", "malformed_records", "oversized_records", "oversized_bytes"]
#: Counters of material that is not in the texts.
MISSING = ["tool_records", "tool_blocks", "attachment_blocks", "unsupported_records", "unsupported_blocks", "malformed_records", "oversized_records"]
_BLOCKS = "array<struct<block:int,kind:string,text:string>>"


def _field(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _text(v: Column, path: str) -> Column:
    """A field if it is a JSON string."""
    return F.when(F.schema_of_variant(_field(v, path, "variant")) == "STRING", _field(v, path))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def read(records: DataFrame, layout: Column | str) -> DataFrame:
    """records with what is in them: valid (it is JSON), object, kind, body_kind, channel, items (blocks of a list), role, said (the blocks that hold text), cwd."""
    layout = F.lit(layout) if isinstance(layout, str) else layout

    def parts(v: Column, body: Column, items: Column) -> Column:
        blocks = F.transform(_field(body, "$.content", "array<variant>"), lambda b, i: F.struct(i.alias("block"), _text(b, "$.type").alias("kind"), _text(b, "$.text").alias("text")))
        return F.struct(v.isNotNull().alias("valid"), F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).alias("object"), _text(v, "$.type").alias("kind"),
                        body.isNotNull().alias("filled"), _text(body, "$.type").alias("body_kind"), _text(body, "$.role").alias("body_role"),
                        F.coalesce(_text(body, "$.channel"), F.when(~items, _text(v, "$.channel"))).alias("channel"), blocks.cast(_BLOCKS).alias("items"), _text(body, "$.content").alias("words"), _workspace(v).alias("cwd"))

    def found(v: Column) -> Column:
        items = F.col("layout") == ITEMS
        body = F.when(items, _field(v, "$.payload", "variant")).otherwise(_field(v, "$.message", "variant"))
        return _let(F.when(F.schema_of_variant(body).startswith("OBJECT"), body), lambda b: parts(v, b, items))

    out = records.withColumn("layout", layout)
    out = out.withColumn("found", _let(F.when(F.col("reason") == "record", F.try_parse_json("value")), found)).select("*", "found.*").drop("found")
    items = F.col("layout") == ITEMS
    role = F.when(items, F.when((F.col("kind") == "response_item") & (F.col("body_kind") == "message"), F.col("body_role"))).otherwise(F.col("kind"))
    role = F.when(role.isin("user", "assistant") | (~items & (role == "human")), role)
    heard = ~F.coalesce((role == "assistant") & F.col("channel").isNotNull() & ~F.col("channel").isin(*SAID), F.lit(False))
    out = out.withColumn("role", F.when(F.col("filled") & heard, role))
    accepted = F.when(items, F.array(*map(F.lit, TEXTS[ITEMS]))).otherwise(F.array(*map(F.lit, TEXTS[TURNS])))
    chosen = F.filter("items", lambda b: F.coalesce(F.array_contains(accepted, b["kind"]) & (b["text"] != ""), F.lit(False)))
    single = F.when(~items & (F.col("words") != ""), F.array(F.struct(F.lit(-1).alias("block"), F.lit(None).cast("string").alias("kind"), F.col("words").alias("text"))))
    none = F.array().cast(_BLOCKS)
    return out.withColumn("said", F.when(F.col("role").isNull(), none).otherwise(F.coalesce(chosen, single.cast(_BLOCKS), none))).drop("filled")


def _workspace(v: Column) -> Column:
    """The folder that a record names, if it is an absolute path without a step up."""
    own = F.when(_text(v, "$.type").isin("session_meta", "turn_context") & F.schema_of_variant(_field(v, "$.payload", "variant")).startswith("OBJECT"), F.struct(_text(v, "$.payload.cwd").alias("cwd")))
    cwd = F.coalesce(own, F.struct(_text(v, "$.cwd").alias("cwd")))["cwd"]
    return F.when(cwd.startswith("/") & (F.octet_length(cwd) <= PATH_BYTES) & ~F.array_contains(F.split(cwd, "/"), ".."), cwd)


def texts(records: DataFrame) -> DataFrame:
    """(source, generation, start, stop, sha256, role, kind, block, block_start, text) of what was said in read records; a text is cut in pieces of at most PIECE_BYTES.

    block is the place in a list of blocks, -1 where the content is the text itself; block_start counts characters.
    """
    each = records.select("source", "generation", "start", "stop", "sha256", "role", F.col("kind"), F.explode("said").alias("b"))
    size, width = F.char_length("b.text"), PIECE_BYTES // 4
    starts = F.when(F.octet_length("b.text") <= PIECE_BYTES, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), size - 1, F.lit(width)))
    cut = each.select("*", F.explode(starts).alias("at"), F.octet_length("b.text").alias("bytes"))
    piece = F.when(F.col("bytes") <= PIECE_BYTES, F.col("b.text")).otherwise(F.substr(F.col("b.text"), F.col("at") + 1, F.lit(width)))
    return cut.select("source", "generation", "start", "stop", "sha256", "role", "kind", F.col("b.block").alias("block"), F.col("at").cast("long").alias("block_start"), piece.alias("text"))


def counted(records: DataFrame) -> DataFrame:
    """Read records with a column for each of COUNTERS."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    kind, body = F.col("kind"), F.col("body_kind")
    hidden = yes(~F.col("channel").isin(*SAID))
    flags = records.withColumns({"_item": (F.col("layout") == ITEMS) & yes(kind == "response_item"), "_event": (F.col("layout") == ITEMS) & yes(kind == "event_msg")})
    item, event = F.col("_item"), F.col("_event")
    inner = (item & (yes(body.isin(*INNER)) | (yes(body == "message") & yes(F.col("body_role") == "assistant") & hidden))) | (event & yes(body.isin(*THINKING)))
    flags = flags.withColumns({
        "_inner": inner | ((F.col("layout") == TURNS) & yes(kind == "assistant") & hidden), "_describes": (event & yes(body.isin(*EVENTS))) | (yes(kind.isin(*DESCRIBING)) & ~item & ~event),
        "_odd": event & ~yes(body.isin(*THINKING, *EVENTS)), "_others": F.filter("items", lambda b: ~F.array_contains(F.transform("said", lambda s: s["block"]), b["block"]))})
    flags = flags.withColumn("_tool", item & yes(body.isin(*TOOLS)) & ~F.col("_inner"))
    flags = flags.withColumn("_open", F.col("object") & ~F.col("_inner") & ~F.col("_tool") & ~F.col("_describes") & ~event)  # records whose blocks are looked at
    n_said, listed = F.size("said"), F.col("items").isNotNull()
    of = lambda test: F.when(F.col("_open") & listed, F.size(F.filter("_others", test))).otherwise(0)
    among = lambda *kinds: lambda b: yes(b["kind"].isin(*kinds))
    known, line, large = among(*TOOL_BLOCKS, *ATTACHED, *INNER_BLOCKS), F.col("reason") == "record", F.col("reason") == "oversized"
    whole, first = line & F.col("valid"), large & (F.col("record_start") == F.col("start"))
    broken = (line & ~F.col("valid")) | (F.col("reason") == "malformed")
    values = {
        "processed_records": whole | broken | first, "indexed_records": whole & (n_said > 0), "text_blocks": n_said, "text_bytes": F.aggregate("said", F.lit(0).cast("long"), lambda n, b: n + F.octet_length(b["text"])),
        "metadata_records": F.col("_describes") | (F.col("_open") & (n_said == 0) & listed & (F.size("items") == 0)), "internal_records": F.col("_inner"), "internal_blocks": of(among(*INNER_BLOCKS)),
        "tool_records": F.col("_tool"), "tool_blocks": of(among(*TOOL_BLOCKS)), "attachment_blocks": of(among(*ATTACHED)),
        "unsupported_records": whole & (~F.col("object") | F.col("_odd") | (F.col("_open") & ~listed & (n_said == 0))),
        "unsupported_blocks": of(lambda b: ~known(b) & ~yes(b["kind"].isin(*TEXTS[ITEMS]) & (b["text"] == ""))),
        "malformed_records": broken, "oversized_records": first, "oversized_bytes": F.when(large, F.col("stop") - F.col("start")).otherwise(0),
    }
    return flags.select(*records.columns, *[F.coalesce(values[c].cast("long"), F.lit(0)).alias(c) for c in COUNTERS])


def observations(records: DataFrame) -> DataFrame:
    """What became of each stretch of bytes of counted records: their counters, the folder they name, and a reason, without any text."""
    reason = (F.when(F.col("reason") != "record", F.col("reason")).when(F.col("malformed_records") > 0, "malformed").when(F.col("indexed_records") > 0, "indexed_record").otherwise("unsupported"))
    return records.select("source", "generation", "start", "stop", "record_start", reason.alias("reason"), "scope", "sha256", "cwd", *COUNTERS)


def coverage(seen: DataFrame) -> DataFrame:
    """By (source, generation) of observations: the counters, bytes read and waiting, and complete_supported_text, gaps or pending.

    A tail waits if nothing later was read at its place or beyond.
    """
    tail = F.col("reason") == "pending_tail"
    sums = seen.groupBy("source", "generation").agg(
        *[F.sum(c).alias(c) for c in COUNTERS], F.coalesce(F.max(F.when(~tail, F.col("stop"))), F.lit(0)).alias("processed_bytes"), F.max(F.when(tail, F.col("stop"))).alias("seen_bytes"),
        F.max(F.when(F.col("reason") == "lost", F.lit(1)).otherwise(0)).alias("lost"))
    waiting = F.greatest(F.coalesce("seen_bytes", F.lit(0)) - F.col("processed_bytes"), F.lit(0))
    missing = sum(F.col(c) for c in MISSING) + F.col("lost")
    return sums.select("source", "generation", *COUNTERS, "processed_bytes", waiting.alias("pending_bytes"),
                       F.when(waiting > 0, "pending").when(missing > 0, "gaps").otherwise("complete_supported_text").alias("text_coverage"))


def scopes(seen: DataFrame) -> DataFrame:
    """(source, generation, workspace, first_offset, conflict_at) of observations that name a folder: the first one named, and where another one follows."""
    named = seen.where("cwd is not null").select("source", "generation", "start", "cwd")
    first = named.groupBy("source", "generation").agg(F.min(F.struct("start", "cwd")).alias("f")).select("source", "generation", F.col("f.cwd").alias("workspace"), F.col("f.start").alias("first_offset"))
    later = named.join(first, ["source", "generation"]).where("cwd <> workspace").groupBy("source", "generation").agg(F.min("start").alias("conflict_at"))
    return first.join(later, ["source", "generation"], "left")


def scoped(said: DataFrame, scopes: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """said with workspace and attribution, given once for a generation: from the record that names one up to a conflict.

    hints (source, workspace) come from a host; they count for the newest generation of a source where no record names a folder.
    """
    out = said.join(scopes, ["source", "generation"], "left")
    within = (F.col("start") >= F.col("first_offset")) & (F.col("conflict_at").isNull() | (F.col("start") < F.col("conflict_at")))
    told = F.when(within, F.col("workspace"))
    if hints is None:
        return out.withColumn("attribution", F.when(told.isNotNull(), "transcript_metadata").otherwise("unattributed")).withColumn("workspace", told).drop("first_offset", "conflict_at")
    newest = said.groupBy("source").agg(F.max("generation").alias("generation"))
    given = hints.groupBy("source").agg(F.min("workspace").alias("hint")).join(newest, "source")
    out = out.join(given, ["source", "generation"], "left")
    hint = F.when(F.col("first_offset").isNull(), F.col("hint"))
    attribution = F.when(told.isNotNull(), "transcript_metadata").when(hint.isNotNull(), "host_event").otherwise("unattributed")
    return out.withColumn("attribution", attribution).withColumn("workspace", F.coalesce(told, hint)).drop("first_offset", "conflict_at", "hint")


def capture(spark: SparkSession, folder: str, state: str, out: str, layout: str, **options: object) -> StreamingQuery:
    """Starts the capture of a folder into out/texts and out/observations, one batch for each plan."""
    def put(batch: DataFrame, number: int) -> None:
        held = counted(read(batch, layout)).persist()
        try:
            texts(held).write.mode("overwrite").parquet(f"{out}/texts/batch={number}")
            observations(held).write.mode("overwrite").parquet(f"{out}/observations/batch={number}")
        finally:
            held.unpersist()

    return appended(spark, folder, state, **options).writeStream.foreachBatch(put).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()


def caught_up(spark: SparkSession, folder: str, state: str, out: str, layout: str, **options: object) -> int:
    """Captures a folder until nothing new is there; the number of plans so far.  What grows meanwhile is read as well."""
    number = -1
    while number != (number := Plans(state).number):
        capture(spark, folder, state, out, layout, **options).awaitTermination()
    return number
