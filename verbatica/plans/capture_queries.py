"""What capture makes of records: texts, accounts and workspaces, over the conversations written as lines of either layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import ingest


def _lines(spark, sf_dir):
    """A source for each conversation and a line for each turn: most are messages, some tools, inner speech, events, folders, or cut off."""
    c = table(spark, sf_dir, "conversations")
    lit, conv, turn = F.lit, F.col("conv_id"), F.col("turn")
    words = F.to_json(F.array(F.coalesce("text", lit(""))))
    words = F.substr(words, lit(2), F.char_length(words) - 2)  # the text as a JSON string
    k, role = (conv + turn) % 10, F.col("role")
    item = lambda *parts: F.concat(lit('{"type":"response_item","payload":{"type":"message","role":"'), role, lit('","content":['), *parts, lit("]}}"))
    said = F.concat(lit('{"type":"input_text","text":'), words, lit("}"))
    block = F.concat(lit('{"type":"text","text":'), words, lit("}"))
    message = lambda *parts: F.concat(lit('{"type":"'), role, lit('","message":{"content":'), *parts, lit("}}"))
    items = (F.when(role == "system", F.concat(lit('{"type":"session_meta","payload":{"cwd":"/work/p'), (conv % 3).cast("string"), lit('"}}')))
             .when(k == 0, item(said, lit(',{"type":"input_image"},{"type":"odd"},"loose"'))).when(k == 1, lit('{"type":"response_item","payload":{"type":"reasoning"}}'))
             .when(k == 2, lit('{"type":"response_item","payload":{"type":"function_call","name":"f"}}')).when(k == 3, F.concat(lit('{"type":"response_item","payload":'), words))
             .when((k == 4) & (conv % 4 == 0), F.concat(lit('{"type":"turn_context","payload":{"cwd":"/work/q'), turn.cast("string"), lit('"}}'))).when(k == 4, lit('{"type":"event_msg","payload":{"type":"token_count"}}'))
             .when(k == 5, lit('{"type":"event_msg","payload":{"type":"agent_message"}}')).otherwise(item(said)))
    turns = (F.when(role == "system", lit('{"type":"system","cwd":"/work/up/../p"}'))
             .when(k == 0, message(lit("["), block, lit(',{"type":"tool_use"},{"type":"thinking"},{"type":"text","text":7}]'))).when(k == 1, F.concat(lit('{"type":"assistant","channel":"analysis","message":{"content":'), words, lit("}}")))
             .when(k == 2, message(lit('[{"type":"tool_result","content":"x"}]'))).when(k == 3, lit("[1, 2]"))
             .when(k == 4, F.concat(lit('{"type":"user","cwd":"/work/t'), (turn % 2).cast("string"), lit('","message":{"content":'), words, lit("}}")))
             .when(k == 5, lit('{"type":"user","message":{"content":[]}}')).otherwise(message(words)))
    return c.where("conv_id is not null and turn is not null and role is not null").select(
        F.concat(lit("conv_"), conv.cast("string")).alias("source"), lit("").alias("path"), lit(0).alias("generation"), (turn * 1000).alias("start"), (turn * 1000 + 1000).alias("stop"),
        (turn * 1000).alias("record_start"), lit("record").alias("reason"), lit("record").alias("scope"), lit("").alias("sha256"), F.when(conv % 2 == 0, items).otherwise(turns).alias("value"),
        F.when(conv % 2 == 0, ingest.ITEMS).otherwise(ingest.TURNS).alias("layout"))


def _read(spark, sf_dir):
    return ingest.read(_lines(spark, sf_dir), F.col("layout"))


def _accounts(spark, sf_dir):
    return ingest.coverage(ingest.observations(ingest.counted(_read(spark, sf_dir)))).drop("generation")


def _texts(spark, sf_dir):
    return ingest.texts(_read(spark, sf_dir)).select("source", "start", "role", "kind", "block", "block_start", F.md5("text").alias("digest"))


def _scopes(spark, sf_dir):
    read = _read(spark, sf_dir)
    scopes = ingest.scopes(ingest.observations(ingest.counted(read)))
    held = ingest.scoped(ingest.texts(read), scopes).groupBy("source").agg(F.count("workspace").alias("n_scoped"), F.count_if(F.col("workspace").isNull()).alias("n_unscoped"), F.max("workspace").alias("workspace"))
    return held.join(scopes.select("source", "first_offset", "conflict_at"), "source", "left")


def _in(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_S = lambda path, of="v": f"case when json_type({of}, '{path}') = 'VARCHAR' then json_extract_string({of}, '{path}') end"
_LINES = f"""
cv as (select *, (conv_id + turn) % 10 as k, to_json(coalesce(text, ''))::varchar as w from conversations where conv_id is not null and turn is not null and role is not null),
ln as (select 'conv_' || conv_id as source, turn * 1000 as start, case when conv_id % 2 = 0 then 'items' else 'turns' end as layout,
  case when conv_id % 2 = 0 then
    case when role = 'system' then '{{"type":"session_meta","payload":{{"cwd":"/work/p' || (conv_id % 3) || '"}}}}'
      when k = 0 then '{{"type":"response_item","payload":{{"type":"message","role":"' || role || '","content":[{{"type":"input_text","text":' || w || '}},{{"type":"input_image"}},{{"type":"odd"}},"loose"]}}}}'
      when k = 1 then '{{"type":"response_item","payload":{{"type":"reasoning"}}}}' when k = 2 then '{{"type":"response_item","payload":{{"type":"function_call","name":"f"}}}}'
      when k = 3 then '{{"type":"response_item","payload":' || w when k = 4 and conv_id % 4 = 0 then '{{"type":"turn_context","payload":{{"cwd":"/work/q' || turn || '"}}}}'
      when k = 4 then '{{"type":"event_msg","payload":{{"type":"token_count"}}}}' when k = 5 then '{{"type":"event_msg","payload":{{"type":"agent_message"}}}}'
      else '{{"type":"response_item","payload":{{"type":"message","role":"' || role || '","content":[{{"type":"input_text","text":' || w || '}}]}}}}' end
  else
    case when role = 'system' then '{{"type":"system","cwd":"/work/up/../p"}}'
      when k = 0 then '{{"type":"' || role || '","message":{{"content":[{{"type":"text","text":' || w || '}},{{"type":"tool_use"}},{{"type":"thinking"}},{{"type":"text","text":7}}]}}}}'
      when k = 1 then '{{"type":"assistant","channel":"analysis","message":{{"content":' || w || '}}}}' when k = 2 then '{{"type":"' || role || '","message":{{"content":[{{"type":"tool_result","content":"x"}}]}}}}'
      when k = 3 then '[1, 2]' when k = 4 then '{{"type":"user","cwd":"/work/t' || (turn % 2) || '","message":{{"content":' || w || '}}}}' when k = 5 then '{{"type":"user","message":{{"content":[]}}}}'
      else '{{"type":"' || role || '","message":{{"content":' || w || '}}}}' end end as value from cv),
vs as (select *, case when json_valid(value) then value::json end as v from ln),
bd as (select *, coalesce(json_type(v) = 'OBJECT', false) as obj, case when layout = 'items' then json_extract(v, '$.payload') else json_extract(v, '$.message') end as b from vs),
fl as (select source, start, layout, value, v, obj, {_S('$.type')} as kind, {_S('$.type', 'b')} as bk, {_S('$.role', 'b')} as br, coalesce({_S('$.channel', 'b')}, case when layout = 'turns' then {_S('$.channel')} end) as channel,
  {_S('$.content', 'b')} as words, case when json_type(b, '$.content') = 'ARRAY' then json_extract(b, '$.content[*]') end as items, coalesce(json_type(b) = 'OBJECT', false) as has,
  case when {_S('$.type')} in ('session_meta', 'turn_context') and json_type(v, '$.payload') = 'OBJECT' then {_S('$.payload.cwd')} else {_S('$.cwd')} end as folder from bd),
rl as (select *, case when has and not coalesce(role = 'assistant' and channel not in {_in(ingest.SAID)}, false) then role end as who,
  case when folder like '/%' and strlen(folder) <= {ingest.PATH_BYTES} and not list_contains(string_split(folder, '/'), '..') then folder end as cwd,
  list_transform(items, lambda x, i: struct_pack(block := i - 1, kind := {_S('$.type', 'x')}, text := {_S('$.text', 'x')})) as bl
  from (select *, case when layout = 'items' then case when kind = 'response_item' and bk = 'message' and br in ('user', 'assistant') then br end when kind in ('user', 'human', 'assistant') then kind end as role from fl)),
sd as (select *, case when who is null then [] when bl is not null then list_filter(bl, lambda x: coalesce(x.text <> '' and (x.kind = 'text' or (layout = 'items' and x.kind in ('input_text', 'output_text'))), false))
  when layout = 'turns' and words <> '' then [struct_pack(block := -1, kind := null::varchar, text := words)] else [] end as said from rl),
tx as (select source, start, who as role, kind, unnest(said) as s from sd)"""
_YES = lambda c: f"coalesce({c}, false)"
_ACCOUNTS = f"""with {_LINES},
fg as (select *, v is not null as whole, layout = 'items' and {_YES("kind = 'response_item'")} as item, layout = 'items' and {_YES("kind = 'event_msg'")} as event, {_YES(f"channel not in {_in(ingest.SAID)}")} as hidden from sd),
f2 as (select *, (item and ({_YES(f'bk in {_in(ingest.INNER)}')} or {_YES("bk = 'message' and br = 'assistant' and hidden")})) or (event and {_YES(f'bk in {_in(ingest.THINKING)}')})
  or (layout = 'turns' and {_YES("kind = 'assistant'")} and hidden) as inner_, (event and {_YES(f'bk in {_in(ingest.EVENTS)}')}) or ({_YES(f'kind in {_in(ingest.DESCRIBING)}')} and not item and not event) as describes,
  list_filter(bl, lambda x: not list_contains(list_transform(said, lambda y: y.block), x.block)) as ot from fg),
f3 as (select *, item and {_YES(f'bk in {_in(ingest.TOOLS)}')} and not inner_ as tool from f2),
f4 as (select *, obj and not inner_ and not tool and not describes and not event as opened from f3),
n as (select source, start, 1 as processed_records, (whole and len(said) > 0)::int as indexed_records, case when whole then len(said) else 0 end as text_blocks,
  case when whole then coalesce(list_sum(list_transform(said, lambda x: strlen(x.text))), 0) else 0 end as text_bytes, (whole and (describes or (opened and len(said) = 0 and {_YES('len(items) = 0')})))::int as metadata_records,
  (whole and inner_)::int as internal_records, case when opened then len(list_filter(ot, lambda x: {_YES(f'x.kind in {_in(ingest.INNER_BLOCKS)}')})) end as internal_blocks, (whole and tool)::int as tool_records,
  case when opened then len(list_filter(ot, lambda x: {_YES(f'x.kind in {_in(ingest.TOOL_BLOCKS)}')})) end as tool_blocks, case when opened then len(list_filter(ot, lambda x: {_YES(f'x.kind in {_in(ingest.ATTACHED)}')})) end as attachment_blocks,
  (whole and (not obj or (event and not {_YES(f'bk in {_in([*ingest.THINKING, *ingest.EVENTS])}')}) or (opened and items is null and len(said) = 0)))::int as unsupported_records,
  case when opened then len(list_filter(ot, lambda x: not {_YES(f'x.kind in {_in([*ingest.TOOL_BLOCKS, *ingest.ATTACHED, *ingest.INNER_BLOCKS])}')} and not {_YES(f"x.kind in {_in(ingest.TEXTS[ingest.ITEMS])} and x.text = ''")})) end as unsupported_blocks,
  (not whole)::int as malformed_records from f4)
select source, {', '.join(f"coalesce(sum({c}), 0)::bigint as {c}" for c in ingest.COUNTERS if not c.startswith('oversized'))}, 0::bigint as oversized_records, 0::bigint as oversized_bytes,
  max(start + 1000) as processed_bytes, 0::bigint as pending_bytes, case when {' + '.join(f'coalesce(sum({c}), 0)' for c in ingest.MISSING if c != 'oversized_records')} > 0 then 'gaps' else 'complete_supported_text' end as text_coverage
from n group by source"""
_TEXTS = f"""with {_LINES}
select source, start, role, kind, s.block::int as block, 0::bigint as block_start, md5(s.text) as digest from tx"""
_SCOPES = f"""with {_LINES},
f as (select source, min(start) as first_offset, arg_min(cwd, start) as workspace from sd where cwd is not null group by source),
c as (select f.source, min(sd.start) as conflict_at from sd join f on f.source = sd.source where sd.cwd <> f.workspace group by f.source),
m as (select tx.source, case when tx.start >= first_offset and (conflict_at is null or tx.start < conflict_at) then workspace end as workspace, first_offset, conflict_at
      from tx left join f on f.source = tx.source left join c on c.source = tx.source)
select source, count(workspace) as n_scoped, count(*) - count(workspace) as n_unscoped, max(workspace) as workspace, any_value(first_offset) as first_offset, any_value(conflict_at) as conflict_at from m group by source"""

QUERIES = {"capture_accounts": (_accounts, _ACCOUNTS), "capture_texts": (_texts, _TEXTS), "capture_scopes": (_scopes, _SCOPES)}
