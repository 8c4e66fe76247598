"""Requirements, segments, session heads and the register of names over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import entities, quality, requirements as rq, segments as sg
from ..operators import registry
from ..sources import transcripts
from ..sources.tables import table

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


# --- requirements: two thirds of the documents become lists with ids, bullets and steps, the rest stays prose
def _specs(spark, sf_dir):
    ident = lambda i: F.concat(F.lit("FR-"), F.col("doc_id").cast("string"), F.lit("00"), i.cast("string"))
    line = lambda s, i: (F.when(i % 5 == 0, F.concat(ident(i), F.lit(": the user shall validate "), s, F.lit(" within 5 seconds as "), ident(F.lit(0)), F.lit(" says")))
                         .when(i % 5 == 1, F.concat(F.lit("- a fast system must send "), s)).when(i % 5 == 2, F.concat(F.lit("  Given "), s)).otherwise(s))
    text = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    return _docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(text).alias("text"))


_SPECS = r"""
raw as (select doc_id, coalesce(text, '') as text from documents),
sp as (select doc_id, case when doc_id % 3 = 0 then text else array_to_string(list_transform(string_split(text, chr(10)), lambda s, i:
    case (i - 1) % 5 when 0 then 'FR-' || doc_id || '00' || (i - 1) || ': the user shall validate ' || s || ' within 5 seconds as FR-' || doc_id || '000 says'
      when 1 then '- a fast system must send ' || s when 2 then '  Given ' || s else s end), chr(10)) end as text from raw),
ln as (select doc_id, string_split(regexp_replace(regexp_replace(text, '(?s)```.*?```', '', 'g'), '(?s)<!--.*?-->', '', 'g'), chr(10)) as l, text from sp),
mk as (select doc_id, text, list_concat(list_concat(list_filter(l, lambda s: regexp_matches(s, '(?:[A-Z]+-)?(?:FR|REQ|NFR)-\d+')),
    list_transform(list_filter(l, lambda s: regexp_matches(s, '^\s*[-*+]\s+.')), lambda s: regexp_replace(s, '^\s*[-*+]\s+', ''))),
    list_transform(list_filter(l, lambda s: regexp_matches(s, '^\s*(?:Given|When|Then|And|But)\s+.')), lambda s: regexp_replace(s, '^\s*(?:Given|When|Then|And|But)\s+', ''))) as m from ln),
it as (select doc_id, list_filter(list_transform(case when len(m) > 0 then m else string_split(regexp_replace(text, '(^|[^0-9])[.!?]+(\s|$)', '\1' || chr(1) || '\2', 'g'), chr(1)) end,
    lambda s: """ + _TRIM.format("s") + r"""), lambda s: length(s) >= 11) as l from mk),
ex as (select doc_id, list_filter(l, lambda s, i: list_position(l, s) = i) as r from it)"""


def _extracted(spark, sf_dir):
    return _specs(spark, sf_dir).select("doc_id", rq.extracted(F.col("text")).alias("requirements"))


def _each(spark, sf_dir):
    """A row for each requirement; they are exploded as they are found, since Spark adds a filter to a column that is exploded, which would find them again."""
    return _specs(spark, sf_dir).select("doc_id", F.explode(rq.extracted(F.col("text"))).alias("r"))


def _diagnoses(spark, sf_dir):
    rows = _each(spark, sf_dir).select(rq.diagnosis(F.col("r")).alias("d"))
    return rows.groupBy(F.col("d.hard").alias("hard"), F.col("d.soft").alias("soft"), F.array_join("d.soft_words", ",").alias("soft_words"), F.col("d.diagnosis").alias("diagnosis")).agg(F.count("*").alias("n"))


def _relations(spark, sf_dir):
    rows = _each(spark, sf_dir).select("doc_id", rq.named(F.col("r")).alias("named"))
    return rq.relations(rows, "doc_id").groupBy("source", "relation", "target").agg(F.count("*").alias("n"))


def _quoted(held):
    return ", ".join(f"'{w}'" for w in held)


_LOW = "lower(r)"
_NAMED = _SPECS + f""",
rr as (select unnest(r) as r from ex), rw as (select list_distinct(regexp_extract_all(lower(r), '[\\p{{L}}\\p{{N}}_]+')) as w from rr),
nm as (select list_filter(w, lambda x: x in ({_quoted(rq.ACTORS)})) as a, list_filter(w, lambda x: x in ({_quoted(w for w in rq.OBJECTS if w not in rq.ACTORS)})) as o,
  list_distinct(list_filter(list_transform(w, lambda x: regexp_extract(x, '^({"|".join(rq.VERBS)})[seding]*$', 1)), lambda x: x <> '')) as v from rw),
av as (select a, o, unnest(v) as v from nm where len(a) > 0),
re as (select unnest(a) as source, 'performs' as relation, v as target from av union all select v, 'on', unnest(o) from av)"""


def _overall(spark, sf_dir):
    """The overall score of each document, from its metrics and its cognitive load."""
    d = _docs(spark, sf_dir)
    m = quality.metrics(d, "doc_id").select("doc_id", "atomicity_score", "completeness_score", "passive_voice_ratio", "ambiguous_pronoun_ratio")
    c = rq.cognitive_load(d).select("doc_id", "flesch_reading_ease", "cognitive_load")
    at = m.join(c, "doc_id")
    score = rq.overall(*[F.col(x) for x in ("flesch_reading_ease", "atomicity_score", "completeness_score", "passive_voice_ratio", "ambiguous_pronoun_ratio", "cognitive_load")])
    return at.select("doc_id", F.round("cognitive_load", 6).alias("cognitive_load"), F.round(score, 4).alias("score"))


# --- segments: raw texts, dialogues, and blocks of a word a line
def _told(spark, sf_dir):
    d = _docs(spark, sf_dir)
    turn = F.array_join(F.transform(F.split("text", "\n"), lambda s, i: F.when(i % 4 == 0, F.concat(F.lit("> "), s)).when(i % 4 == 2, F.concat(F.lit(" Assistant: "), s)).otherwise(s)), "\n")
    block = F.array_join(quality.words(F.col("text")), "\n")
    return d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, turn).otherwise(block).alias("text"))


_MARK_SQL = r"(?:>[^\S\n]+\S|(?:human|user|q)[^\S\n]*:|(?:assistant|ai|a|claude|chatgpt)[^\S\n]*:)"
_TOLD = r"""
raw as (select doc_id, coalesce(text, '') as text from documents),
tx as (select doc_id, case doc_id % 3 when 0 then text when 1 then array_to_string(list_transform(string_split(text, chr(10)), lambda s, i: case (i - 1) % 4 when 0 then '> ' || s when 2 then ' Assistant: ' || s else s end), chr(10))
    else array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), chr(10)) end as text from raw),
ls as (select doc_id, text, string_split(text, chr(10)) as l, len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '(?i)^\s*""" + _MARK_SQL + r"""'))) as n,
    string_split(regexp_replace(text, '(?i)(\n)([^\S\n]*""" + _MARK_SQL + r""")', '\1' || chr(1) || '\2', 'g'), chr(1)) as t from tx),
sg as (select doc_id, n, len(l) as n_lines, list_transform(t, lambda s, i: case when i < len(t) then regexp_replace(s, '\n$', '') else s end) as t,
    list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda s: """ + _TRIM.format("s") + r"""), lambda s: s <> '') as p,
    list_filter(list_transform(range(0, len(l), 25), lambda i: """ + _TRIM.format("array_to_string(l[i + 1:i + 25], chr(10))") + r"""), lambda s: s <> '') as g from ls),
se as (select doc_id, case when n >= 3 then list_filter(t, lambda s: s <> '') when len(p) <= 1 and n_lines > 20 then g else p end as s from sg)"""


# --- session logs: headers, resumed sessions, prompts
def _logs(spark, sf_dir):
    line = lambda s, i: (F.when(i % 7 == 0, F.concat(F.lit("Session v"), i.cast("string"), F.lit(" "), s)).when(i % 14 == 9, F.concat(s, F.lit(" (Ctrl+E)")))
                         .when(i % 7 == 3, F.concat(F.lit("> "), F.when(i == 3, "git ").otherwise(""), s)).otherwise(s))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


_LOGS = r"""
lg as (select doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda s, i: case when (i - 1) % 7 = 0 then 'Session v' || (i - 1) || ' ' || s when (i - 1) % 14 = 9 then s || ' (Ctrl+E)'
    when (i - 1) % 7 = 3 then '> ' || case when i = 4 then 'git ' else '' end || s else s end) as l from documents)"""


def _stamps(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderdate is not null")
    text = F.concat(F.lit("Session\n⏺ 9:05 AM Monday, "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("\nhello"))
    return o.select(sg.stamp(text).alias("t")).groupBy("t.stamp", "t.day").agg(F.count("*").alias("n"))


def _names(spark, sf_dir):
    """The first word of each benchmark item is a person's name, the second an alias."""
    w = F.regexp_extract_all(F.col("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    at = table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", w.alias("w")).where(F.size("w") >= 3)
    return at.select("item_id", F.get("w", F.lit(0)).alias("name"), F.array(F.get("w", F.lit(1))).alias("aliases"), (0.5 + (F.col("item_id") % 5) / 10).alias("confidence"), F.lit("learned").alias("source"), F.get("w", F.lit(2)).alias("project"))


_NAMES = r"""
bw as (select item_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') as w from benchmark where text is not null), b as (select item_id, w from bw where len(w) >= 3),
pt as (select lower(unnest(w[1:2])) as term, w[1] as name, 0.5::double + (item_id % 5)::double / 10 as confidence, 'learned' as source from b),
pe as (select term, (min({'n': name, 'c': confidence})).n as name, (min({'n': name, 'c': confidence})).c as confidence from pt group by term),
pj as (select lower(w[3]) as term, min(w[3]) as project from b group by 1), df as (select distinct lower(w[1]) as term from b where item_id % 2 = 0)"""


def _heads(spark, sf_dir):
    """(doc_id, word, context): the words that begin the documents, with the whole text around them."""
    return _docs(spark, sf_dir).select("doc_id", F.regexp_extract("text", r"([\p{L}\p{N}_]+)", 1).alias("word"), F.col("text").alias("context")).where("word <> ''")


def _looked(spark, sf_dir):
    p = _names(spark, sf_dir)
    found = registry.looked_up(_heads(spark, sf_dir), p, p.select(F.col("project").alias("name")), p.where("item_id % 2 = 0").select(F.col("name").alias("word")))
    return found.select("doc_id", "type", "name", F.round("confidence", 6).alias("confidence"), "source", "by_context")


def _sql_sign(pattern):
    """A sign for an engine without looks around: the character beside the word is taken along."""
    edge = pattern.replace(r"\b@", r"(?:^|[^\p{L}\p{N}_])@").replace(r"@\b", r"@(?:$|[^\p{L}\p{N}_])")
    return edge.replace("@", r"\x01").replace("'", "''")


def _votes_sql(signs):
    return " + ".join(f"regexp_matches(c, '{_sql_sign(p)}')::int" for p in signs)


_LOOKED = "with" + _NAMES + r""",
h as (select doc_id, regexp_extract(text, '[\p{L}\p{N}_]+') as word, text from documents where text is not null),
j as (select doc_id, word, text, pe.name, confidence, project, (df.term is not null and pe.name is not null) as asked, replace(lower(text), lower(word), chr(1)) as c
  from h left join pe on pe.term = lower(word) left join pj on pj.term = lower(word) left join df on df.term = lower(word) where word <> ''),
v as (select *, case when asked then """ + _votes_sql(registry.PERSON_SIGNS) + """ else 0 end as yes, case when asked then """ + _votes_sql(registry.CONCEPT_SIGNS) + """ else 0 end as no from j)
select doc_id, case when yes > no then 'person' when no > yes then 'concept' when name is not null then 'person' when project is not null then 'project' else 'unknown' end as type,
  case when yes <> no then word when name is not null then name when project is not null then project else word end as name,
  round(case when yes > no then least(0.95::double, 0.7::double + yes * 0.1::double) when no > yes then least(0.9::double, 0.7::double + no * 0.1::double) when name is not null then confidence when project is not null then 1 else 0 end, 6) as confidence,
  case when yes > no then 'learned' when no > yes then 'context_disambiguated' when name is not null then 'learned' when project is not null then 'onboarding' else 'none' end as source, yes <> no as by_context from v"""


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))


def _unknown(spark, sf_dir):
    p = _names(spark, sf_dir)
    return registry.unknown(_asked(spark, sf_dir), p, p.select(F.col("project").alias("name")), ["the", "and"]).groupBy("name").agg(F.count("*").alias("n"))


def _commits(spark, sf_dir):
    """Orders as commits: ten customers share an address, one in seven has none, and every hundredth author is a machine."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_custkey").cast("string")
    name = F.when(F.col("o_custkey") % 100 == 99, F.concat(F.lit("worker-"), k, F.lit("[bot]"))).otherwise(F.concat(F.lit("Ann C"), k))
    return o.select(name.alias("name"), F.when(F.col("o_custkey") % 7 != 0, F.concat(F.lit("m"), F.floor(F.col("o_custkey") / 10).cast("string"), F.lit("@x.org"))).alias("address"))


_COMMITS = """
c as (select o_custkey as k, count(*) as n from orders where o_custkey % 100 <> 99 group by 1),
g as (select *, case when k % 7 <> 0 then 'm' || (k // 10) else 'c' || k end as person from c),
t as (select person, arg_min('Ann C' || k, {'n': -n, 's': 'Ann C' || k}) as name, max(case when k % 7 <> 0 then 'm' || (k // 10) || '@x.org' end) as address, sum(n)::bigint as n from g group by 1)
select name, coalesce(address, '') as addresses, n from t"""


# --- transcripts: conversations as JSON lines, documents as outputs of tools, events as calls
_TOOLS = ["Bash", "Grep", "Read", "Other", "Glob"]


def _outputs(spark, sf_dir):
    tool = F.get(F.array(*[F.lit(x) for x in _TOOLS]), (F.col("doc_id") % 5).cast("int"))
    text = F.when(F.col("doc_id") % 5 == 3, F.col("text")).otherwise(F.replace("text", F.lit(" "), F.lit("\n")))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(transcripts.tool_result(text, tool), 256).alias("sha256"))


_OUTPUTS = r"""
with o as (select doc_id, (['""" + "', '".join(_TOOLS) + r"""'])[doc_id % 5 + 1] as tool, regexp_replace(case when doc_id % 5 = 3 then coalesce(text, '') else replace(coalesce(text, ''), ' ', chr(10)) end, '^\s+|\s+$', '', 'g') as body from documents),
l as (select *, list_transform(string_split(body, chr(10)), lambda s: '→ ' || s) as l from o),
r as (select doc_id, case when body = '' or tool = 'Read' then ''
    when tool = 'Bash' then case when len(l) <= 40 then array_to_string(l, chr(10)) else array_to_string(l[1:20], chr(10)) || chr(10) || '→ ... [' || (len(l) - 40) || ' lines omitted] ...' || chr(10) || array_to_string(l[-20:], chr(10)) end
    when tool in ('Grep', 'Glob') then case when len(l) <= 20 then array_to_string(l, chr(10)) else array_to_string(l[1:20], chr(10)) || chr(10) || '→ ... [' || (len(l) - 20) || ' more matches]' end
    when length(body) > 2048 then '→ ' || body[1:2048] || '... [truncated, ' || length(body) || ' chars]' else '→ ' || body end as s from l)
select doc_id, sha256(s) as sha256 from r"""


def _calls(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 4 == 0, "Read").when(F.col("event_id") % 4 == 1, "Grep").when(F.col("event_id") % 4 == 2, "Bash").otherwise(F.col("event_type"))
    given = F.to_json(F.struct(F.col("event_type").alias("file_path"), F.col("user_id").alias("offset"), F.when(F.col("event_id") % 3 > 0, F.col("user_id") % 9).alias("limit"), F.col("event_type").alias("pattern"),
                               F.when(F.col("event_id") % 5 == 0, F.lit("src")).alias("path"), F.lit("*.py").alias("glob"), F.repeat(F.col("event_type"), (F.col("user_id") % 60).cast("int")).alias("command")))
    return e.select(transcripts.tool_call(name, F.when(F.col("event_id") % 4 == 3, F.to_json(F.struct("user_id"))).otherwise(given)).alias("line")).groupBy("line").agg(F.count("*").alias("n"))


_CALLS = """
with c as (select event_id % 4 as k, event_type as e, user_id as u, event_id % 3 > 0 as ranged, case when event_id % 5 = 0 then 'src' else '*.py' end as p, repeat(event_type, (user_id % 60)::int) as cmd from events)
select case k when 0 then '[Read ' || e || case when ranged then ':' || u || '-' || (u + u % 9) else '' end || ']' when 1 then '[Grep] ' || e || ' in ' || p
  when 2 then '[Bash] ' || case when length(cmd) > 200 then cmd[1:200] || '...' else cmd end else '[' || e || '] {"user_id":' || u || '}' end as line, count(*) as n from c group by 1"""


def _started(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "assistant", "gemini").otherwise(F.col("role"))
    said = c.select("conv_id", (F.col("turn") + 1).cast("long").alias("line"), F.to_json(F.struct(kind.alias("type"), F.array(F.struct("text")).alias("content"))).alias("value"))
    begun = c.where("conv_id % 2 = 0").select("conv_id", F.lit(0).cast("long").alias("line"), F.lit('{"type":"session_metadata"}').alias("value")).distinct()
    return transcripts.started_messages(said.unionByName(begun), "conv_id").select("conv_id", "ordinal", "role", F.sha2("content", 256).alias("sha256"))


_STARTED = r"""
with t as (select conv_id, (turn + 1)::bigint as ordinal, role, text from conversations where conv_id % 2 = 0 and turn >= 0 and role in ('user', 'assistant') and regexp_matches(text, '\S'))
select conv_id, ordinal, role, sha256(text) as sha256 from t where conv_id in (select conv_id from t group by 1 having count(*) >= 2)"""


QUERIES = {
    "tool_results": (_outputs, _OUTPUTS),
    "tool_calls": (_calls, _CALLS),
    "started_messages": (_started, _STARTED),
    "requirements": (lambda s, d: _extracted(s, d).select("doc_id", F.size("requirements").alias("n"), F.sha2(F.array_join("requirements", "\x1f"), 256).alias("sha256")),
                     "with" + _SPECS + " select doc_id, len(r)::int as n, sha256(array_to_string(r, chr(31))) as sha256 from ex"),
    "requirement_refs": (lambda s, d: rq.references(_specs(s, d), "doc_id", rq.extracted(F.col("text"))).select("doc_id", "id", F.array_join("refs", ",").alias("refs")), "with" + _SPECS + r""",
        i as (select doc_id, pos, regexp_extract_all(r[pos], '(?:[A-Z]+-)?(?:FR|REQ|NFR|AC|SC)-\d+') as ids from (select doc_id, r, unnest(range(1, len(r) + 1)) as pos from ex)),
        o as (select doc_id, ids[1] as id, arg_max(ids, pos) as ids from i where len(ids) > 0 group by 1, 2)
        select doc_id, id, array_to_string(list_filter(ids, lambda x: x <> id), ',') as refs from o"""),
    "requirement_diagnosis": (_diagnoses, "with" + _SPECS + ", rr as (select lower(unnest(r)) as r from ex), h as (select "
                              + " + ".join("len(regexp_extract_all(r, '" + p + "'))" for p in quality.HARD) + " as hard, list_filter([" + _quoted(quality.SOFT) + """], lambda w: contains(r, w)) as w from rr)
        select hard::int as hard, len(w)::int as soft, array_to_string(w, ',') as soft_words, case when hard = 0 then 'no numeric thresholds' end as diagnosis, count(*) as n from h group by all"""),
    "requirement_relations": (_relations, "with" + _NAMED + " select source, relation, target, count(*) as n from re group by all"),
    "requirement_score": (_overall, None),
    "nouns": (lambda s, d: _docs(s, d).select("doc_id", rq.nouns(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("n_distinct")), r"""
        with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+') as w from documents),
        n as (select doc_id, list_concat(list_filter(w, lambda x: regexp_full_match(x, '[A-Z][a-z]+')), list_filter(list_transform(w, lambda x: lower(x)), lambda x: regexp_full_match(x, '.+(tion|ment|ness|ity|er|or|ist)'))) as w from w)
        select doc_id, len(w)::int as n, len(list_distinct(w))::int as n_distinct from n"""),
    "segments": (lambda s, d: _told(s, d).select("doc_id", F.posexplode(sg.segments(F.col("text"))).alias("ordinal", "s")).select("doc_id", "ordinal", F.sha2("s", 256).alias("sha256")),
                 "with" + _TOLD + " select doc_id, (i - 1)::int as ordinal, sha256(s[i]) as sha256 from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from se)"),
    "session_starts": (lambda s, d: sg.session_starts(_logs(s, d), "doc_id", "Session v"), "with" + _LOGS + """,
        i as (select doc_id, l, unnest(range(1, len(l) + 1)) as i from lg)
        select doc_id, (i - 1)::int as line from i where contains(l[i], 'Session v') and not contains(array_to_string(l[i:i + 5], ''), 'Ctrl+E') and not contains(array_to_string(l[i:i + 5], ''), 'previous messages')"""),
    "session_subjects": (lambda s, d: _logs(s, d).select("doc_id", sg.subject(F.col("text")).alias("subject")), "with" + _LOGS + r""",
        p as (select doc_id, list_filter(list_transform(list_filter(l, lambda s: starts_with(s, '> ')), lambda s: """ + _TRIM.format("s[3:]") + r"""), lambda s: length(s) > 5 and not regexp_matches(s, '^(\./|cd |ls |python|bash|git |cat |source |export |claude)')) as p from lg)
        select doc_id, case when len(p) = 0 then 'session' else regexp_replace(trim(regexp_replace(p[1], '[^\p{L}\p{N}_\s-]', '', 'g')), '\s+', '-', 'g')[1:60] end as subject from p"""),
    "session_stamps": (_stamps, """
        select strftime(o_orderdate, '%Y-%m-%d') || '_905AM' as stamp, strftime(o_orderdate, '%Y-%m-%d') as day, count(*) as n from orders where o_orderdate is not null group by all"""),
    "session_people": (lambda s, d: sg.people(_docs(s, d), "doc_id", _names(s, d).select("name")), "with" + _NAMES + r""",
        h as (select doc_id, lower(unnest(regexp_extract_all(array_to_string(string_split(coalesce(text, ''), chr(10))[1:100], chr(10)), '[\p{L}\p{N}_]+'))) as term from documents)
        select distinct doc_id, w[1] as name from h join b on lower(w[1]) = term"""),
    "session_themes": (lambda s, d: sg.themes(_docs(s, d), "doc_id", ["that", "with"]), r"""
        with w as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}{4,}')) as word from documents), c as (select doc_id, word, count(*) as n from w where word not in ('that', 'with') group by all),
        k as (select *, row_number() over (partition by doc_id order by n desc, word) as k from c) select doc_id, string_agg(word, ', ' order by k) as themes from k where k <= 3 group by 1"""),
    "registry_lookup": (_looked, _LOOKED),
    "registry_people": (lambda s, d: registry.people_of(_asked(s, d), _names(s, d), _names(s, d).where("item_id < 0").select(F.col("name").alias("word"))).groupBy("name").agg(F.count("*").alias("n")), "with" + _NAMES + r""",
        q as (select conv_id, turn, lower(unnest(string_split_regex(text, '[\s,.;:!?()\[\]{}"'']+'))) as term from conversations where text is not null),
        f as (select distinct conv_id, turn, name from q join pe on pe.term = q.term) select name, count(*) as n from f group by 1"""),
    "registry_unknown": (_unknown, "with" + _NAMES + r""",
        q as (select conv_id, turn, unnest(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+')) as name from conversations where text is not null),
        f as (select distinct conv_id, turn, name from q where regexp_full_match(name, '\p{Lu}\p{L}+')) select name, count(*) as n from f
        where lower(name) not in (select term from pe) and lower(name) not in (select term from pj) and lower(name) not in ('the', 'and') and name not in (""" + _quoted(entities.STOP) + ") group by 1"),
    "same_people": (lambda s, d: registry.same_people(_commits(s, d)).select("name", F.array_join("addresses", ",").alias("addresses"), "n"), "with" + _COMMITS),
}
