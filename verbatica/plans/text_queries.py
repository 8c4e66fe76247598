"""Text, classifier, quality and capture queries, each with its SQL where that can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, quality, text as t
from ..operators import retrieval
from ..sources import files
from ..sources.tables import DRAWERS_SQL, drawers, messages, table
from ..streaming import capture

WITH = "with" + DRAWERS_SQL
_W = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source", "lang")


def _digests(name):
    def make(spark, sf_dir):
        return _docs(spark, sf_dir).select("doc_id", t.digest(t.transformation(name)(F.col("text"))).alias("sha256"))

    return make


def _matches(name_sql):
    return f"select doc_id, sha256({name_sql}) as sha256 from (select doc_id, coalesce(text, '') as text from documents)"


def _present(text, words):
    return "(" + " + ".join(f"contains({text}, '{w}')::int" for w in words) + ")"


def _best_sql(scores, fallback):
    names = list(scores)
    top = "greatest(" + ", ".join(scores.values()) + ")"
    cases = " ".join(f"when {scores[n]} = {top} then '{n}'" for n in names)
    return f"case when {top} = 0 then '{fallback}' {cases} end"


_HALL = _best_sql({k: _present("low", v) for k, v in classify.HALLS.items()}, "general")
_ROOM = _best_sql({k: _present("low", v) for k, v in classify.CONVERSATION_ROOMS.items()}, "general")


def _words(spark, sf_dir):
    """Texts that do hold the keywords of the classifiers: urls, page titles and messages as they are."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.coalesce("html", F.lit("")).alias("text"))
    talks = table(spark, sf_dir, "conversations").select((-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return pages.unionByName(talks)


_TEXTS = "x as (select page_id as id, coalesce(html, '') as text from pages union all select -1 - conv_id * 1000 - turn, coalesce(text, '') from conversations)"


_INTENT = " ".join("when regexp_matches(text, '(?i)" + "|".join(patterns).replace("'", "''") + f"') then '{name}'" for name, patterns in classify.INTENTS.items())
_F1 = r"""
with m as (select conv_id, turn, coalesce(text, '') as text, lag(coalesce(text, '')) over (partition by conv_id order by turn) as before from conversations),
p as (select * from m where before is not null),
b as (select conv_id, turn, unnest([text, before]) as body, unnest([1, 2]) as side from p),
w as (select conv_id, turn, side, unnest(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(lower(body), '(^|[^\p{L}\p{N}_])(a|an|the)($|[^\p{L}\p{N}_])', '\1 \3', 'g'), '(^|[^\p{L}\p{N}_])(a|an|the)($|[^\p{L}\p{N}_])', '\1 \3', 'g'), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+')) as word from b),
c as (select conv_id, turn, word, count(*) filter (side = 1) as a, count(*) filter (side = 2) as t from w where word <> '' group by all),
s as (select conv_id, turn, sum(least(a, t)) as same, sum(a) as a, sum(t) as t from c group by all)
select p.conv_id as session_id, p.turn as ordinal, round(coalesce(2 * same / (a + t), 1)::double, 6) as f1 from p left join s on s.conv_id = p.conv_id and s.turn = p.turn"""


def _transcripts(spark, sf_dir):
    return t.transcript(messages(spark, sf_dir))


def _json_lines(spark, sf_dir):
    """Conversations as session records in JSON lines, some of other types and some broken."""
    c = table(spark, sf_dir, "conversations")
    record = F.to_json(F.struct(
        F.when(F.col("role") == "system", "progress").otherwise(F.col("role")).alias("type"), F.concat(F.lit("2024-01-01T00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit(":00Z")).alias("timestamp"),
        F.concat(F.lit("s"), "conv_id").alias("sessionId"), F.concat_ws("-", "conv_id", "turn").alias("uuid"), F.struct("role", F.col("text").alias("content")).alias("message")))
    return c.select(F.when((F.col("conv_id") + F.col("turn")) % 17 == 0, F.substring(record, 1, 20)).otherwise(record).alias("value"), F.col("turn").alias("line"))


_ITEMS = """
c as (select *, (conv_id + turn) % 17 = 0 as broken from conversations)"""


def _quality(spark, sf_dir):
    m = quality.metrics(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return m.select("doc_id", *[F.round(c, 6).alias(c) for c in m.columns if c.endswith("_average") or c == "average_grade_level"])


QUERIES = {
    "split_verbatim": (lambda s, d: t.sliced(_docs(s, d).select("doc_id", "text")).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("start").cast("long").alias("start"), F.char_length("chunk").cast("long").alias("n_chars"), t.digest(F.col("chunk")).alias("sha256")), """
        with recursive ch(doc_id, rest, chunk_index, start, chunk) as (
          select doc_id, text, -1::bigint, 0::bigint, '' from documents where text is not null and text <> ''
          union all
          select doc_id, substring(rest, k + 1), chunk_index + 1, start + length(chunk), substring(rest, 1, k) from (
            select *, case when length(rest) <= 800 then length(rest) when strpos(reverse(substring(rest, 1, 800)), chr(10)) between 1 and 400 then 801 - strpos(reverse(substring(rest, 1, 800)), chr(10)) else 800 end as k
            from ch where rest <> ''))
        select doc_id, chunk_index, start, length(chunk)::bigint as n_chars, sha256(chunk) as sha256 from ch where chunk_index >= 0"""),
    "fixed_windows": (lambda s, d: _docs(s, d).select("doc_id", F.posexplode(t.windows(F.col("text"))).alias("pos", "chunk")).select("doc_id", F.col("pos").cast("long").alias("pos"), t.digest(F.col("chunk")).alias("sha256")), """
        select doc_id, p as pos, sha256(substring(text, (p * 800 + 1)::int, 800)) as sha256 from (select doc_id, text, unnest(generate_series(0, (length(text) - 1) // 800)) as p from documents where length(text) > 0)"""),
    "byte_pieces": (lambda s, d: t.pieces(_docs(s, d).select("doc_id", "text"), size=1000).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.octet_length("chunk")).alias("most"), F.sum(F.octet_length("chunk")).alias("bytes")), None),
    "tokenize": (lambda s, d: _docs(s, d).select("doc_id", F.explode(retrieval.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs")), r"""
        select term, count(*) as n, count(distinct doc_id) as n_docs from (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) as term from documents) group by 1"""),
    "content_ids": (lambda s, d: drawers(s, d).select("id", t.digest(F.col("text")).alias("sha256"), t.source_revision(F.col("text"), F.lit(1), F.lit("project")).alias("revision"), t.revision_id(F.col("wing"), F.col("room"), F.col("source_file"), F.lit("r1"), F.col("chunk_index")).alias("drawer_id")), WITH + """
        select id, sha256(text) as sha256, substr(sha256('1:project:' || text), 1, 24) as revision, 'drawer_' || wing || '_' || room || '_' || substr(sha256(source_file || ':r1:' || chunk_index::varchar), 1, 24) as drawer_id from drawers"""),
    "newline_normalize": (_digests("newline_normalize"), _matches(r"replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))")),
    "whitespace_trim": (_digests("whitespace_trim"), _matches(r"regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')")),
    "collapse_blank_lines": (_digests("whitespace_collapse_internal"), _matches(r"regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g')")),
    "line_trim": (_digests("line_trim"), _matches(r"array_to_string(list_transform(string_split(text, chr(10)), lambda s: regexp_replace(regexp_replace(s, '^\s+', ''), '\s+$', '')), chr(10))")),
    "blank_line_drop": (_digests("blank_line_drop"), _matches(r"coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda s: regexp_replace(s, '\s+', '', 'g') <> ''), chr(10)), '')")),
    "line_join_spaces": (_digests("line_join_spaces"), _matches("array_to_string(list_transform(string_split(replace(text, chr(10) || chr(10), chr(1)), chr(1)), lambda s: replace(s, chr(10), ' ')), chr(10) || chr(10))")),
    "strip_noise": (lambda s, d: _docs(s, d).select("doc_id", t.digest(t.strip_noise(F.concat(F.lit("<system-reminder>\nnone\n</system-reminder>\nCURRENT TIME: 5\n"), "text"))).alias("sha256")), r"select doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '')) as sha256 from documents"),
    "sanitize_query": (lambda s, d: _docs(s, d).select("doc_id", t.sanitized_query(F.col("text")).alias("q")).select("doc_id", "q.method", F.char_length("q.clean").alias("n_chars")), None),
    "message_transcript": (lambda s, d: _transcripts(s, d).select("session_id", t.digest(F.col("text")).alias("sha256")), """
        with m as (select conv_id, turn, role = 'user' as asks, coalesce(text, '') as text, lead(role = 'user') over (partition by conv_id order by turn) as next_asks from conversations where coalesce(text, '') <> '')
        select conv_id as session_id, sha256(string_agg(case when asks then '> ' else '' end || text || case when asks and next_asks = false then chr(10) else chr(10) || chr(10) end, '' order by turn)) as sha256 from m group by 1"""),
    "turn_segments": (lambda s, d: t.exchanges(_transcripts(s, d), "session_id").groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.char_length("exchange")).alias("n_chars")), None),
    "session_splits": (lambda s, d: t.split_at_headers(_docs(s, d).select("doc_id", "text"), "doc_id", r"^[A-ZÀ-Ý]").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.char_length("body")).alias("longest")), None),
    "session_messages": (lambda s, d: files.session_messages(_json_lines(s, d)).select("session_id", "uuid", "ts", "role", F.char_length("content").alias("n_chars")), "with" + _ITEMS + r"""
        select 's' || conv_id::varchar as session_id, conv_id::varchar || '-' || turn::varchar as uuid, '2024-01-01T00:' || lpad((turn % 60)::varchar, 2, '0') || ':00Z' as ts, role, length(trim(text))::int as n_chars
        from c where not broken and role in ('user', 'assistant') and trim(text) <> ''"""),
    "capture_coverage": (lambda s, d: capture.coverage(_json_lines(s, d)), "with" + _ITEMS + """
        select count(*) as n_lines, sum((not broken and role in ('user', 'assistant'))::int)::bigint as n_messages, sum((not broken and role not in ('user', 'assistant'))::int)::bigint as n_other, sum(broken::int)::bigint as n_broken,
               case when sum(broken::int) > 0 then 'gaps' when count(*) = 0 then 'pending' else 'complete' end as status from c"""),
    "message_sweep": (lambda s, d: _swept(s, d), "with" + _ITEMS + """,
        m as (select 's' || conv_id::varchar as session_id, conv_id::varchar || '-' || turn::varchar as uuid, turn from c where not broken and role in ('user', 'assistant') and trim(text) <> ''),
        h as (select session_id, max(turn % 60) as mark from m where turn <= 2 group by 1)
        select session_id, count(*) as n from (select session_id, uuid from m where turn <= 2 union select m.session_id, uuid from m left join h using (session_id) where mark is null or turn % 60 >= mark) group by 1"""),
    "human_messages": (lambda s, d: messages(s, d).where("role = 'user'").groupBy("session_id").agg(F.count("*").alias("n"), F.floor(F.count("*") / 3).alias("saves")), "select conv_id as session_id, count(*) as n, count(*) // 3 as saves from conversations where role = 'user' group by 1"),
    "hall_classifier": (lambda s, d: _words(s, d).select("id", classify.hall(F.col("text")).alias("hall")), f"with {_TEXTS}, l as (select id, lower(text) as low from x) select id, {_HALL} as hall from l"),
    "room_classifier": (lambda s, d: _words(s, d).select("id", classify.conversation_room(F.col("text")).alias("room")), f"with {_TEXTS}, l as (select id, lower(text) as low from x) select id, {_ROOM} as room from l"),
    "intent": (lambda s, d: _words(s, d).select("id", classify.intent(F.col("text")).alias("intent")), f"with {_TEXTS} select id, case {_INTENT} end as intent from x"),
    "memory_type": (lambda s, d: classify.memory_types(_words(s, d)).select("id", "memory_type", F.round("confidence", 6).alias("confidence")), None),
    "ears_pattern": (lambda s, d: _words(s, d).select("id", classify.requirement_form(F.col("text")).alias("form")), f"""
        with {_TEXTS}, l as (select id, lower(text) as low from x) select id, case when {_present("low", ["shall not", "must not", "will not", "should not"])} > 0 then 'unwanted'
          when {_present("low", ["when ", "if ", "upon ", "after ", "before "])} > 0 then 'event_driven' when contains(low, 'while ') then 'state_driven' when contains(low, 'where ') then 'optional'
          when {_present("low", ["shall ", "must ", "will "])} > 0 then 'ubiquitous' else 'unclassified' end as form from l"""),
    "readability": (lambda s, d: quality.readability(_docs(s, d).select("doc_id", "text")).select("doc_id", "n_words", "n_sentences", "n_syllables", "n_complex", *[F.round(c, 5).alias(c) for c in ("flesch_reading_ease", "gunning_fog_index", "average_grade_level")]), f"""
        with a as (select doc_id, coalesce(text, '') as text, {_W.format("coalesce(text, '')")} as w from documents),
        b as (select doc_id, len(w) as n_words, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_replace(s, '\\s+', '', 'g') <> '')) as n_sentences,
              list_transform(w, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - ends_with(x, 'e')::int)) as y, length(regexp_replace(text, '\\s', '', 'g'))::double as n from a),
        c as (select doc_id, n_words, n_sentences, coalesce(list_sum(y), 0) as n_syllables, len(list_filter(y, lambda v: v >= 3)) as n_complex, n, n_words::double as ww, n_sentences::double as ss from b),
        e as (select *, n_words > 0 and n_sentences > 0 as ok, 5.88::double * n / ww - 29.6::double * ss / ww - 15.8::double as cl, 4.71::double * n / ww + 0.5::double * ww / ss - 21.43::double as ar,
              0.39::double * ww / ss + 11.8::double * n_syllables / ww - 15.59::double as fk, 0.4::double * (ww / ss + 100 * n_complex / ww) as fog, 1.0430::double * sqrt(n_complex * 30 / ss) + 3.1291::double as smog,
              206.835::double - 1.015::double * ww / ss - 84.6::double * n_syllables / ww as fre from c)
        select doc_id, n_words::int as n_words, n_sentences::int as n_sentences, n_syllables::int as n_syllables, n_complex::int as n_complex, round(case when ok then greatest(0, least(100, fre)) else 0 end, 5) as flesch_reading_ease,
               round(case when ok then fog else 0 end, 5) as gunning_fog_index, round(case when ok then (greatest(fk, 0) + fog + greatest(smog, 0) + greatest(cl, 0) + greatest(ar, 0)) / 5 else 0 end, 5) as average_grade_level from e"""),
    "quality_metrics": (_quality, None),
    "quality_tier": (lambda s, d: quality.metrics(_docs(s, d).select("doc_id", "text"), "doc_id").select("doc_id", retrieval.quality_tier(F.col("overall_weighted_average"), F.lit(True)).alias("factor"), quality.level(F.col("overall_weighted_average")).alias("level")), None),
    "entity_mentions": (lambda s, d: _mentions(s, d), None),
    "token_f1": (lambda s, d: _f1(s, d), _F1),
    "events_hourly": (lambda s, d: capture.activity(table(s, d, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total")), "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all"),
    "user_sessions": (lambda s, d: capture.sessions(table(s, d, "events")).select("user_id", "start", "n"), """
        with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minutes then 0 else 1 end as fresh from events), k as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from g)
        select user_id, min(ts) as start, count(*) as n from k group by user_id, island"""),
    "event_props": (lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count("*").alias("n")), "select event_type, sum(json_extract_string(props, '$.k')::bigint)::bigint as k, count(*) as n from events group by 1"),
}


def _swept(spark, sf_dir):
    rows = files.session_messages(_json_lines(spark, sf_dir)).drop("content", "role")
    return capture.sweep(rows.where("ordinal <= 2"), rows).groupBy("session_id").agg(F.count("*").alias("n"))


def _mentions(spark, sf_dir):
    from ..operators import knowledge

    d = drawers(spark, sf_dir)
    # names: capitalised words of at least 8 letters that begin no sentence
    names = d.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?<=[a-z,] )(\p{Lu}[\p{L}]{7,})"), F.lit(1))).alias("name")).groupBy("name").agg(F.count("*").alias("n")).where("n >= 2").select("name")
    return knowledge.mentions(d, names)


def _f1(spark, sf_dir):
    from pyspark.sql import Window

    c = messages(spark, sf_dir)
    before = F.lag("content").over(Window.partitionBy("session_id").orderBy("ordinal"))
    pairs = c.withColumn("before", before).where("before is not null")
    return t.token_f1(pairs, ["session_id", "ordinal"], "content", "before").select("session_id", "ordinal", F.round("f1", 6).alias("f1"))


def _names(spark, sf_dir):
    """Names to look for: the capitalised words that several messages have."""
    from ..functions import entities

    talks = table(spark, sf_dir, "conversations").select(F.monotonically_increasing_id().alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return entities.candidates(talks, "id", least=1).groupBy("name").agg(F.count("*").alias("n")).where("n >= 5 and char_length(name) >= 6").select("name")


def _entity_queries():
    from ..functions import article, entities, summary

    docs = lambda s, d: _docs(s, d).select("doc_id", "text")
    stop = ", ".join(f"'{w}'" for w in entities.STOP)
    named = rf"""w as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '(?:^|[^\p{{L}}\p{{N}}_])(\p{{Lu}}\p{{L}}+(?:-\p{{L}}+)*)', 1)) as name from documents),
        c as (select doc_id, name, count(*) as n from w where name not in ({stop}) group by all)"""
    return {
        "entity_candidates": (lambda s, d: entities.candidates(docs(s, d), "doc_id"), f"with {named} select doc_id, name, n from c where n >= 3"),
        "entity_lists": (lambda s, d: entities.entity_list(docs(s, d), "doc_id"), f"""with {named},
            k as (select *, row_number() over (partition by doc_id order by name) as nth from c where n >= 2) select doc_id, string_agg(name, ';' order by name) as entities from k where nth <= 25 group by doc_id"""),
        "entity_kinds": (lambda s, d: entities.kinds(docs(s, d), "doc_id"), None),
        "entity_fuzzy_match": (lambda s, d: entities.fuzzy_mentions(_words(s, d), "id", _names(s, d)), None),
        "summaries": (lambda s, d: summary.compressed(docs(s, d), "doc_id", own=True), None),
        "article_profile": (lambda s, d: article.profile(_docs(s, d), language=F.col("lang")).select("doc_id", "n_words", "n_sentences", "oversized", "words_per_sentence", "flesch_reading_ease", "smog"), None),
        "pointer_lines": (lambda s, d: entities.pointer_lines(drawers(s, d).withColumn("drawer_ids", F.array("id")), "id"), None),
        "key_sentences": (lambda s, d: docs(s, d).select("doc_id", summary.key_sentence(F.col("text")).alias("sentence"), summary.codes(F.col("text"), summary.FLAGS).alias("flags"), summary.token_count(F.col("text")).alias("n_tokens")), None),
    }


QUERIES |= _entity_queries()
