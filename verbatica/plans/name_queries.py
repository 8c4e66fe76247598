"""Names of the documents in three languages at once, the signs around them and their kinds, with SQL that searches each pattern by itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as nm
from ..sources.tables import table

#: Small sections for the made-up prose of the tables: words of an upper-case letter that are followed by `of`, `de`, `der` and so on.
SECTIONS = {
    "en": {"candidate_pattern": r"[A-Z][a-z]{2,19}", "person_verb_patterns": [r"\b{name}\s+of\b", r"\b{name}\s+the\b"], "pronoun_patterns": [r"\bthat\b"], "dialogue_patterns": [r"^{name}\s"], "direct_address_pattern": r"\bto\s+{name}\b|\bby\s+{name}\b",
           "project_verb_patterns": [r"\bthe\s+{name}\b"], "stopwords": ["The", "And"]},
    "de": {"candidate_pattern": r"[A-Z][a-z]+ß[a-z]*", "person_verb_patterns": [r"\b{name}\s+der\b", r"\b{name}\s+of\b"], "pronoun_patterns": [r"\bdas\b"], "project_verb_patterns": [r"\bund\s+{name}\b"], "stopwords": ["Der"]},
}
PATTERNS = nm.merged(SECTIONS.values())


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _register(spark, sf_dir):
    """Capitalised words of the benchmark: a register that does not grow with the documents."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.coalesce("text", F.lit("")), r"[^A-Za-z]+")).alias("name"))
    return words.where("name rlike '^[A-Z][a-z]{3,}$'").distinct()


def _mentions(spark, sf_dir):
    return nm.mentions(_docs(spark, sf_dir), "doc_id", PATTERNS).groupBy("name").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).where("n >= 3")


def _signs(spark, sf_dir):
    return nm.signs(_docs(spark, sf_dir), _register(spark, sf_dir), PATTERNS)


def _kinds(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    found = nm.mentions(docs, "doc_id", PATTERNS).groupBy("name").agg(F.sum("n").alias("n")).join(_register(spark, sf_dir), "name", "left_semi")
    return nm.scored(found, nm.signs(docs, found, PATTERNS), PATTERNS).select("name", "n", "person", "project", "kind", "confidence")


_W = r"[\p{L}\p{N}_]"
# SQL has no borders of Unicode words, so a text becomes tokens: words, white space, the rest
_SIGNS = r"""
nm as (select distinct unnest(regexp_split_to_array(coalesce(text, ''), '[^A-Za-z]+')) as name from benchmark), rg as (select name, lower(name) as low from nm where regexp_full_match(name, '[A-Z][a-z]{3,}')),
tk as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+|[\t-\r\p{Z}]+|[^\p{L}\p{N}_\t-\r\p{Z}]+') as t from documents),
ix as (select t, unnest(range(1, len(t) + 1)) as i from tk),
oc as (select name, case when i > 2 then t[i - 2] end as b2, case when i > 1 then t[i - 1] end as b1, t[i + 1] as a1, t[i + 2] as a2, i from ix join rg on t[i] = low),
o2 as (select *, regexp_full_match(a1, '[\t-\r\p{Z}]+') as after, regexp_full_match(b1, '[\t-\r\p{Z}]+') as before from oc),
s1 as (select name, unnest([case when after and (i = 1 or before and ends_with(b1, chr(10))) then 'dialogue:0' end, case when after and a2 = 'of' then 'action:1' end, case when after and a2 = 'the' then 'action:2' end,
  case when after and a2 = 'der' then 'action:3' end, case when before and b2 in ('to', 'by') then 'addressed:4' end, case when before and b2 = 'the' then 'built:5' end, case when before and b2 = 'und' then 'built:6' end,
  case when a1 = '-' and regexp_full_match(a2, 'v?\d+') then 'versioned:7' end, case when a1 = '.' and a2 in ('py', 'js', 'ts', 'yaml', 'yml', 'json', 'sh') then 'code:8' end]) as sign from o2),
ls as (select regexp_split_to_array(lower(coalesce(text, '')), '\r\n|[\n\r\v\f]') as l from documents), lf as (select l, list_transform(l, lambda x: regexp_matches(x, '(^|[^\p{L}\p{N}_])(that|das)($|[^\p{L}\p{N}_])')) as f from ls),
lj as (select l, f, unnest(range(1, len(l) + 1)) as j from lf), s2 as (select name, 'pronoun:0' as sign from lj join rg on contains(l[j], low) where list_contains(f[greatest(j - 2, 1):j + 2], true)),
sg as (select name, sign, count(*) as n from (select * from s1 where sign is not null union all select * from s2) group by all)"""
QUERIES = {
    "locale_mentions": (_mentions, rf"""
        with d as (select doc_id, coalesce(text, '') as text from documents),
        w as (select doc_id, unnest(regexp_extract_all(text, '{_W}+')) as name from d),
        c as (select * from w where regexp_full_match(name, '[A-Z][a-z]{{2,19}}') union all select * from w where regexp_full_match(name, '[A-Z][a-z]+ß[a-z]*')),
        k as (select doc_id, name, count(*) as n from c where lower(name) not in ('the', 'and', 'der') group by all)
        select name, sum(n)::bigint as n, count(*) as texts from k group by name having sum(n) >= 3"""),
    "locale_signs": (_signs, "with" + _SIGNS + " select name, sign, n from sg"),
    "locale_kinds": (_kinds, None),
}
