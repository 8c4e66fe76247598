"""Ignore rules down a tree of paths, packets of evidence and runs of enrichment over the given tables, each with its SQL where that can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import context
from ..operators.enrich import Enrichment
from ..sources import ignoring
from ..sources.tables import drawers, table
from .lineage import shared_dir
from .name_queries import PATTERNS

#: Ignore files of three levels over the paths <language>/<source>/<kind>/<number>.<ending>.
FILES = {"": "*.log\n!keep*.log\ntmp/\n/de/*/docs\n", "en": "!*.log\n**/old?/\n", "en/src1": "*.md\n/docs/**/1*\n!tmp/\n"}


def _paths(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    kind = F.element_at(F.array(*map(F.lit, ["docs", "tmp", "old1", "src", "old12"])), (F.col("doc_id") % 5).cast("int") + 1)
    ending = F.element_at(F.array(*map(F.lit, ["log", "md", "txt"])), (F.col("doc_id") % 3).cast("int") + 1)
    return d.select(F.concat_ws("/", F.coalesce("lang", F.lit("none")), F.coalesce("source", F.lit("none")), kind, F.concat(F.when(F.col("doc_id") % 2 == 0, "keep").otherwise(""), "doc_id", F.lit("."), ending)).alias("path"))


def _ignored(spark, sf_dir):
    return ignoring.ignored(_paths(spark, sf_dir), spark.createDataFrame(list(FILES.items()), "folder string, text string"))


def _packets(spark, sf_dir):
    """A workspace is the last digit of a conversation; pins are its first system messages, live its messages, shared the documents of that last digit by length."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 10).alias("workspace"), F.concat(F.lit("m"), F.lpad("conv_id", 9, "0"), F.lit("/"), "turn").alias("id"), "role", F.col("conv_id").alias("at"), "text")
    pins = c.where("role = 'system'").groupBy("workspace").agg(F.min(F.struct("id", "text")).alias("m")).select("workspace", "m.id", "m.text", F.lit(0).alias("place"))
    d = table(spark, sf_dir, "documents").where("n_chars < 400").select((F.col("doc_id") % 10).alias("workspace"), F.concat(F.lit("d"), F.lpad("doc_id", 9, "0")).alias("id"), "text", F.col("doc_id").alias("place"))
    return context.restored(pins, d, context.live(c), budget=3000).select("workspace", "rank", "id", "used")


def _enriched(spark, sf_dir):
    """Three runs of 200 texts each."""
    one = Enrichment(spark, f"{shared_dir(spark)}/enrich-{uuid.uuid4().hex}", PATTERNS)
    texts, known = drawers(spark, sf_dir).select("id", "text"), spark.createDataFrame([("That", "person"), ("Of", "project")], "name string, kind string")
    for _ in range(3):
        one.run(texts, known, 200)
    return one.facts().groupBy("run", "subject").agg(F.count("*").alias("n"), F.countDistinct("object").alias("drawers"), F.min("object").alias("first"))


_LIVE = """
c as (select conv_id % 10 as workspace, 'm' || lpad(conv_id::varchar, 9, '0') || '/' || turn as id, role, conv_id as at_, text from conversations),
pn as (select workspace, arg_min(struct_pack(id := id, text := text), id) as m from c where role = 'system' group by 1),
sp as (select *, role = 'assistant' as speaker, row_number() over (partition by workspace, role = 'assistant' order by at_ desc, id desc) as nth from c where role in ('user', 'human', 'assistant')),
rc as (select * from sp where nth <= case when speaker then 4 else 8 end),
lv as (select workspace, id, text, row_number() over (partition by workspace order by turn, at_ desc, id desc) as place from (select *, 0 as turn from rc where not speaker and nth <= 4 union all select *, 1 as turn from rc)),
sh as (select doc_id % 10 as workspace, 'd' || lpad(doc_id::varchar, 9, '0') as id, text, doc_id as place from documents where n_chars < 400),
ev as (select workspace, m.id as id, m.text as text, 0 as turn, 0 as pos from pn
  union all select workspace, id, text, 1, (row_number() over (partition by workspace order by place, id) - 1) * 2 from sh union all select workspace, id, text, 1, (row_number() over (partition by workspace order by place, id) - 1) * 2 + 1 from lv),
on_ as (select * from (select *, row_number() over (partition by workspace, id order by turn, pos) as again from ev) where again = 1),
rk as (select *, row_number() over (partition by workspace order by turn, pos, id)::int as rank from on_),
us as (select *, sum(strlen(coalesce(text, '')) + 96) over (partition by workspace order by turn, pos, id rows unbounded preceding)::bigint as used from rk where rank <= 8)"""

QUERIES = {
    "ignored_paths": (_ignored, """
        with p as (select distinct concat_ws('/', coalesce(lang, 'none'), coalesce(source, 'none'), ['docs', 'tmp', 'old1', 'src', 'old12'][doc_id % 5 + 1], (case when doc_id % 2 = 0 then 'keep' else '' end) || doc_id || '.' || ['log', 'md', 'txt'][doc_id % 3 + 1]) as path from documents where doc_id is not null),
        s as (select path, string_split(path, '/') as x from p),
        f as (select path, x[1] = 'de' and x[3] = 'docs' as hidden_docs, x[3] = 'tmp' and not (x[1] = 'en' and x[2] = 'src1') as hidden_tmp, x[1] = 'en' and x[3] = 'old1' as hidden_old, x from s)
        select path, case when hidden_docs or hidden_tmp or hidden_old then true when x[1] = 'en' and x[2] = 'src1' then x[3] <> 'tmp' and (x[4] like '%.md' or (x[3] = 'docs' and x[4] like '1%'))
          when x[1] = 'en' then false else x[4] like '%.log' and x[4] not like 'keep%.log' end as ignored from f"""),
    "restored_context": (_packets, "with" + _LIVE + " select workspace, rank, id, used from us where used <= 3000"),
    "enrichment_runs": (_enriched, None),
}
