"""URL filter by a path-template tree, with DataFrame functions only.

1. A url's host and path are cut out; digits of the path's segments become `#`, so equal shapes count together.
2. Level by level, a node of a host's tree whose children are many for its pages (at least ``FAN`` distinct ones and at
   least the square root of its pages) is variable: its children become `*`.
3. First-level branches of one host merge if they are statistically alike: the same frequent children (each with at least
   ``SHARE`` of the branch's pages) and labelled purity in the same third (or no labels at all).  The merged branch has
   the smallest name of its members.
4. Rules give the labels.  A template's purity is its share of blocked labels, smoothed towards the host's share, which
   is smoothed towards the share of all labels.  A template of purity ``REJECT`` or more is rejected.

A rule's own verdict goes before that of the method; the longest fitting rule wins.  All statistics are sums over (host,
shape), aggregated before any shuffle; joins carry one row per node, and a host of very many pages is a plain skewed join.

A null url, or one without `://`, has an empty host and an empty path and is judged by the purity of that template.
Repeated rows are judged alike, each in its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import cut, table

#: The rules of the contract, as (verdict, host and path).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
DEPTH, FAN, SHARE, SMOOTHING, REJECT = 4, 16, 0.05, 4.0, 0.7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _by_rule(host: Column, path: Column, rules: list[tuple[str, str]], give: int) -> Column:
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last written is asked first
        h, slash, p = rule[1].partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.lit(rule[give])).otherwise(out)
    return out


def judged(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """pages' page_id with host, path, rule, template, purity and verdict."""
    host, path = parsed(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"))
    read = read.withColumn("rule", _by_rule(F.col("host"), F.col("path"), rules, 1)).withColumn("given", _by_rule(F.col("host"), F.col("path"), rules, 0))
    shape = F.array_join(F.filter(F.split(F.regexp_replace("path", "[0-9]+", "#"), "/"), lambda s: s != ""), "/")
    read = read.withColumn("shape", shape)

    shapes = read.groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.sum((F.col("given") == "block").cast("long")).alias("b"), F.count("given").alias("k"))
    shapes = cut(shapes.select("host", "shape", "n", F.coalesce("b", F.lit(0)).alias("b"), "k"), "shapes")
    every = shapes.agg(F.sum("b").alias("b"), F.sum("k").alias("k")).first()
    overall = ((every["b"] or 0) + 0.5 * SMOOTHING) / ((every["k"] or 0) + SMOOTHING)

    s = F.split("shape", "/")
    segment = [F.when(F.col("shape") != "", F.get(s, F.lit(i))) for i in range(DEPTH - 1)]
    tail = F.when(F.size(s) >= DEPTH, F.array_join(F.slice(s, DEPTH, F.greatest(F.size(s) - (DEPTH - 1), F.lit(1))), "/"))
    tree = shapes.select("*", *[c.alias(f"s{i}") for i, c in enumerate([*segment, tail])], F.lit("").alias("t"))
    for i in range(DEPTH):
        child = tree.where(f"s{i} is not null").groupBy("host", "t", f"s{i}").agg(F.sum("n").alias("n"))
        wide = child.groupBy("host", "t").agg(F.count("*").alias("d"), F.sum("n").alias("m")).where(f"d >= {FAN} and d * d >= m").select("host", "t", F.lit(True).alias("wide"))
        name = F.when(F.col(f"s{i}").isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), F.when(F.col("wide"), F.lit("*")).otherwise(F.col(f"s{i}"))))
        tree = tree.join(wide, ["host", "t"], "left").withColumn("t", F.concat("t", name)).drop("wide", f"s{i}")
        tree = cut(tree, f"tree-{i}")  # it is read several times by the next level

    parts = F.split("t", "/")
    tree = tree.withColumn("branch", F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).withColumn(
        "rest", F.when(F.size(parts) > 2, F.concat(F.lit("/"), F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(1))), "/"))).otherwise(F.lit("")))
    size = tree.groupBy("host", "branch").agg(F.sum("n").alias("m"), F.sum("b").alias("b"), F.sum("k").alias("k"))
    often = (tree.groupBy("host", "branch", "rest").agg(F.sum("n").alias("n")).join(size.select("host", "branch", "m"), ["host", "branch"])
             .where(F.col("n") >= SHARE * F.col("m")).groupBy("host", "branch").agg(F.array_join(F.sort_array(F.collect_set("rest")), " ").alias("usual")))
    third = F.when(F.col("k") == 0, F.lit(-1)).otherwise(F.least(F.floor(3 * F.col("b") / F.col("k")), F.lit(2)))
    alike = size.join(often, ["host", "branch"], "left").select("host", "branch", F.coalesce("usual", F.lit("")).alias("usual"), third.alias("third"))
    merged = alike.join(alike.groupBy("host", "usual", "third").agg(F.min("branch").alias("name")), ["host", "usual", "third"]).select("host", "branch", "name")
    tree = cut(tree.join(merged, ["host", "branch"]).withColumn("template", F.concat(F.lit("/"), "name", "rest")), "templates")

    by_host = tree.groupBy("host").agg(F.sum("b").alias("hb"), F.sum("k").alias("hk"))
    ours = (tree.groupBy("host", "template").agg(F.sum("b").alias("b"), F.sum("k").alias("k")).join(by_host, "host")
            .select("host", "template", ((F.col("b") + SMOOTHING * ((F.col("hb") + SMOOTHING * overall) / (F.col("hk") + SMOOTHING))) / (F.col("k") + SMOOTHING)).alias("purity")))
    known = tree.select("host", "shape", "template").join(ours, ["host", "template"])
    verdict = F.coalesce("given", F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return read.join(known, ["host", "shape"], "left").select("page_id", "host", "path", "rule", "template", "purity", verdict.alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "template", F.round("purity", 6).alias("purity"), "verdict")


_CASES = {give: "case " + " ".join(
    f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{p}') then '{out}'"
    for r in sorted(RULES, key=lambda r: (-len(r[1]), r[1])) for h, p, out in [(*r[1].split("/", 1), r[give])]) + " end" for give in (0, 1)}
_LEVELS = "".join(f"""
c{i} as (select host, t, s[{i + 1}] as x, sum(n) as n from t{i} where s[{i + 1}] is not null group by all),
w{i} as (select host, t from c{i} group by host, t having count(*) >= {FAN} and count(*) * count(*) >= sum(n)),
t{i + 1} as (select a.host, a.shape, a.n, a.b, a.k, a.s,
  a.t || case when a.s[{i + 1}] is null then '' when w.host is not null then '/*' else '/' || a.s[{i + 1}] end as t
  from t{i} a left join w{i} w on a.host = w.host and a.t = w.t),""" for i in range(DEPTH))
ORACLE = f"""
with r as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
      regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from r),
j as (select *, {_CASES[1]} as rule, {_CASES[0]} as given,
      array_to_string(list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda x: x <> ''), '/') as shape from p),
sh as (select host, shape, count(*) as n, coalesce(sum((given = 'block')::int), 0) as b, count(given) as k from j group by all),
o as (select (sum(b) + {0.5 * SMOOTHING}) / (sum(k) + {SMOOTHING}) as overall from sh),
sp as (select *, case when shape = '' then [] else string_split(shape, '/') end as q from sh),
t0 as (select host, shape, n, b, k, case when len(q) >= {DEPTH} then q[1:{DEPTH - 1}] || [array_to_string(q[{DEPTH}:], '/')] else q end as s, '' as t from sp),
{_LEVELS}
bt as (select *, coalesce(string_split(t, '/')[2], '') as branch,
       case when len(string_split(t, '/')) > 2 then '/' || array_to_string(string_split(t, '/')[3:], '/') else '' end as tail from t{DEPTH}),
z as (select host, branch, sum(n) as m, sum(b) as b, sum(k) as k from bt group by all),
oc as (select host, branch, tail, sum(n) as n from bt group by all),
ou as (select oc.host, oc.branch, array_to_string(list_sort(list(distinct tail)), ' ') as usual from oc join z on oc.host = z.host and oc.branch = z.branch
       where oc.n >= {SHARE}::double * m group by all),
al as (select z.host, z.branch, coalesce(usual, '') as usual, case when k = 0 then -1 else least(floor(3 * b / k), 2) end as third
       from z left join ou on z.host = ou.host and z.branch = ou.branch),
nm as (select host, branch, min(branch) over (partition by host, usual, third) as name from al),
tt as (select bt.*, '/' || name || tail as template from bt join nm on bt.host = nm.host and bt.branch = nm.branch),
hh as (select host, sum(b) as hb, sum(k) as hk from tt group by host),
pu as (select t.host, template, (sum(b) + {SMOOTHING} * ((any_value(hb) + {SMOOTHING} * any_value(overall)) / (any_value(hk) + {SMOOTHING}))) / (sum(k) + {SMOOTHING}) as purity
       from tt t join hh on t.host = hh.host, o group by all)
select j.page_id, j.host, j.path, j.rule, tt.template, round(purity::double, 6) as purity,
       coalesce(given, case when purity >= {REJECT} then 'block' else 'allow' end) as verdict
from j join tt on j.host = tt.host and j.shape = tt.shape join pu on pu.host = tt.host and pu.template = tt.template
"""

QUERIES = {"op3_url_filter": (query, ORACLE)}
