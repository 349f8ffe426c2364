"""URL filter: path templates of each host, judged by the labels of the urls below them.

Level by level, a host's path segments become the branches of a tree. Segments that look like ids,
that are rare, or that are nearly as many as the urls themselves turn into a wildcard; so do
branches whose share of bad labels does not differ from that of their siblings by a two-proportion
test. A url is rejected when the smoothed share of bad labels of its template is high. Labels
come from explicit rules, which also overrule the templates. DataFrame functions only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollbook.llm.common import rename_free, written

DEPTH = 6
LEAST_URLS = 3
MOST_KIDS, URLS_PER_KID = 8, 4
SIMILAR_Z = 2.0
PRIOR_WEIGHT = 5.0
REJECT_AT = 0.7
VARIABLE = r"^[0-9]+([.][A-Za-z0-9]+)?$|[0-9][0-9]|^[0-9a-f]{8,}$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


class Rule(NamedTuple):
    """``host`` with all its subdomains, and the beginning of the path. At most some hundreds;
    they become part of the expression."""

    verdict: str
    host: str
    path: str


def parse(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.regexp_extract(url, URL, 2)


def best_rule(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), r.host + r.path)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.host + rule.path)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _level(paths: DataFrame, depth: int, last: bool) -> DataFrame:
    """Adds the branch of one level to ``prefix``."""
    raw = F.get("segments", F.lit(depth - 1))
    if last:
        raw = F.when(F.size("segments") > depth, F.array_join(F.slice("segments", depth, F.size("segments")), "/")).otherwise(raw)
    named = paths.withColumn("segment", F.when(raw.rlike(VARIABLE), F.lit("*")).otherwise(raw))
    sums = [F.sum(c).alias(c) for c in ("urls", "labelled", "bad")]
    kids = named.where("segment is not null").groupBy("host", "prefix", "segment").agg(*sums)
    parents = kids.groupBy("host", "prefix").agg(
        F.count(F.when(F.col("segment") != "*", 1)).alias("kids"), *(F.sum(c).alias(f"all_{c}") for c in ("urls", "labelled", "bad"))
    )
    rest = F.col("all_labelled") - F.col("labelled")
    rest_bad = F.col("all_bad") - F.col("bad")
    pooled = F.col("all_bad") / F.col("all_labelled")
    apart = F.abs(F.col("bad") / F.nullif(F.col("labelled"), F.lit(0)) - rest_bad / F.nullif(rest, F.lit(0)))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / rest))
    tested = (F.col("labelled") > 0) & (rest > 0)
    wild = (
        (F.col("segment") == "*")
        | (F.col("urls") < LEAST_URLS)
        | ((F.col("kids") > MOST_KIDS) & (F.col("all_urls") < URLS_PER_KID * F.col("kids")))
        | F.when(tested, apart <= SIMILAR_Z * error).otherwise(False)
    )
    branches = kids.join(parents, ["host", "prefix"]).select(
        "host", "prefix", "segment", F.when(wild, F.lit("*")).otherwise(F.col("segment")).alias("branch")
    )
    return (
        named.join(branches, ["host", "prefix", "segment"], "left")
        .withColumn("prefix", F.concat("prefix", F.when(F.col("segment").isNotNull(), F.concat(F.lit("/"), "branch")).otherwise(F.lit(""))))
        .drop("segment", "branch")
    )


def templates(labelled: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``host, path, template, purity`` of every distinct host and path of ``labelled``
    (``host, path, bad``; bad is 1, 0 or null where there is no label).

    ``purity`` is the share of bad labels in the template, smoothed towards the host's, and that
    towards the overall one. Segments beyond ``depth`` count as one.
    """
    paths = labelled.groupBy("host", "path").agg(
        F.count("*").alias("urls"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad")
    )
    paths = paths.withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn("prefix", F.lit(""))
    paths = written(paths, "url-paths")
    deepest = min(depth, paths.agg(F.max(F.size("segments"))).first()[0] or 0)
    for level in range(1, deepest + 1):
        paths = written(_level(paths, level, level == depth), "url-levels")
    sums = [F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")]

    def smooth(prior: Column) -> Column:
        return (F.col("bad") + PRIOR_WEIGHT * prior) / (F.col("labelled") + PRIOR_WEIGHT)

    overall = paths.agg(*sums).select(F.coalesce(F.col("bad") / F.nullif(F.col("labelled"), F.lit(0)), F.lit(0.0)).alias("overall"))
    own = paths.groupBy("host", "prefix").agg(*sums)
    hosts = own.groupBy("host").agg(*sums).crossJoin(F.broadcast(overall)).select("host", smooth(F.col("overall")).alias("host_share"))
    judged = own.join(hosts, "host").select("host", "prefix", smooth(F.col("host_share")).alias("purity"))
    return paths.join(judged, ["host", "prefix"]).select("host", "path", F.concat("host", "prefix").alias("template"), "purity")


def judge(pages: DataFrame, rules: tuple[Rule, ...], depth: int = DEPTH, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity``, one row per input row.

    The longest fitting rule decides; elsewhere urls whose template is at least ``REJECT_AT`` bad
    are blocked. Null urls and those without ``://`` have an empty host and path and a template
    of their own. Without rules everything is allowed.
    """
    host, path = parse(F.col("url"))
    rows = rename_free(pages, {"page_id": page_id, "url": url}).select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = best_rule(rules, F.col("host"), F.col("path"))
    rows = rows.withColumn("rule", name).withColumn("by_rule", verdict)
    label = F.when(F.col("by_rule") == "block", 1).when(F.col("by_rule") == "allow", 0)
    found = templates(rows.select("host", "path", label.alias("bad")), depth)
    by_template = F.when(F.col("purity") >= REJECT_AT, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(found, ["host", "path"]).select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", by_template).alias("verdict"), "template", "purity"
    )


def oracle_sql(rules: tuple[Rule, ...], depth: int = DEPTH) -> str:
    """``judge`` over ``pages`` as DuckDB SQL."""
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), r.host + r.path))
    fits = [
        f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')" for r in ordered
    ]
    rule = "case " + " ".join(f"when {f} then '{r.host}{r.path}'" for f, r in zip(fits, ordered, strict=True)) + " end"
    verdict = "case " + " ".join(f"when {f} then '{r.verdict}'" for f, r in zip(fits, ordered, strict=True)) + " end"
    levels = ""
    for d in range(1, depth + 1):
        segment = f"segments[{d}]"
        if d == depth:
            segment = f"case when len(segments) > {d} then array_to_string(segments[{d}:], '/') else segments[{d}] end"
        levels += f"""
named{d} as (
  select *, case when regexp_matches(raw, '{VARIABLE}') then '*' else raw end as segment
  from (select *, {segment} as raw from level{d - 1})
),
kids{d} as (
  select host, prefix, segment, sum(urls) as urls, sum(labelled) as labelled, sum(bad) as bad
  from named{d} where segment is not null group by all
),
parents{d} as (
  select host, prefix, count(*) filter (where segment <> '*') as kids, sum(urls) as all_urls,
    sum(labelled) as all_labelled, sum(bad) as all_bad
  from kids{d} group by all
),
branches{d} as (
  select host, prefix, segment, case
    when segment = '*' or urls < {LEAST_URLS} or (kids > {MOST_KIDS} and all_urls < {URLS_PER_KID} * kids)
      or case when labelled > 0 and all_labelled > labelled then
        abs(bad / labelled - (all_bad - bad) / (all_labelled - labelled)) <= {SIMILAR_Z} * sqrt(
          (all_bad / all_labelled) * (1 - all_bad / all_labelled) * (1 / labelled + 1 / (all_labelled - labelled)))
        else false end
    then '*' else segment end as branch
  from kids{d} join parents{d} using (host, prefix)
),
level{d} as (
  select n.host, n.path, n.urls, n.labelled, n.bad, n.segments,
    n.prefix || case when n.segment is null then '' else '/' || b.branch end as prefix
  from named{d} n left join branches{d} b on n.host = b.host and n.prefix = b.prefix and n.segment = b.segment
),"""
    return f"""
with parsed as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{UPPER}', '{LOWER}') as host,
    regexp_extract(coalesce(url, ''), '{URL}', 2) as path
  from pages
),
ruled as (select *, {rule} as rule, {verdict} as by_rule from parsed),
level0 as (
  select host, path, count(*) as urls, count(by_rule) as labelled, count(*) filter (where by_rule = 'block') as bad,
    list_filter(string_split(path, '/'), lambda s: s <> '') as segments, '' as prefix
  from ruled group by host, path
),{levels}
own as (select host, prefix, sum(labelled) as labelled, sum(bad) as bad from level{depth} group by all),
overall as (select coalesce(sum(bad) / nullif(sum(labelled), 0), 0) as overall from own),
hosts as (
  select host, (sum(bad) + {PRIOR_WEIGHT} * any_value(overall)) / (sum(labelled) + {PRIOR_WEIGHT}) as host_share
  from own, overall group by host
),
judged as (
  select host, prefix, (bad + {PRIOR_WEIGHT} * host_share) / (labelled + {PRIOR_WEIGHT}) as purity from own join hosts using (host)
)
select page_id, r.host, r.path, rule,
  coalesce(by_rule, case when purity >= {REJECT_AT} then 'block' else 'allow' end) as verdict,
  r.host || l.prefix as template, purity
from ruled r join level{depth} l on r.host = l.host and r.path = l.path
join judged j on l.host = j.host and l.prefix = j.prefix
"""
