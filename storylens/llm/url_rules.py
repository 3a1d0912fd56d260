"""URL filters: block and allow rules, and their decisions carried over redirects and canonical links.

A rule names a host and the begin of a path.  It fits its host and all subdomains of it, if the path of the URL starts
with the rule's; of several the longest wins, and of equally long ones an allow rule.  URLs without a rule take the
decision of their equivalents: URLs that a redirect (a table of them, or ``<meta http-equiv="refresh">``) or a
canonical link (``<link rel="canonical">``) connects are one component, found by distributed connected components.  A
component with an allow rule on any member allows, otherwise one with a block rule blocks; all other URLs are allowed.

URLs are the same address if host (A-Z in lower case), path (``/`` if empty, dot segments resolved) and query agree;
scheme and fragment don't matter for that.  Links are resolved against the URL of their page; ``<base>`` is not read.
Only DataFrame functions run, no Python code.

A null URL or one without ``://`` has an empty host and path, no rule and no aliases, and is allowed.  Null html has no
links.  Repeated rows and null ids stay rows; an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.joins import lookup_join
from .common import spread, store

#: (verdict, host, begin of the path); fixed values.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

TAG = r"(?i)<(?:link|meta)\b[^>]*(?:canonical|refresh)[^>]*>"
CANONICAL = r"(?i)^<link\b.*\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"
REFRESH = r"(?i)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"
HREF = r"(?i)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
TARGET = r"(?i)\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*['\"]?([^\"'>]*)"
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    found = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.coalesce(F.translate(found, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _without_dots(of: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    parts = F.split(F.substring(of, 2, F.length(of)), "/")
    up = lambda kept: F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
    empty = F.array().cast("array<string>")
    step = lambda kept, x: F.when(x == ".", kept).when(x == "..", up(kept)).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate(parts, empty, step)
    closed = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    plain = F.concat(F.lit("/"), F.array_join(kept, "/"), closed)
    return F.when(of.contains("/."), plain).when(of == "", F.lit("/")).otherwise(of)


def address(url: Column) -> Column:
    """What equal addresses share: host, path and query."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(_rest(url).isNotNull(), F.concat(host(url), _without_dots(path(url)), query))


def rule(host_of: Column, path_of: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The rule (``text, verdict``) that decides, or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[0]))
    fitting = [
        F.when(
            ((host_of == named) | host_of.endswith(f".{named}")) & path_of.startswith(begin),
            F.struct(F.lit(named + begin).alias("text"), F.lit(verdict).alias("verdict")),
        )
        for verdict, named, begin in ordered
    ]
    none = F.lit(None).cast("struct<text:string,verdict:string>")
    return F.coalesce(*fitting, none)


def resolved(base: Column, link: Column) -> Column:
    """A link as a URL, seen from a page; null if it leads to no other address."""
    link = F.regexp_replace(F.trim(link), "&(?:amp|#38);", "&")
    scheme = F.regexp_extract(base, "^([^:/?#]*:)//", 1)
    site = F.regexp_extract(base, "^([^:/?#]*://[^/?#]*)", 1)
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when((link == "") | link.startswith("#") | link.rlike(SCHEME), F.lit(None).cast("string"))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(site, path(base), link))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """``from_url, to_url`` of redirects and canonical links in the html of pages."""
    tags = spread(pages.select("url", "html")).filter(F.instr("url", "://") > 0).select(
        "url", F.explode(F.regexp_extract_all("html", F.lit(TAG), 0)).alias("tag")
    )
    tag = F.col("tag")
    href = F.concat(*(F.regexp_extract(tag, HREF, k) for k in (1, 2, 3)))
    link = F.when(tag.rlike(CANONICAL), href).when(tag.rlike(REFRESH), F.regexp_extract(tag, TARGET, 1))
    return tags.select(F.col("url").alias("from_url"), resolved(F.col("url"), link).alias("to_url")).dropna()


def _node(url: Column) -> Column:
    return F.md5(address(url).cast("binary"))


def equivalent(links: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``node, component, verdict`` of every address with a link; the verdict is that of its component, or null."""
    linked = store(
        links.filter(F.instr("from_url", "://") > 0).filter(F.instr("to_url", "://") > 0).select(
            _node(F.col("from_url")).alias("a"), _node(F.col("to_url")).alias("b"),
            rule(host(F.col("from_url")), _without_dots(path(F.col("from_url"))), rules)["verdict"].alias("of_a"),
            rule(host(F.col("to_url")), _without_dots(path(F.col("to_url"))), rules)["verdict"].alias("of_b"),
        ).distinct(),
        "url-links",
    )
    members = connected_components(linked.select("a", "b")).withColumnRenamed("id", "node")
    ends = linked.select(F.col("a").alias("node"), F.col("of_a").alias("own")).unionByName(
        linked.select(F.col("b").alias("node"), F.col("of_b").alias("own"))
    ).distinct()
    decided = (
        ends.join(members, "node").groupBy("component")
        .agg(F.bool_or(F.col("own") == "allow").alias("allow"), F.bool_or(F.col("own") == "block").alias("block"))
    )
    verdict = F.when(F.col("allow"), F.lit("allow")).when(F.col("block"), F.lit("block"))
    return lookup_join(members, decided.select("component", verdict.alias("verdict")), "component").select(
        "node", "component", "verdict"
    )


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """``pages`` without html, with ``host, path, rule, verdict`` and ``decided_by`` (rule, alias or default).

    ``redirects`` may add links (``from_url, to_url``) to those in the pages.
    """
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("from_url", "to_url"))
    blocked = store(equivalent(links, rules).filter("verdict = 'block'").select(F.col("node").alias("_node")), "url-aliases")
    added = ("host", "path", "rule", "verdict", "decided_by", "_node", "html")
    url = F.col("url")
    out = pages.select(*(c for c in pages.columns if c not in added)).withColumn("host", host(url)).withColumn("path", path(url))
    found = rule(F.col("host"), F.col("path"), rules)
    # A page with a rule of its own needs no alias.
    out = out.withColumn("_rule", found).withColumn("_node", F.when(F.col("_rule").isNull(), _node(url)))
    out = lookup_join(out, blocked.withColumn("_alias", F.lit(True)), "_node", "left", rows=blocked.count())
    verdict = F.coalesce("_rule.verdict", F.when(F.col("_alias"), F.lit("block")), F.lit("allow"))
    by = F.when(F.col("_rule").isNotNull(), "rule").when(F.col("_alias"), "alias").otherwise("default")
    return (
        out.withColumn("rule", F.col("_rule.text")).withColumn("verdict", verdict).withColumn("decided_by", by)
        .drop("_rule", "_node", "_alias")
    )


def op12(pages: DataFrame) -> DataFrame:
    out = judge(pages.select("page_id", "url", "html"), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", "decided_by")


#: Rules, and aliases over absolute links and links that begin with a slash.
OP12_SQL = r"""
with recursive page as (
  select page_id, url, html, case when contains(url, '://') then substr(url, position('://' in url) + 3) end as rest
  from pages
), located as (
  select page_id, url, html, rest, coalesce(regexp_extract(rest, '^[^/?#]*'), '') as raw_host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from page
), named as (
  select *, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host from located
), tag as (
  select url, raw_host, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*(?:canonical|refresh)[^>]*>')) as tag
  from named where rest is not null
), link as (
  select url, raw_host, replace(trim(case
    when regexp_matches(tag, '(?i)^<link\b.*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b')
      then regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]*)', 1)
    when regexp_matches(tag, '(?i)^<meta\b.*\bhttp-equiv\s*=\s*["'']?\s*refresh\b')
      then regexp_extract(tag, '(?i)\bcontent\s*=\s*["'']?[^"''>]*?\burl\s*=\s*["'']?([^"''>]*)', 1) end), '&amp;', '&') as target
  from tag
), pair as (
  select url as a, case when contains(target, '://') then target
    when starts_with(target, '//') then 'x:' || target
    when starts_with(target, '/') then 'x://' || raw_host || target end as b
  from link
), ends as (
  select a, b from pair where b is not null union select b, a from pair where b is not null
), keyed as (
  select list_transform([a, b], lambda u: struct_pack(
    host := translate(regexp_extract(substr(u, position('://' in u) + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    path := case when regexp_extract(substr(u, position('://' in u) + 3), '^[^/?#]*([^?#]*)', 1) = '' then '/'
      else regexp_extract(substr(u, position('://' in u) + 3), '^[^/?#]*([^?#]*)', 1) end,
    query := regexp_extract(substr(u, position('://' in u) + 3), '^[^?#]*(\?[^#]*)', 1))) as k
  from ends
), edge as (
  select distinct k[1].host || k[1].path || k[1].query as a, k[2].host || k[2].path || k[2].query as b from keyed
), reach as (
  select a, b from edge union select r.a, e.b from reach r join edge e on r.b = e.a
), rules(verdict, rule_host, rule_path) as (
  values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), node as (
  select distinct k[1].host || k[1].path || k[1].query as a, k[1].host as host, k[1].path as path from keyed
), node_rule as (
  select n.a, arg_max(r.verdict, length(r.rule_host || r.rule_path)) as verdict
  from node n join rules r on (n.host = r.rule_host or ends_with(n.host, '.' || r.rule_host)) and starts_with(n.path, r.rule_path)
  group by n.a
), aliased as (
  select r.a from reach r join node_rule n on n.a = r.b
  group by r.a having count(*) filter (n.verdict = 'block') > 0 and count(*) filter (n.verdict = 'allow') = 0
), ruled as (
  select n.page_id, n.url, n.host, n.path, n.rest,
    (select arg_max(struct_pack(t := r.rule_host || r.rule_path, v := r.verdict), length(r.rule_host || r.rule_path)) from rules r
      where (n.host = r.rule_host or ends_with(n.host, '.' || r.rule_host)) and starts_with(n.path, r.rule_path)) as r
  from named n
)
select x.page_id, x.host, x.path, x.r.t as rule,
  coalesce(x.r.v, case when a.a is not null then 'block' else 'allow' end) as verdict,
  case when x.r is not null then 'rule' when a.a is not null then 'alias' else 'default' end as decided_by
from ruled x left join aliased a
  on a.a = x.host || case when x.path = '' then '/' else x.path end || regexp_extract(x.rest, '^[^?#]*(\?[^#]*)', 1)
"""
