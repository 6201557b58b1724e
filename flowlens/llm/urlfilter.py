"""URL allow and block rules whose decisions spread over redirect and canonical-link edges; built-in functions only.

A rule names a host and the beginning of a path; it fits that host and its subdomains.  Of the rules that fit a URL the
longest decides (host and path together; of equal length the one with the longer host, then allow before block).

Pages point to other URLs by ``<link rel="canonical" href=...>`` and ``<meta http-equiv="refresh" content="..url=...">``;
a table of redirects may add more edges.  The URLs are nodes by their *alias key*: host and path with the query, without
scheme, fragment and the tracking parameters ``utm_*``.  Connected components over the edges (star rounds, see
``common.components``) are the groups of URLs that lead to one another; nodes without an edge take no part.  A page that
no rule decides follows its group: allowed where some URL of the group is allowed by a rule, else blocked where some URL
of it is blocked by a rule, else allowed.  So an explicit allow goes before every block, and a page's own rule before
its group.

The rules' list is part of the query plan up to ``PLAN_RULES`` rules, and a table joined by host beyond.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule, takes part in no edge and is
allowed; null html has no links; a link may be absolute, start with // or /, or be relative to the page's folder; links
with other schemes than http and https (mailto:, data:) are not followed; repeated rows and rows that repeat a page_id
are rows of their own; an empty table gives an empty result; only page_id, url and html are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import components, stored

#: Rules that are written into the plan as a map by host; a longer list is joined.
PLAN_RULES = 2000
_RULE = "struct<length:int,host_length:int,allow:int,rule:string>"


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str


#: The rules of the registered query (fixed values).
RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
         Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]

_A_Z, _a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = r"(?is)<link\b[^>]*>"
_REFRESH = r"(?is)<meta\b[^>]*>"
_IS_CANONICAL = r"(?is)\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"
_IS_REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"
_HREF = r"(?is)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
_URL = r"(?is)\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"
_TRACKING = r"(^|&)utm_[^&]*"


def _lower(c: Column) -> Column:
    return F.translate(c, _A_Z, _a_z)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """Host, path and query without ``utm_*`` parameters; null where there is no host."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    rest = F.regexp_replace(F.regexp_replace(query, _TRACKING, ""), "^&", "")
    key = F.concat(host(url), path(url), F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(""))
    return F.when(host(url) != "", key)


def resolved(link: Column, url: Column) -> Column:
    """A link of the page ``url`` as an absolute URL; null where its scheme is not http or https."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    top = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(path(url), r"(?s)^(.*/)", 1)
    return (F.when(link.rlike(r"(?i)^https?://"), link)
            .when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string"))
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("/"), F.concat(top, link))
            .when(link.rlike("^[?#]"), F.concat(top, path(url), link))
            .otherwise(F.concat(top, F.when(folder == "", F.lit("/")).otherwise(folder), link)))


def links(html: Column, url: Column) -> Column:
    """Absolute URLs of a page's canonical links and refresh targets (array, possibly empty)."""
    def of(tag: str, wanted: str, target: str) -> Column:
        tags = F.filter(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: t.rlike(wanted))
        return F.transform(tags, lambda t: resolved(F.replace(F.regexp_extract(t, target, 1), F.lit("&amp;"), F.lit("&")),
                                                    url))
    both = F.concat(of(_CANONICAL, _IS_CANONICAL, _HREF), of(_REFRESH, _IS_REFRESH, _URL))
    # most pages have neither: a plain search for the two words decides whether the tags are looked at
    return F.when(html.rlike("(?i)canonical|http-equiv"), both).otherwise(F.array().cast("array<string>"))


def _suffixes(host_col: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(host_col, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + F.lit(1)), "."))


def _entry(r: Rule) -> Column:
    return F.struct(F.lit(len(r.host) + len(r.path)).alias("length"), F.lit(len(r.host)).alias("host_length"),
                    F.lit(int(r.verdict == "allow")).alias("allow"), F.lit(r.host + r.path).alias("rule"),
                    F.lit(r.path).alias("path"))


def judged(urls: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``urls`` (with columns host and path) and ``_rule``: the deciding rule as a struct, or null."""
    rules = [Rule(r.verdict, r.host.lower(), r.path) for r in rules]
    if not rules:
        return urls.withColumn("_rule", F.lit(None).cast(_RULE))
    if len(rules) <= PLAN_RULES:
        by_host: dict[str, list[Rule]] = {}
        for r in rules:
            by_host.setdefault(r.host, []).append(r)
        known = F.create_map(*[x for h, rs in by_host.items() for x in (F.lit(h), F.array(*map(_entry, rs)))])
        hosts = F.filter(_suffixes(F.col("host")), lambda h: F.array_contains(F.array(*map(F.lit, by_host)), h))
        fitting = F.filter(F.flatten(F.transform(hosts, lambda h: F.try_element_at(known, h))),
                           lambda e: F.startswith(F.col("path"), e["path"]))
        best = F.array_max(F.transform(fitting, lambda e: F.struct(e["length"].alias("length"), e["host_length"].alias(
            "host_length"), e["allow"].alias("allow"), e["rule"].alias("rule"))))
        return urls.withColumn("_rule", F.when(F.col("host") != "", best))
    table = urls.sparkSession.createDataFrame([(r.host, r.path, int(r.verdict == "allow")) for r in rules],
                                              "r_host string, r_path string, allow int")
    places = urls.select("host", "path").distinct()
    best = (places.select("host", "path", F.explode(_suffixes(F.col("host"))).alias("r_host")).where("host <> ''")
            .join(table, "r_host").where(F.startswith(F.col("path"), F.col("r_path"))).groupBy("host", "path")
            .agg(F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("length"), F.length("r_host").alias(
                "host_length"), "allow", F.concat("r_host", "r_path").alias("rule"))).alias("_rule")))
    return urls.join(best, ["host", "path"], "left")


def _node(key: Column) -> Column:
    return F.unhex(F.md5(key))


def aliases(pages: DataFrame, redirects: DataFrame | None = None, url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """Edges (a_key, b_key) between different alias keys: pages and their canonical and refresh targets, and the rows of
    ``redirects`` (from_url, to_url)."""
    parts = []
    if html_col is not None:
        found = pages.select(F.col(url_col).cast("string").alias("u"), F.col(html_col).cast("string").alias("h"))
        parts.append(found.select("u", F.explode(links(F.col("h"), F.col("u"))).alias("to")))
    if redirects is not None:
        parts.append(redirects.select(F.col("from_url").cast("string").alias("u"), F.col("to_url").cast("string").alias("to")))
    if not parts:
        return pages.sparkSession.createDataFrame([], "a_key string, b_key string")
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return (every.select(alias_key(F.col("u")).alias("a_key"), alias_key(F.col("to")).alias("b_key"))
            .where("a_key <> b_key").distinct())


def group_verdicts(edges: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """node (MD5 of an alias key) and verdict of every URL with an edge: allow, block, or null where no rule decides
    any URL of its group."""
    edges = stored(edges.select("a_key", "b_key"), "aliases")
    comp = components(edges.select(_node(F.col("a_key")).alias("a"), _node(F.col("b_key")).alias("b")), kind="binary")
    keys = edges.select(F.col("a_key").alias("key")).unionByName(edges.select(F.col("b_key").alias("key"))).distinct()
    url = F.concat(F.lit("http://"), F.col("key"))
    nodes = judged(keys.select(_node(F.col("key")).alias("node"), host(url).alias("host"), path(url).alias("path")), rules)
    comp = stored(nodes.select("node", F.col("_rule.allow").alias("allow")).join(comp, "node"), "groups")
    # one row for each group; groups of any size are pre-aggregated before the exchange
    group = comp.groupBy("component").agg(F.max("allow").alias("allowed"))
    return comp.join(group, "component").select(
        "node", F.when(F.col("allowed") == 1, "allow").when(F.col("allowed") == 0, "block").alias("group_verdict"))


def verdicts(pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id",
             url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """page_id, host, path, rule (host and path of the deciding rule, or null), verdict, and by_alias: whether the
    verdict comes from the page's group."""
    url = F.col(url_col).cast("string")
    rows = judged(pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("u"), host(url).alias("host"),
                               path(url).alias("path")), rules)
    own = F.when(F.col("_rule.allow") == 1, "allow").when(F.col("_rule.allow") == 0, "block")
    rows = rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), own.alias("own"),
                       F.when(F.col("_rule").isNull(), _node(alias_key(F.col("u")))).alias("node"))
    group = group_verdicts(aliases(pages, redirects, url_col, html_col), rules)
    return rows.join(group, "node", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("own", "group_verdict", F.lit("allow")).alias("verdict"),
        (F.col("own").isNull() & F.col("group_verdict").isNotNull()).alias("by_alias"))


def oracle_sql(rules: Sequence[Rule] = RULES, table: str = "pages") -> str:
    """DuckDB SQL of ``verdicts(pages, rules)``, from the definition (reachability by recursion)."""
    listed = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in rules)
    lower = f"translate({{}}, '{_A_Z}', '{_a_z}')"

    def host_of(u: str) -> str:
        return lower.format(f"regexp_extract({u}, '^.*?://([^/?#]*)', 1, 's')")

    def path_of(u: str) -> str:
        return f"regexp_extract({u}, '^.*?://[^/?#]*([^?#]*)', 1, 's')"

    def key_of(u: str) -> str:
        query = f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1, 's')"
        rest = f"regexp_replace(regexp_replace({query}, '{_TRACKING}', '', 'g'), '^&', '')"
        return (f"case when {host_of(u)} <> '' then {host_of(u)} || {path_of(u)} || case when {rest} <> '' then '?' || "
                f"{rest} else '' end end")

    def found(tag: str, wanted: str, target: str) -> str:
        quoted = [x.replace("'", "''") for x in (tag, wanted, target)]
        return (f"select u, replace(regexp_extract(t, '{quoted[2]}', 1), '&amp;', '&') as l from (select u, unnest("
                f"regexp_extract_all(html, '{quoted[0]}')) as t from p) where regexp_matches(t, '{quoted[1]}')")

    return f"""
with recursive p as (select page_id, url as u, html, coalesce({host_of('url')}, '') as host,
                            coalesce({path_of('url')}, '') as path from {table}),
rules as (select * from (values {listed}) r(verdict, r_host, r_path)),
raw as ({found(_CANONICAL, _IS_CANONICAL, _HREF)} union all {found(_REFRESH, _IS_REFRESH, _URL)}),
parts as (select u, l, regexp_extract(u, '^(.*?)://', 1, 's') as scheme, {path_of('u')} as pth,
                 regexp_extract(u, '^(.*?://[^/?#]*)', 1, 's') as top from raw),
targets as (select u, case when regexp_matches(l, '^https?://', 'i') then l
                           when regexp_matches(l, '^[a-z][a-z0-9+.-]*:', 'i') then null
                           when starts_with(l, '//') then scheme || ':' || l
                           when starts_with(l, '/') then top || l
                           when regexp_matches(l, '^[?#]') then top || pth || l
                           else top || case when regexp_extract(pth, '^(.*/)', 1, 's') = '' then '/'
                                            else regexp_extract(pth, '^(.*/)', 1, 's') end || l end as v from parts),
edges as (select distinct a, b from (select {key_of('u')} as a, {key_of('v')} as b from targets) where a <> b),
both_ways as (select a, b from edges union select b, a from edges),
reach as (select a as n, a as m from both_ways union select r.n, e.b from reach r join both_ways e on e.a = r.m),
known as (select distinct n, m from reach),
fits as (select k.m, r.verdict, row_number() over (partition by k.m order by length(r_host || r_path) desc,
                length(r_host) desc, r.verdict) as nr
         from (select distinct m from known) k, rules r
         where ({host_of("'http://' || k.m")} = r_host or ends_with({host_of("'http://' || k.m")}, '.' || r_host))
           and starts_with({path_of("'http://' || k.m")}, r_path)),
groups as (select n, case when bool_or(f.verdict = 'allow') then 'allow' when bool_or(f.verdict = 'block') then 'block' end
                  as g from known k left join fits f on f.m = k.m and f.nr = 1 group by n),
places as (select distinct host, path from p),
own as (select host, path, r_host || r_path as rule, verdict,
               row_number() over (partition by host, path order by length(r_host || r_path) desc, length(r_host) desc,
                                  verdict) as nr
        from places, rules where host <> '' and (host = r_host or ends_with(host, '.' || r_host))
          and starts_with(path, r_path))
select cast(p.page_id as bigint) as page_id, p.host, p.path, o.rule,
       coalesce(o.verdict, g.g, 'allow') as verdict, (o.verdict is null and g.g is not null) as by_alias
from p left join own o on o.host = p.host and o.path = p.path and o.nr = 1
       left join groups g on o.rule is null and g.n = {key_of('p.u')}"""


__all__ = ["verdicts", "judged", "aliases", "group_verdicts", "alias_key", "host", "path", "links", "Rule", "RULES",
           "oracle_sql"]
