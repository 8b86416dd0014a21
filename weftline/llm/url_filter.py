"""URL rules whose block decisions reach the aliases of a page.

Pages that redirect to one another, or name one canonical address, are one equivalence class: a
connected component over redirect and canonical-link edges. A page no rule fits takes the decision of
its class: blocked if a member is, unless a member is explicitly allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import spread_join, written
from weftline.llm.components import components

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """From after the first :// up to / ? # or the end, A-Z lowered; empty without ://."""
    return _lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def match(h: Column, p: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. Equally long ones: the first given."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((h == rule_host) | h.endswith("." + rule_host)) & p.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def key(url: Column) -> Column:
    """A url's identity: host, path and query; scheme and fragment don't count."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.concat(host(url), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def _absolute(base: Column, target: Column) -> Column:
    t = F.trim(F.regexp_replace(target, "&amp;", "&"))
    scheme, site = F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(t.contains("://"), t).when(t.startswith("//"), F.concat(scheme, F.lit(":"), t)).when(t.startswith("/"), F.concat(site, t)).when(t != "", F.concat(folder, t))
    )


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target) urls: every <link rel=canonical href> and <meta http-equiv=refresh content="..url=..">."""
    page = F.col(html)
    links = F.regexp_extract_all(page, F.lit(r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)"), 1)
    metas = F.regexp_extract_all(page, F.lit(r"(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)"), 1)
    href = F.transform(links, lambda x: F.regexp_extract(x, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    to = F.transform(metas, lambda x: F.regexp_extract(x, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    told = pages.where(F.col(url).contains("://") & page.rlike("(?i)canonical|http-equiv"))
    found = told.select(F.col(url).alias("source"), F.explode(F.transform(F.concat(href, to), lambda x: _absolute(F.col(url), x))).alias("target"))
    return found.where("target is not null")


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    redirects: DataFrame | None = None,
    default: str = "allow",
    page_id: str = "page_id",
    url: str = "url",
    html: str | None = "html",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, component) for each row of `pages`.

    `redirects` (source, target) adds redirects known from fetching. `component` is the least url key of
    the page's class (null for a page that is linked with none). A null url, or one without ://, has
    empty host and path, fits no rule and gets `default`; null html has no links, very long html is searched whole; repeated rows each
    give a row; an empty table gives none. Other columns are ignored.
    """
    links = [link_edges(pages, url, html)] if html else []
    if redirects is not None:
        links.append(redirects.select("source", "target").where(F.col("source").contains("://") & F.col("target").contains("://")))
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    base = base.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    base = base.withColumn("own", match(F.col("host"), F.col("path"), rules))
    base = base.select("page_id", F.when(F.col("url").contains("://"), key(F.col("url"))).alias("key"), "host", "path", F.col("own.rule").alias("rule"), F.col("own.verdict").alias("own"))
    none = base.withColumn("component", F.lit(None).cast("string")).withColumn("class_verdict", F.lit(None).cast("string"))
    if links:
        edges = written(links[0].union(links[1]) if len(links) > 1 else links[0], "links")
        if not edges.isEmpty():
            ends = edges.select(F.col("source").alias("url")).union(edges.select("target"))
            nodes = ends.select(key(F.col("url")).alias("node"), match(host(F.col("url")), path(F.col("url")), rules)["verdict"].alias("verdict"))
            classes = written(components(edges.select(key(F.col("source")).alias("a"), key(F.col("target")).alias("b"))), "classes")
            ruled = nodes.join(classes, "node").groupBy("component").agg(F.bool_or(F.col("verdict") == "allow").alias("allowed"), F.bool_or(F.col("verdict") == "block").alias("blocked"))
            said = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("class_verdict")
            known = classes.join(ruled, "component").select(F.col("node").alias("key"), "component", said)
            none = spread_join(base, written(known, "known"), "key", "left")  # very many pages may share one url
    return none.select("page_id", "host", "path", "rule", F.coalesce("own", "class_verdict", F.lit(default)).alias("verdict"), "component")


_HOST = "translate(coalesce(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_REST = "regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
_KEY = f"{_HOST} || CASE WHEN starts_with({_REST}, '/') THEN '' ELSE '/' END || {_REST}"
_BEST = "(SELECT max_by({what}, length(h || p)) FROM rules WHERE ({host} = h OR ends_with({host}, '.' || h)) AND starts_with({path}, p))"
_QUOTE = "[\"'']?"

ORACLE = rf"""
WITH RECURSIVE rules(verdict, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), parts AS (
  SELECT page_id, url, {_HOST.format(u="url")} AS host, {_PATH.format(u="url")} AS path, CASE WHEN contains(url, '://') THEN {_KEY.format(u="url")} END AS key FROM pages
), own AS (
  SELECT *, {_BEST.format(what="h || p", host="host", path="path")} AS rule, {_BEST.format(what="verdict", host="host", path="path")} AS said FROM parts
), told AS (
  SELECT url, unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*{_QUOTE}canonical\b[^>]*>'), lambda x: regexp_extract(x, '(?is)\bhref\s*=\s*{_QUOTE}([^"''\s>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*{_QUOTE}refresh\b[^>]*>'), lambda x: regexp_extract(x, '(?is)\burl\s*=\s*{_QUOTE}([^"''\s>]+)', 1))
  )) AS t FROM pages WHERE contains(url, '://')
), clean AS (
  SELECT url, trim(replace(t, '&amp;', '&')) AS t, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS site, regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)', 1) AS folder FROM told
), links AS (
  SELECT url AS source, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || t
    WHEN starts_with(t, '/') THEN site || t ELSE folder || CASE WHEN ends_with(folder, '/') THEN '' ELSE '/' END || t END AS target FROM clean WHERE t <> ''
), ends AS (SELECT source AS u FROM links UNION SELECT target FROM links
), nodes AS (
  SELECT key, bool_or(said = 'allow') AS allowed, bool_or(said = 'block') AS blocked
  FROM (SELECT {_KEY.format(u="u")} AS key, {_BEST.format(what="verdict", host=_HOST.format(u="u"), path=_PATH.format(u="u"))} AS said FROM ends) GROUP BY key
), edges AS (SELECT {_KEY.format(u="source")} AS a, {_KEY.format(u="target")} AS b FROM links
), twoway AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b
), reach(n, r) AS (SELECT a, a FROM twoway UNION SELECT reach.n, twoway.b FROM reach JOIN twoway ON twoway.a = reach.r
), comps AS (SELECT n, min(r) AS component FROM reach GROUP BY n
), classes AS (SELECT component, bool_or(coalesce(allowed, false)) AS allowed, bool_or(coalesce(blocked, false)) AS blocked FROM comps JOIN nodes ON nodes.key = n GROUP BY component
)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' END, 'allow') AS verdict, component
FROM own LEFT JOIN comps ON comps.n = own.key LEFT JOIN classes USING (component)
"""
