"""URL filtering with redirect equivalence.

Rules decide the pages they fit. Redirects (meta refresh) and canonical links
join urls that name one resource; the connected components of that graph carry
a block to every alias that no rule decides, unless a member of the component
is explicitly allowed. Rules judge every url of the graph, whether it is a page
of the table or only the target of a link.

A url's node is its scheme and host in lower case, path ("/" if empty) and
query, without fragment; only edges join nodes. Links are resolved against the
url of their page: with or without scheme, host or leading slash, a query alone,
dot segments, and ``&amp;`` decoded. Links of other schemes (``mailto:x``) are
no edges.

Defined results: a null url or one without ``://`` has empty host and path,
fits no rule, has no aliases and is allowed; of fitting rules the longest wins,
of equally long ones an allow, then the first by code point; null html has no
links; very long html is read whole; repeated pages each get their row; links to
pages outside the table still connect the pages that share them; an empty table
gives no rows. Only the named columns are read, so that further columns may have
any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktake.llm.common import materialise, table
from stocktake.llm.components import connected_components

ALLOW, BLOCK = "allow", "block"
#: The rules of op10: verdict, host + path.
RULES = ((ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"), (ALLOW, "com/fr/"), (BLOCK, "com/de/"))
CANONICAL = r"(?i)<link\b(?=[^>]*\brel\s*=\s*(?:[\"'][^\"'>]*\bcanonical\b|canonical\b))[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def _host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)


def _path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _scheme_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"^(.*?)://", 1), _UPPER, _LOWER)


def _node(scheme: Column, host: Column, path: Column, query: Column) -> Column:
    """The node; null where there is no host. ``query`` has its question mark."""
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query == "?", "").otherwise(query)))


def _query_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)


def _without_dots(path: Column) -> Column:
    """An absolute path without its dot segments."""
    up = lambda done: F.regexp_replace(done, "/[^/]*$", "")
    step = lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.concat(done, F.lit("/"), x))
    folded = F.aggregate(F.slice(F.split(path, "/"), 2, 1_000_000_000), F.lit(""), step)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(folded, F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))).otherwise(path)


def resolved(scheme: Column, host: Column, path: Column, href: Column) -> Column:
    """The absolute url that a link on a page means; null if it is none or the page itself."""
    asked, place = F.regexp_extract(href, r"(\?[^#]*)", 1), F.regexp_extract(href, r"^[^?#]*", 0)
    here = F.concat(scheme, F.lit("://"), host)
    folder = F.when(path.contains("/"), F.regexp_extract(path, "^(.*/)", 1)).otherwise("/")
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (href == "") | href.startswith("#"), F.lit(None))
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("?"), F.concat(here, path, asked))
        .when(href.startswith("/"), F.concat(here, _without_dots(place), asked))
        .otherwise(F.concat(here, _without_dots(F.concat(folder, place)), asked))
    )


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(size, rank, rule, verdict) of the winning rule, or null. ``rules`` is a parameter: its size is the caller's, not the data's."""
    made = []
    for verdict, rule in rules:
        at = rule.index("/")
        name, start = rule[:at], rule[at:]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        made.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(verdict == ALLOW).alias("rank"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    if not made:
        return F.lit(None).cast("struct<size:int,rank:boolean,rule:string,verdict:string>")
    return F.array_max(F.array(*made))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, reason (rule, alias or none)."""
    read = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))

    def parts(url: str) -> list[Column]:
        rest = F.coalesce(_rest(F.col(url)), F.lit(""))
        node = _node(_scheme_of(F.col(url)), _host_of(rest), _path_of(rest), _query_of(rest))
        return [_scheme_of(F.col(url)).alias("_scheme"), _host_of(rest).alias("_host"), _path_of(rest).alias("_path"), node.alias("_node")]

    links = F.concat(F.regexp_extract_all("_html", F.lit(CANONICAL), 1), F.regexp_extract_all("_html", F.lit(REFRESH), 1))
    links = F.transform(F.coalesce(links, F.array().cast("array<string>")), lambda x: F.regexp_replace(x, "(?i)&(amp|#38|#x26);", "&"))
    ruled = read.select("_id", "_url", links.alias("_links"), *parts("_url")).withColumn("_rule", rule_for(F.col("_host"), F.col("_path"), rules))
    ruled = materialise(ruled, "pages")

    href = ruled.where("_node is not null").select(F.col("_node").alias("_src"), "_scheme", "_host", "_path", F.explode("_links").alias("_href"))
    href = href.select("_src", resolved(F.col("_scheme"), F.col("_host"), F.col("_path"), F.col("_href")).alias("_url")).where("_url is not null")
    edges = materialise(href.select("_src", *parts("_url")).where("_node is not null").distinct(), "links")
    alias = connected_components(edges.select(F.col("_src").alias("src"), F.col("_node").alias("dst")))

    named = ruled.drop("_links", "_scheme").join(alias.withColumnRenamed("node", "_node"), "_node", "left").withColumn("_group", F.coalesce("component", "_node")).drop("component")
    named = materialise(named, "aliases")
    beyond = edges.select("_node", rule_for(F.col("_host"), F.col("_path"), rules)["verdict"].alias("verdict")).where("verdict is not null")
    beyond = beyond.join(alias, F.col("_node") == F.col("node")).select(F.col("component").alias("_group"), "verdict")
    known = named.where("_rule is not null and _group is not null").select("_group", F.col("_rule.verdict").alias("verdict")).unionByName(beyond)
    groups = known.groupBy("_group").agg(F.max(F.col("verdict") == BLOCK).alias("blocks"), F.max(F.col("verdict") == ALLOW).alias("allows"))
    blocked = groups.where("blocks and not allows").select("_group", F.lit(True).alias("_blocked"))
    rest = named.where("_rule is null").join(blocked, "_group", "left")
    rest = rest.select("_id", "_host", "_path", F.lit(None).cast("string").alias("rule"), F.when(F.col("_blocked"), BLOCK).otherwise(ALLOW).alias("verdict"), F.when(F.col("_blocked"), "alias").otherwise("none").alias("reason"))
    sure = named.where("_rule is not null").select("_id", "_host", "_path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("verdict"), F.lit("rule").alias("reason"))
    return sure.unionByName(rest).select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), "rule", "verdict", "reason")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def parts(url: str) -> str:
        rest = f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
        host = f"translate(regexp_extract({rest}, '^[^/?#]*', 0), {quote(_UPPER)}, {quote(_LOWER)})"
        path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
        scheme = f"translate(regexp_extract({url}, '^(.*?)://', 1), {quote(_UPPER)}, {quote(_LOWER)})"
        asked = rf"regexp_extract({rest}, '^[^?#]*(\?[^#]*)', 1)"
        node = f"CASE WHEN {host} <> '' THEN {scheme} || '://' || {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {asked} = '?' THEN '' ELSE {asked} END END"
        return f"{scheme} AS scheme, {host} AS host, {path} AS path, {node} AS node"

    def dotless(path: str) -> str:
        step = "CASE WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN x = '.' THEN a ELSE a || '/' || x END"
        folded = f"list_reduce(list_concat([''], string_split({path}, '/')[2:]), lambda a, x: {step})"
        return rf"CASE WHEN regexp_matches({path}, '(^|/)\.\.?(/|$)') THEN {folded} || CASE WHEN regexp_matches({path}, '/\.\.?$') THEN '/' ELSE '' END ELSE {path} END"

    values = ", ".join(f"({quote(v)}, {quote(r)}, {quote(r[: r.index('/')])}, {quote(r[r.index('/') :])})" for v, r in RULES)
    fits = "(host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath)"
    link = r"""CASE WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches(tag, '(?i)\brel\s*=\s*(?:["''][^"''>]*\bcanonical\b|canonical\b)') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
      WHEN regexp_matches(tag, '(?i)^<meta') AND regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?i)\bcontent\s*=\s*["'']?[^"''>]*?\burl\s*=\s*["'']?([^"''\s>]+)', 1) ELSE '' END"""
    folder = "CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*/)', 1) ELSE '/' END"
    asked, place = r"regexp_extract(href, '(\?[^#]*)', 1)", "regexp_extract(href, '^[^?#]*', 0)"
    return rf"""
WITH RECURSIVE
 p AS (SELECT row_number() OVER () AS k, page_id, html, {parts('url')} FROM pages),
 rules(verdict, rule, rhost, rpath) AS (VALUES {values}),
 hit AS (SELECT k, arg_max(rule, len(rule)) AS rule, arg_max(verdict, len(rule)) AS verdict FROM p JOIN rules ON {fits} GROUP BY k),
 tags AS (SELECT node, scheme, host, path, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM p WHERE node IS NOT NULL),
 hrefs AS (SELECT node, scheme, host, path, regexp_replace(href, '(?i)&(amp|#38|#x26);', '&', 'g') AS href FROM (SELECT node, scheme, host, path, {link} AS href FROM tags) WHERE href <> ''),
 target AS (SELECT node AS src, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(href, '#') THEN NULL
     WHEN starts_with(href, '//') THEN scheme || ':' || href WHEN starts_with(href, '?') THEN scheme || '://' || host || path || {asked}
     WHEN starts_with(href, '/') THEN scheme || '://' || host || {dotless(place)} || {asked}
     ELSE scheme || '://' || host || {dotless(f'({folder} || {place})')} || {asked} END AS url FROM hrefs),
 one AS (SELECT * FROM (SELECT src, {parts('url')} FROM target WHERE url IS NOT NULL) WHERE node IS NOT NULL),
 edge AS (SELECT src, node AS dst FROM one UNION SELECT node, src FROM one),
 reach(a, b) AS (SELECT src, dst FROM edge UNION SELECT reach.a, edge.dst FROM reach JOIN edge ON reach.b = edge.src),
 comp AS (SELECT a AS node, least(a, min(b)) AS grp FROM reach GROUP BY a),
 every AS (SELECT p.*, coalesce(comp.grp, p.node) AS grp, hit.rule, hit.verdict AS own FROM p LEFT JOIN comp ON comp.node = p.node LEFT JOIN hit ON hit.k = p.k),
 beyond AS (SELECT grp, arg_max(verdict, len(rule)) AS own FROM one JOIN comp USING (node) JOIN rules ON {fits} GROUP BY grp, node),
 bad AS (SELECT grp FROM (SELECT grp, own FROM every UNION ALL SELECT grp, own FROM beyond) WHERE own IS NOT NULL AND grp IS NOT NULL GROUP BY grp HAVING bool_or(own = 'block') AND NOT bool_or(own = 'allow'))
SELECT page_id, host, path, rule, CASE WHEN own IS NOT NULL THEN own WHEN grp IN (SELECT grp FROM bad) THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN own IS NOT NULL THEN 'rule' WHEN grp IN (SELECT grp FROM bad) THEN 'alias' ELSE 'none' END AS reason FROM every
"""


ORACLE_SQL = _oracle()
