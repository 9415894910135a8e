"""URL filters with redirect equivalence (native).

A rule (host, path) fits its host and all subdomains where the url's path starts with
the rule's; the longest fitting rule decides.  Pages that no rule fits get the decision
of their aliases: urls are nodes in a normal form (scheme, fragment and default port
dropped, host in lower case), canonical links, refresh redirects and given redirect
rows are edges, and in each connected component an explicit allow outweighs any block,
a block outweighs nothing, and with neither the page is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from artifact_scan.llm.components import components
from artifact_scan.llm.store import table, written

#: Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?i)<link[ \t\r\n\f][^>]*rel[ \t\r\n\f]*=[ \t\r\n\f]*[\"']?canonical[^>]*>"
_HREF = r"(?i)[ \t\r\n\f]href[ \t\r\n\f]*=[ \t\r\n\f]*[\"']([^\"']*)[\"']"
_META = r"(?i)<meta[ \t\r\n\f][^>]*http-equiv[ \t\r\n\f]*=[ \t\r\n\f]*[\"']?refresh[^>]*>"
_GOTO = r"(?i)url[ \t\r\n\f]*=[ \t\r\n\f]*'?([^\"'> \t\r\n\f]+)"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(_rest(url), r"^[^/?#]*", ""), r"^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls. Rules are few: they become one CASE."""
    rule = verdict = None
    for decision, name, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix))
        rule = F.when(fits, name + prefix) if rule is None else rule.when(fits, name + prefix)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    return rule, verdict


def with_node(df: DataFrame, url: str, node: str) -> DataFrame:
    """``df`` with the url's normal form, null where the url has no host. In steps, which keeps the generated code small."""
    df = df.withColumn("_rest", F.regexp_replace(_rest(F.col(url)), "#(?s:.*)$", ""))
    df = df.withColumn("_host", F.regexp_replace(F.translate(F.regexp_extract("_rest", r"^[^/?]*", 0), _UPPER, _LOWER), r":(80|443)$", ""))
    df = df.withColumn("_tail", F.regexp_replace("_rest", r"^[^/?]*", ""))
    slash = F.when(F.startswith("_tail", F.lit("/")), "").otherwise("/")
    return df.withColumn(node, F.when(F.col("_host") != "", F.concat("_host", slash, "_tail"))).drop("_rest", "_host", "_tail")


def _absolute(df: DataFrame) -> DataFrame:
    """Adds ``aim``, the ``target`` against its page's url: absolute, scheme-relative, root-relative or path-relative."""
    df = df.withColumn("_site", F.concat(F.lit("http://"), host_of(F.col("url")))).withColumn("_path", path_of(F.col("url")))
    folder = F.regexp_replace(F.when(F.col("_path") == "", "/").otherwise(F.col("_path")), r"[^/]*$", "")
    target = F.col("target")
    aim = (
        F.when(F.instr(target, "://") > 0, target)
        .when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target))
        .when(F.startswith(target, F.lit("/")), F.concat("_site", target))
        .otherwise(F.concat("_site", folder, target))
    )
    return df.withColumn("aim", aim).drop("_site", "_path")


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): the page and each node that one of its canonical links or refreshes names, but itself."""
    html = F.col("html")
    named = lambda tag, attribute: F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, attribute, 1))
    both = F.concat(named(_LINK, _HREF), named(_META, _GOTO))
    found = pages.where(html.rlike(r"(?i)canonical|refresh")).select("url", F.explode(F.array_distinct(both)).alias("target"))
    found = _absolute(found.where("target <> ''"))
    return with_node(with_node(found, "url", "a"), "aim", "b").select("a", "b").where("a <> b")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for each page row.

    ``redirects`` may add (from_url, to_url) rows.  A null url, or one without ``://``, has an
    empty host and path, fits no rule, is no node and is allowed.  Of fitting rules of equal
    length the first in ``rules`` decides.  Every canonical link and refresh of a page counts.  Rows
    that repeat a page get equal verdicts; pages with equal normal forms are aliases without any
    edge; urls and pages of any length are read whole, other columns are not; an empty table
    gives none.
    """
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.union(with_node(with_node(redirects, "from_url", "a"), "to_url", "b").select("a", "b"))
    found = components(edges)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    empty = F.lit("")
    seen = pages.select("page_id", "url", F.coalesce(host, empty).alias("host"), F.coalesce(path, empty).alias("path"))
    seen = with_node(seen, "url", "node").drop("url")
    rule, explicit = rule_of(F.col("host"), F.col("path"), rules)
    seen = seen.withColumn("rule", rule).withColumn("explicit", explicit)
    # Pages without a node are no keys of a join; aggregates are written before they are joined, so that hot keys can be split.
    nodes = seen.where("node is not null").join(found, "node", "left").withColumn("alias", F.coalesce("root", "node"))
    told = written(nodes.where("explicit is not null").groupBy("alias").agg(F.max(F.col("explicit") == "allow").alias("allowed")), "urls-told")
    # Only pages without a rule need their component's decision.
    open_ = nodes.where("explicit is null").join(told, "alias", "left")
    columns = ["page_id", "host", "path", "rule"]
    out = open_.select(*columns, F.when(~F.col("allowed"), "block").otherwise("allow").alias("verdict"))
    out = out.unionByName(nodes.where("explicit is not null").select(*columns, F.col("explicit").alias("verdict")))
    return out.unionByName(seen.where("node is null").select(*columns, F.coalesce("explicit", F.lit("allow")).alias("verdict")))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter with redirects between the given pages, which hold none of their own: chains, a tree and a ring by page id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    to = F.when(F.col("page_id") % 5 < 2, F.floor(F.col("page_id") / 3)).when(F.col("page_id") % 5 == 2, F.col("page_id") + 5)
    moved = pages.select(F.col("url").alias("from_url"), to.alias("to")).join(pages.select(F.col("page_id").alias("to"), F.col("url").alias("to_url")), "to")
    return judge(pages, redirects=moved.select("from_url", "to_url"))


def _sql_case(column: int) -> str:
    lines = []
    for decision, name, prefix in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        result = (name + prefix, decision)[column]
        lines.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{prefix}') THEN '{result}'")
    return "CASE " + " ".join(lines) + " END"


def _sql_node(url: str) -> str:
    rest = f"regexp_replace(CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END, '#.*$', '', 's')"
    host = f"regexp_replace(translate(regexp_extract({rest}, '^[^/?]*'), '{_UPPER}', '{_LOWER}'), ':(80|443)$', '')"
    tail = f"regexp_replace({rest}, '^[^/?]*', '')"
    return f"CASE WHEN {host} <> '' THEN {host} || CASE WHEN starts_with({tail}, '/') THEN {tail} ELSE '/' || {tail} END END"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql(more: str = "") -> str:
    return f"""
WITH RECURSIVE cut AS (
  SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id, url, html, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM cut
), named AS (
  SELECT url, host, path, regexp_extract(unnest(regexp_extract_all(html, {_quoted(_LINK)})), {_quoted(_HREF)}, 1) AS target FROM parsed
  UNION ALL
  SELECT url, host, path, regexp_extract(unnest(regexp_extract_all(html, {_quoted(_META)})), {_quoted(_GOTO)}, 1) FROM parsed
), aimed AS (
  SELECT url, CASE WHEN strpos(target, '://') > 0 THEN target WHEN starts_with(target, '//') THEN 'http:' || target
    WHEN starts_with(target, '/') THEN 'http://' || host || target
    ELSE 'http://' || host || regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') || target END AS target
  FROM named WHERE target <> ''
  {more}
), edges AS (
  SELECT {_sql_node("url")} AS a, {_sql_node("target")} AS b FROM aimed
), both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(node, label) AS (
  SELECT a, a FROM both_ways UNION SELECT e.b, r.label FROM reach r JOIN both_ways e ON e.a = r.node
), roots AS (SELECT node, min(label) AS root FROM reach GROUP BY node),
ruled AS (
  SELECT page_id, host, path, {_sql_case(0)} AS rule, {_sql_case(1)} AS explicit, {_sql_node("url")} AS node FROM parsed
), seen AS (
  SELECT ruled.*, coalesce(root, ruled.node) AS alias FROM ruled LEFT JOIN roots ON roots.node = ruled.node
), told AS (
  SELECT alias, max(CASE explicit WHEN 'allow' THEN 1 ELSE 0 END) AS allowed FROM seen WHERE explicit IS NOT NULL AND alias IS NOT NULL GROUP BY alias
)
SELECT page_id, host, path, rule, coalesce(explicit, CASE WHEN allowed = 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM seen LEFT JOIN told ON told.alias = seen.alias
"""


ORACLE_SQL = _sql()
ALIASES_SQL = _sql("UNION ALL SELECT f.url, t.url FROM pages f JOIN pages t ON t.page_id = CASE WHEN f.page_id % 5 < 2 THEN f.page_id // 3 WHEN f.page_id % 5 = 2 THEN f.page_id + 5 END")
