"""URL filters: block and allow rules, spread to aliases over redirects and canonical links.

Everything is DataFrame and SQL functions. A rule is a host and the start of a
path; it fits the host and all subdomains. A url without a rule of its own takes
the decision of its aliases: the urls that redirects and canonical links connect
it with. An alias that a rule allows outweighs those that rules block.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components, table

#: (rule, verdict) of the registered query; host and path are parted at the first slash.
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
_GOTO = r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>;]+)"""

_BASE = r"""(?is)<base\b[^>]*\bhref\s*=[^>]*>"""
#: Character references by name.
_NAMES = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, with A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to ? # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A url as an end of links: without scheme and fragment, host lower-cased; null where it has no host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict), else null. The list is part of the plan: keep it to thousands."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at = rule.index("/") if "/" in rule else len(rule)
        h, p = rule[:at].lower(), rule[at:]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _let(c: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is worked out once: a lambda's variable isn't written out where it is used."""
    return F.element_at(F.transform(F.array(c), fn), 1)


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute as it is written; empty where it has none."""
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'\s>][^\s>]*))"""
    return _let(tag, lambda t: F.concat(*(F.regexp_extract(t, pattern, k) for k in (1, 2, 3))))


def _unescaped(c: Column) -> Column:
    """Character references undone in one pass, those by name and by number; unknown ones stay."""
    names = F.from_json(F.lit(json.dumps(_NAMES)), "map<string,string>")

    def character(code: Column) -> Column:
        legal = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.decode(F.unhex(F.lpad(F.hex(F.when(legal, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")

    def undo(x: Column) -> Column:
        code = F.when(x.rlike("^&#[xX]"), F.conv(F.regexp_extract(x, "^&#[xX](.*);$", 1), 16, 10)).otherwise(F.regexp_extract(x, "^&#(.*);$", 1))
        return F.when(~x.startswith("&") | ~x.endswith(";"), x).when(x == "&amp;", "&").when(x.startswith("&#"), _let(code.try_cast("long"), character)).otherwise(
            F.coalesce(F.try_element_at(names, F.regexp_extract(x, "^&(.*);$", 1)), x))

    parts = F.regexp_extract_all(c, F.lit(r"(?s)&(?:#[0-9]{1,9}|#[xX][0-9A-Fa-f]{1,8}|[A-Za-z][A-Za-z0-9]{1,40});|&|[^&]+"), F.lit(0))
    return F.array_join(F.transform(parts, undo), "")


def _no_dots(path: Column) -> Column:
    """A path from / on without its . and .. segments (RFC 3986, 5.2.4)."""
    add = lambda out, x: F.when(x == ".", out).when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(1)))).otherwise(F.concat(out, F.array(x)))
    kept = lambda parts: F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), add)

    def clean(p: Column) -> Column:
        end = F.when(p.rlike(r"/\.\.?$"), "/").otherwise("")
        return F.when(p.rlike(r"/\.\.?(?:/|$)"), _let(F.concat(F.array_join(_let(F.split(p, "/"), kept), "/"), end), lambda out: F.when(out == "", "/").otherwise(out))).otherwise(p)

    return _let(path, clean)


def resolved(base: Column, to: Column) -> Column:
    """The url that `to` means on a page whose absolute url is base; null for schemes without // and for an empty target.

    Targets that have a host stay as they are written.
    """

    def target(base: Column, to: Column) -> Column:
        path, rest = F.regexp_extract(to, r"^[^?#]*", 0), F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
        own = _let(path_of(base), lambda p: F.when(p == "", "/").otherwise(p))
        query = F.regexp_extract(base, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
        merged = F.when(to.startswith("/"), path).otherwise(F.concat(F.regexp_extract(own, r"(?s)^.*/", 0), path))
        tail = F.when(to.startswith("#"), F.concat(own, query, to)).when(to.startswith("?"), F.concat(own, rest)).otherwise(F.concat(_no_dots(merged), rest))
        return F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to).when((to == "") | to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None).when(
            to.startswith("//"), F.concat(F.lit("x:"), to)).otherwise(_let(host_of(base), lambda h: F.when(h != "", F.concat(F.lit("x://"), h, tail))))

    clean = F.regexp_replace(F.regexp_replace(to, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    return _let(base, lambda b: _let(clean, lambda t: target(b, t)))


def html_links(pages: DataFrame) -> DataFrame:
    """(src, dst) nodes of all canonical links and meta refreshes in each page's whole html.

    Targets are resolved against the page's url, or its base tag where it has one.
    """
    every = lambda pattern, name, goto: F.transform(
        F.regexp_extract_all("html", F.lit(pattern), F.lit(0)), lambda tag: F.struct(_attribute(tag, name).alias("value"), F.lit(goto).alias("goto")))
    goto = r"""(?is)^\s*[0-9.]*(?:\s*[;,]\s*|\s+)(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|([^"'].*))"""
    raw = pages.where("url IS NOT NULL AND html IS NOT NULL AND (lower(html) LIKE '%canonical%' OR lower(html) LIKE '%refresh%')")
    found = F.concat(every(_CANONICAL, "href", False), every(_REFRESH, "content", True))
    raw = raw.select("url", _attribute(F.regexp_extract("html", _BASE, 0), "href").alias("base"), F.explode(found).alias("found"))

    def end(both: Column) -> Column:
        aim = _let(both[1], lambda v: F.when(F.col("found.goto"), F.concat(*(F.regexp_extract(v, goto, k) for k in (1, 2, 3)))).otherwise(v))
        return _let(resolved(F.coalesce(resolved(F.col("url"), both[0]), F.col("url")), aim), node_of)

    both = F.transform(F.array("base", "found.value"), _unescaped)
    return raw.select(node_of(F.col("url")).alias("src"), _let(both, end).alias("dst"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], links: DataFrame, keep: list[str], url: str = "url") -> DataFrame:
    """keep, host, path, rule, verdict and alias_of (the component, null without links) of each row.

    links has nodes src and dst (node_of), redirects and canonical links alike; null
    ends and loops are ignored. A row's own rule decides it. Else any url of its
    component that a rule allows makes it allow, else any that a rule blocks makes
    it block, else allow. Urls of links that are no page count for their
    component too. Null urls and urls without :// have no host, no rule and no
    links: allow. Rows stay as often as they come; columns besides keep are left out.
    """
    scratch = Scratch(pages.sparkSession)
    ends = links.where("src IS NOT NULL AND dst IS NOT NULL AND src != dst")
    parts = connected_components(ends.select(F.col("src").alias("a"), F.col("dst").alias("b")), scratch)
    # a node is host and the rest: it is judged by the same rules
    as_url = F.concat(F.lit("x://"), F.col("node"))
    judged = parts.withColumn("verdict", rule_for(host_of(as_url), path_of(as_url), rules)["verdict"])
    decided = judged.groupBy("component").agg(F.max(F.col("verdict") == "allow").alias("allowed"), F.max(F.col("verdict") == "block").alias("blocked"))
    alias = parts.join(decided, "component").select("node", F.col("component").alias("alias_of"), F.when(F.coalesce("allowed", F.lit(False)), "allow").when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow").alias("alias_verdict"))
    u = F.col(url)
    rows = pages.select(*keep, host_of(u).alias("host"), path_of(u).alias("path"), node_of(u).alias("node"))
    rows = rows.withColumn("own", rule_for(F.col("host"), F.col("path"), rules))
    return rows.join(alias, "node", "left").select(
        *keep, "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "alias_verdict", F.lit("allow")).alias("verdict"), "alias_of")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, RULES, html_links(pages), ["page_id"])


def _sql() -> str:
    node = r"""CASE WHEN regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1) <> '' THEN translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ||
      CASE WHEN regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1) = '' THEN '/' ELSE regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1) END END"""
    rule = "CASE " + " ".join(
        f"WHEN (host = '{r[:r.index('/')]}' OR ends_with(host, '.{r[:r.index('/')]}')) AND starts_with(path, '{r[r.index('/'):]}') THEN '{r}'"
        for r, _ in sorted(RULES, key=lambda x: -len(x[0]))) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES) + " END"
    parts = r"""coalesce(translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
      coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path"""
    q = lambda x: x.replace("'", "''")
    return f"""
    WITH RECURSIVE found AS (
      SELECT url, regexp_extract(regexp_extract(html, '{q(_CANONICAL)}'), '{q(_HREF)}', 1) AS "to" FROM pages WHERE url IS NOT NULL AND regexp_matches(html, '{q(_CANONICAL)}')
      UNION ALL
      SELECT url, regexp_extract(regexp_extract(html, '{q(_REFRESH)}'), '{q(_GOTO)}', 1) FROM pages WHERE url IS NOT NULL AND regexp_matches(html, '{q(_REFRESH)}')),
    full_links AS (
      SELECT url, CASE WHEN starts_with("to", '//') THEN 'x:' || "to" WHEN starts_with("to", '/') THEN 'x://' || translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || "to" ELSE "to" END AS "to" FROM found),
    links AS (SELECT {node.format(u='url')} AS src, {node.format(u='"to"')} AS dst FROM full_links),
    edges AS (SELECT src AS a, dst AS b FROM links WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst UNION SELECT dst, src FROM links WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst),
    reach AS (SELECT a AS node, a AS other FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a),
    comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
    node_parts AS (SELECT node, component, {parts.format(u="('x://' || node)")} FROM comp),
    node_rules AS (SELECT node, component, {rule} AS rule FROM node_parts),
    decided AS (SELECT component, CASE WHEN bool_or(({verdict}) = 'allow') THEN 'allow' WHEN bool_or(({verdict}) = 'block') THEN 'block' ELSE 'allow' END AS alias_verdict FROM node_rules GROUP BY component),
    rows_ AS (SELECT page_id, {parts.format(u='url')}, {node.format(u='url')} AS node FROM pages),
    ruled AS (SELECT *, {rule} AS rule FROM rows_)
    SELECT page_id, host, path, rule, coalesce({verdict}, alias_verdict, 'allow') AS verdict, component AS alias_of
    FROM ruled LEFT JOIN comp USING (node) LEFT JOIN decided USING (component)
    """


SQL = _sql()
