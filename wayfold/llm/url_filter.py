"""Operator 1: URL filter with redirect equivalence.

A rule is (host, path, block or allow). It fits a URL whose host is its host or a subdomain and whose path
starts with its path; the longest rule decides. URLs that no rule fits get what their aliases have: redirects
(meta refresh, or pairs given) and canonical links are edges between URLs, their connected components are
found by distributed star passes, and a component with a blocked URL is blocked but for URLs that a rule
allows. A URL's node is its host, path and query: scheme and fragment make no difference.

Rules given as a list are compiled into one expression of the projection, so judging needs no shuffle; rules
given as a DataFrame (block lists of any size) are joined on the URL's host suffixes.

Defined results: a null URL, or one without ://, has an empty host and path, fits no rule that needs a host
and is allowed; an empty path fits no rule with a path; repeated rows are judged each; rules of one length:
allow wins; pages without links form no component; an empty table gives no rows; other columns of the
input are not read (keep_allowed() keeps them)."""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import cut
from wayfold.llm.components import connected_components

#: host, path, verdict (fixed by the result contract).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_QUOTED = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _lower(c: Column) -> Column:
    return F.translate(c, ascii_uppercase, ascii_lowercase)


def _rest(url: Column) -> Column:
    """What follows the first ://; empty if there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return _lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """Host, path and query; null where there is no host."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)
    host = host_of(url)
    return F.when(host != "", F.concat(host, path_of(url), query))


def fits(host: Column, path: Column, rule_host, rule_path) -> Column:
    rule_host, rule_path = (F.lit(x) if isinstance(x, str) else x for x in (rule_host, rule_path))
    return ((host == rule_host) | host.endswith(F.concat(F.lit("."), rule_host))) & path.startswith(rule_path)


def compiled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null fields if none does."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "allow")):
        out = F.when(fits(host, path, h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def joined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct (host, path) of `urls` that a rule (host, path, verdict) fits."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    at = urls.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("suffix"))
    named = rules.select(F.col("host").alias("suffix"), F.col("path").alias("rule_path"), F.concat("host", "path").alias("rule"), "verdict")
    met = at.join(named, "suffix").where(F.col("path").startswith(F.col("rule_path")))
    best = F.struct(F.length("rule"), F.when(F.col("verdict") == "allow", 1).otherwise(0), F.col("rule"), F.col("verdict"))
    return met.groupBy("host", "path").agg(F.max(best).alias("m")).select("host", "path", "m.rule", "m.verdict")


def decided(urls: DataFrame, rules) -> DataFrame:
    """`urls` (host, path, ...) with the rule and verdict of the longest rule."""
    if not isinstance(rules, DataFrame):
        return urls.withColumn("_d", compiled(F.col("host"), F.col("path"), rules)).select("*", "_d.rule", "_d.verdict").drop("_d")
    return urls.join(joined(urls, rules), ["host", "path"], "left")


def _attribute(tag: Column, name: str) -> Column:
    return F.concat(*[F.regexp_extract(tag, rf"(?i)\b{name}{_QUOTED}", i) for i in (1, 2, 3)])


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): nodes joined by a canonical link or a meta refresh of a page; comments and scripts do not count."""
    page = pages.where(F.col(html).rlike("(?i)canonical|http-equiv")).select(F.col(url).alias("url"), F.col(html).alias("html"))
    clean = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script>", "")
    tags = page.select("url", F.explode(F.regexp_extract_all(clean, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"))
    canonical = F.when(F.col("tag").rlike(r"(?i)\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"), _attribute(F.col("tag"), "href"))
    refresh = F.when(F.col("tag").rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh"), F.regexp_extract("tag", r"(?i)\burl\s*=\s*[\"']?([^\"'>\s]+)", 1))
    # inline() of one struct keeps what follows from being expanded into what precedes.
    to = tags.select(F.inline(F.array(F.struct(
        host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("a"),
        F.trim(F.replace(F.coalesce(canonical, refresh), F.lit("&amp;"), F.lit("&"))).alias("to")))))
    host, path, link = F.col("host"), F.col("path"), F.col("to")
    absolute = (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(F.lit("x:"), link))
        .when(link.startswith("/"), F.concat(F.lit("x://"), host, link))
        .when(link.startswith("?"), F.concat(F.lit("x://"), host, path, link))
        .when((link != "") & ~link.startswith("#"), F.concat(F.lit("x://"), host, F.regexp_extract(path, r"^(.*/)?", 0), link))
    )
    to = to.select(F.inline(F.array(F.struct(F.col("a"), absolute.alias("to")))))
    return to.select(F.inline(F.array(F.struct(F.col("a"), node_of(F.col("to")).alias("b")))))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(key, host, path, rule, verdict, component) of every page. `redirects` (from_url, to_url) adds edges;
    component is the smallest node of the page's aliases, null if it has none."""
    edges = links(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")))
    nodes = connected_components(edges)
    at = nodes.withColumn("u", F.concat(F.lit("x://"), "node"))
    at = decided(at.withColumn("host", host_of(F.col("u"))).withColumn("path", path_of(F.col("u"))), rules)
    blocked = at.groupBy("component").agg(F.max(F.coalesce(F.col("verdict") == "block", F.lit(False))).alias("blocked"))
    aliases = cut(nodes.join(blocked, "component"))
    u = F.col(url)
    rows = decided(pages.select(F.col(key), host_of(u).alias("host"), path_of(u).alias("path"), node_of(u).alias("node")), rules)
    if aliases.isEmpty():
        rows = rows.withColumn("component", F.lit(None).cast("string")).withColumn("blocked", F.lit(None).cast("boolean"))
    else:
        rows = rows.join(aliases, "node", "left")
    verdict = F.coalesce("verdict", F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return rows.select(key, "host", "path", "rule", verdict.alias("verdict"), "component")


def keep_allowed(pages: DataFrame, key: str = "page_id", **how) -> DataFrame:
    """The pages whose verdict is allow, with their own columns; all rows of an id share one verdict: block if any has it."""
    out = judge(pages, key, **how).groupBy(key).agg(F.max(F.col("verdict") == "block").alias("b")).where("not b").select(key)
    return pages.join(out, key, "left_semi")
