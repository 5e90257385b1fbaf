"""URL filters with redirect equivalence.

Every url is judged by an ordered rule list (host, path, verdict): a rule fits
its host and all subdomains if the path starts with the rule's path; the
longest rule wins. Pages that name another url as their canonical link, or
redirect to it, are aliases of it: connected components over these edges carry
a block decision to all aliases without a rule of their own. An explicit allow
takes precedence: a page with an allow rule stays allowed, and a component that
holds an explicitly allowed url blocks none of its pages without a rule.

Edges come from ``<link rel=canonical>`` and ``<meta http-equiv=refresh>`` in
``html``; more edges (a redirect log) can be passed in. Urls are nodes by host
and what follows it, without scheme and fragment.

Edge cases: null urls and urls without ``://`` have an empty host and path, no
rule and no aliases; relative targets are resolved against the page's host;
targets that are no page of the table still carry their rule's verdict; pages
with one url share a verdict; equally long rules: the first in the list wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, save

CANONICAL_TAG = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH_TAG = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
REFRESH_URL = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.regexp_replace(_rest(url), r"^[^/?#]*", ""), r"^[^?#]*", 0), F.lit(""))


def node(url: Column) -> Column:
    """Name of a url in the alias graph: host, path and query."""
    tail = F.regexp_extract(F.regexp_replace(_rest(url), r"^[^/?#]*", ""), r"^[^#]*", 0)
    return F.when(host(url) != "", F.concat(host(url), F.when(tail == "", F.lit("/")).otherwise(tail)))


def rule_of(h: Column, p: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest fitting rule, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][0] + rules[i][1]), i))
    for i in reversed(order):
        rh, rp, rv = rules[i]
        fits = ((h == rh) | F.endswith(h, F.lit("." + rh))) & F.startswith(p, F.lit(rp))
        name, verdict = F.when(fits, rh + rp).otherwise(name), F.when(fits, rv).otherwise(verdict)
    return name, verdict


def resolve(target: Column, base: Column) -> Column:
    """Absolute url of a link target found on page ``base``."""
    scheme = F.substring_index(base, "://", 1)
    return (F.when(F.instr(target, "://") > 0, target)
            .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
            .when(F.startswith(target, F.lit("/")), F.concat(scheme, F.lit("://"), host(base), target))
            .otherwise(F.concat(scheme, F.lit("://"), host(base), F.regexp_replace(path(base), r"[^/]*$", ""),
                                target)))


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) urls of canonical links and refresh redirects."""
    found = pages.select("url", F.explode(F.array(
        F.regexp_extract(F.regexp_extract("html", CANONICAL_TAG, 0), HREF, 1),
        F.regexp_extract(F.regexp_extract("html", REFRESH_TAG, 0), REFRESH_URL, 1))).alias("target"))
    found = found.where("target <> '' AND instr(url, '://') > 0")
    return found.select(F.col("url").alias("src"), resolve(F.replace("target", F.lit("&amp;"), F.lit("&")),
                                                           F.col("url")).alias("dst"))


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, component) per row of ``pages``."""
    links = page_edges(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("src", "dst"))
    ends, _ = save(links.select(*[x for c in ("src", "dst") for x in (
        node(F.col(c)).alias(c), host(F.col(c)).alias(f"{c}_host"), path(F.col(c)).alias(f"{c}_path"))])
        .where("src IS NOT NULL AND dst IS NOT NULL")
        .withColumns({"a": F.xxhash64("src"), "b": F.xxhash64("dst")}))
    alias = components(ends.select("a", "b"))
    urls = (ends.select(F.col("a").alias("node"), F.col("src_host").alias("h"), F.col("src_path").alias("p"))
            .unionByName(ends.select(F.col("b").alias("node"), F.col("dst_host").alias("h"),
                                     F.col("dst_path").alias("p"))).distinct())
    explicit = rule_of(F.col("h"), F.col("p"), rules)[1]
    verdicts = (urls.join(alias, "node").withColumn("v", explicit).groupBy("root")
                .agg(F.bool_or(F.coalesce(F.col("v") == "block", F.lit(False))).alias("blocked"),
                     F.bool_or(F.coalesce(F.col("v") == "allow", F.lit(False))).alias("allowed")))
    state, _ = save(alias.join(verdicts, "root").select("node", "root", (F.col("blocked") & ~F.col("allowed"))
                                                        .alias("carried")))
    url = F.col("url")
    named = pages.select("page_id", "url", host(url).alias("host"), path(url).alias("path"),
                         F.xxhash64(node(url)).alias("node"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = named.join(state, "node", "left")
    return out.select("page_id", "url", "host", "path", name.alias("rule"),
                      F.coalesce(verdict, F.when(F.col("carried"), "block").otherwise("allow")).alias("verdict"),
                      F.col("root").alias("component"))
