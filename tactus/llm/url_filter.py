"""URL filters with redirect equivalence.

A rule set judges urls directly; redirect and canonical-link edges join urls into alias classes by
distributed connected components, and a block spreads to every member of a class that no rule judges itself. A url
with a rule of its own keeps that rule's verdict, so an explicit allow always stands.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.llm.common import ascii_lower, materialise
from tactus.llm.components import connected_components

#: (verdict, host and path).
PRODUCTION_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Rule sets of up to so many rules are compiled into the plan; larger ones are joined, with the same results.
COMPILED_RULES = 100


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z in lower case; empty for null or without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The alias node of a url: host, path and query, without scheme and fragment."""
    query = F.coalesce(F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1), F.lit(""))
    path = path_of(url)
    return F.when(url.contains("://"), F.concat(host_of(url), F.when(path == "", F.lit("/")).otherwise(path), query))


def rule_of(host: Column, path: Column, rules) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null; equal lengths: allow first, then by text."""
    ordered = sorted({(v, r) for v, r in rules}, key=lambda x: (-len(x[1]), x[0] != "allow", x[1]))
    tests = []
    for verdict, rule in ordered:
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        tests.append((fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    if not tests:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    first, *more = tests
    return reduce(lambda c, t: c.when(*t), more, F.when(*first))


def with_rules(df: DataFrame, host: str, path: str, rules) -> DataFrame:
    """df with `own`, rule_of() its columns host and path. rules: (verdict, rule) pairs, or a DataFrame of them.

    Many rules: each distinct (host, path) meets the rules of its host's suffixes that are as long as some start of its path, by equal keys.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= COMPILED_RULES:
            return df.withColumn("own", rule_of(F.col(host), F.col(path), rules))
        rules = df.sparkSession.createDataFrame(list(rules), "verdict string, rule string")
    at = F.instr("rule", "/")
    with_path = F.when(at > 0, F.substr("rule", at)).otherwise(F.lit("/"))
    keyed = rules.select("verdict", "rule", F.when(at > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule")).alias("_suffix"), with_path.alias("_start")).distinct()
    first = F.struct((-F.length("rule")).alias("n"), (F.col("verdict") != "allow").alias("block"), "rule", "verdict")
    best = keyed.groupBy("_suffix", "_start").agg(F.min(first).alias("_best"))
    lengths = best.groupBy("_suffix").agg(F.collect_set(F.length("_start")).alias("_lengths"))
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    asked = df.select(host, path).where(F.col(host).isNotNull() & F.col(path).isNotNull()).distinct()
    asked = asked.withColumn("_suffix", F.explode(suffixes)).join(lengths, "_suffix").withColumn("_n", F.explode("_lengths")).where(F.col("_n") <= F.length(path))
    found = asked.withColumn("_start", F.substring(F.col(path), F.lit(1), F.col("_n"))).join(best, ["_suffix", "_start"]).groupBy(host, path).agg(F.min("_best").alias("_best"))
    own = F.when(F.col("_best").isNotNull(), F.struct(F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("verdict"))).alias("own")
    return df.join(found, [host, path], "left").select(*df.columns, own)


_LINK = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
_META = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\bcontent\s*=\s*["'][^"'>]*?url\s*=\s*([^"'\s>]+)"""


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) urls: canonical links and meta redirects of each page's html; relative targets are resolved."""
    html = F.col("html")
    targets = F.concat(
        F.when(html.rlike(r"(?i)canonical"), F.regexp_extract_all(html, F.lit(_LINK), F.lit(1))).otherwise(F.array().cast("array<string>")),
        F.when(html.rlike(r"(?i)http-equiv"), F.regexp_extract_all(html, F.lit(_META), F.lit(1))).otherwise(F.array().cast("array<string>")),
    )
    found = pages.select("url", F.explode(targets).alias("to")).where("url is not null and to <> ''")
    url, to = F.col("url"), F.col("to")
    scheme = F.regexp_extract(url, r"^([^:/?#]*):", 1)
    site = F.regexp_extract(url, r"^([^:/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"^([^:/?#]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    full = (
        F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(to.startswith("/"), F.concat(site, to))
        .when(to.startswith("?"), F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), to))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), to))
    )
    return found.select(url.alias("src"), full.alias("dst"))


def judge_urls(pages: DataFrame, rules=PRODUCTION_RULES, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, alias (its class, null if it has no edge).

    pages: page_id, url, html; other columns are ignored. rules: (verdict, rule) pairs or a DataFrame of them, any number. redirects: more edges (src, dst) of urls, e.g. from
    a crawl log. Null or malformed urls have empty host and path, no rule and no aliases: they get `default`.
    Repeated rows are judged alike, each on its own row; urls are read whole, however long. An empty table gives an empty result.
    """
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("src", "dst"))
    # the urls themselves stay beside their nodes: a rule may judge a target that is no page
    ends = materialise(edges.where("src is not null and dst is not null"), "redirects")
    nodes = ends.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst"))
    classes = materialise(connected_components(nodes), "aliases")
    placed = classes.withColumns({"_host": F.regexp_extract("node", r"^([^/?#]*)", 1), "_path": F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1)})
    blocked = with_rules(placed, "_host", "_path", rules).groupBy("component").agg(F.coalesce(F.bool_or(F.col("own.verdict") == "block"), F.lit(False)).alias("blocked"))
    state = classes.join(blocked, "component").select("node", F.col("component").alias("alias"), "blocked")
    url = F.col("url")
    judged = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    judged = with_rules(judged, "host", "path", rules)
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("blocked"), F.lit("block")), F.lit(default))
    return judged.join(state, "node", "left").select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), "alias")
