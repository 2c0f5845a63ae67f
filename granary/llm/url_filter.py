"""URL filter: host and path rules, and redirect equivalence.

A url that a rule fits has the rule's verdict. Others take the verdict of their aliases: urls that redirect to each other or name
each other as canonical are one class (a connected component of those edges, found without collecting them), and a class with
an allowed url is allowed, else one with a blocked url is blocked. What is left is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import checked_broadcast, settle, table
from granary.llm.components import connected_components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The production rules.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """What stands for a url among aliases: host and the rest up to the fragment, without the scheme; null without ://."""
    rest = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), F.when(rest == "", "/").otherwise(rest)))


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(length, allow, rule, verdict) of the longest rule that fits host and path (of equals an allowing one); null if none fits."""
    fits = []
    for r in rules:
        own = (host == r.host) | F.endswith(host, F.lit("." + r.host))
        found = F.struct(F.lit(len(r.name)).alias("length"), F.lit(r.verdict == "allow").alias("allow"), F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        fits.append(F.when(own & F.startswith(path, F.lit(r.path)), found))
    return F.greatest(*fits, fits[0]) if fits else F.lit(None)


def _target(base: Column, link: Column) -> Column:
    """A link resolved against the url that holds it (dot segments stay); null for an empty one and for one within the same page."""
    scheme = F.regexp_extract(base, r"(?s)\A(.*?)://", 1)
    host = F.regexp_extract(base, _URL, 1)
    clean = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    own = F.concat(scheme, F.lit("://"), host)
    return (
        F.when((clean == "") | F.startswith(clean, F.lit("#")), None)
        .when(F.startswith(clean, F.lit("//")), F.concat(scheme, F.lit(":"), clean))
        .when(F.startswith(clean, F.lit("/")), F.concat(own, clean))
        .when(F.startswith(clean, F.lit("?")), F.concat(own, path_of(base), clean))
        .when(clean.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), clean)
        .otherwise(F.concat(own, F.when(path_of(base) == "", "/").otherwise(F.regexp_extract(path_of(base), r"(?s)\A(.*/)?", 0)), clean))
    )


# Tags that name another url for the page, and where in the tag it stands. Fixed values of HTML.
CANONICAL = r"(?is)<link\b[^>]*[\s\"'/]rel\s*=\s*[\"']?canonical\b[^>]*>"
HREF = r"(?is)[\s\"'/]href\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)<meta\b[^>]*[\s\"'/]http-equiv\s*=\s*[\"']?refresh\b[^>]*>"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target) nodes of all canonical links and meta refreshes in pages."""
    found = lambda tag, link: F.transform(F.regexp_extract_all(html_col, F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, link, 1))
    links = pages.select(F.col(url_col).alias("url"), F.explode(F.concat(found(CANONICAL, HREF), found(REFRESH, REFRESH_URL))).alias("link")).filter("url is not null")
    return links.select(node_of(F.col("url")).alias("source"), node_of(_target(F.col("url"), F.col("link"))).alias("target")).filter("source is not null and target is not null")


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict): one row per row of pages.

    redirects: (source, target) urls seen elsewhere, such as in fetch logs. A null url, and one without ://, has an empty host and
    path, fits no rule, has no alias and is allowed. Null html has no link. Repeated rows keep a row each. No rows: no rows.
    """
    edges = page_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("source")).alias("source"), node_of(F.col("target")).alias("target")))
    # url -> component; a node's own rule counts for its component, also that of a url which isn't a page.
    nodes = connected_components(edges, "source", "target")
    seen = nodes.withColumn("at", F.concat(F.lit("http://"), F.col("node")))
    seen = seen.withColumn("found", rule_for(host_of(F.col("at")), path_of(F.col("at")), rules))
    whole = seen.groupBy("component").agg(F.max(F.coalesce(F.col("found.allow"), F.lit(False))).alias("allowed"), F.max(F.coalesce(~F.col("found.allow"), F.lit(False))).alias("blocked"))
    aliases = checked_broadcast(settle(nodes.join(whole, "component").filter("allowed or blocked").select(F.col("node").alias("alias"), F.when(F.col("allowed"), "allow").otherwise("block").alias("theirs"))))
    judged = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("own"))
    judged = judged.withColumn("found", rule_for(F.col("host"), F.col("path"), rules)).join(aliases, F.col("own") == F.col("alias"), "left")
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", "theirs", F.lit("allow")).alias("verdict"))


def op6_redirect_classes(spark, sf_dir: str) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict."""
    return judge(table(spark, sf_dir, "pages"))
