"""URL filters with redirect equivalence.

A page's canonical links and refresh redirects make its URL and their targets aliases. Distributed connected
components over these links give classes of aliases. A URL that a rule fits has that rule's verdict, whatever
its aliases are. Any other URL gets its class's verdict: allow, if an explicit allow rule fits a member; else
block, if a block rule fits one; else allow. Targets that aren't pages count as members.

A rule is host/path; it fits its host and all subdomains, if the URL's path starts with the rule's. The
longest rule wins, of equally long ones the first in order of their text. Rules are compiled into the plan.

Links are read from the page's HTML without its comments and scripts: link elements with rel=canonical and
meta elements with http-equiv=refresh; relative targets are resolved, fragments dropped, scheme and host
lower-cased. A comment or script without an end takes the rest of the page, and so does a tag, which then counts
for nothing: each character is passed over once, however long the page is. Defined results: a null url, or one without ``://``, has an empty host and path, no rule and no
aliases, and is allowed; null html has no links; repeated rows are judged alike; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import rekey

RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node(url: Column) -> Column:
    """The URL as a node: scheme and host lower-cased, no fragment; null without ``://``."""
    scheme, rest = F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(lower_ascii(scheme), F.lit("://"), host(url), rest))


def fitting(h: Column, p: Column, rules: list[tuple[str, str]]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):  # the longest is asked first
        name, slash, start = text.partition("/")
        name = name.lower()
        fits = ((h == name) | h.endswith("." + name)) & p.startswith(slash + start)
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.trim(F.regexp_replace(value, r"""^["']|["']$""", ""))


def _resolved(target: Column, scheme: Column, host: Column, path: Column) -> Column:
    """The target of a link on a page of this scheme, host and path."""
    root = F.concat(scheme, F.lit("://"), host)
    return (
        F.when(target == "", None)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(root, path, target))
        .when(target.rlike(r"^(#|[A-Za-z][A-Za-z0-9+.-]*:)"), None)
        .otherwise(F.concat(root, F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1)), target))
    )


def links(pages: DataFrame) -> DataFrame:
    """Edges (a, b) from each page's URL to its canonical and refresh targets.

    In steps whose columns the next one uses more than once: written as one expression, each use would hold all the
    regular expressions below it, more than a generated class can.
    """
    bare = F.regexp_replace("html", r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)", " ")
    tags = pages.select("url", F.explode(F.regexp_extract_all(bare, F.lit(r"(?is)<(?:link|meta)\b[^>]*+(?:>|\z)"), F.lit(0))).alias("tag"))
    tags = tags.where(F.col("tag").endswith(">") & F.lower("tag").rlike("canonical|refresh"))
    tags = tags.select("url", *[_attribute(F.col("tag"), a).alias(c) for a, c in (("rel", "rel"), ("href", "href"), ("http-equiv", "equiv"), ("content", "content"))])
    refresh = F.trim(F.regexp_extract("content", r"""(?is)^\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"']*)""", 1))
    target = F.when(F.array_contains(F.split(lower_ascii(F.col("rel")), r"\s+"), "canonical"), F.col("href")).when(lower_ascii(F.col("equiv")) == "refresh", refresh)
    tags = tags.select("url", F.regexp_replace(target, "&amp;", "&").alias("target"), F.regexp_extract("url", r"(?s)^(.*?)://", 1).alias("scheme"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    tags = tags.select(node(F.col("url")).alias("a"), _resolved(*map(F.col, ("target", "scheme", "host", "path"))).alias("to"))
    edges = tags.select("a", node(F.col("to")).alias("b"))
    return edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule, verdict, and by what: ``rule``, ``alias`` or ``default``.

    redirects: more edges (a, b) between URLs, as from crawl logs.
    """
    edges = links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b")))
    classes = components(edges)
    own = classes.withColumn("fit", fitting(host(F.col("node")), path(F.col("node")), rules))
    each = own.groupBy("component").agg(F.max((F.col("fit.verdict") == "allow").cast("int")).alias("allow"), F.max((F.col("fit.verdict") == "block").cast("int")).alias("block"))
    each = each.select(rekey(F.col("component"), "string").alias("c"), F.when(F.col("allow") == 1, "allow").when(F.col("block") == 1, "block").alias("passed_on"))
    aliases = classes.join(each, classes["component"] == each["c"]).where("passed_on IS NOT NULL").select(rekey(F.col("node"), "string").alias("n"), "passed_on")
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rows = rows.withColumn("fit", fitting(F.col("host"), F.col("path"), rules)).withColumn("node", node(F.col("url")))
    rows = rows.join(aliases, rows["node"] == aliases["n"], "left")
    by = F.when(F.col("fit").isNotNull(), "rule").when(F.col("passed_on").isNotNull(), "alias").otherwise("default")
    return rows.select("page_id", "url", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "passed_on", F.lit("allow")).alias("verdict"), by.alias("decided_by"))
