"""URL filters with redirect equivalence, in DataFrame operators only.

Rules judge a URL by the longest rule that fits it. A URL that no rule fits
takes over what the rules say about its aliases: redirect and canonical-link
edges join URLs into components, and a component with an allowed member is
allowed, else one with a blocked member is blocked, else the default holds.

Defined results: a null URL, or one without ``://``, has an empty host and
path, fits no rule, has no aliases and gets the default. Null html has no
links. Repeated rows are each judged. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityfeed.llm.common import cut
from cityfeed.operators.graph import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
DEFAULT = "allow"


def host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def resource(url: Column) -> Column:
    """Host, path and query: the name under which aliases meet; null without a host."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(host(url) != "", F.concat(host(url), path(url), query))


def fitting_rule(host_: Column, path_: Column, rules) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. ``rules`` is a stated list, tried longest first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host_ == rule_host) | host_.endswith("." + rule_host)) & path_.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _without_dots(path_: Column) -> Column:
    """A path from the root with its ``.`` and ``..`` segments resolved."""
    parts = F.split(F.regexp_replace(path_, r"/(\.\.?)$", "/$1/"), "/")
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.slice(parts, 2, 1 << 20), F.array().cast("array<string>"), step), "/"))


def _target(tag: Column, url: Column) -> Column:
    """The absolute form of a link target found on the page ``url``; null if there is none."""
    base = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"(?s)^(.*?):", 1)
    own, rest = F.regexp_extract(tag, r"^[^?#]*", 0), F.regexp_extract(tag, r"[?#].*$", 0)
    folder = F.concat(F.lit("/"), F.regexp_extract(path(url), r"(?s)^/(.*/)", 1))
    return (
        F.when(tag == "", None)
        .when(tag.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), tag)
        .when(base == "", None)
        .when(tag.startswith("//"), F.concat(scheme, F.lit(":"), tag))
        .when(tag.startswith("/"), F.concat(base, _without_dots(own), rest))
        .when(tag.startswith("#") | tag.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(tag.startswith("?"), F.concat(base, path(url), tag))
        .otherwise(F.concat(base, _without_dots(F.concat(folder, own)), rest))
    )


def _decoded(link: Column) -> Column:
    """A link without the entities that URLs in HTML have; ``&amp;`` last, so that nothing is decoded twice."""
    for entity, char in (("(?i)&#(?:38|x26);", "&amp;"), ("(?i)&(?:quot|#34|#x22);", '"'), ("(?i)&(?:apos|#39|#x27);", "'"), ("(?i)&amp;", "&")):
        link = F.regexp_replace(link, entity, char)
    return link


def page_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst)`` URLs from all canonical links and refresh redirects in ``html``."""
    rel = r"""(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'|canonical(?=[\s/>]))"""
    canonical = F.regexp_extract_all("html", F.lit(r"(?i)<link\b[^>]*\brel\s*=\s*" + rel + "[^>]*>"), F.lit(0))
    refresh = F.regexp_extract_all("html", F.lit(r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""), F.lit(0))
    links = F.concat(
        F.transform(canonical, lambda tag: F.regexp_extract(tag, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)),
        F.transform(refresh, lambda tag: F.regexp_extract(tag, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)),
    )
    has = F.col("html").rlike("(?i)canonical|refresh")
    found = pages.where(F.col("url").isNotNull() & has).select(F.col("url").alias("src"), F.explode(links).alias("tag"))
    return found.select("src", _target(_decoded(F.col("tag")), F.col("src")).alias("dst")).where("dst is not null")


def alias_verdicts(edges: DataFrame, rules) -> DataFrame:
    """``(node, alias_verdict)`` for every resource that an edge touches and whose component a rule judges."""
    pairs = edges.select(resource(F.col("src")).alias("a"), resource(F.col("dst")).alias("b"), "src", "dst").where("a is not null and b is not null and a <> b")
    pairs = cut(pairs, "links")
    members = components(pairs.select("a", "b"))
    names = pairs.select(F.col("a").alias("node"), F.col("src").alias("url")).union(pairs.select(F.col("b").alias("node"), F.col("dst").alias("url")))
    judged = names.select("node", fitting_rule(host(F.col("url")), path(F.col("url")), rules)["verdict"].alias("said")).where("said is not null")
    # "allow" sorts before "block", so the least verdict lets an explicit allow win
    by_root = cut(members.join(judged, "node").groupBy("root").agg(F.min("said").alias("alias_verdict")), "verdicts")
    # the verdicts are a table of their own, so Spark's skew join may split the nodes of a giant component
    return members.join(by_root, "root").groupBy("node").agg(F.min("alias_verdict").alias("alias_verdict"))


def filter_urls(pages: DataFrame, rules=RULES, default: str = DEFAULT, redirects: DataFrame | None = None) -> DataFrame:
    """Judge every page: ``page_id, host, path, rule, verdict, by_alias``.

    ``redirects`` adds ``(src, dst)`` URL pairs to the links found in the pages.
    """
    edges = page_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select("src", "dst"))
    aliases = alias_verdicts(edges, rules)
    own = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.coalesce(resource(F.col("url")), F.concat(F.lit("#"), F.col("page_id").cast("string"))).alias("node"))
    own = own.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    out = own.join(aliases, "node", "left")
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", "alias_verdict", F.lit(default)).alias("verdict"),
        (F.col("fit").isNull() & F.col("alias_verdict").isNotNull()).alias("by_alias"),
    )
