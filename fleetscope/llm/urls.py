"""URL filter: rules by host and path, carried to aliases over redirect and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetscope.llm.frames import ascii_lower
from fleetscope.llm.graph import components
from fleetscope.session import checkpointed

#: (verdict, host, path); compiled into the plan, so a list of configuration size.
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """What makes two urls one node: host, path and query, without scheme and fragment; null without a host."""
    rest = F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(host_of(url) != "", F.concat(host_of(url), rest))


def absolute(link: Column, base: Column) -> Column:
    """A link seen from the page ``base``: absolute, host-relative, root-relative or relative to the page's folder."""
    scheme, origin = F.regexp_extract(base, r"^([^:/?#]*:)//", 1), F.regexp_extract(base, r"^([^:/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([^:/?#]*://[^/?#]*/(?:[^?#]*/)?)", 1)
    folder = F.when(folder != "", folder).otherwise(F.concat(origin, F.lit("/")))
    return (
        F.when(link.isNull() | (link == "") | link.startswith("#"), None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), None)
        .otherwise(F.concat(folder, link))
    )


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag, quoted or not; empty if there is none."""
    found = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1)
    return F.replace(F.trim(F.translate(found, "\"'", "")), F.lit("&amp;"), F.lit("&"))


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Return (url, link): canonical links and meta-refresh redirects of pages, outside comments and scripts. ``canonical`` may be one of several words
    of ``rel``; relative links start from the page's base element, if it has one."""
    visible = F.regexp_replace(html := F.col(html_col), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    shown = pages.where(html.rlike(r"(?i)canonical|http-equiv")).select(F.col(url_col).alias("url"), visible.alias("visible"))
    tags = shown.select("url", F.regexp_extract("visible", r"(?is)<base\b[^>]*>", 0).alias("base"),
                        F.explode(F.regexp_extract_all("visible", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"))
    names = F.split(F.lower(attribute(F.col("tag"), "rel")), r"[\x20\x09-\x0D]+")
    canonical = F.when(F.array_contains(names, "canonical"), attribute(F.col("tag"), "href"))
    refresh = F.when(F.lower(attribute(F.col("tag"), "http-equiv")) == "refresh",
                     F.regexp_extract(attribute(F.col("tag"), "content"), r"(?i)url\s*=\s*(.*)$", 1))
    # Stored in between, which also keeps the expressions small.
    found = checkpointed(tags.select("url", attribute(F.col("base"), "href").alias("base"), F.trim(F.coalesce(canonical, refresh)).alias("raw")).where("raw <> ''"))
    based = checkpointed(found.select("url", F.coalesce(absolute(F.col("base"), F.col("url")), "url").alias("base"), "raw"))
    return checkpointed(based.select("url", absolute(F.col("raw"), F.col("base")).alias("link")).where("link is not null"))


def _first_fit(rules: Sequence[tuple[str, str, str]], host: Column, path: Column, value) -> Column:
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1]), len(r[2]))):  # the longest is tried first
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        chosen = F.when(fits, F.lit(value(rule))).otherwise(chosen)
    return chosen


def judge(
    pages: DataFrame, links: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html", default: str = "allow",
) -> DataFrame:
    """Return (page_id, host, path, rule, verdict) for every page.

    A rule fits its host and all subdomains where the path begins with the rule's; the longest host, then
    path, wins and settles the page. Pages that no rule fits follow their aliases: connected components over (url, link) edges -
    canonical links and redirects, read from the pages unless ``links`` gives them - carry decisions. An allowed
    url anywhere in the component allows its unruled aliases, else a blocked one blocks them, else ``default`` holds.

    A null url or one without ``://`` has an empty host and path, fits no rule and gets ``default``. Null html has no links. Of rules of equal
    length the later one counts. Repeated rows each get their verdict; a null page_id stays null. Very long texts are searched once a pattern in
    their task.
    """
    links = page_links(pages, url_col, html_col) if links is None else links
    ends = checkpointed(
        links.select(F.explode(F.array("url", "link")).alias("url")).select("url", address(F.col("url")).alias("address"))
        .where("address is not null").distinct())
    edges = links.select(address(F.col("url")).alias("a"), address(F.col("link")).alias("b")).where("a is not null and b is not null")
    roots = components(edges)
    verdict_of = _first_fit(rules, host_of(F.col("url")), path_of(F.col("url")), lambda r: r[0])
    decided = (
        roots.join(ends, roots["node"] == ends["address"]).groupBy("root").agg(F.min(verdict_of).alias("carried"))  # allow < block
        .where("carried is not null")
    )
    carried = roots.join(decided, "root").select(F.col("node").alias("alias"), "carried")
    judged = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address(F.col("url")).alias("address"))
    host, path = F.col("host"), F.col("path")
    judged = judged.withColumn("rule", _first_fit(rules, host, path, lambda r: r[1] + r[2])).withColumn(
        "verdict", _first_fit(rules, host, path, lambda r: r[0]))
    return judged.join(carried, judged["address"] == carried["alias"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", "carried", F.lit(default)).alias("verdict"))
