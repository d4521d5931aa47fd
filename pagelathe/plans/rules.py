"""Crawl rules as data: which links pages give, who owns them, what is a page, gates by origin, and sitemaps.

All are plans over tables: pages and responses in, links and decisions out. Rules are few and live on the driver; a
page's links come from one parse, however many rules there are.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.extract import Field


class Follow(NamedTuple):
    """A link rule: a query for links, tests of the absolute links, and what becomes of the pages they lead to.

    `allow` and `deny` are Java patterns, found anywhere in a link. `follow` says whether the rules apply to those pages
    again: by default only if no fields are taken from them.
    """

    query: str
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    allow_domains: tuple[str, ...] = ()
    deny_domains: tuple[str, ...] = ()
    fields: tuple[Field, ...] = ()
    follow: bool | None = None
    priority: int = 0

    @property
    def follows(self) -> bool:
        return not self.fields if self.follow is None else self.follow


def takes(rule: Follow, link: Column) -> Column:
    """Whether a rule takes an absolute link."""
    out = F.lit(True)
    if rule.allow:
        out = out & F.exists(F.array(*map(F.lit, rule.allow)), lambda p: F.regexp_like(link, p))
    for p in rule.deny:
        out = out & ~F.regexp_like(link, F.lit(p))
    if rule.allow_domains:
        out = out & ~C.canonical_offsite(link, list(rule.allow_domains))
    if rule.deny_domains:
        out = out & C.canonical_offsite(link, list(rule.deny_domains))
    return F.coalesce(out, F.lit(False))


#: Media types of pages.
HTML = ("text/html", "application/xhtml+xml", "text/xml", "application/xml")


def not_a_page(status: Column, content_type: Column) -> Column:
    """Why rules leave a response alone: no success, or no HTML; null for pages. A response without type is a page."""
    kind = F.lower(F.trim(content_type))
    html = F.lit(False)
    for x in HTML:
        html = html | kind.startswith(x)
    return F.when(~status.between(200, 299), F.concat(F.lit("HTTP "), status.cast("string"))).when(kind.isNotNull() & ~html, F.concat(F.lit("not HTML ("), kind, F.lit(")")))


def taken(pages: DataFrame, rules: list[Follow]) -> DataFrame:
    """(page_id, pos, target, rule, priority, follow): each link of pages (page_id, url, html) once, under the first rule that takes it."""
    found = pages.select("page_id", C.rule_links(F.col("html"), F.col("url"), tuple(r.query for r in rules)).alias("links"))
    kept = F.filter("links", lambda x: _taken_by(x, rules))
    urls = F.transform("kept", lambda x: x["url"])
    first = F.filter("kept", lambda x, i: F.array_position(urls, x["url"]) == i + 1)  # of a page's links, which are few
    rows = found.select("page_id", kept.alias("kept")).select("page_id", F.posexplode(first).alias("pos", "x"))
    facts = F.array(*[F.struct(F.lit(r.priority).alias("priority"), F.lit(r.follows).alias("follow")) for r in rules])
    return rows.select("page_id", "pos", F.col("x.url").alias("target"), F.col("x.rule").alias("rule"), F.get(facts, F.col("x.rule"))["priority"].alias("priority"), F.get(facts, F.col("x.rule"))["follow"].alias("follow"))


def _taken_by(x: Column, rules: list[Follow]) -> Column:
    out = F.lit(False)
    for no, r in enumerate(rules):
        out = F.when(x["rule"] == no, takes(r, x["url"])).otherwise(out)
    return x["url"].isNotNull() & out


def items(pages: DataFrame, owners: DataFrame, rules: list[Follow]) -> dict[int, DataFrame]:
    """By rule with fields: (page_id, item) of the pages whose URL it owns; owners (url, rule)."""
    owned = pages.join(owners, "url")
    return {no: owned.where(F.col("rule") == no).select("page_id", C.item(F.col("html"), list(r.fields)).alias("item")) for no, r in enumerate(rules) if r.fields}


def origin(canonical: Column) -> Column:
    return F.regexp_extract(canonical, r"^(https?://(?:[^/?#@]*@)?[^/?#]*)", 1)


def robots_texts(files: DataFrame) -> DataFrame:
    """(origin, text) of fetched robots.txt files (origin, status, text): 2xx as they are, 4xx allow all, anything else disallows all."""
    text = F.when(F.col("status").between(200, 299), F.coalesce("text", F.lit(""))).when(F.col("status").between(400, 499), "").otherwise("User-agent: *\nDisallow: /")
    return files.groupBy("origin").agg(F.max(F.struct("status", text.alias("text"))).alias("x")).select("origin", F.col("x.text").alias("text"))


def gated(requests: DataFrame, robots: DataFrame, reservations: DataFrame | None = None, agent: str = "*") -> DataFrame:
    """requests (url in canonical form and more) with `gate`: null, `robots` or `tdm`, by their origins' files.

    robots (origin, status, text) and reservations (origin, text); an origin without robots file is disallowed, one
    without reservations is not reserved. A join on the origin: AQE splits an origin with a large share of the requests.
    """
    path = F.regexp_extract("url", "^https?://[^/?#]*([^#]*)", 1)
    r = requests.withColumn("_origin", origin(F.col("url")))
    files = robots_texts(robots).select(F.col("origin").alias("_origin"), F.col("text").alias("_robots"))
    r = r.join(files, "_origin", "left")
    gate = F.when(F.col("_robots").isNull() | ~C.robots_allowed(F.col("_robots"), F.lit(agent), F.when(path == "", "/").otherwise(path)), "robots")
    if reservations is not None:
        r = r.join(reservations.groupBy("origin").agg(F.max("text").alias("_tdm")).withColumnRenamed("origin", "_origin"), "_origin", "left")
        gate = gate.when(F.col("_tdm").isNotNull() & F.coalesce(C.tdm_reserved(F.col("_tdm"), path), F.lit(False)), "tdm")
    return r.withColumn("gate", gate).drop("_origin", "_robots", "_tdm")


def routed(entries: DataFrame, rules: list[tuple[str, str]], follow: list[str] = (".*",), alternates: bool = False, keep: Column | None = None) -> DataFrame:
    """(url, route) of sitemap entries (kind, loc, alternates): entries of an index that match `follow` go to `sitemap`,
    those of a sitemap to the first of rules (pattern, route) that matches; others are skipped. keep filters entries."""
    e = entries.where("loc is not null")
    e = e.where(keep) if keep is not None else e
    some = F.when(F.lit(alternates) & (F.col("kind") != "index"), F.concat(F.array("loc"), F.coalesce("alternates", F.array().cast("array<string>")))).otherwise(F.array("loc"))
    each = e.select("kind", F.explode(some).alias("url"))
    route = F.when(F.col("kind") == "index", F.when(F.exists(F.array(*map(F.lit, follow)), lambda p: F.regexp_like("url", p)), "sitemap"))
    for pattern, name in rules:
        route = route.when(F.regexp_like("url", F.lit(pattern)), name)
    return each.select("url", route.alias("route")).where("route is not null")


def piped(items: DataFrame, *stages, schema: str) -> DataFrame:
    """items through stages, functions of a dict that return one, or None to drop it; rows go through Arrow batches."""
    import pandas as pd

    names = [c.strip().split()[0] for c in schema.split(",")]

    def over(parts):
        for part in parts:
            out = []
            for row in part.to_dict("records"):
                for stage in stages:
                    row = stage(row)
                    if row is None:
                        break
                else:
                    out.append([row.get(k) for k in names])
            yield pd.DataFrame(out, columns=names)

    return items.mapInPandas(over, schema)
