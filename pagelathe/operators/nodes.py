"""Nodes as rows: axes as joins on the interval encoding, positions as windows, selections as semi-joins.

All joins are on page_id and an interval or parent within it. A page's nodes are bounded by the page, so that a hot
page cannot exist; what grows with the data is the number of page_ids, by which everything is partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C


def nodes(pages: DataFrame, tags: tuple[str, ...] | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """page_id, url, ord, parent, end, depth, kind, tag, attrs, data: one row for each node of pages (page_id, url, html), of some tags and kinds alone if given."""
    return pages.select("page_id", "url", F.inline(C.nodes(F.col("html"), tags, kinds)))


def along(nodes: Column, name: str, context, wanted) -> Column:
    """array<struct<context_ord, position, node>>: an axis within the array of a page's nodes, without a join.

    context and wanted tell by a node (a column) which nodes it starts from and which it leads to.
    """
    of = lambda a: {k: a[k] for k in ("ord", "parent", "end")}

    def one(a: Column) -> Column:
        found = F.filter(nodes, lambda b: _AXES[name](of(a), of(b)) & wanted(b))
        found = F.reverse(found) if name in REVERSE else found
        return F.transform(found, lambda b, i: F.struct(a["ord"].alias("context_ord"), (i + 1).alias("position"), b.alias("node")))

    return F.flatten(F.transform(F.filter(nodes, context), one))


def lying(nodes: Column, name: str, context, wanted) -> Column:
    """The nodes of a page's array that lie on an axis of some context node, each once: the CSS combinators without a join."""
    of = lambda a: {k: a[k] for k in ("ord", "parent", "end")}
    return F.filter(nodes, lambda b: wanted(b) & F.exists(nodes, lambda a: context(a) & _AXES[name](of(a), of(b))))


def attr(name: str) -> Column:
    return F.get(F.filter("attrs", lambda a: a["name"] == name), F.lit(0))["value"]


def elements(n: DataFrame, tag: str | None = None, cls: str | None = None) -> DataFrame:
    out = n.where("kind = 'element'")
    out = out.where(F.col("tag") == tag) if tag else out
    return out.where(F.array_contains(F.split(attr("class"), r"\s+"), cls)) if cls else out


#: axis: condition on the context a and the node b
_AXES = {
    "descendant": lambda a, b: (b["ord"] > a["ord"]) & (b["ord"] < a["end"]),
    "descendant-or-self": lambda a, b: (b["ord"] >= a["ord"]) & (b["ord"] < a["end"]),
    "child": lambda a, b: b["parent"] == a["ord"],
    "parent": lambda a, b: b["ord"] == a["parent"],
    "ancestor": lambda a, b: (b["ord"] < a["ord"]) & (b["end"] > a["ord"]),
    "ancestor-or-self": lambda a, b: (b["ord"] <= a["ord"]) & (b["end"] > a["ord"]),
    "following-sibling": lambda a, b: (b["parent"] == a["parent"]) & (b["ord"] > a["ord"]),
    "preceding-sibling": lambda a, b: (b["parent"] == a["parent"]) & (b["ord"] < a["ord"]),
    "following": lambda a, b: b["ord"] >= a["end"],
    "preceding": lambda a, b: b["end"] <= a["ord"],
    "self": lambda a, b: b["ord"] == a["ord"],
}
REVERSE = ("ancestor", "ancestor-or-self", "preceding", "preceding-sibling", "parent")


def axis(context: DataFrame, n: DataFrame, name: str) -> DataFrame:
    """Pairs: the nodes of an axis with `context_ord`, numbered outwards as `position`."""
    a = context.select("page_id", "ord", "parent", "end").distinct().alias("a")
    b = n.alias("b")
    on = (F.col("a.page_id") == F.col("b.page_id")) & _AXES[name](*({k: F.col(f"{t}.{k}") for k in ("ord", "parent", "end")} for t in "ab"))
    order = F.col("ord").desc() if name in REVERSE else F.col("ord").asc()
    out = a.join(b, on).select("b.*", F.col("a.ord").alias("context_ord"))
    return out.withColumn("position", F.row_number().over(W.partitionBy("page_id", "context_ord").orderBy(order)))


def under(n: DataFrame, context: DataFrame, name: str = "descendant") -> DataFrame:
    """The nodes that lie on an axis of some context node, each once: the CSS combinators."""
    a = context.select(F.col("page_id").alias("_page"), F.col("ord").alias("_ord"), F.col("parent").alias("_parent"), F.col("end").alias("_end"))
    on = (n["page_id"] == a["_page"]) & _AXES[name]({"ord": a["_ord"], "parent": a["_parent"], "end": a["_end"]}, n)
    return n.join(a, on, "left_semi")


def outermost(n: DataFrame) -> DataFrame:
    """Without nodes that lie in another one of n."""
    a = n.select(F.col("page_id").alias("_page"), F.col("ord").alias("_ord"), F.col("end").alias("_end"))
    return n.join(a, (n["page_id"] == a["_page"]) & (n["ord"] > a["_ord"]) & (n["ord"] < a["_end"]), "left_anti")


def nth_child(n: DataFrame) -> DataFrame:
    """Elements with `nth` and `nth_last` among their siblings, and `nth_of_type`."""
    same = W.partitionBy("page_id", "parent")
    return elements(n).withColumns({"nth": F.row_number().over(same.orderBy("ord")), "nth_last": F.row_number().over(same.orderBy(F.desc("ord"))), "nth_of_type": F.row_number().over(W.partitionBy("page_id", "parent", "tag").orderBy("ord"))})


def string_values(context: DataFrame, n: DataFrame) -> DataFrame:
    """context with `text`, the texts below each in order."""
    texts = axis(context, n.where("kind = 'text'"), "descendant").groupBy("page_id", F.col("context_ord").alias("ord")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "data"))), lambda t: t["data"]), "").alias("text"))
    return context.join(texts, ["page_id", "ord"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def links(pages: DataFrame, selector: str = "a") -> DataFrame:
    """page_id, url, pos, href, target."""
    found = pages.select("page_id", "url", F.posexplode(C.links(F.col("html"), F.col("url"), selector)).alias("pos", "link"))
    return found.select("page_id", "url", "pos", F.col("link.href").alias("href"), F.col("link.url").alias("target"))
