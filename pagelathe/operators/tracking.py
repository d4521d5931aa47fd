"""Elements followed through redesigns: a store of fingerprints as a table (site, name, print), read and written by joins.

A page's element is looked for with the fingerprint that the store has for its site. What pages of one site have
learned meets in one row by a partial aggregate, whatever their number: the last page's fingerprint, and whether the
texts differed anywhere.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import track as T
from ..functions.html import parse
from ..functions.xpath import XPathError

RUN = "struct<state:string,score:double,values:array<string>,print:string>"


def fingerprint(html: Column, query: str) -> Column:
    """The fingerprint, as JSON, of the element that a query finds; null without any."""
    return run(html, F.lit(None).cast("string"), T.Tracker("", query))["print"]


def run(html: Column, known: Column, tracker: T.Tracker, least: float = T.THRESHOLD) -> Column:
    """RUN of a tracked query on pages, with the fingerprints (JSON or null) known before; null without a page, and where the query finds something else than elements."""

    @F.pandas_udf(RUN)
    def over(htmls: pd.Series, prints: pd.Series) -> pd.DataFrame:
        rows = []
        for html, text in zip(htmls, prints):
            try:
                if html is None:
                    raise XPathError("no page")
                state, score, values, now = tracker.run(parse(html), T.from_json(text), least)
                rows.append((state, score, values, now and now.to_json()))
            except XPathError:
                rows.append((None, None, None, None))
        return pd.DataFrame(rows, columns=["state", "score", "values", "print"]).astype({"score": "float64"})

    return over(html, known)


def scores(known: Column, other: Column) -> Column:
    """The score between two fingerprints (JSON); null where one is none."""

    @F.pandas_udf("double")
    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        both = [(T.from_json(x), T.from_json(y)) for x, y in zip(a, b)]
        return pd.Series([T.score(x, y) if x and y else None for x, y in both], dtype="float64")

    return over(known, other)


def tracked(pages: DataFrame, store: DataFrame, name: str, query: str, least: float = T.THRESHOLD) -> DataFrame:
    """pages (site, html and more) with `track` (RUN) of a query that is followed under a name."""
    tracker = T.Tracker(name, query)
    known = store.where(F.col("name") == name).select(F.col("site").alias("_site"), F.col("print").alias("_print"))
    joined = pages.join(known, pages["site"] == known["_site"], "left")
    return joined.withColumn("track", run(F.col("html"), F.col("_print"), tracker, least)).drop("_site", "_print")


def upserted(store: DataFrame, pages: DataFrame, name: str, order: str) -> DataFrame:
    """The store after `tracked` pages (site, track, and a column that orders them); rows that don't change are kept as they are."""
    fields = "text string, preceding string, text_varies boolean, preceding_varies boolean"
    matched = pages.where("track.print is not null").select("site", F.col(order).alias("_at"), F.col("track.print").alias("print"))
    seen = matched.withColumn("p", F.from_json("print", fields)).groupBy("site").agg(
        F.max_by("print", "_at").alias("print"),
        (F.bool_or("p.text_varies") | (F.min("p.text") != F.max("p.text"))).alias("t"),
        (F.bool_or("p.preceding_varies") | (F.min("p.preceding") != F.max("p.preceding"))).alias("v"),
    )

    def said(text: Column, key: str, value: Column) -> Column:
        return F.when(value, F.regexp_replace(text, f'"{key}": false', f'"{key}": true')).otherwise(text)

    fresh = seen.select("site", F.lit(name).alias("name"), said(said(F.col("print"), "text_varies", F.col("t")), "preceding_varies", F.col("v")).alias("print"))
    return store.join(fresh.select("site", "name"), ["site", "name"], "left_anti").select("site", "name", "print").union(fresh)


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows of a store that have to be written."""
    return after.join(before.select("site", "name", "print"), ["site", "name", "print"], "left_anti")


def reports(pages: DataFrame, name: str) -> DataFrame:
    """(site, name, what, score): once for each site, that a tracked element was relocated or lost, with its least score."""
    found = pages.where("track.state in ('relocated', 'lost')")
    return found.groupBy("site", F.lit(name).alias("name"), F.col("track.state").alias("what")).agg(F.min("track.score").alias("score"))
