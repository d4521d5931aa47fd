"""Sources: pages, responses, and sitemaps as rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policy


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(spark: SparkSession, megabytes: int = 4) -> None:
    """Has Spark hand at most so many bytes (and a row) at once to a Python worker, which holds them and what it makes of them, whatever the table's size.

    This is a setting of the session; one that is lower already stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    known = spark.conf.get(name).strip().lower().removesuffix("b")
    if not known.isdigit() or not 0 < int(known) <= megabytes << 20:
        spark.conf.set(name, str(megabytes << 20))


def responses(pages: DataFrame) -> DataFrame:
    """Pages as responses: url, status, version, headers, body."""
    headers = F.array(F.struct(F.lit("content-type").alias("name"), F.lit("text/html; charset=utf-8").alias("value")))
    return pages.select("url", F.lit(200).alias("status"), F.lit("HTTP/1.1").alias("version"), headers.alias("headers"), F.col("html").cast("binary").alias("body"))


ENTRY = "array<struct<loc:string,lastmod:string,changefreq:string,priority:double,alternates:array<string>>>"


def sitemap_entries(files: DataFrame) -> DataFrame:
    """(url, kind, loc, lastmod, changefreq, priority, alternates) of sitemap files (url, body)."""

    @F.pandas_udf(f"struct<kind:string,entries:{ENTRY}>")
    def read(bodies: pd.Series) -> pd.DataFrame:
        found = [policy.sitemap(b) for b in bodies]
        return pd.DataFrame({"kind": [k for k, _ in found], "entries": [[e._asdict() for e in es] for _, es in found]})

    return files.select("url", read("body").alias("map")).select("url", "map.kind", F.inline_outer("map.entries"))
