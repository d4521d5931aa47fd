"""Link-graph plans: admission to a frontier, and expansion of a crawl over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C


def admitted(requests: DataFrame, seen: DataFrame | None = None, allowed: list[str] = (), max_depth: int | None = None, per_host: int | None = None, unfiltered: str | None = None) -> DataFrame:
    """requests (url, depth, seq) with canonical, fp, host, and `reason`: null for those admitted, else the first test that fails.

    The tests in order: invalid, offsite, depth, trap, seen (before or earlier in requests), host cap. `unfiltered` is a
    boolean column of requests that are spared the tests offsite and seen.
    """
    spared = F.coalesce(F.col(unfiltered), F.lit(False)) if unfiltered else F.lit(False)
    r = requests.withColumn("canonical", C.canonical(F.col("url")))
    r = r.withColumn("fp", F.substring(F.sha2(F.concat(F.lit("GET "), F.col("canonical")), 256), 1, 32)).withColumn("host", C.canonical_host(F.col("canonical")))
    path = F.regexp_extract("canonical", "^[a-z]+://[^/]*([^?#]*)", 1)
    reason = F.when(F.col("canonical").isNull(), "invalid")
    reason = reason.when(~spared & C.canonical_offsite(F.col("canonical"), list(allowed)), "offsite") if allowed else reason
    reason = reason.when(F.col("depth") > max_depth, "depth") if max_depth is not None else reason
    r = r.withColumn("reason", reason.when(C.repeats(path), "trap"))
    # the first of a fingerprint by a partial aggregate: no window over a hot key
    firsts = r.where(F.col("reason").isNull() & ~spared).groupBy("fp").agg(F.min("seq").alias("_first"))
    if seen is not None:
        firsts = firsts.join(seen.select("fp").distinct(), "fp", "left_anti")
    r = r.join(firsts, "fp", "left").withColumn("reason", F.when(F.col("reason").isNull() & ~spared & ~(F.col("seq").eqNullSafe(F.col("_first"))), "seen").otherwise(F.col("reason"))).drop("_first")
    if per_host is not None:
        # of a hot host each task keeps per_host rows only before they are brought together
        ranked = r.where("reason is null").select("fp", "seq", F.row_number().over(W.partitionBy("host").orderBy("seq")).alias("_rank"))
        within = ranked.where(F.col("_rank") <= per_host).select("fp", "seq", F.lit(True).alias("_within"))
        r = r.join(within, ["fp", "seq"], "left").withColumn("reason", F.when(F.col("reason").isNull() & F.col("_within").isNull(), "host cap").otherwise(F.col("reason"))).drop("_within")
    return r


def counted(decided: DataFrame, column: str = "reason") -> DataFrame:
    """(reason, n) of requests or outcomes: the counters of a crawl."""
    return decided.groupBy(column).agg(F.count("*").alias("n"))


def redirected(start: DataFrame, hops: DataFrame, keep, most: int = 20) -> DataFrame:
    """(url, last, hops, loop) of each URL of start (url): where the redirects (source, target) lead, by at most `most` joins.

    A chain that is longer, or comes back to where it was, ends with `loop`. keep(df, name) writes a table and reads it again.
    """
    once = hops.groupBy("source").agg(F.min("target").alias("target"))
    now = start.select("url", F.col("url").alias("last"), F.lit(0).alias("hops"), F.array("url").alias("path"))
    done = None
    for turn in range(most + 1):
        step = keep(now.join(once, now["last"] == once["source"], "left").drop("source"), f"hops{turn}")
        ended = step.where("target is null or array_contains(path, target)" if turn < most else "true").select("url", "last", "hops", F.col("target").isNotNull().alias("loop"))
        done = ended if done is None else done.union(ended)
        now = step.where("target is not null and not array_contains(path, target)").select("url", F.col("target").alias("last"), (F.col("hops") + 1).alias("hops"), F.array_append("path", F.col("target")).alias("path"))
        if turn < most and now.isEmpty():
            break
    return done


def reached(seeds: DataFrame, links: DataFrame, max_depth: int, keep) -> DataFrame:
    """(url, depth): canonical URLs within max_depth links (source, target) of seeds (url), by anti-joins on what is known.

    keep(df, name) writes a table and reads it again, so that each round's plan stays short.
    """
    known = keep(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "reached0")
    edge = known
    for depth in range(1, max_depth + 1):
        step = edge.join(links, edge["url"] == links["source"]).select(F.col("target").alias("url")).where("url is not null").distinct()
        edge = keep(step.join(known, "url", "left_anti").withColumn("depth", F.lit(depth)), f"reached{depth}")
        if edge.isEmpty():
            break
        known = known.union(edge)
    return known
