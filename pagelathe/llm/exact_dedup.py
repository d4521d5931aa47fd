"""Exact deduplication against a persistent index of digests.

The index is a Parquet table of one row per text (digest, keep_id, copies), bucketed and sorted by digest.
A batch is reduced to one row per digest before it meets the index, so that no key is hot in the sort-merge
anti-join; what the index lacks is appended to it.

Defined results. Null texts count as empty texts and are copies of each other. A text that the index holds from
an earlier batch keeps its earlier keep_id; within a batch the largest doc_id stays. Null doc_ids lose against any
other; if all are null, keep_id is null and the rows count as kept. Rows that repeat both doc_id and text are
each reported; `drop_copies` keeps one of them. Other columns are carried by `drop_copies` and not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, whole_text

FIELDS = "digest binary, keep_id bigint, copies bigint"


class DigestIndex:
    """The index at `path`; `name` is its name in the session's catalogue."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64):
        self.spark, self.name, self.path = spark, name, path
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({FIELDS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")
        self.buckets = buckets

    def lacking(self, groups: DataFrame) -> DataFrame:
        """The rows of groups (FIELDS) whose digest the index lacks; the index is neither shuffled nor sorted."""
        return groups.join(self.spark.table(self.name).select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        fresh = self.lacking(groups).select("digest", "keep_id", "copies")
        fresh.repartition(self.buckets, "digest").write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").option("path", self.path).saveAsTable(self.name)

    def forget(self) -> None:
        """Takes the name from the catalogue; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(whole_text().cast("binary"), 256)).alias("digest"))


def exact_dedup(docs: DataFrame, index: DigestIndex, scratch: Scratch) -> DataFrame:
    """A row per row of docs: doc_id, keep_id, group_size, kept, text_sha256; index gets the new texts."""
    batch = scratch.keep(digests(docs), "digests")
    groups = scratch.keep(batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("copies")), "groups")
    earlier = scratch.keep(index.spark.table(index.name).join(groups.select("digest"), "digest", "left_semi"), "earlier")
    index.append(groups)
    owner = groups.join(earlier.select("digest", F.col("keep_id").alias("before"), F.lit(True).alias("old")), "digest", "left")
    owner = scratch.keep(owner.select("digest", F.when(F.col("old"), F.col("before")).otherwise(F.col("keep_id")).alias("keep_id"), "copies"), "owners")
    return batch.join(owner, "digest").select(
        "doc_id",
        "keep_id",
        F.col("copies").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def new_index(spark: SparkSession, scratch: Scratch) -> DigestIndex:
    name = "digests_" + scratch.root.rpartition("-")[2]
    return DigestIndex(spark, name, scratch.path("index"), max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "exact")
    index = new_index(spark, scratch)
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), index, scratch)
    index.forget()
    return out


def drop_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without the rows that `exact_dedup` drops, and with one of the rows that repeat doc_id and text."""
    scratch = Scratch(spark, "exact")
    index = new_index(spark, scratch)
    report = exact_dedup(docs, index, scratch)
    index.forget()
    verdict = report.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("times"))
    verdict = scratch.keep(verdict.where("not kept or times > 1").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), F.col("kept").alias("__kept")), "verdict")
    mine = docs.withColumn("__text_sha", F.sha2(whole_text().cast("binary"), 256))

    def same(part: DataFrame):
        return mine["__text_sha"].eqNullSafe(part["__sha"]) & mine["doc_id"].cast("long").eqNullSafe(part["__id"])

    # a sort-merge join at every size: what must go grows with the input
    once = mine.join(verdict.hint("merge"), same(verdict), "left_anti").select(*[mine[c] for c in docs.columns])
    repeated = verdict.where("__kept")
    if repeated.isEmpty():
        return once
    again = mine.join(repeated, same(repeated), "left_semi").dropDuplicates(["__text_sha", "doc_id"])
    return once.unionByName(again.select(*docs.columns))


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
