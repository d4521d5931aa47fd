"""State of a crawl as tables of batches, so that a run can be killed anywhere and goes on with each item delivered once.

A folder holds `requests`, `done`, `items` and `counters`, each partitioned by batch. A batch is written under its
number and counts only when its row in `commits` stands, which is written last; what a killed batch left is overwritten
when its number is used again. Numbers rise; only those up to the last one that counts are ever read. So requests and their state, and items and counters, appear together or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUESTS = "fp string, url string, depth int, priority int, seq long"
DONE = "fp string, outcome string"
ITEMS = "_id string, item string"
COUNTERS = "counter string, n long"
TABLES = {"requests": REQUESTS, "done": DONE, "items": ITEMS, "counters": COUNTERS}


class Checkpoint:
    """The state under `path`, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def committed(self) -> DataFrame:
        """(batch) of the batches that count."""
        if not self._exists("commits"):
            return self.spark.createDataFrame([], "batch long")
        return self.spark.read.schema("batch long").parquet(f"{self.path}/commits")

    def next_batch(self) -> int:
        last = self.committed().agg(F.max("batch")).first()[0]
        return 0 if last is None else last + 1

    def read(self, name: str) -> DataFrame:
        """The rows of a table from the batches that count."""
        if not self._exists(name):
            return self.spark.createDataFrame([], TABLES[name] + ", batch long")
        rows = self.spark.read.schema(TABLES[name] + ", batch long").parquet(f"{self.path}/{name}").where(F.col("batch") < self.next_batch())
        return rows.join(self.committed(), "batch", "left_semi")

    def commit(self, batch: int, **tables: DataFrame) -> bool:
        """Writes tables under a batch; False, and nothing written, if the batch counts already."""
        if not self.committed().where(F.col("batch") == batch).isEmpty():
            return False
        for name, rows in tables.items():
            columns = [c.strip().split()[0] for c in TABLES[name].split(",")]
            rows.select(*columns).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        self.spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return True

    def pending(self) -> DataFrame:
        """Requests that are not done, the highest priority first, then the earliest: what a run goes on with."""
        return self.read("requests").join(self.read("done"), "fp", "left_anti").orderBy(F.desc("priority"), "seq")

    def seen(self) -> DataFrame:
        return self.read("requests").select("fp").distinct()

    def counted(self) -> DataFrame:
        return self.read("counters").groupBy("counter").agg(F.sum("n").alias("n"))

    def deliver(self, batch: int, items: DataFrame, done: DataFrame | None = None, requests: DataFrame | None = None) -> bool:
        """Commits the items (_id, item) that no earlier batch delivered, each once, with what is done and newly requested."""
        fresh = items.groupBy("_id").agg(F.min("item").alias("item")).join(self.read("items").select("_id"), "_id", "left_anti")
        tables = {"items": fresh, "counters": fresh.agg(F.lit("items").alias("counter"), F.count("*").alias("n"))}
        if done is not None:
            tables["done"] = done
        if requests is not None:
            tables["requests"] = requests.join(self.seen(), "fp", "left_anti").dropDuplicates(["fp"])
        return self.commit(batch, **tables)

    def sink(self, key: str = "_id", item: str = "item"):
        """A function for `foreachBatch`: a stream's items, each once, however often a batch is repeated."""

        def write(rows: DataFrame, batch: int) -> None:
            self.deliver(batch, rows.select(F.col(key).alias("_id"), F.col(item).alias("item")))

        return write
