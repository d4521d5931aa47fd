"""What the operators of this subpackage share: the shared working folder and lookups from Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only where it is unset (tests on one machine) a temporary one."""
    name = spark.conf.get("spark.checkpoint.dir", None)
    if not name and not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not name:
        name = "file://" + tempfile.mkdtemp(prefix="pagelathe-")
        spark.conf.set("spark.checkpoint.dir", name)
        atexit.register(shutil.rmtree, name.removeprefix("file://"), True)
    at = spark._jvm.org.apache.hadoop.fs.Path(name)  # with its scheme, so that Spark and pyarrow take it for the same
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 4) -> None:
    """Has Spark hand at most so many rows, and bytes of longer texts, at once to Python workers: executors are small.

    Both are settings of the session; one that is lower already stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    known = spark.conf.get(name).strip().lower().removesuffix("b")
    if not known.isdigit() or not 0 < int(known) <= megabytes << 20:
        spark.conf.set(name, str(megabytes << 20))


def give_back() -> None:
    """Returns what a Python worker has freed to the system, as workers stay for later tasks and stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: What a worker keeps between tasks, and how to drop each: emptied when the worker has been idle for IDLE seconds.
KEPT: dict[str, Callable[[], None]] = {}
IDLE = 2.0
_RESTING = threading.Lock()
_timers: list[threading.Timer] = []


def _rest(mine: threading.Timer) -> None:
    with _RESTING:
        if _timers and _timers[-1] is mine:
            for drop in KEPT.values():
                drop()
            give_back()


def _begin() -> None:
    with _RESTING:
        while _timers:
            _timers.pop().cancel()


def _end() -> None:
    give_back()
    timer = threading.Timer(IDLE, lambda: _rest(timer))
    timer.daemon = True
    _timers.append(timer)
    timer.start()


def tidy(run: Callable[[Iterator], Iterator], *forget: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """run (over the batches of a task), after which `forget` empties caches and memory is given back.

    What is in KEPT stays for a next task that follows soon, and is dropped otherwise, so that no stage pays for what
    an earlier one has loaded.
    """

    def over(parts: Iterator) -> Iterator:
        _begin()
        try:
            yield from run(parts)
        finally:
            for f in forget:
                f()
            _end()

    return over


class Scratch:
    """Tables of one run of an operator, under a fresh folder in the shared one.

    A table written here cuts the lineage and outlives lost executors.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def whole_text(name: str = "text") -> Column:
    """A text column with null counting as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def open_folder(uri: str):
    """A pyarrow file system and the path in it, for use in Python workers."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        raise ValueError(f"a folder without scheme: {uri}")
    return fs.FileSystem.from_uri(uri)


def slices(texts: list[str], chars: int) -> Iterator[slice]:
    """Neighbouring texts of at most so many characters together, or single longer ones."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > chars:
            yield slice(first, i)
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield slice(first, len(texts))


def sorted_ids(df: DataFrame, scratch: Scratch, name: str) -> str:
    """Writes the column `id` of df in ranges, sorted, so that a worker reads only the part that its rows need."""
    df.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct().sort("id").write.mode("overwrite").option("parquet.block.size", 4 << 20).parquet(scratch.path(name))
    return scratch.path(name)


def is_among(uri: str, held: int = 2_000_000, ahead: int = 50_000) -> Column:
    """A UDF that tells whether an id is in the sorted table at uri.

    A table of at most `held` ids is read once a task. Of a longer one the row groups are read, one at a time, that some
    `ahead` rows' ids fall in. So memory stays bounded however long the table is, and neither side is shuffled or broadcast.
    """

    def answers(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import pyarrow.dataset as ds

        system, path = open_folder(uri)
        table = ds.dataset(path, filesystem=system, format="parquet", exclude_invalid_files=False)
        empty = "id" not in table.schema.names
        whole = None if empty or table.count_rows() > held else np.sort(table.to_table(columns=["id"]).column(0).to_numpy())

        def answer(ids: pd.Series) -> pd.Series:
            out = np.zeros(len(ids), bool)
            known = ids.notna().to_numpy()
            want = ids[known].to_numpy(np.int64)
            if whole is not None and len(whole):
                out[known] = whole[np.minimum(np.searchsorted(whole, want), len(whole) - 1)] == want
            elif whole is None and not empty and len(want):
                found = np.zeros(len(want), bool)
                near = (ds.field("id") >= int(want.min())) & (ds.field("id") <= int(want.max()))
                for part in table.to_batches(columns=["id"], filter=near, batch_size=1 << 17):
                    found |= np.isin(want, part.column(0).to_numpy())
                out[known] = found
            return pd.Series(out)

        waiting: list[pd.Series] = []
        for ids in parts:
            waiting.append(ids)
            if whole is not None or sum(map(len, waiting)) >= ahead:
                yield answer(pd.concat(waiting, ignore_index=True))
                waiting = []
        if waiting:
            yield answer(pd.concat(waiting, ignore_index=True))

    @F.pandas_udf(T.BooleanType())
    def among(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidy(answers)(parts)

    return among


def over_among(docs: DataFrame, uri: str, run: Callable[[Iterator], Iterator], schema: str, held: int = 2_000_000) -> DataFrame:
    """docs.mapInPandas(run) for the rows whose doc_id (long) is in the sorted table at uri; one Python worker a task if it has at most `held` ids."""
    if docs.sparkSession.read.schema("id long").parquet(uri).count() > held:
        return docs.where(is_among(uri, held)("doc_id")).mapInPandas(tidy(run), schema)

    def some(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.dataset as ds

        system, path = open_folder(uri)
        table = ds.dataset(path, filesystem=system, format="parquet", exclude_invalid_files=False)
        ids = np.sort(table.to_table(columns=["id"]).column(0).to_numpy()) if "id" in table.schema.names else np.empty(0, np.int64)
        for part in parts:
            known = part["doc_id"].notna().to_numpy()
            want = part["doc_id"].to_numpy(np.int64, na_value=0) if known.all() else part["doc_id"].fillna(0).to_numpy(np.int64)
            if len(ids):
                found = known & (ids[np.minimum(np.searchsorted(ids, want), len(ids) - 1)] == want)
                if found.any():
                    yield part[found]

    return docs.mapInPandas(tidy(lambda parts: run(some(parts))), schema)


def runs_equal(key: np.ndarray):
    """Pairs of positions with equal key in a sorted array, lag by lag."""
    at = np.arange(len(key) - 1)
    lag = 1
    while len(at):
        at = at[at + lag < len(key)]
        at = at[key[at] == key[at + lag]]
        if len(at):
            yield at, at + lag
        lag += 1
