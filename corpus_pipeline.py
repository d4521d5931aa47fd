"""From raw documents to encoded training data, one operator a stage.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last keep
the columns of `documents` and drop rows. `run` writes what each stage keeps as Parquet in the shared folder and reads
it again for the next, so that a lost executor never repeats an earlier stage.

Defined results of all stages. Null texts count as empty. quality keeps texts without a character, rows without language
or doc_id, and everything if no label trusts any document. exact_dedup keeps of equal texts the row with the largest
doc_id (null is the least), and one of rows that repeat both; so one empty text stays. near_dedup keeps the least doc_id
of a component, and rows without doc_id. decontamination drops every row whose doc_id holds an item, and keeps rows
without doc_id. sentencepiece gives one row for each row. Empty tables give empty tables, columns beyond those of
`documents` are carried along by all but the last stage, whatever their names, and texts may be of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelathe.llm import decontaminate, exact_dedup, near_dedup, pieces, quality
from pagelathe.llm.common import Scratch


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model doesn't reject."""
    return quality.drop_poor(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_copies(spark, docs)


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.one_of_each(spark, docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces."""
    return pieces.encode(docs)


STAGES = [("quality", good), ("exact_dedup", distinct), ("near_dedup", apart), ("decontamination", clean), ("sentencepiece", encoded)]

#: The quality model, SimHash components and piece lattices have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
