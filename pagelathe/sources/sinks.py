"""Sinks for items: JSON Lines, CSV and Parquet, with a schema inferred from JSON items."""

from __future__ import annotations

from pathlib import PurePath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(df: DataFrame) -> DataFrame:
    """Decimals and times as text, NaN and infinities as null: what JSON can hold."""

    def one(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(f.name)
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("string").alias(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            pattern = "yyyy-MM-dd" if isinstance(f.dataType, T.DateType) else "yyyy-MM-dd'T'HH:mm:ss"
            return F.date_format(c, pattern).alias(f.name)
        return c

    return df.select(*[one(f) for f in df.schema.fields])


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for CSV."""
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f"`{f.name}`") for f in plain(df).schema.fields])


def extras(items: DataFrame, fields: list[str]) -> DataFrame:
    """(key, n): the keys of items (item: JSON text) that are none of fields, and how many rows have each."""
    keys = items.select(F.explode(F.json_object_keys("item")).alias("key"))
    return keys.where(~F.col("key").isin(*fields)).groupBy("key").agg(F.count("*").alias("n"))


def write(df: DataFrame, path: str, mode: str = "errorifexists", fields: list[str] | None = None) -> None:
    """Writes by the path's ending: .jsonl, .jl, .csv or .parquet; `fields` are the columns and their order, lacking ones null."""
    if fields is not None:
        df = df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields])
    kind = PurePath(path).suffix.lower()
    if kind in (".jsonl", ".jl"):
        plain(df).write.mode(mode).option("ignoreNullFields", "false").json(path)
    elif kind == ".csv":
        flat(plain(df)).write.mode(mode).option("header", "true").option("emptyValue", "").csv(path)
    elif kind == ".parquet":
        df.write.mode(mode).option("compression", "snappy").parquet(path)
    else:
        raise ValueError(f"no sink for {path!r}: use .jsonl, .jl, .csv or .parquet")


def kinds(items: DataFrame) -> DataFrame:
    """(key, kinds): the JSON kinds of each key of items (item: JSON text), over all rows."""
    pairs = items.select(F.explode(F.from_json("item", "map<string,variant>")).alias("key", "value"))
    kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    return pairs.groupBy("key").agg(F.array_sort(F.collect_set(kind)).alias("kinds"))


#: How kinds merge: integers with floats to double, any other mix and nulls alone to text.
_KINDS = {"BIGINT": "bigint", "DOUBLE": "double", "DECIMAL": "double", "FLOAT": "double", "BOOLEAN": "boolean", "STRING": "string"}


def merged(found: list[str]) -> str:
    known = {_KINDS.get(k, "string") for k in found if k != "VOID"}
    return known.pop() if len(known) == 1 else "double" if known == {"bigint", "double"} else "string"


def inferred(items: DataFrame, most: int = 10_000) -> list[tuple[str, str]]:
    """(key, type) of the schema of items, in the order of keys; more than `most` keys are data, not a schema, and an error."""
    found = kinds(items).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"items have more than {most} keys")
    return sorted((r["key"], merged(r["kinds"])) for r in found)


def typed(items: DataFrame, schema: list[tuple[str, str]] | None = None) -> DataFrame:
    """Items (item: JSON text) as columns of the inferred types; what does not fit is null."""
    schema = inferred(items) if schema is None else schema
    v = F.try_parse_json("item")

    def one(key: str, kind: str) -> Column:
        path = "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']"
        if kind == "string":
            value = F.try_variant_get(v, F.lit(path), "variant")
            return F.coalesce(F.try_variant_get(v, F.lit(path), "string"), F.to_json(value)).alias(key)
        return F.try_variant_get(v, F.lit(path), kind).alias(key)

    return items.select(*[one(k, kind) for k, kind in schema])


def misfits(items: DataFrame, schema: list[tuple[str, str]] | None = None) -> DataFrame:
    """(key, missing, wrong): rows without a key, and rows whose value does not fit its type; one pass over the rows."""
    schema = inferred(items) if schema is None else schema
    has = F.from_json("item", "map<string,variant>")
    pairs = items.select(F.explode(has).alias("key", "value"))
    kind = F.create_map(*[F.lit(x) for row in schema for x in row])[F.col("key")] if schema else F.lit(None).cast("string")
    fits = F.when(kind == "bigint", F.try_variant_get("value", F.lit("$"), "bigint").isNotNull()).when(kind == "double", F.try_variant_get("value", F.lit("$"), "double").isNotNull()).when(kind == "boolean", F.try_variant_get("value", F.lit("$"), "boolean").isNotNull()).otherwise(F.lit(True))
    wrong = (F.schema_of_variant("value") != "VOID") & ~fits
    found = pairs.groupBy("key").agg(F.count("*").alias("n"), F.count_if(wrong).alias("wrong"))
    known = items.sparkSession.createDataFrame([(k,) for k, _ in schema], "key string")
    rows = items.count()
    return known.join(found, "key", "left").select("key", (F.lit(rows) - F.coalesce("n", F.lit(0))).alias("missing"), F.coalesce("wrong", F.lit(0)).alias("wrong"))
