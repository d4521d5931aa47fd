"""Token counts of the documents in flat token files that have no index.

`write_flat` encodes documents and writes them as files of little-endian 16-bit identifiers, each document closed by
the end-of-document identifier, with a manifest of what stands in which order. `count_tokens` needs the files alone:
it deals out blocks of them, finds the separators of a block with one vectorised comparison, and stitches documents
that cross blocks with a prefix scan over the blocks: the sum of the separators before a block numbers its
documents, and the maximum of their places tells where the document began that is open at its start. The scan runs
in two levels (`SPAN` blocks, then the spans), so that no task holds all blocks of a long file.

Defined results. Null and empty texts have no tokens and are counted as such. The end-of-document identifier never
stands in a text, whose special strings are encoded as ordinary text. Tokens after a file's last separator are a
last document. Repeated rows are each counted. Other columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import KEPT, Scratch, open_folder, tidy, whole_text

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END, BLOCK, SPAN = 50256, 1 << 20, 1024
_ENCODINGS: dict = {}
KEPT["encodings"] = _ENCODINGS.clear


def encoding(path: str):
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        _ENCODINGS[path] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def write_flat(docs: DataFrame, folder: str, scratch: Scratch, vocabulary: str = VOCABULARY) -> DataFrame:
    """Writes the files under folder, one for each task that succeeds, and returns the manifest (file, ordinal, doc_id).

    An attempt writes a file of its own name; only those in the manifest, which Spark commits once, count.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(vocabulary).encode_ordinary
        system, path = open_folder(folder)
        system.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.tokens"
        with system.open_output_stream(f"{path}/{name}") as out:
            at = 0
            for part in parts:
                for text in part["text"]:
                    out.write(np.array([*encode(text), END], "<u2").tobytes())
                yield pd.DataFrame({"file": name, "ordinal": np.arange(at, at + len(part)), "doc_id": part["doc_id"].astype("Int64")})
                at += len(part)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return scratch.keep(rows.mapInPandas(tidy(run), "file string, ordinal long, doc_id long"), "manifest")


def separators(folder: str, end: int, block: int):
    """A function for mapInPandas: (file, block_no, tokens) to the places of the separators of each block."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = open_folder(folder)
        for part in parts:
            for file, no, tokens in zip(part["file"], part["block_no"], part["tokens"]):
                start = no * block
                with system.open_input_file(f"{path}/{file}") as source:
                    ids = np.frombuffer(source.read_at(2 * int(min(block, tokens - start)), 2 * int(start)), "<u2")
                yield pd.DataFrame({"file": [file], "block_no": [no], "tokens": [tokens], "places": [np.flatnonzero(ids == end) + start]})

    return run


def sizes(folder: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = open_folder(folder)
        for part in parts:
            yield pd.DataFrame({"file": part["file"], "tokens": [system.get_file_info(f"{path}/{f}").size // 2 for f in part["file"]]})

    return run


def count_tokens(files: DataFrame, folder: str, scratch: Scratch, end: int = END, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """(file, ordinal, n_tokens) of the documents in files (file), in their order."""
    spark = files.sparkSession
    known = scratch.keep(files.select("file").distinct().mapInPandas(sizes(folder), "file string, tokens long"), "sizes")
    blocks = known.where("tokens > 0").select("file", "tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / block))).alias("block_no"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = blocks.repartition(n).mapInPandas(separators(folder, end, block), "file string, block_no long, tokens long, places array<long>")
    found = scratch.keep(found, "places")
    each = found.select("file", "block_no", "tokens", F.size("places").alias("n"), F.array_max("places").alias("last"), F.floor(F.col("block_no") / span).alias("span"))
    inside = W.partitionBy("file", "span").orderBy("block_no").rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy("file").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    spans = each.groupBy("file", "span").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    spans = spans.select("file", "span", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("n0"), F.max("last").over(across).alias("last0"))
    scanned = each.select("file", "span", "block_no", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("n1"), F.max("last").over(inside).alias("last1"))
    carried = scanned.join(spans, ["file", "span"]).select("file", "block_no", (F.col("n0") + F.col("n1")).alias("before"), F.coalesce(F.greatest("last0", "last1"), F.lit(-1)).alias("open"))
    whole = found.join(carried, ["file", "block_no"]).select("file", "before", "open", "places", F.posexplode("places").alias("i", "place"))
    whole = whole.select("file", (F.col("before") + F.col("i")).alias("ordinal"), (F.col("place") - F.when(F.col("i") == 0, F.col("open")).otherwise(F.expr("get(places, i - 1)")) - 1).alias("n_tokens"))
    ends = each.groupBy("file").agg(F.max("tokens").alias("tokens"), F.max("last").alias("last"), F.sum("n").alias("ordinal"))
    rest = (F.col("tokens") - F.coalesce("last", F.lit(-1)) - 1).alias("n_tokens")
    return whole.union(ends.select("file", "ordinal", rest).where("n_tokens > 0"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and n_tokens of every document."""
    scratch = Scratch(spark, "tokens")
    folder = scratch.path("flat")
    manifest = write_flat(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, scratch)
    counts = count_tokens(manifest.select("file"), folder, scratch)
    return manifest.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
