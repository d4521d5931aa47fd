"""Benchmark decontamination with SimHash over item-sized windows.

Words are lower-cased runs of letters, digits and underscores; shingles are five words. A document is looked at
closely only around the shingles that it shares with an item, which loses nothing: a window without such a shingle
has similarity zero. There every window as long as an item gets a 256-bit SimHash, and the windows are indexed by
each of its sixteen 16-bit blocks, in which the item looks up its own block with up to three bits changed. By the
pigeonhole principle that finds every window within 63 bits of the item. Candidates are verified by their exact
weighted similarity, the sum of the lesser shingle counts over the sum of the greater ones.

The second and further occurrences of a shingle in a window count as shingles of their own in its SimHash, so that the
weighted similarity is the Jaccard similarity of what is hashed. Sets of similarity 0.8 have a cosine of 0.89 or more
and differ in 39 of 256 bits on average, with a standard deviation of 6; the radius lies four of those beyond. What
that loses is measured by the tests, which compare with all windows verified exactly for items of many lengths.

The items are the stated query set. They are read in blocks of bounded text, each of which is searched for in all
documents.

Defined results. One row per document and item of similarity 0.8 or more, with the best window (the earliest of
equal ones). Null texts are empty and match nothing, items without words match nothing, items of fewer than five
words are one shingle, documents shorter than an item are one window. Repeated rows of documents are each reported;
items that repeat an id are searched for under it, each on its own.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, small_batches, tidy, whole_text
from .words import word_hashes

WORDS, SIMILARITY, RADIUS_IN_BLOCK = 5, 0.8, 3
WORD = re.compile(r"\w+")
RESULT = "doc_id long, item_id long, similarity double, start_word int, end_word int"


def words_of(text: str) -> list[str]:
    """The words of a text; `word_hashes` has the same, in the same order."""
    return WORD.findall(text.lower())


def shingles(ids: np.ndarray, width: int = WORDS) -> np.ndarray:
    """Hashes of all runs of `width` words."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = (out ^ ids[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def signs(hashes: np.ndarray) -> np.ndarray:
    """256 signs (+1, -1) for each shingle."""
    four = np.empty((len(hashes), 4), np.uint64)
    for i in range(4):
        x = hashes + np.uint64((0xD1B54A32D192ED03 * (i + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        four[:, i] = x ^ (x >> np.uint64(31))
    return np.unpackbits(four.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def blocks_of(sums: np.ndarray) -> np.ndarray:
    """Rows of 256 sums to rows of sixteen 16-bit blocks."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


_FLIPS = np.array([sum(1 << b for b in c) for k in range(RADIUS_IN_BLOCK + 1) for c in combinations(range(16), k)], np.uint16)


def similarity(a: Counter, b: Counter) -> float:
    more = sum((a | b).values())
    return sum((a & b).values()) / more if more else 0.0


def marked(hashes: np.ndarray) -> np.ndarray:
    """Hashes of a window in which the second, third and further occurrence of a shingle are other shingles.

    As sets, what is so marked has a Jaccard similarity equal to the weighted one of the shingles.
    """
    order = np.argsort(hashes, kind="stable")
    known = hashes[order]
    starts = np.flatnonzero(np.r_[True, known[1:] != known[:-1]])
    turn = np.arange(len(known)) - np.repeat(starts, np.diff(np.r_[starts, len(known)]))
    out = np.empty_like(hashes)
    out[order] = known + turn.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
    return out


def prints_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """The fingerprints, as blocks, of all windows of `size` neighbouring shingles."""
    n = len(hashes) - size + 1
    sums = np.zeros((len(hashes) + 1, 256), np.int32)
    np.cumsum(signs(hashes), axis=0, dtype=np.int32, out=sums[1:])
    out = blocks_of(sums[size:] - sums[:-size])
    order = np.argsort(hashes, kind="stable")
    first, second = order[:-1], order[1:]
    twice = (hashes[first] == hashes[second]) & (second - first < size)
    if twice.any():  # windows with a repeated shingle, one by one
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, np.maximum(0, second[twice] - size + 1), 1)
        np.add.at(change, np.minimum(first[twice] + 1, n), -1)
        for at in np.flatnonzero(np.cumsum(change[:-1]) > 0).tolist():
            out[at] = blocks_of(signs(marked(hashes[at : at + size])).sum(0, dtype=np.int32)[None])[0]
    return out


def within(windows: np.ndarray, item: np.ndarray) -> np.ndarray:
    """The windows (rows of blocks) within the radius of an item's fingerprint.

    The windows are indexed by each block; the item looks up its own block with up to RADIUS_IN_BLOCK bits changed.
    """
    near = np.zeros(len(windows), bool)
    for block in range(16):
        order = np.argsort(windows[:, block], kind="stable")
        values = windows[order, block]
        wanted = item[block] ^ _FLIPS
        low, high = np.searchsorted(values, wanted, "left"), np.searchsorted(values, wanted, "right")
        for a, b in zip(low[low < high].tolist(), high[low < high].tolist()):
            near[order[a:b]] = True
    some = np.flatnonzero(near)
    return some[np.bitwise_count(windows[some] ^ item).sum(1) < 16 * (RADIUS_IN_BLOCK + 1)]


class Items:
    """A block of items: their fingerprints, and which shingles they have."""

    def __init__(self, rows: list[tuple[int, str]]):
        hashes, bounds = word_hashes([(text or "").lower() for _, text in rows], "letters")
        spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        self.rows = [(rows[i][0], b - a) for i, (a, b) in enumerate(spans) if b > a]  # (item, words)
        self.own = [shingles(hashes[a:b], min(WORDS, b - a)) for a, b in spans if b > a]
        self.prints = np.array([prints_of(x, len(x))[0] for x in self.own], np.uint16).reshape(-1, 16)
        self.shared: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by width: sorted hashes, their items, a sieve
        for width in {min(WORDS, n) for _, n in self.rows}:
            mine = [(at, np.unique(x)) for at, x in enumerate(self.own) if min(WORDS, self.rows[at][1]) == width]
            key = np.concatenate([x for _, x in mine])
            item = np.repeat([at for at, _ in mine], [len(x) for _, x in mine])
            order = np.argsort(key, kind="stable")
            sieve = np.zeros(1 << min(25, max(16, int(16 * len(key)).bit_length())), bool)
            sieve[key & np.uint64(len(sieve) - 1)] = True
            self.shared[width] = key[order], item[order], sieve

    def anchors(self, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, place in the text) of the shingles that texts, given as by `word_hashes`, share with items."""
        for width, (key, item, sieve) in self.shared.items():
            mine = shingles(hashes, width)
            maybe = np.flatnonzero(sieve[mine & np.uint64(len(sieve) - 1)])
            if not len(maybe):
                continue
            low, high = np.searchsorted(key, mine[maybe], "left"), np.searchsorted(key, mine[maybe], "right")
            text = np.searchsorted(bounds, maybe, "right") - 1
            good = np.flatnonzero((low < high) & (maybe + width <= bounds[text + 1]))
            for p, t, a, b in zip(maybe[good].tolist(), text[good].tolist(), low[good].tolist(), high[good].tolist()):
                for at in item[a:b].tolist():
                    yield t, at, p - int(bounds[t])

    def best(self, at: int, hashes: np.ndarray, places: list[int]) -> tuple[float, int, int] | None:
        """(similarity, first word, word after the last) of an item's best window in a text; places: of shared shingles."""
        length = self.rows[at][1]
        width = min(WORDS, length)
        size = min(length, len(hashes)) - width + 1
        last = max(0, len(hashes) - length)
        own = Counter(self.own[at].tolist())
        out = (0.0, 0)
        near = np.unique(np.concatenate([np.arange(max(0, p - size + 1), min(p, last) + 1) for p in places]))
        for run in np.split(near, np.flatnonzero(np.diff(near) > 1) + 1):  # neighbouring windows share their sums
            for first in range(0, len(run), 4096):
                low, high = int(run[first]), int(run[min(first + 4096, len(run)) - 1])
                mine = shingles(hashes[low : high + size + width - 1], width)
                for w in within(prints_of(mine, size), self.prints[at]).tolist():
                    is_like = similarity(own, Counter(mine[w : w + size].tolist()))
                    if is_like >= SIMILARITY and is_like > out[0]:
                        out = (is_like, low + w)
        return (*out, min(out[1] + length, len(hashes))) if out[0] else None

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item id, similarity, first word, word after the last) for each item found in a text."""
        hashes, bounds = word_hashes([t.lower() for t in texts], "letters")
        places: dict[tuple[int, int], list[int]] = defaultdict(list)
        for t, at, p in self.anchors(hashes, bounds):
            places[t, at].append(p)
        found: dict[tuple[int, int], tuple[float, int, int]] = {}
        for (t, at), where in sorted(places.items()):
            row = self.best(at, hashes[bounds[t] : bounds[t + 1]], where)
            key = t, self.rows[at][0]
            if row and (key not in found or (-row[0], row[1]) < (-found[key][0], found[key][1])):
                found[key] = row
        for (t, item), row in found.items():
            yield t, item, *row


def search_in(items: Items):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            doc_ids, texts = part["doc_id"].tolist(), part["text"].tolist()
            for some in slices(texts, 1 << 20):
                out += [(doc_ids[some.start + t], *row) for t, *row in items.search(texts[some])]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "similarity", "start_word", "end_word"]).astype({"doc_id": "Int64", "item_id": "int64", "similarity": "float64", "start_word": "int32", "end_word": "int32"})

    return run


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, block: int = 20_000, block_chars: int = 8_000_000) -> DataFrame:
    """Rows (RESULT): where an item, or a text of similarity 0.8 or more to it, stands in a document.

    Items are searched for in blocks of at most `block` rows and about `block_chars` characters, each of which reads
    docs once; a block's index holds some ten bytes for a character.
    """
    small_batches(spark)
    out = spark.createDataFrame([], RESULT)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    held: list[tuple[int, str]] = []
    chars = 0

    def flush() -> DataFrame:
        packed = spark.sparkContext.broadcast(list(held))  # at most `block` items and about `block_chars` characters

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            return search_in(Items(packed.value))(parts)

        return out.union(read.mapInPandas(tidy(run), RESULT))

    wanted = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text"))
    for row in wanted.orderBy("item_id", "text").toLocalIterator():  # a block at a time is on the driver
        held.append((row["item_id"], row["text"]))
        chars += len(row["text"])
        if len(held) >= block or chars >= block_chars:
            out, held, chars = flush(), [], 0
    if held:
        out = flush()
    return out


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item; rows without doc_id stay."""
    scratch = Scratch(spark, "leaks")
    gone = scratch.keep(contaminated(spark, docs, benchmark).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
