"""Near-duplicates by SimHash.

A text's fingerprint has 64 bits over its word shingles (XXH64, seed 42). Equal fingerprints are reduced to one row
first, so that groups of copies cost one row each. The 64 bits are cut into `blocks` blocks; two fingerprints that
differ in at most `radius` bits agree in at least blocks - radius of them, so a row is dealt out once for each
choice of that many blocks, and every linked pair meets in at least one bucket. A bucket returns a spanning forest
of its links, never its pairs. A bucket of more than `limit` fingerprints is not compared pair by pair at all:
two fingerprints are within 4 bits exactly if some third word is within 2 bits of both, so its members are dealt
out to the words around them and those that meet are linked to the least of them. That is linear in the members.
The links then go through large-star/small-star rounds until each document has the least doc_id it reaches.

Defined results. Null and blank texts have fingerprint zero and are linked like any other. Fewer words than a
shingle are one shingle. Rows without doc_id get a fingerprint and, alone in their component, a null component_id;
otherwise the component of their fingerprint. Repeated rows are each reported. Other columns are ignored.

The pipeline's stage, `one_of_each`, has figures of its own: two texts are linked exactly if their sets of five-word
shingles have a Jaccard similarity of 0.8. Their candidates come by the method above first: the fingerprints of the sets
that lie within `radius` bits are found by their blocks, and the links of each bucket are verified on the sets. About 10
of 64 bits differ at a similarity of 0.8, and at a radius that covers this a block would have three bits or fewer and
tell no fingerprints apart (several together, that do, are millions of choices), so there is an exact way for the rest, by
shingles. In any one order of all shingles, two such sets share one of their first n - ceil(0.8 n) + 1, and these prefixes,
with the shingles that are rare in a sample first, are what a text is dealt out by; the sample changes how many meet, never
what is found. Those that meet can only be that similar if enough of both is left from the first shingle that they share
on, and are compared by a SimHash of 128 bits with a radius of 48, which is 5 standard deviations beyond what 0.8 makes
of sets of any size, and what is left is verified on the sets. So it doesn't matter that a bucket's links are a forest,
of which one may fail where a pair left out of it would not. Where more than `crowd` texts have a least shingle in
common, they are first compared with the CENTRES of them whose SimHash is nearest to that of the crowd, also verified;
texts of one component are not compared again, so that a large group of near copies costs CENTRES comparisons for each
and not one for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, open_folder, over_among, runs_equal, slices, sorted_ids, tidy, whole_text
from .decontaminate import shingles
from .words import word_hashes

RADIUS = 4
WORDS, WIDE_RADIUS, SAMPLE, COMMON, CENTRES = 5, 48, 10_000, 2, 4  # the stage's; similarity 0.8 is written as 4 of 5


def fingerprint(text: str, words: int = 4) -> int:
    """The unsigned fingerprint of one text."""
    import xxhash

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = list(map(b" ".join, zip(*(found[i:] for i in range(words)))))
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(shingles), 1 << 16):
        part = shingles[at : at + (1 << 16)]
        bits = np.fromiter([digest(s, 42) for s in part], np.uint64, len(part)).astype(">u8").view(np.uint8)
        ones += np.unpackbits(bits.reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(shingles)).tobytes(), "big")


def _prints(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in parts:
        yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


@F.pandas_udf(T.LongType())
def fingerprint_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The fingerprint as a signed 64-bit number."""
    yield from tidy(_prints)(parts)


def masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """Signed 64-bit masks, one for each choice of blocks - radius blocks."""
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    out = []
    for chosen in combinations(range(blocks), blocks - radius):
        m = sum(1 << bit for b in chosen for bit in range(edges[b], edges[b + 1]))
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def blocks_for(count: int) -> int:
    """The least number of blocks at which a fingerprint meets few others by chance; any number finds every link."""
    for blocks in range(RADIUS + 2, 12):
        keys = len(masks(blocks))
        if keys * count / 2 ** (64 * (blocks - RADIUS) / blocks) <= 8:
            break
    return blocks


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from nodes to the least node of their component, for the components of the links a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[a], least[b])
        before = least.copy()
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        np.minimum.at(least, before[a], low)
        np.minimum.at(least, before[b], low)
        least = least[least]
        if (least == before).all():
            break
    moved = least != np.arange(len(nodes))
    return nodes[moved], nodes[least[moved]]


def compare(limit: int, radius: int):
    """A function for mapInPandas over rows (which, key, fp, rep) sorted by which and key.

    Rows out: kind 0 with a link a-b of representatives, or kind 1 with a member (which, fp, rep) of a bucket over limit.
    """

    def bucket(part: pd.DataFrame) -> pd.DataFrame:
        which, key = part["which"].to_numpy(), part["key"].to_numpy()
        starts = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (key[1:] != key[:-1])])
        size = np.diff(np.r_[starts, len(part)])
        run = np.repeat(np.arange(len(starts)), size)
        large = np.repeat(size > limit, size)
        small = part[~large]
        run, fp, rep = run[~large], small["fp"].to_numpy(np.int64).view(np.uint64), small["rep"].to_numpy(np.int64)
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for i, j in runs_equal(run):
            near = np.bitwise_count(fp[i] ^ fp[j]) <= radius
            if near.any():
                found.append((rep[i[near]], rep[j[near]]))
                held += int(near.sum())
            if held > 1 << 20:
                a, b = forest(*(np.concatenate([x, *(p[k] for p in found)]) for k, x in enumerate((a, b))))
                found, held = [], 0
        if found or len(a):
            a, b = forest(*(np.concatenate([x, *(p[k] for p in found)]) for k, x in enumerate((a, b))))
        links = pd.DataFrame({"kind": 0, "which": 0, "a": a, "b": b})
        over = part[large]
        return pd.concat([links, pd.DataFrame({"kind": 1, "which": over["which"], "a": over["fp"], "b": over["rep"]})]).astype({"kind": "int32", "which": "int32", "a": "int64", "b": "int64"})

    def over_partition(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        open_key = None  # a bucket over limit whose members are passed on as they come
        for part in parts:
            if rest is not None and len(rest):
                part = pd.concat([rest, part], ignore_index=True)
            if not len(part):
                continue
            if open_key is not None:
                same = ((part["which"] == open_key[0]) & (part["key"] == open_key[1])).to_numpy()
                if same.any():
                    over = part[same]
                    yield pd.DataFrame({"kind": 1, "which": over["which"], "a": over["fp"], "b": over["rep"]}).astype({"kind": "int32", "which": "int32"})
                    part = part[~same]
                if not len(part):
                    rest = None
                    continue
                open_key = None
            last = part.iloc[-1]
            tail = ((part["which"] == last["which"]) & (part["key"] == last["key"])).to_numpy()
            rest = part[tail]
            if len(rest) > limit:
                open_key, rest = (last["which"], last["key"]), None
                yield bucket(part)
            elif (~tail).any():
                yield bucket(part[~tail])
        if rest is not None and len(rest):
            yield bucket(rest)

    return over_partition


def around(fp: np.ndarray, mask: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The words within 2 bits of each fingerprint that agree with it on mask: (indices, words)."""
    everyone = np.arange(len(fp))
    yield everyone, fp
    for i in range(64):
        one = np.uint64(1 << i)
        may = everyone[(mask & one) == 0]
        flipped = fp[may] ^ one
        yield may, flipped
        for j in range(i + 1, 64):
            two = np.uint64(1 << j)
            can = (mask[may] & two) == 0
            yield may[can], flipped[can] ^ two


def dealt_around(chosen: list[int]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = np.array(chosen, np.int64).view(np.uint64)
        for part in parts:
            for at in range(0, len(part), 2048):
                some = part.iloc[at : at + 2048]
                fp, which, rep = some["a"].to_numpy(np.int64).view(np.uint64), some["which"].to_numpy(), some["b"].to_numpy()
                for i, word in around(fp, known[which]):
                    if len(i):
                        yield pd.DataFrame({"which": which[i], "word": word.view(np.int64), "rep": rep[i]})

    return run


def links(spark: SparkSession, prints: DataFrame, scratch: Scratch, blocks: int | None = None, limit: int = 2048) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of prints (fp, rep) within the radius."""
    chosen = masks(blocks or blocks_for(prints.count()))
    keys = F.array(*[F.struct(F.lit(i).alias("which"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(chosen)])
    dealt = prints.select("fp", "rep", F.explode(keys).alias("at")).select("at.which", "at.key", "fp", "rep")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(n, "which", "key").sortWithinPartitions("which", "key")
    found = scratch.keep(dealt.mapInPandas(tidy(compare(limit, RADIUS)), "kind int, which int, a long, b long"), "found")
    out = found.where("kind = 0").select("a", "b")
    over = found.where("kind = 1")
    if not over.isEmpty():
        met = scratch.keep(over.mapInPandas(tidy(dealt_around(chosen)), "which int, word long, rep long"), "met")
        least = scratch.keep(met.groupBy("which", "word").agg(F.min("rep").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n"), "least")
        star = met.join(least, ["which", "word"]).where("rep <> b").select(F.col("rep").alias("a"), "b")
        out = out.union(star)
    return scratch.keep(out.distinct(), "links")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the least node that each node of the links (a, b) reaches, by large-star and small-star rounds."""

    def star(df: DataFrame, large: bool, name: str) -> DataFrame:
        both = df.union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b <= a")
        low = scratch.keep(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")), name + "_low")
        out = both.join(low, "a")
        if large:
            out = out.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            out = out.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
        return scratch.keep(out.where("a <> b").distinct(), name)

    now, before, turn = edges.select("a", "b"), None, 0
    while True:
        now = star(star(now, True, f"large{turn}"), False, f"small{turn}")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1))).alias("h")).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before, turn = state, turn + 1
        if turn > 1:
            scratch.drop(*(f"{k}{turn - 2}{x}" for k in ("large", "small") for x in ("", "_low")))


def near_dedup(spark: SparkSession, docs: DataFrame, blocks: int | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of docs."""
    scratch = Scratch(spark, "simhash")
    prints = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_of(whole_text()).alias("fp")), "prints")
    distinct = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    edges = links(spark, distinct.where("rep is not null"), scratch, blocks, limit)
    if edges.isEmpty():
        owners = distinct.select("fp", F.col("rep").alias("component"))
    else:
        found = components(edges, scratch)
        owners = distinct.join(found, distinct["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component"))
    owners = scratch.keep(owners, "owners")
    return prints.join(owners, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """The distinct five-word shingles of each text, as ascending hashes; fewer words are one shingle, none are none."""
    for some in slices(texts, 1 << 20):
        ids, bounds = word_hashes(texts[some], "blanks")
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield np.unique(shingles(ids[a:b], min(WORDS, b - a))) if b > a else np.empty(0, np.uint64)


def mixed(hashes: np.ndarray, no: int) -> np.ndarray:
    x = hashes + np.uint64(0xD1B54A32D192ED03 * (no + 1) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set, as two numbers."""
    ones = np.zeros(128, np.int32)
    for at in range(0, len(hashes), 1 << 14):
        some = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(np.stack([mixed(some, 0), mixed(some, 1)], 1).view(np.uint8), axis=1).sum(0, dtype=np.int32)
    return np.packbits(ones * 2 > len(hashes)).view(np.uint64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of 0.8 or more."""
    if min(len(a), len(b)) * 5 < max(len(a), len(b)) * 4:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


@F.pandas_udf(T.BooleanType())
def alike_sets(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)], dtype=bool)


def packed_sets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas: (doc_id, text) to (doc_id, set), the hashes of a set end to end."""
    for part in parts:
        yield pd.DataFrame({"doc_id": part["doc_id"], "set": [s.tobytes() for s in shingle_sets(part["text"].tolist())]})


def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield pd.DataFrame({"shingle": np.concatenate([np.empty(0, np.uint64), *shingle_sets(part["text"].tolist())]).view(np.int64)})


def described(common: str):
    """A function for mapInPandas: (doc_id, text) to what the stage needs of a set; common is the folder of the sample's counts."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.dataset as ds

        system, path = open_folder(common)
        table = ds.dataset(path, filesystem=system, format="parquet", exclude_invalid_files=False)
        known, often = np.empty(0, np.uint64), np.empty(0, np.int64)
        if "shingle" in table.schema.names:
            rows = table.to_table(columns=["shingle", "n"])
            known, often = rows["shingle"].to_numpy().view(np.uint64), rows["n"].to_numpy()
            order = np.argsort(known)
            known, often = known[order], often[order]
        for part in parts:
            out = []
            for doc_id, found in zip(part["doc_id"], shingle_sets(part["text"].tolist())):
                n = len(found)
                total = int(mixed(found, 2).sum(dtype=np.uint64)) if n else 0
                first, second = wide_print(found).view(np.int64).tolist()
                ordered = found
                if len(known) and n:
                    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                    ordered = found[np.argsort(np.where(known[at] == found, often[at], 0), kind="stable")]
                prefix = ordered[: n - -(-4 * n // 5) + 1] if n else ordered
                least = [int(mixed(found, k).min().view(np.int64)) for k in (3, 4, 5)] if n else []
                out.append((doc_id, n, total - (1 << 64) if total >> 63 else total, first, second, prefix.view(np.int64), least))
            yield pd.DataFrame(out, columns=["doc_id", "n", "total", "first", "second", "prefix", "least"])

    return run


def meeting(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas: rows (key, rep, component, n, rest, first, second) with equal keys in a row to pairs (a, b) to be verified.

    `rest` is how many of a set's shingles stand at the key or after it in the order of all. Where the key is the first
    that two sets share, they share `rest` of either at most; 4 of 9 of both sizes are needed for a similarity of 0.8.
    """

    def near(x: list[np.ndarray], i, j) -> np.ndarray:
        rep, component, n, rest, first, second = x
        size = np.minimum(rest[i], rest[j]) * 9 >= (n[i] + n[j]) * 4
        return size & (component[i] != component[j]) & (np.bitwise_count(first[i] ^ first[j]) + np.bitwise_count(second[i] ^ second[j]) <= WIDE_RADIUS)

    def pairs(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        key = part["key"].to_numpy()
        x = [part[c].to_numpy(np.int64) for c in ("rep", "component", "n", "rest")] + [part[c].to_numpy(np.int64).view(np.uint64) for c in ("first", "second")]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[starts, len(key)])

        def out(i, j) -> pd.DataFrame:
            a, b = x[0][i], x[0][j]
            return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)})

        few = np.flatnonzero(np.repeat(size <= 256, size))
        for i, j in runs_equal(key[few]):
            i, j = few[i], few[j]
            ok = near(x, i, j)
            if ok.any():
                yield out(i[ok], j[ok])
        for start, n in zip(starts[size > 256].tolist(), size[size > 256].tolist()):
            component = x[1][start : start + n]
            names, count = np.unique(component, return_counts=True)
            largest = component == names[count.argmax()]
            # those of the largest component first: only the others need a look at all before them
            order = start + np.r_[np.flatnonzero(largest), np.flatnonzero(~largest)]
            for at in range(int(largest.sum()), n):
                i = order[:at]
                ok = near(x, i, order[at])
                if ok.any():
                    yield out(i[ok], np.full(int(ok.sum()), order[at]))

    held: list[pd.DataFrame] = []
    rows, most = 0, 1 << 16
    for part in parts:
        held.append(part)
        rows += len(part)
        if rows < most:
            continue
        whole = pd.concat(held, ignore_index=True)
        end = int(np.flatnonzero((whole["key"] != whole["key"].iloc[-1]).to_numpy())[-1:].sum() + 1) if whole["key"].iloc[0] != whole["key"].iloc[-1] else 0
        if end:
            yield from pairs(whole[:end])
        held, rows = [whole[end:]], len(whole) - end
        most = max(1 << 16, 2 * rows)
    if rows:
        yield from pairs(pd.concat(held, ignore_index=True))


def verified(found: DataFrame, texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Those of the pairs (a, b) whose texts (doc_id, text) are alike."""
    found = scratch.keep(found.distinct(), f"{name}_pairs")
    if found.isEmpty():
        return found
    ids = sorted_ids(found.select(F.explode(F.array("a", "b")).alias("id")), scratch, f"{name}_ids")
    some = scratch.keep(over_among(texts, ids, packed_sets, "doc_id long, set binary"), f"{name}_sets")
    both = found.join(some.select(F.col("doc_id").alias("a"), F.col("set").alias("a_set")), "a").join(some.select(F.col("doc_id").alias("b"), F.col("set").alias("b_set")), "b")
    out = scratch.keep(both.where(alike_sets("a_set", "b_set")).select("a", "b").distinct(), f"{name}_links")
    scratch.drop(f"{name}_sets")
    return out


def by_blocks(spark: SparkSession, firsts: DataFrame, blocks: int | None = None, limit: int = 2048) -> DataFrame:
    """Pairs (a, b) of rows (rep, first) that join all whose fingerprints `first` are linked within RADIUS bits, to be verified."""
    scratch = Scratch(spark, "blocks")
    prints = scratch.keep(firsts.groupBy(F.col("first").alias("fp")).agg(F.min("rep").alias("rep"), F.max("rep").alias("other")), "prints")
    equal = firsts.join(prints.where("rep <> other").select(F.col("fp").alias("first"), F.col("rep").alias("b")), "first").where("rep <> b")
    return links(spark, prints.select("fp", "rep"), scratch, blocks, limit).union(equal.select(F.col("rep").alias("a"), "b"))


def central(crowds: DataFrame, scratch: Scratch) -> DataFrame:
    """(no, key, b): of each crowd of rows (no, key, rep, first, second), the CENTRES whose fingerprints are nearest to the majority of its bits."""
    sums = [F.sum(F.getbit(x, F.lit(i))).alias(f"{x}{i}") for x in ("first", "second") for i in range(64)]
    counts = crowds.groupBy("no", "key").agg(F.count("*").alias("n"), *sums)

    def most(x: str) -> Column:
        bits = [F.when(F.col(f"{x}{i}") * 2 > F.col("n"), F.lit((1 << i) - (1 << 64 if i == 63 else 0))).otherwise(F.lit(0)) for i in range(64)]
        return F.aggregate(F.array(*[b.cast("long") for b in bits]), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    middle = scratch.keep(counts.select("no", "key", most("first").alias("m1"), most("second").alias("m2")), "middles")
    far = F.bit_count(F.col("first").bitwiseXOR(F.col("m1"))) + F.bit_count(F.col("second").bitwiseXOR(F.col("m2")))
    near = crowds.join(middle, ["no", "key"]).select("no", "key", "rep", far.alias("far"))
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("no", "key").orderBy("far", "rep")))
    return scratch.keep(ranked.where(F.col("place") <= CENTRES).select("no", "key", F.col("rep").alias("b")), "centres")


def near_copies(spark: SparkSession, docs: DataFrame, crowd: int = 64) -> DataFrame:
    """(doc_id, component_id) of the rows of docs with a doc_id: the least doc_id that links of similarity 0.8 lead to."""
    scratch = Scratch(spark, "near")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).where("doc_id is not null")
    every = max(1, texts.count() // SAMPLE)
    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
    scratch.keep(sample.mapInPandas(tidy(spread), "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON), "common")
    sets = scratch.keep(texts.mapInPandas(tidy(described(scratch.path("common"))), "doc_id long, n int, total long, first long, second long, prefix array<long>, least array<long>"), "sets")
    same = ["n", "total", "first", "second"]
    distinct = scratch.keep(sets.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other")), "distinct")
    # arrays are left where they are: what is moved is the rows that are not their set's first
    twice = scratch.keep(sets.select("doc_id", *same).join(distinct.where("rep <> other"), same).where("doc_id <> rep").select("doc_id", *same).distinct(), "twice")
    firsts = sets.join(twice, ["doc_id", *same], "left_anti").withColumnRenamed("doc_id", "rep")
    met, owner = by_blocks(spark, firsts.select("rep", "first")), None
    stars = firsts.select("rep", "first", "second", F.posexplode("least").alias("no", "key"))
    crowded = scratch.keep(stars.groupBy("no", "key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).drop("n"), "crowded")
    if not crowded.isEmpty():
        crowds = scratch.keep(stars.join(crowded, ["no", "key"]), "crowds")
        close = crowds.join(central(crowds, scratch), ["no", "key"]).where("rep <> b")
        met = met.union(close.select(F.greatest("rep", "b").alias("a"), F.least("rep", "b").alias("b")))
    edges = verified(met, texts, scratch, "near")
    if not edges.isEmpty():
        owner = scratch.keep(components(edges, scratch).select(F.col("node").alias("rep"), "component"), "known")
    by_key = Window.partitionBy("key")
    dealt = firsts.select(F.posexplode("prefix").alias("at", "key"), "rep")
    shared = scratch.keep(dealt.withColumns({"low": F.min("rep").over(by_key), "high": F.max("rep").over(by_key)}).where("low <> high").select("key", "rep", "at").distinct(), "shared")
    facts = firsts.select("rep", "n", "first", "second").distinct()
    facts = facts.withColumn("component", F.col("rep")) if owner is None else facts.join(owner, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    full = shared.join(facts, "rep").select("key", "rep", "component", "n", (F.col("n") - F.col("at")).alias("rest"), "first", "second")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = full.repartition(n, "key").sortWithinPartitions("key").mapInPandas(tidy(meeting), "a long, b long")
    edges = edges.union(verified(pairs, texts, scratch, "rest"))
    if edges.isEmpty():
        owners = distinct.select(*same, F.col("rep").alias("component_id"))
    else:
        found = scratch.keep(components(edges, scratch), "found")
        owners = distinct.join(found, distinct["rep"] == found["node"], "left").select(*same, F.coalesce("component", "rep").alias("component_id"))
    return sets.select("doc_id", *same).join(owners, same).select("doc_id", "component_id")


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with one document of each component of near_copies: that with its least doc_id; rows without doc_id stay."""
    scratch = Scratch(spark, "simhash")
    gone = scratch.keep(near_copies(spark, docs).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
