"""Quality by the perplexity of an interpolated modified Kneser-Ney model of characters.

Trusted documents are those that `labels` marks with quality 1. Of all of them the `ORDER`-grams of characters are
counted: distinct ones within a task first, then by key over all tasks. Lower orders count the distinct left
neighbours of a gram. With three discounts per order, estimated from the counts of counts, the probabilities are
computed from the lowest order up by joins on contexts and suffixes, sharded by those keys. The finished table of
probabilities and back-off weights, which grows with the text it was made from, is written in shards by key. A task joins the distinct
grams of a portion of its texts with the shards one after another and holds a bounded number of their rows, so that
neither texts nor table are shuffled or broadcast for scoring. A tenth of the trusted documents, by their doc_id, is kept out of the
counts and sets the bounds: a language's bound is the `QUANTILE` of theirs in that language, times `SLACK`. Means and
bounds of a language with n of them are drawn towards those of all as if `DRAW` of n + `DRAW` were the latter, so that
few of them count for less but there is no number from which on they count. What is compared is the perplexity drawn
towards its language's mean as if `PRIOR` more characters had it, as that of a few words says little. Documents of a
language without any trusted document are kept, with a null threshold.

Defined results. White space runs count as one space. Null and blank texts have a null perplexity and are kept. A
null language is a language. Documents without doc_id are scored like others but never trusted; a doc_id that is
labelled twice is trusted if any label says so. Without any trusted document everything is kept. Repeated rows are
each scored, and each counted if trusted.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, give_back, open_folder, over_among, sorted_ids, tidy, whole_text

ORDER, QUANTILE, SLACK, DRAW, PRIOR = 5, 0.99, 1.1, 10, 50
SHARD, HOLD, PORTION = 1_000_000, 4_000_000, 2_000_000  # rows of a shard, rows that a worker keeps, characters scored at once
BEGIN = "\x02"
_M = np.uint64(0x9E3779B97F4A7C15)


def codes(text: str) -> np.ndarray:
    """The characters of a text, after ORDER - 1 marks of its beginning."""
    plain = " ".join(text.split())
    if not plain:
        return np.empty(0, np.uint32)
    return np.frombuffer((BEGIN * (ORDER - 1) + plain.replace("\0", "\x01")).encode("utf-32-le", "surrogatepass"), np.uint32)


def _seed(length: int, kind: int) -> np.uint64:
    return np.uint64((length * 2 + kind) * 0xD1B54A32D192ED03 & (2**64 - 1))


def keys_at(chars: np.ndarray, ends: np.ndarray | None, length: int, kind: int) -> np.ndarray:
    """64-bit keys of the grams of a length: of all in order, or of those whose last characters stand at `ends`."""
    n = len(chars) - length + 1 if ends is None else len(ends)
    h = np.full(n, _seed(length, kind))
    for i in range(length):
        c = chars[i : i + n] if ends is None else chars[ends - (length - 1 - i)]
        h = (h ^ c.astype(np.uint64)) * _M
        h ^= h >> np.uint64(29)
    return h


def count_grams(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas: (text) to (gram, n), distinct within some hundred thousand grams of one task."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def merged(rows):
        key, n, gram = (np.concatenate(x) for x in zip(*rows))
        uniq, first, back = np.unique(key, return_index=True, return_inverse=True)
        return uniq, np.bincount(back, n).astype(np.int64), gram[first]

    def out(row):
        return pd.DataFrame({"gram": row[2].tolist(), "n": row[1]})

    def add(chars: list[np.ndarray]) -> None:
        nonlocal held, size
        flat = np.concatenate(chars)
        ends = np.concatenate([np.arange(ORDER - 1, len(c)) + at for c, at in zip(chars, np.cumsum([0, *map(len, chars[:-1])]))])
        key, first, n = np.unique(keys_at(flat, ends, ORDER, 0), return_index=True, return_counts=True)
        some = ends[first]
        gram = np.stack([flat[some - (ORDER - 1 - i)] for i in range(ORDER)], 1).astype(np.uint32)
        held.append((key, n, np.ascontiguousarray(gram).view(f"U{ORDER}").ravel()))
        size += len(key)

    chars, length = [], 0
    for part in parts:
        for text in part["text"]:
            c = codes(text)
            if len(c):
                chars.append(c)
                length += len(c)
            if length > 1 << 19:
                add(chars)
                chars, length = [], 0
                if size > 1 << 19:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > 3 << 17:
                        yield out(held[0])
                        held, size = [], 0
    if chars:
        add(chars)
    if held:
        yield out(merged(held))


def _suffix(n: int) -> Column:
    return F.substring("gram", 2, n)


@F.pandas_udf(T.LongType())
def key_of(grams: pd.Series, kinds: pd.Series) -> pd.Series:
    """The key of a gram of any length as signed number; kind 0 for probabilities, 1 for back-off weights."""
    out = np.zeros(len(grams), np.uint64)
    lengths, kinds = grams.str.len().to_numpy(), kinds.to_numpy()
    for length in np.unique(lengths):
        for kind in (0, 1):
            at = np.flatnonzero((lengths == length) & (kinds == kind))
            if len(at):
                chars = np.frombuffer("".join(grams.iloc[at]).encode("utf-32-le", "surrogatepass"), np.uint32)
                ends = np.arange(len(at)) * int(length) + int(length) - 1
                out[at] = keys_at(chars, ends, int(length), kind)
    return pd.Series(out.view(np.int64))


class Model:
    """A trained table, read shard by shard in Python workers.

    Texts are scored in portions of PORTION characters. Of a portion the distinct grams are found first, then the keys
    of all that they need are looked up at once, so that a portion reads a shard once however many there are; of the
    last few shards a worker keeps HOLD rows.
    """

    def __init__(self, folder: str, bits: int, unseen: float):
        self.folder, self.bits, self.unseen = folder, bits, unseen
        self.shards: OrderedDict[int, tuple] = OrderedDict()

    def __getstate__(self):
        return self.folder, self.bits, self.unseen

    def __setstate__(self, state):
        self.__init__(*state)

    def forget(self) -> None:
        self.shards.clear()

    def shard(self, no: int) -> tuple:
        if no in self.shards:
            self.shards.move_to_end(no)
        else:
            import pyarrow.parquet as pq

            system, path = open_folder(self.folder)
            table = pq.read_table(f"{path}/shard={no}", filesystem=system, columns=["key", "value"], partitioning=None)
            key, value = table["key"].to_numpy().view(np.uint64), table["value"].to_numpy()
            del table
            if (key[1:] < key[:-1]).any():  # sorted as signed numbers, or in several files
                order = np.argsort(key)
                key, value = key[order], value[order]
            while self.shards and sum(len(x[0]) for x in self.shards.values()) + len(key) > HOLD:
                self.shards.popitem(last=False)
            top = max(1, int(len(key)).bit_length())
            own = (key << np.uint64(self.bits)) >> np.uint64(64 - top)
            first = np.zeros((1 << top) + 1, np.int32)
            np.cumsum(np.bincount(own.astype(np.int64), minlength=1 << top), out=first[1:])
            self.shards[no] = key, value, first, top
        return self.shards[no]

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, NaN for those that the table lacks; shards that are held come first."""
        out = np.full(len(keys), np.nan, np.float32)
        if not self.bits:
            return self._in_shard(0, keys)
        of = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[order], np.arange((1 << self.bits) + 1))
        for no in sorted(np.flatnonzero(np.diff(edges)).tolist(), key=lambda no: (no not in self.shards, no)):
            mine = order[edges[no] : edges[no + 1]]
            out[mine] = self._in_shard(no, keys[mine])
        return out

    def _in_shard(self, no: int, wanted: np.ndarray) -> np.ndarray:
        key, value, first, top = self.shard(no)
        slot = ((wanted << np.uint64(self.bits)) >> np.uint64(64 - top)).astype(np.int64)
        at, end = first[slot], first[slot + 1]
        found = np.full(len(wanted), np.nan, np.float32)
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            hit = key[at] == wanted[left]
            found[left[hit]] = value[at[hit]]
            at = at + 1
            go = ~hit & (at < end)
            left, at, end = left[go], at[go], end[go]
        return found

    def logs(self, chars: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log probabilities of the characters at `ends`."""
        plan = [(length, kind) for length in range(ORDER, 0, -1) for kind in ((0, 1) if length > 1 else (0,))]
        value = {}
        if self.bits:
            keys = [keys_at(chars, ends - kind, length - kind, kind) for length, kind in plan]
            every = self.look_up(np.concatenate(keys))
            value = dict(zip(plan, np.split(every, len(plan))))
        out = np.zeros(len(ends))
        left, behind = np.arange(len(ends)), np.zeros(len(ends))

        def of(length: int, kind: int) -> np.ndarray:
            if self.bits:
                return value[length, kind][left]
            return self.look_up(keys_at(chars, ends[left] - kind, length - kind, kind))

        for length in range(ORDER, 0, -1):
            p = of(length, 0)
            seen = ~np.isnan(p)
            out[left[seen]] = behind[seen] + p[seen]
            left, behind = left[~seen], behind[~seen]
            if not len(left):
                return out
            if length > 1:
                behind = behind + np.nan_to_num(of(length, 1))
        out[left] = behind + self.unseen
        return out

    def perplexities(self, parts: Iterator[pd.Series]) -> Iterator[np.ndarray]:
        """Perplexity of each text of each part, NaN for blank ones; some parts may be read before the first result."""
        sizes: list[int] = []  # characters of the texts of this portion
        pieces: list[tuple] = []  # (place of each character's gram among the distinct ones, the distinct grams' characters)
        held: list[np.ndarray] = []
        chars, waiting = 0, 0

        def pack() -> None:
            nonlocal waiting
            if not held:
                return
            flat = np.concatenate(held)
            starts = np.cumsum([0, *map(len, held)])
            ends = np.concatenate([np.arange(s + ORDER - 1, e) for s, e in zip(starts[:-1], starts[1:])])
            place, known = pd.factorize(keys_at(flat, ends, ORDER, 0))
            first = np.empty(len(known), np.int64)
            first[place[::-1]] = ends[::-1]
            grams = np.stack([flat[first - (ORDER - 1 - i)] for i in range(ORDER)], 1).astype(np.uint32)
            pieces.append((place.astype(np.int32), known, grams))
            held.clear()
            waiting = 0

        def flush() -> np.ndarray:
            nonlocal chars
            pack()
            out = np.full(len(sizes), np.nan)
            if pieces:
                place, known = pd.factorize(np.concatenate([k for _, k, _ in pieces]))
                first = np.empty(len(known), np.int64)
                first[place[::-1]] = np.arange(len(place))[::-1]
                grams = np.concatenate([g for _, _, g in pieces])[first]
                ends = np.arange(ORDER - 1, grams.size, ORDER)
                # where a worker can't keep all shards, all grams at once, so that each shard is read once
                step = 1 << 17 if SHARD << self.bits <= HOLD else len(ends)
                logs = np.concatenate([self.logs(grams.ravel(), ends[i : i + step]) for i in range(0, len(ends), step)])
                each, at = [], 0
                for mine, own, _ in pieces:
                    each.append(logs[place[at : at + len(own)]][mine].astype(np.float64))
                    at += len(own)
                count = np.array(sizes)
                some = np.flatnonzero(count)
                n = count[some]
                out[some] = np.exp(-np.add.reduceat(np.concatenate(each), np.cumsum(n) - n) / n)
            sizes.clear()
            pieces.clear()
            chars = 0
            give_back()
            return out

        def add(text: str) -> None:
            nonlocal chars, waiting
            c = codes(text)
            n = max(0, len(c) - (ORDER - 1))
            sizes.append(n)
            if n:
                held.append(c)
                chars += n
                waiting += n
            if waiting > 1 << 18:
                pack()

        for part in parts:
            for text in part:
                add(text)
            if chars > PORTION:
                yield flush()
        if sizes:
            yield flush()

    def column(self) -> Column:
        model = self

        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            yield from map(pd.Series, model.perplexities(parts))

        @F.pandas_udf(T.DoubleType())
        def perplexity(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            yield from tidy(run, model.forget)(parts)

        return F.nanvl(perplexity(whole_text()), F.lit(None).cast("double"))


def discounts(counts: dict[int, int]) -> list[float]:
    """The three discounts of an order from its counts of counts, within [0, count]."""
    n1, n2, n3, n4 = (counts[k] for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = []
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        out.append(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) if a else k / 2)
    return out


def train(texts: DataFrame, scratch: Scratch, shard: int = SHARD, among: str | None = None) -> Model | None:
    """The model of the texts (text), or of those of texts (doc_id, text) whose id is in the table `among`; None if they hold no character."""
    counted = over_among(texts, among, count_grams, "gram string, n long") if among else texts.mapInPandas(tidy(count_grams), "gram string, n long")
    grams = scratch.keep(counted.groupBy("gram").agg(F.sum("n").alias("n")), f"grams{ORDER}")
    tables = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = scratch.keep(tables[k + 1].groupBy(_suffix(k).alias("gram")).agg(F.count("*").alias("n")), f"grams{k}")
    stats = None
    for k, df in tables.items():
        row = df.agg(F.lit(k).alias("k"), F.count("*").alias("types"), *[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)])
        stats = row if stats is None else stats.union(row)
    stats = {r["k"]: r for r in stats.collect()}  # ORDER rows
    if not stats[1]["types"]:
        return None
    n = F.col("n")
    finished = None
    lower = None
    unseen = 0.0
    for k in range(1, ORDER + 1):
        d = discounts({i: stats[k][f"n{i}"] for i in (1, 2, 3, 4)})
        less = F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])
        if k == 1:
            total, mass = tables[1].agg(F.sum("n"), F.sum(less)).first()
            size = stats[1]["types"] + 1
            unseen = float(np.log(max(mass, 1e-9) / total / size))
            now = tables[1].select("gram", ((n - less) / total + mass / total / size).alias("p"))
        else:
            contexts = scratch.keep(tables[k].groupBy(F.substring("gram", 1, k - 1).alias("context")).agg((F.sum(less) / F.sum("n")).alias("back"), F.sum("n").alias("total")), f"contexts{k}")
            mine = tables[k].select("gram", "n", F.substring("gram", 1, k - 1).alias("context"), _suffix(k - 1).alias("rest"))
            now = mine.join(contexts, "context").join(lower.select(F.col("gram").alias("rest"), F.col("p").alias("q")), "rest").select("gram", ((n - less) / F.col("total") + F.col("back") * F.col("q")).alias("p"))
            weights = contexts.select(F.col("context").alias("gram"), F.lit(1).alias("kind"), F.log(F.greatest("back", F.lit(1e-9))).alias("value"))
            finished = weights if finished is None else finished.union(weights)
        lower = scratch.keep(now, f"p{k}")
        rows = lower.select("gram", F.lit(0).alias("kind"), F.log("p").alias("value"))
        finished = rows if finished is None else finished.union(rows)
    rows = sum(2 * r["types"] for r in stats.values())
    bits = max(0, int(np.ceil(np.log2(max(1, rows / shard)))))
    keyed = finished.select(key_of("gram", "kind").alias("key"), F.col("value").cast("float").alias("value"))
    keyed = keyed.withColumn("shard", F.shiftrightunsigned("key", 64 - bits).cast("int") if bits else F.lit(0))
    keyed.repartition(1 << bits, "shard").sortWithinPartitions("shard", "key").write.mode("overwrite").partitionBy("shard").parquet(scratch.path("model"))
    scratch.drop(*(f"{x}{k}" for k in range(1, ORDER + 1) for x in ("grams", "contexts", "p")))
    return Model(scratch.path("model"), bits, unseen)


def trusted_ids(labels: DataFrame, scratch: Scratch) -> str:
    return sorted_ids(labels.where("quality = 1").select(F.col("doc_id").alias("id")), scratch, "trusted")


def trusted(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of facts about documents that a label trusts; they are shuffled, so that all documents' texts had better not be among them."""
    known = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("__trusted")).distinct()
    return facts.join(known, facts["doc_id"].cast("long") == known["__trusted"], "left_semi")


def kept_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0


def judged(scored: DataFrame, kept: DataFrame, languages: DataFrame, scratch: Scratch) -> DataFrame:
    """scored (lang, perplexity, length and more) with `threshold` and `keep`, by the trusted rows kept out of training (the same columns).

    languages (lang): those of all trusted documents, kept out or not.
    """
    named = F.coalesce("lang", F.lit("und"))
    known = kept.where("perplexity is not null").select(named.alias("of"), F.log("perplexity").alias("log"), "length")
    if (overall := known.agg(F.avg("log").alias("mean")).first()["mean"]) is None:
        return scored.withColumns({"threshold": F.lit(None).cast("double"), "keep": F.lit(True)})

    def shrunk(own: Column, pooled: float) -> Column:
        return (F.col("n") * own + DRAW * pooled) / (F.col("n") + DRAW)

    def drawn(log: Column) -> Column:
        return F.exp((F.col("length") * log + PRIOR * F.col("own")) / (F.col("length") + PRIOR))

    means = known.groupBy("of").agg(F.avg("log").alias("mean"), F.count("*").alias("n")).select("of", "n", shrunk(F.col("mean"), overall).alias("own"))
    known = scratch.keep(known.join(means, "of").select("of", "n", "own", drawn(F.col("log")).alias("x")), "bounds")
    bound = F.percentile_approx("x", QUANTILE, 10000) * SLACK
    general = known.agg(bound.alias("x")).first()["x"]
    bounds = known.groupBy("of").agg(F.first("own").alias("own"), F.first("n").alias("n"), bound.alias("bound"))
    bounds = bounds.select("of", "own", F.exp(shrunk(F.log("bound"), float(np.log(general)))).alias("threshold"))
    every = scratch.keep(languages.select(named.alias("of")).distinct().join(bounds, "of", "left").select("of", F.coalesce("own", F.lit(overall)).alias("own"), F.coalesce("threshold", F.lit(general)).alias("threshold")), "languages")
    out = scored.join(every, named == F.col("of"), "left")
    return out.withColumn("keep", F.coalesce(drawn(F.log("perplexity")) <= F.col("threshold"), F.lit(True))).drop("of", "own")


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity, threshold, keep for every row of docs."""
    scratch = Scratch(spark, "quality")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), whole_text().alias("text"))
    model = train(read.where(~kept_out()).select("doc_id", "text"), scratch, among=trusted_ids(labels, scratch))
    score = model.column() if model else F.lit(None).cast("double")
    scored = scratch.keep(read.select("doc_id", "lang", score.alias("perplexity"), F.length("text").alias("length")), "scores")
    return judged(scored, trusted(scored.where(kept_out()), labels), trusted(scored, labels).select("lang"), scratch).select("doc_id", "lang", "perplexity", "threshold", "keep")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_poor(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that `quality` rejects. Texts of all documents are not shuffled: those that set the bounds are scored twice."""
    scratch = Scratch(spark, "quality")
    rest = docs.where(~kept_out()).select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    model = train(rest, scratch, among=trusted_ids(labels, scratch))
    if not model:
        return docs
    facts = [docs["lang"].cast("string").alias("lang"), model.column().alias("perplexity"), F.length(whole_text()).alias("length")]
    known = scratch.keep(trusted(docs.where(kept_out()), labels).select(*facts), "known")
    # texts are not shuffled but for the tenth that is kept out
    scored = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *facts)
    languages = trusted(docs.select("doc_id", "lang"), labels).select(F.col("lang").cast("string").alias("lang"))
    return judged(scored, known, languages, scratch).where("keep").select("row.*")
