"""Secret scans: three fixed patterns, and Markov models of characters that find what the patterns miss.

A candidate is a run of 20 or more letters, digits and `+/_=-`. Two first-order Markov models, one of random strings
and one of ordinary identifiers, are trained from labelled samples (token, random): transitions are counted for each
label and smoothed by half a count. A candidate is a secret if the log-likelihood ratio of its transitions reaches
LIKELY. All is built from SQL functions. The models are one table of 128 x 128 numbers, whatever the input's size.

`samples` makes the labelled samples: digests written in several alphabets are the random ones; the words of
documents that `labels` marks with quality 1 (`BOUND` documents at most, in the order of a hash of doc_id), freed from
what the patterns match, are the ordinary ones, alone and joined as identifiers and paths are (camel case, underscores,
hyphens, slashes). What LIKELY makes of samples of neither kind's training is measured by the tests.

Spans count code points, the end is exclusive. Offsets are prefix sums over the pieces between matches, in two levels,
so that a text with very many matches stays cheap.

Defined results. Null and empty texts have no spans. Matches of one kind don't overlap, those of different kinds may;
a Markov span may equal a base span. Repeated rows and rows without doc_id are each scanned. Without labels of quality
1 there are no ordinary samples and every transition of them is equally likely. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import whole_text

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run's first match takes the rest of the run, so that the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
LEAST_ASSIGNED, LIKELY, BOUND, RANDOM, SYMBOLS, CHUNK = 6, 20.0, 2000, 20_000, 128, 256

SPAN = "array<struct<start:int,end:int,text:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def located(found: Column, between: Column) -> Column:
    """The spans of found (texts of matches), between the pieces' texts around them."""

    def spans(x: Column) -> Column:
        pieces, lengths, step = x["pieces"], x["lengths"], x["step"]
        chunks = F.sequence(F.lit(0), F.floor((F.size(step) - 1) / CHUNK).cast("int"))
        sums = F.transform(chunks, lambda c: total(F.slice(step, c * CHUNK + 1, F.lit(CHUNK))))
        before = let(sums, lambda s: F.transform(chunks, lambda c: total(F.slice(s, F.lit(1), c))))

        def one(b: Column) -> Callable[[Column, Column], Column]:
            def at(text: Column, i: Column) -> Column:
                c = F.floor(i / CHUNK).cast("int")
                start = F.get(b, c) + total(F.slice(step, c * CHUNK + 1, i - c * CHUNK)) + F.get(pieces, i)
                return F.struct(start.alias("start"), (start + F.get(lengths, i)).alias("end"), text.alias("text"))

            return at

        return let(before, lambda b: F.transform(x["found"], one(b)))

    size = lambda texts: F.transform(texts, lambda t: F.char_length(t))
    parts = F.struct(found.alias("found"), size(found).alias("lengths"), size(between).alias("pieces"))
    return let(parts, lambda p: let(F.struct(p["found"].alias("found"), p["lengths"].alias("lengths"), p["pieces"].alias("pieces"), F.zip_with(p["lengths"], F.slice(p["pieces"], F.lit(1), F.size(p["lengths"])), lambda a, b: a + b).alias("step")), spans))


def matches(text: Column, pattern: str) -> Column:
    """The spans (start, end, text) of a pattern; most texts end at the first look."""
    return F.when(text.rlike(pattern), located(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1))).otherwise(F.array().cast(SPAN))


def assigned(text: Column) -> Column:
    """Matches of ASSIGN whose value is long enough; the others are dropped after they have matched."""
    long = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.char_length(v) >= LEAST_ASSIGNED)
    return F.when(text.rlike(ASSIGN), let(F.struct(matches(text, ASSIGN).alias("all"), long.alias("long")), lambda x: F.filter(x["all"], lambda s, i: F.get(x["long"], i)))).otherwise(F.array().cast(SPAN))


def samples(spark: SparkSession, docs: DataFrame, labels: DataFrame, bound: int = BOUND, random: int = RANDOM) -> DataFrame:
    """Labelled samples (token, random)."""
    chosen = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(bound)
    text = whole_text()
    for pattern in (ASSIGN, ACCESS, HEX):
        text = F.regexp_replace(text, pattern, " ")
    read = docs.join(F.broadcast(chosen), docs["doc_id"].cast("long") == F.col("__id"), "left_semi")  # at most `bound` ids are sent
    words = read.select(F.explode(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+"), F.lit(0))).alias("token"))
    runs = read.select(F.explode(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9]+(?: [A-Za-z0-9]+){1,3}"), F.lit(0))).alias("token"))
    joined = [F.replace(F.initcap("token"), F.lit(" "), F.lit("")), *[F.translate("token", " ", x) for x in "_-/"], F.translate(F.upper("token"), " ", "_")]
    runs = runs.select(F.element_at(F.array(*joined), (F.pmod(F.xxhash64("token"), F.lit(len(joined))) + 1).cast("int")).alias("token"))
    words = words.union(runs).select("token", F.lit(False).alias("random"))
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    base64 = F.base64(F.unhex(digest))
    kinds = [digest, F.upper(digest), base64, F.translate(base64, "+/=", "-_"), F.upper(F.translate(base64, "+/=", ""))]
    kind = F.element_at(F.array(*kinds), (F.col("id") % len(kinds) + 1).cast("int"))
    return words.union(spark.range(random).select(kind.alias("token"), F.lit(True).alias("random")))


def codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.ascii(c) % SYMBOLS)


def pairs(codes: Column, value: Callable[[Column, Column], Column]) -> Column:
    """value(a, b) for neighbours of an array, the first after a zero."""
    return F.zip_with(F.slice(F.concat(F.array(F.lit(0)), codes), F.lit(1), F.size(codes)), codes, value)


def train(labelled: DataFrame) -> list[float]:
    """The log-likelihood ratio of each transition a, b at a * SYMBOLS + b, from rows (token, random)."""
    spark = labelled.sparkSession
    tokens = labelled.where("token <> ''").groupBy("token", "random").agg(F.count("*").alias("n"))
    moves = tokens.select("random", "n", F.explode(pairs(codes(F.col("token")), lambda a, b: a * SYMBOLS + b)).alias("move"))
    counts = moves.groupBy("move").agg(*[F.coalesce(F.sum(F.when(F.col("random") == truth, F.col("n"))), F.lit(0)).alias(name) for name, truth in (("r", True), ("o", False))])
    cells = spark.range(SYMBOLS * SYMBOLS).withColumnRenamed("id", "move")  # whatever the input's size
    full = cells.join(counts, "move", "left").fillna(0).withColumn("a", F.floor(F.col("move") / SYMBOLS))
    row = full.groupBy("a").agg(F.sum("r").alias("ra"), F.sum("o").alias("oa"))
    kinds = 68  # symbols that tokens are made of
    ratio = F.log((F.col("r") + 0.5) / (F.col("ra") + 0.5 * kinds)) - F.log((F.col("o") + 0.5) / (F.col("oa") + 0.5 * kinds))
    one = full.join(row, "a").select("move", F.round(ratio, 6).alias("x")).agg(F.array_sort(F.collect_list(F.struct("move", "x"))).alias("all")).select("all.x").first()
    return list(one["x"])


def ratio(token: Column, table: list[float]) -> Column:
    known = F.lit(np.array(table))
    return F.aggregate(let(codes(token), lambda c: pairs(c, lambda a, b: F.get(known, a * SYMBOLS + b))), F.lit(0.0), lambda s, x: s + x)


def scan(docs: DataFrame, table: list[float], likely: float = LIKELY) -> DataFrame:
    """doc_id and found: array<struct<start, kind_no, end, kind, text, score>> in order, for each row of docs."""
    text = F.col("text")
    guessed = F.filter(F.transform(matches(text, CANDIDATE), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), ratio(s["text"], table).alias("score"))), lambda s: s["score"] >= likely)

    def named(spans: Column, no: int, score: bool = False) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end"), F.lit(KINDS[no]).alias("kind"), s["text"].alias("text"), (s["score"] if score else F.lit(None).cast("double")).alias("score")))

    found = F.concat(named(assigned(text), 0), named(matches(text, ACCESS), 1), named(matches(text, HEX), 2), named(guessed, 3, True))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).select("doc_id", F.array_sort(found).alias("found"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = train(samples(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    found = scan(docs, table)

    def many(no: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind_no"] == no)).cast("long")

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("found", lambda s: s["kind_no"] < 3)
    return found.select(
        "doc_id",
        many(0).alias("n_assign"),
        many(1).alias("n_access"),
        many(2).alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
        many(3).alias("n_markov"),
    )
