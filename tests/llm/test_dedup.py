from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash

from pagelathe.llm import exact_dedup, near_dedup
from pagelathe.llm.common import Scratch

FIELDS = "doc_id long, text string, lang string, digest string"
D = "/root/testdata/sf0.001"


def test_exact_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    cols = "doc_id, keep_id, group_size, kept, text_sha256"
    got = exact_dedup.op2_exact_dedup(spark, D).selectExpr(*cols.split(", ")).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT {cols} FROM ({exact_dedup.ORACLE})").fetchall())


def test_exact_edges(spark):
    rows = [(1, None, "a", "x"), (2, "", "b", "y"), (3, "t", "c", "z"), (4, "t ", "c", "z"), (None, "t", "c", "z"), (5, "u", "c", "z"), (5, "u", "c", "z")]
    docs = spark.createDataFrame(rows, FIELDS)
    scratch = Scratch(spark, "t")
    index = exact_dedup.new_index(spark, scratch)
    out = {(r.doc_id, r.kept, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs, index, scratch).collect()}
    assert out == {(1, False, 2, 2), (2, True, 2, 2), (3, True, 3, 2), (4, True, 4, 1), (None, False, 3, 2), (5, True, 5, 2)}
    more = spark.createDataFrame([(9, "t", "", ""), (8, "new", "", "")], FIELDS)
    again = Scratch(spark, "t")
    assert {(r.doc_id, r.kept, r.keep_id) for r in exact_dedup.exact_dedup(more, index, again).collect()} == {(9, False, 3), (8, True, 8)}
    index.forget()
    kept = exact_dedup.drop_copies(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]
    assert exact_dedup.drop_copies(spark, docs.limit(0)).count() == 0


def brute_print(text):
    words = "".join(c.lower() if c.isascii() else c for c in text).translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), seed=42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(prints):
    owner = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(prints, 2):
            if bin(prints[a] ^ prints[b]).count("1") <= 4 and owner[a] != owner[b]:
                owner[a] = owner[b] = min(owner[a], owner[b])
                changed = True
    return owner


def test_near_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    prints = {r.doc_id: brute_print(r.text or "") for r in docs.collect()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_dedup.op5_simhash_near_dedup(spark, D).collect()}
    owner = brute_components(prints)
    assert got == {i: (f"{p:016x}", owner[i]) for i, p in prints.items()}


@pytest.mark.parametrize("blocks, limit", [(6, 2048), (8, 2048), (6, 3)])
def test_links_of_close_fingerprints(spark, blocks, limit):
    rng = np.random.default_rng(3)
    prints = {}
    for i in range(60):
        base = int(rng.integers(0, 2**63)) if i % 6 == 0 or not prints else prints[i - 1]
        flips = rng.choice(64, int(rng.integers(1, 7)), replace=False)
        prints[i] = base ^ sum(1 << int(b) for b in flips)
    rows = [(int(np.uint64(p).view(np.int64)), i) for i, p in prints.items()]
    scratch = Scratch(spark, "t")
    edges = near_dedup.links(spark, spark.createDataFrame(rows, "fp long, rep long"), scratch, blocks, limit)
    got = {r.node: r.component for r in near_dedup.components(edges, scratch).collect()}
    assert {i: got.get(i, i) for i in prints} == brute_components(prints)


def test_near_edges(spark):
    docs = spark.createDataFrame([(1, None, "", ""), (2, " \n", "", ""), (3, "One two", "", ""), (4, "one  TWO", "", ""), (None, "x", "", ""), (4, "one two", "", "")], FIELDS)
    out = sorted((r.doc_id or 0, r.component_id) for r in near_dedup.near_dedup(spark, docs).collect())
    assert out == [(0, None), (1, 1), (2, 1), (3, 3), (4, 3), (4, 3)]
    assert sorted(r.doc_id or 0 for r in near_dedup.one_of_each(spark, docs).collect()) == [0, 1, 3]
    assert near_dedup.near_dedup(spark, docs.limit(0)).count() == 0


def brute_near_copies(texts):
    def grams(text):
        words = text.lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {i: grams(t) for i, t in texts.items()}
    owner = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(texts, 2):
            if owner[a] != owner[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                owner[a] = owner[b] = min(owner[a], owner[b])
                changed = True
    return owner


@pytest.mark.parametrize("crowd", [64, 2])
def test_stage_links_at_similarity(spark, crowd):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for i in range(120):
        if i % 4 == 0:
            now = list(rng.choice(words, int(rng.integers(3, 150))))
        else:
            now = list(now)
            for _ in range(int(rng.integers(0, 3))):
                now[int(rng.integers(0, len(now)))] = str(rng.choice(words))
        texts[i] = " ".join(now)
    # a crowd round one text, and one with a shared line only
    base = list(rng.choice(words, 200))
    for i in range(120, 420):
        texts[i] = " ".join(base[: (i * 7) % 200] + [f"x{i}"] + base[(i * 7) % 200 :]) if i < 300 else " ".join(base[:12] + list(rng.choice(words, 30)))
    docs = spark.createDataFrame([(i, t, "", "") for i, t in texts.items()], FIELDS)
    got = {r.doc_id: r.component_id for r in near_dedup.near_copies(spark, docs, crowd).collect()}
    want = brute_near_copies(texts)
    assert got == want and 0 < sum(i != c for i, c in want.items()) < len(want)


def test_stage_drops_near_copies(spark):
    words = [f"w{i}" for i in range(100)]
    copy = words[:40] + ["other"] + words[41:70] + ["more"] + words[71:]
    far = [f"w{i * 37 % 100}" for i in range(100)]
    docs = spark.createDataFrame([(1, " ".join(words), "", ""), (2, " ".join(copy), "", ""), (3, " ".join(far), "", "")], FIELDS)
    assert sorted(r.doc_id for r in near_dedup.one_of_each(spark, docs).collect()) == [1, 3]


def test_stage_links_fingerprints_by_blocks(spark, monkeypatch):
    """The stage's candidates come by blocks of SimHashes first; its links are those of all pairs within the radius."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(300)]
    texts = {}
    for i in range(0, 90, 3):
        base = list(rng.choice(words, 250))
        texts |= {i: " ".join(base), i + 1: " ".join([*base, "end"]), i + 2: " ".join(["begin", "here", *base])}
    sets = dict(zip(texts, near_dedup.shingle_sets(list(texts.values()))))
    prints = {i: int(near_dedup.wide_print(s)[0]) for i, s in sets.items()}
    prints[90] = prints[0]
    firsts = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()], "rep long, first long")
    owner = {i: i for i in prints}
    for _ in range(3):
        for a, b in combinations(prints, 2):
            if (prints[a] ^ prints[b]).bit_count() <= near_dedup.RADIUS:
                owner[a] = owner[b] = min(owner[a], owner[b])
    scratch = Scratch(spark, "t")
    for limit in (2048, 1):
        found = near_dedup.components(near_dedup.by_blocks(spark, firsts, limit=limit), scratch).collect()
        assert {r.node: r.component for r in found if r.node != r.component} == {i: c for i, c in owner.items() if i != c} and len(found) > 20
    met, own = [], near_dedup.by_blocks
    monkeypatch.setattr(near_dedup, "by_blocks", lambda *a, **k: met.append(own(*a, **k)) or met[-1])
    docs = spark.createDataFrame([(i, t, "", "") for i, t in texts.items()], FIELDS)
    assert {r.doc_id: r.component_id for r in near_dedup.near_copies(spark, docs).collect()} == brute_near_copies(texts)
    assert len(met) == 1 and met[0].count() > 10


def test_index_of_an_earlier_session(spark):
    """The index is files: a new session finds what an earlier one appended, and appends to it."""
    scratch = Scratch(spark, "t")
    index = exact_dedup.DigestIndex(spark, "digests_first", scratch.path("index"), 4)
    first = spark.createDataFrame([(1, "a", "", ""), (2, "b", "", "")], FIELDS)
    assert all(r.kept for r in exact_dedup.exact_dedup(first, index, scratch).collect())
    index.forget()
    other = spark.newSession()
    assert not other.catalog.tableExists("digests_first")
    again = exact_dedup.DigestIndex(other, "digests_second", scratch.path("index"), 4)
    second = other.createDataFrame([(3, "b", "", ""), (4, "c", "", ""), (5, "c", "", "")], FIELDS)
    out = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(second, again, Scratch(other, "t")).collect()}
    assert out == {3: (2, False), 4: (5, False), 5: (5, True)}
    assert sorted(r.keep_id for r in other.table("digests_second").collect()) == [1, 2, 5]
    again.forget()


def test_very_long_and_repeated_texts(spark):
    long = " ".join(f"w{i % 5000}" for i in range(300_000))
    rows = [(1, long, "", ""), (2, long + " end", "", ""), (3, "x " * 500_000, "", ""), (3, "x " * 500_000, "", ""), (4, None, "", "")]
    docs = spark.createDataFrame(rows, FIELDS)
    out = sorted((r.doc_id, r.component_id) for r in near_dedup.near_dedup(spark, docs).collect())
    assert out == [(1, 1), (2, 1), (3, 3), (3, 3), (4, 4)]
    assert sorted((r.doc_id, r.component_id) for r in near_dedup.near_copies(spark, docs).collect()) == [(1, 1), (2, 1), (3, 3), (3, 3), (4, 4)]
