"""Brute-force versions of what SQL can't express: segmentations, Kneser-Ney, similar windows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from pagelathe.llm import decontaminate, pieces, quality
from pagelathe.llm.common import Scratch
from pagelathe.llm.words import word_hashes

V = pieces.vocabulary(pieces.VOCABULARY)


def segmentations(text):
    """All (score, ids) of a text with START for its start and spaces."""
    if not text:
        return [(0.0, [])]
    out = []
    for k in range(1, min(len(text), V.longest) + 1):
        head = text[:k]
        if head in V.score:
            first = [(V.score[head], [V.id[head]])]
        elif k == 1:
            data = head.encode()
            first = [(sum(V.byte_score[b] for b in data), [V.byte[b] for b in data])]
        else:
            continue
        out += [(s + t, a + b) for s, a in first for t, b in segmentations(text[k:])]
    return out


@pytest.mark.parametrize("text", ["banana", "to be or", "a", "日本語x", "x🙂 of", "sees the", "\nthe", "  in"])
def test_n_best_against_all_segmentations(text):
    every = sorted(segmentations("▁" + text.replace(" ", "▁")), key=lambda x: -x[0])
    ids, score, others = V.encode(text, 4)
    got = [score] + [s for s, _ in others]
    assert np.allclose(got, [s for s, _ in every[:4]])
    known = {tuple(i): s for s, i in every}
    whole = [ids.tolist()]
    for _, changes in others:
        one = ids.tolist()
        for a, b, c in sorted(changes, reverse=True):
            one[a:b] = c
        whole.append(one)
    assert len(set(map(tuple, whole))) == len(whole) and np.allclose([known[tuple(w)] for w in whole], got)


@pytest.mark.parametrize("word", ["東京都に住んでいる" * 20, "aGVsbG8gd29ybGQK" * 12, "x" * 100, "🙂" * 80, "antidisestablishmentarianism" * 4])
def test_long_words_are_cut_without_loss(word):
    parts = V.cut("▁" + word)
    assert "".join(parts) == "▁" + word
    whole, each = V.n_best("▁" + word, 1)[0], [V.n_best(p, 1)[0] for p in parts]
    assert math.isclose(whole[0], sum(s for s, _ in each), abs_tol=1e-6)
    ids, score, others = V.encode(word, 3)
    assert math.isclose(score, whole[0], abs_tol=1e-6) and V.decode(ids.tolist()) == word
    assert np.allclose([s for s, _ in others], [s for s, _ in V.n_best("▁" + word, 3)[1:]])


def test_words_hash_alike_wherever_they_stand():
    texts = ["", "One  two_3 ONE\n", "x" * 700_000 + " two_3", "é\xa0É", None or "one"]
    for kind, split in (("letters", decontaminate.words_of), ("blanks", lambda t: "".join(c.lower() if c.isascii() else c for c in t).split(" "))):
        hashes, bounds = word_hashes([t.lower() if kind == "letters" else t for t in texts], kind)
        words = [[w for w in (split(t) if kind == "letters" else split(t.replace("\n", " "))) if w] for t in texts]
        assert np.diff(bounds).tolist() == list(map(len, words))
        known = dict(zip([w for some in words for w in some], hashes.tolist()))
        assert [known[w] for some in words for w in some] == hashes.tolist() and len(set(known.values())) == len(known)


def windows_like(words, item):
    width = min(5, len(item))
    grams = lambda x: Counter(tuple(x[i : i + width]) for i in range(len(x) - width + 1))
    own = grams(item)
    return max((decontaminate.similarity(own, grams(words[i : i + len(item)])) for i in range(max(1, len(words) - len(item) + 1))), default=0.0)


def test_recall_of_windows_of_all_lengths():
    """Items of 1 to 300 words, some with repeats, near the threshold on both sides: what verifying all windows finds."""
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(600)]
    items, docs = [], []
    for n in [*range(1, 60), *range(60, 300, 20)]:
        for repeats in (False, True):
            item = list(rng.choice(vocabulary, n))
            if repeats and n > 12:
                item[n // 3 : n // 2] = ["again"] * (n // 2 - n // 3)
            copy = list(item)
            for _ in range(int(rng.integers(0, max(1, n // 20) + 1))):
                copy[int(rng.integers(0, n))] = "changed"
            if repeats and n > 40:
                copy[5 : 5 + n // 9] = ["same"] * (n // 9)
            items.append((len(items), " ".join(item)))
            docs.append(" ".join([*rng.choice(vocabulary, 15), *copy, *rng.choice(vocabulary, 9)]))
    found = {(t, i): s for t, i, s, _, _ in decontaminate.Items(items).search(docs)}
    want = {}
    for t, text in enumerate(docs):
        words = decontaminate.words_of(text)
        for i, item in items:
            if i == t or len(item.split()) < 5:
                s = windows_like(words, decontaminate.words_of(item))
                if s >= 0.8:
                    want[t, i] = s
    missed = want.keys() - found.keys()
    assert len(want) > 80 and len(missed) <= 0.01 * len(want), missed
    assert all(math.isclose(found[k], want[k]) for k in want.keys() & found.keys())
    assert all(k in want for k in found if k[0] == k[1])


def test_decontamination_defined_results(spark):
    item = " ".join(f"word{i}" for i in range(20))
    long = "filler " * 400_000 + item
    rows = [(1, item, 5, "a"), (1, item, 5, "a"), (2, long, 6, "b"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long, similarity string")
    bench = spark.createDataFrame([(7, item), (7, item + " more"), (8, item)], "item_id long, text string")
    out = sorted((r.doc_id, r.item_id, r.similarity, r.start_word) for r in decontaminate.contaminated(spark, docs, bench).collect())
    assert out == [(1, 7, 1.0, 0), (1, 7, 1.0, 0), (1, 8, 1.0, 0), (1, 8, 1.0, 0), (2, 7, 1.0, 400_000), (2, 8, 1.0, 400_000)]
    assert sorted(map(tuple, decontaminate.contaminated(spark, docs, bench, block=1).groupBy("doc_id", "item_id").count().select("doc_id", "item_id").collect())) == [(1, 7), (1, 8), (2, 7), (2, 8)]
    kept = decontaminate.drop_contaminated(spark, docs, bench)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [None]


def brute_model(texts, order=5):
    """p(char | context before it) of interpolated modified Kneser-Ney, over characters."""
    begin = "\x02" * (order - 1)
    tables = {order: Counter()}
    for t in texts:
        t = begin + " ".join(t.split())
        tables[order].update(t[i - order + 1 : i + 1] for i in range(order - 1, len(t)))
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    less = {}
    for k, table in tables.items():
        of = Counter(table.values())
        d = quality.discounts({i: of[i] for i in (1, 2, 3, 4)})
        less[k] = lambda n, d=d: d[min(n, 3) - 1]
    by = {k: defaultdict(list) for k in tables}
    for k, table in tables.items():
        for g, n in table.items():
            by[k][g[:-1]].append(n)
    size = len(tables[1]) + 1

    def p(context, c):
        k = len(context) + 1
        some = by[k].get(context)
        if k > 1 and not some:
            return p(context[1:], c)
        total, mass = sum(some), sum(map(less[k], some))
        n = tables[k].get(context + c, 0)
        own = (n - less[k](n)) / total if n else 0
        return own + mass / total * (p(context[1:], c) if k > 1 else 1 / size)

    def perplexity(text):
        text = " ".join(text.split())
        if not text:
            return None
        t = begin + text
        return math.exp(-sum(math.log(p(t[i - order + 1 : i], t[i])) for i in range(order - 1, len(t))) / len(text))

    return perplexity


@pytest.mark.parametrize("shard", [1_000_000, 400])
def test_perplexity_against_brute_force(spark, shard):
    texts = ["the cat sat on the mat and the dog sat on the log", "a dog and a cat  met\nat the mat", "sad dogs sat at logs"] * 2
    asked = [*texts[:2], "the dog met a bat", "ZQ!", "", None, "s", "the cat " * 300, "naïve 東京"]
    model = quality.train(spark.createDataFrame([(t,) for t in texts], "text string"), Scratch(spark, "t"), shard)
    assert (model.bits > 0) == (shard == 400)
    got = [r.p for r in spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "i int, text string").select("i", model.column().alias("p")).orderBy("i").collect()]
    brute = brute_model(texts)
    for x, t in zip(got, asked):
        want = brute(t or "")
        assert (x is None and want is None) or math.isclose(x, want, rel_tol=1e-4), (t, x, want)


def test_portions_and_shards_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    one, many = (quality.train(docs.select("text"), Scratch(spark, "t"), shard) for shard in (10_000_000, 20_000))
    assert one.bits == 0 and many.bits >= 2
    parts = [pd.Series(texts[i : i + 30]) for i in range(0, len(texts), 30)]
    whole = np.concatenate(list(one.perplexities(iter(parts))))
    monkeypatch.setattr(quality, "PORTION", 50_000)
    monkeypatch.setattr(quality, "HOLD", 40_000)
    assert np.allclose(whole, np.concatenate(list(many.perplexities(iter(parts)))), rtol=1e-5)
    assert sum(len(x[0]) for x in many.shards.values()) <= 40_000 + 30_000


def test_quality_defined_results(spark):
    text = "some words of a plain text that goes on for a while "
    rows = [(i, text + str(i % 7), "en", "doc", i) for i in range(60)] + [(60, None, "en", None, 1), (61, "", None, "x", 2), (62, "qzx jj kkvv !!", "en", "x", 3), (62, "qzx jj kkvv !!", "en", "x", 3), (None, text, "xx", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, perplexity string, keep long")
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(3, 0), (None, 1)], "doc_id long, quality int")
    out = quality.quality(spark, docs, labels).collect()
    assert len(out) == len(rows)
    assert all(r.keep for r in out if r.doc_id in (60, 61)) and all(r.perplexity is None for r in out if r.doc_id in (60, 61))
    assert [r.keep for r in out if r.doc_id == 62] == [False, False]
    kept = quality.drop_poor(spark, docs, labels)
    assert kept.columns == docs.columns and sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, *range(62)]
    assert quality.drop_poor(spark, docs, labels.where("quality = 7")).count() == len(rows)
