"""SentencePiece encoding with N-best segmentations, and decoding.

A text becomes U+2581 for its start and for each space, and is segmented into pieces of a SentencePiece vocabulary;
a segmentation's score is the sum of its pieces' scores. Characters that are in no piece, and U+2581 itself, become
the byte pieces of their UTF-8, so that decoding gives back every text exactly.

No piece crosses a word start, so the lattice of a text is a chain of the lattices of its words; words of more than
LONG characters (CJK, base64) are cut further where no piece of the vocabulary crosses. Of each word the
best segmentation and the loss of the second best are found by Viterbi passes (forward and backward, vectorised
over words of one length): the second best is the best path through an edge off the best path. In the N best of a
text only those words can differ from their best whose loss is among the N - 1 least; for those the N best are
searched by A* from the end of the word, whose exact heuristics are the forward Viterbi scores. They are then
combined to the N best of the whole text.

The scores are those that the vocabulary states. In a BPE vocabulary these are merge ranks, so that the segmentation of
the best score is not the one that merging would give.

Defined results. Null and empty texts have no pieces, one segmentation and score 0. Of segmentations of equal score
each counts; which come first is fixed but not defined. Lone surrogates cannot occur in a Spark string. Repeated
rows are each encoded.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEPT, slices, small_batches, tidy, whole_text

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
START, BEST, LONG = "▁", 4, 64
OWN = "\ud800"  # stands for a START of the text itself: no Spark string holds a lone surrogate
NONE = -1e300
SCHEMA = "doc_id long, n_pieces long, ids array<int>, score double, others array<struct<score:double,changes:array<struct<first:int,after:int,ids:array<int>>>>>, round_trip boolean"


class _Places(dict):
    """Places of words in the store; a word that is not there yet gets the next place and is held as new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        out = self[word] = len(self)
        self.new.append(word)
        return out


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [i for i in range(len(self.pieces)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {self.pieces[i]: model.get_score(i) for i in plain}
        self.id = {self.pieces[i]: i for i in plain}
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_score = [model.get_score(i) for i in self.byte]
        self.raw = [p.replace(START, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte):
            self.raw[i] = bytes([b])
        self.longest = max(map(len, self.score))
        if any(START in p.lstrip(START) for p in self.score):
            raise ValueError("a piece crosses a word start")
        cut = "" if any("\n" in p and len(p) > 1 for p in self.score) else "\n"
        self.words = re.compile(f"{START}*[^{START}{cut}]+|{START}+" + ("|\n" if cut else ""))
        hashes = self._hash_all(list(self.score))
        order = np.argsort(hashes)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces have one hash")
        bits = 21
        self._shift = np.uint64(64 - bits)
        self._first = np.searchsorted(hashes[order], np.arange(1 << bits, dtype=np.uint64) << self._shift).astype(np.int32)
        self._deep = int(np.bincount((hashes >> self._shift).astype(np.int64)).max())
        # a place past the end, for probes that run over
        self._keys = np.concatenate([hashes[order], np.zeros(self._deep, np.uint64)])
        self._scores = np.concatenate([np.array(list(self.score.values()))[order], [NONE] * self._deep])
        self._ids = np.array(list(self.id.values()), np.int32)[order]
        self.forget()

    def forget(self) -> None:
        """Empties the store of known words: their best segmentations, end to end, with scores and losses."""
        self.known = _Places()
        self.searched: dict[tuple[str, int], list] = {}
        self.flat, self.first, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.best, self.loss = np.empty(0), np.empty(0)

    @staticmethod
    def _hash_all(words: list[str]) -> np.ndarray:
        out = []
        for w in words:
            h = np.zeros(1, np.uint64)
            for c in w:
                h = Vocabulary._step(h, np.uint64(ord(c)))
            out.append(h[0])
        return np.array(out, np.uint64)

    @staticmethod
    def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        h = (h ^ (c + np.uint64(0x632BE5AB))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(31))

    def _look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the pieces with these hashes, or -1."""
        at = self._first[(hashes >> self._shift).astype(np.int64)]
        out = np.where(self._keys[at] == hashes, at, np.int32(-1))
        for k in range(1, self._deep):
            out = np.where(self._keys[at + k] == hashes, at + np.int32(k), out)
        return out

    # one word, any length

    def edges(self, word: str, j: int) -> Iterator[tuple[int, float, tuple[int, ...]]]:
        """(start, score, ids) of what may end at j."""
        for i in range(max(0, j - self.longest), j):
            s = self.score.get(word[i:j])
            if s is not None:
                yield i, s, (self.id[word[i:j]],)
        if word[j - 1] not in self.score:
            data = (START if word[j - 1] == OWN else word[j - 1]).encode()
            yield j - 1, sum(self.byte_score[b] for b in data), tuple(self.byte[b] for b in data)

    def forward(self, word: str) -> array:
        """Viterbi scores of the prefixes."""
        best = array("d", [NONE]) * (len(word) + 1)
        best[0] = 0.0
        for j in range(1, len(word) + 1):
            best[j] = max(best[i] + s for i, s, _ in self.edges(word, j))
        return best

    def n_best(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a word, by A* from its end.

        As the heuristics are exact, each entry stands for a segmentation of just its score and no two for the same, so
        that no more entries need to be held than segmentations are still wanted; edges are found again where needed.
        """
        best = self.forward(word)
        turn = 0
        heap: list[tuple] = [(-best[-1], turn, len(word), 0.0, None)]
        out: list[tuple[float, list[int]]] = []
        while heap and len(out) < n:
            _, _, at, behind, path = heapq.heappop(heap)
            if not at:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((behind, ids))
                continue
            for i, s, ids in self.edges(word, at):
                turn += 1
                heapq.heappush(heap, (-(best[i] + s + behind), turn, i, behind + s, (ids, path)))
            if len(heap) > n - len(out):
                heap = heapq.nsmallest(n - len(out), heap)
        return out

    def cut(self, word: str) -> list[str]:
        """A long word cut wherever no piece crosses: the lattice is the chain of its parts' lattices."""
        chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        out, first, open_until = [], 0, 0  # open_until: the furthest end of a piece that has begun
        for at in range(0, len(chars), 1 << 15):
            some = chars[at : at + (1 << 15) + self.longest].astype(np.uint64)
            n = min(1 << 15, len(chars) - at)
            reach = np.arange(1, n + 1)
            h = np.zeros(n, np.uint64)
            for k in range(1, self.longest + 1):
                m = min(n, len(some) - k + 1)
                if m <= 0:
                    break
                h = self._step(h[:m], some[k - 1 : k - 1 + m])
                found = self._look_up(h) >= 0
                reach[:m][found] = np.flatnonzero(found) + k
            furthest = np.maximum.accumulate(np.maximum(reach + at, open_until))
            for end in (np.flatnonzero(furthest == np.arange(at + 1, at + n + 1)) + at + 1).tolist():
                out.append(word[first:end])
                first = end
            open_until = int(furthest[-1])
        return out

    def ranked(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        """`n_best`, kept for short words."""
        out = self.searched.get((word, n))
        if out is None:
            out = self.n_best(word, n)
            if len(word) <= 24:
                self.searched[word, n] = out
        return out

    def _one(self, word: str) -> tuple[list[int], float, float]:
        two = self.n_best(word, 2)
        return two[0][1], two[0][0], two[0][0] - two[1][0] if len(two) > 1 else float("inf")

    # many words of one length

    def _many(self, words: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(usable, pieces by row, -1 before the first, scores, losses); words with bytes are not usable."""
        chars = np.array(words, f"U{length}").view(np.uint32).reshape(-1, length).astype(np.uint64)
        n = len(words)
        deep = min(length, self.longest)
        place = np.full((length, deep + 1, n), -1, np.int32)
        for i in range(length):
            h = np.zeros(n, np.uint64)
            for k in range(1, min(deep, length - i) + 1):
                h = self._step(h, chars[:, i + k - 1])
                place[i, k] = self._look_up(h)
        usable = (place[:, 1] >= 0).all(0)
        score = np.where(place >= 0, self._scores[place], NONE)
        ahead = np.full((length + 1, n), NONE)
        took = np.zeros((length + 1, n), np.int32)
        ahead[0] = 0
        for j in range(1, length + 1):
            for k in range(1, min(deep, j) + 1):
                s = ahead[j - k] + score[j - k, k]
                better = s > ahead[j]
                ahead[j][better] = s[better]
                took[j][better] = k
        behind = np.full((length + 1, n), NONE)
        behind[length] = 0
        for i in range(length - 1, -1, -1):
            for k in range(1, min(deep, length - i) + 1):
                np.maximum(behind[i], behind[i + k] + score[i, k], out=behind[i])
        on = np.zeros((length, deep + 1, n), bool)
        everyone = np.arange(n)
        at = np.where(usable, length, 0)
        steps = []
        while (at > 0).any():
            k = took[at, everyone]
            go = at > 0
            at = at - k
            on[at[go], k[go], everyone[go]] = True
            steps.append(np.where(go, self._ids[place[at, k, everyone]], -1))
        second = np.full(n, NONE)
        for i in range(length):
            for k in range(1, min(deep, length - i) + 1):
                s = ahead[i] + score[i, k] + behind[i + k]
                np.maximum(second, np.where(on[i, k] | (place[i, k] < 0), NONE, s), out=second)
        total = ahead[length]
        loss = np.where(second > NONE / 2, total - second, np.inf)
        return usable, np.array(steps[::-1], np.int32).reshape(-1, n).T, total, loss

    def learn(self) -> None:
        """Adds the new words to the store, in the order of their places."""
        words, self.known.new = self.known.new, []
        if not words:
            return
        groups: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            groups[len(w)].append(i)
        flat, count, best, loss, order = [], [], [], [], []
        singly: list[int] = []
        for length, some in groups.items():
            if length > 24 or len(some) < 8:
                singly += some
                continue
            for at in range(0, len(some), 4096):
                part = np.array(some[at : at + 4096])
                usable, rows, score, less = self._many([words[i] for i in part.tolist()], length)
                if not usable.all():
                    singly += part[~usable].tolist()
                    part, rows, score, less = part[usable], rows[usable], score[usable], less[usable]
                order.append(part)
                flat.append(rows[rows >= 0])
                count.append((rows >= 0).sum(1))
                best.append(score)
                loss.append(less)
        for i in singly:
            ids, score, less = self._one(words[i])
            order.append(np.array([i]))
            flat.append(np.array(ids, np.int32))
            count.append(np.array([len(ids)]))
            best.append(np.array([score]))
            loss.append(np.array([less]))
        back = np.argsort(np.concatenate(order))
        counts = np.concatenate(count)
        first = (np.cumsum(counts) - counts + len(self.flat))[back]
        self.flat = np.concatenate([self.flat, *flat])
        self.first, self.count = np.concatenate([self.first, first]), np.concatenate([self.count, counts[back]])
        self.best, self.loss = np.concatenate([self.best, np.concatenate(best)[back]]), np.concatenate([self.loss, np.concatenate(loss)[back]])

    # texts

    def split(self, text: str) -> list[str]:
        """The words of a text with START for spaces; a START of the text itself becomes OWN."""
        if not text:
            return []
        words = self.words.findall(START + text.replace(START, OWN).replace(" ", START))
        if len(max(words, key=len)) > LONG:
            words = [part for w in words for part in (self.cut(w) if len(w) > LONG else (w,))]
        return words

    def encode(self, text: str, n: int = BEST) -> tuple[np.ndarray, float, list]:
        """(ids, score, others): the best segmentation, and the next n - 1 as changes (first, after, ids) of it."""
        return next(self.encode_all([self.split(text)], n))

    def encode_all(self, texts: list[list[str]], n: int) -> Iterator[tuple[np.ndarray, float, list]]:
        """`encode` for texts that are split."""
        places = [np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)) for words in texts]
        self.learn()
        for words, at in zip(texts, places):
            count = self.count[at]
            ends = np.cumsum(count)
            ids = self.flat[np.repeat(self.first[at] - (ends - count), count) + np.arange(count.sum())]
            score, loss = float(self.best[at].sum()), self.loss[at]
            near = np.flatnonzero(np.isfinite(loss))
            if len(near) > n - 1:  # the n - 1 words of least loss, the first of equal ones
                most = np.partition(loss[near], n - 2)[n - 2] if n > 1 else -1.0
                near = np.concatenate([near[loss[near] < most], near[loss[near] == most]])[: n - 1]
            top: list[tuple[float, list]] = [(0.0, [])]
            for i in np.sort(near).tolist():
                after = int(ends[i])
                first = after - int(count[i])
                mine, best = ids[first:after].tolist(), float(self.best[at[i]])
                choices, same = [(0.0, None)], False
                for s, other in self.ranked(words[i], n):
                    if not same and other == mine:
                        same = True
                    else:
                        choices.append((best - s, (first, after, other)))
                top = sorted(((d + less, changes + [c] if c else changes) for d, changes in top for less, c in choices), key=lambda x: x[0])[:n]
            yield ids, score, [(score - d, changes) for d, changes in top[1:]]

    def decode(self, ids: list[int]) -> str:
        whole = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return whole[1:] if whole.startswith(" ") else whole


_LOADED: dict[str, Vocabulary] = {}
KEPT["vocabularies"] = _LOADED.clear


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def decoder(path: str = VOCABULARY):
    """A UDF from arrays of identifiers to texts."""

    @F.pandas_udf(T.StringType())
    def decode(ids: pd.Series) -> pd.Series:
        v = vocabulary(path)
        return pd.Series([None if x is None else v.decode(x) for x in ids])

    return decode


def encode(docs: DataFrame, path: str = VOCABULARY, n: int = BEST, held: int = 200_000) -> DataFrame:
    """Rows (SCHEMA) for the rows (doc_id, text) of docs. A worker keeps some `held` words at most, some 40 MB, from task to task."""
    others = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))

    def some(v: Vocabulary, doc_ids: list, texts: list[str]) -> pa.RecordBatch:
        split = [v.split(t) for t in texts]
        if len(v.known) > held or len(v.searched) > held:
            v.forget()
        best, scores, more, right = [np.empty(0, np.int32)], [], [], []
        for text, (ids, score, rest) in zip(texts, v.encode_all(split, n)):
            best.append(ids)
            scores.append(score)
            more.append([{"score": s, "changes": [{"first": a, "after": b, "ids": c} for a, b, c in changes]} for s, changes in rest])
            right.append(v.decode(ids.tolist()) == text)
        ends = np.cumsum([len(x) for x in best]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(best)))
        return pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, pa.int64()), pa.array(np.diff(ends), pa.int64()), lists, pa.array(scores, pa.float64()), pa.array(more, others), pa.array(right, pa.bool_())],
            names=["doc_id", "n_pieces", "ids", "score", "others", "round_trip"],
        )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for part in parts:
            doc_ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for at in slices(texts, 1_000_000):
                yield some(v, doc_ids[at], texts[at])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(tidy(run), SCHEMA)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
