"""Benchmark decontamination by latent semantic retrieval.

Items and documents are cut into passages: windows of words as TF-IDF vectors over the benchmark's vocabulary.
A randomised SVD of benchmark and corpus passages gives a latent space: one distributed pass over every passage of
every document sketches the corpus's Gram matrix, and power iterations run on that sketch and the benchmark's passages.
Every window of every document is projected there and compared, a block at a time, with every passage of the stated benchmark by cosine.
Candidates are verified by the longest common subsequence of words with the passage and by whether the item's
answer (its last words) follows where it should.

There are three sizes of windows: items of under ``SCALES[-1].least`` words are one passage each and are looked for in
windows about as short, where the words around them can't outweigh them; longer items are cut into long windows, so one
of any length is found by its parts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import table, text_of


class Scale(NamedTuple):
    """Windows of so many words, their stride, and the fewest words of an item that is looked for in them."""

    window: int
    stride: int
    least: int


SCALES = (Scale(8, 4, 0), Scale(16, 8, 8), Scale(32, 16, 24))
RANK, EXTRA, POWER = 128, 16, 2
#: Columns of the corpus's sketch, passages multiplied at a time, and the words whose rows of it are added up together.
SKETCH, FIT_ROWS, PART = 80, 64, 512
FIT_TASKS = 8
#: The benchmark's passages weigh so many times as much as all of the corpus's, as they are what has to be told apart.
FAVOUR = 16.0
#: Least cosine of a candidate.
NEAR = 0.4
#: Share of a passage's words in the longest common subsequence: enough alone, and enough with the answer.
LCS, LCS_WITH_ANSWER = 0.7, 0.5
ANSWER_WORDS = 5
ANSWER_SHARE = 0.8
#: A word outside the benchmark's counts this share of the benchmark's mean squared weight in a window's norm, so that
#: half an item is still near it. The mean is of the benchmark's own words, so it doesn't move with the corpus's size.
OUTSIDE = 0.25
#: Words of documents that are looked through at a time (a longer document is whole), windows projected and passages
#: compared at a time.
BLOCK, ROWS, TARGETS = 1 << 15, 128, 4096

_TO = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TO).split()


class Vocabulary:
    """Words of the benchmark by number; every other word has the number ``size``."""

    def __init__(self, items: list[list[bytes]]):
        self.of = {w: i for i, w in enumerate(sorted({w for t in items for w in t}))}
        self.size = len(self.of)

    def ids(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.of.get, tokens, repeat(self.size)), np.int32, len(tokens))


def window_starts(n: int, scale: Scale = SCALES[-1]) -> np.ndarray:
    return np.arange(0, max(1, n - scale.window + scale.stride), scale.stride) if n else np.zeros(0, np.int64)


def held_words(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, scale: Scale, other: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each window (a row, in order of their numbers, padded with ``other``) and the reciprocal root of each one's
    count there: a word that is there n times weighs as its root in all, so squared weights add up over words."""
    reach = starts[:, None] + np.arange(scale.window)
    held = np.where(reach < ends[:, None], ids[np.minimum(reach, len(ids) - 1)], other)
    held.sort(axis=1)
    new = np.ones(held.shape, bool)
    new[:, 1:] = held[:, 1:] != held[:, :-1]
    run = np.cumsum(new.ravel()) - 1
    return held, (1.0 / np.sqrt(np.bincount(run)))[run].reshape(held.shape).astype(np.float32)


def lcs(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel in the words of ``a``."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    every = (1 << len(a)) - 1
    v = every
    for w in b:
        m = masks.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & every
    return len(a) - v.bit_count()


@dataclass
class Retriever:
    """The latent space and the benchmark's passages in it."""

    vocabulary: Vocabulary
    item_ids: list
    items: list[list[bytes]]
    idf: np.ndarray  # by word of the vocabulary
    basis: np.ndarray  # word by latent dimension
    near: float = NEAR

    def __post_init__(self):
        size = self.vocabulary.size
        self.weighted = np.vstack([self.basis * self.idf[:, None], np.zeros((1, self.basis.shape[1]))]).astype(np.float32)
        self.square = np.append(self.idf**2, 0.0)
        self.passages: list[list[tuple[int, int, int]]] = [[] for _ in SCALES]  # (item, first word, end)
        for i, t in enumerate(self.items):
            k = max(k for k, s in enumerate(SCALES) if len(t) >= s.least)
            cut = window_starts(len(t), SCALES[k]).tolist()
            self.passages[k] += [(i, s, min(s + SCALES[k].window, len(t))) for s in cut] if SCALES[k] is SCALES[-1] else [(i, 0, len(t))]
        every = [self.vocabulary.ids(t) for t in self.items]
        self.outside = OUTSIDE * float(np.mean(np.concatenate([self.square[x] for x in every]))) if every else 0.0
        self._known: dict[tuple[int, int], dict[bytes, int]] = {}
        self.targets = []
        for scale, passages in zip(SCALES, self.passages, strict=True):
            widest = scale._replace(window=max((e - s for _, s, e in passages), default=1))
            rows = np.zeros((len(passages), self.basis.shape[1]), np.float32)
            for r, (i, s, e) in enumerate(passages):
                rows[r] = self.project(every[i], np.array([s]), np.array([e]), widest)[0]
            self.targets.append(rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9))
        assert self.square[size] == 0

    def project(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, scale: Scale) -> np.ndarray:
        held, share = held_words(ids, starts, ends, scale, self.vocabulary.size)
        return np.matmul(share[:, None, :], self.weighted[held])[:, 0]

    def candidates(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, int, int, float]]:
        """(text, item, its passage's first word and end, first word, end, best cosine) of what some window of a text (the
        numbers of its words) is near to, by text and in the order of the benchmark's passages."""
        begin = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        ids = np.concatenate([np.zeros(0, np.int32), *texts])
        energy = np.concatenate([[0.0], np.cumsum(self.square[ids])])
        others = np.concatenate([[0], np.cumsum(ids == self.vocabulary.size)])
        out = []
        for scale, passages, targets in zip(SCALES, self.passages, self.targets, strict=True):
            if not passages or not len(ids):
                continue
            own = [window_starts(len(x), scale) for x in texts]
            text = np.repeat(np.arange(len(texts)), [len(x) for x in own])
            starts = np.concatenate(own) + begin[text]
            ends = np.minimum(starts + scale.window, begin[text + 1])
            inner, outer = energy[ends] - energy[starts], (others[ends] - others[starts]) * self.outside
            # a window's length in the latent space is at most that of its words, so this leaves out none that is near
            some = np.flatnonzero((inner > 1e-9) & (inner * (1 + 1e-6) >= self.near**2 * (inner + outer)))
            found: dict[tuple[int, int], list] = {}
            for at in range(0, len(some), ROWS):
                part = some[at : at + ROWS]
                latent = self.project(ids, starts[part], ends[part], scale)
                # the norm in the latent space is of what the window has there; words outside lengthen it
                latent /= np.maximum(np.sqrt((latent**2).sum(1) + outer[part]), 1e-9)[:, None]
                for first in range(0, len(targets), TARGETS):
                    cosine = latent @ targets[first : first + TARGETS].T
                    for w, r in zip(*(x.tolist() for x in np.nonzero(cosine >= self.near)), strict=True):
                        i, t = int(part[w]), int(text[part[w]])
                        found.setdefault((t, first + r), []).append((int(starts[i] - begin[t]), int(ends[i] - begin[t]), float(cosine[w, r])))
            for (t, r), spans in found.items():
                spans.sort()
                s, e, c = spans[0]
                for s2, e2, c2 in spans[1:]:
                    if s2 <= e:
                        e, c = e2, max(c, c2)
                    else:
                        out.append((t, *passages[r], s, e, c))
                        s, e, c = s2, e2, c2
                out.append((t, *passages[r], s, e, c))
        return sorted(out)

    def verify(self, tokens: list[bytes], i: int, ps: int, pe: int, s: int, e: int) -> tuple[float, float]:
        """Share of an item's passage in its longest common subsequence with the words around a candidate, and share
        of the item's answer there or, if the passage isn't the item's last, where it should follow. Long stretches
        are compared in overlapping parts of twice the passage; one that has too few of its words is none."""
        item, counts = self.items[i], self._counts(i, ps, pe)
        length = pe - ps
        size, first = 2 * length, max(0, s - length)
        region, best, answer = tokens[first : e + length], 0.0, 0.0
        for at in range(0, max(1, len(region) - size + length // 2), max(1, length // 2)):
            part = region[at : at + size]
            if sum(map(counts.__getitem__, counts.keys() & set(part))) < max(best, LCS_WITH_ANSWER) * length:
                continue
            share = lcs(item[ps:pe], part) / length
            if share > best:
                there = first + at + size + len(item) - pe
                last = item[-ANSWER_WORDS:]
                best, answer = share, lcs(last, tokens[max(first + at, there - 2 * size) : there]) / len(last)
        return best, answer

    def _counts(self, i: int, ps: int, pe: int) -> dict[bytes, int]:
        found = self._known.get((i, ps))
        if found is None:
            found = self._known[i, ps] = dict(Counter(self.items[i][ps:pe]))
        return found

    def leaks(self, texts: list[str]) -> list[list[tuple]]:
        """Of each text (item_id, cosine, lcs, answer, first word) of the items that it gives away: of each the passage
        with the greatest share, the first one of equals."""
        out: list[list[tuple]] = []
        held: list[list[bytes]] = []
        size = 0
        for text in texts:
            held.append(words(text))
            size += len(held[-1])
            if size >= BLOCK:
                out += self._leaks(held)
                held, size = [], 0
        return out + self._leaks(held)

    def _leaks(self, texts: list[list[bytes]]) -> list[list[tuple]]:
        best: list[dict[int, tuple]] = [{} for _ in texts]
        for t, i, ps, pe, s, e, c in self.candidates([self.vocabulary.ids(x) for x in texts]):
            share, answer = self.verify(texts[t], i, ps, pe, s, e)
            if (share >= LCS or share >= LCS_WITH_ANSWER and answer >= ANSWER_SHARE) and share > best[t].get(i, (0, 0))[1]:
                best[t][i] = (c, share, answer, s)
        return [[(self.item_ids[i], *x) for i, x in sorted(found.items())] for found in best]


class Sketch:
    """Of a corpus, its documents, those that hold each word of the vocabulary, and the Gram matrix of its passages times ``x``.

    Its passages are every 32 words of a document in turn, the last ones fewer, so each word counts in one. A passage is a
    row of unit length with the root of each word's count there; words outside the vocabulary count nowhere. Word
    frequencies multiply the product afterwards, so one pass gives both.
    """

    def __init__(self, x: np.ndarray):
        self.x = x.astype(np.float32)
        self.product = np.zeros(x.shape, np.float64)
        self.df = np.zeros(len(x), np.int64)
        self.n = 0

    def add(self, texts: list[np.ndarray]) -> None:
        """Count in some texts, as the numbers of their words."""
        self.n += len(texts)
        ids = np.concatenate([np.zeros(0, np.int32), *texts])
        sizes = np.array([len(t) for t in texts], np.int64)
        text = np.repeat(np.arange(len(texts)), sizes)
        cuts = -(-sizes // SCALES[-1].window)
        place = np.arange(len(ids)) - (np.cumsum(sizes) - sizes)[text]
        passage = (np.cumsum(cuts) - cuts)[text] + place // SCALES[-1].window
        inside = ids < len(self.df)
        ids, text, passage = ids[inside], text[inside], passage[inside]
        self.df += np.bincount(np.unique(text * len(self.df) + ids) % max(1, len(self.df)), minlength=len(self.df))
        cut = np.searchsorted(passage, np.arange(0, int(cuts.sum()) + FIT_ROWS, FIT_ROWS)).tolist()
        for k, (at, end) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if at < end:
                self._add(ids[at:end], passage[at:end] - k * FIT_ROWS)

    def _add(self, ids: np.ndarray, passage: np.ndarray) -> None:
        order = np.zeros(len(self.df), np.int64)
        order[ids] = 1
        own = np.flatnonzero(order)
        order[own] = np.arange(len(own))
        a = np.bincount(passage * len(own) + order[ids], minlength=FIT_ROWS * len(own)).reshape(FIT_ROWS, len(own)).astype(np.float32)
        a = np.sqrt(a / np.maximum(a.sum(1, keepdims=True), 1))
        self.product[own] += a.T @ (a @ self.x[own])


def sketched(docs: DataFrame, vocabulary: Vocabulary, x: np.ndarray) -> Sketch:
    """The sketch of all documents. Tasks' parts are added up on the executors, by words, before they reach the driver."""
    schema = "part int, n bigint, df binary, product binary"

    def row(part: int, n: int, df: np.ndarray, product: np.ndarray) -> dict:
        return {"part": part, "n": n, "df": df.tobytes(), "product": product.astype(np.float32).tobytes()}

    def count(batches):
        own = Sketch(x)
        for batch in batches:
            held, size = [], 0
            for t in batch["text"]:
                held.append(vocabulary.ids(words(t)))
                size += len(held[-1])
                if size >= BLOCK:
                    own.add(held)
                    held, size = [], 0
            own.add(held)
        if own.n:
            yield pd.DataFrame([row(p, own.n if at == 0 else 0, own.df[at : at + PART], own.product[at : at + PART]) for p, at in enumerate(range(0, len(x), PART))])

    def add(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for part, n, df, product in zip(*(batch[c] for c in ("part", "n", "df", "product")), strict=True):
                df, product = np.frombuffer(df, np.int64), np.frombuffer(product, np.float32).reshape(-1, x.shape[1])
                held = total.setdefault(part, [0, np.zeros(df.shape, np.int64), np.zeros(product.shape, np.float64)])
                held[0] += n
                held[1] += df
                held[2] += product
        yield pd.DataFrame([row(part, *held) for part, held in total.items()], columns=["part", "n", "df", "product"])

    parts = docs.select(text_of().alias("text")).mapInPandas(count, schema).repartition(FIT_TASKS, "part").mapInPandas(add, schema)
    out = Sketch(x)
    for r in parts.collect():
        own = slice(r.part * PART, (r.part + 1) * PART)
        out.n += r.n
        out.df[own] = np.frombuffer(bytes(r.df), np.int64)
        out.product[own] = np.frombuffer(bytes(r.product), np.float32).reshape(-1, x.shape[1])
    return out


def factor(sketch: Sketch) -> np.ndarray:
    """F, so that F F' is the Gram matrix as far as the sketch knows it (Nystroem's approximation)."""
    inner = sketch.x.astype(np.float64).T @ sketch.product
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    some = values > 1e-6 * max(values[-1], 0.0)
    return sketch.product @ (vectors[:, some] / np.sqrt(values[some]))


def gram_product(ids: np.ndarray, idf: np.ndarray, x: np.ndarray, total: np.ndarray, scale: Scale = SCALES[-1], weight: float = 1.0) -> None:
    """Add A'(A x) of a text's normalised windows to ``total``, by the words that each block of windows has."""
    starts = window_starts(len(ids), scale)
    other = len(idf)
    for at in range(0, len(starts), ROWS):
        part = starts[at : at + ROWS]
        held, share = held_words(ids, part, np.minimum(part + scale.window, len(ids)), scale, other)
        own, place = np.unique(held, return_inverse=True)
        a = np.zeros((len(held), len(own)), np.float32)
        rows = np.repeat(np.arange(len(held)), held.shape[1])
        np.add.at(a, (rows, place.ravel()), share.ravel())
        a *= np.append(idf, 0.0)[own]
        a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)
        inside = own < other
        own, a = own[inside], a[:, inside]
        total[own] += weight**2 * (a.T @ (a @ x[own]))


def randomised_svd(corpus: np.ndarray, vocabulary: Vocabulary, idf: np.ndarray, items: list[np.ndarray], weight: float, rank: int = RANK, seed: int = 5) -> np.ndarray:
    """Leading right singular vectors of the benchmark's TF-IDF rows, multiplied by ``weight``, and of a corpus whose Gram
    matrix is ``corpus`` times its transpose."""
    rng = np.random.default_rng(seed)
    width = min(rank + EXTRA, vocabulary.size)
    x = np.linalg.qr(rng.normal(size=(vocabulary.size, width)))[0]

    def product(x: np.ndarray) -> np.ndarray:
        out = corpus @ (corpus.T @ x)
        for ids in items:
            gram_product(ids, idf, x, out, weight=weight)
        return out

    for _ in range(POWER):
        x = np.linalg.qr(product(x))[0]
    small = x.T @ product(x)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return x @ vectors[:, np.argsort(-values)[: min(rank, width)]]


def fit(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> Retriever | None:
    """The retriever for a benchmark, which must fit in memory; None if it has no words.

    Word frequencies and the corpus's part of the SVD are of every passage of every document.
    """
    rows = benchmark.where("text IS NOT NULL").select("item_id", "text").orderBy("item_id", "text").collect()
    pairs = [(r.item_id, words(r.text)) for r in rows]
    pairs = [(i, t) for i, t in pairs if t]
    if not pairs:
        return None
    vocabulary = Vocabulary([t for _, t in pairs])
    rng = np.random.default_rng(7)
    sketch = sketched(docs, vocabulary, np.linalg.qr(rng.normal(size=(vocabulary.size, min(SKETCH, vocabulary.size))))[0])
    idf = np.log((sketch.n + 1) / (sketch.df + 1)) + 0.1
    corpus = factor(sketch) * idf[:, None]
    ids = [vocabulary.ids(t) for _, t in pairs]
    own = sum(len(window_starts(len(x))) for x in ids)
    weight = float(np.sqrt(max(1.0, FAVOUR * (corpus**2).sum() / own)))
    basis = randomised_svd(corpus, vocabulary, idf, ids, weight, min(rank, vocabulary.size))
    return Retriever(vocabulary, [i for i, _ in pairs], [t for _, t in pairs], idf, basis)


def find_leaks(docs: DataFrame, benchmark: DataFrame, retriever: Retriever | None = None) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, first_word): documents that hold an item, a passage of one, or a paraphrase.

    A null or empty text, or an empty benchmark, gives no row; an item without words is never found; a repeated row is
    reported each time, one with a null doc_id under null; of passages with equal shares the first counts. Items that
    share an item_id are looked for one by one. Further columns are ignored.
    """
    retriever = retriever or fit(docs, benchmark)
    item_type = benchmark.schema["item_id"].dataType.simpleString()

    @F.pandas_udf(f"array<struct<item_id:{item_type},cosine:double,lcs:double,answer:double,first_word:bigint>>")
    def scan(texts: pd.Series) -> pd.Series:
        names = ("item_id", "cosine", "lcs", "answer", "first_word")
        return pd.Series([[dict(zip(names, x, strict=True)) for x in own] for own in (retriever.leaks(list(texts)) if retriever else [[]] * len(texts))], dtype=object)

    return docs.select("doc_id", scan(text_of()).alias("found")).select("doc_id", F.inline("found"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose own text gives an item away.

    Each row is decided by its text alone, so null and repeated ids need no care; null and empty texts stay, repeated
    rows stay or go together, an empty benchmark takes nothing, and columns of any name stay.
    """
    retriever = fit(docs, benchmark)
    if retriever is None:
        return docs

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not found for found in retriever.leaks(list(texts))], dtype=bool)

    return docs.where(clean(text_of()))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it gives away."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
