"""Language ID: each document as a mixture of languages, its proportions found by expectation-maximisation.

Languages are n-gram distributions learned from labelled texts.  A document is a list of short chunks of
words; each chunk is of one language, and EM on the chunks' likelihoods gives the proportions.  How many
languages a document has is chosen by penalised likelihood over nested sets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import fold, table, text_of, unused
from marlstone.llm.subword import ALPHA, blocks, codes, grams, word_index

SIZES, BITS = (2, 3, 4), 14
BUCKETS = 1 << BITS
#: Documents of each language that are learned from, as expected by a hash of the id (fewer: all).
SAMPLE = 1500
FIT_TASKS = 8
#: Most labels that are learned, the most frequent ones; it bounds the model, of 128 KB a label.
MOST_LABELS = 1000
CHUNK = 6
#: Rounds of EM at most, and the change of all proportions below which a document is done.
ROUNDS, SETTLED = 300, 1e-4
#: Log-likelihood units, times the logarithm of the number of chunks, that one more language must gain.
PENALTY = 6.0
#: n-grams of a word overlap; their log-likelihoods count this much.
TEMPER = 0.5
BLOCK = 1 << 20
UNKNOWN = "und"


def count_ngrams(texts: list[str]) -> np.ndarray:
    out = np.zeros(BUCKETS)
    for _, parts in blocks(texts, BLOCK):
        z, _ = codes(parts, ALPHA)
        for bucket, _ in grams(z, word_index(z)[0], SIZES, BITS):
            out += np.bincount(bucket, minlength=BUCKETS)
    return out


def em(like: np.ndarray, size: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages and the log-likelihood they reach, for documents of ``size`` chunks each
    (their likelihoods by language in order). Each document goes on until its proportions settle."""
    pi = allowed / allowed.sum(1, keepdims=True)
    active, rows, n = np.arange(len(size)), np.arange(len(like)), size
    for _ in range(ROUNDS):
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        r = np.repeat(pi[active], n, axis=0) * like[rows]
        r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
        after = np.add.reduceat(r, begin, axis=0) / n[:, None]
        moving = np.abs(after - pi[active]).max(1) > SETTLED
        pi[active] = after
        if not moving.any():
            break
        rows, active, n = rows[np.repeat(moving, n)], active[moving], n[moving]
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    total = np.log(np.maximum((np.repeat(pi, size, axis=0) * like).sum(1), 1e-300))
    return pi, np.add.reduceat(total, begin)


@dataclass(frozen=True)
class LanguageModel:
    """Language names in order, and log-probabilities of n-gram buckets by language."""

    names: tuple[str, ...]
    logp: np.ndarray

    @classmethod
    def of_counts(cls, counts: dict[str, np.ndarray]) -> LanguageModel:
        names = tuple(sorted(counts))
        rows = [np.log((counts[n] + 0.5) / (counts[n].sum() + 0.5 * BUCKETS)) for n in names]
        return cls(names, np.array(rows, np.float32).reshape(len(names), BUCKETS))

    def chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods of all chunks by language, and the text of each chunk (in order)."""
        lls, docs = [], []
        for of, parts in blocks(texts, BLOCK):
            z, begin = codes(parts, ALPHA)
            owner, starts = word_index(z)
            if not len(starts):
                continue
            part = np.searchsorted(begin, starts, "right") - 1
            within = np.arange(len(starts)) - np.searchsorted(part, part)
            new = np.flatnonzero(within % CHUNK == 0)
            chunk = np.searchsorted(new, np.arange(len(starts)), "right") - 1
            ll = np.zeros((len(new), len(self.names)))
            for bucket, word in grams(z, owner, SIZES, BITS):
                at = chunk[word]
                for k, row in enumerate(self.logp):
                    ll[:, k] += np.bincount(at, row[bucket], len(new))
            lls.append(ll * TEMPER)
            docs.append(np.asarray(of)[part[new]])
        if not lls:
            return np.zeros((0, len(self.names))), np.zeros(0, np.int64)
        return np.concatenate(lls), np.concatenate(docs)

    def mixtures(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Language proportions of each text (rows of zeros where it has no letter), restricted to its
        chosen set, and the proportions over all languages."""
        ll, doc = self.chunks(texts)
        n, k = len(texts), len(self.names)
        chosen, full = np.zeros((n, k)), np.zeros((n, k))
        if not len(doc) or not k:
            return chosen, full
        ids, begin = np.unique(doc, return_index=True)
        size = np.diff(np.append(begin, len(doc)))
        like = np.exp(np.maximum(ll - ll.max(1, keepdims=True), -500.0))
        everything, most = em(like, size, np.ones((len(ids), k)))
        # the best single language by its total, then further ones by proportion
        total = np.add.reduceat(ll, begin, axis=0)
        order = np.argsort(-(everything + 2.0 * (total == total.max(1, keepdims=True))), axis=1, kind="stable")
        place = np.argsort(order, axis=1, kind="stable")
        best, best_pi = np.full(len(ids), -np.inf), np.zeros((len(ids), k))
        for m in range(1, k + 1):
            # no set explains a document better than all languages together, so one that can't pay for m is done
            cost = PENALTY * (m - 1) * np.log(size + 1.0)
            some = np.flatnonzero(most + 1e-6 * np.abs(most) - cost > best)
            if not len(some):
                break
            rows = np.concatenate([np.arange(begin[i], begin[i] + size[i]) for i in some])
            pi, gain = em(like[rows], size[some], (place[some] < m).astype(float))
            gain -= cost[some]
            better = gain > best[some]
            best[some[better]], best_pi[some[better]] = gain[better], pi[better]
        chosen[ids], full[ids] = best_pi, everything
        return chosen, full

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, list[str]]:
        """Main language, its proportion, and the chosen set with proportions, largest first."""
        chosen, full = self.mixtures(texts)
        names, score, sets = [], np.zeros(len(texts)), []
        for i, (pi, every) in enumerate(zip(chosen, full, strict=True)):
            if not pi.any():
                names.append(UNKNOWN)
                sets.append("")
                continue
            b = int(pi.argmax())
            names.append(self.names[b])
            score[i] = min(1.0, every[b])
            sets.append(",".join(f"{self.names[j]}:{pi[j]:.3f}" for j in np.argsort(-pi, kind="stable") if pi[j] > 0))
        return names, score, sets


def fit(docs: DataFrame, lang_col: str = "lang") -> LanguageModel:
    """Learn from texts with a label outside the held-out fold, about SAMPLE of them for each language.

    The sample is taken by a hash of the id against the language's share, so it needs no sort; counting is
    done on the executors, and FIT_TASKS rows a language reach the driver. Of more than MOST_LABELS labels the most
    frequent ones are learned, those of equal frequency in order.
    """
    train = docs.where(F.col("text").isNotNull() & F.col(lang_col).isNotNull()).where(fold(F.col("doc_id")) != 0)
    train = train.select("doc_id", "text", F.col(lang_col).cast("string").alias("lang"))
    sizes = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(MOST_LABELS).collect()
    if not sizes:
        return LanguageModel.of_counts({})
    u = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1_000_000))
    share = docs.sparkSession.createDataFrame([(r.lang, SAMPLE * 1_000_000 // r.n) for r in sizes], "lang string, share long")
    some = train.join(F.broadcast(share), "lang").where(u < F.col("share"))

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                counts[lang] = counts.get(lang, 0) + count_ngrams(list(texts))
        for lang, c in counts.items():
            yield pd.DataFrame({"lang": [lang], "counts": [c.tobytes()]})

    rows = some.select("lang", "text").repartition(FIT_TASKS).mapInPandas(count, "lang string, counts binary")
    total: dict[str, np.ndarray] = {}
    for r in rows.toLocalIterator():
        total[r.lang] = total.get(r.lang, 0) + np.frombuffer(bytes(r.counts))
    return LanguageModel.of_counts(total)


def identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred, score and languages (the chosen set with proportions).

    A null or empty text, or one without letters, is ``und`` with score 0; so is every text if nothing was
    learned. Equal proportions go to the first name. Any number of languages can make up a text; a chunk of CHUNK words is
    of one. Rows, repeated ones and those without an id too, and other columns stay (own names are replaced).
    """

    @F.pandas_udf("lang_pred string, score double, languages string")
    def run(texts: pd.Series) -> pd.DataFrame:
        names, score, sets = model.predict(list(texts))
        return pd.DataFrame({"lang_pred": names, "score": score, "languages": sets})

    rest = docs.drop("lang_pred", "score", "languages")
    found = unused("found", rest)
    return rest.withColumn(found, run(text_of())).select(*[F.col(f"`{c}`") for c in rest.columns], f"{found}.*")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main language of every document; a fifth of the ids is held out of learning."""
    docs = table(spark, sf_dir, "documents")
    out = identified(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "languages")
