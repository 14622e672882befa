"""Quality classifier: document evidence combined with host and path-level posteriors by empirical Bayes.

A logistic model reads a few traits of a text.  Its probabilities, or the labels where a document of the training
folds has one, are summed for each path (a site's section) and each host by grouped aggregation over all documents.
A host's rate is shrunk toward the global rate, and a path's toward its host's, by beta priors whose strengths are
estimated from the spread of the rates; sparse sites stay near the prior.  A document's log-odds are its own evidence
plus the shrunk log-odds of its path, in which the document itself doesn't count.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import Staged, fold, lookup, table, text_of

#: Bound of the labelled sample that is fitted, by label; the least hashes of doc_id are taken.
MOST_LABELLED = 4000
TRAITS = (
    "words", "mean_length", "distinct", "upper", "digits", "symbols", "odd_symbols", "ends", "bars", "repeated_lines",
    "top_word", "line_length", "repeated_pairs", "exclaim", "long_words", "lower_start",
)
LETTERS = re.compile(r"[^\W\d_]+")
#: Strength of a prior, in documents, where the spread of the rates doesn't tell, and its bounds.
STRENGTH, LEAST_STRENGTH, MOST_STRENGTH = 20.0, 2.0, 10_000.0


def traits(text: str) -> list[float]:
    """Numbers from 0 to about 1 that tell prose from lists, junk and repetition."""
    w = text.split()
    n = max(len(w), 1)
    chars = max(len(text), 1)
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    low = [x.lower() for x in w]
    counts: dict[str, int] = {}
    for x in low:
        counts[x] = counts.get(x, 0) + 1
    pairs = set(zip(low, low[1:], strict=False))
    letters = sum(map(len, LETTERS.findall(text)))
    return [
        min(np.log1p(len(w)) / 10, 1.5), min(sum(map(len, w)) / n / 10, 2.0), len(counts) / n,
        sum(x.isupper() and len(x) > 1 for x in w) / n, sum(map(text.count, "0123456789")) / chars * 10,
        1 - letters / chars, sum(map(text.count, "#$%&*@{}<>")) / chars * 10, sum(x[-1] in ".!?" for x in w) / n * 5,
        text.count("|") / n, 1 - len(set(lines)) / max(len(lines), 1), max(counts.values(), default=0) / n,
        min(chars / max(len(lines), 1) / 1000, 2.0), 1 - len(pairs) / max(len(low) - 1, 1), text.count("!") / n,
        sum(len(x) > 14 for x in w) / n, sum(x[:1].islower() for x in lines) / max(len(lines), 1),
    ]


@dataclass(frozen=True)
class Evidence:
    """A logistic model of the traits and their squares."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(_wide((x - self.mean) / self.scale) @ self.weights, -12, 12)


def _wide(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -8, 8)
    return np.hstack([np.ones((len(z), 1)), z, z**2 - 1])


def train(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Evidence:
    """Penalised logistic regression by Newton steps; without both labels it says nothing (log-odds 0 or the share)."""
    y = np.asarray(y, float)
    width = len(TRAITS)
    if not len(y) or y.min() == y.max():
        w = np.zeros(1 + 2 * width)
        if len(y):
            w[0] = 4.0 if y[0] else -4.0
        return Evidence(np.zeros(width), np.ones(width), w)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    a = _wide((x - mean) / scale)
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(h, a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Evidence(mean, scale, w)


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the labelled ids outside the held-out fold; of an id's labels the greatest counts."""
    of = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(fold(F.col("doc_id")) != 0)
    return of.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Traits and labels of at most MOST_LABELLED rows of each label outside the held-out fold. Of an id's texts the
    least counts."""
    of = training_labels(labels)
    order = F.xxhash64("doc_id", F.lit("quality"))
    ids = [of.where(c).orderBy(order, "doc_id").limit(MOST_LABELLED) for c in ("quality = 1", "quality = 0")]
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = rows.select("doc_id", "quality", traits_udf()("text").alias("x")).orderBy("doc_id").collect()
    return np.array([r.x for r in rows]).reshape(-1, len(TRAITS)), np.array([r.quality for r in rows])


def traits_udf():
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([traits(t) for t in texts], dtype=object)

    return run


def evidence_udf(model: Evidence):
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.log_odds(np.array([traits(t) for t in texts]).reshape(-1, len(TRAITS))), dtype="float64")

    return run


def site_columns(source: Column, lang: Column) -> tuple[Column, Column]:
    """Host and path of a document: what its source has before and after the first slash (after a scheme);
    a source without a path is divided by language, as sites divide their sections."""
    plain = F.regexp_replace(F.coalesce(source.cast("string"), F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.substring_index(plain, "/", 1)
    path = F.regexp_extract(plain, "^[^/]*/([^/?#]*)", 1)
    return F.lower(host), F.when(path != "", path).otherwise(F.coalesce(lang.cast("string"), F.lit("")))


def strength(rows: DataFrame, rate: Column, around: Column) -> float:
    """Strength of the beta prior, by the method of moments over (n, s) rows: how much the rates spread about
    ``around`` beyond what n documents each would."""
    r = rows.where("n >= 2").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(rate - around, 2)).alias("spread"), F.sum(around * (1 - around)).alias("chance"),
        F.sum(F.col("n") * around * (1 - around)).alias("whole"),
    ).first()
    if not r.k or r.whole is None or r.whole <= 0:
        return STRENGTH
    beyond = r.spread - r.chance
    if beyond <= 0:
        return MOST_STRENGTH
    return float(np.clip(r.whole / beyond - 1, LEAST_STRENGTH, MOST_STRENGTH))


def scored(docs: DataFrame, model: Evidence, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, host, path, evidence, host_rate, path_rate, score) of every row of ``docs``.

    The rates are those of a document's site without the document itself. ``labels`` (doc_id, quality) are
    :func:`training_labels`. Null and empty texts have the evidence of no words; a null source is one host, a null
    language one path. Repeated rows count each time, and so do equal texts; equal scores are possible and left so.
    A row without an id has no label. An empty table gives an empty result; other columns are left out.
    """
    staged = Staged(docs.sparkSession, "quality")
    host, path = site_columns(F.col("source"), F.col("lang"))
    own = docs.select("doc_id", host.alias("host"), path.alias("path"), evidence_udf(model)(text_of()).alias("evidence"))
    p = 1 / (1 + F.exp(-F.col("evidence")))
    if labels is None:
        own = own.withColumn("good", p)
    else:
        known = staged.keep(labels.select("doc_id", "quality"), "labels")
        own = lookup(staged.keep(own, "unlabelled"), known, "doc_id").withColumn("good", F.coalesce(F.col("quality").cast("double"), p)).drop("quality")
    own = staged.keep(own, "evidence")
    paths = staged.keep(own.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("s")), "paths")
    hosts = staged.keep(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "hosts")
    totals = hosts.agg(F.sum("n"), F.sum("s")).first()
    overall = float(np.clip(totals[1] / totals[0], 1e-4, 1 - 1e-4)) if totals[0] else 0.5
    shrunk = lambda s, n, around, by: (s + around * by) / (n + F.lit(by))
    by_host = strength(hosts, F.col("s") / F.col("n"), F.lit(overall))
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    paths = staged.keep(paths.join(hosts, "host"), "with_hosts")
    by_path = strength(paths, F.col("s") / F.col("n"), shrunk(F.col("host_s"), F.col("host_n"), F.lit(overall), by_host))
    sites = staged.keep(paths.select(F.concat_ws("\x1f", "host", "path").alias("site"), "n", "s", "host_n", "host_s"), "sites")
    out = lookup(own.withColumn("site", F.concat_ws("\x1f", "host", "path")), sites, "site")
    less = lambda c, by: F.greatest(F.col(c) - by, F.lit(0))
    out = out.withColumn("host_rate", shrunk(less("host_s", F.col("good")), less("host_n", 1), F.lit(overall), by_host))
    out = out.withColumn("path_rate", shrunk(less("s", F.col("good")), less("n", 1), F.col("host_rate"), by_path))
    bounded = F.least(F.lit(1 - 1e-4), F.greatest(F.lit(1e-4), F.col("path_rate")))
    shift = F.log(bounded / (1 - bounded)) - F.lit(float(np.log(overall / (1 - overall))))
    score = 1 / (1 + F.exp(-(F.col("evidence") + shift)))
    staged.only(own, sites)
    return out.select("doc_id", "host", "path", "evidence", "host_rate", "path_rate", score.alias("score"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence, shrunk site rates, score and decision for every document; held_out is null without an id."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(*labelled_sample(docs, labels))
    return scored(docs, model, training_labels(labels)).select("*", (fold(F.col("doc_id")) == 0).alias("held_out"), (F.col("score") >= 0.5).cast("int").alias("predicted"))
