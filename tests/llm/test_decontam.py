"""Decontamination against items of many lengths, and the query against a plain version."""

import random

import numpy as np
import pytest

from marlstone.llm import decontam


def sample(seed):
    """Items of 3 to 2000 words, documents with verbatim and paraphrased copies, and clean ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9))) for _ in range(4000)]
    often = [1 / (i + 3) for i in range(4000)]
    text = lambda n: rng.choices(vocabulary, often, k=n)
    items = [text(n) for n in (6, 10, 15, 30, 60, 200, 400, 2000) for _ in range(3)]
    items += [text(10) + ["rep"] * 12 + text(8), ["hmm"] * 30]
    docs, verbatim, near = [], set(), set()
    for k, item in enumerate(items):
        for changed, truth in ((0.0, verbatim), (0.15, near)):
            own = [rng.choice(vocabulary) if rng.random() < changed else w for w in item]
            around = text(rng.choice([60, 400]))
            at = rng.randrange(len(around))
            truth.add((len(docs), k))
            docs.append((len(docs), " ".join([*around[:at], *own, *around[at:]])))
    docs += [(len(docs) + i, " ".join(text(rng.choice([60, 400, 1500])))) for i in range(150)]
    return items, docs, verbatim, near


@pytest.fixture(scope="module")
def case(spark):
    items, docs, verbatim, near = sample(4)
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    rows = [*docs, (None, docs[8][1]), (None, None), (5000, ""), (8, "clean words only"), (8, "clean words only"), (6000, docs[8][1])]
    return items, spark.createDataFrame(rows, "doc_id long, text string"), bench, verbatim, near, rows


def test_items_of_any_length_are_found(case, tmp_path, spark):
    items, docs, bench, verbatim, near, rows = case
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    out = decontam.op8_decontam(spark, str(tmp_path)).collect()
    got = {(r.doc_id, r.item_id) for r in out}
    assert not verbatim - got
    assert len(near & got) >= 0.95 * len(near)
    assert not {x for x in got if x[0] not in (None, 6000)} - verbatim - near
    # a plain version: every passage of every item against every stretch of every document
    plain = set()
    for d, t in rows:
        w = decontam.words(t or "")
        for k, item in enumerate(items):
            size = min(len(item), 32)
            for ps in range(0, max(1, len(item) - size + 1), 16):
                passage = item[ps : ps + size]
                if any(decontam.lcs([x.encode() for x in passage], w[at : at + 2 * size]) >= 0.9 * size for at in range(0, max(1, len(w) - size), max(1, size // 2))):
                    plain.add((d, k))
                    break
    assert not plain - got


def test_rows_are_decided_by_their_own_text(case):
    _, docs, bench, verbatim, near, rows = case
    clash = docs.selectExpr("doc_id", "text", "1 AS _gone", "2 AS item_id", "3 AS found")
    kept = decontam.decontaminated(clash, bench)
    assert kept.columns == clash.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert (None, None) in got and (5000, "") in got and got.count((8, "clean words only")) == 2
    assert (None, rows[8][1]) not in got and (6000, rows[8][1]) not in got and (8, rows[8][1]) not in got
    assert decontam.decontaminated(clash.limit(0), bench).count() == 0 and decontam.decontaminated(clash, bench.limit(0)).count() == len(rows)


def test_every_document_counts_in_the_fit(spark):
    """Two tables that differ in which words stand together in one document without an id: as many documents hold each word,
    so only a fit that takes this document's passages can tell them apart."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(200)]
    bench = spark.createDataFrame([(k, " ".join(vocabulary[20 * k : 20 * k + 20])) for k in range(10)], "item_id long, text string")
    rows = [(k, " ".join(rng.choices(vocabulary, k=300))) for k in range(30)]
    once = rng.sample(vocabulary, 200)
    other = rng.sample(vocabulary, 200)
    fits = []
    for own in (once, other):
        docs = spark.createDataFrame([*rows, (None, " ".join(own * 20))], "doc_id long, text string")
        fits.append(decontam.fit(docs, bench))
    assert np.array_equal(fits[0].idf, fits[1].idf)
    a, b = (f.weighted[:-1] @ f.weighted[:-1].T for f in fits)
    assert np.abs(a - b).max() > 1e-3


def test_the_sketch_is_of_every_passage(spark):
    rng = np.random.default_rng(3)
    of = decontam.Vocabulary([[b"w%d" % i for i in range(700)]])
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.3, size=n) % 900) for n in (0, 1, 31, 32, 33, 5, 0, 2500, 40_000, 700)] + [None, "none of these"]
    docs = spark.createDataFrame([(k if k % 3 else None, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    x = rng.normal(size=(of.size, 9)).astype(np.float32)
    got = decontam.sketched(docs, of, x)
    rows, df = [], np.zeros(of.size, int)
    for t in texts:
        w = decontam.words(t or "")
        df[[of.of[a] for a in set(w) if a in of.of]] += 1
        for at in range(0, len(w), 32):
            row = np.bincount(of.ids(w[at : at + 32]), minlength=of.size + 1)[:-1]
            if row.any():
                rows.append(np.sqrt(row / row.sum()))
    assert got.n == len(texts) and np.array_equal(got.df, df)
    assert np.allclose(got.product, np.array(rows).T @ (np.array(rows) @ x), rtol=1e-3, atol=1e-2)
    # Nystroem's approximation is exact for a sketch as wide as the vocabulary's rank
    small = decontam.Vocabulary([[b"w%d" % i for i in range(1, 40)]])
    whole = decontam.sketched(docs, small, np.eye(small.size))
    f = decontam.factor(whole)
    assert np.allclose(f @ f.T, whole.product, rtol=1e-3, atol=1e-2)
