"""Every registered query and the pipeline on tables in a folder, against plain versions, with odd rows and clashing columns."""

import hashlib
import random
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import langid, media, mixing, quality, registry, secrets, simhash, toxicity
from test_simhash import slow_components, slow_fingerprint
from test_text_operators import slow_base

#: Names that operators use for themselves, as further columns of the tables.
CLASH = ("clean", "salt", "found", "key", "marked", "ident", "cell", "mix", "site", "good", "template", "host", "text_key", "phrases", "id", "label", "size", "_gone", "a.b")
GOTHIC = "\U00010330\U00010331\U00010332 \U00010333\U00010334"


def words_of(rng, n, kind):
    parts = {"aa": ["tion", "ing", "th", "er"], "bb": ["ez", "os", "ado", "ñar"], "cc": ["ung", "keit", "sch", "ü"]}[kind]
    return " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rng = random.Random(41)
    docs, labels = [], []
    for i in range(400):
        lang = rng.choice(["aa", "bb", "cc"])
        text = words_of(rng, rng.choice([3, 40, 120]), lang)
        toxic = rng.random() < 0.25
        if toxic:
            w = text.split()
            w[rng.randrange(len(w))] = "grubnak" + rng.choice(["", "s"])
            text = " ".join(w)
        junk = rng.random() < 0.3
        if junk:
            text += " $$$ |||" * 10
        docs.append((i, text, lang if i % 11 else None, f"s{i % 5}", len(text)))
        labels.append((i, int(not junk), int(toxic)))
    item = " ".join(words_of(rng, 40, "aa").split()[:30])
    key = "".join(rng.choices(string.ascii_letters + string.digits, k=40))
    long = " ".join(f"w{i}" for i in range(60_000))
    docs += [(400, None, None, None, None), (401, "", "aa", "s1", 0), (402, " \t\n", "aa", "s1", 3), (403, GOTHIC, None, "s1", 6), (404, "1 2 3", "bb", None, 5), (405, long, "aa", "s1", len(long)),
             (406, f"x {key} y password=abcdefgh1", "aa", "s1", 1), (407, words_of(rng, 60, "bb") + " " + item, "bb", "s1", 1), (408, docs[0][1].upper(), "aa", "s2", 1), (408, docs[0][1].upper(), "aa", "s2", 1),
             (None, docs[1][1], "aa", "s2", 1), (None, None, None, None, None), (5, "quite another text of this id " + words_of(rng, 40, "cc"), "cc", "s0", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    df.withColumn("m", F.create_map(F.lit("k"), F.lit("v"))).write.parquet(str(at / "documents.parquet"))
    labels += [(None, 1, 1), (7, None, None), (8, 1, 1), (9000, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame([(0, item), (1, None), (2, "")], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    vectors = np.random.default_rng(3).normal(size=(12, 64))
    rows = [(100 * i, list(map(float, v))) for i, v in enumerate(vectors)] + [(7, list(map(float, vectors[1]))), (8, None), (9, []), (None, list(map(float, vectors[2])))]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(at / "embeddings.parquet"))
    return str(at), docs, labels


def same_rows(got, docs, columns):
    assert len(got) == len(docs) and sorted((r.doc_id for r in got), key=str) == sorted((d[0] for d in docs), key=str)
    assert set(columns) <= set(got[0].asDict())


def held(i):
    return None if i is None else zlib.crc32(str(i).encode()) % 5 == 0


def test_op1(spark, folder):
    at, docs, _ = folder
    got = registry.queries()["op1_secrets"](spark, at).collect()
    same_rows(got, docs, ("n_assign", "n_access", "n_hex", "base_sha256", "spans"))
    model = secrets.train()
    want = {}
    for i, t, *_ in docs:
        base = slow_base(t or "")
        # a run is a secret if any stretch of twenty characters or more is, whatever its length
        markov = False
        for m in secrets.CANDIDATE.finditer(t or ""):
            p, n = model.parts(m.group()), len(m.group())
            markov |= len(set(m.group())) >= secrets.DISTINCT and any(p[a:b].mean() > model.threshold for a in range(n) for b in range(a + secrets.STRETCH, n + 1))
        want.setdefault(i, []).append((hashlib.sha256(base.encode()).hexdigest(), base.count("assign:"), markov))
    for r in got:
        assert (r.base_sha256, r.n_assign, r.n_markov > 0) in want[r.doc_id]
        assert set(filter(None, r.spans.split(","))) >= set(filter(None, slow_base(next((t for i, t, *_ in docs if i == r.doc_id and r.doc_id is not None), "") or "").split(","))) or r.doc_id in (None, 5)
    assert next(r for r in got if r.doc_id == 406).n_markov == 1


def test_op2(spark, folder):
    at, docs, _ = folder
    got = registry.queries()["op2_simhash"](spark, at).collect()
    same_rows(got, docs, ("fingerprint", "component_id"))
    fps = {}
    for n, (_, t, *_) in enumerate(docs):
        fps[n] = slow_fingerprint(t)
    groups = slow_components(fps)
    least = {}
    for n, g in groups.items():
        ids = [docs[k][0] for k in groups if groups[k] == g and docs[k][0] is not None]
        least[n] = min(ids, default=None)
    want = sorted(((str(docs[n][0]), f"{fps[n]:016x}", str(least[n])) for n in fps))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_op3(spark, folder):
    at, docs, labels = folder
    got = registry.queries()["op3_quality"](spark, at).collect()
    same_rows(got, docs, ("score", "held_out", "predicted"))
    known = {}
    for i, q, _ in labels:
        if i is not None and q is not None and not held(i):
            known[i] = max(known.get(i, 0), q)
    rows = [(r.host, r.path, known.get(r.doc_id, 1 / (1 + np.exp(-r.evidence))) if r.doc_id is not None else 1 / (1 + np.exp(-r.evidence)), r) for r in got]
    overall = np.clip(np.mean([g for *_, g, _ in rows]), 1e-4, 1 - 1e-4)
    sums = lambda f: {k: (sum(g for h, p, g, _ in rows if f(h, p) == k), sum(f(h, p) == k for h, p, *_ in rows)) for k in {f(h, p) for h, p, *_ in rows}}
    hosts, paths = sums(lambda h, p: h), sums(lambda h, p: (h, p))

    def strength(groups, around):
        r = [(s, n, around(k)) for k, (s, n) in groups.items() if n >= 2]
        whole, beyond = sum(n * a * (1 - a) for _, n, a in r), sum(n * (s / n - a) ** 2 for s, n, a in r) - sum(a * (1 - a) for *_, a in r)
        return quality.STRENGTH if not r or whole <= 0 else quality.MOST_STRENGTH if beyond <= 0 else np.clip(whole / beyond - 1, quality.LEAST_STRENGTH, quality.MOST_STRENGTH)

    by_host = strength(hosts, lambda k: overall)
    by_path = strength(paths, lambda k: (hosts[k[0]][0] + overall * by_host) / (hosts[k[0]][1] + by_host))
    for h, p, g, r in rows:
        host = (hosts[h][0] - g + overall * by_host) / (hosts[h][1] - 1 + by_host)
        path = (paths[h, p][0] - g + host * by_path) / (paths[h, p][1] - 1 + by_path)
        bounded = np.clip(path, 1e-4, 1 - 1e-4)
        odds = r.evidence + np.log(bounded / (1 - bounded)) - np.log(overall / (1 - overall))
        assert r.host_rate == pytest.approx(host, abs=1e-6) and r.path_rate == pytest.approx(path, abs=1e-6) and r.score == pytest.approx(1 / (1 + np.exp(-odds)), abs=1e-6)
        assert r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.5)
    truth = {i: q for i, q, _ in labels[:400]}
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth and r.held_out and r.doc_id != 5]) > 0.95


def test_op7(spark, folder):
    at, docs, labels = folder
    got = registry.queries()["op7_toxicity"](spark, at).collect()
    same_rows(got, docs, ("score", "held_out", "predicted"))
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    d, lab = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    texts, y = toxicity.labelled_sample(d, lab)
    least = {i: min(t for j, t, *_ in docs if j == i and t is not None) for i, t, *_ in docs if i is not None and t is not None}
    of = {i: max(x for j, _, x in labels if j == i and x is not None) for i, _, x in labels if i is not None and x is not None}
    assert sorted(zip(texts, y.tolist(), strict=True)) == sorted((least[i], of[i]) for i in of if i in least and not held(i))
    model = toxicity.train(texts, y)
    want = {(i, round(float(model.scores([t or ""])[0]), 6)) for i, t, *_ in docs}
    assert {(r.doc_id, round(r.score, 6)) for r in got} == want
    truth = {i: x for i, _, x in labels[:400] if i not in (5, 8)}
    out = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in out]) > 0.93
    clash = toxicity.without_toxic(d.withColumn("_score", F.lit("x")), lab)
    assert {c for c in CLASH} <= set(clash.columns) and "_score" in clash.columns and clash.where("doc_id IS NULL").count() >= 1
    assert toxicity.without_toxic(d.limit(0), lab).count() == 0 and toxicity.without_toxic(d, lab.limit(0)).count() == len(docs)


def test_op10(spark, folder):
    at, docs, _ = folder
    got = registry.queries()["op10_langid"](spark, at).collect()
    same_rows(got, docs, ("lang_pred", "score", "held_out"))
    for r in got:
        t = next((t for i, t, *_ in docs if i == r.doc_id), None)
        assert r.held_out == held(r.doc_id) and 0 <= r.score <= 1
        if r.doc_id not in (None, 5):
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    truth = {d[0]: d[2] for d in docs[:400] if d[2]}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth and r.doc_id != 5]) > 0.97
    out = langid.identified(spark.read.parquet(f"{at}/documents.parquet"), langid.LanguageModel.of_counts({}))
    assert set(CLASH) <= set(out.columns) and out.where("lang_pred <> 'und'").count() == 0 and out.where("found <> 'clash'").count() == 0


def test_any_number_of_languages_makes_up_a_text():
    rng = random.Random(17)
    ends = {f"l{k}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(4)] for k in range(7)}
    say = lambda k, n: " ".join("".join(rng.choices(ends[k], k=2)) for _ in range(n))
    m = langid.LanguageModel.of_counts({k: langid.count_ngrams([say(k, 80) for _ in range(20)]) for k in ends})
    _, _, sets = m.predict([" ".join(say(k, 240) for k in ends), " ".join(say(k, 240) for k in list(ends)[:6])])
    assert [s.count(":") for s in sets] == [7, 6]
    # a plain EM gives the proportions
    ll, doc = m.chunks([" ".join(say(k, 60 * (i + 1)) for i, k in enumerate(ends))])
    pi = np.ones(len(ends)) / len(ends)
    for _ in range(2000):
        r = pi * np.exp(ll - ll.max(1, keepdims=True))
        pi = (r / r.sum(1, keepdims=True)).mean(0)
    like = np.exp(ll - ll.max(1, keepdims=True))
    assert np.allclose(langid.em(like, np.array([len(like)]), np.ones((1, len(ends))))[0][0], pi, atol=0.01)


def test_op9(spark, folder):
    at, _, _ = folder
    got = {r.vec_id: r for r in registry.queries()["op9_media"](spark, at).collect()}
    assert len(got) == 16 and got[7].class_id == got[100].class_id == 7 and got[None].class_id == 200
    assert got[8].class_id == got[9].class_id == 8 and got[8].n_matches == 0 and media.op9_media is not None


def test_operators_keep_columns_of_any_name(spark, folder):
    at, docs, _ = folder
    d = spark.read.parquet(f"{at}/documents.parquet")
    out = secrets.redacted(d)
    assert out.columns == d.columns and out.where("`a.b` <> 'clash' OR clean <> 'clash'").count() == 0 and out.count() == len(docs)
    upper = secrets.redacted(d.withColumnRenamed("n_chars", "N_CHARS")).where("doc_id = 406").first()
    assert upper.N_CHARS == len(upper.text)
    mixed = mixing.mixed(d.drop("mix"))
    assert mixed.where("cell <> 'clash' OR salt <> 'clash'").count() == 0 and mixed.count() == len(docs)
    kept = simhash.deduplicated(d)
    assert kept.columns == d.columns and kept.where("marked <> 'clash' OR ident <> 'clash' OR _gone <> 'clash'").count() == 0
    ids = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    assert [i for i, _ in ids].count("None") == 2 and [i for i, _ in ids].count("5") == 2 and "408" not in [i for i, _ in ids]
    assert "401" not in [i for i, _ in ids] or "400" not in [i for i, _ in ids]
    assert simhash.deduplicated(d.limit(0)).count() == 0


def test_pipeline(spark, folder):
    at, docs, _ = folder
    out = corpus_pipeline.run(spark, at)
    rows = out.collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert 407 not in by and 408 not in by and set(CLASH) <= set(out.columns) and {"weight", "prob"} <= set(out.columns)
    assert all("password=abcdefgh1" not in (r.text or "") for r in rows) and 0 < len(rows) <= len(docs)
    # stage by stage: what a stage gives is what it gives on the one before
    d = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = d.count()
        path = f"{at}/stage-{name}"
        stage(spark, d, at).write.parquet(path)
        d = spark.read.parquet(path)
        assert d.count() <= before and (name != "secrets" or d.count() == before)
    assert sorted(str(r.doc_id) + (r.text or "") for r in d.collect()) == sorted(str(r.doc_id) + (r.text or "") for r in rows)


def test_pipeline_of_empty_tables(spark, folder, tmp_path):
    at, _, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{at}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name in ("op1_secrets", "op2_simhash", "op3_quality", "op5_mixing", "op6_licenses", "op7_toxicity", "op8_decontam", "op10_langid"):
        assert registry.queries()[name](spark, str(tmp_path)).count() == 0, name
