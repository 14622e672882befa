import random

import numpy as np
import xxhash
from pyspark.sql import types as T

from marlstone.llm import simhash
from marlstone.llm.common import Staged
from marlstone.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, band int"


def slow_fingerprint(text, k=3):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union_find(pairs, nodes):
    at = {n: n for n in nodes}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def slow_components(fps):
    ids = sorted(fps)
    return union_find([(a, b) for a in ids for b in ids if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2], ids)


def test_links_connect_what_all_pairs_connect(spark, pair_limit=3):
    rng = random.Random(5)
    fps = set()
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            x = base
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = [int(np.array(x, np.uint64).astype(np.int64)) for x in fps]
    staged = Staged(spark, "test")
    nodes = spark.createDataFrame([(0, x) for x in signed], "band int, fp long")
    edges = simhash.links(staged, nodes, 2, pair_limit).select("a", "b")
    got = {r.node: r.root for r in components(staged, edges).collect()}
    want = union_find([(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2], signed)
    assert {n: got.get(n, n) for n in signed} == want


def test_query_matches_brute_force_and_odd_rows(spark):
    rng = random.Random(3)
    vocabulary = ["Wort", "É", "the", "of", "x" * 40, "a.b", "1"]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "One  two", "one\x0btwo", "a b c d", "A B C D", "long " * 5000]
    texts += [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 9))) for _ in range(60)]
    rows = [(i, t, None, "s", None, 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in simhash.simhash_components(docs).collect()}
    fps = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: r.fingerprint & (2**64 - 1) for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == slow_components(fps)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c", None, None, None, 1), (4, "a b c", None, None, None, 1), (4, "a b c", None, None, None, 1)], SCHEMA)
    assert [(r.doc_id, r.component_id) for r in simhash.simhash_components(docs).orderBy("doc_id").collect()] == [(None, 4), (4, 4), (4, 4)]
    assert simhash.simhash_components(docs.limit(0)).count() == 0
    assert simhash.deduplicated(docs).count() == 2
    assert simhash.deduplicated(docs.limit(0)).count() == 0


def test_near_copies_are_grouped_and_others_kept(spark):
    rng = random.Random(11)
    syllables = ["tor", "lan", "mi", "ke", "sou", "bra", "fen", "dul", "wix", "pra"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(1, 5)))
    rows, originals = [], 40
    for i in range(originals):
        rows.append((i, " ".join(word() for _ in range(rng.choice([60, 300, 1500])))))
    near = {}
    for i in range(originals):
        w = rows[i][1].split()
        for _ in range(max(1, len(w) // 90)):
            w[rng.randrange(len(w))] = word()
        near[100 + i] = i
        rows.append((100 + i, " ".join(w)))
    rows.append((500, rows[0][1].upper()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.deduplicated(docs).collect()}
    assert set(range(originals)) <= kept and 500 not in kept
    assert len(kept & set(near)) <= 1


def test_components_of_a_path_and_a_star(spark):
    staged = Staged(spark, "test")
    path = [(i, i + 1) for i in range(9)]
    star = [(100, i) for i in range(101, 130)]
    edges = spark.createDataFrame(path + star + [(7, 7), (None, 3)], T.StructType.fromDDL("a long, b long"))
    got = {r.node: r.root for r in components(staged, edges).collect()}
    assert got == {i: 0 for i in range(10)} | {i: 100 for i in range(100, 130)}


def edited(rng, tokens, n):
    """``tokens`` with n words replaced at places at least five apart, so each changes five shingles."""
    out = list(tokens)
    for at in rng.sample(range(5, len(out) - 5, 6), n):
        out[at] = f"edit{rng.getrandbits(40)}"
    return out


def jaccard(a, b, k=5):
    a, b = ({tuple(x[i : i + k]) for i in range(len(x) - k + 1)} for x in (a, b))
    return len(a & b) / len(a | b)


def test_texts_under_the_similarity_stay(spark):
    rng = random.Random(21)
    rows, want = [], []
    for i in range(40):
        w = [f"word{rng.getrandbits(30)}" for _ in range(300)]
        v = edited(rng, w, rng.randrange(4, 15))
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        want += [2 * i] if jaccard(w, v) >= 0.8 else [2 * i, 2 * i + 1]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id for r in kept.collect()}
    assert {x for x in want if x % 2} <= got


def test_appended_and_cut_copies_are_found(spark):
    rng = random.Random(22)
    word = lambda: f"word{rng.getrandbits(30)}"
    rows, near = [], set()
    for i in range(0, 120, 2):
        w = [word() for _ in range(rng.choice([100, 400, 1500]))]
        v = w + [word() for _ in range(len(w) * 23 // 100)] if i % 4 else w[: len(w) * 82 // 100]
        assert jaccard(w, v) >= 0.8
        near.add(i + 1)
        rows += [(i, " ".join(w)), (i + 1, " ".join(v))]
    kept = {r.doc_id for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for i, _ in rows} - near


def test_groups_are_those_of_all_pairs(spark):
    """Many texts of a few frequent lines, and variants of variants: each within 0.8 of some, not of the least id."""
    rng = random.Random(23)
    lines = [[f"line{rng.getrandbits(20)}" for _ in range(20)] for _ in range(24)]
    texts = [[w for line in rng.sample(lines, 12) for w in line] + [f"end{i}"] for i in range(60)]
    texts += [edited(rng, t, rng.randrange(1, 6)) for t in texts[:30]]
    base = [f"word{rng.getrandbits(30)}" for _ in range(300)]
    group = [base]
    for _ in range(80):
        group.append(edited(rng, rng.choice(group), rng.randrange(2, 5)))
    texts += group
    rng.shuffle(texts)
    sets = [set(simhash.shingle_set(" ".join(t)).tolist()) for t in texts]
    n = range(len(texts))
    pairs = [(a, b) for a in n for b in n if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.id: r.group for r in simhash.near_duplicates(docs).collect()}
    assert {i: got.get(i, i) for i in n} == union_find(pairs, n)


def test_similar_texts_that_share_no_band_are_grouped(spark):
    """texts that share no band were never compared. The seeds are those of the first such pairs."""
    texts = []
    for seed in (19850, 49558, 81250):
        rng = random.Random(seed)
        w = [f"w{rng.getrandbits(24)}" for _ in range(49)]
        v = list(w)
        v[20] = f"x{rng.getrandbits(24)}"
        a, b = (simhash.bands(simhash.shingle_set(" ".join(x))) for x in (w, v))
        assert jaccard(w, v) == 0.8 and not (a == b).any()
        texts += [" ".join(w), " ".join(v)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.id, r.group) for r in simhash.near_duplicates(docs).collect()} == {(i, i // 2 * 2) for i in range(6)}
    assert {r.doc_id for r in simhash.deduplicated(docs).collect()} == {0, 2, 4}


def test_what_signatures_refuse_is_found(spark, monkeypatch):
    """a pair whose signatures differ too much was never verified."""
    monkeypatch.setattr(simhash, "LOOSE_BITS", -1)
    rng = random.Random(24)
    lines = [[f"line{rng.getrandbits(20)}" for _ in range(20)] for _ in range(12)]
    texts = [[w for line in rng.sample(lines, 8) for w in line] + [f"word{rng.getrandbits(30)}" for _ in range(rng.choice([2, 60]))] for _ in range(30)]
    texts += [edited(rng, t, rng.randrange(1, 6)) for t in texts]
    texts += [[f"word{rng.getrandbits(30)}" for _ in range(n)] for n in range(1, 12)]
    texts += [t[:-1] for t in texts[-6:]]
    sets = [set(simhash.shingle_set(" ".join(t)).tolist()) for t in texts]
    n = range(len(texts))
    pairs = [(a, b) for a in n for b in n if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.id: r.group for r in simhash.near_duplicates(docs).collect()}
    assert len(pairs) > 20 and {i: got.get(i, i) for i in n} == union_find(pairs, n)


def test_wordless_texts_are_copies(spark):
    """texts of white space, and a null and an empty text of one id, were left as they were."""
    rows = [(3, ""), (4, " \n"), (5, "\t\t"), (6, None), (6, ""), (7, "\n a  b "), (8, "A b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == [3, 7]
    assert simhash.deduplicated(docs.where("doc_id = 6")).count() == 1


def test_exploded_fingerprints_are_not_broadcast(spark):
    """the index was broadcast, as its size was taken for that of the fingerprints it is exploded from."""
    plans = []

    class Watched(Staged):
        def keep(self, df, what="t"):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().keep(df, what)

    staged = Watched(spark, "test")
    nodes = staged.keep(spark.range(500).selectExpr("0 AS band", "id AS fp"))
    edges = staged.keep(simhash.links(staged, nodes, 2, 16))
    assert "SortMergeJoin" in plans[1] and "SortMergeJoin" in plans[2]
    assert not any("Broadcast" in p for p in plans)
    assert edges.count() > 0
