"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint has a bit set where over half of a text's shingle hashes have it.  Fingerprints
that differ in at most d bits are found without comparing all pairs: cut into ``d // 2 + 1`` segments,
one segment of such a pair differs by at most one bit, so every fingerprint is indexed under each segment
with one bit wildcarded, equal index keys are brought together, and the distance is verified.  (For an
even d the last segment is indexed as it is: if all others differ in two bits or more, it differs in none.)

A key with over ``pair_limit`` fingerprints is not paired.  Its fingerprints are indexed under all keys
with two wildcards instead; those that share one are all within two bits of each other, so each is linked
to the least of them: as exact, and linear in the group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marlstone.llm.common import BROADCAST_IDS, HUB, Staged, hub_join, lookup, of_ids, table, text_of, unused
from marlstone.llm.components import components

#: Maps A-Z to a-z in UTF-8, where those bytes stand for nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BITS, HALF = 64, 32
SEED = 42
#: Hashes counted at a time, so a very long text needs no more memory than a long one.
BLOCK = 1 << 16


def words(text: str) -> list[bytes]:
    """UTF-8 words between bytes 0x20 and 0x09-0x0D, which is what bytes.split() splits at."""
    return text.encode("utf-8", "replace").translate(LOWER).split()


def shingles(tokens: list[bytes], k: int) -> list[bytes]:
    """All k-word shingles, repeats included; a shorter text is one shingle, an empty one has none."""
    if len(tokens) <= k:
        return [b" ".join(tokens)] if tokens else []
    return list(map(b" ".join, zip(*(tokens[i:] for i in range(k)), strict=False)))


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit fingerprint of unsigned hashes; zero if there are none."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.add.reduce(np.unpackbits(part, axis=1), axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes)).view(">u8")[0].astype(np.uint64).astype(np.int64))


def hashed(pieces: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, SEED) for x in pieces), np.uint64, len(pieces))


def fingerprint(text: str | None, k: int = 3) -> int:
    return majority(hashed(shingles(words(text or ""), k)))


def fingerprint_udf(k: int = 3):
    @F.pandas_udf(T.LongType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, k) for t in texts], dtype="int64")

    return run


def _variants(fp, bits: int):
    """Index keys (segment and wildcard in the high half, the masked segment in the low half)."""
    if bits not in (0, 1, 2):
        raise ValueError("links are exact for at most two differing bits")
    high, low = F.shiftrightunsigned(fp, HALF), fp.bitwiseAND(F.lit((1 << HALF) - 1))
    if bits == 2:
        ones = [(p << HALF, high.bitwiseAND(F.lit(~(1 << p) & 0xFFFFFFFF))) for p in range(HALF)]
        return [F.lit(tag).bitwiseOR(masked) for tag, masked in ones] + [F.lit(HALF << HALF).bitwiseOR(low)]
    # one segment of two is equal
    return [F.lit(33 << HALF).bitwiseOR(high), F.lit(HALF << HALF).bitwiseOR(low)]


def links(staged: Staged, nodes: DataFrame, bits: int = 2, pair_limit: int = 128) -> DataFrame:
    """Edges (band, a, b) over distinct ``nodes`` (band int, fp long) that connect exactly what pairs
    within ``bits`` of each other, of one band, connect."""
    index = nodes.select("band", "fp", F.explode(F.array(*_variants(F.col("fp"), bits))).alias("key"))
    # counted with partial sums, so a popular segment is no one task's load; the counts are joined back by many rows a key
    counts = index.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Spark takes what is exploded for as small as what it is exploded from, and would broadcast millions of rows
    shared = staged.keep(index.join(counts.hint("merge"), ["band", "key"]), "shared")
    bucket = Window.partitionBy("band", "key")
    before = bucket.orderBy("fp").rowsBetween(-pair_limit, -1)
    exact_distance = lambda b: (F.bit_count(F.col("fp").bitwiseXOR(b)) <= bits)
    pairs = (
        shared.where(F.col("n") <= pair_limit + 1)
        .select("band", "fp", F.filter(F.collect_list("fp").over(before), exact_distance).alias("found"))
        .where(F.size("found") > 0)
        .select("band", F.col("fp").alias("a"), F.explode("found").alias("b"))
    )
    hot = shared.where(F.col("n") > pair_limit + 1).select("band", "fp").distinct()
    masks = [~((1 << i) | (1 << j)) for i in range(BITS) for j in range(i + 1, BITS)] if bits == 2 else (
        [~(1 << i) for i in range(BITS)] if bits == 1 else [-1])
    masks = [m if m >= -(1 << 63) else m + (1 << 64) for m in masks]
    starred = (
        hot.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
        .select("band", "fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("kept"))
    )
    least = starred.groupBy("band", "mask", "kept").agg(F.min("fp").alias("b"), F.max("fp").alias("most"))
    stars = (
        starred.join(least.where("b < most").drop("most").hint("merge"), ["band", "mask", "kept"])
        .where("fp <> b").select("band", F.col("fp").alias("a"), "b")
    )
    return pairs.unionByName(stars)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, bits: int = 2) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (long) and component_id, the least id reachable.

    Null, empty and wordless texts have fingerprint zero and link like any other.  A null id gets a
    fingerprint and its group's least id (null if the group has no other).  Repeated rows stay repeated.
    An empty table gives an empty result; further columns are ignored.
    """
    staged = Staged(docs.sparkSession, "simhash")
    fps = staged.keep(
        docs.select(F.col(id_col).alias("id"), fingerprint_udf(k)(text_of(text_col)).alias("fp")), "fps"
    )
    groups = staged.keep(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "groups")
    edges = links(staged, groups.select(F.lit(0).alias("band"), "fp"), bits)
    roots = staged.keep(components(staged, edges.select("a", "b")), "roots")
    # of fingerprints that stand alone, one text each, nothing needs to be looked up
    rooted = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").where("root IS NOT NULL OR n > 1")
    rooted = staged.keep(rooted.select("fp", F.coalesce("root", "fp").alias("root"), "least"), "rooted")
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = staged.keep(rooted.join(of_root, "root").select("fp", "component_id", F.lit(True).alias("known")), "known")
    staged.only(fps, known)
    out = lookup(fps, known, "fp")
    return out.select(
        F.col("id").alias(id_col), F.col("fp").alias("fingerprint"),
        F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of those within two bits."""
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


# --- groups of near-duplicate texts, for the pipeline ---
#
# Sixty-four bits of SimHash can't tell a similarity of 0.8: two such texts differ in about twenty of them, and deletion
# variants reach two. So texts that may be near are brought together by bands of minima of their shingle hashes; SimHash
# words are the loose filter of what comes together, and the exact similarity of the shingle sets decides. Both may miss
# a pair, so they only serve to link most of each large group cheaply: a join of all texts by the prefixes of their shingle
# sets, which can't miss any, finds whatever is not yet linked.

SIGNATURE = 4  # 64-bit words of the signature that filters candidates
#: Texts are near-duplicates from this Jaccard similarity of their sets of shingles (as a fraction, for exact sums).
NEAR_NUM, NEAR_DEN = 4, 5
#: Of 256 bits. Sets with a Jaccard similarity of 0.8 differ in 39 on average (the angle of two sets with that
#: overlap), with a deviation of six, and those of five shingles and four of them in 48, so this loose filter is six
#: deviations off, and for the smallest sets four and a half. What it refuses, the join by prefixes may still find.
LOOSE_BITS = 76
#: Bands of so many minima each: a pair of a similarity of 0.8 shares no band once in 38 000 times.
BANDS, ROWS = 20, 4
#: Counters of shingle hashes; they only order the shingles, so hashes that share one cost time, never a pair.
COUNTERS, MOST = 1 << 20, np.iinfo(np.int32).max
#: Counters in a row of partial sums (8 kB, as Spark hands Python thousands of rows at once), and tasks that add them up.
PART, FIT_TASKS = 1 << 11, 8
#: Hashes in the sets of hubs that are broadcast at most (8 bytes each).
HUB_HASHES = 4_000_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_BAND = np.random.default_rng(11).integers(1, 1 << 63, (BANDS * ROWS, 2), np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray, i: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * _MIX[i]
        h = (h ^ (h >> np.uint64(29))) * _MIX[(i + 1) % 4]
        return h ^ (h >> np.uint64(32))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One signed key for each band of a set's hashes; none of an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 512):
            part = hashes[i : i + 512].view(np.uint64)
            part = (part ^ (part >> np.uint64(29)))[None, :] * _BAND[:, :1] + _BAND[:, 1:]
            np.minimum(least, part.min(1), out=least)
        key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[0]
        for r in range(ROWS):
            key = _mixed(key ^ least[r::ROWS], r)
    return key.view(np.int64)


def heads_udf(k: int = 5):
    """Of a text's shingle set: its size, a signature, and its bands."""

    @F.pandas_udf("size int, sig array<bigint>, bands array<bigint>")
    def run(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, k) for t in texts]
        return pd.DataFrame({
            "size": [len(h) for h in sets],
            "sig": [[majority(_mixed(h.view(np.uint64), i)) for i in range(SIGNATURE)] for h in sets],
            "bands": [bands(h) for h in sets],
        })

    return run


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """The distinct shingle hashes of a text, signed, in ascending order."""
    return np.unique(hashed(shingles(words(text or ""), k)).view(np.int64))


def sets_udf(k: int = 5):
    @F.pandas_udf("array<bigint>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, k) for t in texts], dtype=object)

    return run


def shingle_counts(texts: DataFrame, k: int = 5) -> np.ndarray:
    """Of each counter the number of shingles of all ``texts`` that belong to it, each once a text. Tasks' counts are added
    up on the executors, by parts, before they reach the driver."""
    schema = "part int, n binary"

    def count(batches):
        total, held, size = np.zeros(COUNTERS, np.int64), [], 0
        for batch in batches:
            for t in batch["text"]:
                held.append(counter_of(shingle_set(t, k)))
                size += len(held[-1])
                if size >= COUNTERS:
                    total += np.bincount(np.concatenate(held), minlength=COUNTERS)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=COUNTERS)
        rows = [(part, x.astype(np.int32).tobytes()) for part, x in enumerate(total.reshape(-1, PART)) if x.any()]
        yield pd.DataFrame(rows, columns=["part", "n"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, n in zip(batch["part"], batch["n"], strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(n, np.int32).astype(np.int64)
        yield pd.DataFrame([(part, x.clip(max=MOST).astype(np.int32).tobytes()) for part, x in total.items()], columns=["part", "n"])

    out = np.zeros((COUNTERS // PART, PART), np.int32)
    for r in texts.select("text").mapInPandas(count, schema).repartition(FIT_TASKS, "part").mapInPandas(add, schema).collect():
        out[r.part] = np.frombuffer(bytes(r.n), np.int32)
    return out.ravel()


def counter_of(hashes: np.ndarray) -> np.ndarray:
    return hashes & (COUNTERS - 1)


def prefix(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of a set of hashes, in ascending order, those that come first by ``counts`` and hash: so many that every set with a
    similarity of 0.8 has one of them, and they one of its prefix."""
    n = len(hashes) - -(-len(hashes) * NEAR_NUM // NEAR_DEN) + 1
    return hashes[np.argsort(counts[counter_of(hashes)], kind="stable")[:n]]


def prefixes_udf(counts, k: int = 5):
    @F.pandas_udf("array<bigint>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([prefix(shingle_set(t, k), counts.value) for t in texts], dtype=object)

    return run


def verified_pairs(staged: Staged, texts: DataFrame, pairs: DataFrame, k: int = 5) -> DataFrame:
    """The rows (a, b) of written ``pairs`` (x, y) whose ``texts`` (id, text) have shingle sets with a Jaccard similarity
    of 0.8 or more."""
    ids = staged.keep(pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct(), "ids")
    sets = staged.keep(of_ids(texts, ids, "id").select("id", sets_udf(k)("text").alias("hashes")), "sets")
    side = lambda end: sets.select(F.col("id").alias(end), F.col("hashes").alias(f"h{end}"))
    fits = lambda hubs: hubs.agg(F.sum(F.size("hx"))).first()[0] <= HUB_HASHES
    both = hub_join(staged, pairs, side("x"), "x", fits=fits).join(side("y"), "y")
    both = both.withColumn("common", F.size(F.array_intersect("hx", "hy")).cast("long"))
    total = F.size("hx") + F.size("hy")  # common / (total - common) >= NEAR
    near = both.where((NEAR_DEN + NEAR_NUM) * F.col("common") >= NEAR_NUM * total)
    out = staged.keep(near.where("common > 0").select(F.col("x").alias("a"), F.col("y").alias("b")), "near")
    staged.drop(sets)
    return out


def likely(nx, ny, sx, sy):
    """What a pair of a similarity of 0.8 fulfils: sizes exactly, signatures but for some deviations."""
    distance = sum((F.bit_count(sx[i].bitwiseXOR(sy[i])) for i in range(SIGNATURE)), F.lit(0))
    return (NEAR_DEN * F.least(nx, ny) >= NEAR_NUM * F.greatest(nx, ny)) & (distance <= LOOSE_BITS)


def near_duplicates(docs: DataFrame, k: int = 5, ident: Column | None = None) -> DataFrame:
    """(id, group): every document that has a near-duplicate other than equal ones after it, with the least id of its
    group; ``ident`` (doc_id) tells documents apart.

    Equal texts (letter case and white space aside) are grouped first, under their least id.  The rest are indexed
    by bands of minima of their shingle hashes, and each text is compared with the least id of each of its bands; this
    links most of every large group, by candidates that sizes and signatures allow.  Then all texts are joined exactly, by
    the rarest fifth of their shingles (prefix and positional filter), except within groups that are linked already: no
    pair is left out.  Candidates of either step are verified by the exact similarity of their shingle sets, and verified
    links are closed over.  Rows with a null doc_id take no part.
    """
    staged = Staged(docs.sparkSession, "neardup")
    whole = F.lower(F.trim(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", " ")))
    texts = docs.where("doc_id IS NOT NULL").select((ident if ident is not None else F.col("doc_id")).alias("id"), text_of().alias("text"))
    same = F.struct(F.xxhash64(whole).alias("h1"), F.crc32(whole.cast("binary")).alias("h2")).alias("same")
    heads = staged.keep(texts.select("id", same, heads_udf(k)("text").alias("s")).select("id", "same", "s.*"), "heads")
    first = heads.groupBy("same").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "b")
    first = staged.keep(first, "first")
    paired = lookup(heads, first, "same")
    copies = staged.keep(paired.where("id <> b").select("id", "b"), "copies")
    own = staged.keep(paired.where("b IS NULL OR id = b").where("size > 0").select("id", "size", "sig", "bands"), "own")
    index = own.select("id", F.explode("bands").alias("key"))
    counts = index.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = staged.keep(counts, "counts")
    shared = staged.keep(hub_join(staged, index, counts.drop("n"), "key", _hubs(counts)), "shared")
    light = own.select("id", "size", "sig")
    star = shared.where("id <> least").select(F.col("least").alias("x"), F.col("id").alias("y")).distinct()
    # equal copies hang on their least alone, so they take no part in the search for components
    linked = verified_pairs(staged, texts, _likely(staged, star, light), k)
    roots = staged.keep(components(staged, linked), "first_roots")
    pairs = _unlinked_pairs(staged, texts, own, roots, k)
    more = verified_pairs(staged, texts, pairs, k)
    roots = staged.keep(components(staged, linked.unionByName(more)), "roots")
    groups = roots.select(F.col("node").alias("id"), F.col("root").alias("group"))
    hung = lookup(copies, staged.keep(roots.select(F.col("node").alias("b"), "root"), "ends"), "b")
    groups = staged.keep(groups.unionByName(hung.select("id", F.coalesce("root", "b").alias("group"))), "groups")
    staged.only(groups)
    return groups


def _hubs(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("n") > HUB)


def _likely(staged: Staged, pairs: DataFrame, light: DataFrame) -> DataFrame:
    """The ``pairs`` (x, y) whose sizes and signatures (in ``light``, by id) allow a similarity of 0.8."""
    pairs = staged.keep(pairs, "asked")
    for end in ("x", "y"):
        side = light.select(F.col("id").alias(end), F.col("size").alias(f"n{end}"), F.col("sig").alias(f"s{end}"))
        pairs = hub_join(staged, pairs, side, end)
    return staged.keep(pairs.where(likely(*map(F.col, ("nx", "ny", "sx", "sy")))).select("x", "y"), "likely")


def _unlinked_pairs(staged: Staged, texts: DataFrame, own: DataFrame, roots: DataFrame, k: int) -> DataFrame:
    """The pairs (x, y) of different roots, of all texts in ``own``, that prefix, position and size allow to be similar.

    Shingles are in the order of the counts of all texts, rarest first. Two sets with a similarity of 0.8 have at least 0.8 of
    the greater one in common, so one of the first fifth of each; and after the first that they share, enough have to
    follow in both. Of the texts that have a shingle, those of its most frequent root aren't compared with each other.
    """
    counts = staged.spark.sparkContext.broadcast(shingle_counts(texts, k))
    rooted = own.select("id", "size").join(roots.withColumnRenamed("node", "id"), "id", "left")
    rooted = staged.keep(rooted.select("id", "size", F.coalesce("root", "id").alias("root")), "rooted")
    ahead = staged.keep(texts.select("id", prefixes_udf(counts, k)("text").alias("prefix")).join(rooted, "id"), "ahead")
    counts.unpersist()
    first = ahead.select("id", "root", "size", F.posexplode("prefix").alias("at", "h")).withColumn("at", F.col("at") + 1)
    met = first.groupBy("h").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("n"))
    met = staged.keep(met.where("r1 <> r2").select("h", "n"), "met")
    # what is exploded is no small side, though Spark takes it for one
    first = staged.keep(hub_join(staged, first, met.select("h"), "h", _hubs(met)), "prefixes")
    of_root = first.groupBy("h", "root").agg(F.count(F.lit(1)).alias("n"))
    major = of_root.groupBy("h").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.sum("n").alias("n"))
    major = staged.keep(major, "major")
    first = staged.keep(hub_join(staged, first, major.drop("n"), "h", _hubs(major)), "sided")
    side = lambda df, i: df.select("h", (F.col("root") == F.col("major")).alias(f"major{i}"), *[F.col(c).alias(f"{c}{i}") for c in ("id", "root", "size", "at")])
    a, b = side(first.where("root <> major"), 1), side(first, 2)
    overlap = 1 + F.least(F.col("size1") - F.col("at1"), F.col("size2") - F.col("at2"))
    near = (NEAR_NUM + NEAR_DEN) * overlap >= NEAR_NUM * (F.col("size1") + F.col("size2"))
    pairs = a.join(b, "h").where((F.col("major2") | (F.col("id1") < F.col("id2"))) & (F.col("root1") != F.col("root2")) & near)
    return staged.keep(pairs.select(F.least("id1", "id2").alias("x"), F.greatest("id1", "id2").alias("y")).distinct(), "pairs")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the least doc_id.

    Rows that share a doc_id are documents of their own if their texts differ, and of equal ones one row stays, the
    least by its other columns as JSON; of a group that has texts of one id, the least hash stays. Rows with a null doc_id
    all stay. Null, empty and wordless texts are equal copies of each other. Columns of any name and type stay, and an
    empty table stays empty.
    """
    staged = Staged(docs.sparkSession, "dedup")
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    mark, ident = unused("marked", docs), F.col("doc_id")
    again = staged.keep(again.select("doc_id", F.lit(True).alias(mark)), "again")
    plain = [F.col(f"`{c}`") for c in docs.columns]
    if not again.isEmpty():
        marked = lookup(docs, again, "doc_id")
        rest = F.struct(*[c for c, name in zip(plain, docs.columns, strict=True) if name not in ("doc_id", "text")], F.lit(0).alias(mark))
        one = marked.where(F.col(mark)).groupBy("doc_id", "text").agg(F.min_by(rest, F.to_json(rest)).alias("rest"))
        one = one.select(*[F.col(f"`{c}`") if c in ("doc_id", "text") else F.col(f"rest.`{c}`") for c in docs.columns])
        docs = staged.keep(marked.where(F.col(mark).isNull()).select(*plain).unionByName(one), "single")
        # not of text_of(): a null text and an empty one are two rows
        ident = F.struct("doc_id", F.xxhash64(F.col("text").cast("string")).alias("h"))
    own = unused("ident", docs)
    gone = near_duplicates(docs, ident=ident).where("id <> group")
    gone = staged.keep(gone.select(F.col("id").alias(own), F.lit(True).alias(mark)), "gone")
    return lookup(docs.withColumn(own, ident), gone, own, most=BROADCAST_IDS).where(F.col(mark).isNull()).select(*plain)
