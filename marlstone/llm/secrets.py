"""Secret scans: patterns, and two character Markov models compared by log-likelihood ratio.

One model is of random strings, one of ordinary identifiers; both are first-order chains over characters,
trained from labelled samples.  A stretch of 20 characters or more of an unbroken run whose ratio per
character is over a threshold set on held-back samples is a secret that no pattern knows.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import table, text_of, unused

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16
#: Least characters of a secret that no pattern knows, and what stands between the parts of a run.
STRETCH = 20
SEPARATORS = "=/_-"
#: A run of fewer different characters is a ruled line or filler, of which the chains know nothing; one in a million
#: random strings of 20 hexadecimal digits has so few.
DISTINCT = 6

ALPHABET = string.ascii_letters + string.digits + "+/_=-"
_CODE = np.full(128, len(ALPHABET), np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i
#: Parts that the ordinary identifiers of the default sample are put together from.
PARTS = (
    "get set is has on add new old max min num total count index value name type user group list map item node "
    "file path line word text page data table column row key field query result error message handler request "
    "response server client session config option default parse read write load save open close start stop "
    "create update delete remove insert find search filter sort merge split join format print encode decode "
    "build test check valid init main module class object string number array buffer stream thread process "
    "task event time date hour minute second version release source target input output device network port "
    "host address memory cache image color width height style view model controller service manager factory"
).split()


def random_sample(n: int, rng: random.Random) -> list[str]:
    """Random strings as generators of keys make them: several alphabets and lengths."""
    b62 = string.ascii_letters + string.digits
    kinds = (b62, b62 + "+/", b62 + "-_", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, string.hexdigits[:16])
    return ["".join(rng.choices(rng.choice(kinds), k=rng.randrange(20, 49))) for _ in range(n)]


def ordinary_sample(n: int, rng: random.Random) -> list[str]:
    """Identifiers in the usual letter cases, paths, and words run together, some with a number or a date."""
    out = []
    while len(out) < n:
        parts = rng.choices(PARTS, k=rng.randrange(3, 9))
        style = rng.randrange(6)
        if style == 0:
            s = "_".join(parts)
        elif style == 1:
            s = parts[0] + "".join(p.title() for p in parts[1:])
        elif style == 2:
            s = "_".join(parts).upper()
        elif style == 3:
            s = "/".join(parts)
        elif style == 4:
            s = "-".join(parts)
        else:
            s = "".join(parts)
        if rng.random() < 0.4:
            s += rng.choice(["", "_", "-"]) + str(rng.choice([rng.randrange(10), rng.randrange(1990, 2040), rng.randrange(10000)]))
        if len(s) >= 12:
            out.append(s)
    return out


@dataclass(frozen=True)
class MarkovPair:
    """Log-likelihood ratio by character pair (random over ordinary), and the threshold per character."""

    ratio: np.ndarray
    threshold: float

    def parts(self, token: str) -> np.ndarray:
        """The ratio of each character after the one before."""
        code = np.concatenate([[len(ALPHABET)], _CODE[np.frombuffer(token.encode("ascii"), np.uint8)]])
        return self.ratio[code[:-1], code[1:]]

    def score(self, token: str) -> float:
        """The highest mean ratio of a stretch of STRETCH characters or more (of the whole, if it is shorter)."""
        parts = self.parts(token)
        if len(parts) <= STRETCH:
            return float(parts.mean())
        total = np.concatenate([[0.0], np.cumsum(parts)])
        # a stretch of twice the length or more has a half that is no worse
        return float(max(((total[n:] - total[:-n]) / n).max() for n in range(STRETCH, min(2 * STRETCH, len(parts) + 1))))

    def is_secret(self, token: str) -> bool:
        return self.score(token) > self.threshold

    def stretches(self, token: str) -> list[tuple[int, int]]:
        """(start, end) of the secrets of an unbroken run: the whole run if its mean ratio is over the threshold,
        else the stretches of most evidence, each out to the next separators, and those left and right of it."""
        if len(token) < STRETCH or len(set(token)) < DISTINCT or not self.is_secret(token):
            return []
        over = self.parts(token) - self.threshold
        if over.sum() > 0:
            return [(0, len(token))]
        total = np.concatenate([[0.0], np.cumsum(over)])
        gain = total[STRETCH:] - np.minimum.accumulate(total[:-STRETCH])
        e = int(gain.argmax()) + STRETCH
        s = int(total[: e - STRETCH + 1].argmin())
        while s > 0 and token[s - 1] not in SEPARATORS:
            s -= 1
        while e < len(token) and token[e] not in SEPARATORS:
            e += 1
        return [*self.stretches(token[:s]), (s, e), *((e + a, e + b) for a, b in self.stretches(token[e:]))]


def _counts(sample: list[str]) -> np.ndarray:
    n = len(ALPHABET) + 1
    counts = np.full((n, n), 0.5)
    for s in sample:
        code = np.concatenate([[n - 1], _CODE[np.frombuffer(s.encode("ascii"), np.uint8)]])
        np.add.at(counts, (code[:-1], code[1:]), 1.0)
    return np.log(counts / counts.sum(1, keepdims=True))


def train(randoms: list[str] | None = None, ordinary: list[str] | None = None, seed: int = 7, miss_at_most: float = 0.002) -> MarkovPair:
    """Fit both models on two thirds of the labelled samples and set the threshold on the rest.

    The threshold is the highest ordinary score of the held-back samples, unless more than
    ``miss_at_most`` of the random ones would fall under it; then it is lowered to that quantile.
    """
    rng = random.Random(seed)
    randoms = randoms if randoms is not None else random_sample(3000, rng)
    ordinary = ordinary if ordinary is not None else ordinary_sample(3000, rng)
    cut = lambda x: (x[: len(x) * 2 // 3], x[len(x) * 2 // 3 :])
    (r, r_held), (o, o_held) = cut(randoms), cut(ordinary)
    pair = MarkovPair(_counts(r) - _counts(o), 0.0)
    least = float(np.quantile([pair.score(s) for s in r_held], miss_at_most))
    most = max(pair.score(s) for s in o_held)
    return MarkovPair(pair.ratio, max(min(most, least), 0.0) if most > least else (most + least) / 2)


def scan(text: str, model: MarkovPair) -> list[tuple[int, int, int]]:
    """(start, end, kind) of every secret of a text, by start, then kind; code points, end exclusive."""
    found = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST_VALUE:
            found.append((m.start(), m.end(), 0))
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= LEAST_ACCESS:
            found.append((m.start(), m.end(), 1))
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    found += [(m.start() + s, m.start() + e, 3) for m in CANDIDATE.finditer(text) for s, e in model.stretches(m.group())]
    return sorted(found, key=lambda x: (x[0], x[2], x[1]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def find_secrets(docs: DataFrame, text_col: str = "text", model: MarkovPair | None = None) -> DataFrame:
    """``docs`` with ``secrets``: an array of (start, end, kind) structs over the whole text.

    Equal scores of stretches go to the first. A null or empty text has an empty array; rows, repeated ones too, and further columns stay as they
    are (a column named ``secrets`` is replaced).
    """
    model = model or train()

    @F.pandas_udf("array<struct<start:int,end:int,kind:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in scan(t, model)] for t in texts], dtype=object)

    return docs.withColumn("secrets", run(text_of(text_col)))


def redacted(docs: DataFrame, model: MarkovPair | None = None) -> DataFrame:
    """``docs`` with every secret of ``text`` replaced by ``<secret>`` and n_chars counted anew.

    Overlapping spans become one; a text without secrets, a null or empty one too, stays as it is. Every row stays,
    repeated ones and those without an id too, with the columns it has, whatever they are called.
    """
    model = model or train()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redact(t, model) for t in texts], dtype=object)

    clean = unused("clean", docs)
    out = docs.withColumn(clean, run(F.col("text")))
    changed = ~F.col(clean).eqNullSafe(F.col("text"))
    return out.select(*[
        F.col(clean).alias(c) if c.lower() == "text"
        else F.when(changed, F.length(clean).cast(docs.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c) if c.lower() == "n_chars"
        else F.col(f"`{c}`")
        for c in docs.columns
    ])


def redact(text: str, model: MarkovPair) -> str:
    out, at = [], 0
    for s, e, _ in scan(text, model):
        if s >= at:
            out += [text[at:s], "<secret>"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of the secrets of every document."""
    model = train()

    @F.pandas_udf("n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_markov bigint")
    def digest(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            spans = scan(t, model)
            n = [sum(k == kind for _, _, k in spans) for kind in range(4)]
            base = joined([x for x in spans if x[2] < 3])
            rows.append((*n[:3], hashlib.sha256(base.encode()).hexdigest(), joined(spans), n[3]))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"])

    return table(spark, sf_dir, "documents").select("doc_id", digest(text_of()).alias("d")).select("doc_id", "d.*")
