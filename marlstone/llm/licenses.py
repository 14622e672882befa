"""License scans: phrases, and an exact set-similarity join of text blocks with license notices.

The join finds every stretch of a text, of at most ``WINDOW`` times a notice's words, that holds at least ``threshold``
of the notice's distinct words.  Words are ranked by the number of texts in the whole corpus that have them, rarest
first.  A stretch that holds o of the n words of a notice holds one of its first n - o + 1 (prefix filter), so texts
are cut into blocks around those words, and blocks are joined with notices by (word); a block needs o words (length
filter), and at the first word they share enough must follow in both (positional filter).  What passes is verified
at every place.  Of notices of one family that overlap, such as those of versions of one license, the best stays.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import Staged, lookup, table, text_of, unused

#: Phrases and the labels they stand for.
PHRASES = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))
#: License notices in their usual wording, with labels and the words that no stretch may lack.
NOTICES = (
    ("mit", "Released under the MIT License.", "mit"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ""),
    ("apache", "Licensed under the Apache License, Version 2.0.", "apache"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", "general public"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "general public"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lesser general public"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ""),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ""),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla"),
    ("cc-by", "Licensed under CC BY 4.0.", "cc by"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", "cc by nc"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", "cc by sa"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "commons attribution"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "commons noncommercial"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "commons sharealike"),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered"),
)
#: Labels of which one notice holds most of another's words.
FAMILIES = (("gpl", "lgpl"), ("cc-by", "cc-by-nc", "cc-by-sa"))
THRESHOLD = 0.8
#: A stretch is at most so many times as long as its notice.
WINDOW = 2
#: A notice of fewer distinct words than this must be contained in full: a fifth of few words says little.
SHORT = 6

_TO = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """A-Z lower-cased, split at ASCII characters other than letters and digits."""
    return text.encode("utf-8", "replace").translate(_TO).split()


@dataclass(frozen=True)
class Notice:
    label: str
    family: str
    ranked: tuple[int, ...]  # distinct words by rank, rarest first
    telling: frozenset[int]
    length: int  # words, repeats included
    need: int

    @property
    def prefix(self) -> tuple[int, ...]:
        return self.ranked[: len(self.ranked) - self.need + 1]


class Matcher:
    """Notices over ranked words."""

    def __init__(self, frequency: dict[bytes, int], notices=NOTICES, threshold: float = THRESHOLD):
        vocabulary = sorted({w for n in notices for w in words(n[1])}, key=lambda w: (frequency.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.notices = []
        for label, text, telling in notices:
            tokens = [self.rank[w] for w in words(text)]
            ranked = tuple(sorted(set(tokens)))
            need = len(ranked) if len(ranked) < SHORT else ceil(threshold * len(ranked) - 1e-9)
            family = next((f[0] for f in FAMILIES if label in f), label)
            self.notices.append(Notice(label, family, ranked, frozenset(self.rank[w] for w in words(telling)), len(tokens), need))
        #: How far a stretch can reach from a prefix word.
        self.reach: dict[bytes, int] = {}
        for n in self.notices:
            for r in n.prefix:
                self.reach[vocabulary[r]] = max(self.reach.get(vocabulary[r], 0), WINDOW * n.length - 1)

    def prefixes(self) -> list[tuple[int, int, int, int, int]]:
        """(word, notice, place, distinct words, needed words) of every prefix word of every notice."""
        return [(r, i, at, len(n.ranked), n.need) for i, n in enumerate(self.notices) for at, r in enumerate(n.prefix)]

    def blocks(self, tokens: list[bytes]) -> list[tuple[int, list[int]]]:
        """(first word, ranks, -1 for words of no notice) of the stretches within reach of a prefix word; they don't touch."""
        if self.reach.keys().isdisjoint(tokens):
            return []
        spans: list[list[int]] = []
        for at, w in enumerate(tokens):
            if w in self.reach:
                s, e = max(0, at - self.reach[w]), min(len(tokens), at + self.reach[w] + 1)
                if spans and s <= spans[-1][1]:
                    spans[-1] = [min(s, spans[-1][0]), max(e, spans[-1][1])]
                    while len(spans) > 1 and spans[-1][0] <= spans[-2][1]:
                        last = spans.pop()
                        spans[-1] = [min(last[0], spans[-1][0]), max(last[1], spans[-1][1])]
                else:
                    spans.append([s, e])
        get = self.rank.get
        return [(s, [get(w, -1) for w in tokens[s:e]]) for s, e in spans]

    def matches(self, ranks: list[int], i: int) -> list[tuple[int, int, int]]:
        """(distinct words, first, end) of the stretches of a block that hold enough of notice i, each as short as it
        can be: of those that overlap in a row the one with the most words, then the shortest, then the first."""
        notice, size = self.notices[i], WINDOW * self.notices[i].length
        ranked = set(notice.ranked)
        held: dict[int, int] = {}
        out: list[tuple[int, int, int]] = []
        first = last = 0
        for at, r in enumerate(ranks):
            if r not in ranked:
                continue
            held[r] = held.get(r, 0) + 1
            while at - first >= size or (x := ranks[first]) not in ranked or held[x] > 1:
                if (x := ranks[first]) in ranked:
                    held[x] -= 1
                    if not held[x]:
                        del held[x]
                first += 1
            if len(held) < notice.need or not notice.telling <= held.keys():
                continue
            own = (len(held), first, at + 1)
            if out and first < last:
                if (own[0], first - at) > (out[-1][0], out[-1][1] - out[-1][2] + 1):
                    out[-1] = own
            else:
                out.append(own)
            last = at + 1
        return out

    def best(self, ranks: list[int], candidates: list[int]) -> list[tuple[str, float]]:
        """(label, containment) of the notices that a block holds, without those of which half or more is also that of a
        better one (then of a longer one) of their family."""
        found = [(got / len(self.notices[i].ranked), len(self.notices[i].ranked), i, s, e) for i in candidates for got, s, e in self.matches(ranks, i)]
        out = []
        for share, n, i, s, e in found:
            notice = self.notices[i]
            beaten = any(
                (share2, n2) > (share, n) and self.notices[j].family == notice.family and self.notices[j].label != notice.label and 2 * (min(e, e2) - max(s, s2)) >= e - s
                for share2, n2, j, s2, e2 in found
            )
            if not beaten:
                out.append((notice.label, share))
        return out


def places(text: str) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels) of a text."""
    tokens = words(text)
    joined = b" " + b" ".join(tokens) + b" "
    at_word, base = [], set()
    if b" license " in joined:
        for phrase, label in PHRASES:
            at, before, k = joined.find(b" " + phrase + b" "), 0, 0
            while at >= 0:
                k += joined.count(b" ", before, at)
                before = at
                at_word.append(k)
                base.add(label)
                at = joined.find(b" " + phrase + b" ", at + 1)
    return len(tokens), len(at_word), min(at_word, default=None), max(at_word, default=None), sorted(base)


def frequencies(docs: DataFrame, notices=NOTICES) -> dict[bytes, int]:
    """In how many texts each word of the notices occurs. As many rows as these have words reach the driver."""
    vocabulary = {w for n in notices for w in words(n[1])}

    def count(batches):
        total: dict[bytes, int] = {}
        for batch in batches:
            for t in batch["text"]:
                for w in vocabulary.intersection(words(t)):
                    total[w] = total.get(w, 0) + 1
        if total:
            yield pd.DataFrame({"word": [w.decode() for w in total], "n": np.array(list(total.values()), np.int64)})

    rows = docs.select(text_of().alias("text")).mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r.word.encode(): r.n for r in rows}


def join_blocks(staged: Staged, blocks: DataFrame, matcher: Matcher) -> DataFrame:
    """(key, start, notices): the notices that a written table of blocks (key, start, ranks) may hold, by prefix, length
    and positional filter."""
    known = F.array_sort(F.array_distinct(F.filter("ranks", lambda r: r >= 0)))
    ranked = blocks.select("key", "start", known.alias("known"))
    grams = ranked.select("key", "start", F.size("known").alias("size"), F.posexplode("known").alias("at", "word"))
    # as many rows as the notices have prefix words
    prefixes = blocks.sparkSession.createDataFrame(matcher.prefixes(), "word int, notice int, place int, n int, need int")
    some = grams.join(F.broadcast(prefixes), "word").where("size >= need AND 1 + least(size - 1 - at, n - 1 - place) >= need")
    return staged.keep(some.groupBy("key", "start").agg(F.sort_array(F.collect_set("notice")).alias("notices")), "candidates")


def contained(docs: DataFrame, matcher: Matcher, text_col: str = "text") -> DataFrame:
    """(key, labels, best): of every text that holds a notice, by its hash, the labels and the highest containment."""
    staged = Staged(docs.sparkSession, "licenses")

    @F.pandas_udf("array<struct<start:int,ranks:array<int>>>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "ranks": r} for s, r in matcher.blocks(words(t))] for t in texts], dtype=object)

    @F.pandas_udf("array<struct<label:string,share:double>>")
    def verified(ranks: pd.Series, notices: pd.Series) -> pd.Series:
        return pd.Series([[{"label": x, "share": y} for x, y in matcher.best(list(r), list(n))] for r, n in zip(ranks, notices, strict=True)], dtype=object)

    blocks = docs.select(_key(text_col), cut(text_of(text_col)).alias("b")).select("key", F.inline("b"))
    blocks = staged.keep(blocks.dropDuplicates(["key", "start"]), "blocks")
    found = blocks.join(join_blocks(staged, blocks, matcher), ["key", "start"]).select("key", F.inline(verified("ranks", "notices")))
    out = staged.keep(found.groupBy("key").agg(F.collect_set("label").alias("labels"), F.max("share").alias("best")), "labels")
    staged.only(out)
    return out


def _key(text_col: str):
    t = text_of(text_col)
    return F.struct(F.xxhash64(t).alias("h1"), F.crc32(t.cast("binary")).alias("h2"), F.length(t).alias("n")).alias("key")


def license_scan(docs: DataFrame, notices=NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a struct ``license``: word count, phrase places, labels and the best containment.

    A null or empty text has no words, empty labels and score 0; places of phrases are null where there are
    none. Notices of one family with equal containment of equal length both stay. Rows, repeated ones too, and further
    columns stay (a column named ``license`` is replaced); an empty table gives an empty result.
    """
    found = contained(docs, Matcher(frequencies(docs, notices), notices, threshold))

    @F.pandas_udf("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([places(t) for t in texts], columns=["n_words", "n_base", "first_word", "last_word", "base"])
        return out.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64"})

    rest = docs.drop("license")
    key, own, labels, best = (unused(n, rest) for n in ("text_key", "phrases", "notice_labels", "notice_share"))
    side = found.select(F.col("key").alias(key), F.col("labels").alias(labels), F.col("best").alias(best))
    out = lookup(rest.withColumns({own: run(text_of()), key: _key("text")}), side, key)
    phrase = lambda n: F.col(f"`{own}`.{n}").alias(n)
    all_labels = F.array_sort(F.array_union(phrase("base"), F.coalesce(F.col(labels), F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce(F.col(best), F.lit(0.0)), F.when(F.size(phrase("base")) > 0, 1.0).otherwise(0.0))
    scan = F.struct(
        *map(phrase, ("n_words", "n_base", "first_word", "last_word")), F.array_join(phrase("base"), ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"), score.alias("score"),
    )
    return out.select(*[F.col(f"`{c}`") for c in rest.columns], scan.alias("license"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase places and license labels of every document."""
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license.*")
