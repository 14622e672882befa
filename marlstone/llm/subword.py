"""Character n-grams of many texts at once, in numpy."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np

CODES = sys.maxunicode + 1
ALNUM = np.fromiter((chr(i).isalnum() for i in range(CODES)), bool, CODES)
ALPHA = np.fromiter((chr(i).isalpha() for i in range(CODES)), bool, CODES)


def codes(texts: list[str], letters: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts with zeros for whatever is no letter, and the start of each
    text; two zeros stand between texts."""
    low = [t.lower() for t in texts]
    every = np.frombuffer(("\0\0" + "\0\0".join(low) + "\0\0").encode("utf-32-le", "replace"), np.uint32)
    starts = np.cumsum([2] + [len(t) + 2 for t in low[:-1]]) if low else np.zeros(0, np.int64)
    return np.where(letters[every], every, 0), starts


def word_index(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position the number of its word (of the last one before, between words), and word starts."""
    starts = np.flatnonzero((z[1:] != 0) & (z[:-1] == 0)) + 1
    mark = np.zeros(len(z), np.int32)
    mark[starts] = 1
    return np.cumsum(mark, dtype=np.int32) - 1, starts


def grams(z: np.ndarray, owner: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, word) of every n-gram that lies in one word, its edges included."""
    wide = z.astype(np.uint64)
    letter = z != 0
    with np.errstate(over="ignore"):
        for n in sizes:
            if len(z) < n:
                continue
            m = len(z) - n + 1
            inside = letter[1 : 1 + m].copy()
            for j in range(2, n - 1):
                inside &= letter[j : j + m]
            at = np.flatnonzero(inside)
            h = np.full(len(at), n, np.uint64)
            for j in range(n):
                h = h * np.uint64(0x100000001B3) + wide[at + j]
            h ^= h >> np.uint64(29)
            h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
            yield h.astype(np.int32), owner[at + 1]


def blocks(texts: list[str], most: int, longest: int | None = None) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in order, in lists of at most ``most`` characters, with the number of each text. A text of more than
    ``longest`` (``most``) is cut at spaces (within a word only if there is none), so every character comes up once; one
    of more than ``most`` that isn't cut is a list of its own."""
    longest = longest or most
    of: list[int] = []
    parts: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or not text:
            to = min(len(text), at + longest)
            if to < len(text):
                cut = text.rfind(" ", at, to)
                to = cut + 1 if cut >= at else to
            if parts and size + to - at > most:
                yield of, parts
                of, parts, size = [], [], 0
            of.append(i)
            parts.append(text[at:to])
            size += to - at
            at = to
            if not text:
                break
    if parts:
        yield of, parts
