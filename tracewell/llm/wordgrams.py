"""Words of many texts at once, and sums of tables over hashed character n-grams of each word.

Shared by the language identifier and the toxicity tagger; everything is vectorised over the code points of
a block of texts. A word is a run of letters and marks; its n-grams include one boundary mark at each end.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np

#: Code points handled at once; a longer text is a block of its own.
BLOCK = 1 << 18


class Words(NamedTuple):
    """Words of a list of texts: text k has words first[k] to first[k + 1]; start and end are its code-point offsets."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    scores: np.ndarray
    script: np.ndarray


#: First and last code points of scripts; what lies in none is script 0.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF),
    ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
    ("han", 0x20000, 0x323AF),
)
SCRIPT_NAMES = ("other", *dict.fromkeys(name for name, _, _ in SCRIPTS))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its lower-case form if it belongs to words, else 0; its script."""
    lower, script = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if unicodedata.category(ch := chr(c))[0] in "LM":
            low = ch.lower()
            lower[c] = ord(low) if len(low) == 1 else c
    for name, a, b in SCRIPTS:
        script[a : b + 1] = SCRIPT_NAMES.index(name)
    return lower, script


def grams(chars: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(table index of the n-gram at each place, whether it lies within a word). chars: words between single zeros."""
    size = max(0, len(chars) - n + 1)
    h = np.full(size, np.uint64(n * 0x9E3779B97F4A7C15 % 2**64))
    inside = np.ones(size, bool)
    for k in range(n):
        part = chars[k : k + size]
        h = (h ^ part) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
        if 0 < k < n - 1:
            inside &= part != 0
    return (h >> np.uint64(64 - bits)).astype(np.int64), inside


def _block(text: str, tables: dict[int, np.ndarray], bits: int):
    lower, script = _tables()
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    low = lower[points]
    letter = low != 0
    start = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    end = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    columns = next(iter(tables.values())).shape[1] if tables else 0
    if not len(start):
        return start, end, np.zeros((0, columns), np.float32), np.zeros(0, np.uint8)
    keep = letter.copy()
    keep[start - 1] = True
    chars = np.append(low[keep].astype(np.uint64), np.uint64(0))
    heads = np.flatnonzero(chars[:-1] == 0)
    total = np.zeros((len(chars), columns), np.float32)
    for n, table in tables.items():
        at, inside = grams(chars, n, bits)
        total[: len(at)] += table[at] * inside[:, None]
    return start - 1, end - 1, np.add.reduceat(total[:-1], heads, axis=0), script[points[start]]


def words(texts: list[str], tables: dict[int, np.ndarray], bits: int) -> Words:
    """Words of the texts and, for each, the sums of tables[n] (2**bits rows) over its n-grams."""
    starts, ends, scores, scripts, counts = [], [], [], [], np.zeros(len(texts), np.int64)
    k = 0
    while k < len(texts):
        stop, size = k, 0
        while stop < len(texts) and (stop == k or size + len(texts[stop]) < BLOCK):
            size += len(texts[stop]) + 1
            stop += 1
        start, end, score, script = _block("\n".join(texts[k:stop]), tables, bits)
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts[k:stop])])
        owner = np.searchsorted(offsets, start, side="right") - 1
        counts[k:stop] = np.bincount(owner, minlength=stop - k)
        starts.append(start - offsets[owner])
        ends.append(end - offsets[owner])
        scores.append(score)
        scripts.append(script)
        k = stop
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    width = next(iter(tables.values())).shape[1] if tables else 0
    return Words(np.cumsum([0, *counts]), join(starts, np.int64), join(ends, np.int64), np.concatenate(scores) if scores else np.zeros((0, width), np.float32), join(scripts, np.uint8))


def gram_counts(texts: list[str], orders: tuple[int, ...], bits: int) -> dict[int, np.ndarray]:
    """How often each table row is met in the words of the texts, by order."""
    found = {n: np.zeros(1 << bits, np.int64) for n in orders}
    lower, _ = _tables()
    for text in texts:
        low = lower[np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
        letter = low != 0
        keep = letter.copy()
        keep[:-1] |= letter[1:]
        chars = np.append(low[keep].astype(np.uint64), np.uint64(0))
        for n in orders:
            at, inside = grams(chars, n, bits)
            found[n] += np.bincount(at[inside], minlength=1 << bits)
    return found


def steps(first: np.ndarray):
    """For each t, the indices of the t-th words of all texts that have one, longest texts first."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    base, active = first[:-1][order], np.searchsorted(-n[order], -np.arange(n.max(initial=0)), side="left")
    return base, active
