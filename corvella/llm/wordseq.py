"""Texts as sequences of word numbers over a small vocabulary, and alignment of such sequences."""

from __future__ import annotations

import re

import numpy as np

from corvella.llm.common import Memo

_EDGE = re.compile(r"[\W_]+")


def normal(chunk: str) -> str:
    """A run without white space as a word: lower case, letters and digits only; may be empty."""
    return chunk if chunk.isalnum() else _EDGE.sub("", chunk)


def words_of(text: str | None) -> list[str]:
    return [w for c in (text or "").lower().split() if (w := normal(c))]


class Numberer:
    """Numbers words by a vocabulary from 1 on; other words are 0. Runs without letters or digits vanish."""

    def __init__(self, vocab: dict[str, int]):
        self.memo = Memo(lambda c: vocab.get(w, 0) if (w := normal(c)) else -1)

    def __call__(self, text: str | None) -> np.ndarray:
        chunks = (text or "").lower().split()
        ids = np.fromiter(map(self.memo.__getitem__, chunks), np.int64, len(chunks))
        return ids[ids >= 0] if len(ids) and ids.min() < 0 else ids


def grams(ids: np.ndarray, n: int, base: int) -> np.ndarray:
    """A number for each run of n words, -1 where a word is outside the vocabulary."""
    if len(ids) < n:
        return np.zeros(0, np.int64)
    m = len(ids) - n + 1
    out, bad = np.zeros(m, np.int64), np.zeros(m, bool)
    for j in range(n):
        out = out * base + ids[j : m + j]
        bad |= ids[j : m + j] == 0
    out[bad] = -1
    return out


def align(a: np.ndarray, b: np.ndarray, band: tuple[int, int] | None = None, match: int = 2, differ: int = -1, gap: int = -1) -> tuple[int, int, int, int, int, int]:
    """Smith-Waterman alignment: (score, matches, a_start, a_end, b_start, b_end), ends exclusive.

    band: (low, high) bounds of j - i; only cells within are made, so time and memory are len(a) times its width.
    """
    n, m = len(a), len(b)
    low, high = band or (-n, m)
    low, high = max(low, -n), min(high, m)
    if low > high or not n or not m:
        return 0, 0, 0, 0, 0, 0
    # h[i, d]: the best score that ends at the first i and i + low + d words; a column at either side stays empty
    width = high - low + 1
    h = np.zeros((n + 1, width + 2), np.int32)
    steps = gap * np.arange(width, dtype=np.int32)
    held = np.zeros(width + n + 1, b.dtype)  # held[i + d] is the word of b that ends there, 0 beyond b
    k = np.arange(low, low + len(held))
    inside = (k >= 1) & (k <= m)
    held[inside] = b[k[inside] - 1]
    for i in range(1, n + 1):
        word, real = held[i : i + width], inside[i : i + width]
        row = np.maximum(h[i - 1, 1:-1] + np.where((word == a[i - 1]) & (word > 0), match, differ), h[i - 1, 2:] + gap)
        row = np.where(real, np.maximum(row, 0), 0)
        row = np.maximum.accumulate(row - steps) + steps  # gaps along b
        h[i, 1:-1] = np.where(real, row, 0)
    i, d = np.unravel_index(np.argmax(h), h.shape)
    i, j = int(i), int(i + low + d - 1)
    score, i_end, j_end, hits = int(h[i, d]), i, j, 0
    at = lambda i, j: h[i, j - i - low + 1] if low <= j - i <= high else 0
    while i and j and at(i, j) > 0:
        same = b[j - 1] == a[i - 1] and b[j - 1] > 0
        if at(i, j) == at(i - 1, j - 1) + (match if same else differ):
            hits += bool(same)
            i, j = i - 1, j - 1
        elif j - i < high and at(i, j) == at(i - 1, j) + gap:
            i -= 1
        else:
            j -= 1
    return score, hits, i, i_end, j, j_end
