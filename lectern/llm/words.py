"""Vectorised words, word hashes and word-shingle hashes of UTF-8 text (numpy).

A word is a maximal run of bytes outside {0x20, 0x09-0x0D}. Texts are scanned in
slices that end at white space, so working memory is bounded by the slice (or by
one word, if a word is longer) and not by the text.
"""

from __future__ import annotations

import numpy as np

SLICE = 1 << 18
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COEF = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = -(-n // 4096) * 4096
        f = np.full(size, _BASE, np.uint64)
        g = np.full(size, _BASE_INV, np.uint64)
        f[0] = g[0] = 1
        _pow, _inv = np.cumprod(f), np.cumprod(g)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix), elementwise."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(buf: np.ndarray):
    """Views of ``buf`` cut at white space."""
    n, at = len(buf), 0
    while at < n:
        end = min(n, at + SLICE)
        while end < n:
            gap = np.flatnonzero(~_IS_WORD[buf[end:end + SLICE]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(n, end + SLICE)
        yield buf[at:end]
        at = end


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words."""
    w = np.zeros(len(buf) + 2, np.int8)
    w[1:-1] = _IS_WORD[buf]
    d = np.diff(w)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def word_hashes(buf: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    parts = []
    for s in slices(buf):
        start, end = spans(s)
        if not len(start):
            continue
        pw, inv = _powers(len(s) + 1)
        pre = np.zeros(len(s) + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[s] if lower else s] * pw[:len(s)], out=pre[1:])
        parts.append(mix((pre[end] - pre[start]) * inv[start] + (end - start).astype(np.uint64)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words; empty when there are fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:m] * _COEF[0]
    for j in range(1, n):
        acc += h[j:j + m] * _COEF[j]
    return mix(acc)


def shingles(buf: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles, A-Z lower-cased; with fewer
    than ``n`` words the whole sequence counts as one shingle; no words, none."""
    h = word_hashes(buf, lower=True)
    if not len(h):
        return h
    if len(h) < n:
        return mix((h * _COEF[:len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    return np.unique(windows(h, n))
