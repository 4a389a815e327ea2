"""Array arithmetic on one text at a time: words, shingles and character grams as 64-bit hashes."""

from __future__ import annotations

from functools import cache

import numpy as np

U64 = np.uint64
_BASE, _MIX1, _MIX2 = 0x9E3779B97F4A7C15 | 1, U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=U64) + U64(1)
_LOWER[65:91] += U64(32)
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> U64(30))) * _MIX1
    h = (h ^ (h >> U64(27))) * _MIX2
    return h ^ (h >> U64(31))


def _table(name: str, base: int, n: int) -> np.ndarray:
    have = _powers[name]
    if len(have) < n:
        have = np.cumprod(np.concatenate(([U64(1)], np.full(max(n, 2 * len(have)), base % 2**64, U64))), dtype=U64)
        _powers[name] = have
    return have


def words(text: str | None) -> np.ndarray:
    """A hash of each word (runs of anything but ASCII white space, A-Z in lower case)."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.empty(0, U64)
    inside = ~_SPACE[data]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(starts):
        return np.empty(0, U64)
    up, down = _table("up", _BASE, len(data)), _table("down", pow(_BASE, -1, 2**64), len(data))
    return mix(np.add.reduceat(_LOWER[data] * inside * up[: len(data)], starts) * down[starts])


def runs(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    h = values[:n].copy()
    for j in range(1, k):
        h = h * U64(_BASE) + values[j : j + n]
    return mix(h)


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter text has its whole sequence as one."""
    w = words(text)
    if len(w) >= k:
        return np.unique(runs(w, k))
    return runs(w, len(w)) ^ U64(len(w)) if len(w) else w


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


@cache
def _folds() -> tuple[np.ndarray, np.ndarray]:
    """For each code point of the basic plane: its lower case form, and itself a space unless a letter (first) or a letter or digit (second)."""
    low = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, range(0x10000))]
    alpha = [x if chr(i).isalpha() else 32 for i, x in enumerate(low)]
    alnum = [x if chr(i).isalnum() else 32 for i, x in enumerate(low)]
    return np.array(alpha, np.uint32), np.array(alnum, np.uint32)


def folded(text: str | None, digits: bool) -> tuple[np.ndarray, np.ndarray]:
    """(characters, places): lower case, all but letters (and digits) as single spaces, and where each stood in the text."""
    raw = code_points(text)
    fold = _folds()[int(digits)]
    chars = fold[np.minimum(raw, 0xFFFF)]
    if len(high := np.flatnonzero(raw > 0xFFFF)):
        chars[high] = [c if chr(c).isalpha() or digits and chr(c).isalnum() else 32 for c in raw[high].tolist()]
    gap = chars == 32
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    places = np.flatnonzero(keep)
    return chars[places], places


def char_runs(chars: np.ndarray, q: int) -> np.ndarray:
    """A hash of each run of q characters, by doubling."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.empty(0, U64)
    out, at, bit, block = None, 0, 1, chars.astype(U64)
    while bit <= q:
        if q & bit:
            part = block[at : at + n]
            out = part.copy() if out is None else out * U64(pow(_BASE, bit, 2**64)) + part
            at += bit
        m = len(block) - bit
        block = block[:m] * U64(pow(_BASE, bit, 2**64)) + block[bit : bit + m] if m > 0 else block[:0]
        bit *= 2
    return mix(out)
