"""Word shingles of many texts at once, as 64-bit hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

K = 5
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _RNG.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POW = np.ones(1 << 12, dtype=np.uint64)


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    global _POW
    if base == _BASE and n <= len(_POW) and _POW[-1] != 1:
        return _POW[:n]
    size = max(n, 1 << 12)
    out = np.ones(size, dtype=np.uint64)
    out[1:] = np.uint64(base)
    out = np.multiply.accumulate(out)
    if base == _BASE:
        _POW = out
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without 20, 09-0D) of all texts in one array, and where each text's begin
    (one entry more than texts). lower: A-Z are lower-cased first."""
    raws = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = b"\n".join(raws) + b"\n"
    if lower:
        data = data.lower()
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), first
    size = ends - starts
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)  # place inside the word
    value = _BYTE[raw[~space]] * powers(int(size.max()))[at]
    hashed = np.add.reduceat(value, np.cumsum(size) - size)
    return mix(hashed + size.astype(np.uint64)), first


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingles of each text: of K words, lower-cased; of all words, if there are fewer."""
    words, first = word_hashes(texts, lower=True)
    n = len(words)
    out = []
    if n >= K:
        rolled = np.zeros(n - K + 1, dtype=np.uint64)
        for i in range(K):
            rolled += words[i : n - K + 1 + i] * _STEP[i]
        rolled = mix(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= K:
            out.append(np.unique(rolled[a : b - K + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _STEP[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def in_parts(texts: list, most: int = 1 << 18) -> Iterator[tuple[int, list]]:
    """Neighbouring texts together while they have at most so many characters; a longer text comes alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and size + n > most:
            yield lo, texts[lo:i]
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, texts[lo:]
