"""Word shingles of many texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from quarry.llm.common import pieces

WORDS = 5
#: Texts are joined up to so many bytes before they are hashed; a longer text is a piece of its own.
PIECE_BYTES = 900_000
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xD1B54A32D192ED03
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below n (at least)."""
    size = 1 << max(12, int(n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.empty(size, np.uint64)
            p[0] = 1
            k = 1
            while k < size:
                p[k : 2 * k] = p[:k] * np.uint64(pow(base, k, 1 << 64))
                k *= 2
            out.append(p)
        _powers[size] = tuple(out)
    return _powers[size]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z in lower case, and for each text where its words begin in them (one entry more at the end)."""
    data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    gap = _SPACE[data]
    edge = np.diff(gap.view(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return h, np.searchsorted(start, offsets)


def shingle_sets(texts: list[bytes], k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words than k is one shingle, without words none."""
    h, first = word_hashes(texts)
    n = len(h)
    s = np.zeros(n, np.uint64)
    for j in range(min(k, n)):
        s[: n - j] = s[: n - j] * np.uint64(_STEP) + h[j:]
    s = mix(s)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(s[a : b - k + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                x = np.uint64(b - a)
                for w in h[a:b]:
                    x = x * np.uint64(_STEP) + w
            out.append(mix(np.array([x], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sets_of(texts: list[bytes], k: int = WORDS) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Shingle sets of the texts, some at a time: (index of the first, sets)."""
    for a, b in pieces([len(t) for t in texts], PIECE_BYTES):
        yield a, shingle_sets(texts[a:b], k)
