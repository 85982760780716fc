"""64-bit hashes of white-space separated words for many whole texts at once, in numpy."""

from __future__ import annotations

import numpy as np

#: Bytes handled at a time, unless one text is longer; arrays of 16 times as many bytes are made of them.
PIECE = 500_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(64).integers(1, 2**64, 256, dtype=np.uint64)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]  # A-Z hash as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def unmix(h: np.ndarray) -> np.ndarray:
    """What ``mix`` was given."""
    h = h ^ (h >> np.uint64(31)) ^ (h >> np.uint64(62))
    h = h * np.uint64(pow(0x94D049BB133111EB, -1, 2**64))
    h = h ^ (h >> np.uint64(27)) ^ (h >> np.uint64(54))
    h = h * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 2**64))
    return h ^ (h >> np.uint64(30)) ^ (h >> np.uint64(60))


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int):
        if len(cls.up) < n:
            cls.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE)]))
            cls.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _UNBASE)]))
        return cls.up, cls.down


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the white-space separated words of ``data`` begin and end."""
    edge = np.flatnonzero(np.diff(_SPACE[np.frombuffer(data, np.uint8)], prepend=True, append=True))
    return edge[::2], edge[1::2]


def _hash_joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[buffer]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[::2], edge[1::2]
    up, down = _Powers.of(len(buffer) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buffer] * up[: len(buffer)])])
    words = mix((total[end] - total[start]) * down[start])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return words, np.bincount(np.searchsorted(ends, start, side="right"), minlength=len(texts))


def word_hashes(texts: list[str | None], piece: int = PIECE):
    """Yields (first text's index, hashes of all words, words per text) for consecutive texts, about ``piece`` bytes at a time; A-Z count as a-z."""
    part: list[bytes] = []
    first = size = 0
    for i, t in enumerate(texts):
        data = t.encode("utf-8", "replace") if t else b""
        if part and size + len(data) > piece:
            yield first, *_hash_joined(part)
            part, first, size = [], i, 0
        part.append(data)
        size += len(data) + 1
    if part:
        yield first, *_hash_joined(part)
    if len(_Powers.up) > 2 * piece:
        _Powers.up = _Powers.down = np.ones(1, np.uint64)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    k = len(words) - n + 1
    h = np.zeros(max(k, 0), np.uint64)
    for j in range(n):
        h = mix(h + words[j : j + max(k, 0)] + np.uint64(j + 1))
    return h
