"""Hashed word shingles of whole texts, computed with NumPy over Arrow batches."""

from __future__ import annotations

import numpy as np

#: Five words make a shingle.
SHINGLE_WORDS = 5
#: Bytes that are hashed at a time, so that a very long text needs no more memory than its word hashes.
CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_WEIGHTS = mix(np.arange(1001, 1001 + SHINGLE_WORDS, dtype=np.uint64) * _STEP) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, 0xD6E8FEB86659FD93, np.uint64)) if n else np.zeros(0, np.uint64)


def _words_of_chunk(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blank = _SPACE[raw]
    edge = np.flatnonzero(np.diff(blank.astype(np.int8), prepend=1, append=1))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = ends - starts
    inside = np.flatnonzero(~blank)
    first = np.cumsum(lengths) - lengths
    within = np.arange(len(inside)) - np.repeat(first, lengths)
    values = _BYTE[_LOWER[raw[inside]]] * _powers(int(lengths.max()))[within]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64)), starts


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each lower-cased (A-Z) word and the byte at which the word starts."""
    data, at, hashes, starts = np.frombuffer(raw, np.uint8), 0, [], []
    while at < len(data):
        stop = min(len(data), at + CHUNK)
        while stop < len(data) and not _SPACE[data[stop]]:
            more = np.flatnonzero(_SPACE[data[stop : stop + CHUNK]])
            stop = stop + int(more[0]) if len(more) else min(len(data), stop + CHUNK)
        h, s = _words_of_chunk(data[at:stop])
        hashes.append(h)
        starts.append(s + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def _combine(words: np.ndarray, n: int) -> np.ndarray:
    last = len(words) - n + 1
    total = np.full(last, n * int(_STEP) % (1 << 64), np.uint64)
    for i in range(n):
        total += words[i : i + last] * _WEIGHTS[i]
    return mix(total) >> np.uint64(1)


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """For each text its distinct shingles as ascending 63-bit hashes; a text of fewer words than a shingle gives its
    whole sequence as one; null and wordless texts give none. Texts are hashed together, about CHUNK bytes at once."""
    out: list[np.ndarray] = []
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop] or b"") < CHUNK):
            size += len(texts[stop] or b"")
            stop += 1
        part = [t or b"" for t in texts[start:stop]]
        words, at = word_hashes(b" ".join(part))
        ends = np.cumsum([len(t) + 1 for t in part])
        bounds = np.concatenate([[0], np.searchsorted(at, ends)])
        every = _combine(words, SHINGLE_WORDS) if len(words) >= SHINGLE_WORDS else np.zeros(0, np.uint64)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= SHINGLE_WORDS:
                out.append(np.unique(every[a : b - SHINGLE_WORDS + 1]).view(np.int64))
            elif b > a:
                out.append(_combine(words[a:b], int(b - a)).view(np.int64))
            else:
                out.append(np.zeros(0, np.int64))
        start = stop
    return out
