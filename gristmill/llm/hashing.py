"""Word and n-gram hashes of whole texts, computed for many texts at once inside a task (numpy only).

A word is a run of characters other than space and the control characters 9 to 13. Texts of any length are
worked through in pieces of about one megabyte, so the memory beyond the hashes themselves stays constant.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _piece_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words in ``b`` and their hashes (a polynomial over the bytes)."""
    gap = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return start, np.empty(0, np.uint64)
    size = end - start
    total = int(size.sum())
    # position inside the word of every byte that belongs to a word
    inside = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    power = np.empty(int(size.max()), np.uint64)
    power[0] = _BASE
    if len(power) > 1:
        power[1:] = _BASE
        np.multiply.accumulate(power, out=power)
    value = (b[~gap].astype(np.uint64) + np.uint64(1)) * power[inside]
    return start, mix(np.add.reduceat(value, np.cumsum(size) - size))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets): text i owns ``hashes[offsets[i]:offsets[i + 1]]``."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    blob = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(blob):
        to = min(at + PIECE, len(blob))
        while to < len(blob) and not _SPACE[blob[to - 1]]:
            ahead = np.flatnonzero(_SPACE[blob[to:to + PIECE]])
            to = to + int(ahead[0]) + 1 if len(ahead) else min(to + PIECE, len(blob))
        s, h = _piece_hashes(blob[at:to])
        starts.append(s + at)
        hashes.append(h)
        at = to
    start = np.concatenate(starts) if starts else np.empty(0, np.int64)
    all_hashes = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    return all_hashes, np.searchsorted(start, first)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words; a shorter text is one run of all its words, an empty one has none."""
    n = min(n, len(words))
    if not n:
        return words
    total = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[j:len(words) - n + 1 + j]
    return mix(total + np.uint64(n))
