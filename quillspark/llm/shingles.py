"""Sets of hashed word shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from .arrow import words_of

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser over 64 bits: each input bit reaches each output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and each text's place among them."""
    codes, items, offsets = words_of(texts)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(w) for w in items.cast(pa.binary()).to_pylist()), np.uint64, len(items))
    return hashes[codes], offsets


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted by hash and joined, and each text's place among them.

    A text of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    words, offsets = word_hashes(texts)
    n = len(words)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled += words[k : k + len(rolled)] * (_ODD[k % 5] + np.uint64(2 * (k // 5)))
    rolled = mix(rolled)
    sets = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= width:
            sets.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            sets.append(np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes(), seed=int(b - a))], np.uint64))
        else:
            sets.append(np.empty(0, np.uint64))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.concatenate(sets) if sets else np.empty(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])
