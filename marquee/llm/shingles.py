"""64-bit hashes of words and word shingles (numpy), shared by the operators on word sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_M = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on each other."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts, bounds of each text's words).

    Words are runs without space, tab to carriage return; with ``lower`` A-Z are lower-cased first; null has no word.
    """
    chunks = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    bounds = chunks.offsets.to_numpy().astype(np.int64)
    flat = chunks.flatten().dictionary_encode()
    names = flat.dictionary.to_pylist()
    if lower:
        names = [w.translate(_UPPER) for w in names]
    hashed = pd.util.hash_array(np.array(names, dtype=object), categorize=False) if names else np.zeros(0, np.uint64)
    index = flat.indices.to_numpy(zero_copy_only=False)
    bounds -= bounds[0]
    if len(names) and "" in names:  # a text that starts or ends with white space
        full = np.array([w != "" for w in names])[index]
        bounds = np.concatenate([[0], np.cumsum(full)])[bounds]
        index = index[full]
    return hashed[index] if len(index) else np.zeros(0, np.uint64), bounds


def windows(h: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window of ``size`` words, bounds of each text's windows); a shorter text with words is one window."""
    n = np.diff(bounds)
    k = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    out_bounds = np.concatenate([[0], np.cumsum(k)])
    if not len(h):
        return np.zeros(0, np.uint64), out_bounds
    acc = np.zeros(max(len(h) - size + 1, 0), np.uint64)
    for i in range(size):
        acc = acc * _M + h[i : i + len(acc)]
    acc = mix(acc)
    start = np.repeat(bounds[:-1] - out_bounds[:-1], k) + np.arange(out_bounds[-1])
    short = (n > 0) & (n < size)
    out = acc[np.minimum(start, len(acc) - 1)] if len(acc) else np.zeros(out_bounds[-1], np.uint64)
    for i in np.flatnonzero(short):
        one = np.zeros(1, np.uint64) + np.uint64(n[i])
        for w in h[bounds[i] : bounds[i + 1]]:
            one = one * _M + w
        out[out_bounds[i]] = mix(one ^ _B)[0]
    return out, out_bounds


def distinct_sorted(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each segment sorted, without repeats."""
    if not len(x):
        return x, bounds
    parts = [np.unique(x[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
