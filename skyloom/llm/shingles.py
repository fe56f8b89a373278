"""Hashes of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash


def shingle_hashes(text: str, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of all word shingles, repeats included; a text of fewer words is one shingle."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    width = min(shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")
