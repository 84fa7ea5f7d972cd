"""Hashes of word shingles of whole texts, vectorized over many texts."""

from __future__ import annotations

from itertools import chain

import numpy as np

from .common import mix64, offsets_of

BYTES_AT_ONCE = 1_000_000
_rng = np.random.default_rng(20240131)
STEP = _rng.integers(0, 2**63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(words: list[list[bytes]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of all shingles of texts that come as lists of words; each distinct word is hashed once, from its bytes."""
    from xxhash import xxh3_64_intdigest

    distinct = dict.fromkeys(chain.from_iterable(words))
    if not distinct:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    for i, w in enumerate(distinct):
        distinct[w] = i
    n = np.fromiter(map(len, words), np.int64, len(words))
    codes = codes[np.fromiter(map(distinct.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))]
    start = offsets_of(n)[:-1]
    size = np.minimum(n, width)
    owners = np.repeat(np.arange(len(n)), np.where(n > 0, n - size + 1, 0))
    at = np.arange(len(owners)) - np.searchsorted(owners, np.arange(len(n)))[owners] + start[owners]
    total = np.zeros(len(owners), np.uint64)
    for k in range(width):
        inside = k < size[owners]
        total[inside] += codes[at[inside] + k] * STEP[k]
    return owners, mix64(total ^ size[owners].astype(np.uint64))


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its shingles: words parted by the six ASCII white-space
    characters (which are what bytes.split() parts at), A-Z in lower case, `width` in a row, or all of them where there are fewer."""
    out: list[np.ndarray] = []
    pending: list[list[bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        raw = (text or "").encode().lower()
        pending.append(raw.split())
        size += len(raw) + 1
        if size >= BYTES_AT_ONCE or i == len(texts) - 1:
            owners, hashes = _hashes(pending, width)
            cuts = np.searchsorted(owners, np.arange(len(pending) + 1))
            out += [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            pending, size = [], 0
    return out
