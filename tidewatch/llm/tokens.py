"""Byte-level BPE vocabularies and the encoding of whole texts."""

from __future__ import annotations

import base64
import json
import re

import numpy as np

from .common import worker_cache

ADJACENT_SPACE = re.compile(r"\s\s")
LOOKAHEAD = r"\s+(?!\S)|"


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies: visible Latin-1 stands for itself, the rest follows from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of_json(path: str) -> dict[bytes, int]:
    """Token bytes to id from a byte-level BPE file, checked to number its tokens in merge order."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    symbols = _byte_symbols()
    ranks = {}
    for token, i in model["vocab"].items():
        if all(c in symbols for c in token):
            ranks[bytes(symbols[c] for c in token)] = i
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    for i, merge in enumerate(merges):
        left, right = merge.split(" ")
        if model["vocab"][left + right] != 256 + i:
            raise ValueError("the vocabulary's ids don't follow its merges")
    return {k: v for k, v in ranks.items() if v < 256 + len(merges)}


def ranks_of_tiktoken(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Encodes texts to ids. Where no two white-space characters are adjacent, the pattern's
    lookahead branch matches what its last branch matches, so a pattern without it serves, which is faster."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        def encoding(pat):
            return tiktoken.Encoding("corpus", pat_str=pat, mergeable_ranks=ranks, special_tokens={})

        self.exact = encoding(pattern)
        self.single_spaced = encoding(pattern.replace(LOOKAHEAD, ""))

    @classmethod
    def of(cls, path: str, pattern: str) -> Encoder:
        """The worker's encoder for this vocabulary file."""
        cache = worker_cache("encoders")
        if (path, pattern) not in cache:
            cache[path, pattern] = cls(ranks_of_json(path) if path.endswith(".json") else ranks_of_tiktoken(path), pattern)
        return cache[path, pattern]

    def encode(self, text: str) -> np.ndarray:
        encoding = self.exact if ADJACENT_SPACE.search(text) else self.single_spaced
        return np.array(encoding.encode_ordinary(text), np.uint32)
