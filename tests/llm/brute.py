"""Plain Python forms of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter

SPACE = r"[\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width=5):
    w = words(lowered(text))
    return frozenset(zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def components(docs, percent=80):
    sets = {k: shingles(t) for k, t in docs}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(sets[k]), root(k)) for k in keys}


def without_repeats(texts, length):
    """Kept bytes of each text: those that no string of the length covers that starts twice or more."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(hash(t[i : i + length]) for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[hash(t[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append(bytes(b for b, g in zip(t, gone, strict=True) if not g))
    return out


def without_repeated_lines(docs, run=3):
    """Texts by id, in order: lines with a word go if they are in a run that has occurred before."""
    seen, out = set(), {}
    for k, text in sorted(docs):
        lines = (text or "").split("\n")
        filled = [i for i, x in enumerate(lines) if words(x)]
        gone = set()
        for at in range(len(filled) - run + 1):
            key = tuple(lines[i] for i in filled[at : at + run])
            if key in seen:
                gone |= set(filled[at : at + run])
            seen.add(key)
        out[k] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out
