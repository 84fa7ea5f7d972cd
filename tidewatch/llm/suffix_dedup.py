"""Removal of long repeats by a logarithmic family of sparse suffix arrays.

A byte goes if a string of `length` bytes that covers it starts anywhere else too. Every
such string (window) has an anchor: the place in it whose next `gram` bytes have the
smallest hash, the first of equal ones. Equal windows have their anchors at the same
place, so suffixes need to be indexed at anchors only, about one in 140 bytes, and
neighbouring windows of one anchor are handled together as a stretch.

Documents are dealt to row blocks. A row block's anchors, ordered by the first bytes of
their suffix (`gram` of them, 128 at most) and then by a 128-bit digest of the stretch, are
its sparse suffix array. Column blocks, by hash of those first bytes, take the row blocks'
arrays batch by batch: each batch is merge-scanned against the levels that are there, which
marks long matches on both sides, and then joins them; levels hold one, two, four ...
batches, and equal ones merge. A stretch that is met again is repeated as a whole. Where
only a suffix is met again, with another stretch around it, the windows of the anchor are
looked at one by one in a second round, by suffix and digest; of stretches with copies one
stands for all, so groups of copies stay linear. The windows of a very common suffix are dealt to
several column blocks by their digests, of which equal windows have equal ones. All stretches and windows are told apart by digests of
their bytes; the rolling hash chooses anchors and nothing else.

With words=True, length and gram count words (parted by the six ASCII white-space
characters) instead of bytes: `length` words in a row that start anywhere else too go, with
the white space behind them; between words, any white space is as good as any other.

A text of more than twice `piece` bytes is indexed in pieces of about that size, each with what follows it as far as its
last window reaches, so that every window is in one piece; what is removed is put together over its pieces. A single
word is not cut.

Null and empty texts, and texts shorter than `length`, lose nothing. Rows with equal ids
or texts are rows of their own (equal long texts therefore go in full). Other columns are
carried along in `rest`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import block_of, dealt_sizes, mix64, n_partitions, offsets_of, ragged_index, worker_cache, written

BYTES_AT_ONCE = 1_000_000
#: Bytes of a piece of a long text.
PIECE = 2_000_000
#: Anchors that a column block holds about, anchors that a document is taken to have, and batches of a column block.
ANCHORS_PER_BLOCK, ANCHORS_A_DOC, BATCHES = 250_000, 32, 8
#: Bytes of a suffix that are compared, at most, and of a digest.
SUFFIX, DIGEST = 128, 16
NOTHING, REPEATED, OPEN, STANDS = 0, 1, 2, 3
#: Windows of one suffix that stay together, about; those of a more common one are dealt in parts by digest.
WINDOWS_TOGETHER = 16_384

#: Parts a suffix's windows are dealt in are numbered in steps of this.
PART = np.uint64(0x9E3779B97F4A7C15)

_rng = np.random.default_rng(20240131)
BYTE_CODE = _rng.integers(0, 2**64, 256, np.uint64)
BASE = np.uint64(int(_rng.integers(0, 2**62)) * 2 + 1)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LATER_WORD = re.compile(rb"(?<=[\x20\x09-\x0D])[^\x20\x09-\x0D]")


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers of base; a worker keeps those that ordinary buffers need."""
    kept = worker_cache("powers")
    if len(kept.get(int(base), ())) < n:
        out = np.full(max(n, 2 * BYTES_AT_ONCE), base, np.uint64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if n > 2 * BYTES_AT_ONCE:
            return out
        kept[int(base)] = out
    return kept[int(base)][:n]


def squeezed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def expanded(data: pa.Scalar) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data.as_py())


class Family:
    """Levels of suffix arrays (keys in order, numbers); level i holds about 2^i batches.

    A key is a suffix of `width` bytes and the digest of its stretch. Entries are numbered as they come."""

    def __init__(self, width: int):
        self.width, self.levels = width, []
        self.repeated, self.opened, self.copies = (np.zeros(0, bool) for _ in range(3))

    def suffixes(self, keys: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(keys.view(np.uint8).reshape(len(keys), -1)[:, : self.width]).view(f"S{self.width}").ravel()

    def merged(self, *runs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Runs as one, in order; of equal keys those of earlier runs come first."""
        keys, numbers = (np.concatenate(x) for x in zip(*runs, strict=True))
        order = np.argsort(keys, kind="stable")
        return keys[order], numbers[order]

    def scan(self, level: tuple, batch: tuple) -> None:
        """Marks the matches between a level and a batch, on both sides: neighbours in the order of both with equal keys, and with equal suffixes but other stretches."""
        keys, numbers = self.merged(level, batch)
        if not len(keys):
            return
        suffixes = self.suffixes(keys)
        new_key, new_suffix = (np.concatenate([[True], x[1:] != x[:-1]]) for x in (keys, suffixes))
        stretch, suffix = np.cumsum(new_key) - 1, np.cumsum(new_suffix) - 1
        twice = (np.bincount(stretch) > 1)[stretch]
        self.repeated[numbers[twice]] = True
        self.copies[numbers[~new_key]] = True
        self.opened[numbers[(np.bincount(suffix, new_key) > 1)[suffix]]] = True

    def add(self, keys: np.ndarray, repeated: np.ndarray) -> None:
        """Takes a batch of keys, some of which are known to be repeated."""
        numbers = np.arange(len(self.repeated), len(self.repeated) + len(keys))
        self.repeated = np.concatenate([self.repeated, repeated])
        self.opened, self.copies = (np.concatenate([x, np.zeros(len(keys), bool)]) for x in (self.opened, self.copies))
        none = keys[:0], numbers[:0]
        run = self.merged((keys, numbers))
        for level in (none, *(x for x in self.levels if x is not None)):
            self.scan(level, run)
        # the first of equal stretches stays for all
        stays = ~self.copies[run[1]]
        run = run[0][stays], run[1][stays]
        for i, level in enumerate(self.levels):
            if level is None:
                self.levels[i] = run
                return
            run, self.levels[i] = self.merged(level, run), None
        self.levels.append(run)

    def found(self) -> np.ndarray:
        """What has become of each entry."""
        return np.where(self.copies, REPEATED, np.where(self.repeated, np.where(self.opened, STANDS, REPEATED), np.where(self.opened, OPEN, NOTHING))).astype(np.uint8)


class Buffer:
    """Some texts end to end, as symbols: here bytes. Or one piece of a long text, that starts `at` there; with `more` another one follows."""

    def __init__(self, texts: list[bytes], length: int, gram: int, at: int = 0, more: bool = False):
        self.texts, self.length, self.gram, self.at, self.more = texts, length, gram, at, more
        self.raw = b"".join(texts)
        self.ends = offsets_of(np.array([len(t) for t in texts], np.int64))
        self.codes = BYTE_CODE[np.frombuffer(self.raw, np.uint8)]

    @staticmethod
    def pieces(text: bytes, length: int, size: int) -> Iterator[tuple[int, bytes, bool]]:
        """The pieces of a long text, with their place and whether more follow: each has `size` windows, the last one the rest."""
        at = 0
        while len(text) - at >= size + length:
            yield at, text[at : at + size + length - 1], True
            at += size
        yield at, text[at:], False

    def bytes_of(self, i: int, spans: np.ndarray) -> list:
        """Spans (start, stop) of text i, in bytes of it."""
        return spans.tolist()

    def cut(self, start: np.ndarray, stop: np.ndarray) -> list[bytes]:
        """The bytes of the symbols from start to stop, one or more."""
        raw = self.raw
        return [raw[a:z] for a, z in zip(start.tolist(), stop.tolist(), strict=True)]

    def anchors(self):
        """(first window, last window, anchor) of each anchor, in order."""
        windows = ragged_index(self.ends[:-1], np.maximum(np.diff(self.ends) - self.length + 1, 0))
        if not len(windows):
            return (np.zeros(0, np.int64),) * 3
        n = len(self.codes)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.codes * powers(BASE, n), out=sums[1:])
        grams = mix64((sums[self.gram :] - sums[: -self.gram]) * powers(INVERSE, n + 1 - self.gram))
        least = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
        span, width = self.length - self.gram + 1, 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        anchor = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(first[1:], len(anchor)) - 1
        return windows[first], windows[last], anchor[first]

    def indexed(self, width: int):
        """The anchors' windows, with the keys of their suffix and stretch and a hash of the suffix."""
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        first, last, anchor = self.anchors()
        suffixes = [x[:width].ljust(width, b"\0") for x in self.cut(anchor, anchor + self.gram)]
        keys = np.frombuffer(b"".join(x + xxh3_128_digest(y) for x, y in zip(suffixes, self.cut(first, last + self.length), strict=True)), f"S{width + DIGEST}")
        return first, last, keys, np.fromiter(map(xxh3_64_intdigest, suffixes), np.uint64, len(suffixes))

    def prints(self, start: np.ndarray) -> np.ndarray:
        """Digests of the windows that start there."""
        from xxhash import xxh3_64_intdigest

        return np.fromiter(map(xxh3_64_intdigest, self.cut(start, start + self.length)), np.uint64, len(start))


class Words(Buffer):
    """The same over the words of the texts, as if one space parted them."""

    def __init__(self, texts: list[bytes], length: int, gram: int, at: int = 0, more: bool = False):
        from xxhash import xxh3_64_intdigest

        self.texts, self.length, self.gram, self.at, self.more = texts, length, gram, at, more
        self.begins = offsets_of(np.array([len(t) + 1 for t in texts], np.int64))
        joined = b" ".join(texts)
        edge = np.diff(np.concatenate([[True], SPACE[np.frombuffer(joined, np.uint8)], [True]]).astype(np.int8))
        self.first, self.last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        words = joined.split()
        self.raw, self.starts = b" ".join(words), offsets_of(self.last - self.first + 1)
        distinct = dict.fromkeys(words)
        hashes = np.fromiter(map(xxh3_64_intdigest, distinct), np.uint64, len(distinct))
        for i, w in enumerate(distinct):
            distinct[w] = i
        self.codes = hashes[np.fromiter(map(distinct.__getitem__, words), np.int64, len(words))]
        self.ends = np.searchsorted(self.first, self.begins)

    @staticmethod
    def pieces(text: bytes, length: int, size: int) -> Iterator[tuple[int, bytes, bool]]:
        """Pieces that start with a word and end where one starts: the words from `size` bytes on start the next piece, the first length - 1 of them end this one too."""
        at = 0
        while True:
            words = LATER_WORD.finditer(text, at + size)
            ahead = list(islice(words, length))
            if len(ahead) < length:
                break
            yield at, text[at : ahead[-1].start()], True
            at = ahead[0].start()
        yield at, text[at:], False

    def bytes_of(self, i: int, spans: np.ndarray) -> list:
        start, stop = (spans + self.ends[i]).T
        after = np.append(self.first, 0)[stop]
        # a piece ends where the next word starts
        end = self.begins[i] + len(self.texts[i]) if self.more else self.last[stop - 1]
        return (np.stack([self.first[start], np.where(stop < self.ends[i + 1], after, end)], 1) - self.begins[i]).tolist()

    def cut(self, start: np.ndarray, stop: np.ndarray) -> list[bytes]:
        return super().cut(self.starts[start], self.starts[stop] - 1)


def _buffers(texts: Iterable[bytes], length: int, gram: int, kind: type[Buffer], piece: int) -> Iterator[Buffer]:
    """Buffers of about a million bytes, or of a piece of a text where that is longer."""
    held: list[bytes] = []
    size = 0
    for t in texts:
        if len(t) <= 2 * piece:
            held.append(t)
            size += len(t)
        if held and (size >= BYTES_AT_ONCE or len(t) > 2 * piece):
            yield kind(held, length, gram)
            held, size = [], 0
        if len(t) > 2 * piece:
            for at, part, more in kind.pieces(t, length, piece):
                yield kind([part], length, gram, at, more)
    if held:
        yield kind(held, length, gram)


class Block:
    """The suffix array of a row block: its distinct keys in order, how they are dealt to columns, and where each anchor has its key."""

    def __init__(self, texts: Iterable[bytes], length: int, gram: int, width: int, n_cols: int, kind: type[Buffer], piece: int):
        # only what later steps need is kept of a buffer
        self.buffers = []
        keys, self.hashes = [np.zeros(0, f"S{width + DIGEST}")], []
        for b in _buffers(texts, length, gram, kind, piece):
            first, last, own, hashes = b.indexed(width)
            b.codes = None
            self.buffers.append((b, first, last, hashes))
            keys.append(own)
        self.keys, self.at, self.which, counts = np.unique(np.concatenate(keys), return_index=True, return_inverse=True, return_counts=True)
        self.twice = counts > 1
        hashes = np.concatenate([np.zeros(0, np.uint64), *(x[3] for x in self.buffers)])[self.at]
        self.order, self.cuts = by_column(hashes, n_cols)

    def judged(self, found: np.ndarray):
        """Each buffer with its anchors' windows, suffix hashes and what was found of them: of equal stretches the first stands. Also the bits of digests by which a suffix's windows are dealt in parts."""
        state, bits = found[self.which] & 3, found[self.which] >> 2
        first = np.zeros(len(state), bool)
        first[self.at] = True
        state[~first] = np.where(state[~first] == NOTHING, NOTHING, REPEATED)
        at = 0
        for b, start, last, hashes in self.buffers:
            yield b, start, last, hashes, state[at : at + len(start)], bits[at : at + len(start)]
            at += len(start)

    def answered(self, answers) -> np.ndarray:
        found = np.zeros(len(self.keys), np.uint8)
        for c, data in answers:
            found[self.order[self.cuts[c] : self.cuts[c + 1]]] = np.frombuffer(data, np.uint8)
        return found


def by_column(hashes: np.ndarray, n: int):
    """Places by column, otherwise in order, and the columns' bounds."""
    column = (mix64(hashes) % np.uint64(n)).astype(np.int64)
    order = np.argsort(column, kind="stable")
    return order, np.searchsorted(column[order], np.arange(n + 1))


def open_windows(parts):
    """Suffix hashes (with the number of the part, where a suffix has several), starts and digests of all windows of open and standing anchors, buffer by buffer."""
    for b, first, last, hashes, found, bits in parts:
        pick = found >= OPEN
        n = (last - first + 1)[pick]
        start = ragged_index(first[pick], n)
        prints = b.prints(start)
        part = prints & ((np.uint64(1) << np.repeat(bits[pick], n).astype(np.uint64)) - np.uint64(1))
        yield np.repeat(hashes[pick], n) + part * PART, start, prints


def with_bits(suffixes: np.ndarray, found: np.ndarray, together: int) -> np.ndarray:
    """What was found of each entry, and above it the bits by which the windows of its suffix are dealt in parts: as many that `together` open anchors or so have one part."""
    pick = found >= OPEN
    _, which, counts = np.unique(suffixes[pick], return_inverse=True, return_counts=True)
    out = found.copy()
    out[pick] |= np.ceil(np.log2(np.maximum(1, counts / together))).astype(np.uint8)[which] << 2
    return out


def joined_spans(spans: list, more: list) -> list:
    """Spans in order of their starts, and more of them; those that meet are one."""
    out = list(spans)
    for start, stop in more:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


class Windows:
    """The distinct windows of a row block, by suffix hash and digest, and how they are dealt to columns."""

    def __init__(self, parts: list, n_cols: int):
        empty = np.zeros(0, np.uint64)
        groups, prints = (np.concatenate([empty, *x]) for x in ((p[i] for p in parts) for i in (0, 2)))
        order = np.lexsort((prints, groups))
        groups, prints = groups[order], prints[order]
        new = np.concatenate([np.ones(min(1, len(groups)), bool), (groups[1:] != groups[:-1]) | (prints[1:] != prints[:-1])])
        at = np.cumsum(new) - 1
        self.which = np.zeros(len(order), np.int64)
        self.which[order] = at
        self.groups, self.prints, self.twice = groups[new], prints[new], np.bincount(at, minlength=int(new.sum())) > 1
        self.order, self.cuts = by_column(self.groups, n_cols)


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 128, words: bool = False, piece: int = PIECE, together: int = WINDOWS_TOGETHER) -> DataFrame:
    """doc_id, n_bytes, kept (the bytes that stay), spans (removed, in bytes), and the other columns in rest."""
    kind = Words if words else Buffer
    n_docs, n_rows = dealt_sizes(docs)
    n_parts = n_partitions(docs.sparkSession)
    n_cols = max(n_parts, -(-n_docs * ANCHORS_A_DOC // ANCHORS_PER_BLOCK))
    width = SUFFIX if words else min(gram, SUFFIX)
    # an anchor has about half as many windows as there are places for it in one
    anchors_together = max(1, 2 * together // (length - gram + 1))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    text = F.col("text").cast("string")
    own = [block_of(F.col("doc_id"), text, n_rows).alias("block"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")]
    blocks = docs.select(*own, *([F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest")] if others else [])).repartition(n_parts, "block")

    def block_in(table) -> Block:
        return Block(((t.as_py() or "").encode() for t in table.column("text")), length, gram, width, n_cols, kind, piece)

    def binary_table(rows: list, names: list[str], n_ints: int = 2):
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.table([pa.array(c, pa.int32() if i < n_ints else pa.binary()) for i, c in enumerate(columns)], names=names)

    def deal(table):
        b, block, rows = block_in(table), table.column("block")[0].as_py(), []
        for c in np.flatnonzero(np.diff(b.cuts)):
            pick = b.order[b.cuts[c] : b.cuts[c + 1]]
            rows.append((int(c), block, squeezed(b.keys[pick].tobytes()), np.packbits(b.twice[pick]).tobytes()))
        return binary_table(rows, ["column", "block", "keys", "twice"])

    def index(table):
        order = np.argsort(np.asarray(table.column("block")), kind="stable").tolist()
        keys = [np.frombuffer(expanded(table.column("keys")[i]), f"S{width + DIGEST}") for i in order]
        twice = [np.unpackbits(np.frombuffer(table.column("twice")[i].as_py(), np.uint8), count=len(k)).astype(bool) for i, k in zip(order, keys, strict=True)]
        ends = offsets_of(np.array([len(k) for k in keys], np.int64))
        # neighbouring row blocks are a batch together
        batch = ends[:-1] // max(1, -(-int(ends[-1]) // BATCHES))
        cuts = [0, *(np.flatnonzero(np.diff(batch)) + 1).tolist(), len(keys)]
        family = Family(width)
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            family.add(np.concatenate(keys[a:z]), np.concatenate(twice[a:z]))
        found = family.found()
        if (found >= OPEN).any():
            found = with_bits(family.suffixes(np.concatenate(keys)), found, anchors_together)
        parts = [found[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table([table.column("block").take(pa.array(order)), table.column("column").take(pa.array(order)), pa.array(parts, pa.binary())], names=["block", "column", "found"])

    def deal_windows(table, answers):
        if not len(answers) or not len(table):
            return binary_table([], ["column", "block", "groups", "prints", "twice"])
        b, block, rows = block_in(table), answers.column("block")[0].as_py(), []
        found = b.answered(zip(answers.column("column").to_pylist(), answers.column("found").to_pylist(), strict=True))
        w = Windows(list(open_windows(b.judged(found))), n_cols)
        for c in np.flatnonzero(np.diff(w.cuts)):
            pick = w.order[w.cuts[c] : w.cuts[c + 1]]
            groups, counts = np.unique(w.groups[pick], return_counts=True)
            rows.append((int(c), block, groups.tobytes() + counts.astype(np.uint64).tobytes(), w.prints[pick].tobytes(), np.packbits(w.twice[pick]).tobytes()))
        return binary_table(rows, ["column", "block", "groups", "prints", "twice"])

    def spread(data: bytes) -> np.ndarray:
        groups, counts = np.frombuffer(data, np.uint64).reshape(2, -1)
        return np.repeat(groups, counts.astype(np.int64))

    def count_windows(table):
        prints = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("prints")]
        groups = [spread(x.as_py()) for x in table.column("groups")]
        twice = np.concatenate([np.unpackbits(np.frombuffer(t.as_py(), np.uint8), count=len(p)) for t, p in zip(table.column("twice"), prints, strict=True)])
        group, flat = np.concatenate(groups), np.concatenate(prints)
        order = np.lexsort((flat, group))
        group, flat = group[order], flat[order]
        which = np.cumsum(np.concatenate([[True], (group[1:] != group[:-1]) | (flat[1:] != flat[:-1])])) - 1
        repeated = np.zeros(len(order), bool)
        repeated[order] = ((np.bincount(which) > 1) | (np.bincount(which, twice[order]) > 0))[which]
        ends = np.cumsum([len(p) for p in prints])
        found = [np.packbits(repeated[e - len(p) : e]).tobytes() for e, p in zip(ends, prints, strict=True)]
        return pa.table([table.column("block"), table.column("column"), pa.array(found, pa.binary()), pa.array([1] * len(found), pa.int32())], names=["block", "column", "found", "round"])

    def cut(table, answers):
        rounds: tuple[list, list] = ([], [])
        for r, c, data in zip(*(answers.column(n).to_pylist() for n in ("round", "column", "found")), strict=True):
            rounds[r].append((c, data))
        block = block_in(table)
        parts = list(block.judged(block.answered(rounds[0])))
        opened = list(open_windows(parts))
        w = Windows(opened, n_cols)
        repeated = np.zeros(len(w.prints), bool)
        for c, data in rounds[1]:
            repeated[w.order[w.cuts[c] : w.cuts[c + 1]]] = np.unpackbits(np.frombuffer(data, np.uint8), count=w.cuts[c + 1] - w.cuts[c]).astype(bool)
        sizes, kept, spans, at = [], [], [], 0
        before: list = []
        for (b, first, last, _, found, _), (_, start, _) in zip(parts, opened, strict=True):
            n = int(b.ends[-1])
            starts = np.zeros(n + 1, np.int32)
            whole = (found == REPEATED) | (found == STANDS)
            starts[ragged_index(first[whole], (last - first + 1)[whole])] = 1
            starts[start[repeated[w.which[at : at + len(start)]]]] = 1
            at += len(start)
            sums = np.cumsum(starts)[:-1]
            sums[length:] -= sums[:-length].copy() if len(sums) > length else sums[:0]
            covered = sums > 0
            for i, (text, a, z) in enumerate(zip(b.texts, b.ends[:-1], b.ends[1:], strict=True)):
                edge = np.flatnonzero(np.diff(np.concatenate([[False], covered[a:z], [False]]).astype(np.int8)))
                gone = b.bytes_of(i, edge.reshape(-1, 2))
                if b.at or b.more:
                    # pieces overlap, so what one removes can go on in the next
                    before = joined_spans(before, [(s + b.at, e + b.at) for s, e in gone])
                    if b.more:
                        continue
                    text, gone, before = table.column("text")[len(sizes)].as_py().encode(), before, []
                sizes.append(len(text))
                kept.append(b"".join(text[e:s] for e, s in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(text)], strict=True)))
                spans.append([{"start": s, "stop": e} for s, e in gone])
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        out = [table.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, span)]
        return pa.table([*out, *([table.column("rest")] if others else [])], names=["doc_id", "n_bytes", "kept", "spans", *(["rest"] if others else [])])

    answers = "block int, column int, found binary"
    anchors = written(blocks.groupBy("block").applyInArrow(deal, "column int, block int, keys binary, twice binary").groupBy("column").applyInArrow(index, answers), "anchors")
    windows = blocks.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(deal_windows, "column int, block int, groups binary, prints binary, twice binary")
    counted = windows.groupBy("column").applyInArrow(count_windows, f"{answers}, round int")
    both = anchors.withColumn("round", F.lit(0)).unionByName(counted)
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])))]
        + ([blocks.schema["rest"]] if others else [])
    )
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(cut, schema)
