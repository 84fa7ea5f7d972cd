"""Byte-level BPE encoding and decoding by a shuffle of distinct words.

Each task cuts its documents, some megabytes at a time (a row block), into pre-tokens:
every document becomes the numbers of its words in the block's list of distinct words.
Texts are read once and never shuffled. The distinct words of each row block go to word
blocks by hash, where each distinct word of the corpus is encoded once; the ids return to
the row blocks and are put in place by the documents' word numbers. Decoding joins each
id to its bytes in the vocabulary's token table, which has a row for each id, and joins
the bytes in order.

Null and empty texts have no ids and decode to nothing. Repeated rows are encoded each on
its own; null and repeated ids stay. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_partitions, offsets_of, ragged_index, worker_cache
from .tokens import ranks_of_json, ranks_of_tiktoken

#: Words that a word block holds about, and distinct words that a document is taken to add.
WORDS_PER_BLOCK, WORDS_A_DOC = 250_000, 32
#: Bytes of texts of a row block; a longer text is a block of its own.
BYTES_PER_BLOCK = 8_000_000
DEALT = "key long, doc_ids binary, payload binary"


def ranks_at(path: str) -> dict[bytes, int]:
    cache = worker_cache("ranks")
    if path not in cache:
        cache[path] = ranks_of_json(path) if path.endswith(".json") else ranks_of_tiktoken(path)
    return cache[path]


def word_encoder(path: str, pattern: str):
    """The worker's encoder for single words."""
    import tiktoken

    cache = worker_cache("word encoders")
    if path not in cache:
        cache[path] = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks_at(path), special_tokens={})
    return cache[path]


def token_table(path: str) -> dict[int, bytes]:
    cache = worker_cache("token tables")
    if path not in cache:
        cache[path] = {i: token for token, i in ranks_at(path).items()}
    return cache[path]


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned 32-bit numbers, each by planes of bytes, compressed."""
    import zstandard

    head = struct.pack(f"<{len(arrays) + 1}I", len(arrays), *map(len, arrays))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays))


def expanded(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,) = struct.unpack_from("<I", raw)
    at, out = 4 + 4 * n, []
    for size in struct.unpack_from(f"<{n}I", raw, 4):
        planes = np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size)
        out.append(np.ascontiguousarray(planes.T).view("<u4").ravel())
        at += 4 * size
    return out


def packed_words(words: list[bytes]) -> bytes:
    import zstandard

    sizes = np.array([len(w) for w in words], np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<I", len(words)) + sizes + b"".join(words))


def unpacked_words(data: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,) = struct.unpack_from("<I", raw)
    at = 4 + 4 * n + offsets_of(np.frombuffer(raw, np.uint32, n, 4).astype(np.int64))
    return [raw[a:z] for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def plain(piece: str) -> bool:
    """Whether a piece is letters alone, of the ASCII or the older Latin ranges, on which all versions of Unicode agree."""
    return piece.isalpha() and (piece.isascii() or max(piece) < "\u0250")


def piece_words(space: str, piece: str, cut) -> list[str]:
    """The words of a piece behind a space or none: letters, letters and a mark, and lines of these are seen without the pattern."""
    if plain(piece):
        return [space + piece]
    if piece[-1] in ".,;:!?" and plain(piece[:-1]):
        return [space + piece[:-1], piece[-1]]
    line, _, more = piece.partition("\n")
    if line and more and not line[-1].isspace() and not more[0].isspace():
        return [*piece_words(space, line, cut), "\n", *piece_words("", more, cut)]
    return cut(space + piece)


def words_of(texts: list[str], pattern: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of some texts, the texts' word numbers end to end, and how many each text has.

    A text is cut before each space that a non-space follows, if no space in it comes before
    white space or at its end: no match of the pattern reaches across. Other texts are cut as a
    whole. Distinct pieces are looked at once."""
    import regex

    cut = regex.compile(pattern).findall
    pieces = [t.split(" ") for t in texts]
    rest = dict.fromkeys(chain.from_iterable(p[1:] for p in pieces))
    unsafe = {c for c in rest if not c or c[0].isspace()}
    whole = {i for i, p in enumerate(pieces) if unsafe and not unsafe.isdisjoint(p[1:])}
    if whole:
        rest = dict.fromkeys(chain.from_iterable(p[1:] for i, p in enumerate(pieces) if i not in whole))
    known: dict[str, int] = {}
    numbers, sizes = [], []
    for at, piece in enumerate(rest):
        rest[piece] = at
        own = piece_words(" ", piece, cut)
        numbers += [known.setdefault(w, len(known)) for w in own]
        sizes.append(len(own))
    word, count = np.array(numbers, np.int64), np.array(sizes, np.int64)
    starts, flat, lens = offsets_of(count)[:-1], [], []
    for i, (t, p) in enumerate(zip(texts, pieces, strict=True)):
        first = cut(t) if i in whole else piece_words("", p[0], cut) if p[0] else []
        own = np.array([known.setdefault(w, len(known)) for w in first], np.int64)
        if i not in whole and len(p) > 1:
            piece = np.fromiter(map(rest.__getitem__, p[1:]), np.int64, len(p) - 1)
            own = np.concatenate([own, word[ragged_index(starts[piece], count[piece])]])
        flat.append(own)
        lens.append(len(own))
    return list(known), np.concatenate(flat) if flat else np.zeros(0, np.int64), np.array(lens, np.int64)


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded (bytes)."""
    n_docs, n_parts = max(1, docs.count()), n_partitions(docs.sparkSession)
    n_cols = max(n_parts, -(-n_docs * WORDS_A_DOC // WORDS_PER_BLOCK))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def deal(batches):
        """Rows of two kinds: the words of a row block for a word block, and the documents of a row block (keys from n_cols on)."""
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = [0, *(np.flatnonzero(np.diff(size // BYTES_PER_BLOCK)) + 1), len(size)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a < z:
                    yield dealt(batch.slice(a, z - a), n_cols + block)
                    block += 1

    def dealt(batch, key):
        words, flat, lens = words_of([t or "" for t in batch.column("text").to_pylist()], pattern)
        raw = [w.encode() for w in words]
        column = np.fromiter((zlib.crc32(w) % n_cols for w in raw), np.int64, len(raw))
        order = np.argsort(column, kind="stable")
        used = np.flatnonzero(np.bincount(column, minlength=n_cols))
        at = np.searchsorted(column[order], np.append(used, n_cols)).tolist()
        sent = [packed_words([raw[i] for i in order[a:z].tolist()]) for a, z in zip(at[:-1], at[1:], strict=True)]
        ids = batch.column("doc_id")
        home = np.append(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), np.packbits(ids.is_valid().to_numpy(zero_copy_only=False)).astype(np.int64))
        keys, owners = [*used.tolist(), key], [struct.pack("<q", key)] * len(used) + [home.astype("<i8").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(owners, pa.binary()), pa.array([*sent, squeezed(lens, flat, column)], pa.binary())], ["key", "doc_ids", "payload"])

    def encode_words(table):
        if table.column("key")[0].as_py() >= n_cols:
            return pa.table({"key": pa.array([], pa.int64()), "column": pa.array([], pa.int64()), "ids": pa.array([], pa.binary())})
        encode = word_encoder(vocabulary, pattern)._core_bpe.encode_single_piece
        number: dict[bytes, int] = {}
        lists = []
        for data in table.column("payload"):
            words = unpacked_words(data.as_py())
            lists.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
        ids = [encode(w) for w in number]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat, at = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), offsets_of(sizes)
        out = [squeezed(sizes[own], flat[ragged_index(at[own], sizes[own])]) for own in lists]
        home = [struct.unpack("<q", x.as_py())[0] for x in table.column("doc_ids")]
        return pa.table([pa.array(home, pa.int64()), table.column("key"), pa.array(out, pa.binary())], names=["key", "column", "ids"])

    def join_back(table, answers):
        rows = table.num_rows if table.num_rows and table.column("key")[0].as_py() >= n_cols else 0
        keys, n, encoded, decoded = [], [], [], []
        bytes_of = token_table(vocabulary).__getitem__ if rows else None
        for r in range(rows):
            lens, flat, column = expanded(table.column("payload")[r].as_py())
            home = np.frombuffer(table.column("doc_ids")[r].as_py(), "<i8")
            valid = np.unpackbits(home[len(lens) :].astype(np.uint8), count=len(lens))
            order = np.argsort(column, kind="stable")
            bounds = np.searchsorted(column[order], np.arange(n_cols + 1))
            sizes, at, parts, used = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64), [], 0
            for c, data in zip(answers.column("column").to_pylist(), answers.column("ids"), strict=True):
                size, ids = expanded(data.as_py())
                own = order[bounds[c] : bounds[c + 1]]
                sizes[own], at[own] = size, used + offsets_of(size.astype(np.int64))[:-1]
                parts.append(ids)
                used += len(ids)
            ids = np.concatenate(parts) if parts else np.zeros(0, "<u4")
            ends = offsets_of(lens.astype(np.int64)).tolist()
            for a, z, k, ok in zip(ends[:-1], ends[1:], home.tolist(), valid.tolist(), strict=False):
                own = flat[a:z]
                mine = ids[ragged_index(at[own], sizes[own])]
                keys.append(k if ok else None)
                n.append(len(mine))
                encoded.append(mine.astype("<u4").tobytes())
                decoded.append(b"".join(map(bytes_of, mine.tolist())))
        return pa.table([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(encoded, pa.binary()), pa.array(decoded, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    # one shuffle serves both: word blocks and row blocks have keys of their own
    both = rows.mapInArrow(deal, DEALT).repartition(n_parts, "key")
    answers = both.groupBy("key").applyInArrow(encode_words, "key long, column long, ids binary")
    return both.groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(join_back, "doc_id long, n_tokens long, ids binary, decoded binary")
