"""Cost-balanced packing of token sequences.

Every document becomes its token ids and an end id. Stretches of a full sequence are
cut off as sequences of their own; what remains of the documents is packed, within
row blocks of some thousand documents, in descending order into the sequence of the
lowest estimated cost (linear plus quadratic in the length of each piece, as attention
is masked between pieces) that has room for it. A piece that fits nowhere is cut at
the room of the lowest-cost sequence that is not full. Every block has the fewest
sequences that hold its tokens, so padding is under one sequence a block.

Null and empty texts are the end id alone. Rows with equal ids are packed each on its
own; null ids are kept. The result does not depend on partitioning: blocks are chosen
by hash of the id and text, and ties are broken by length, id, then text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_of, dealt_sizes
from .tokens import Encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"


def sequence_plan(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(item, start in it, length, sequence, offset there) of items in descending order, packed into the fewest sequences."""
    n = max(1, -(-int(lengths.sum()) // capacity))
    free, cost, out = np.full(n, capacity), np.zeros(n), []
    for item in range(len(lengths)):
        start, left = 0, int(lengths[item])
        while left:
            room = free >= left
            if not room.any():
                room = free > 0
            s = int(np.argmin(np.where(room, cost, np.inf)))
            take = min(left, int(free[s]))
            out.append((item, start, take, s, capacity - int(free[s])))
            free[s] -= take
            cost[s] += linear * take + quadratic * take * take
            start, left = start + take, left - take
    return out


def pack(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = 1024, end_id: int = 0, linear: float = 1.0, quadratic: float = 1 / 1024, docs_per_block: int = 2000) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    n_blocks = dealt_sizes(docs, docs_per_block)[1]

    def encode(batches):
        encoder = Encoder.of(vocabulary, pattern)
        for batch in batches:
            blocks, keys, totals, crcs, tails = batch.column("block"), batch.column("doc_id"), [], [], []
            for text in batch.column("text"):
                own = np.append(encoder.encode(text.as_py() or ""), end_id).astype("<u4")
                full = len(own) // capacity * capacity
                totals.append(len(own))
                crcs.append([zlib.crc32(own[s : s + capacity]) for s in range(0, full, capacity)])
                tail = own[full:]
                tails.append((tail.astype("<u2") if tail.max(initial=0) < 65536 else tail).tobytes())
            yield pa.RecordBatch.from_arrays([blocks, keys, pa.array(totals, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary())], ["block", "doc_id", "doc_tokens", "crcs", "tail"])

    def place(table):
        rows = table.to_pylist()
        base, local, out = rows[0]["block"] << 32, 0, []
        for r in rows:
            r["left"] = r["doc_tokens"] - len(r["crcs"]) * capacity
            for i, crc in enumerate(r["crcs"]):
                out.append((r["doc_id"], i * capacity, capacity, crc, r["doc_tokens"], base + local, 0))
                local += 1
        rest = sorted((r for r in rows if r["left"]), key=lambda r: (-r["left"], r["doc_id"] is None, r["doc_id"] or 0, r["tail"]))
        for item, start, length, s, offset in sequence_plan(np.array([r["left"] for r in rest], np.int64), capacity, linear, quadratic):
            r = rest[item]
            ids = np.frombuffer(r["tail"], "<u2" if len(r["tail"]) == 2 * r["left"] else "<u4")[start : start + length].astype("<u4")
            out.append((r["doc_id"], r["doc_tokens"] - r["left"] + start, length, zlib.crc32(ids.tobytes()), r["doc_tokens"], base + local + s, offset))
        columns = list(zip(*out, strict=True)) or [[]] * 7
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"), columns, strict=True)})

    rows = docs.select(block_of(F.col("doc_id"), F.col("text").cast("string"), n_blocks).alias("block"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = rows.mapInArrow(encode, "block int, doc_id long, doc_tokens long, crcs array<long>, tail binary")
    return coded.groupBy("block").applyInArrow(place, PIECES)
