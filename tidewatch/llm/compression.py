"""Quality rules: base word rules and compression bands.

zstandard ratios (bytes before / after) of whole texts and of their fixed chunks are
held against limits for their length. The limits are one fixed function of the length: the ratio that
prose of that length has, taken from a table by half octaves and straight lines between them, times
the ends of a band. Repetitive text lies above, incompressible text below. Chunks are of one length
and have the limits of that length, with a band of their own. Every text is judged alone, so its verdict is the same
in any table.

Null and empty texts have no words and fail the base rules. Repeated ids stay, other columns are
ignored; only the columns named below are returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ratios of prose in four European languages at level 3, at the middle of half octaves of length in bytes, the first from 64 to 90: measured medians from 256 bytes on, carried on below.
PROSE_FROM, PROSE = 12, (1.32, 1.38, 1.44, 1.50, 1.56, 1.60, 1.69, 1.82, 1.94, 2.00, 2.07, 2.13, 2.19, 2.23, 2.27, 2.32, 2.40)

RULES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, ratio_min double, ratio_max double, chunk_low double, chunk_high double"


def prose_ratio(n_bytes: int) -> float:
    """The ratio of prose of a length: straight lines over the logarithm of the length between the table's values, level at its ends."""
    at = min(max(2 * math.log2(max(n_bytes, 1)) - 0.5 - PROSE_FROM, 0.0), len(PROSE) - 1.0)
    k = min(int(at), len(PROSE) - 2)
    return PROSE[k] + (PROSE[k + 1] - PROSE[k]) * (at - k)


def base_counts(text: str, symbols: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text; bytes.split() parts exactly at the six ASCII white-space characters."""
    raw = text.encode()
    words = raw.split()
    n_space = len(raw) - sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) >= 4:
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
        pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
        _, which, counts = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
        twice, inside = counts[which] > 1, np.zeros(len(words), bool)
        for k in range(3):
            inside[k : k + len(twice)] |= twice
        repeated = int(inside.sum())
    return len(words), len(text) - n_space, sum(raw.count(c) for c in symbols), len(lines) - len(set(lines)), repeated


def chunk_starts(n: int, chunk_bytes: int) -> list[int]:
    """Starts of chunks of one length that cover all n bytes, the last one overlapping where it must; none in shorter texts."""
    starts = list(range(0, n - chunk_bytes + 1, chunk_bytes))
    return [*starts, n - chunk_bytes] if starts and n % chunk_bytes else starts


def quality_rules(
    docs: DataFrame,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    symbols: str = "#*$%&|<>",
    level: int = 3,
    chunk_bytes: int = 4096,
    band: tuple[float, float] = (0.8, 1.12),
    chunk_band: tuple[float, float] = (0.8, 1.07),
) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, the text's ratio with its limits, and the least and the largest ratio of its chunks."""

    def judge(batches):
        import zstandard

        compressor, marks, usual = zstandard.ZstdCompressor(level=level), symbols.encode(), prose_ratio(chunk_bytes)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                raw, counts = text.encode(), base_counts(text, marks)
                failed = counts[0] < min_words or 100 * counts[4] > max_repeat_percent * counts[0]
                ratio = len(raw) / len(compressor.compress(raw)) if raw else None
                least, most = (k * prose_ratio(len(raw)) for k in band)
                chunks = [chunk_bytes / len(compressor.compress(raw[i : i + chunk_bytes])) for i in chunk_starts(len(raw), chunk_bytes)]
                low, high = min(chunks, default=None), max(chunks, default=None)
                kept = not failed and least <= ratio <= most and (not chunks or (low >= chunk_band[0] * usual and high <= chunk_band[1] * usual))
                rows.append((key, *counts, failed, kept, ratio, least, most, low, high))
            fields = [x.split() for x in RULES.split(", ")]
            columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
            kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(judge, RULES)
