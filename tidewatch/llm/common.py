"""Shared folders, row blocks and ragged-array helpers of the corpus operators."""

from __future__ import annotations

import sys
import types

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir, written  # noqa: F401  used by the operators

#: Documents and bytes of texts of one row block, about: the unit in which Python tasks hold whole texts.
DOCS_PER_BLOCK, BYTES_PER_BLOCK = 2000, 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt_sizes(docs: DataFrame, per_block: int = DOCS_PER_BLOCK) -> tuple[int, int]:
    """The number of documents and of row blocks: a block holds about per_block documents and BYTES_PER_BLOCK bytes at most on average."""
    sizes = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col("text").cast("string"))).alias("bytes")).first()
    return max(1, sizes.n), max(1, -(-sizes.n // per_block), -(-(sizes.bytes or 0) // BYTES_PER_BLOCK))


def block_of(id_col: Column, text_col: Column, n: int) -> Column:
    """A row block by hash of the id and the text, so that null and repeated ids spread."""
    return F.pmod(F.xxhash64(id_col.cast("string"), text_col), F.lit(n)).cast("int")


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks."""
    module = sys.modules.setdefault("_tidewatch_worker_cache", types.ModuleType("_tidewatch_worker_cache"))
    return module.__dict__.setdefault(name, {})


def ragged_index(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the concatenated slices [start, start + len)."""
    ends = np.cumsum(lens)
    return np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)


def offsets_of(lens: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=out[1:])
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (shift, multiply), vectorized over uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))
