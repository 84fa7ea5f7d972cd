"""N-gram Jaccard join as a blocked product of the document by shingle incidence matrix.

Documents are dealt to row blocks, shingle hashes to column blocks. A first pass sends
the distinct hashes of each row block to the column blocks, which return in how many
documents each is found. A set whose shared shingles are fewer than the size bound of
its own size (80 % of it) has no partner. Equal sets are one row of the matrix.

The product of the matrix with its transpose is taken where the bounds leave room for a
link. Two sets with enough overlap share one of the first n - ceil(0.8 n) + 1 of their
shingles, rarest first, at places that leave room for the overlap their sizes ask for:
these columns give the pairs of rows that are multiplied. Each pair's rows are
multiplied column block by column block; the overlap counts of the blocks are
accumulated, and pairs whose sum is below the bound of their sizes are discarded.

First each set is multiplied with one pivot of each column, the set that has the
column's shingle earliest in its order. Sets that already are in one component need no
further product; in columns that hold several components, sets of the sizes that can
link are then multiplied with each other. So every link between different sets either is
computed or lies within a component, and exact copies and star-shaped groups of near
copies stay linear.

Null and empty texts have no shingles and are alone. Repeated rows return a row each;
rows of one id with different texts are documents of their own. Rows whose id is null
take no part in links: they get the component of documents with an equal set, if there
are any with an id, else null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import block_of, dealt_sizes, mix64, n_partitions, offsets_of, written
from .components import components
from .shingles import shingle_sets

#: Hashes that a column block holds about; shingles that a document is taken to have.
HASHES_PER_BLOCK, SHINGLES_A_DOC = 2_000_000, 512
#: Column blocks of the product, by the leading bits of a hash.
PRODUCT_BITS = 2
#: Sizes whose ratio is below this are in one band.
BAND = 1.02
SETS = "doc_id long, block int, n_shingles long, set_key string, prefix array<long>, place array<int>, members array<binary>"


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending integers as compressed planes of their differences' bytes."""
    import zstandard

    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def overlap_needed(n: Column, m: Column, percent: int) -> Column:
    """The least intersection with which percent * union <= 100 * intersection."""
    return F.ceil((percent * (n + m)) / F.lit(100 + percent))


def incidence(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """One row a document: the size and key of its shingle set and, if it can have partners, its prefix and members."""
    n_docs, n_rows = dealt_sizes(docs)
    n_cols = -(-n_docs * SHINGLES_A_DOC // HASHES_PER_BLOCK)
    shift = np.uint64(64 - min(64, math.ceil(math.log2(n_docs * SHINGLES_A_DOC)) + 13))
    text = F.col("text").cast("string")
    blocks = docs.select(block_of(F.col("doc_id"), text, n_rows).alias("block"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).repartition(n_partitions(docs.sparkSession), "block")

    def column_of(short: np.ndarray) -> np.ndarray:
        return (mix64(short) % np.uint64(n_cols)).astype(np.int64)

    def found_in(sets: list[np.ndarray]):
        """The distinct short hashes of a row block, by column block, with the number of its documents that hold them."""
        flat = np.concatenate(sets) >> shift if sets else np.zeros(0, np.uint64)
        short, which, counts = np.unique(flat, return_inverse=True, return_counts=True)
        column = column_of(short)
        order = np.argsort(column, kind="stable")
        cuts = np.searchsorted(column[order], np.arange(n_cols + 1))
        return short, which, counts, order, cuts

    def deal(table):
        short, _, counts, order, cuts = found_in(shingle_sets(table.column("text").to_pylist(), width))
        block, rows = table.column("block")[0].as_py(), []
        for c in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[c] : cuts[c + 1]]
            rows.append((int(c), block, pack_sorted(short[own]), np.minimum(counts[own], 255).astype(np.uint8).tobytes()))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["column", "block", "hashes", "counts"])

    def count(table):
        hashes = [unpack_sorted(x) for x in table.column("hashes").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("counts").to_pylist()])
        _, which = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.minimum(np.bincount(which, counts), 255).astype(np.uint8)[which]
        ends = np.cumsum([len(h) for h in hashes])
        parts = [total[e - len(h) : e].tobytes() for h, e in zip(hashes, ends, strict=True)]
        return pa.table([table.column("block"), table.column("column"), pa.array(parts, pa.binary())], names=["block", "column", "found"])

    def index(table, answers):
        texts = table.column("text").to_pylist()
        sets = shingle_sets(texts, width)
        short, which, _, order, cuts = found_in(sets)
        found = np.zeros(len(short), np.uint8)
        for c, data in zip(answers.column("column").to_pylist(), answers.column("found").to_pylist(), strict=True):
            found[order[cuts[c] : cuts[c + 1]]] = np.frombuffer(data, np.uint8)
        everywhere, rows, at, block = found[which], [], 0, table.column("block")[0].as_py() if table.num_rows else None
        for doc_id, own in zip(table.column("doc_id").to_pylist(), sets, strict=True):
            seen, at, n = everywhere[at : at + len(own)], at + len(own), len(own)
            key = hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest() if n else None
            least = -(-percent * n // 100)
            if n and int((seen > 1).sum()) >= least:
                rank = np.lexsort((own, seen))[: n - least + 1]
                place = np.flatnonzero(seen[rank] > 1)
                shared = own[seen > 1]
                cuts = np.searchsorted(shared, np.arange(1, 1 << PRODUCT_BITS, dtype=np.uint64) << np.uint64(64 - PRODUCT_BITS))
                rows.append((doc_id, block, n, key, own[rank[place]].view(np.int64), place.astype(np.int32), [x.tobytes() for x in np.split(shared, cuts)]))
            else:
                rows.append((doc_id, block, n, key, None, None, None))
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        types = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()))
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "block", "n_shingles", "set_key", "prefix", "place", "members"])

    answers = blocks.groupBy("block").applyInArrow(deal, "column int, block int, hashes binary, counts binary").groupBy("column").applyInArrow(count, "block int, column int, found binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(index, SETS)


def overlap_counts(x: pa.Array, y: pa.Array) -> np.ndarray:
    """The product of each row of a tile x with the row of y beside it: both are CSR rows of ascending hashes within a column block."""
    lens = [np.fromiter((len(v) // 8 for v in side.to_pylist()), np.int64, len(side)) for side in (x, y)]
    flat = [np.frombuffer(b"".join(side.to_pylist()), np.uint64) for side in (x, y)]
    columns, at = np.unique(np.concatenate(flat), return_inverse=True)
    keys = [np.repeat(np.arange(len(n)), n) * len(columns) + own for n, own in zip(lens, np.split(at, [len(flat[0])]), strict=True)]
    place = np.searchsorted(keys[1], keys[0])
    both = np.zeros(len(keys[0]), bool)
    inside = place < len(keys[1])
    both[inside] = keys[1][place[inside]] == keys[0][inside]
    sums = offsets_of(both.astype(np.int64))
    ends = offsets_of(lens[0])
    return sums[ends[1:]] - sums[ends[:-1]]


def linked(pairs: DataFrame, slices: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose rows overlap enough. The rows' parts in a column block meet pair by pair,
    are multiplied tile by tile, and the counts are added up and held against the bound of both sizes."""

    def multiply(batches):
        for batch in batches:
            counts = overlap_counts(batch.column("x"), batch.column("y"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "n", "m")), pa.array(counts, pa.int64())], ["a", "b", "n", "m", "both"])

    left = slices.select(F.col("row").alias("a"), "part", F.col("hashes").alias("x"), F.col("n_shingles").alias("n"))
    right = slices.select(F.col("row").alias("b"), "part", F.col("hashes").alias("y"), F.col("n_shingles").alias("m"))
    tiles = pairs.join(left, "a").join(right, ["b", "part"]).select("a", "b", "n", "m", "x", "y")
    counts = tiles.mapInArrow(multiply, "a string, b string, n long, m long, both long").groupBy("a", "b", "n", "m").agg(F.sum("both").alias("both"))
    return counts.filter(F.col("both") >= overlap_needed(F.col("n"), F.col("m"), percent)).select("a", "b")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id reachable by links of at least percent / 100 likeness."""
    sets = written(incidence(docs, width, percent), "incidence")
    keyed = sets.filter("n_shingles > 0 and doc_id is not null")
    # a row of the matrix is a distinct set; all rows of a set are equal, so any of its blocks' first ones serves
    nth = F.row_number().over(Window.partitionBy("block", "set_key").orderBy("doc_id"))
    firsts = keyed.filter("prefix is not null").withColumn("nth", nth).filter("nth = 1").select("set_key", "block", "doc_id")
    rows = firsts.groupBy("set_key").agg(F.min(F.struct("block", "doc_id")).alias("of")).select(F.col("set_key").alias("row"), "of.*")
    matrix = sets.filter("prefix is not null").withColumnRenamed("set_key", "row").join(rows, ["row", "block", "doc_id"]).dropDuplicates(["row"])
    matrix = written(matrix.select("row", "n_shingles", "prefix", "place", "members"), "matrix")
    slices = matrix.select("row", "n_shingles", F.posexplode("members").alias("part", "hashes")).filter(F.octet_length("hashes") > 0)

    entries = matrix.select("row", F.col("n_shingles").alias("n"), F.explode(F.arrays_zip("prefix", "place")).alias("e")).select(F.col("e.prefix").alias("hash"), "row", "n", F.col("e.place").alias("place"))
    columns = entries.groupBy("hash").agg(F.min(F.struct("place", "row", "n")).alias("pivot"), F.count("*").alias("size")).filter("size > 1").select("hash", "pivot")

    def can_link(n: Column, place: Column, m: Column, other: Column) -> Column:
        return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least(n - place, m - other) >= overlap_needed(n, m, percent))

    p = F.col("pivot")
    near = entries.join(columns, "hash").filter(F.col("row") != p["row"]).filter(can_link(F.col("n"), F.col("place"), p["n"], p["place"]))
    pairs = written(near.select(F.least("row", p["row"]).alias("a"), F.greatest("row", p["row"]).alias("b")).distinct(), "pairs")
    links = written(linked(pairs, slices, percent), "links")

    # columns that still hold several components: each set meets those of the columns' other sets that are no larger and of a
    # size that its own size and place leave room for; sizes are a part of the join key, so that no other pairs are formed
    labels = components(links)
    known = entries.join(labels.select(F.col("node").alias("row"), "component"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    mixed = known.groupBy("hash").agg((F.min("component") < F.max("component")).alias("mixed")).filter("mixed").select("hash")
    open_ = known.join(mixed, "hash")

    def band(n: Column) -> Column:
        return F.floor(F.ln(n) / math.log(BAND)).cast("int")

    # the overlap a set needs with one of m shingles is at most what it has left from this place on
    least, most = F.ceil(percent * F.col("n") / 100), F.floor((F.col("n") - F.col("place")) * (100 + percent) / percent + 1e-6) - F.col("n")
    larger = open_.withColumn("most", F.least(F.col("n"), most)).filter(F.col("most") >= least)
    x = larger.withColumn("band", F.explode(F.sequence(band(least) - 1, band(F.col("most")) + 1))).alias("x")
    y = open_.withColumn("band", band(F.col("n"))).alias("y")
    order = (F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.row") > F.col("y.row")))
    rest = (
        x.join(y, (F.col("x.hash") == F.col("y.hash")) & (F.col("x.band") == F.col("y.band")) & order & (F.col("x.component") != F.col("y.component")) & can_link(F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place")))
        .select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b"))
        .distinct()
        .join(pairs, ["a", "b"], "left_anti")
    )
    more = written(linked(rest, slices, percent), "links")
    final = components(links.unionByName(more)) if more.take(1) else labels

    # a large group of equal sets is a row for each row block here, and its documents are spread over the blocks
    groups = keyed.groupBy("set_key", "block").agg(F.min("doc_id").alias("least"))
    parts = groups.groupBy("set_key").agg(F.min("least").alias("least")).join(final.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    ids = written(parts.select("set_key", "component", "least"), "sets")
    smallest = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    of_set = ids.filter(F.col("component") != F.col("set_key")).select("set_key", "component").join(smallest, "component").select("set_key", "component_id")
    alone = ids.filter(F.col("component") == F.col("set_key")).select("set_key").join(smallest.withColumnRenamed("component", "set_key"), "set_key")
    blocks = sets.filter("n_shingles > 0").select("set_key", "block").distinct().join(of_set.unionByName(alone), "set_key")
    found = sets.filter("n_shingles > 0").select("doc_id", "n_shingles", "set_key", "block").join(blocks, ["set_key", "block"], "left")
    found = found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return found.unionByName(sets.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, unchanged, that carry the smallest id of their component, and those that are in none; of rows with equal id and text one."""
    found = jaccard_components(docs, width, percent)
    # read twice below, so that the links are not made twice
    stay = written(found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("stays")).agg(F.count("*").alias("copies")), "stay")

    def those(copies: str) -> DataFrame:
        those_ids = stay.filter(copies)
        # columns by their table: docs may have any names
        return docs.join(those_ids, docs["doc_id"].eqNullSafe(those_ids["stays"]), "left_semi")

    return those("copies = 1").unionByName(those("copies > 1").dropDuplicates(["doc_id", "text"]))
