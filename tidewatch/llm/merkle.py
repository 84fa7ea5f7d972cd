"""Merkle manifest of a table of documents: leaves, roots, proofs and the check of tampered rows.

H is lowercase hex SHA-256 of its inputs one after the other, digests as hex text. A leaf is H of
the row's fields, each `-` if null, else its UTF-8 length in bytes, `:` and itself. The leaves of a lang ascend by
doc_id (nulls first; rows of one doc_id by leaf); as long as a tree has several nodes, each run of `arity` consecutive ones
becomes their H, also a last run that is shorter. What is left is the lang's subroot; the subroots
in the order of lang (null first, then by bytes) make the tree of the root in the same way.

Leaves are numbered without gathering a lang: rows are sorted by ranges over the table, and a row's number in its lang
is its place in its range plus what the ranges before hold of the lang. At each level every node is joined by its number with the numbers
that its siblings compute for it: their own number shifted by each offset to another slot of the run (with arity 2 the number XOR 1).
The nodes of slot zero then emit the parents, until one node is left. Proofs go down the other way:
a node's path is its siblings on top of its parent's path, so that a parent is joined with its own few children only and no
join meets a frequent key. Each level is written as a table.

An empty table has no rows. Equal rows are leaves of their own, next to each other; null doc_ids are never tampered with,
and null texts stay as they are. Columns other than the five are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_partitions, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def hexed(c: Column) -> Column:
    """Hex text of one digest or of several, one after the other."""
    return F.lower(F.hex(c))


def leaf_of(**changed: Column) -> Column:
    fields = [changed.get(c, F.col(c)).cast("string") for c in FIELDS]
    return digest(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in fields))


def numbered(rows: DataFrame, tree: str | None, order: list[str]) -> DataFrame:
    """rows with idx, their number from 0 in the order within their tree, and size, the rows of that tree.

    order begins with tree. The rows between two bounds of the sort are counted by tree; a window runs over those
    counts only, which are at most as many as bounds and trees together."""
    ranged = rows.repartitionByRange(n_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "placed")
    key = F.col(tree) if tree else F.lit(0)
    counts = placed.groupBy(key.alias("of"), F.col("part").alias("in_part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("of").orderBy("in_part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.select("of", "in_part", "first", (upto - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("of")).alias("size"))
    joined = placed.join(counts, (F.col("part") == F.col("in_part")) & key.eqNullSafe(F.col("of")))
    return joined.select(*rows.columns, (F.col("before") + F.col("at") - F.col("first")).alias("idx"), "size")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """nodes (tree, idx, size, hash, ...) with left and right, the hashes of the other nodes of their run, one after the other."""
    slot, run = F.pmod("idx", F.lit(arity)), F.col("idx") - F.pmod("idx", F.lit(arity))
    offsets = F.array(*(F.lit(k).cast("long") for k in range(1, arity)))
    targets = F.filter(F.transform(offsets, lambda k: run + F.pmod(slot + k, F.lit(arity))), lambda t: t < F.col("size"))
    sent = nodes.filter("size > 1").select(F.col("tree").alias("to_tree"), F.explode(targets).alias("to_idx"), F.struct(slot.alias("slot"), "hash").alias("sibling"))
    got = sent.groupBy("to_tree", "to_idx").agg(F.array_sort(F.collect_list("sibling")).alias("siblings"))
    found = nodes.join(got, (F.col("tree") == F.col("to_tree")) & (F.col("idx") == F.col("to_idx")), "left").withColumn("siblings", F.coalesce("siblings", F.array().cast("array<struct<slot: bigint, hash: binary>>")))

    def side(keep) -> Column:
        return F.aggregate(F.filter("siblings", keep), F.lit(b""), lambda acc, s: F.concat(acc, s["hash"]))

    return found.select(*nodes.columns, side(lambda s: s["slot"] < slot).alias("left"), side(lambda s: s["slot"] > slot).alias("right"))


def levels_of(nodes: DataFrame, depth: int, arity: int) -> list[DataFrame]:
    """The levels of all trees, each as a table, from the leaves (tree, idx, size, hash, ...) up; depth: the levels of the largest tree."""
    levels = [written(with_siblings(nodes, arity), "level")]
    for _ in range(depth - 1):
        heads = levels[-1].filter((F.col("size") > 1) & (F.pmod("idx", F.lit(arity)) == 0))
        parents = heads.select(
            "tree", F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(size + {arity - 1}) div {arity}").alias("size"), F.unhex(digest(hexed(F.col("hash")), hexed(F.col("right")))).alias("hash"),
        )
        levels.append(written(with_siblings(parents, arity), "level"))
    return levels


def depth_of(largest: int, arity: int) -> int:
    depth = 1
    while largest > 1:
        largest, depth = -(-largest // arity), depth + 1
    return depth


def paths(levels: list[DataFrame], above: DataFrame, arity: int) -> DataFrame:
    """The lowest level with path: the siblings (left, right) level by level up to the tree's root, then those of above (tree, path, ...), whose other columns come along."""
    more, found = [c for c in above.columns if c not in ("tree", "path")], None
    for k, nodes in reversed([*enumerate(levels)]):
        own = nodes.select("tree", "idx", "size", F.array(F.struct("left", "right")).alias("own"), *(nodes.columns[3:-2] if k == 0 else []))
        rows = own.filter("size = 1").join(above, "tree")
        if found is not None:
            parents = found.select(F.col("tree").alias("of"), F.col("idx").alias("parent"), "path", *more)
            children = own.filter("size > 1").join(parents, (F.col("tree") == F.col("of")) & (F.expr(f"idx div {arity}") == F.col("parent"))).drop("of", "parent")
            rows = rows.unionByName(children.withColumn("path", F.concat("own", "path")))
        found = rows.drop("own")
    return found


def merkle_manifest(docs: DataFrame, arity: int = 8, tampered_every: int = 3) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row."""
    docs = docs.select(*FIELDS)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % tampered_every == 0, F.lit(False))
    forged = F.when(hit, leaf_of(text=F.translate(F.col("text").cast("string"), UPPER, LOWER)))
    leaves = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.unhex(leaf_of()).alias("hash"), F.unhex(forged).alias("forged"))
    # a row's number in the table tells equal leaves apart, so that the sort can deal them to different tasks
    leaves = numbered(written(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves"), "lang", ["lang", "doc_id", "hash", "row"])
    leaves = written(leaves, "numbered")

    trees = written(numbered(leaves.filter("idx = 0").select("lang", F.col("size").alias("leaves")), None, ["lang"]), "trees")
    sizes = trees.agg(F.max("leaves").alias("leaves"), F.max("size").alias("trees")).first()
    tree = F.coalesce(F.concat(F.lit(":"), "lang"), F.lit("-"))
    levels = levels_of(leaves.select(tree.alias("tree"), "idx", "size", "hash", "doc_id", "forged"), depth_of(sizes.leaves or 0, arity), arity)

    subroots = levels[0].filter("size = 1").select("tree", "hash")
    for level in levels[1:]:
        subroots = subroots.unionByName(level.filter("size = 1").select("tree", "hash"))
    subroots = subroots.join(trees.select(tree.alias("tree"), "idx", "size"), "tree")
    upper = levels_of(subroots.select(F.lit("").alias("tree"), "idx", "size", "hash", F.col("tree").alias("of_lang")), depth_of(sizes.trees or 0, arity), arity)
    root = upper[-1].select("tree", F.array().cast("array<struct<left: binary, right: binary>>").alias("path"), F.col("hash").alias("root"))
    above = paths([upper[0].select("tree", "idx", "size", F.col("hash").alias("subroot"), "of_lang", "left", "right"), *upper[1:]], root, arity)
    above = written(above.select(F.col("of_lang").alias("tree"), "path", "subroot", "root"), "paths")

    found = paths(levels, above, arity)
    start = hexed(F.coalesce("forged", "hash"))
    folded = F.aggregate("path", start, lambda acc, p: digest(hexed(p["left"]), acc, hexed(p["right"])))
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(hexed(p["left"]), hexed(p["right"]))), ""), 256)
    return found.select(
        "doc_id", hexed(F.col("hash")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"), (folded == hexed(F.col("root"))).alias("verified"),
    )
