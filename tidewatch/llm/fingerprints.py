"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the ascending array of the k smallest 64-bit hashes of a text's distinct word
shingles (words parted by ASCII white space, in lower case, `width` in a row, or all where
there are fewer). Sketches of parts merge into the sketch of the whole, and two of them
estimate resemblance, containment and the number of distinct shingles; sets of fewer than
k shingles are held whole, which makes these exact.

Null and empty texts have empty sketches; two empty sketches resemble each other by 1, an
empty and another one by 0. The next document is the next row in ascending order of
(doc_id, text), nulls first, after the last the first; repeated rows are one document in
this order and return a row each. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_partitions, written

WORD_BREAK = r"[\x20\x09-\x0D]+"


def with_sketch(df: DataFrame, text: Column, name: str, k: int, width: int) -> DataFrame:
    """df with the sketch of a text. Word hashes are a column of their own, so that each is computed once."""
    words = F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != "")
    df = df.withColumn(f"{name}_words", F.transform(words, lambda w: F.xxhash64(w)))
    h = F.col(f"{name}_words")
    starts = F.when(F.size(h) > 0, F.sequence(F.lit(0), F.greatest(F.size(h) - width, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(width))))
    return df.withColumn(name, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).drop(f"{name}_words")


def merge_sketches(a: Column, b: Column, k: int) -> Column:
    """The sketch of the union of two sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(sketch: Column, k: int) -> Column:
    """An aggregate: the sketch of the union of a group's sets, kept at k hashes while it grows."""
    return F.aggregate(F.collect_list(sketch), F.array().cast("array<bigint>"), lambda x, y: merge_sketches(x, y, k))


def resemblance(a: Column, b: Column, k: int) -> Column:
    """Estimated |A and B| / |A or B|: the part of the union's sketch that both sketches hold."""
    union = merge_sketches(a, b, k)
    both = F.array_intersect(union, F.array_intersect(a, b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(both) / F.size(union))


def distinct_shingles(a: Column, k: int) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the place of the k-th hash."""
    part = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / part)


def containment(a: Column, b: Column, k: int) -> Column:
    """Estimated |A and B| / |A|."""
    both = resemblance(a, b, k) * distinct_shingles(merge_sketches(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def in_order(keys: DataFrame) -> DataFrame:
    """For each key of (doc_id, key, n_chars) the one before it in order, around the end: keys are dealt to
    ranges, each range looks at its own rows, and only the ranges' last rows, one each, are looked at together."""
    n = n_partitions(keys.sparkSession)
    ranged = written(keys.distinct().repartitionByRange(n, "doc_id", "key").withColumn("part", F.spark_partition_id()), "order")
    row = F.struct("doc_id", "key", "n_chars")
    own = Window.partitionBy("part").orderBy("doc_id", "key")
    # a row for each range, as many as shuffle partitions
    ends = ranged.groupBy("part").agg(F.max(row).alias("last"))
    across = Window.partitionBy(F.lit(0)).orderBy("part")
    ends = ends.select("part", F.coalesce(F.lag("last").over(across), F.last("last").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("previous"))
    found = ranged.withColumn("before", F.lag(row).over(own)).join(F.broadcast(ends), "part")
    before = F.coalesce("before", "previous")
    return found.select("key", before["key"].alias("before"), before["doc_id"].alias("before_id"), before["n_chars"].alias("before_chars"))


def fingerprints(docs: DataFrame, k: int = 256, width: int = 5, edited_part: int = 4) -> DataFrame:
    """doc_id, n_chars, edited_text, the sketches of both texts, near_edited and near_next."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # a document is known by its id and a hash of its text
    rows = rows.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.hex(F.xxhash64("text"))).alias("key"), "doc_id", "text")
    order = in_order(rows.select("doc_id", "key", F.char_length("text").cast("long").alias("n_chars")))

    # both joins take the same columns, so that texts are shuffled once; ids come from the order
    texts = rows.select("key", "text")
    heads = texts.join(order, "key").dropDuplicates(["key"])
    heads = with_sketch(heads.withColumn("head", F.substring(F.col("text"), F.lit(1), F.floor(F.col("before_chars") / edited_part).cast("int"))), F.col("text"), "next_sketch", k, width)
    heads = heads.select(F.col("before").alias("key"), F.col("before_id").alias("doc_id"), "head", "next_sketch")

    n = F.char_length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / edited_part).cast("int")), F.col("head"))
    found = with_sketch(with_sketch(texts.join(heads, "key").withColumn("edited_text", edited), F.col("text"), "sketch", k, width), F.col("edited_text"), "edited_sketch", k, width)
    return found.select(
        "doc_id", n.cast("long").alias("n_chars"), "edited_text", "sketch", "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
