"""Line dedup by winnowing, in DataFrame functions only.

Lines with a word are hashed; each window of `run` of them selects its smallest hash (the
first of equal ones), so any run of that many lines that occurs twice has its minimum
selected at the same place both times. A selected minimum is one fingerprint, however
many windows chose it, and carries the lines around it that those windows reach. Only
fingerprints that are found at two places or more go on. Their positions are joined: of
each window that chose a fingerprint, told apart by the hashes of all its lines, later
occurrences meet the first one in order of (doc_id, line). From there matches extend both
ways through the windows that also match, and the lines of later repeats go. Groups of
equal windows are only ever held against their first occurrence.

Blank lines are neither counted nor removed. Null and empty texts stay as they are (null
as empty). Repeated rows are one document: each returns with what the document keeps.
Other columns are carried along in `rest`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]"


def drop_repeated_runs(docs: DataFrame, run: int = 3) -> DataFrame:
    """doc_id, text without later repeats, n_lines, n_removed, and the other columns in rest."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest")] if others else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *rest)
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))

    lines = F.split("text", "\n", -1)
    filled = rows.select("doc_id", "key", F.filter(lines, lambda x: x.rlike(WORD)).alias("lines"))
    hashed = filled.filter(F.size("lines") >= run).select("doc_id", "key", F.transform("lines", lambda x, i: F.struct(F.xxhash64(x).alias("hash"), i.alias("place"))).alias("h"))
    # the window from each line on selects a minimum; runs of windows with one minimum are one fingerprint
    chosen = F.transform(F.sequence(F.lit(0), F.size("h") - run), lambda i: F.array_min(F.slice("h", i + 1, run)))
    hashed = hashed.withColumn("chosen", chosen)
    fresh = F.filter(F.sequence(F.lit(0), F.size("chosen") - 1), lambda i: (i == 0) | (F.get("chosen", i) != F.get("chosen", i - 1)))
    selected = F.transform(
        fresh,
        lambda i: F.struct(
            F.get("chosen", i)["hash"].alias("print"),
            F.get("chosen", i)["place"].alias("place"),
            i.alias("start"),
            # what its windows reach: to the last window that has the minimum
            F.transform(F.slice("h", i + 1, F.get("chosen", i)["place"] - i + run), lambda x: x["hash"]).alias("around"),
        ),
    )
    prints = written(hashed.select("doc_id", "key", F.explode(selected).alias("s")).select("doc_id", "key", "s.*"), "prints")

    place = F.struct("doc_id", "key", "place")
    shared = prints.groupBy("print").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low <> high").select("print")
    open_ = prints.join(shared, "print", "left_semi")
    # the windows of a fingerprint: those of its lines whose minimum it is
    last = F.least(F.size("around") - run, F.col("place") - F.col("start"))
    own = F.filter(F.sequence(F.lit(0), last), lambda i: F.array_min(F.slice("around", i + 1, run)) == F.col("print"))
    windows = open_.select("doc_id", "key", F.explode(F.transform(own, lambda i: F.struct((F.col("start") + i).alias("start"), F.slice("around", i + 1, run).alias("lines")))).alias("w")).select("doc_id", "key", "w.*")
    at = F.struct("doc_id", "key", "start")
    first = windows.groupBy("lines").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first <> last").drop("last")
    later = windows.join(first, "lines").filter(at != F.col("first"))
    gone = later.select(F.col("doc_id").alias("of"), F.col("key").alias("of_key"), F.explode(F.sequence(F.col("start"), F.col("start") + (run - 1))).alias("place"))
    gone = gone.groupBy("of", "of_key").agg(F.collect_set("place").alias("gone"))

    joined = rows.join(gone, (F.col("key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of")), "left").withColumn("lines", lines)
    joined = joined.withColumn("at", F.sequence(F.lit(0), F.size("lines") - 1))
    joined = joined.withColumn("filled", F.filter("at", lambda i: F.get("lines", i).rlike(WORD)))
    kept = F.transform(F.array_except("at", F.transform("gone", lambda g: F.get("filled", g))), lambda i: F.get("lines", i))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select("doc_id", text.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.greatest(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), *(["rest"] if others else []))
