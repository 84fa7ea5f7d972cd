"""Connected components of a link table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node reaches. Every round takes each
    node's smallest neighbouring label, then that label's own label; rounds are written tables."""
    both = written(links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).filter("x <> y").distinct(), "links")
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("component")), "labels")

    def total(df: DataFrame):
        return df.agg(F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))).first()[0]

    before = total(labels)
    while before is not None:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("component").alias("near"))
        nearer = labels.join(near.withColumnRenamed("x", "node"), "node").select("node", F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = written(nearer.join(jump, "component", "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        after = total(labels)
        if after == before:
            break
        before = after
    return labels
