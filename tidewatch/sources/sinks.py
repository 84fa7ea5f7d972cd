"""Writers: events by date, change feed, run metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import removed, renamed


def append_events(events: DataFrame, path: str, as_of: str, run: str | None = None) -> None:
    """Appends events, stamped with the time they were first seen, by date; a date of any share of the rows is cut into files of ordinary size.

    With the name of a run they are a folder run=... of the table, which is written beside it and takes its name when it is
    whole: a run that is repeated, or that failed half-way, leaves its events once. A table takes runs with names or without, not both."""
    seen = F.lit(as_of).cast("timestamp_ntz")
    stamped = events.withColumn("first_seen_at", seen).withColumn("last_updated_at", seen).withColumn("date", F.to_date("occurred_at"))
    stamped = stamped.hint("rebalance", F.col("date"))
    if run is None:
        stamped.write.mode("append").partitionBy("date").parquet(path)
        return
    spark, staged, target = events.sparkSession, f"{path}/_{uuid.uuid4().hex}", f"{path}/run={run}"
    stamped.write.partitionBy("date").parquet(staged)
    removed(spark, target)
    if not renamed(spark, staged, target):
        raise RuntimeError(f"run {run} is being written elsewhere too")


def change_feed(df: DataFrame, kind: str) -> DataFrame:
    """One message a row: its type and the row as JSON."""
    return df.select(F.lit(kind).alias("type"), F.to_json(F.struct(*df.columns)).alias("payload"))


def run_metrics(changes: DataFrame, path: str, run: str) -> None:
    """Appends what a batch fetched, created and updated; changes has a column change."""
    changes.agg(F.lit(run).alias("run"), F.count("*").alias("fetched"), F.count_if(F.col("change") == "insert").alias("created"), F.count_if(F.col("change") == "update").alias("updated")).write.mode("append").parquet(path)
