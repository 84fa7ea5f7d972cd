"""Records of ingestion runs: what each write fetched, created and updated, observed while it is written."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

RUN = "run string, status string, fetched long, created long, updated long, error string, started_at timestamp, completed_at timestamp"
#: Characters of an error that are kept.
ERROR_CHARS = 2000


def counts() -> list:
    """What is observed of rows with a column change."""
    change = F.col("change")
    return [F.count(F.lit(1)).alias("fetched"), F.count_if(change == "insert").alias("created"), F.count_if(change == "update").alias("updated")]


def now() -> datetime:
    return datetime.now(timezone.utc)


def record(spark: SparkSession, log: str, run: str, status: str, found: dict, error: BaseException | str | None, started: datetime) -> None:
    """Puts the run's record in place of what the log has of it: a folder a run, so that a retried run is there once."""
    row = (run, status, *(found.get(c) for c in ("fetched", "created", "updated")), None if error is None else str(error)[:ERROR_CHARS], started, None if status == "running" else now())
    spark.createDataFrame([row], RUN).coalesce(1).write.mode("overwrite").parquet(f"{log}/id={run}")


def recorded(changes: DataFrame, log: str, run: str, write: Callable[[DataFrame], None]) -> None:
    """Runs write(changes) and keeps a record of it in the log: running, then completed with its counts, or failed with its error, which is raised again.

    The counts are observed in the plan that is written, so nothing is read twice; write must write the DataFrame that it gets, once. A failed run has no counts, as part of its rows may not
    have been seen. A run of the same name takes the record's place."""
    spark, started = changes.sparkSession, now()
    record(spark, log, run, "running", {}, None, started)
    seen = Observation(f"run-{uuid.uuid4().hex}")
    try:
        write(changes.observe(seen, *counts()))
    except BaseException as error:
        record(spark, log, run, "failed", {}, error, started)
        raise
    record(spark, log, run, "completed", seen.get, None, started)


def recorded_batches(log: str, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that runs write(changes, n) and keeps a record of each batch, as recorded() does; a batch that runs twice has one."""

    def work(batch: DataFrame, n: int) -> None:
        recorded(batch, log, f"batch-{n}", lambda df: write(df, n))

    return work


def runs(spark: SparkSession, log: str) -> DataFrame:
    """The records of a log, one a run."""
    return spark.read.schema(RUN).parquet(log).select(*(field.split()[0] for field in RUN.split(", ")))


class BatchLog(StreamingQueryListener):
    """Keeps what the observed metrics of streams say: for each batch of a query with df.observe(name, *counts()), a record named by name and batch;
    for a query that ends by an error, a failed record. Records are kept in memory, `most` of them, until take() is called, as a listener should not run jobs."""

    def __init__(self, name: str, most: int = 10_000):
        self.name, self.most, self.rows = name, most, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            started = datetime.fromisoformat(event.progress.timestamp.replace("Z", "+00:00"))
            self.rows = [*self.rows, (f"{self.name}-{event.progress.batchId}", "completed", found["fetched"], found["created"], found["updated"], None, started, now())][-self.most :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.rows = [*self.rows, (f"{self.name}-{event.runId}", "failed", None, None, None, event.exception[:ERROR_CHARS], now(), now())][-self.most :]

    def take(self, spark: SparkSession) -> DataFrame:
        rows, self.rows = self.rows, []
        return spark.createDataFrame(rows, RUN)
