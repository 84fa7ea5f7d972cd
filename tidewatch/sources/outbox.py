"""Messages of detectors: kept by batch and detector before they are sent, and sent once to each sink."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import exists, made, names_in, removed, renamed

MESSAGE = "type string, payload string"


def detector_messages(found: DataFrame, kind: str, per_message: int = 500) -> DataFrame:
    """(type, payload): what a detector found as messages of up to per_message rows, as a JSON list each; none where it found nothing."""
    part = F.floor(F.monotonically_increasing_id() / per_message)
    rows = found.select(F.struct(*found.columns).alias("row"), part.alias("part"))
    return rows.groupBy("part").agg(F.to_json(F.collect_list("row")).alias("payload")).select(F.lit(kind).alias("type"), "payload")


class Outbox:
    """A folder of messages by batch and detector, and of what each sink has got.

    put() keeps a detector's messages under a temporary name that becomes theirs by one rename, so that they are there as a whole or not
    at all, and a batch that runs twice keeps the first. send() gives every sink what it has not got yet and notes it behind each, so that
    a sink that was cut off gets the rest in the next call, and none gets a batch's messages twice unless it failed after it had taken them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def put(self, batch: int, detector: str, messages: Callable[[], DataFrame]) -> bool:
        """Whether the messages are new; else they are not computed."""
        place = f"{self.folder}/messages/batch={batch:012d}/detector={detector}"
        if exists(self.spark, place):
            return False
        temporary = f"{self.folder}/temporary/{uuid.uuid4().hex}"
        messages().write.parquet(temporary)
        made(self.spark, place.rsplit("/", 1)[0])
        kept = renamed(self.spark, temporary, place)
        removed(self.spark, temporary)
        return kept

    def pending(self, sink: str) -> list[tuple[str, str]]:
        """(batch, detector) folders that a sink has not got, in order of batches."""
        sent = set(names_in(self.spark, f"{self.folder}/sent/{sink}"))
        found = [(b, d) for b in names_in(self.spark, f"{self.folder}/messages") for d in names_in(self.spark, f"{self.folder}/messages/{b}")]
        return [x for x in found if "-".join(x) not in sent]

    def send(self, sinks: dict[str, Callable[[DataFrame, str], None]]) -> int:
        """Calls each sink with messages and the name of their batch and detector; returns how many of these were sent."""
        n = 0
        for name, sink in sinks.items():
            for batch, detector in self.pending(name):
                sink(self.spark.read.schema(MESSAGE).parquet(f"{self.folder}/messages/{batch}/{detector}"), f"{batch}-{detector}")
                made(self.spark, f"{self.folder}/sent/{name}/{batch}-{detector}")
                n += 1
        return n
