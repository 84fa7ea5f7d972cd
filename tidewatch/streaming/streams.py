"""Structured Streaming twins: event time, watermarks, and keyed state with time to live.

Streams that only need windows are windowed aggregations; cooldowns, latest positions and static data
keep a little state a key. Clusters, trends, baselines, instability and escalation have modules of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import cell_id, normal_title


def hourly_events(events: DataFrame, *by: str, late: str = "1 hour") -> DataFrame:
    """Tumbling hourly counts."""
    return events.withWatermark("occurred_at", late).groupBy(F.window("occurred_at", "1 hour"), *by).agg(F.count("*").alias("n"))


def convergence(points: DataFrame, late: str = "24 hours", min_types: int = 3) -> DataFrame:
    """Cells where several kinds of signal meet within sliding days; counts of kinds are approximate only beyond a few hundred kinds."""
    counts = points.withWatermark("ts", late).groupBy(F.window("ts", "24 hours", "1 hour"), cell_id(F.col("lat"), F.col("lon")).alias("cell")).agg(F.size(F.collect_set("kind")).alias("types"), F.count("*").alias("total"))
    return counts.filter(F.col("types") >= min_types)


def convergence_alerts(points: DataFrame, late: str = "24 hours", min_types: int = 3) -> DataFrame:
    """(cell, day): cells where several kinds meet, once for each day on which such a window ends."""
    closed = convergence(points, late, min_types).select("cell", F.window_time("window").alias("at"), F.to_date(F.col("window.end")).alias("day"))
    return closed.dropDuplicatesWithinWatermark(["cell", "day"]).select("cell", "day")


def with_static(messages: DataFrame) -> DataFrame:
    """Positions with the last static data of their object: messages are (object_id, updated_at, kind, lat, lon, name, ship_type) with kind
    position or static, and an object's last name and type are its state, without end. Rows of a micro-batch are taken in order of time, static data first."""

    def fill(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames))
        rows["static"] = rows["kind"] == "static"
        rows = rows.sort_values(["us", "static"], ascending=[True, False], kind="stable")
        known = dict(zip(("name", "ship_type"), state.get if state.exists else (None, None)))
        for field, before in known.items():
            filled = rows[field].ffill()
            rows[field] = filled if before is None else filled.fillna(before)
        last = rows.iloc[-1]
        state.update((None if pd.isna(last["name"]) else str(last["name"]), None if pd.isna(last["ship_type"]) else int(last["ship_type"])))
        yield rows[~rows["static"]][["object_id", "us", "lat", "lon", "name", "ship_type"]].astype({"ship_type": "Int64"})

    rows = messages.select("object_id", F.unix_micros("updated_at").alias("us"), "kind", "lat", "lon", "name", F.col("ship_type").cast("long").alias("ship_type"))
    return rows.groupBy("object_id").applyInPandasWithState(fill, "object_id long, us long, lat double, lon double, name string, ship_type long", "name string, ship_type long", "append", GroupStateTimeout.NoTimeout)


def distinct_headlines(headlines: DataFrame, late: str = "7 days") -> DataFrame:
    return headlines.withWatermark("published_at", late).dropDuplicatesWithinWatermark(["source", "link", "title"])


def cooldown_alerts(headlines: DataFrame, minutes: int = 15, late: str = "30 minutes") -> DataFrame:
    """The first headline of a normal title, then each that comes the cooldown or more after the last emitted one. Rows of a
    micro-batch are taken in order of time; state goes when the watermark is past the cooldown."""
    gap = minutes * 60_000

    def emit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ms", "id"], kind="stable")
        last = state.get[0] if state.exists else None
        keep = []
        for ms in rows["ms"]:
            keep.append(last is None or ms - last >= gap)
            last = ms if keep[-1] else last
        state.update((int(last),))
        state.setTimeoutTimestamp(max(int(last) + gap, state.getCurrentWatermarkMs() + 1))
        yield rows[keep][["key", "id", "title", "ms"]]

    rows = headlines.withWatermark("published_at", late).select(normal_title(F.col("title")).alias("key"), "id", "title", F.unix_millis("published_at").alias("ms"), "published_at")
    return rows.groupBy("key").applyInPandasWithState(emit, "key string, id long, title string, ms long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def latest_positions(fixes: DataFrame, ttl_minutes: int = 8, late: str = "1 minute", order: str | None = None) -> DataFrame:
    """Each object's latest fix, updated as fixes come; an object that is silent for the time to live is dropped from state. Of fixes of one
    time the least by the column order counts, without it the first that came. Frames of an object are looked through one by one."""
    ttl = ttl_minutes * 60_000

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        for rows in frames:
            latest = rows[rows["us"] == rows["us"].max()].sort_values("seq", kind="stable")
            found = tuple(latest[c].iloc[0].item() for c in ("us", "seq", "lat", "lon"))
            if held is None or (found[0], -found[1]) > (held[0], -held[1]):
                held = found
        us, seq, lat, lon = held
        state.update(held)
        state.setTimeoutTimestamp(max(us // 1000 + ttl, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"object_id": [key[0]], "ms": [us // 1000], "lat": [lat], "lon": [lon], "us": [us], "seq": [seq]})

    seq = (F.col(order) if order else F.lit(0)).cast("long").alias("seq")
    rows = fixes.filter("updated_at is not null").withWatermark("updated_at", late).select("object_id", "lat", "lon", F.unix_micros("updated_at").alias("us"), seq, "updated_at")
    return rows.groupBy("object_id").applyInPandasWithState(keep, "object_id long, ms long, lat double, lon double, us long, seq long", "us long, seq long, lat double, lon double", "update", GroupStateTimeout.EventTimeTimeout)


def per_batch(stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], mode: str = "append", **trigger) -> StreamingQuery:
    """Runs a batch operator on each micro-batch: upserts with change feed, clustering over recent tables, scores of each trigger.
    A batch may run twice after a failure, so work must write by its id."""
    return stream.writeStream.foreachBatch(work).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def state_of(spark: SparkSession, table: str, n: int) -> dict[int, int]:
    """Which version holds each bucket of a table after batch n: a row a bucket, so its size is fixed."""
    return {r.bucket: r.held for r in spark.read.parquet(f"{table}-index/version={n}").collect()} if n >= 0 else {}


def current_table(spark: SparkSession, table: str, n: int) -> DataFrame:
    """The table after batch n: each bucket from the version that last wrote it."""
    return spark.read.parquet(*(f"{table}/version={held}/bucket={b}" for b, held in sorted(state_of(spark, table, n).items())))


def upsert_stream(stream: DataFrame, table: str, feed: str, checkpoint: str, buckets: int = 256) -> StreamingQuery:
    """Merges raw events into a table of buckets by external id, and writes what changed as messages. A batch reads and writes
    only the buckets that it touches, into a version of its own, and then the list of which version holds each bucket; a batch
    that runs twice starts from the list before it."""
    from ..operators.events import upsert_events
    from ..sources.sinks import change_feed

    bucket = F.pmod(F.xxhash64("external_id"), F.lit(buckets)).cast("int")
    kept = "external_id string, confidence_score int, event_type string"

    def work(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        held = state_of(spark, table, n - 1)
        touched = [r.b for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most one row a bucket
        paths = [f"{table}/version={held[b]}/bucket={b}" for b in touched if b in held]
        existing = spark.read.parquet(*paths).select("external_id", F.col("confidence").cast("int").alias("confidence_score"), "event_type") if paths else spark.createDataFrame([], kept)
        merged = upsert_events(existing, batch).withColumn("bucket", bucket)
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/version={n}")
        if touched:
            changed = spark.read.parquet(f"{table}/version={n}").drop("bucket").filter("change <> 'none'")
            change_feed(changed.filter("change = 'insert'"), "new_event").unionByName(change_feed(changed.filter("change = 'update'"), "update_event")).write.mode("overwrite").parquet(f"{feed}/batch={n}")
        index = list((held | dict.fromkeys(touched, n)).items())
        spark.createDataFrame(index, "bucket int, held long").coalesce(1).write.mode("overwrite").parquet(f"{table}-index/version={n}")

    return per_batch(stream, checkpoint, work)
