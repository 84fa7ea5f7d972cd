"""Streams over files that arrive one by one, against their batch twins."""

from pyspark.sql import functions as F

from tidewatch.operators import headlines as hl
from tidewatch.functions.columns import normal_title
from tidewatch.streaming import baselines, clusters, streams, trends


def arriving(spark, tmp_path, frames, schema):
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    return spark.readStream.schema(spark.read.parquet(f"file://{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")


def drained(stream, name, mode, tmp_path):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/cp-{name}").trigger(availableNow=True).start().awaitTermination(120)
    return stream.sparkSession.table(name)


def test_cooldown_stream_equals_batch(spark, tmp_path):
    times = [0, 5, 16, 40, 41, 60]
    rows = [(i, "Same, title!" if i % 2 else "same title", t) for i, t in enumerate(times)]
    stream = arriving(spark, tmp_path, [rows[:3], rows[3:]], "id long, title string, minute int").withColumn("published_at", F.timestamp_seconds(F.col("minute") * 60 + 1_700_000_000))
    got = sorted(r.id for r in drained(streams.cooldown_alerts(stream), "cooldown", "append", tmp_path).collect())
    batch = spark.createDataFrame(rows, "id long, title string, minute int").withColumn("published_at", F.timestamp_seconds(F.col("minute") * 60 + 1_700_000_000))
    assert got == sorted(r.id for r in hl.with_cooldown(batch, normal_title(F.col("title")), "published_at", 15).collect()) == [0, 2, 3, 5]


def test_latest_positions(spark, tmp_path):
    rows = [(1, 1.0, 1.0, 10), (1, 2.0, 2.0, 20), (2, 5.0, 5.0, 15)]
    stream = arriving(spark, tmp_path, [rows], "object_id long, lat double, lon double, s long").withColumn("updated_at", F.timestamp_seconds("s"))
    found = drained(streams.latest_positions(stream), "positions", "update", tmp_path)
    assert {(r.object_id, r.ms) for r in found.collect()} == {(1, 20000), (2, 15000)}


def test_latest_positions_of_many_fixes(spark, tmp_path):
    """An object's fixes come in several frames, and of fixes of one time the least by the order counts."""
    n = 25_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("object_id"), F.col("id").cast("double").alias("lat"), F.lit(0.0).alias("lon"), "id", F.timestamp_millis(F.least("id", F.lit(n - 3))).alias("updated_at"))
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/fixes")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/fixes")
    found = drained(streams.latest_positions(stream, order="id"), "many_positions", "update", tmp_path)
    assert [(r.object_id, r.ms, r.lat) for r in found.collect()] == [(1, n - 3, n - 3.0)]


def test_hourly_counts_close_with_the_watermark(spark, tmp_path):
    rows = [[("a", 0), ("a", 60)], [("a", 3700)], [("a", 20000)]]
    stream = arriving(spark, tmp_path, rows, "country string, s long").withColumn("occurred_at", F.timestamp_seconds("s"))
    found = drained(streams.hourly_events(stream, "country"), "hours", "append", tmp_path)
    assert sorted(r.n for r in found.collect()) == [1, 2]


def test_upsert_stream(spark, tmp_path):
    rows = [[(1, "x-1", 50, "drone")], [(2, "x-1", 40, "missile"), (3, "x-2", 10, "drone")]]
    stream = arriving(spark, tmp_path, rows, "id long, external_id string, confidence_score int, event_type string")
    streams.upsert_stream(stream, f"file://{tmp_path}/t", f"file://{tmp_path}/feed", f"file://{tmp_path}/cp").awaitTermination(120)
    last = {r.external_id: (r.confidence, r.change) for r in spark.read.parquet(f"file://{tmp_path}/t/version=1").collect()}
    assert last == {"x-1": (53, "update"), "x-2": (10, "insert")}
    assert spark.read.parquet(f"file://{tmp_path}/feed/batch=1").count() == 2


def test_cluster_stream_equals_batch_over_what_has_come(spark, tmp_path):
    rows = [[(1, "missile strike reported near coast", "s", 1, 0), (2, "talks resume today again", "s", 1, 5)], [(3, "missile strike reported near town", "s", 1, 10)]]
    schema = "id long, title string, source string, tier int, minute int"
    stream = arriving(spark, tmp_path, rows, schema).withColumn("published_at", F.timestamp_seconds(F.col("minute") * 60 + 1_700_000_000))
    clusters.cluster_stream(stream, f"file://{tmp_path}/t", f"file://{tmp_path}/o", f"file://{tmp_path}/cp", []).awaitTermination(180)
    batch = spark.createDataFrame([r for x in rows for r in x], schema).withColumn("published_at", F.timestamp_seconds(F.col("minute") * 60 + 1_700_000_000))
    found = {r.id: r.cluster_id for r in spark.read.parquet(f"file://{tmp_path}/o").collect()}
    assert found == {r.id: r.cluster_id for r in hl.cluster_headlines(batch, []).collect()} == {1: 1, 2: 2, 3: 1}


def test_terms_are_silent_for_the_cooldown(spark, tmp_path):
    rows = [[(f"s{i}", f"l{n}-{i}", "quake felt", n * 20) for i in range(5)] for n in range(4)]
    stream = arriving(spark, tmp_path, rows, "source string, link string, title string, minute int").withColumn("published_at", F.timestamp_seconds(F.col("minute") * 60 + 1_700_000_000))
    trends.trending_stream(stream, f"file://{tmp_path}/t", f"file://{tmp_path}/o", f"file://{tmp_path}/cp").awaitTermination(180)
    found = spark.read.parquet(f"file://{tmp_path}/o").filter("term = 'quake'").collect()
    assert sorted((r.batch, r.recent_count) for r in found) == [(0, 5), (2, 15)]


def test_upserts_rewrite_only_touched_buckets(spark, tmp_path):
    rows = [[(i, f"x-{i}", 50, "drone") for i in range(1, 41)], [(41, "x-1", 40, "missile")]]
    stream = arriving(spark, tmp_path, rows, "id long, external_id string, confidence_score int, event_type string")
    table = f"file://{tmp_path}/t"
    streams.upsert_stream(stream, table, f"file://{tmp_path}/feed", f"file://{tmp_path}/cp", buckets=8).awaitTermination(120)
    last = {r.external_id: (r.confidence, r.event_type) for r in streams.current_table(spark, table, 1).collect()}
    assert len(last) == 40 and last["x-1"] == (53, "missile") and last["x-2"] == (50, "drone")
    assert len(list((tmp_path / "t" / "version=1").glob("bucket=*"))) == 1


def test_static_data_is_kept_between_batches(spark, tmp_path):
    schema = "object_id long, kind string, lat double, lon double, name string, ship_type long, s long"
    rows = [[(1, "position", 1.0, 1.0, None, None, 1), (1, "static", None, None, "A", 35, 2)], [(1, "static", None, None, "B", None, 4), (1, "position", 2.0, 2.0, None, None, 3), (1, "position", 3.0, 3.0, None, None, 5), (2, "position", 9.0, 9.0, None, None, 5)]]
    stream = arriving(spark, tmp_path, rows, schema).withColumn("updated_at", F.timestamp_seconds("s"))
    found = drained(streams.with_static(stream), "static", "append", tmp_path).collect()
    assert sorted((r.object_id, r.lat, r.name, r.ship_type) for r in found if r.name) == [(1, 2.0, "A", 35), (1, 3.0, "B", 35)]
    assert sorted((r.object_id, r.lat, r.ship_type) for r in found if not r.name) == [(1, 1.0, None), (2, 9.0, None)]


def test_baseline_state_goes_on_between_batches(spark, tmp_path):
    from tidewatch.operators import scores as sc

    counts = [3, 4] * 15 + [30, 40, 35, 3, 50]
    rows = [("a", n, h) for h, n in enumerate(counts)]
    schema = "key string, n long, h long"
    stream = arriving(spark, tmp_path, [rows[:27], rows[27:]], schema).withColumn("hour", F.timestamp_seconds(F.col("h") * 3600))
    found = drained(baselines.baseline_alerts(stream, "key"), "baseline", "append", tmp_path).collect()
    batch = sc.baseline_anomalies(spark.createDataFrame(rows, schema).withColumn("hour", F.timestamp_seconds(F.col("h") * 3600).cast("timestamp_ntz")), ["key"]).collect()
    assert sorted((r.n, round(r.z, 4)) for r in found) == sorted((r.n, r.z) for r in batch) and found


def test_an_alert_a_cell_and_day(spark, tmp_path):
    rows = [(1.5, 1.5, k, 3600 * h) for h, k in ((1, "a"), (2, "b"), (3, "c"), (100, "a"))] + [(7.5, 7.5, "a", 3600)]
    stream = arriving(spark, tmp_path, [rows], "lat double, lon double, kind string, s long").withColumn("ts", F.timestamp_seconds("s"))
    found = drained(streams.convergence_alerts(stream), "cells", "append", tmp_path).collect()
    assert sorted((r.cell, r.day.isoformat()) for r in found) == [("1,1", "1970-01-01"), ("1,1", "1970-01-02")]
