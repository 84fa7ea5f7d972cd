"""Queries over feeds: files in the feeds' formats are written from the tables to a fresh shared folder, then read, normalised or streamed."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dictionaries as d
from ..operators import headlines as hl
from ..sources import feeds, outbox, runs, sinks
from ..storage import shared_dir
from ..streaming import baselines, clusters, escalation, instability, streams, trends
from .queries import AS_OF, CATEGORY_RISK, CONFLICT, DAILY, FOLD, NOW, ORACLE_SQL, SANCTIONED, SEVERITY_WEIGHTS, TERMS, breaking_gate, convergence_cells, daily_scores, gated_headlines, query, signals_of, trending_terms

#: Records of one landed file.
PER_FILE = 500


def json_files(rows: DataFrame, wrapper: str, key: str) -> str:
    """Rows as JSON files of one object each, whose field wrapper holds some hundred rows in order of the key."""
    record = F.struct(*[c for c in rows.columns if c != key])
    objects = rows.groupBy(F.floor(F.col(key) / PER_FILE).alias("file")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct(key, record.alias("r")))), lambda x: x["r"]).alias(wrapper))).alias("value"))
    return text_files(objects)


def text_files(rows: DataFrame) -> str:
    """The value of each row as a file of its own."""
    path = shared_dir(rows.sparkSession, "feed")
    rows.repartition("file").write.partitionBy("file").text(path)
    return path


def wall_clock(ts: str) -> Column:
    return F.col(ts).cast("timestamp_ntz").alias(ts)


def streamed(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream emits of the files that are there."""
    return streamed_in_turn([stream], mode)


def streamed_in_turn(arrivals: Iterable[DataFrame], mode: str = "append") -> DataFrame:
    """All that one stream emits which is run again, from its checkpoint, each time that more has come."""
    out = None
    for stream in arrivals:
        spark = stream.sparkSession
        out, checkpoint = (out, checkpoint) if out else (shared_dir(spark, "stream"), shared_dir(spark, "stream-checkpoint"))
        stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def arriving(rows: DataFrame) -> DataFrame:
    path = shared_dir(rows.sparkSession, "arriving")
    rows.write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


def arriving_in_order(rows: DataFrame, ts: str, parts: int) -> Iterator[DataFrame]:
    """Rows as a stream, given once for each of equal stretches of the time, when that one has come too: run from its checkpoint each time, it has a micro-batch
    a stretch, of as many files as there are tasks to write it."""
    spark, path = rows.sparkSession, shared_dir(rows.sparkSession, "arriving")
    at = F.unix_micros(ts)
    ends = rows.agg(F.min(at).alias("low"), (F.max(at) - F.min(at) + 1).alias("span"))
    dealt = rows.join(F.broadcast(ends)).withColumn("part", F.floor((at - F.col("low")) * parts / F.col("span"))).drop("low", "span")
    for k in range(parts):
        dealt.filter(F.col("part") == k).drop("part").write.mode("append").parquet(path)
        yield spark.readStream.schema(rows.schema).parquet(path)


@query("fx_headline", "select concat('news-', substr(md5(link), 1, 12)) as external_id, title, date_trunc('minute', published_at) as occurred_at, concat('C', id % 5) as country, concat(source, '.example.org') as domain from fx_headline where id % 3 <> 0")
def article_index(headlines):
    rows = headlines.select(
        "id", F.col("link").alias("url"), "title", F.date_format("published_at", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"), F.concat("source", F.lit(".example.org")).alias("domain"),
        F.when(F.col("id") % 3 == 0, "German").otherwise("English").alias("language"), F.concat(F.lit("C"), F.col("id") % 5).alias("sourcecountry"),
    )
    items = feeds.normalise_article(feeds.read_article_index(headlines.sparkSession, json_files(rows, "articles", "id")))
    return items.select("external_id", "title", wall_clock("occurred_at"), "country", "domain")


@query("fx_headline", "with i as (select 'source-' || substr(md5(link), 1, 12) as source_id, concat('news-', substr(md5(link), 1, 12)) as external_id from fx_headline) select distinct source_id, external_id from i")
def item_sources(headlines):
    rows = headlines.select("id", F.col("link").alias("url"), "title", F.lit("20240102T030405Z").alias("seendate"), F.col("source").alias("domain"), F.lit("English").alias("language"), F.lit("X").alias("sourcecountry"))
    items = feeds.normalise_article(feeds.read_article_index(headlines.sparkSession, json_files(rows, "articles", "id")))
    sources, links = feeds.sources_of(items)
    return links.join(sources.select("source_id"), "source_id").select("source_id", "external_id")


# every third file has entries instead of items; every fifth item has a guid only, every seventh no title
@query("fx_event", f"select concat('A & B ', id) as title, concat('http://x.example/', id) as link, date_trunc('second', occurred_at) as published_at, concat('text of ', id) as description from fx_event where id // {PER_FILE} % 3 = 0 or id % 7 <> 0")
def feed_xml(events):
    at, n, file = F.col("occurred_at"), F.col("id").cast("string"), F.floor(F.col("id") / PER_FILE)
    link = F.concat(F.lit("http://x.example/"), n)
    item = F.concat(
        F.lit("<item>"), F.when(F.col("id") % 7 == 0, "").otherwise(F.concat(F.lit("<title>A &amp;amp; B "), n, F.lit("</title>"))),
        F.when(F.col("id") % 5 == 0, F.concat(F.lit("<guid>"), link, F.lit("</guid>"))).otherwise(F.concat(F.lit("<link>"), link, F.lit("</link>"))),
        F.lit("<pubDate>"), F.date_format(at, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate><description>&lt;p&gt;text of "), n, F.lit("&lt;/p&gt;</description></item>"),
    )
    entry = F.concat(F.lit("<entry><title>A &amp;amp; B "), n, F.lit("</title><link href='"), link, F.lit("'/><updated>"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated><summary>text of "), n, F.lit("</summary></entry>"))
    whole_seconds = events.withColumn("occurred_at", F.date_trunc("second", at).cast("timestamp_ntz"))
    rows = whole_seconds.select(file.alias("file"), "id", F.when(file % 3 == 0, entry).otherwise(item).alias("x"))
    parts = rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "x"))), lambda r: r["x"]), "").alias("x"))
    kinds = [(F.col("file") % 3 == 0, "feed"), (F.lit(True), "rss")]
    value = F.coalesce(*(F.when(when, F.concat(F.lit(f"<{tag}>"), "x", F.lit(f"</{tag}>"))) for when, tag in kinds))
    found = feeds.read_feed_xml(events.sparkSession, text_files(parts.select("file", value.alias("value"))), AS_OF)
    return found.select("title", "link", wall_clock("published_at"), "description")


@query("fx_event", "select latitude, longitude, cast(case when frp >= 150 then 4 when frp >= 80 then 3 when frp >= 40 then 2 else 1 end as int) as severity, date_trunc('minute', occurred_at) as occurred_at from (select *, id % 200 + 0.5 as frp from fx_event) where frp >= 20 and id % 4 <> 0 and id % 9 <> 0")
def thermal_csv(events):
    rows = events.select(
        "latitude", "longitude", F.lit(300.0).alias("bright_ti4"), F.date_format("occurred_at", "yyyy-MM-dd").alias("acq_date"), F.date_format("occurred_at", "Hmm").alias("acq_time"),
        F.when(F.col("id") % 4 == 0, "low").otherwise("nominal").alias("confidence"), F.when(F.col("id") % 9 == 0, "NaN").otherwise((F.col("id") % 200 + 0.5).cast("string")).alias("frp"), F.lit("D").alias("daynight"),
    )
    path = shared_dir(events.sparkSession, "feed")
    rows.write.option("header", True).csv(path)
    return feeds.normalise_thermal(feeds.read_thermal_csv(events.sparkSession, path)).select("latitude", "longitude", "severity", wall_clock("occurred_at"))


@query("fx_event fx_box", "select e.latitude, e.longitude, date_trunc('minute', occurred_at) as occurred_at, arg_min(b.country, seq) as country, cast(case when frp >= 80 then 65 when frp >= 40 then 55 else 45 end as int) as confidence_score from (select *, id % 200 + 0.5 as frp from fx_event) e join fx_box b on latitude between min_lat and max_lat and longitude between min_lon and max_lon where frp >= 20 group by id, 1, 2, 3, 5")
def thermal_boxes(events, boxes):
    rows = events.select("latitude", "longitude", F.lit(300.0).alias("bright_ti4"), F.date_format("occurred_at", "yyyy-MM-dd").alias("acq_date"), F.date_format("occurred_at", "HHmm").alias("acq_time"), F.lit("nominal").alias("confidence"), (F.col("id") % 200 + 0.5).alias("frp"), F.lit("D").alias("daynight"))
    path = shared_dir(events.sparkSession, "feed")
    rows.write.option("header", True).csv(path)
    return feeds.normalise_thermal(feeds.read_thermal_csv(events.sparkSession, path), boxes).select("latitude", "longitude", wall_clock("occurred_at"), "country", "confidence_score")


@query("fx_fix", "select fix_id, object_id % 3 as side from fx_fix where fix_id % 90 = 35 or object_id % 3 <> 0")
def kept_vessels(fixes):
    sides = fixes.select("fix_id", (F.col("object_id") % 3).alias("side"), F.when(F.col("fix_id") % 90 != 0, F.col("fix_id") % 90).alias("ship_type"))
    return feeds.kept_vessels(sides.withColumn("side", F.when(F.col("side") == 0, "neutral").otherwise(F.col("side").cast("string")))).select("fix_id", F.when(F.col("side") == "neutral", 0).otherwise(F.col("side").try_cast("int")).cast("long").alias("side"))


@query("fx_event", "select concat('quake-e', id) as external_id, cast(case when m >= 7 then 5 when m >= 6 then 4 when m >= 5 then 3 else 2 end as int) as severity, cast(case when m >= 6 then 50 when m >= 5 then 20 else 10 end as int) as location_radius_km, case id % 3 when 0 then 'United States' when 1 then 'Chile' else 'Unknown' end as country, latitude, longitude, date_trunc('millisecond', occurred_at) as occurred_at from (select *, 3 + id % 50 / 10.0 as m from fx_event) where m >= 4 and id % 11 <> 0")
def seismic_geojson(events):
    place = F.when(F.col("id") % 3 == 0, "5 km N of X, CA").when(F.col("id") % 3 == 1, "coast, Chile")
    properties = F.struct((3 + F.col("id") % 50 / F.lit(10.0)).alias("mag"), place.alias("place"), F.unix_millis(F.col("occurred_at").cast("timestamp")).alias("time"), F.when(F.col("id") % 11 == 0, "quarry blast").otherwise("earthquake").alias("type"), F.col("title").alias("title"))
    rows = events.select(F.col("id").alias("n"), F.concat(F.lit("e"), "id").alias("id"), properties.alias("properties"), F.struct(F.array("longitude", "latitude", F.lit(10.0)).alias("coordinates")).alias("geometry"))
    found = feeds.normalise_seismic(feeds.read_seismic_geojson(events.sparkSession, json_files(rows, "features", "n")))
    return found.select("external_id", "severity", "location_radius_km", "country", "latitude", "longitude", wall_clock("occurred_at"))


@query("fx_fix", "select concat('a', fix_id) as object_id, lat, lon, cast(case when fix_id % 5 = 0 then 0 else fix_id % 400 end as double) as altitude_ft, fix_id % 5 = 0 or fix_id % 400 < 100 as on_ground from fx_fix where fix_id % 13 <> 0 and lat between 10 and 45 and lon between 20 and 70 and fix_id % 2 = 0")
def aircraft_objects(fixes):
    n = F.col("fix_id")
    rows = fixes.select(
        "fix_id", F.concat(F.lit("A"), n).alias("hex"), F.when(n % 2 == 0, "RCH12 ").otherwise("CIV9").alias("flight"), F.when(n % 13 != 0, F.col("lat")).alias("lat"), "lon",
        F.when(n % 5 == 0, "ground").otherwise((n % 400).cast("string")).alias("alt_baro"), F.lit(100.0).alias("gs"), F.lit(90.0).alias("track"), F.lit("A1").alias("category"),
    )
    found = feeds.read_aircraft_objects(fixes.sparkSession, json_files(rows, "ac", "fix_id"))
    return feeds.kept_tracks(found, [], ["RCH"]).select("object_id", "lat", "lon", "altitude_ft", "on_ground")


@query("fx_fix", "select concat('v', fix_id) as object_id, concat('C', fix_id % 3) as country, lat, lon, cast(floor(fix_id % 9000 * 3.281 + 0.5) as bigint) as altitude_ft, cast(floor(fix_id % 300 * 1.944 + 0.5) as bigint) as speed_kt from fx_fix where fix_id % 10 <> 0")
def aircraft_vectors(fixes):
    n = F.col("fix_id")
    slots = [F.concat(F.lit("v"), n), F.lit("CALL "), F.concat(F.lit("C"), n % 3), None, None, F.col("lon"), F.when(n % 10 != 0, F.col("lat")), n % 9000, F.lit(False), n % 300, F.lit(90)]
    values = F.array(*(F.lit(None).cast("string") if x is None else x.cast("string") for x in slots), *[F.lit(None).cast("string")] * 6)
    rows = fixes.select("fix_id", values.alias("v")).groupBy(F.floor(n / PER_FILE).alias("file")).agg(F.to_json(F.struct(F.lit(1).alias("time"), F.collect_list("v").alias("states"))).alias("value"))
    return feeds.read_aircraft_vectors(fixes.sparkSession, text_files(rows)).select("object_id", "country", "lat", "lon", "altitude_ft", "speed_kt")


def vessel_files(fixes: DataFrame) -> str:
    n = F.col("fix_id")
    position = F.create_map(F.lit("PositionReport"), F.struct((n % 120).cast("double").alias("Sog"), (n % 400).cast("double").alias("TrueHeading"), F.lit(None).cast("int").alias("Type"), F.lit(None).cast("string").alias("Destination")))
    static = F.create_map(F.lit("ShipStaticData"), F.struct(F.lit(None).cast("double").alias("Sog"), F.lit(None).cast("double").alias("TrueHeading"), (n % 90).cast("int").alias("Type"), F.concat(F.lit("P"), n % 7, F.lit(" ")).alias("Destination")))
    head = F.struct(F.when(n % 17 == 0, 0).otherwise(n).alias("MMSI"), F.when(n % 19 == 0, 0.0).otherwise(F.col("lat")).alias("latitude"), F.col("lon").alias("longitude"), F.lit(" Ship ").alias("ShipName"))
    kind = F.when(n % 3 == 0, "ShipStaticData").otherwise("PositionReport")
    rows = fixes.select(kind.alias("MessageType"), head.alias("MetaData"), F.when(n % 3 == 0, static).otherwise(position).alias("Message"))
    path = shared_dir(fixes.sparkSession, "feed")
    rows.write.json(path)
    return path


VESSELS = "select fix_id as object_id, 'Ship' as name, lat, lon, cast(case when fix_id % 120 > 102 then 0 else fix_id % 120 end as double) as speed_kt, cast(case when fix_id % 400 > 360 then 0 else fix_id % 400 end as double) as heading from fx_fix where fix_id % 3 <> 0 and fix_id % 17 <> 0 and fix_id % 19 <> 0"


@query("fx_fix", VESSELS)
def vessel_reports(fixes):
    return feeds.vessel_positions(feeds.read_vessel_messages(fixes.sparkSession, vessel_files(fixes)))


@query("fx_fix", VESSELS)
def vessel_reports_streamed(fixes):
    return streamed(feeds.vessel_positions(feeds.read_vessel_stream(fixes.sparkSession, vessel_files(fixes))))


@query("fx_fix", "select fix_id as object_id, 'Ship' as name, cast(fix_id % 90 as int) as ship_type, concat('P', fix_id % 7) as destination from fx_fix where fix_id % 3 = 0 and fix_id % 17 <> 0")
def vessel_statics(fixes):
    return feeds.vessel_static(feeds.read_vessel_messages(fixes.sparkSession, vessel_files(fixes)))


@query("fx_event", "select occurred_at as timestamp, concat('A \"', id % 7, '\"') as country, title as city, 'mobile' as device from fx_event where id % 3 <> 0")
def visit_log(events):
    seen = events.select(
        F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.concat(F.lit('A "'), F.col("id") % 7, F.lit('"')).alias("country"), F.col("title").alias("city"), F.lit("r").alias("region"),
        F.lit("").alias("referrer"), F.when(F.col("id") % 3 == 0, "10.0.0.1").otherwise("8.8.8.8").alias("address"), F.lit("an iPhone").alias("agent"),
    )
    path = shared_dir(events.sparkSession, "feed")
    feeds.append_visits(feeds.counted_visits(seen).select("timestamp", "country", "city", "region", "referrer", "device"), path)
    return feeds.read_visits(events.sparkSession, path).select(wall_clock("timestamp"), "country", "city", "device")


@query("fx_grid", "select lat, lon, population from fx_grid")
def population_table(grid):
    path = shared_dir(grid.sparkSession, "grid")
    grid.select("lat", "lon", F.col("population").cast("long").alias("population")).write.parquet(path)
    return feeds.read_population_grid(grid.sparkSession, path)


@query("fx_event", "select concat('p', id) as place_id, cast(id % 100 as double) as current_popularity, '0,1,2' as hours from fx_event")
def popularity_places(events):
    points = F.transform(F.array(F.lit(2), F.lit(0), F.lit(1)), lambda h: F.struct(h.cast("string").alias("at"), (F.col("id") % 7 + h).cast("double").alias("value")))
    rows = events.select("id", F.concat(F.lit("p"), "id").alias("place_id"), F.col("title").alias("name"), (F.col("id") % 100).cast("double").alias("current_popularity"), F.lit(False).alias("is_spike"), F.lit(False).alias("is_closed_now"), points.alias("sparkline"))
    found = feeds.read_popularity(events.sparkSession, json_files(rows, "places", "id"))
    return found.select("place_id", "current_popularity", F.array_join(F.transform("sparkline", lambda p: p["at"]), ",").alias("hours"))


@query("fx_event", f"select id, occurred_at, {NOW} as first_seen_at, cast(occurred_at as date) as date from fx_event")
def appended_events(events):
    path = shared_dir(events.sparkSession, "events")
    for part in (F.col("id") % 2 == 0, F.col("id") % 2 == 1):
        sinks.append_events(events.filter(part).select("id", "occurred_at"), path, AS_OF)
    return events.sparkSession.read.parquet(path).select("id", "occurred_at", "first_seen_at", "date")


@query("fx_event", f"select id, occurred_at, {NOW} as first_seen_at, cast(occurred_at as date) as date, case when id % 2 = 0 then 'even' else 'odd' end as run from fx_event")
def appended_runs(events):
    """Two runs; the first was made with half of its events before."""
    path = shared_dir(events.sparkSession, "events")
    for run, part in (("even", F.col("id") % 4 == 0), ("even", F.col("id") % 2 == 0), ("odd", F.col("id") % 2 != 0)):
        sinks.append_events(events.filter(part).select("id", "occurred_at"), path, AS_OF, run)
    return events.sparkSession.read.parquet(path).select("id", "occurred_at", "first_seen_at", "date", "run")


@query("fx_event", "select 'new_event' as type, '{\"id\":' || id || ',\"country\":\"' || country || '\"}' as payload from fx_event")
def change_messages(events):
    return sinks.change_feed(events.select("id", "country"), "new_event")


@query("fx_event", "select 'first' as run, 'completed' as status, count(*) as fetched, count(*) filter (where id % 3 = 0) as created, count(*) filter (where id % 3 = 1) as updated, cast(null as varchar) as error from fx_event union all select 'second', 'failed', null, null, null, 'wrong: ' || (select max(id) from fx_event)")
def ingestion_runs(events):
    """A run that writes all events, and one that fails at the last."""
    spark = events.sparkSession
    log, out = shared_dir(spark, "runs"), shared_dir(spark, "run-out")
    change = F.when(F.col("id") % 3 == 0, "insert").when(F.col("id") % 3 == 1, "update").otherwise("none")
    changes = events.select("id", change.alias("change"))
    runs.recorded(changes, log, "first", lambda df: df.write.parquet(f"{out}/first"))
    last = changes.agg(F.max("id").alias("last"))

    def failing(df):
        wrong = F.when(F.col("id") == F.col("last"), F.raise_error(F.concat(F.lit("wrong: "), "id")).cast("long")).otherwise(F.col("id"))
        df.join(F.broadcast(last)).select(wrong.alias("id")).write.parquet(f"{out}/second")

    try:
        runs.recorded(changes, log, "second", failing)
    except Exception as error:
        if "wrong: " not in str(error):
            raise
    return runs.runs(spark, log).select("run", "status", "fetched", "created", "updated", F.nullif(F.regexp_extract("error", "wrong: [0-9]+", 0), F.lit("")).alias("error"))


# windows close when they end before the latest time less the delay
@query("fx_event", "select date_trunc('hour', occurred_at)::timestamp as hour, country, count(*) as n from fx_event where date_trunc('hour', occurred_at) + interval 1 hour <= (select max(occurred_at) from fx_event) - interval 1 hour group by 1, 2")
def hourly_events_streamed(events):
    rows = events.select("country", F.col("occurred_at").cast("timestamp").alias("occurred_at"))
    return streamed(streams.hourly_events(arriving(rows), "country")).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "country", "n")


@query("fx_event", "with w as (select date_trunc('hour', occurred_at)::timestamp - to_hours(h) as start, concat(floor(latitude)::bigint, ',', floor(longitude)::bigint) as cell, event_type from fx_event, range(24) as r(h)) select start, cell, count(distinct event_type) as types, count(*) as total from w where start + interval 24 hours <= (select max(occurred_at) from fx_event) - interval 24 hours group by 1, 2 having count(distinct event_type) >= 3")
def convergence_streamed(events):
    rows = events.select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("event_type").alias("kind"), F.col("occurred_at").cast("timestamp").alias("ts"))
    found = streamed(streams.convergence(arriving(rows)))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "cell", F.col("types").cast("long").alias("types"), "total")


@query("fx_headline", "select min(id) as id, source, title from fx_headline group by source, link, title")
def distinct_headlines_streamed(headlines):
    rows = headlines.select("id", "source", "link", "title", F.col("published_at").cast("timestamp").alias("published_at"))
    return streamed(streams.distinct_headlines(arriving(rows.unionByName(rows)))).select("id", "source", "title")


# ---- streams with state


def closed_only(table: str) -> str:
    """Hourly counts whose window ends before the latest time less the delay."""
    return f"hourly as (select event_type, date_trunc('hour', occurred_at)::timestamp as hour, count(*) as n from {table} where date_trunc('hour', occurred_at) + interval 1 hour <= (select max(occurred_at) from {table}) - interval 1 hour group by 1, 2)"


@query("fx_event", ORACLE_SQL["baseline_anomalies"][ORACLE_SQL["baseline_anomalies"].index("hourly as") :].replace(ORACLE_SQL["baseline_anomalies"][ORACLE_SQL["baseline_anomalies"].index("hourly as") : ORACLE_SQL["baseline_anomalies"].index(", t as")], "with " + closed_only("fx_event")))
def baseline_alerts_streamed(events):
    rows = events.select("event_type", F.col("occurred_at").cast("timestamp").alias("occurred_at"))
    hourly = streamed(streams.hourly_events(arriving(rows), "event_type")).select("event_type", F.col("window.start").alias("hour"), "n")
    found = streamed(baselines.baseline_alerts(arriving(hourly), "event_type"))
    return found.select("event_type", F.timestamp_millis("ms").cast("timestamp_ntz").alias("hour"), "n", F.round("mean", 4).alias("mean"), F.round("z", 4).alias("z"))


ORACLE_SQL["baseline_alerts_streamed"] = ORACLE_SQL["baseline_alerts_streamed"].replace("with ", "with recursive ", 1)


# coarse cells, so that small tables have some
@query("fx_event", "with w as (select date_trunc('hour', occurred_at)::timestamp - to_hours(h) as start, concat(floor(latitude / 6)::bigint, ',', floor(longitude / 6)::bigint) as cell, event_type from fx_event, range(24) as r(h)), g as (select start, cell from w where start + interval 24 hours <= (select max(occurred_at) from fx_event) - interval 24 hours group by 1, 2 having count(distinct event_type) >= 3) select distinct cell, cast(start + interval 24 hours as date) as day from g")
def convergence_alerts_streamed(events):
    rows = events.select((F.col("latitude") / 6).alias("lat"), (F.col("longitude") / 6).alias("lon"), F.col("event_type").alias("kind"), F.col("occurred_at").cast("timestamp").alias("ts"))
    return streamed(streams.convergence_alerts(arriving(rows)))


@query("fx_fix", "with s as (select object_id, updated_at, fix_id, fix_id % 7 as ship_type from fx_fix where fix_id % 10 = 1), p as (select object_id, updated_at, lat, lon from fx_fix where fix_id % 10 <> 1) select p.object_id, epoch_us(p.updated_at) as us, p.lat, p.lon, (select arg_max(concat('n', s.ship_type), s.updated_at) from s where s.object_id = p.object_id and s.updated_at <= p.updated_at) as name, (select arg_max(s.ship_type, s.updated_at) from s where s.object_id = p.object_id and s.updated_at <= p.updated_at) as ship_type from p")
def with_static_streamed(fixes):
    is_static, value = F.col("fix_id") % 10 == 1, F.col("fix_id") % 7
    rows = fixes.select(
        "object_id", F.col("updated_at").cast("timestamp").alias("updated_at"), F.when(is_static, "static").otherwise("position").alias("kind"), F.when(~is_static, F.col("lat")).alias("lat"), F.when(~is_static, F.col("lon")).alias("lon"),
        F.when(is_static, F.concat(F.lit("n"), value)).alias("name"), F.when(is_static, value).alias("ship_type"),
    )
    return streamed(streams.with_static(arriving(rows)))


@query("fx_fix", "select object_id, epoch_us(updated_at) // 1000 as ms, lat, lon from (select *, row_number() over (partition by object_id order by updated_at desc, fix_id) as nth from fx_fix) where nth = 1")
def latest_positions_streamed(fixes):
    rows = fixes.select("fix_id", "object_id", "lat", "lon", F.col("updated_at").cast("timestamp").alias("updated_at"))
    spark = fixes.sparkSession
    out = shared_dir(spark, "positions")
    streams.per_batch(streams.latest_positions(arriving(rows), order="fix_id"), shared_dir(spark, "stream-checkpoint"), lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"), mode="update").awaitTermination()
    return spark.read.parquet(out).groupBy("object_id").agg(F.max_by(F.struct("ms", "lat", "lon"), F.struct("us", -F.col("seq"))).alias("f")).select("object_id", "f.*")


# half of the reports come in a second file
@query("fx_event", "with t as (select external_id, arg_max(event_type, id) as event_type from fx_event group by 1), f as (" + FOLD + ") select external_id, event_type, confidence from f join t using (external_id)")
def upserted_events_streamed(events):
    spark = events.sparkSession
    path, table = shared_dir(spark, "arriving"), shared_dir(spark, "upserted")
    rows = events.select("id", "external_id", "confidence_score", "event_type")
    half = events.agg((F.floor(F.max("id") / 2)).alias("half"))
    parts = rows.join(F.broadcast(half))
    for when in (F.col("id") < F.col("half"), F.col("id") >= F.col("half")):
        parts.filter(when).drop("half").write.mode("append").parquet(path)
        streams.upsert_stream(spark.readStream.schema(rows.schema).parquet(path), table, f"{table}-feed", f"{table}-checkpoint", buckets=32).awaitTermination()
    return streams.current_table(spark, table, 1).select("external_id", "event_type", "confidence")


@query("fx_headline", TERMS.replace("from fx_headline where", "from (select min(id) as id, source, link, title, min(published_at) as published_at from fx_headline group by source, link, title) where"))
def trending_streamed(headlines):
    spark = headlines.sparkSession
    table = shared_dir(spark, "trending")
    rows = headlines.select("source", "link", "title", F.col("published_at").cast("timestamp").alias("published_at")).filter(F.col("published_at") <= F.lit(AS_OF).cast("timestamp"))
    trends.trending_stream(arriving(rows), table, f"{table}-out", f"{table}-checkpoint", blocked=("near", "over")).awaitTermination()
    found = spark.read.parquet(f"{table}-out").drop("batch", "found_at")
    return found.withColumn("baseline", F.round("baseline", 4)).withColumn("multiplier", F.round("multiplier", 4))


# four stretches of time: what is live is carried from one to the next
@query("fx_headline")
def clusters_streamed(headlines):
    spark = headlines.sparkSession
    table = shared_dir(spark, "clusters")
    rows = headlines.select("id", "title", "source", "tier", F.col("published_at").cast("timestamp").alias("published_at"))
    for stream in arriving_in_order(rows, "published_at", 4):
        clusters.cluster_stream(stream, table, f"{table}-out", f"{table}-checkpoint", d.COMMON_WORDS).awaitTermination()
    return spark.read.parquet(f"{table}-out").select("id", "cluster_id")


@query("fx_headline", ORACLE_SQL["breaking_alerts"][ORACLE_SQL["breaking_alerts"].index("gate as (select id, published_at") :].replace("gate as (", "with gate as (", 1))
def breaking_alerts_streamed(headlines):
    """The cooldown in keyed state, over what passes the gate."""
    gated = gated_headlines(headlines).select("id", "title", F.col("published_at").cast("timestamp").alias("published_at"))
    return streamed(streams.cooldown_alerts(arriving(gated))).select("id", "key")


ORACLE_SQL["breaking_alerts_streamed"] = ORACLE_SQL["breaking_alerts_streamed"].replace("with ", "with recursive ", 1)


TICKS = """with closed as (select lower(trim(country)) as country, date_trunc('hour', occurred_at)::timestamp as hour, count(*) as n, sum(case severity when 1 then 0.5 when 2 then 1.0 when 3 then 1.5 when 4 then 2.0 when 5 then 3.0 else 1.0 end * case event_type when 'missile' then 2.0 when 'airstrike' then 2.0 when 'explosion' then 1.5 when 'drone' then 1.5 else 1.0 end) as weight
 from fx_event where trim(country) <> '' and date_trunc('hour', occurred_at) + interval 1 hour <= (select max(occurred_at) from fx_event) - interval 1 hour group by 1, 2),
newest as (select max(hour) as newest from closed),
spans as (select country, min(hour) as low, max(hour) as high from closed group by 1),
spine as (select country, unnest(generate_series(low, greatest(high, newest - interval 1 hour), interval 1 hour)) as hour from spans, newest),
full_ as (select s.country, s.hour, coalesce(n, 0) as n, coalesce(weight, 0) as weight from spine s left join closed using (country, hour)),
t as (select country, hour, sum(n) over week as n, sum(weight) over week as weight, row_number() over (partition by country order by hour) as ticks, sum(n) over (partition by country order by hour rows between 23 preceding and current row) as recent, sum(n) over (partition by country order by hour rows between 47 preceding and 24 preceding) as older
 from full_ window week as (partition by country order by hour rows between 167 preceding and current row)),
r as (select *, case when ticks < 48 then 'stable' when coalesce(older, 0) = 0 then case when recent > 0 then 'accelerating' else 'stable' end when recent / older > 1.3 then 'accelerating' when recent / older < 0.7 then 'decelerating' else 'stable' end as trend from t),
s as (select country, hour, cast(n as bigint) as n, trend, cast(greatest(0, least(100, floor(least(40.0, n / 50.0 * 40.0) + least(30.0, weight / 150.0 * 30.0) + case trend when 'accelerating' then 10 when 'decelerating' then -5 else 0 end + case when country in ('nation_1', 'nation_5') then 10 else 0 end + case when country in ('nation_2', 'nation_5') then 10 else 0 end + 0.5))) as bigint) as score from r)
select country, hour, n, trend, score from s"""


@query("fx_event", TICKS)
def instability_streamed(events):
    """A score of each country for each hour, from a stream of closed hours."""
    signals = signals_of(events).withColumn("ts", F.col("ts").cast("timestamp"))
    hourly = streamed(instability.hourly_signals(arriving(signals), instability.signal_weight(SEVERITY_WEIGHTS, CATEGORY_RISK)))
    found = streamed_in_turn(instability.instability_ticks(hours, SANCTIONED, CONFLICT) for hours in arriving_in_order(hourly, "hour", 4))
    return found.select("country", F.timestamp_millis("ms").cast("timestamp_ntz").alias("hour"), "n", "trend", "score")


HISTORY = f"""with {DAILY}, w as (select country, time, score, lag(score) over (partition by country order by time) as p, row_number() over (partition by country order by time) as nth from daily),
h as (select *, count(*) over r as points, regr_slope(score, nth) over r as line, score - first_value(score) over r as change from w window r as (partition by country order by time range between interval 24 hours preceding and current row)),
f as (select *, epoch(time) as s, case when points < 3 then 0.0 else round(line, 9) end as slope, case when p is null then null when floor(score) > floor(p) and score >= 2 then 'threshold' when score - p >= 0.5 then 'jump' when p < 4.5 and score >= 4.5 then 'critical' end as found from h),
g as (select * from f where found is not null),
kept as (select country, min(s) as s from g group by 1 union all select k.country, (select min(g.s) from g where g.country = k.country and g.s >= k.s + 7200) as s from kept k where exists (select 1 from g where g.country = k.country and g.s >= k.s + 7200))
select f.country, time, round(slope, 4) + 0.0 as slope, case when slope > 0.1 then 'escalating' when slope < -0.1 then 'de-escalating' else 'stable' end as trend, round(change, 1) + 0.0 as change_24h, case when k.s is not null then found end as signal from f left join kept k on k.country = f.country and k.s = f.s and f.found is not null"""


@query("fx_event", HISTORY)
def escalation_streamed(events):
    """Slope, trend, change and signal of every score, from keyed state."""
    scores = daily_scores(events).select(F.col("country").alias("id"), F.col("time").cast("timestamp").alias("at"), "score")
    found = streamed_in_turn(escalation.escalation_history(times) for times in arriving_in_order(scores, "at", 3))
    trend = F.when(F.col("slope") > 0.1, "escalating").when(F.col("slope") < -0.1, "de-escalating").otherwise("stable")
    return found.select(F.col("id").alias("country"), F.timestamp_millis("ms").cast("timestamp_ntz").alias("time"), (F.round("slope", 4) + 0.0).alias("slope"), trend.alias("trend"), (F.round("change_24h", 1) + 0.0).alias("change_24h"), "signal")


ORACLE_SQL["escalation_streamed"] = ORACLE_SQL["escalation_streamed"].replace("with ", "with recursive ", 1)


# the hours of the first half go into one stream, what it holds is saved, and another stream goes on from there
@query("fx_event", ORACLE_SQL["baseline_alerts_streamed"][ORACLE_SQL["baseline_alerts_streamed"].index("hourly as") :].replace("hourly as", "with hourly as", 1))
def baselines_restored(events):
    spark = events.sparkSession
    hourly = streamed(streams.hourly_events(arriving(events.select("event_type", F.col("occurred_at").cast("timestamp").alias("occurred_at"))), "event_type")).select("event_type", F.col("window.start").alias("hour"), "n")
    ends = hourly.agg(F.min("hour").alias("low"), F.max("hour").alias("high")).first()
    folder, state = shared_dir(spark, "baselines"), shared_dir(spark, "stream-checkpoint")
    if ends.low is None:
        return hourly.select("event_type", F.col("hour").cast("timestamp_ntz").alias("hour"), "n", F.lit(0.0).alias("mean"), F.lit(0.0).alias("z")).limit(0)
    half = F.lit(ends.low + (ends.high - ends.low) / 2)
    early = baselines.baseline_alerts(arriving(hourly.filter(F.col("hour") < half)), "event_type")
    early.writeStream.format("parquet").option("path", f"{folder}-alerts").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    baselines.save_baselines(baselines.state_table(spark, state, "event_type"), folder)
    late = streamed(baselines.baseline_alerts(arriving(hourly.filter(F.col("hour") >= half)), "event_type", baselines.load_baselines(spark, folder)))
    found = spark.read.schema(late.schema).parquet(f"{folder}-alerts").unionByName(late)
    return found.select("event_type", F.timestamp_millis("ms").cast("timestamp_ntz").alias("hour"), "n", F.round("mean", 4).alias("mean"), F.round("z", 4).alias("z"))


ORACLE_SQL["baselines_restored"] = ORACLE_SQL["baselines_restored"].replace("with ", "with recursive ", 1)


def body_of(name: str) -> str:
    """A query's SQL as a table."""
    return f"({ORACLE_SQL[name]})"


@query("fx_headline fx_event fx_fix", f"select 'trending_spikes' as type, count(*) as n, cast(sum(recent_count) as bigint) as total from {body_of('trending_terms')} union all select 'convergence_alerts', count(*), cast(sum(score) as bigint) from {body_of('convergence_cells')} union all select 'breaking_alerts', count(*), cast(sum(id) as bigint) from {body_of('breaking_alerts')}")
def detector_feed(headlines, events, fixes):
    """What three detectors found, through the outbox into a feed, sent again as after a failure."""
    spark = headlines.sparkSession
    folder = shared_dir(spark, "outbox")
    box = outbox.Outbox(spark, folder)
    found = {"trending_spikes": lambda: trending_terms(headlines), "convergence_alerts": lambda: convergence_cells(events, fixes), "breaking_alerts": lambda: breaking_gate(headlines).select("id", "title")}
    for _ in range(2):
        for name, detector in found.items():
            box.put(0, name, lambda name=name, detector=detector: outbox.detector_messages(detector(), name))
        box.send({"feed": lambda messages, key: messages.write.mode("append").parquet(f"{folder}/feed")})
    rows = spark.read.parquet(f"{folder}/feed").select("type", F.explode(F.from_json("payload", "array<struct<recent_count: long, score: long, id: long>>")).alias("row"))
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.coalesce("row.recent_count", "row.score", "row.id")).alias("total"))
