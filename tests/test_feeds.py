"""Readers over small files, each with a bad row, and writers."""

import json

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidewatch.plans import feeds as plans  # noqa: F401  registers its queries
from tidewatch.plans.queries import ORACLE_SQL, QUERIES
from tidewatch.sources import feeds, sinks
from tidewatch.streaming import streams

from .oracle import same

AS_OF = "2024-01-31 00:00:00"


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return f"file://{tmp_path / name}"


def test_articles(spark, tmp_path):
    rows = {"articles": [{"url": "http://a", "title": "T", "seendate": "20240102T030459Z", "domain": "a.org", "language": "English", "sourcecountry": "X"}, {"url": "http://b", "title": "U", "seendate": "never", "language": "German"}]}
    df = feeds.read_article_index(spark, put(tmp_path, "a.json", json.dumps(rows)))
    assert [str(r.seendate) for r in df.orderBy("url").collect()] == ["2024-01-02 03:04:00", "None"]
    items = feeds.normalise_article(df)
    assert items.count() == 1
    sources, links = feeds.sources_of(items)
    assert sources.count() == links.count() == 1


def test_rss_and_atom(spark, tmp_path):
    put(tmp_path, "r.xml", "<rss><channel><item><title>A &amp;amp; B</title><guid>http://g</guid><pubDate>Wed, 31 Jan 2024 10:00:00 GMT</pubDate><description>&lt;p&gt;x&lt;/p&gt;</description></item><item><title>no link</title></item></channel></rss>")
    put(tmp_path, "s.xml", "<feed><entry><title>E</title><link href='http://e'/><updated>2024-01-30T00:00:00Z</updated><summary>s</summary></entry></feed>")
    rows = {r.link: r for r in feeds.read_feed_xml(spark, f"file://{tmp_path}", AS_OF).collect()}
    assert set(rows) == {"http://g", "http://e"}
    assert rows["http://g"].title == "A & B" and rows["http://g"].description == "x"
    assert str(rows["http://g"].published_at) == "2024-01-31 10:00:00"


def test_thermal(spark, tmp_path):
    text = "latitude,longitude,bright_ti4,acq_date,acq_time,confidence,frp,daynight\n31.3,34.3,300,2024-01-02,304,nominal,85.5,D\n1,2,3,2024-01-02,1200,low,90,D\n1,2,3,2024-01-02,1200,high,NaN,D\n1,2\n"
    df = feeds.read_thermal_csv(spark, put(tmp_path, "t.csv", text))
    assert df.count() == 2
    item = feeds.normalise_thermal(df).first()
    assert (item.severity, str(item.occurred_at)) == (3, "2024-01-02 03:04:00")


def test_seismic(spark, tmp_path):
    quake = lambda i, mag, place: {"id": i, "properties": {"mag": mag, "place": place, "time": 1706659200000, "type": "earthquake", "title": "t"}, "geometry": {"coordinates": [34.0, 31.0, 5.0]}}
    df = feeds.read_seismic_geojson(spark, put(tmp_path, "q.json", json.dumps({"features": [quake("a", 6.1, "3 km of X, CA"), quake("b", 3.9, "Y"), quake("c", 4.0, None)]})))
    rows = {r.external_id: r for r in feeds.normalise_seismic(df).collect()}
    assert set(rows) == {"quake-a", "quake-c"}
    assert (rows["quake-a"].country, rows["quake-a"].severity, rows["quake-a"].location_radius_km) == ("United States", 4, 50)
    assert rows["quake-c"].country == "Unknown" and rows["quake-c"].latitude == 31.0


def test_aircraft(spark, tmp_path):
    objects = {"ac": [{"hex": "AB", "flight": "RCH1 ", "lat": 30.0, "lon": 40.0, "alt_baro": "ground", "gs": 10.0}, {"hex": "CD", "lat": None}]}
    a = feeds.read_aircraft_objects(spark, put(tmp_path, "o.json", json.dumps(objects)))
    row = a.first()
    assert (a.count(), row.altitude_ft, row.on_ground, row.callsign) == (1, 0.0, True, "RCH1")
    assert feeds.kept_tracks(a, [], ["RCH"]).count() == 1 and feeds.kept_tracks(a, [], ["XX"]).count() == 0
    states = {"time": 1, "states": [["id", "CALL ", "Iran", None, None, 50.0, 30.0, 1000, False, 100.0, 90.0, None, None, None, None, None, 0], ["bad"]]}
    v = feeds.read_aircraft_vectors(spark, put(tmp_path, "v.json", json.dumps(states))).collect()
    assert [(r.country, r.altitude_ft, r.speed_kt) for r in v] == [("Iran", 3281, 194)]


def test_vessels(spark, tmp_path):
    position = {"MessageType": "PositionReport", "MetaData": {"MMSI": 5, "latitude": 1.0, "longitude": 2.0, "ShipName": " N "}, "Message": {"PositionReport": {"Sog": 103.0, "TrueHeading": 90.0}}}
    none = {"MessageType": "PositionReport", "MetaData": {"MMSI": 0, "latitude": 1.0, "longitude": 2.0}, "Message": {"PositionReport": {"Sog": 1.0}}}
    static = {"MessageType": "ShipStaticData", "MetaData": {"MMSI": 5}, "Message": {"ShipStaticData": {"Type": 35, "Destination": "X "}}}
    messages = feeds.read_vessel_messages(spark, put(tmp_path, "m.json", "\n".join(map(json.dumps, (position, none, static)))))
    assert [(r.object_id, r.name, r.speed_kt, r.heading) for r in feeds.vessel_positions(messages).collect()] == [(5, "N", 0.0, 90.0)]
    assert [(r.ship_type, r.destination) for r in feeds.vessel_static(messages).collect()] == [(35, "X")]


def test_visits_and_popularity(spark, tmp_path):
    df = feeds.read_visits(spark, put(tmp_path, "v.csv", 'timestamp,country,city,region,referrer,device\n"2024-01-01T00:00:00Z","A ""B""","c","r","","mobile"\n'))
    assert df.first().country == 'A "B"'
    seen = spark.createDataFrame([("1.2.3.4", "iPhone Mobile"), ("10.0.0.1", "x"), ("8.8.8.8", "iPad")], "address string, agent string")
    assert sorted(r.device for r in feeds.counted_visits(seen).collect()) == ["mobile", "tablet"]
    places = {"places": [{"place_id": "p", "name": "n", "sparkline": [{"at": "2", "value": 2.0}, {"at": "1", "value": 1.0}]}]}
    assert [x["at"] for x in feeds.read_popularity(spark, put(tmp_path, "p.json", json.dumps(places))).first().sparkline] == ["1", "2"]


def test_sinks(spark, tmp_path):
    events = spark.sql("select 1 as id, timestamp_ntz '2024-01-02 03:00:00' as occurred_at")
    sinks.append_events(events, f"file://{tmp_path}/e", AS_OF)
    sinks.append_events(events, f"file://{tmp_path}/e", AS_OF)
    assert spark.read.parquet(f"file://{tmp_path}/e").filter(F.col("date") == "2024-01-02").count() == 2
    first = f"file://{tmp_path}/r"
    for run, n in (("a", 1), ("a", 2), ("b", 1), ("a", 1)):
        sinks.append_events(spark.range(n).crossJoin(events.select("occurred_at")), first, AS_OF, run)
    assert sorted((r.run, r.id) for r in spark.read.parquet(first).collect()) == [("a", 0), ("b", 0)]
    sinks.append_events(spark.range(1).selectExpr("id", "timestamp_ntz '2024-01-02 03:00:00' as occurred_at").limit(0), first, AS_OF, "b")
    assert [r.run for r in spark.read.parquet(first).select("run").collect()] == ["a"]
    assert json.loads(sinks.change_feed(events.select("id"), "new_event").first().payload) == {"id": 1}


def test_convergence_is_of_cells_of_one_degree(spark, tmp_path):
    """Kinds of neighbouring degrees do not meet: events 12000 apart have one place, the next ids are in other degrees."""
    kinds = ["error", "signup", "purchase"]
    rows = [(12_000 * i + j, f"2024-01-0{1 + i} 10:00:00", j, kinds[i % 3] if j == 0 else kinds[j % 3], 1.0, '{"k": 1}') for i in range(6) for j in (0, 81, 82)]
    rows += [(12_000 * (6 + i), "2024-01-02 11:00:00", 0, kinds[i], 1.0, '{"k": 1}') for i in range(3)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    pq.write_table(events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).toArrow(), tmp_path / "events.parquet")
    (tmp_path / "nation.parquet").symlink_to("/root/testdata/sf0.001/nation.parquet")
    found = QUERIES["convergence_streamed"](spark, str(tmp_path)).collect()
    assert {r.cell for r in found} == {"12,25"} and len(found) == 24
    same(spark, str(tmp_path), QUERIES["convergence_streamed"], ORACLE_SQL["convergence_streamed"])


def test_located_items_are_judged_by_stories(spark, tmp_path):
    """Texts of even documents are not in titles, yet count: for the kind, and for the place where the title has none."""
    texts = ["an earthquake and a drone strike", "calm", "in Beirut today", "calm", "two killed by missile attack near Gaza", None]
    rows = [(200 + i, text, "en", f"src{i}", 1) for i, text in enumerate(texts * 4)]
    spark.createDataFrame([r for r in rows if r[1]], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"file://{tmp_path}/made")
    pq.write_table(spark.read.parquet(f"file://{tmp_path}/made").toArrow(), tmp_path / "documents.parquet")
    same(spark, str(tmp_path), QUERIES["located_items"], ORACLE_SQL["located_items"])


def test_stretches_of_a_stream_are_written_by_many_tasks(spark, tmp_path):
    # one task read the whole table for each stretch and wrote it as one file
    rows = spark.range(0, 8000, 1, 4).select("id", F.timestamp_seconds(F.col("id") % 1000).alias("at"))
    batches = []

    def work(batch, n):
        batches.append((n, batch.select(F.input_file_name()).distinct().count(), batch.count(), batch.agg(F.min("id")).first()[0]))

    for stream in plans.arriving_in_order(rows, "at", 4):
        streams.per_batch(stream, f"file://{tmp_path}/cp", work).awaitTermination(120)
    assert batches == [(k, 4, 2000, 250 * k) for k in range(4)]
