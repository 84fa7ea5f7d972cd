"""Readers of landed feed files: declared schemas, bad rows dropped or nulled, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import country_of_place, hashed_id, magnitude_severity, plain_text, radiation_confidence, radiation_severity
from ..operators.spatial import box_country

ARTICLES = "articles array<struct<url:string,title:string,seendate:string,domain:string,language:string,sourcecountry:string>>"
THERMAL = "latitude double, longitude double, bright_ti4 double, acq_date string, acq_time string, confidence string, frp double, daynight string"
SEISMIC = "features array<struct<id:string,properties:struct<mag:double,place:string,time:bigint,updated:bigint,url:string,title:string,status:string,tsunami:int,sig:int,type:string,alert:string>,geometry:struct<coordinates:array<double>>>>"
AIRCRAFT = "ac array<struct<hex:string,flight:string,lat:double,lon:double,alt_baro:string,gs:double,track:double,category:string,t:string,r:string>>"
VESSEL = "MessageType string, MetaData struct<MMSI:bigint,latitude:double,longitude:double,ShipName:string>, Message map<string,struct<Sog:double,TrueHeading:double,Type:int,Destination:string>>"
VISITS = "timestamp string, country string, city string, region string, referrer string, device string"
PLACES = "places array<struct<place_id:string,name:string,current_popularity:double,is_spike:boolean,is_closed_now:boolean,sparkline:array<struct<at:string,value:double>>>>"


def feed_time(text: Column, as_of: str) -> Column:
    """RFC 822 or ISO times; as_of where neither can be read. The weekday is cut off first."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"\s+(GMT|UTC|Z)$", " +0000"))
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(text), F.lit(as_of).cast("timestamp"))


def read_article_index(spark: SparkSession, path: str) -> DataFrame:
    """Articles of news-index files; times to the minute."""
    rows = spark.read.schema(ARTICLES).option("multiLine", True).json(path).select(F.explode("articles").alias("a")).select("a.*")
    return rows.withColumn("seendate", F.date_trunc("minute", F.try_to_timestamp(F.col("seendate"), F.lit("yyyyMMdd'T'HHmmss'Z'"))))


def read_feed_xml(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """Items of RSS files, and entries of files that have no items; rows without title or link are dropped."""
    item = "title string, link string, guid string, pubDate string, description string, `content:encoded` string"
    entry = "title string, link array<struct<_href:string>>, published string, updated string, summary string, content string"
    file = F.col("_metadata.file_path").alias("file")
    rss = spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", False).schema(item).load(path).select(file, "title", F.coalesce("link", "guid").alias("link"), F.col("pubDate").alias("date"), F.coalesce("description", F.col("`content:encoded`")).alias("text"))
    atom = spark.read.format("xml").option("rowTag", "entry").schema(entry).load(path).select(file, "title", F.get("link", F.lit(0))["_href"].alias("link"), F.coalesce("published", "updated").alias("date"), F.coalesce("summary", "content").alias("text"))
    every = rss.unionByName(atom.join(rss.select("file").distinct(), "file", "left_anti"))
    filled = every.filter((F.trim("title") != "") & (F.trim("link") != ""))
    return filled.select(plain_text(F.col("title")).alias("title"), F.trim("link").alias("link"), feed_time(F.col("date"), as_of).alias("published_at"), plain_text(F.coalesce("text", F.lit(""))).alias("description"))


def read_thermal_csv(spark: SparkSession, path: str) -> DataFrame:
    """Detections; rows with too few columns or without number for frp or place are dropped."""
    rows = spark.read.schema(THERMAL).option("header", True).option("mode", "DROPMALFORMED").csv(path)
    good = [F.col(c).isNotNull() & ~F.isnan(c) for c in ("frp", "latitude", "longitude")]
    return rows.filter(good[0] & good[1] & good[2]).withColumn("acquired_at", F.try_to_timestamp(F.concat("acq_date", F.lit(" "), F.lpad("acq_time", 4, "0")), F.lit("yyyy-MM-dd HHmm")))


def read_seismic_geojson(spark: SparkSession, path: str) -> DataFrame:
    f = F.col("f")
    rows = spark.read.schema(SEISMIC).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    at = f["geometry"]["coordinates"]
    return rows.select(f["id"].alias("id"), "f.properties.*", F.get(at, F.lit(0)).alias("longitude"), F.get(at, F.lit(1)).alias("latitude"), F.get(at, F.lit(2)).alias("depth_km")).withColumn("occurred_at", F.timestamp_millis("time"))


def read_aircraft_objects(spark: SparkSession, path: str) -> DataFrame:
    """Aircraft as objects: an altitude that is no number is 0; on the ground under 100 ft."""
    rows = spark.read.schema(AIRCRAFT).option("multiLine", True).json(path).select(F.explode("ac").alias("a")).select("a.*")
    altitude = F.coalesce(F.expr("try_cast(alt_baro as double)"), F.lit(0.0))
    return rows.filter("lat is not null and lon is not null").select(F.lower("hex").alias("object_id"), F.trim("flight").alias("callsign"), "lat", "lon", altitude.alias("altitude_ft"), (altitude < 100).alias("on_ground"), F.col("gs").alias("speed_kt"), F.col("track").alias("heading"), "category")


def read_aircraft_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Aircraft as arrays of 17 slots, in metres and m/s."""
    rows = spark.read.schema("time bigint, states string").option("multiLine", True).json(path)
    v = rows.select(F.explode(F.from_json("states", "array<array<string>>")).alias("v"))
    number = lambda i: F.get("v", F.lit(i)).try_cast("double")
    return v.filter(number(5).isNotNull() & number(6).isNotNull()).select(
        F.get("v", F.lit(0)).alias("object_id"), F.trim(F.get("v", F.lit(1))).alias("callsign"), F.get("v", F.lit(2)).alias("country"),
        number(6).alias("lat"), number(5).alias("lon"), F.floor(F.coalesce(number(7), F.lit(0.0)) * 3.281 + 0.5).cast("long").alias("altitude_ft"),
        F.floor(F.coalesce(number(9), F.lit(0.0)) * 1.944 + 0.5).cast("long").alias("speed_kt"), number(10).alias("heading"),
    )


def vessel_positions(messages: DataFrame) -> DataFrame:
    """Positions among vessel messages, batch or stream: no id, no place or a place off the globe is dropped; impossible speed and heading become 0."""
    m, p = F.col("MetaData"), F.element_at("Message", F.col("MessageType"))
    lat, lon = m["latitude"], m["longitude"]
    good = (F.coalesce(m["MMSI"], F.lit(0)) != 0) & (lat != 0) & (lon != 0) & lat.between(-90, 90) & lon.between(-180, 180)
    zeroed = lambda c, most: F.when(c > most, 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    return messages.filter((F.col("MessageType") == "PositionReport") & good).select(m["MMSI"].alias("object_id"), F.trim(m["ShipName"]).alias("name"), lat.alias("lat"), lon.alias("lon"), zeroed(p["Sog"], 102).alias("speed_kt"), zeroed(p["TrueHeading"], 360).alias("heading"))


def vessel_static(messages: DataFrame) -> DataFrame:
    m, s = F.col("MetaData"), F.element_at("Message", F.col("MessageType"))
    return messages.filter((F.col("MessageType") == "ShipStaticData") & (F.coalesce(m["MMSI"], F.lit(0)) != 0)).select(m["MMSI"].alias("object_id"), F.trim(m["ShipName"]).alias("name"), s["Type"].alias("ship_type"), F.trim(s["Destination"]).alias("destination"))


def read_vessel_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VESSEL).json(path)


def read_vessel_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(VESSEL).json(path)


def kept_tracks(aircraft: DataFrame, countries: list[str], military: list[str]) -> DataFrame:
    """Aircraft in the theatre (10 to 45 N, 20 to 70 E) of a listed country or with a military callsign or category."""
    callsign = F.upper("callsign")
    by_sign = F.lit(False)
    for prefix in military:
        by_sign = by_sign | callsign.startswith(prefix)
    known = F.col("country").isin(countries) if "country" in aircraft.columns else F.lit(False)
    sort = F.col("category").isin("A6", "A7") if "category" in aircraft.columns else F.lit(False)
    return aircraft.filter(F.col("lat").between(10, 45) & F.col("lon").between(20, 70) & (known | by_sign | sort))


def read_visits(spark: SparkSession, path: str) -> DataFrame:
    """Quoted visit log; a quote is doubled in a field."""
    return spark.read.schema(VISITS).option("header", True).option("quote", '"').option("escape", '"').csv(path).withColumn("timestamp", F.try_to_timestamp("timestamp"))


def append_visits(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def counted_visits(visits: DataFrame, address: str = "address", agent: str = "agent") -> DataFrame:
    """Visits from outside, with their device: mobile, tablet or desktop, in this order of test."""
    local = F.coalesce(F.col(address), F.lit("")).rlike(r"^$|^127\.|^::1$|^192\.168\.|^10\.")
    device = F.when(F.col(agent).rlike("(?i)mobile|iphone|android.*mobile"), "mobile").when(F.col(agent).rlike("(?i)tablet|ipad"), "tablet").otherwise("desktop")
    return visits.filter(~local).withColumn("device", device)


def read_popularity(spark: SparkSession, path: str) -> DataFrame:
    """Places with their sparkline sorted by time."""
    rows = spark.read.schema(PLACES).option("multiLine", True).json(path).select(F.explode("places").alias("p")).select("p.*")
    return rows.withColumn("sparkline", F.array_sort("sparkline"))


def read_population_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("lat double, lon double, population bigint").parquet(path)


def kept_vessels(vessels: DataFrame, unknown: str = "neutral") -> DataFrame:
    """Vessels of the military type 35 or of a known side."""
    return vessels.filter((F.coalesce("ship_type", F.lit(0)) == 35) | (F.col("side") != unknown))


def normalise_thermal(df: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """Raw items of detections of 20 MW or more whose confidence is not low; with boxes (seq, country, min_lat, max_lat, min_lon,
    max_lon) only of those within one, with the country of the first."""
    country = []
    if boxes is not None:
        df, country = box_country(df, boxes, "latitude", "longitude"), [F.col("box_country").alias("country")]
    key = F.concat_ws("|", F.format_string("%.3f", "latitude"), F.format_string("%.3f", "longitude"), "acq_date", "acq_time")
    return df.filter("frp >= 20 and lower(confidence) <> 'low'").select(
        hashed_id("thermal", key).alias("external_id"), F.concat(F.lit("Thermal anomaly, "), F.col("frp"), F.lit(" MW")).alias("title"), F.lit("fire").alias("event_type"),
        radiation_severity(F.col("frp")).alias("severity"), "latitude", "longitude", F.col("acquired_at").alias("occurred_at"), F.lit("approximate").alias("geolocation_precision"),
        F.array(F.struct(F.lit("thermal").alias("name"), F.lit("satellite").alias("source_type"), F.lit(None).cast("string").alias("url"), F.lit(80).alias("reliability_score"))).alias("sources"),
        radiation_confidence(F.col("frp"), F.lower("confidence")).cast("int").alias("confidence_score"), *country,
    )


def normalise_seismic(df: DataFrame, min_magnitude: float = 4.0) -> DataFrame:
    """Raw items of earthquakes of the magnitude or more; the country is what follows the last comma of the place."""
    country = country_of_place(F.col("place"))
    return df.filter((F.col("mag") >= min_magnitude) & (F.col("type") == "earthquake")).select(
        F.concat(F.lit("quake-"), F.col("id")).alias("external_id"), "title", F.lit("alert").alias("event_type"), magnitude_severity(F.col("mag")).alias("severity"), "latitude", "longitude",
        F.when(F.col("mag") >= 6, 50).when(F.col("mag") >= 5, 20).otherwise(10).alias("location_radius_km"), country.alias("country"), "occurred_at", F.lit("exact").alias("geolocation_precision"),
        F.array(F.struct(F.lit("seismic").alias("name"), F.lit("api").alias("source_type"), F.col("url").alias("url"), F.lit(95).alias("reliability_score"))).alias("sources"),
    )


def normalise_article(df: DataFrame, language: str = "English") -> DataFrame:
    """Raw items of articles in the language."""
    return df.filter(F.col("language") == language).select(
        hashed_id("news", F.col("url")).alias("external_id"), "title", F.col("seendate").alias("occurred_at"), F.col("sourcecountry").alias("country"), "domain",
        F.array(F.struct(F.col("domain").alias("name"), F.lit("news").alias("source_type"), F.col("url").alias("url"), F.lit(58).alias("reliability_score"))).alias("sources"),
    )


def sources_of(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, links) of raw items: an id of each distinct source, and the pairs of item and source."""
    rows = items.select("external_id", F.explode("sources").alias("s")).select("external_id", "s.*").withColumn("source_id", hashed_id("source", F.coalesce("url", F.concat_ws("|", "external_id", "name"))))
    return rows.drop("external_id").dropDuplicates(["source_id"]), rows.select("external_id", "source_id").distinct()
