"""Filters, projections, statistics, scores and merges over events, sources and their links.

Timestamps are compared as they come; every relative time is counted from an explicit as_of.
Tables may be of any size: dimensions are broadcast only where their size is fixed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import half_up, in_bbox


@dataclass(frozen=True)
class EventFilter:
    """Optional conditions; texts match as substrings without case."""

    country: str | None = None
    region: str | None = None
    city: str | None = None
    event_type: str | None = None
    verification: str | None = None
    min_confidence: int | None = None
    start: str | None = None
    end: str | None = None
    bbox: tuple[float, float, float, float] | None = None


def _text(name: str, value: str | None) -> list[Column]:
    if not value:
        return []
    escaped = value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return [F.col(name).ilike(f"%{escaped}%")]


def _common(f: EventFilter) -> list[Column]:
    found = _text("country", f.country)
    if f.event_type:
        found.append(F.col("event_type") == f.event_type)
    if f.start:
        found.append(F.col("occurred_at") >= F.lit(f.start).cast("timestamp_ntz"))
    if f.end:
        found.append(F.col("occurred_at") <= F.lit(f.end).cast("timestamp_ntz"))
    if f.bbox and (inside := in_bbox(F.col("latitude"), F.col("longitude"), *f.bbox)) is not None:
        found.append(inside)
    return found


def _all(df: DataFrame, conditions: list[Column]) -> DataFrame:
    for c in conditions:
        df = df.filter(c)
    return df


def filter_events(df: DataFrame, f: EventFilter) -> DataFrame:
    """Active events other than fires that meet the filter."""
    more = [*_text("region", f.region), *_text("city", f.city)]
    if f.verification:
        more.append(F.col("verification_status") == f.verification)
    if f.min_confidence is not None:
        more.append(F.col("confidence_score") >= f.min_confidence)
    return _all(df, [F.col("is_active"), F.col("event_type") != "fire", *_common(f), *more])


def filter_events_for_stats(df: DataFrame, f: EventFilter) -> DataFrame:
    """The filter of statistics: no region, city, status or confidence, and fires stay."""
    return _all(df, [F.col("is_active"), *_common(f)])


def with_source_count(events: DataFrame, links: DataFrame) -> DataFrame:
    counts = links.groupBy(F.col("event_id").alias("id")).agg(F.count("*").alias("source_count"))
    return events.join(counts, "id", "left").withColumn("source_count", F.coalesce("source_count", F.lit(0)).cast("long"))


def relative_start(as_of: str, hours: int, minutes: int = 5) -> Column:
    """The start of a range that ends at as_of, brought down to whole steps of some minutes."""
    return F.timestamp_seconds(F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - hours * 3600) / (60 * minutes)) * (60 * minutes)).cast("timestamp_ntz")


def source_page(sources: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    """The latest sources, 200 at most."""
    return sources.orderBy(F.desc("created_at"), "source_id").offset(offset).limit(min(limit, 200))


def last_of(df: DataFrame, at: str, n: int, key: str = "id") -> DataFrame:
    """The n latest rows."""
    return df.orderBy(F.desc(at), F.desc(key)).limit(n)


def ranked(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The n rows of the highest value with their rank; the smaller key goes first."""
    top = df.orderBy(F.desc(by), key).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), key)).cast("long"))


def event_page(events: DataFrame, limit: int = 4000, offset: int = 0) -> DataFrame:
    """The latest events, 5000 at most."""
    return events.orderBy(F.desc("occurred_at"), "id").offset(offset).limit(min(limit, 5000))


#: Columns of an event as lists and details show it, and of a layer of the map.
DETAIL = (
    "id external_id title summary description event_type severity confidence_score verification_status geolocation_precision latitude longitude location_radius_km country region city "
    "occurred_at first_seen_at last_updated_at is_active created_at updated_at"
).split()
LAYER = "id event_type severity confidence_score latitude longitude location_radius_km occurred_at".split()


def projected(events: DataFrame, columns: list[str]) -> DataFrame:
    """These columns in this order; null where the table has none of that name."""
    return events.select(*(F.col(c) if c in events.columns else F.lit(None).cast("string").alias(c) for c in columns))


def event_list(events: DataFrame, links: DataFrame, limit: int = 4000, offset: int = 0) -> DataFrame:
    """A page of the latest events with all columns and the count of their sources; links are counted for the page's events only."""
    page = event_page(projected(events, DETAIL), limit, offset)
    own = links.join(F.broadcast(page.select(F.col("id").alias("event_id"))), "event_id", "left_semi")  # 5000 ids at most
    return with_source_count(page, own)


def event_sources(events: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """Each event's sources with their rank by reliability."""
    found = events.select(F.col("id").alias("event_id")).join(links, "event_id").join(sources, "source_id")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("reliability_score"), "source_id")).cast("long"))


def top_source_url(links: DataFrame, sources: DataFrame) -> DataFrame:
    """The url of each event's most reliable source that has one."""
    urls = links.join(sources.filter(F.col("url").isNotNull()), "source_id")
    return urls.groupBy("event_id").agg(F.max_by("url", F.struct("reliability_score", -F.col("source_id"))).alias("url"))


def event_stats(events: DataFrame, *by: str) -> DataFrame:
    return events.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("confidence_score") >= 80).alias("high_confidence"),
        F.count_if(F.col("event_type").isin("missile", "drone")).alias("missile_drone"),
        F.countDistinct("country").alias("countries"),
        F.max("occurred_at").alias("latest"),
    )


def timeline(events: DataFrame, as_of: str, hours: int, unit: str = "day") -> DataFrame:
    """Counts of active events by bucket and type over the last hours."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {hours} hours")
    recent = events.filter(F.col("is_active") & (F.col("occurred_at") >= since))
    return recent.groupBy(F.date_trunc(unit, "occurred_at").cast("timestamp_ntz").alias("bucket"), "event_type").agg(F.count("*").alias("n"))


def timeline_wide(counts: DataFrame, types: list[str], buckets: int = 24) -> DataFrame:
    """The latest buckets with a column for each type."""
    wide = counts.groupBy("bucket").pivot("event_type", types).agg(F.sum("n")).fillna(0, types)
    return wide.orderBy(F.desc("bucket")).limit(buckets)


def confidence(links: DataFrame, sources: DataFrame, events: DataFrame) -> DataFrame:
    """Score and verification of each event from its sources and the precision of its place: mean reliability,
    5 for each further source up to 20, 10 where a machine and a human kind agree, less 0, 5 or 15; 10 without sources."""
    kinds = F.col("source_type")
    per_event = links.join(sources, "source_id").groupBy(F.col("event_id").alias("id")).agg(
        F.avg("reliability_score").alias("mean"),
        F.count("*").alias("n"),
        F.max("reliability_score").alias("best"),
        F.max(kinds.isin("satellite", "api")).alias("machine"),
        F.max(kinds.isin("news", "manual", "social")).alias("human"),
    )
    score = confidence_points(F.col("mean"), F.col("n"), F.col("machine") & F.col("human"))
    found = events.select("id", "geolocation_precision").join(per_event, "id", "left").withColumn("score", score.cast("long"))
    return found.select("id", "score", verification_status(F.col("score"), F.col("n"), F.col("best")).alias("verification_status"))


def confidence_points(mean: Column, n: Column, mixed: Column) -> Column:
    """The score of an event from the mean reliability and number of its sources, whether their kinds are mixed, and the precision of its place."""
    loss = F.when(F.col("geolocation_precision") == "exact", 0).when(F.col("geolocation_precision") == "approximate", 5).otherwise(15)
    raw = mean + F.least((n - 1) * 5, F.lit(20)) + F.when(mixed, 10).otherwise(0) - loss
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(10)).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), half_up(raw))))


def verification_status(score: Column, n_sources: Column, best: Column) -> Column:
    return F.when((score >= 80) & (best >= 80), "verified").when((score >= 50) | (n_sources >= 2), "partially_verified").otherwise("unverified")


def merge_confidence(items: DataFrame, key: str, order: str, score: str) -> DataFrame:
    """Confidence after reports of one key came in order: each repeat lifts it to 3 above the higher of both, 100 at most.
    In closed form the maximum over reports of score plus 3 for each report after it, and one more for repeats."""
    by_key = Window.partitionBy(key)
    rank, n = F.row_number().over(by_key.orderBy(order)), F.count("*").over(by_key)
    lifted = items.select(key, F.col(score).alias("s"), rank.alias("i"), n.alias("n"))
    lift = F.col("s") + 3 * (F.col("n") - F.greatest(F.col("i"), F.lit(2)) + 1)
    return lifted.groupBy(key).agg(F.max("n").alias("reports"), F.least(F.lit(100), F.max(F.when(F.col("n") == 1, F.col("s")).otherwise(lift))).cast("long").alias("confidence"))


def distinct_sources(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept sources, source_id to kept source_id): of equal urls the oldest stays; sources without url all stay."""
    by_url = Window.partitionBy("url").orderBy("created_at", "source_id")
    named = sources.filter(F.col("url").isNotNull()).withColumn("kept_id", F.first("source_id").over(by_url))
    mapping = named.select("source_id", "kept_id").unionByName(sources.filter(F.col("url").isNull()).select("source_id", F.col("source_id").alias("kept_id")))
    return sources.join(mapping.filter("source_id = kept_id").select("source_id"), "source_id", "left_semi"), mapping


def relinked(links: DataFrame, mapping: DataFrame) -> DataFrame:
    return links.join(mapping, "source_id").select("event_id", F.col("kept_id").alias("source_id")).distinct()


def upsert_sources(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """New sources of a batch: the first of each url that is not there yet, and all without url."""
    first = batch.filter(F.col("url").isNotNull()).withColumn("nth", F.row_number().over(Window.partitionBy("url").orderBy("created_at", "source_id"))).filter("nth = 1").drop("nth")
    new = first.join(existing.filter(F.col("url").isNotNull()).select("url"), "url", "left_anti")
    return new.unionByName(batch.filter(F.col("url").isNull()))


def upsert_events(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Events after a batch of reports: unknown external ids are inserted, known ones have their confidence folded with
    the reports in order of id; the latest report gives the type. Only touched keys need writing: change is insert, update or none."""
    known = existing.select("external_id", F.lit(-1).cast("long").alias("id"), F.col("confidence_score").alias("score"), F.col("event_type"))
    new = batch.select("external_id", "id", F.col("confidence_score").alias("score"), "event_type")
    every = known.unionByName(new)
    folded = merge_confidence(every, "external_id", "id", "score")
    state = every.groupBy("external_id").agg(F.max_by("event_type", "id").alias("event_type"), F.min("id").alias("low"), F.max("id").alias("high"))
    change = F.when(F.col("low") >= 0, "insert").when(F.col("high") >= 0, "update").otherwise("none")
    return folded.join(state, "external_id").select("external_id", "event_type", "confidence", "reports", change.alias("change"))


def ingest_reports(existing: DataFrame, items: DataFrame) -> DataFrame:
    """Events after raw items (id, external_id, title, event_type, geolocation_precision, sources) came in order of id.

    An unknown external id, and each item without one, is inserted as its first item says; later items lift the confidence and
    give the status by their own sources. Existing events are (external_id, title, event_type, confidence_score,
    verification_status), whose ids sort before all items. Change is insert, update or none; event_key is the external id, or made of the item's id."""
    of = lambda field: F.transform("sources", lambda s: s[field])
    n, reliability = F.size("sources"), of("reliability_score")
    has = lambda *kinds: F.arrays_overlap(of("source_type"), F.array(*map(F.lit, kinds)))
    mean = F.aggregate(reliability, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0))
    score = confidence_points(mean, n, has("satellite", "api") & has("news", "manual", "social"))
    key = F.coalesce("external_id", F.concat(F.lit("item-"), F.col("id").cast("string")))
    none = F.lit(None)
    new = items.select(key.alias("event_key"), "id", "title", "event_type", score.cast("long").alias("score"), n.alias("n"), F.array_max(reliability).cast("int").alias("best"), none.cast("string").alias("status"))
    known = existing.select(F.col("external_id").alias("event_key"), F.lit(-1).cast("long").alias("id"), "title", "event_type", F.col("confidence_score").cast("long").alias("score"), none.cast("int").alias("n"), none.cast("int").alias("best"), F.col("verification_status").alias("status"))
    every = known.unionByName(new)
    state = every.groupBy("event_key").agg(F.min_by(F.struct("title", "event_type"), "id").alias("first"), F.max_by(F.struct("n", "best", "status"), "id").alias("last"), F.min("id").alias("low"), F.max("id").alias("high"))
    change = F.when(F.col("low") >= 0, "insert").when(F.col("high") >= 0, "update").otherwise("none")
    status = F.coalesce("last.status", verification_status(F.col("confidence"), F.col("last.n"), F.col("last.best")))
    return merge_confidence(every, "event_key", "id", "score").join(state, "event_key").select("event_key", "first.title", "first.event_type", "confidence", status.alias("verification_status"), change.alias("change"))


def new_links(existing: DataFrame, links: DataFrame) -> DataFrame:
    """Links that are not there yet, each once."""
    return links.distinct().join(existing, links.columns, "left_anti")


def unpublished(events: DataFrame, published: DataFrame) -> DataFrame:
    """Events whose id is not among the published ones."""
    return events.join(published.select("id"), "id", "left_anti")


def visible(events: DataFrame, types: list[str], as_of: str, hours: int = 3) -> DataFrame:
    """Events of the chosen types, with is_recent where they are younger than some hours."""
    age = F.lit(as_of).cast("timestamp_ntz") - F.col("occurred_at")
    return events.filter(F.col("event_type").isin(types)).withColumn("is_recent", age < F.expr(f"interval {hours} hours"))


def urgent_candidates(events: DataFrame, as_of: str, minutes: int = 10, min_severity: int = 4, min_confidence: int = 72) -> DataFrame:
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {minutes} minutes")
    urgent = F.col("is_active") & (F.col("occurred_at") >= since) & (F.col("severity") >= min_severity) & (F.col("confidence_score") >= min_confidence)
    return events.filter(urgent & F.col("event_type").isin("missile", "airstrike", "explosion"))


def unpublished_candidates(events: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {hours} hours")
    return events.filter(F.col("is_active") & (F.col("occurred_at") >= since) & (F.col("event_type") != "fire"))


def best_per(events: DataFrame, by: str, k: int = 1) -> DataFrame:
    """The k events of each group with the highest severity, then confidence."""
    order = Window.partitionBy(by).orderBy(F.desc("severity"), F.desc("confidence_score"), "id")
    return events.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def live_union(live: DataFrame, stored: DataFrame) -> DataFrame:
    """Live rows, and stored ones whose id is not live."""
    return live.unionByName(stored.join(live.select("id"), "id", "left_anti"))


def adaptive_windows(events: DataFrame, ts: str, base_hours: int = 24, levels: int = 2, cap: int = 250) -> DataFrame:
    """The coarsest windows with fewer than cap rows: base windows that reach it are halved, up to `levels` times; a smallest
    window that still reaches it is flagged as truncated. Rows are counted once, on the smallest windows."""
    seconds = base_hours * 3600
    leaf = seconds // 2**levels
    epoch = F.unix_timestamp(F.col(ts).cast("timestamp"))
    counts = events.groupBy(F.floor(epoch / leaf).cast("long").alias("leaf")).agg(F.count("*").alias("n"))
    for level in range(levels + 1):
        per = 2 ** (levels - level)
        counts = counts.withColumn(f"n{level}", F.sum("n").over(Window.partitionBy(F.floor(F.col("leaf") / per))))
    fits = [F.col(f"n{level}") < cap for level in range(levels + 1)]
    chosen = F.lit(levels)
    for level in reversed(range(levels)):
        chosen = F.when(fits[level], level).otherwise(chosen)
    counts = counts.withColumn("level", chosen.cast("int"))
    size = F.lit(seconds) / F.pow(F.lit(2), F.col("level"))
    start = (F.floor(F.col("leaf") * leaf / size) * size).cast("long")
    return counts.groupBy(start.alias("window_start"), size.cast("long").alias("window_seconds")).agg(F.sum("n").alias("n")).withColumn("truncated", (F.col("window_seconds") == leaf) & (F.col("n") >= cap))


def location_drift(old: DataFrame, new: DataFrame, key: str, tolerance: float = 0.01) -> DataFrame:
    """Rows whose place moved by more than the tolerance, or whose country changed, or region where both have one."""
    o, n = old.alias("o"), new.alias("n")
    moved = (F.abs(F.col("o.latitude") - F.col("n.latitude")) > tolerance) | (F.abs(F.col("o.longitude") - F.col("n.longitude")) > tolerance) | ~F.col("o.country").eqNullSafe(F.col("n.country"))
    if "region" in old.columns and "region" in new.columns:
        moved = moved | ~F.col("o.region").eqNullSafe(F.col("n.region"))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}")).filter(moved).select(F.col(f"o.{key}"), F.col("o.country").alias("old_country"), F.col("n.country").alias("new_country"))


def urgent_unpublished(events: DataFrame, published: DataFrame, as_of: str, minutes: int = 10, types: tuple[str, ...] = ("missile", "airstrike", "explosion"), min_severity: int = 4, min_confidence: int = 72) -> DataFrame:
    """Active events of the urgent types that were first seen in the last minutes, are grave and sure enough, and whose id is not among the published, with their rank: the gravest, then the surest."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {minutes} minutes")
    found = events.filter(F.col("is_active") & (F.col("first_seen_at") >= since) & (F.col("severity") >= min_severity) & (F.col("confidence_score") >= min_confidence) & F.col("event_type").isin(*types))
    found = found.join(published.select("id"), "id", "left_anti").select("id", "event_type", "severity", "confidence_score")
    # severities and confidences are a few hundred pairs: ranks within a pair go behind the counts of those before
    pair = ["severity", "confidence_score"]
    counts = found.groupBy(*pair).agg(F.count("*").alias("n"))
    order = Window.orderBy(F.desc("severity"), F.desc("confidence_score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = counts.select(*pair, (F.sum("n").over(order) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy(*pair).orderBy("id"))
    return found.withColumn("nth", within).join(before, pair).select("id", "event_type", *pair, (F.col("before") + F.col("nth")).alias("rank"))
