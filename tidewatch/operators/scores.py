"""Detectors over time and place: convergence, instability, baselines, escalation, risk, tracks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.columns import banded, cell_id, clamp, half_up
from .dictionary import small
from .headlines import with_cooldown


def seconds(ts: str) -> Column:
    return F.unix_timestamp(F.col(ts).cast("timestamp"))


def convergence_cells(points: DataFrame, as_of: str, hours: int = 24, min_types: int = 3) -> DataFrame:
    """1 by 1 degree cells where several kinds of signal met in the last hours: points are (lat, lon, kind, ts)."""
    now = F.lit(as_of).cast("timestamp_ntz")
    recent = points.filter((F.col("ts") > now - F.expr(f"interval {hours} hours")) & (F.col("ts") <= now))
    by_kind = recent.groupBy(cell_id(F.col("lat"), F.col("lon")).alias("cell"), "kind").agg(F.count("*").alias("n"))
    cells = by_kind.groupBy("cell").agg(F.count("*").alias("types"), F.sum("n").alias("total"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return cells.filter(F.col("types") >= min_types).withColumn("score", F.least(F.lit(100), 25 * F.col("types") + F.least(F.lit(25), 2 * F.col("total"))).cast("long"))


def country_instability(signals: DataFrame, as_of: str, severity_weights: dict[int, float], category_risk: dict[str, float], sanctioned: list[str], conflict: list[str]) -> DataFrame:
    """Weekly score of each country from intensity, weighted severity, trend and baseline; signals are (country, category, severity, ts)."""
    now = F.lit(as_of).cast("timestamp_ntz")
    week = signals.filter((F.col("ts") > now - F.expr("interval 7 days")) & (F.col("ts") <= now)).withColumn("country", F.lower(F.trim("country")))
    weight, risk = F.lit(1.0), F.lit(1.0)
    for k, v in severity_weights.items():
        weight = F.when(F.col("severity") == k, v).otherwise(weight)
    for k, v in category_risk.items():
        risk = F.when(F.col("category") == k, v).otherwise(risk)
    hour = lambda h: F.col("ts") > now - F.expr(f"interval {h} hours")
    by = week.groupBy("country").agg(F.count("*").alias("n"), F.sum(weight * risk).alias("weighted"), F.count_if(hour(24)).alias("recent"), F.count_if(hour(48) & ~hour(24)).alias("older"))
    ratio = F.when(F.col("older") > 0, F.col("recent") / F.col("older")).when(F.col("recent") > 0, 2.0).otherwise(1.0)
    trend = F.when(ratio > 1.3, 10).when(ratio < 0.7, -5).otherwise(0)
    base = F.when(F.col("country").isin(sanctioned), 10).otherwise(0) + F.when(F.col("country").isin(conflict), 10).otherwise(0)
    score = clamp(half_up(F.least(F.lit(40.0), F.col("n") / 50.0 * 40.0) + F.least(F.lit(30.0), F.col("weighted") / 150.0 * 30.0) + trend + base), 0, 100)
    level = banded(F.col("score"), [(80, "critical"), (60, "high"), (40, "elevated"), (20, "guarded")], "low")
    return by.withColumn("score", score.cast("long")).select("country", "n", "score", level.alias("level"))


def top_categories(signals: DataFrame, k: int = 5) -> DataFrame:
    counts = signals.groupBy("country", "category").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("country").orderBy(F.desc("n"), "category"))
    return counts.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def hourly_counts(events: DataFrame, ts: str, *by: str) -> DataFrame:
    return events.groupBy(*by, F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))


def baseline_anomalies(hourly: DataFrame, by: list[str], min_samples: int = 24, z: float = 2.5, min_sd: float = 0.5, cooldown_h: int = 2) -> DataFrame:
    """Hours whose count lies z deviations off what came before; alerts of one key are two hours apart at least.
    A key has one row an hour, so its window is bounded by the hours of its history."""
    past = Window.partitionBy(*by).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    seen = hourly.withColumn("sample", F.row_number().over(Window.partitionBy(*by).orderBy("hour"))).withColumn("mean", F.avg("n").over(past)).withColumn("sd", F.stddev_samp("n").over(past))
    found = seen.withColumn("z", (F.col("n") - F.col("mean")) / F.col("sd")).filter((F.col("sample") >= min_samples) & (F.col("sd") >= min_sd) & (F.abs("z") >= z))
    found = found.withColumn("id", seconds("hour"))
    return with_cooldown(found, F.concat_ws("::", *(F.lower(b) for b in by)), "hour", cooldown_h * 60).select(*by, "hour", "n", F.round("mean", 4).alias("mean"), F.round("z", 4).alias("z"))


def baseline_state(hourly: DataFrame, by: list[str]) -> DataFrame:
    """(n, mean, m2) of each key."""
    return hourly.groupBy(*by).agg(F.count("n").alias("samples"), F.avg("n").alias("mean"), (F.coalesce(F.var_pop("n"), F.lit(0.0)) * F.count("n")).alias("m2"))


def merge_baselines(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """The states of two disjoint samples as one."""
    x, y = a.select(*by, *(F.col(c).alias(f"a_{c}") for c in ("samples", "mean", "m2"))), b.select(*by, *(F.col(c).alias(f"b_{c}") for c in ("samples", "mean", "m2")))
    both = x.join(y, by, "full").fillna(0)
    n, delta = F.col("a_samples") + F.col("b_samples"), F.col("b_mean") - F.col("a_mean")
    return both.select(*by, n.alias("samples"), (F.col("a_mean") + delta * F.col("b_samples") / n).alias("mean"), (F.col("a_m2") + F.col("b_m2") + delta * delta * F.col("a_samples") * F.col("b_samples") / n).alias("m2"))


def hourly_trend(hourly: DataFrame, by: str) -> DataFrame:
    """Mean of the last 24 hours against the 24 before, on a spine of all hours of a key; needs 48."""
    span = hourly.groupBy(by).agg(F.min("hour").alias("low"), F.max("hour").alias("high"))
    spine = span.select(by, F.explode(F.sequence("low", "high", F.expr("interval 1 hour"))).alias("hour"))
    full = spine.join(hourly, [by, "hour"], "left").fillna({"n": 0})
    order = Window.partitionBy(by).orderBy("hour")
    full = full.withColumn("sample", F.row_number().over(order)).withColumn("recent", F.avg("n").over(order.rowsBetween(-23, 0))).withColumn("older", F.avg("n").over(order.rowsBetween(-47, -24)))
    full = full.withColumn("last", F.max("hour").over(Window.partitionBy(by))).filter((F.col("hour") == F.col("last")) & (F.col("sample") >= 48))
    ratio = F.when(F.col("older") > 0, F.col("recent") / F.col("older")).when(F.col("recent") > 0, 2.0).otherwise(1.0)
    return full.select(by, F.round(ratio, 4).alias("ratio"), F.when(ratio > 1.3, "rising").when(ratio < 0.7, "falling").otherwise("stable").alias("trend"))


def escalation_scores(parts: DataFrame) -> DataFrame:
    """Combined score of hotspots from (id, status, matches, breaking, instability, alert_score, alerts, flights, vessels)."""
    news = F.least(F.lit(100.0), 15.0 * F.col("matches") + 30.0 * F.col("breaking") + 5.0 * F.col("matches") / 2)
    geo = F.when(F.col("alerts") == 0, 0.0).otherwise(F.least(F.lit(100.0), F.col("alert_score") + 10.0 * F.col("alerts")))
    military = F.least(F.lit(100.0), 10.0 * F.col("flights") + 15.0 * F.col("vessels"))
    raw = 0.35 * news + 0.25 * F.coalesce("instability", F.lit(30.0)) + 0.25 * geo + 0.15 * military
    static = F.when(F.col("status") == "active", 3.5).when(F.col("status") == "monitoring", 2.5).when(F.col("status") == "stable", 1.5).otherwise(2.0)
    return parts.withColumn("score", 0.3 * static + 0.7 * (1 + raw / 25.0))


def escalation_signals(scores: DataFrame, key: str, ts: str, score: str, cooldown_h: int = 2) -> DataFrame:
    """Scores that cross a whole number (from 2 on), rise by 0.5, or cross 4.5, once in the cooldown; a first score never signals."""
    before = F.lag(score).over(Window.partitionBy(key).orderBy(ts))
    s, p = F.col(score), F.col("_before")
    kind = F.when(p.isNull(), None).when((F.floor(s) > F.floor(p)) & (s >= 2), "threshold").when(s - p >= 0.5, "jump").when((p < 4.5) & (s >= 4.5), "critical")
    found = scores.withColumn("_before", before).withColumn("signal", kind).filter(F.col("signal").isNotNull()).withColumn("id", seconds(ts))
    return with_cooldown(found, F.col(key).cast("string"), ts, cooldown_h * 60).drop("_before", "id")


def score_trend(scores: DataFrame, key: str, ts: str, score: str, hours: int = 24, points: int = 49) -> DataFrame:
    """Slope over index of up to 49 scores of the last 24 hours, and their change from first to last."""
    frame = Window.partitionBy(key).orderBy(seconds(ts)).rangeBetween(-hours * 3600, 0)
    last = scores.withColumn("_all", F.collect_list(score).over(frame))
    last = last.withColumn("_own", F.when(F.size("_all") > points, F.slice("_all", -points, points)).otherwise(F.col("_all")))
    n = F.size("_own")
    mean_i = (n - 1) / F.lit(2.0)
    mean = F.aggregate("_own", F.lit(0.0), lambda a, x: a + x) / n
    cov = F.aggregate(F.transform("_own", lambda x, i: (i - mean_i) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
    slope = F.when(n >= 3, cov / (n * (n * n - 1) / 12.0)).otherwise(0.0)
    change = F.element_at("_own", -1) - F.element_at("_own", 1)
    return last.select(key, ts, F.round(slope, 4).alias("slope"), F.round(change, 1).alias("change_24h"), F.when(slope > 0.1, "escalating").when(slope < -0.1, "de-escalating").otherwise("stable").alias("trend"))


def global_risk(events: DataFrame, as_of: str, weights: dict[str, float]) -> DataFrame:
    """One score of the last 24 hours: root of the sum of weight, severity, confidence and recency over ten, five at most."""
    now = F.lit(as_of).cast("timestamp_ntz")
    recent = events.filter((F.col("occurred_at") > now - F.expr("interval 24 hours")) & (F.col("occurred_at") <= now) & F.col("is_active"))
    weight = F.lit(1.0)
    for k, v in weights.items():
        weight = F.when(F.col("event_type") == k, v).otherwise(weight)
    fresh = F.when(F.col("occurred_at") > now - F.expr("interval 6 hours"), 2.0).otherwise(1.0)
    score = F.least(F.lit(5.0), F.sqrt(F.coalesce(F.sum(weight * F.col("severity") * F.col("confidence_score") / 100.0 * fresh), F.lit(0.0)) / 10.0))
    level = banded(F.col("score"), [(4, "critical"), (3, "high"), (2, "elevated"), (1, "guarded")], "low")
    return recent.agg(F.count("*").alias("n"), F.round(score, 4).alias("score")).withColumn("level", level)


def country_risk(events: DataFrame, as_of: str, codes: DataFrame) -> DataFrame:
    """Risk of each country with a code: severity by confidence, twice within 6 hours, half more within 24."""
    now = F.lit(as_of).cast("timestamp_ntz")
    fresh = F.when(F.col("occurred_at") > now - F.expr("interval 6 hours"), 2.0).when(F.col("occurred_at") > now - F.expr("interval 24 hours"), 1.5).otherwise(1.0)
    sums = events.filter("is_active").groupBy(F.trim("country").alias("country")).agg(F.sum(F.col("severity") * F.col("confidence_score") / 100.0 * fresh).alias("risk"))
    band = banded(F.col("risk"), [(1000, "severe"), (500, "high"), (100, "moderate")], "low")
    return sums.join(small(codes), "country").select("iso2", F.round("risk", 4).alias("risk"), band.alias("band"))


def latest_track(fixes: DataFrame, as_of: str | None = None, ttl_min: int = 8) -> DataFrame:
    """The latest fix of each object, if it is younger than the time to live."""
    last = fixes.groupBy("object_id").agg(F.max_by(F.struct("fix_id", "kind", "lat", "lon", "updated_at"), F.struct("updated_at", "fix_id")).alias("f")).select("object_id", "f.*")
    if as_of is None:
        return last
    return last.filter(F.col("updated_at") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {ttl_min} minutes"))


def guarded_latest(fixes: DataFrame, primary: str, seconds_fresh: int = 30) -> DataFrame:
    """The latest fix of each object, where another source does not replace a primary fix that is less than 30 seconds older."""
    at = seconds("updated_at")
    best = fixes.groupBy("object_id").agg(F.max(F.when(F.col("source") == primary, F.struct(at.alias("at"), "fix_id"))).alias("p"), F.max(F.struct(at.alias("at"), "fix_id")).alias("l"))
    pick = F.when(F.col("p").isNotNull() & (F.col("l.at") - F.col("p.at") < seconds_fresh), F.col("p.fix_id")).otherwise(F.col("l.fix_id"))
    return fixes.join(best.select("object_id", pick.alias("fix_id")), ["object_id", "fix_id"])


def static_as_of(positions: DataFrame, static: DataFrame, fields: list[str]) -> DataFrame:
    """Positions with the last static data of their object up to their time: both kinds in one ordered window, no pairs."""
    none = [F.lit(None).cast(static.schema[f].dataType).alias(f) for f in fields]
    p = positions.select("object_id", "updated_at", F.lit(1).alias("_kind"), F.struct(*positions.columns).alias("_p"), *none)
    s = static.select("object_id", "updated_at", F.lit(0).alias("_kind"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), *fields)
    order = Window.partitionBy("object_id").orderBy("updated_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    filled = p.unionByName(s).select("_kind", "_p", *(F.last(f, ignorenulls=True).over(order).alias(f) for f in fields))
    return filled.filter("_kind = 1").select("_p.*", *fields)


def activity_index(places: DataFrame) -> DataFrame:
    """Index of places (popularity, is_spike, is_closed, sparkline of (at, value)): mean popularity of open ones at 0.6, or of the
    last six positive values, plus the share of spikes at 40."""
    values = F.filter(F.transform(F.array_sort("sparkline"), lambda p: p["value"]), lambda v: v > 0)
    last = F.when(F.size(values) > 6, F.slice(values, -6, 6)).otherwise(values)
    mean = F.when(F.size(last) > 0, F.aggregate(last, F.lit(0.0), lambda a, x: a + x) / F.size(last))
    open_ = ~F.col("is_closed") & F.col("popularity").isNotNull()
    score = F.coalesce(F.avg(F.when(open_, F.col("popularity"))), F.avg(mean), F.lit(0.0)) * 0.6 + F.avg(F.col("is_spike").cast("double")) * 40
    return places.agg(F.least(F.lit(100), half_up(score)).alias("activity"))


def sparkline_means(places: DataFrame, k: int = 7) -> DataFrame:
    """For each point of a place's sparkline (place_id, sparkline of (hour, value)) the rounded mean of the k nearest in time, of equally near ones the
    earlier; a line has 24 points. Rows of one place are one line. Points of one hour are one, which counts its neighbours as often as it is there.

    In the order of hours the k nearest points lie within k - 1 places, so each line is looked through by itself and only lines are shuffled."""
    lines = places.groupBy("place_id").agg(F.sort_array(F.flatten(F.collect_list("sparkline"))).alias("line")).filter(F.size("line") > 0)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line = batch.column("line")
            owner = line.value_parent_indices().to_numpy()
            hours, values = line.flatten().field("hour"), line.flatten().field("value")
            mean, known, first = line_means(owner, hours.to_numpy(zero_copy_only=False), values.to_numpy(zero_copy_only=False).astype("float64"), values.is_valid().to_numpy(zero_copy_only=False), k)
            result = pa.array(np.floor(mean[first] + 0.5).astype("int64"), pa.int64(), mask=~known[first])
            yield pa.RecordBatch.from_arrays([batch.column("place_id").take(pa.array(owner[first])), hours.take(pa.array(first)), result], ["place_id", "hour", "mean"])

    point = places.schema["sparkline"].dataType.elementType
    schema = StructType([places.schema["place_id"], StructField("hour", point["hour"].dataType), StructField("mean", LongType())])
    return lines.mapInArrow(means, schema)


def line_means(owner: np.ndarray, hours: np.ndarray, values: np.ndarray, there: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For points in the order of their line and hour: the mean of the k nearest of the line, whether one of those has a value, and which points are the first of their hour."""
    n = len(hours)
    at = np.arange(n)[:, None] + np.arange(1 - k, k)[None, :]
    inside = (at >= 0) & (at < n)
    at = at.clip(0, max(n - 1, 0))
    inside &= owner[at] == owner[:, None]
    far = np.where(inside, np.abs(hours[at].astype("float64") - hours[:, None]), np.inf)
    # candidates are in order of hours, which a stable sort keeps among equally far ones
    nearest = np.argsort(far, axis=1, kind="stable")[:, :k]
    at, inside, far = (np.take_along_axis(x, nearest, 1) for x in (at, inside, far))
    first = np.flatnonzero((np.arange(n) == 0) | (owner != np.roll(owner, 1)) | (hours != np.roll(hours, 1)))
    again = (far == 0).sum(axis=1)
    for i in first[again[first] > 1]:  # points of one hour, which are rare
        at[i], inside[i] = np.repeat(at[i], again[i])[:k], np.repeat(inside[i], again[i])[:k]
    used = inside & there[at]
    count = used.sum(axis=1)
    return np.where(used, values[at], 0.0).sum(axis=1) / np.maximum(count, 1), count > 0, first


def anomaly_message(kind: Column, n: Column, mean: Column, z: Column) -> Column:
    level = banded(F.abs(z), [(4, "extreme"), (3, "high")], "notable")
    return F.format_string("%s: %d reports in an hour, usually %.1f (%s, z %.1f)", kind, n.cast("long"), mean, level, z)


def recent_flag(ts: Column, as_of: str, hours: int = 3) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") - ts < F.expr(f"interval {hours} hours")
