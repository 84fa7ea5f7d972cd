"""Trending terms as a stream: hourly summaries find the terms that can stand out, exact counts judge them against an hourly baseline."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.headlines import title_terms
from ..storage import names_in, scratch, written
from .streams import distinct_headlines, per_batch
from .versions import put, version

NEWEST = "newest timestamp, refreshed timestamp, held int"
ALERTED = "term string, found_at timestamp"
BASELINE = "term string, week long"
WEEK = timedelta(days=7)


def summaries(terms: DataFrame, most: int) -> DataFrame:
    """(hour, sketch): a summary of the most frequent terms of each hour, which tracks `most` of them."""
    return terms.groupBy(F.date_trunc("hour", "published_at").alias("hour")).agg(F.call_function("approx_top_k_accumulate", "term", F.lit(most)).alias("sketch"))


def frequent(hours: DataFrame, most: int) -> DataFrame:
    """(term): the terms of some hours' summaries as one, `most` at most. A summary that has no room left over-counts a term by its least count at most, and a term
    that is more frequent than the bound of the error is in it."""
    # by a constant, as tasks without summaries can't take part in combining
    whole = hours.withColumn("all", F.lit(0)).groupBy("all").agg(F.call_function("approx_top_k_combine", "sketch", F.lit(most)).alias("sketch"))
    return whole.select(F.explode(F.call_function("approx_top_k_estimate", "sketch", F.lit(most))).alias("x")).select(F.col("x.item").alias("term"))


def dates(since: datetime, until: datetime) -> list[str]:
    return [f"date={since.date() + timedelta(days=i)}" for i in range((until.date() - since.date()).days + 1)]


def recent(table: str, empty: DataFrame, ts: str, since: datetime, until: datetime, n: int) -> DataFrame:
    """Rows of batches up to n after since, until included; only the folders of the dates in between are listed and read. empty where none of them has come."""
    spark = empty.sparkSession
    known = set(names_in(spark, table))
    found = [f"{table}/{d}" for d in dates(since, until) if d in known]
    if not found:
        return empty
    rows = spark.read.option("basePath", table).parquet(*found)
    return rows.filter((F.col("batch") <= n) & (F.col(ts) > F.lit(since)) & (F.col(ts) <= F.lit(until))).drop("date", "batch")


def add(rows: DataFrame, table: str, ts: str, n: int) -> None:
    """Adds a batch's rows by date; a batch that runs twice overwrites its own."""
    dated = rows.withColumn("date", F.to_date(ts)).withColumn("batch", F.lit(n))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(table)


def trending_stream(
    headlines: DataFrame, table: str, out: str, checkpoint: str, min_count: int = 5, multiplier: float = 3.0, min_sources: int = 2, blocked: tuple[str, ...] = (),
    cooldown_minutes: int = 30, refresh_minutes: int = 60, most_terms: int = 10_000, exact: bool = False,
) -> StreamingQuery:
    """(term, recent_count, sources, baseline, multiplier, found_at) after each batch of headlines (source, link, title, published_at), in out by batch.

    A headline counts once within seven days by source, link and title; blank titles do not. The terms of the last two hours that the
    hours' summaries hold, `most_terms` at most, are counted exactly, by term and source first; exact takes all terms instead, without that bound. The
    baseline is a table of each term's count in the seven days before it was last made, over seven; it is made anew once it is refresh_minutes old, from counts by hour and, for the hour that
    begins before the seven days, from its headlines. Terms new since then have the baseline 0. A term that stands out is silent for the cooldown after it was found. Times are those of
    the newest headline, not the clock's. As that one's time never falls, a headline seven days older counts in no batch any more: its terms are not stored, so that a
    batch writes the files of some eight dates, however many it brings."""
    def work(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        with scratch(spark):
            before = version(spark, f"{table}-newest", n - 1, NEWEST).first()
            titles = batch.select("published_at", "source", title_terms(F.col("title"), blocked).alias("terms"))
            if before and before.newest:
                titles = titles.filter(F.col("published_at") > F.lit(before.newest - WEEK))
            titles = written(titles, "titles").filter(F.size("terms") > 0)
            newest = max(filter(None, [titles.agg(F.max("published_at")).first()[0], before and before.newest]), default=None)
            if newest is None:
                put(spark.createDataFrame([], NEWEST), f"{table}-newest", n)
                put(spark.createDataFrame([], ALERTED), f"{table}-alerted", n)
                return
            counting = titles.filter(F.col("published_at") > F.lit(newest - WEEK))
            each = written(counting.select("published_at", "source", F.explode("terms").alias("term")), "terms")
            by_hour = each.groupBy(F.date_trunc("hour", "published_at").alias("hour"), "term").agg(F.count("*").alias("n"))
            add(each, f"{table}-rows", "published_at", n)
            add(by_hour, f"{table}-hours", "hour", n)
            add(summaries(each, most_terms), f"{table}-summaries", "hour", n)

            due = not before or not before.refreshed or newest - before.refreshed >= timedelta(minutes=refresh_minutes)
            refreshed, held = (newest, n) if due else (before.refreshed, before.held)
            if due:
                since = newest - WEEK
                first_whole = (since + timedelta(hours=1)).replace(minute=0, second=0, microsecond=0)
                moment = timedelta(microseconds=1)
                whole = recent(f"{table}-hours", by_hour.limit(0), "hour", first_whole - moment, newest, n).select("term", "n")
                part = recent(f"{table}-rows", each.limit(0), "published_at", since, first_whole - moment, n).select("term", F.lit(1).cast("long").alias("n"))
                whole.unionByName(part).groupBy("term").agg(F.sum("n").alias("week")).write.mode("overwrite").parquet(f"{table}-baseline/version={n}")
            baseline = spark.read.schema(BASELINE).parquet(f"{table}-baseline/version={held}")

            since = newest - timedelta(hours=2)
            now = recent(f"{table}-rows", each.limit(0), "published_at", since, newest, n)
            if not exact:
                hours = recent(f"{table}-summaries", summaries(each.limit(0), most_terms).limit(0), "hour", since - timedelta(hours=1), newest, n)
                now = now.join(F.broadcast(frequent(hours, most_terms)), "term")  # most_terms rows at most
            by_source = now.groupBy("term", "source").agg(F.count("*").alias("n"))
            counts = by_source.groupBy("term").agg(F.sum("n").alias("recent_count"), F.count("*").alias("sources")).filter((F.col("recent_count") >= min_count) & (F.col("sources") >= min_sources))
            silent = version(spark, f"{table}-alerted", n - 1, ALERTED).filter(F.col("found_at") > F.lit(newest - timedelta(minutes=cooldown_minutes)))
            usual = F.coalesce(F.col("week") / F.lit(7.0), F.lit(0.0))
            judged = counts.join(baseline, "term", "left").withColumn("baseline", usual).filter((F.col("baseline") == 0) | (F.col("recent_count") > multiplier * F.col("baseline")))
            found = judged.join(silent, "term", "left_anti").select("term", "recent_count", "sources", "baseline", F.when(F.col("baseline") > 0, F.col("recent_count") / F.col("baseline")).otherwise(0.0).alias("multiplier"), F.lit(newest).alias("found_at"))
            found = written(found, "found")
            found.write.mode("overwrite").parquet(f"{out}/batch={n}")
            put(silent.unionByName(found.select("term", "found_at")), f"{table}-alerted", n)
            put(spark.createDataFrame([(newest, refreshed, held)], NEWEST), f"{table}-newest", n)

    return per_batch(distinct_headlines(headlines.filter(F.trim("title") != "")), checkpoint, work)
