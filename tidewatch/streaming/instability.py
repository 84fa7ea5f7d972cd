"""Weekly instability of countries as a stream: a ring of hourly counts in each country's state, and a score at each hour."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from .baselines import PROVIDER

HOUR_MS, RING = 3_600_000, 168
#: The hours of the ring end with `hour`; ticks: hours since the country's first one, the ring's length at most.
STATE = "hour long, ticks int, counts array<bigint>, weights array<double>"
SCORES = "country string, ms long, n long, trend string, score long"


def trend_of(counts: list[int], ticks: int) -> str:
    """The mean of the last 24 hours against the 24 before; stable before there are 48."""
    if ticks < 48:
        return "stable"
    recent, older = sum(counts[-24:]), sum(counts[-48:-24])
    ratio = recent / older if older else 2.0 if recent else 1.0
    return "accelerating" if ratio > 1.3 else "decelerating" if ratio < 0.7 else "stable"


class Ticks(StatefulProcessor):
    """One country: hours come in order, and the hours between them count 0; where none comes, a timer moves the ring on until it is empty."""

    def __init__(self, sanctioned: list[str], conflict: list[str]):
        self.sanctioned, self.conflict = set(sanctioned), set(conflict)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("ring", STATE)

    def score(self, country: str, hour: int, ticks: int, counts: list[int], weights: list[float]) -> tuple:
        n, trend = sum(counts), trend_of(counts, ticks)
        base = 10 * (country in self.sanctioned) + 10 * (country in self.conflict)
        raw = min(40.0, n / 50 * 40) + min(30.0, sum(weights) / 150 * 30) + {"accelerating": 10, "decelerating": -5, "stable": 0}[trend] + base
        return country, hour, n, trend, max(0, min(100, math.floor(raw + 0.5)))

    def walked(self, country: str, hours: list[tuple[int, int, float]], until: int | None) -> Iterator[pd.DataFrame]:
        """Moves the ring over the given hours, then over empty ones up to until; gives a row an hour. Keeps a timer while the ring holds anything."""
        hour, ticks, counts, weights = self.state.get() if self.state.exists() else (None, 0, [0] * RING, [0.0] * RING)
        counts, weights, rows, timer = list(counts), list(weights), [], hour

        def tick(at: int, n: int, weight: float):
            nonlocal hour, ticks
            hour, ticks = at, min(RING, ticks + 1)
            counts[:], weights[:] = [*counts[1:], n], [*weights[1:], weight]
            rows.append(self.score(country, hour, ticks, counts, weights))

        for at, n, weight in hours:
            while hour is not None and hour + HOUR_MS < at and any(counts):
                tick(hour + HOUR_MS, 0, 0.0)
            if hour is not None and hour + HOUR_MS < at:
                ticks = 0  # it was forgotten meanwhile
            tick(at, n, weight)
        while until is not None and hour is not None and hour + 2 * HOUR_MS <= until and any(counts):
            tick(hour + HOUR_MS, 0, 0.0)
        if timer is not None:
            self.handle.deleteTimer(timer + 2 * HOUR_MS)
        if any(counts):
            self.state.update((hour, ticks, counts, weights))
            self.handle.registerTimer(hour + 2 * HOUR_MS)
        else:
            self.state.clear()
        yield pd.DataFrame(rows, columns=["country", "ms", "n", "trend", "score"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("ms")
        yield from self.walked(key[0], [(int(a), int(b), float(c)) for a, b, c in frame[["ms", "n", "weight"]].itertuples(index=False)], None)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.walked(key[0], [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def signal_weight(severity_weights: dict[int, float], category_risk: dict[str, float]) -> Column:
    """Severity times risk of a signal's category, 1 for what is not listed."""
    weight, risk = F.lit(1.0), F.lit(1.0)
    for k, v in severity_weights.items():
        weight = F.when(F.col("severity") == k, float(v)).otherwise(weight)
    for k, v in category_risk.items():
        risk = F.when(F.col("category") == k, float(v)).otherwise(risk)
    return weight * risk


def hourly_signals(signals: DataFrame, weight: Column, late: str = "1 hour") -> DataFrame:
    """(country, hour, n, weight) of closed hours of signals (country, category, severity, ts); countries without a name have none."""
    named = signals.withColumn("country", F.lower(F.trim("country"))).filter("country <> ''").withColumn("weight", weight)
    closed = named.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "country").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    return closed.select("country", F.col("window.start").alias("hour"), "n", "weight")


def instability_ticks(hourly: DataFrame, sanctioned: list[str], conflict: list[str]) -> DataFrame:
    """(country, ms, n, trend, score) for each hour from a country's first signal on, until its last 168 hours are empty: then it is forgotten.

    hourly has (country, hour, n, weight) as a stream in order of hours, as hourly_signals gives it. A country's state is one ring of 168 hours. The session's state store must be RocksDB."""
    hourly.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = hourly.withWatermark("hour", "0 seconds").select("country", F.unix_millis("hour").alias("ms"), "n", "weight", "hour")
    return rows.groupBy("country").transformWithStateInPandas(Ticks(sanctioned, conflict), SCORES, "append", "eventtime")


def ranked(ticks: DataFrame, most: int = 250) -> DataFrame:
    """Ticks with their rank within the hour by score, the `most` highest: the bound on countries is one on what is reported, state holds them all."""
    order = Window.partitionBy("ms").orderBy(F.desc("score"), "country")
    return ticks.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)
