"""Escalation of hotspots as a stream: each hotspot's scores of the last day in its state, and what each new score means against them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .baselines import PROVIDER

DAY_MS, POINTS = 86_400_000, 49
STATE = "times array<bigint>, scores array<double>, last double, signalled long"


def slope_of(scores: list[float]) -> float:
    """Of the line through scores one step apart, to nine places; 0 for fewer than three."""
    n = len(scores)
    if n < 3:
        return 0.0
    middle, mean = (n - 1) / 2, sum(scores) / n
    return round(sum((i - middle) * (x - mean) for i, x in enumerate(scores)) / (n * (n * n - 1) / 12), 9) + 0.0


def signal_of(before: float | None, score: float) -> str | None:
    """What a score means after the one before: crossing a whole number from 2 on, a jump by 0.5, or crossing 4.5; a first score means nothing."""
    if before is None:
        return None
    if math.floor(score) > math.floor(before) and score >= 2:
        return "threshold"
    if score - before >= 0.5:
        return "jump"
    return "critical" if before < 4.5 <= score else None


class History(StatefulProcessor):
    """One hotspot: scores come in order of time; those of the last day, 49 at most, are kept."""

    def __init__(self, cooldown_ms: int):
        self.cooldown_ms = cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("history", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times, scores, last, signalled = self.state.get() if self.state.exists() else ([], [], None, None)
        own, found = [*zip(times, scores, strict=True)], []
        for ms, score in pd.concat(list(rows)).sort_values("ms")[["ms", "score"]].itertuples(index=False):
            ms, score = int(ms), float(score)
            own = [x for x in own if ms - x[0] <= DAY_MS][-(POINTS - 1) :] + [(ms, score)]
            signal = signal_of(last, score)
            if signal and (signalled is None or ms - signalled >= self.cooldown_ms):
                signalled = ms
            else:
                signal = None
            values = [x for _, x in own]
            found.append((key[0], ms, score, slope_of(values), score - values[0], signal))
            last = score
        self.state.update(([t for t, _ in own], [x for _, x in own], last, signalled))
        yield pd.DataFrame(found, columns=["id", "ms", "score", "slope", "change_24h", "signal"])

    def close(self) -> None:
        pass


def escalation_history(scores: DataFrame, cooldown_h: int = 2) -> DataFrame:
    """(id, ms, score, slope, change_24h, signal) for each score of a stream (id string, at, score) whose scores of an id come in order: slope over their index and change from first to
    last of the last day's scores, 49 at most, and the signal if it is one and comes cooldown_h or more after the last. A hotspot's state has one size and no end; the session's
    state store must be RocksDB."""
    scores.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = scores.select("id", F.unix_millis("at").alias("ms"), F.col("score").cast("double").alias("score"))
    return rows.groupBy("id").transformWithStateInPandas(History(cooldown_h * 3_600_000), "id string, ms long, score double, slope double, change_24h double, signal string", "append", "none")
