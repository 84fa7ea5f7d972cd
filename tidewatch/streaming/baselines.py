"""Hourly baselines as keyed state that can be saved, loaded and gone on with."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..storage import exists, names_in, removed, renamed

#: State of a key: samples, mean, squared deviations, the last count and its hour, the hour of the last alert; times in milliseconds.
STATE = "samples long, mean double, m2 double, last long, last_ms long, alerted long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Baseline(StatefulProcessor):
    """Holds each hour of a key against those before, in order, and counts it in."""

    def __init__(self, by: str, min_samples: int, z: float, min_sd: float, cooldown_ms: int):
        self.by, self.min_samples, self.z, self.min_sd, self.cooldown_ms = by, min_samples, z, min_sd, cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("baseline", STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        whole = [None if pd.isna(row[c]) else int(row[c]) for c in ("last", "last_ms", "alerted")]
        self.state.update((int(row["samples"]), float(row["mean"]), float(row["m2"]), *whole))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        samples, mean, m2, last, last_ms, alerted = self.state.get() if self.state.exists() else (0, 0.0, 0.0, None, None, None)
        found = []
        for ms, n in pd.concat(list(rows)).sort_values("ms")[["ms", "n"]].itertuples(index=False):
            sd = (m2 / (samples - 1)) ** 0.5 if samples > 1 else 0.0
            score = (n - mean) / sd if sd >= self.min_sd else 0.0
            if samples + 1 >= self.min_samples and abs(score) >= self.z and (alerted is None or ms - alerted >= self.cooldown_ms):
                alerted = int(ms)
                found.append((key[0], alerted, int(n), mean, score))
            samples, step = samples + 1, n - mean
            mean += step / samples
            m2 += step * (n - mean)
            last, last_ms = int(n), int(ms)
        self.state.update((samples, float(mean), float(m2), last, last_ms, alerted))
        yield pd.DataFrame(found, columns=[self.by, "ms", "n", "mean", "z"])

    def close(self) -> None:
        pass


def baseline_alerts(hourly: DataFrame, by: str, saved: DataFrame | None = None, min_samples: int = 24, z: float = 2.5, min_sd: float = 0.5, cooldown_h: int = 2) -> DataFrame:
    """(by, ms, n, mean, z): hours of a key (by, hour, n) whose count lies z deviations off those before; alerts of a key are cooldown_h apart at least.

    Hours must come in order, as closed windows do. saved (by and the fields of STATE, a row a key) is what a first start goes on from; a restart has its own
    checkpoint. A key's state has one size and no end. The session's state store must be RocksDB."""
    hourly.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = hourly.select(by, F.unix_millis("hour").alias("ms"), "n")
    processor = Baseline(by, min_samples, z, min_sd, cooldown_h * 3_600_000)
    initial = saved.groupBy(by) if saved is not None else None
    return rows.groupBy(by).transformWithStateInPandas(processor, f"{by} string, ms long, n long, mean double, z double", "append", "none", initialState=initial)


def state_table(spark: SparkSession, checkpoint: str, by: str) -> DataFrame:
    """The baselines (by and the fields of STATE) that a stream holds, read from its state store."""
    rows = spark.read.format("statestore").option("stateVarName", "baseline").load(checkpoint)
    return rows.select(F.col("key").getField(by).alias(by), "value.*")


def save_baselines(baselines: DataFrame, folder: str) -> int:
    """Saves baselines as the folder's next version, which is there as a whole or not at all: it is written beside and gets its name by one rename. Returns the
    version. Of two writers one takes the number and the other the next."""
    spark = baselines.sparkSession
    found = versions(spark, folder)
    n = found[-1] + 1 if found else 0
    while True:
        temporary = f"{folder}/.version={n}-{spark.sparkContext.applicationId}-{id(baselines)}"
        if not exists(spark, temporary):
            baselines.write.parquet(temporary)
        if renamed(spark, temporary, f"{folder}/version={n}"):
            return n
        removed(spark, temporary)
        n += 1


def versions(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(name.split("=")[1]) for name in names_in(spark, folder) if name.startswith("version="))


def load_baselines(spark: SparkSession, folder: str, at: int | None = None) -> DataFrame:
    """The baselines of a version, the last one by default."""
    found = versions(spark, folder)
    if not found or at is not None and at not in found:
        raise ValueError(f"{folder} holds no version {'' if at is None else at}")
    return spark.read.parquet(f"{folder}/version={found[-1] if at is None else at}")
