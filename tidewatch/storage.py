"""Tables in the folder that the cluster shares, which cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_open = threading.local()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir. Only a local session without that setting gets a temporary folder; on a cluster no executor could share it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidewatch-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends here and survives lost executors. Within scratch() it is removed at the end."""
    path = shared_dir(df.sparkSession, name)
    for paths in getattr(_open, "scratches", [])[-1:]:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that written() makes in this block and thread when it ends: for work that has stored its results by then, such as that of a micro-batch."""
    _open.scratches = [*getattr(_open, "scratches", []), []]
    try:
        yield
    finally:
        *_open.scratches, paths = _open.scratches
        for path in paths:
            removed(spark, path)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew where its files give fewer partitions than there are cores: for long work on each row, which a table in few files would leave to few tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    # always true; as it is another value on each row, the optimizer moves no later filter, with the work that it does on each row, below the shuffle
    return df.repartition(cores).filter(F.monotonically_increasing_id() >= 0)


def file_system(spark: SparkSession, path: str):
    """The file system of a path, as Spark sees it, and the path there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def removed(spark: SparkSession, path: str) -> bool:
    """Removes a file or folder; whether there was one."""
    fs, where = file_system(spark, path)
    return fs.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return fs.exists(where)


def renamed(spark: SparkSession, path: str, to: str) -> bool:
    """Gives a file or folder another name in one step, unless that name is taken; whether it has it now."""
    fs, where = file_system(spark, path)
    target = file_system(spark, to)[1]
    return not fs.exists(target) and fs.rename(where, target)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, none where there is no such folder."""
    fs, where = file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def made(spark: SparkSession, folder: str) -> None:
    """Makes a folder and those above it."""
    fs, where = file_system(spark, folder)
    fs.mkdirs(where)
