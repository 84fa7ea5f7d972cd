"""Tables that a stream carries from batch to batch: a version a batch, written whole, of which the last two are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import removed


def version(spark: SparkSession, table: str, n: int, schema: str) -> DataFrame:
    """What the table held after batch n; nothing before the first batch."""
    return spark.read.schema(schema).parquet(f"{table}/version={n}") if n >= 0 else spark.createDataFrame([], schema)


def put(df: DataFrame, table: str, n: int) -> None:
    """The table after batch n. A batch that runs twice starts from n - 1 and writes n anew; older versions go."""
    df.write.mode("overwrite").parquet(f"{table}/version={n}")
    if n > 1:
        removed(df.sparkSession, f"{table}/version={n - 2}")
