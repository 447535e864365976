"""Latest-wins state of a growing attempt log, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.latest import latest_wins


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def upsert_latest(log: DataFrame, state: str, checkpoint: str, keys: list[str], seq: str):
    """Keep the latest row of each key under ``state`` (versions by batch: a batch that runs again writes the same)."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = [f"{state}/v{number - 1}"] if number else []
        rows = latest_wins(batch, keys, seq)
        if old:
            rows = latest_wins(rows.unionByName(spark.read.schema(batch.schema).parquet(old[0]).select(*rows.columns)), keys, seq)
        rows.select(*batch.columns).write.mode("overwrite").parquet(f"{state}/v{number}")

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def status_counts(log: DataFrame, time: str, status: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Attempts by status and window, with late rows up to ``late``."""
    return log.withWatermark(time, late).groupBy(F.window(time, window), status).count()
