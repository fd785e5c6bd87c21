"""Streams of append-only logs: latest row per key, first row per key, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .log_table import LogTable


def read_log(spark: SparkSession, folder: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """A folder of JSON line files as a stream; corrupt lines are dropped."""
    s = spark.readStream.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").option("maxFilesPerTrigger", per_trigger).json(folder)
    return s.filter("_corrupt_record is null").drop("_corrupt_record")


def upsert_latest(stream: DataFrame, keys: list[str], order: list[str], table: str, checkpoint: str, buckets: int = 32, max_deltas: int = 8):
    """Keep the last row of each key in a table of deltas; a batch that is run again changes nothing."""
    log = LogTable(stream.sparkSession, table, keys, order, stream.schema, buckets, max_deltas)
    return stream.writeStream.foreachBatch(lambda batch, epoch: log.append(batch, epoch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_rows(spark: SparkSession, table: str) -> DataFrame:
    """The last row of each key as of the last finished batch."""
    return LogTable(spark, table).read()


def first_per_key(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_rates(stream: DataFrame, time: str, key: str, value: str, width: str, delay: str, slide: str | None = None) -> DataFrame:
    """Rows and mean per window and key; late rows beyond the watermark are dropped."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width, slide or width), key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
