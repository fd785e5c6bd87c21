"""Order-dependent operators as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .order import places


def paced_schedule(df: DataFrame, lane: list[str], time: str, order: list[str], interval: float) -> DataFrame:
    """Start of each request when starts lie ``interval`` apart at least: start_i = max(time_i, start_i-1 + interval), in closed form."""
    w = Window.partitionBy(*lane).orderBy(*order)
    i = F.row_number().over(w) - 1
    slack = F.max(F.col(time) - F.col("_i") * interval).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_i", i).withColumn("start", F.col("_i") * interval + slack).drop("_i")


def failure_streaks(df: DataFrame, lane: list[str], order: list[str], failed: Column, short: float = 30.0, long: float = 120.0, from_streak: int = 3) -> DataFrame:
    """Length of the run of failures up to each row, and the pause that a breaker takes after it."""
    w = Window.partitionBy(*lane).orderBy(*order)
    d = df.withColumn("_f", failed).withColumn("_island", F.sum((~F.col("_f")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum(F.col("_f").cast("int")).over(Window.partitionBy(*lane, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("streak", run)
    return d.withColumn("cooldown", F.when(F.col("streak") == 0, 0.0).when(F.col("streak") >= from_streak, long).otherwise(short)).drop("_f", "_island")


def ecdf(df: DataFrame, keys: list[str], value: str, tie: list[str]) -> DataFrame:
    """k / n in sorted order; ties step one by one."""
    return places(df.filter(F.col(value).isNotNull()), keys, [value, *tie], "_place", "ecdf").drop("_place")


def earlier_duplicate(df: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """Was the same non-empty text seen earlier within the keys?"""
    n = F.row_number().over(Window.partitionBy(*keys, text).orderBy(*order))
    return df.withColumn("repeated", (n > 1) & (F.coalesce(F.col(text), F.lit("")) != ""))


def running_total(df: DataFrame, keys: list[str], order: list[str], value: str, out: str = "running") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))


def delta(df: DataFrame, keys: list[str], order: list[str], value: str, initial: float = 0.5, out: str = "delta") -> DataFrame:
    """Difference to the value before; the first to ``initial``."""
    return df.withColumn(out, F.col(value) - F.lag(value, 1, initial).over(Window.partitionBy(*keys).orderBy(*order)))
