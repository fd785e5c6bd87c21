"""Deterministic sampling and batching by md5 order, the same in any engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.semantics import hash_order


def balanced_sample(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, taking one of each group in turn; groups and rows in hash order."""
    d = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(hash_order(seed, F.col(key)), key)).cast("long"))
    d = d.withColumn("_g", hash_order(seed, F.col(group)))
    return d.orderBy("turn", "_g", key).limit(n).drop("_g")


def require_rows(df: DataFrame, n: int) -> DataFrame:
    """The rows, if there are n of them."""
    found = df.count()
    if found != n:
        raise ValueError(f"{found} rows, {n} needed")
    return df


def stratified_batches(df: DataFrame, group: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """Batches that deal each group out evenly: position in order of group and hash, modulo k.

    Positions are counts before a group plus places within it, so no task orders all rows.
    """
    d = df.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(hash_order(seed, F.col(key)), key)))
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(F.col(group).alias("_g"), F.coalesce(F.sum("_n").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    j = d.join(sizes, d[group].eqNullSafe(sizes["_g"]))
    return j.withColumn("batch", F.pmod(F.col("_before") + F.col("_place") - 1, F.lit(k))).drop("_place", "_g", "_before")


def smoke_choice(df: DataFrame, dataset: str, subject: str, key: str, quotas: dict[str, int]) -> DataFrame:
    """The first row of each (dataset, subject), then so many of each dataset."""
    first = df.withColumn("_n", F.row_number().over(Window.partitionBy(dataset, subject).orderBy(key))).filter("_n = 1")
    first = first.withColumn("_k", F.row_number().over(Window.partitionBy(dataset).orderBy(key)))
    quota = F.lit(0)
    for name, q in quotas.items():
        quota = F.when(F.col(dataset) == name, q).otherwise(quota)
    return first.filter(F.col("_k") <= quota).drop("_n", "_k")


def random_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, in hash order."""
    return df.orderBy(hash_order(seed, F.col(key)), key).limit(n)
