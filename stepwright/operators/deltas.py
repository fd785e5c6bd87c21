"""Judge and critic results carried through labels, Q, token utility, E and the sums of tables as deltas.

A change set names some keys. Only their steps and rows are read (steps are stored by
a hash of the key, so only the touched buckets are), their measures are computed anew,
and the differences are added to the sums from which the tables' means come. The rest
of the run is neither read nor written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .steps import apply_critic, apply_judge, overall, quality, token_utility

MEASURES = ("C_final", "V", "Q", "PTU", "E")
_BUCKET = "_bucket"


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def store_by_key(df: DataFrame, keys: list[str], path: str, buckets: int = 64) -> None:
    """Write rows in folders by a hash of their key."""
    df.withColumn(_BUCKET, _bucket(keys, buckets)).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(path)


def read_touched(spark: SparkSession, path: str, touched: DataFrame, keys: list[str], buckets: int = 64) -> DataFrame:
    """The stored rows of some keys: their buckets are literals of the scan, so other folders are not opened."""
    wanted = sorted(r[0] for r in touched.select(_bucket(keys, buckets)).distinct().collect())  # at most ``buckets`` numbers
    d = spark.read.parquet(path).filter(F.col(_BUCKET).isin(wanted)).drop(_BUCKET)
    return d.join(touched.select(*keys).distinct(), keys, "left_semi")


def touched_keys(judged: DataFrame, critic: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with a successful result of either kind."""
    some = [x.filter("status = 'success'").select(*keys) for x in (judged, critic)]
    return some[0].unionByName(some[1]).distinct()


def changes(metrics: DataFrame, steps: DataFrame, judged: DataFrame, critic: DataFrame, keys: list[str], order: str, by: str) -> DataFrame:
    """keys, ``by``, and each measure before and after, of the touched rows.

    ``metrics`` and ``steps`` are those of touched keys. C, V follow the judge, labels
    and Q the critic, PTU both, E all where the attempt is valid. Q stays where no step
    was changed.
    """
    said = critic.filter("status = 'success'").select(*keys).distinct().withColumn("_said", F.lit(True))
    labelled = apply_critic(steps, critic, [*keys, order])
    q = quality(labelled, *keys).join(said, keys, "left_semi").select(*keys, F.col("q_step").alias("_q"))
    t = token_utility(labelled, *keys).select(*keys, F.col("ptu").alias("_t"))
    old = metrics.select(*keys, by, *(F.col(m).cast("double").alias(f"{m}_old") for m in MEASURES))
    j = apply_judge(metrics, judged, keys).join(q, keys, "left").join(t, keys, "left")
    j = j.withColumn("Q", F.coalesce("_q", "Q")).withColumn("PTU", F.coalesce("_t", "PTU"))
    j = j.withColumn("E", F.when(F.coalesce("valid", F.lit(False)), overall(F.col("V"), F.col("PTU"), F.col("Q"), F.col("R"))).otherwise(F.col("E")))
    return old.join(j.select(*keys, *(F.col(m).cast("double").alias(f"{m}_new") for m in MEASURES)), keys)


def summary_sums(metrics: DataFrame, by: str) -> DataFrame:
    """``by``, n, and the sum and count of each measure: what the tables' means are made of."""
    each = [f(m).alias(f"{m}_{kind}") for m in MEASURES for f, kind in ((lambda c: F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)), "sum"), (F.count, "count"))]
    return metrics.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *each)


def add_changes(sums: DataFrame, changed: DataFrame, by: str) -> DataFrame:
    """The sums after the changes, without the rows that did not change."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    known = lambda c: F.col(c).isNotNull().cast("long")
    d = changed.groupBy(by).agg(*(F.sum(zero(f"{m}_new") - zero(f"{m}_old")).alias(f"_{m}_sum") for m in MEASURES), *(F.sum(known(f"{m}_new") - known(f"{m}_old")).alias(f"_{m}_count") for m in MEASURES))
    j = sums.join(d, by, "left")
    return j.select(by, "n", *((F.col(f"{m}_{k}") + F.coalesce(F.col(f"_{m}_{k}"), F.lit(0))).alias(f"{m}_{k}") for m in MEASURES for k in ("sum", "count")))


def means(sums: DataFrame, by: str) -> DataFrame:
    """``by``, n and each measure's mean."""
    return sums.select(by, "n", *(F.try_divide(F.col(f"{m}_sum"), F.col(f"{m}_count")).alias(m) for m in MEASURES))
