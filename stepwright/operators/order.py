"""Places, ranks, quantiles and frontiers without a task that orders a whole group.

All stand on one stored sort: rows are dealt into ranges of (keys, value) and written
once with the number of their range, so that every later pass sees the same ranges.
The ranges' totals are a small table, and a running sum over it says what lies before
each range; what lies before a row within its range takes a window over key and range.
Ranges are as many as Spark makes of the rows: they grow with the rows, not with the
groups, and one group with all rows is spread as any other. A value that many rows
have is one row of a histogram; where each row needs its own place, the tie columns
part them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_RANGE, _BEFORE, _WITHIN, _COUNT = "_range", "_before", "_within", "_count"


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder that executors share: below spark.checkpoint.dir, or a temporary one on a local master."""
    import atexit
    import shutil
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix=f"{tag}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"{folder}/table"


def stored(df: DataFrame, tag: str = "stored") -> DataFrame:
    """The rows as a table in the shared folder: what is computed from it again and again was computed once."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, *order: str | Column) -> DataFrame:
    """The rows stored in order, with the number of the range of each; numbers follow the order."""
    d = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(d.withColumn(_RANGE, F.spark_partition_id()), "ranges")


def _running(ranged: DataFrame, keys: list[str], count: Column, out: str) -> DataFrame:
    """keys, range and the total of ``count`` in the ranges before it; a row per key and range."""
    totals = ranged.groupBy(*keys, _RANGE).agg(F.sum(count).alias(_COUNT))
    before = Window.partitionBy(*keys).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(out, F.coalesce(F.sum(_COUNT).over(before), F.lit(0))).withColumn(f"{out}_all", F.sum(_COUNT).over(Window.partitionBy(*keys)))


def _same(a: str, b: str, keys: list[str]) -> Column:
    """Join condition on keys that may be NULL, and on the range."""
    on = F.col(f"{a}.{_RANGE}") == F.col(f"{b}.{_RANGE}")
    for k in keys:
        on = on & F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`"))
    return on


def _with_before(ranged: DataFrame, keys: list[str], order: list, count: Column) -> DataFrame:
    """Adds ``_before``, the total of ``count`` over the rows of the key that come earlier, and ``_all``, over all rows of the key."""
    inner = Window.partitionBy(*keys, _RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = ranged.withColumn(_WITHIN, F.coalesce(F.sum(count).over(inner), F.lit(0)))
    t = _running(ranged, keys, count, _BEFORE)
    j = d.alias("d").join(t.alias("t"), _same("d", "t", keys))
    return j.select("d.*", (F.col(f"t.{_BEFORE}") + F.col(_WITHIN)).alias(_BEFORE), F.col(f"t.{_BEFORE}_all").alias("_all")).drop(_WITHIN, _RANGE)


def places(df: DataFrame, keys: list[str], order: list[str], out: str, share: str | None = None, rows: str | None = None) -> DataFrame:
    """Place of each row within its key from 0, nulls first; ``share``: (place + 1) / rows of the key; ``rows``: those rows."""
    d = _with_before(in_ranges(df, *keys, *order), keys, order, F.lit(1).cast("long")).withColumnRenamed(_BEFORE, out)
    if share:
        d = d.withColumn(share, (F.col(out) + 1) / F.col("_all"))
    return d.withColumnRenamed("_all", rows) if rows else d.drop("_all")


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, ``_n``: rows of each value that is not NULL, added up before the shuffle."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))


def average_ranks(counted: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The rows of a histogram with their rank, ties at their mean, and ``_all``, the rows of the key."""
    d = _with_before(in_ranges(counted, *keys, value), keys, [value], F.col("_n"))
    return d.withColumn(out, F.col(_BEFORE) + (F.col("_n") + 1) / 2.0).drop(_BEFORE)


def quantiles(df: DataFrame, keys: list[str], value: str, at: list[float], names: list[str]) -> DataFrame:
    """keys and exact quantiles, linear between neighbours.

    A histogram of values in stored ranges; the ranges' totals say which range has the
    wanted places, and only the values of those ranges are added up one by one.
    """
    ranged = in_ranges(histogram(df, keys, value), *keys, value)
    t = _running(ranged, keys, F.col("_n"), _BEFORE)
    last = F.col(f"{_BEFORE}_all") - 1
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), (last * F.lit(q)).alias("place")) for i, q in enumerate(at)))
    t = t.withColumn("_q", F.explode(wanted)).filter((F.ceil("_q.place") >= F.col(_BEFORE)) & (F.floor("_q.place") < F.col(_BEFORE) + F.col(_COUNT)))
    need = t.groupBy(*keys, _RANGE, _BEFORE).agg(F.collect_list("_q").alias("_q"))
    d = ranged.alias("d").join(need.alias("t"), _same("d", "t", keys)).select("d.*", f"t.{_BEFORE}", "t._q")
    upto = Window.partitionBy(*keys, _RANGE).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_to", F.col(_BEFORE) + F.sum("_n").over(upto)).withColumn("_from", F.col("_to") - F.col("_n")).withColumn("_q", F.explode("_q"))
    holds = lambda p: (p >= F.col("_from")) & (p < F.col("_to"))
    low, high = F.floor("_q.place"), F.ceil("_q.place")
    v = F.col(value).cast("double")
    g = d.filter(holds(low) | holds(high)).groupBy(*keys, F.col("_q.i").alias("_i"), (F.col("_q.place") - low).alias("_part")).agg(F.max(F.when(holds(low), v)).alias("_l"), F.max(F.when(holds(high), v)).alias("_h"))
    g = g.withColumn("_x", F.col("_l") + (F.col("_h") - F.col("_l")) * F.col("_part"))
    return g.groupBy(*keys).agg(*(F.max(F.when(F.col("_i") == i, F.col("_x"))).alias(n) for i, n in enumerate(names)))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, rho, mean absolute difference of two columns where both are present; rho NULL for n <= 1.

    Rows are counted by (x, y) first; ranks come from the histograms of x and of y, and
    are taken from their mean before they are multiplied.
    """
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = stored(both.groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_c")), "cells")
    j = cells
    for v, out in (("_x", "_rx"), ("_y", "_ry")):
        h = cells.groupBy(*keys, v).agg(F.sum("_c").alias("_n"))
        r = average_ranks(h, keys, v, out)
        on = F.col(f"a.{v}") == F.col(f"b.{v}")
        for k in keys:
            on = on & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
        j = j.alias("a").join(r.alias("b"), on).select("a.*", (F.col(out) - (F.col("_all") + 1) / 2.0).alias(out))
    s = lambda c: F.sum(F.col("_c") * c)
    rx, ry = F.col("_rx"), F.col("_ry")
    g = j.groupBy(*keys).agg(F.sum("_c").alias("n"), s(rx * ry).alias("_xy"), s(rx * rx).alias("_xx"), s(ry * ry).alias("_yy"), (s(F.abs(F.col("_x") - F.col("_y"))) / F.sum("_c")).alias("mean_abs_diff"))
    rho = F.when((F.col("n") > 1) & (F.col("_xx") > 0) & (F.col("_yy") > 0), F.col("_xy") / F.sqrt(F.col("_xx")) / F.sqrt(F.col("_yy")))
    return g.select(*keys, "n", rho.alias("rho"), "mean_abs_diff")


def frontier(df: DataFrame, cost: str, value: str) -> DataFrame:
    """Rows that no other row beats: none is cheaper or as cheap with at least the value, one of both strictly.

    Each task keeps the frontier of its own rows, which holds all of the whole one; what
    is left is stored, and the best value of each cost is compared with the best of all
    cheaper ranges of cost and of cheaper costs in its range.
    """
    left = stored(_own_frontiers(df.filter(F.col(cost).isNotNull() & F.col(value).isNotNull()), cost, value), "frontier")
    best = in_ranges(left.groupBy(F.col(cost).alias("_cost")).agg(F.max(value).alias("_best")), "_cost")
    w = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    tops = best.groupBy(_RANGE).agg(F.max("_best").alias("_top")).withColumn("_cheaper", F.max("_top").over(w)).select(_RANGE, "_cheaper")
    within = F.max("_best").over(Window.partitionBy(_RANGE).orderBy("_cost").rowsBetween(Window.unboundedPreceding, -1))
    on_it = best.withColumn("_within", within).join(tops, _RANGE)
    beaten = F.coalesce(F.greatest("_within", "_cheaper") >= F.col("_best"), F.lit(False))
    on_it = on_it.filter(~beaten).select("_cost", "_best")
    return left.join(on_it, (F.col(cost) == F.col("_cost")) & (F.col(value) == F.col("_best"))).drop("_cost", "_best")


def _own_frontiers(df: DataFrame, cost: str, value: str) -> DataFrame:
    """The frontier of each task's rows; more may stay where very many rows tie. Numbers that a double may round are all kept."""
    import numpy as np
    import pyarrow as pa

    at = [df.columns.index(c) for c in (cost, value)]
    if not {df.dtypes[i][1] for i in at} <= {"double", "float", "int", "smallint", "tinyint"}:
        return df

    def keep(c, v):
        order = np.lexsort((-v, c))  # the best row of each cost comes first
        starts = np.flatnonzero(np.diff(c[order], prepend=np.nan) != 0)
        best = v[order[starts]]
        cheaper = np.maximum.accumulate(best)[:-1]
        on_it = np.concatenate([[True], best[1:] > cheaper])
        cell = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(order)))
        return np.sort(order[on_it[cell] & (v[order] == best[cell])])

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            held = b if held is None else pa.concat_batches([held, b])
            c, v = (held.column(i).to_numpy(zero_copy_only=False).astype(float) for i in at)
            held = held.take(pa.array(keep(c, v)))
            if held.num_rows > 100_000:  # memory stays bounded; later rows are compared among themselves
                yield held
                held = None
        if held is not None:
            yield held

    return df.mapInArrow(run, df.schema)
