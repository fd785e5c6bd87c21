"""Versions, joins of archives, grids and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .order import places


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unique_by(df: DataFrame, *keys: str) -> DataFrame:
    """The rows, or an error while they are read if a key repeats or is blank."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "")
    bad = F.when(blank, F.raise_error(F.lit("blank key"))).when(n > 1, F.raise_error(F.concat(F.lit("duplicate key: "), F.to_json(F.struct(*keys)))))
    return df.withColumn("_bad", bad.cast("string")).filter("_bad is null").drop("_bad")


def change_events(df: DataFrame, keys: list[str], order: list, digest: str, carry: list[str]) -> DataFrame:
    """One row per change of a key's digest in version order: event added or replaced, ``carry`` now and before (prev_)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_prev", F.lag(digest).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    d = d.filter(F.col("_first") | ~F.col(digest).eqNullSafe(F.col("_prev")))
    before = [F.lag(c).over(w).alias(f"prev_{c}") for c in carry]
    event = F.when(F.lag(F.lit(1)).over(w).isNull(), "added").otherwise("replaced").alias("event")
    return d.select("*", event, *before).drop("_prev", "_first")


def latest_version(df: DataFrame, keys: list[str], order: list, digest: str, carry: list[str]) -> DataFrame:
    """The last state of each key, with the provenance of the first version that had this content."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() if isinstance(c, Column) else F.col(c).desc() for c in order])
    events = change_events(df, keys, order, digest, carry)
    return events.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def repaired_wins(original: DataFrame, repaired: DataFrame, *keys: str) -> DataFrame:
    """The union of keys; the repaired row where there is one, else the original; ``origin`` says which."""
    o, r = original.withColumn("_p", F.lit(1)), repaired.withColumn("_p", F.lit(0))
    w = Window.partitionBy(*keys).orderBy("_p")
    both = o.unionByName(r).withColumn("_n", F.row_number().over(w))
    return both.filter("_n = 1").withColumn("origin", F.when(F.col("_p") == 0, "repaired").otherwise("original")).drop("_n", "_p")


def grid_gaps(actual: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Cells that the grid of both small key tables expects and that are missing, and cells that it does not expect."""
    keys = [*rows.columns, *columns.columns]
    grid, have = rows.crossJoin(F.broadcast(columns)), actual.select(*keys).distinct()
    return grid.join(have, keys, "left_anti").withColumn("gap", F.lit("missing")).unionByName(have.join(grid, keys, "left_anti").withColumn("gap", F.lit("unexpected")))


def disjoint_union(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Both row sets; an error if they share a key."""
    return unique_by(a.unionByName(b), *keys)


def assert_empty(df: DataFrame, message: str) -> None:
    """Fail closed: an error that names the first violations."""
    found = df.limit(10).collect()
    if found:
        raise ValueError(f"{message}: {[r.asDict() for r in found]}")


def definition_conflicts(df: DataFrame, key: str, digest: Column) -> DataFrame:
    """Keys that come with more than one content."""
    return df.groupBy(key).agg(F.countDistinct(digest).alias("versions")).filter("versions > 1")


def pending(grid: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Work that is not done yet."""
    return grid.join(done.select(*keys).distinct(), list(keys), "left_anti")


def lanes(tasks: DataFrame, key: str, n: int, cached: DataFrame | None = None) -> DataFrame:
    """Lane of each task: position in key order modulo lanes; finished tasks leave without renumbering the others."""
    numbered = places(tasks, [], [key], "lane").withColumn("lane", F.pmod("lane", F.lit(n)).cast("long"))
    return numbered if cached is None else numbered.join(cached.select(key).distinct(), key, "left_anti")
