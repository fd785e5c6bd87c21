"""Missing values, shares and hashes, defined once for every operator.

Missing is NULL everywhere: NaN, infinities, blanks and text that is no number
become NULL on entry, so averages skip them. Group keys that are NULL are left
out where a table is by key. A sum of nothing is 0. Divisions name their guard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def num(c: Column) -> Column:
    """A finite double, or NULL."""
    d = c.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_floor(a: Column, b: Column, floor: float = 1e-12) -> Column:
    """a / max(b, floor)."""
    return a.cast("double") / F.greatest(b.cast("double"), F.lit(floor))


def total(c: Column) -> Column:
    """Sum, 0 over nothing."""
    return F.coalesce(F.sum(c), F.lit(0))


def keyed(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose group keys are all present."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df


def share_within(n: str, *keys: str) -> Column:
    """Share of a count in its group's total."""
    return F.col(n) / F.sum(n).over(Window.partitionBy(*keys))


def hash_pick(seed: int, *parts: Column, of: Column) -> Column:
    """A pseudorandom index below ``of`` from md5 of seed and parts joined by ':'; the same in any SQL engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % of.cast("long")


def hash_order(seed: int, *parts: Column) -> Column:
    """A pseudorandom sort key: md5 of seed and parts joined by ':'."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def canonical_digest(json: Column) -> Column:
    """sha256 of a JSON text with keys in order; numerals and spaces do not matter."""
    return F.sha2(F.to_json(F.parse_json(json)), 256)


def last_of(a: Column, k: int) -> Column:
    """The last k elements, or all if there are fewer."""
    n = F.least(F.lit(k), F.size(a))
    return F.when(n > 0, F.slice(a, -F.greatest(n, F.lit(1)), F.greatest(n, F.lit(1)))).otherwise(F.slice(a, 1, 0))
