"""Intervals, tests, resampling and frontiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.semantics import ratio

Z95 = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson interval of k successes in n, clipped to [0, 1]; NULL where n is not positive."""
    k, n = k.cast("double"), F.when(n > 0, n.cast("double"))
    p, zz = k / n, z * z
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) * z / (1 + zz / n)
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), centre - half)), F.when(n.isNotNull(), F.least(F.lit(1.0), centre + half))


#: Sums of binomial terms are kept below this power of two; what is taken out is paid from the factor 0.5^n.
_SCALE = 512


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p of b against c discordant pairs; 1 without any.

    Binomials of any n: 0.5^n is no double beyond n = 1074, so the halves that a term
    has not yet been given are counted beside it.
    """
    n, k = (b + c).cast("int"), F.least(b, c).cast("int")
    given = F.least(n, F.lit(_SCALE))
    first = F.pow(F.lit(0.5), given)
    state = F.struct(first.alias("term"), first.alias("sum"), (n - given).alias("halves"))
    steps = F.when(k > 0, F.sequence(F.lit(1), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<int>"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] * (n - i + 1) / i
        given = F.when(term > 1, F.least(a["halves"], F.lit(_SCALE))).otherwise(0)
        scale = F.pow(F.lit(0.5), given)
        return F.struct((term * scale).alias("term"), ((a["sum"] + term) * scale).alias("sum"), (a["halves"] - given).alias("halves"))

    end = F.aggregate(steps, state, step)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * end["sum"] * F.pow(F.lit(0.5), end["halves"])))


def holm(df: DataFrame, p: str, family: list[str], tie: list[str], out: str = "p_holm", by: str | None = None) -> DataFrame:
    """Holm's adjustment within a family of tests, in order of p, or of ``by`` (p rounded, say) if given."""
    w = Window.partitionBy(*family).orderBy(by or p, *tie)
    m, r = F.count(F.lit(1)).over(Window.partitionBy(*family)), F.row_number().over(w)
    raw = F.least(F.lit(1.0), (m - r + 1) * F.col(p))
    return df.withColumn("_raw", raw).withColumn(out, F.max("_raw").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_raw")


def pair_outcomes(df: DataFrame, agent: str, problem: str, value: str) -> DataFrame:
    """left, right, problem, x, y for each pair of agents on the problems that both have."""
    d = df.filter(F.col(value).isNotNull()).select(agent, problem, value)
    l, r = d.toDF("left", problem, "x"), d.toDF("right", problem, "y")
    return l.join(r, problem).filter("left < right")


def paired_tests(df: DataFrame, agent: str, problem: str, value: str) -> DataFrame:
    """left, right, n, both discordant counts, mean difference and exact p of each pair of agents."""
    j = pair_outcomes(df, agent, problem, value)
    g = j.groupBy("left", "right").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("x") == 1) & (F.col("y") == 0)).alias("left_only"), F.count_if((F.col("x") == 0) & (F.col("y") == 1)).alias("right_only"), F.avg(F.col("x") - F.col("y")).alias("mean_diff"))
    return g.withColumn("p", mcnemar_exact(F.col("left_only"), F.col("right_only")))


def bootstrap_ci_numpy(df: DataFrame, keys: list[str], value: str, order: list[str], replicates: int = 5000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """As bootstrap_ci with numpy's generator, seeded anew for each group; one group of values at a time."""
    import numpy as np
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[value].dropna().to_numpy(float)
        lo = hi = None
        if len(v):
            m = v[np.random.default_rng(seed).integers(0, len(v), (replicates, len(v)))].mean(axis=1)
            lo, hi = np.quantile(m, [(1 - level) / 2, (1 + level) / 2])
        return pd.DataFrame([[*pdf[keys].iloc[0], lo, hi]], columns=[*keys, "lo", "hi"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*{*keys, *order, value}).groupBy(*keys).applyInPandas(one, f"{kinds}, lo double, hi double")


def beta_share(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value = 0.0
    for m in range(200, 0, -1):  # from the innermost term outwards
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = even / (1 + odd / (1 + value))
    first = -(a + b) * x / (a + 1)
    return front / (1 + first / (1 + value))


def rank_p_value(rho: float | None, n: int) -> float | None:
    """Two-sided p of a rank correlation of n pairs, by Student's t; NULL for fewer than three."""
    if rho is None or n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    t2 = rho * rho * (n - 2) / (1 - rho * rho)
    return beta_share((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def with_p_value(correlations: DataFrame, out: str = "p") -> DataFrame:
    """Rows of (rho, n), one a pair of columns, with the p value of each."""
    import pandas as pd

    p = F.pandas_udf(lambda rho, n: pd.Series([rank_p_value(None if r != r else r, int(k)) for r, k in zip(rho, n)], dtype=float), "double")
    return correlations.withColumn(out, p("rho", "n"))


def rate(condition: Column) -> Column:
    """Share of rows that meet a condition; rows where it is unknown count as not."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


__all__ = ["wilson", "mcnemar_exact", "holm", "pair_outcomes", "paired_tests", "bootstrap_ci_numpy", "rate", "ratio"]
