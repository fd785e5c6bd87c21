"""Bootstrap intervals and ranks: with replacement, row by row or from histograms of outcomes.

Draws come from md5, so any engine draws the same.

With replacement (``drawn_means``) a resample draws as many rows as the group has, one
after the other, each from all of the group: draw k of replicate b takes the row at the
place md5 of seed, b and k modulo the rows of the group. ``bootstrap_ci`` with ``order``
works so.

Otherwise a resample draws every row a Poisson number of times of mean 1.

Row by row (``drawn_rows``) every row has a draw of its own in each replicate, from
md5 of seed, replicate and the row's name: rows times replicates draws, dealt over the
cores whatever the size of the files. Counts are added up where they are drawn, so
a task of few groups shuffles few sums. ``bootstrap_ci`` with ``row`` and
``paired_bootstrap`` work so.

From a histogram (``draws``) the rows of one outcome are drawn a Poisson number of
times of mean n together, so one count is drawn for each outcome and replicate: the
rows are grouped once, and from there the cost is replicates times outcomes, from md5
of seed, outcome and replicate. ``bootstrap_ci`` without ``order`` and ``row``, and
``rank_stability``, work so. Counts of mean 32 or less come from the exact distribution; larger ones from a normal
variate by the expansion of the Poisson quantile to the third order, which is within
one of the exact count (a bound of an interval moves by less than its share of one
row). Outcomes of a continuous measure can be rounded to multiples of ``resolution``,
which moves every mean by half of it at most.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.semantics import hash_order, ratio
from .order import places

#: Largest mean whose distribution is tabulated.
EXACT = 32
#: Draws of a hash: two numbers of 32 bits each.
PER_HASH = 2


def cumulated(mean: int) -> list[int]:
    """P(X <= k) of a Poisson variable in units of 2^-32, for k from 0 up to where it is 1."""
    out, term, total, k = [], math.exp(-mean), 0.0, 0
    while not out or out[-1] < 2**32:
        total += term
        out.append(min(2**32, round(total * 2**32)))
        k += 1
        term *= mean / k
        if term < 2**-40 and k > mean:
            break
    return out


#: For each mean up to EXACT the numbers from which on a draw is at least 1, 2, ...
TABLE = [cumulated(m) for m in range(EXACT + 1)]


def poisson_counts(mean: Column, high: Column, low: Column) -> Column:
    """A Poisson count of whole mean from two uniform numbers below 2^32."""
    table = F.from_json(F.lit(json.dumps(TABLE)), "array<array<bigint>>")
    exact = F.size(F.filter(F.get(table, mean.cast("int")), lambda t: t <= high)).cast("double")
    z = F.sqrt(-2 * F.log((high + 0.5) / 2.0**32)) * F.cos(2 * math.pi * ((low + 0.5) / 2.0**32))
    root = F.sqrt(mean.cast("double"))
    wide = F.floor(mean + root * z + (z * z - 1) / 6 + (z - z * z * z) / (72 * root) + 0.5).cast("double")
    return F.when(mean <= EXACT, exact).otherwise(F.greatest(F.lit(0.0), wide)).cast("long")


def draws(histogram: DataFrame, key: Column, n: str, replicates: int, seed: int = 42) -> DataFrame:
    """The histogram's rows for each replicate b, with the number of times ``_w`` that it draws the outcome."""
    d = histogram.withColumn("_hash", F.explode(F.transform(F.sequence(F.lit(0), F.lit((replicates - 1) // PER_HASH)), lambda i: F.struct(i.alias("i"), hash_order(seed, i, key).alias("md5")))))
    part = lambda at: F.conv(F.substring("_hash.md5", at, 8), 16, 10).cast("long")
    each = F.array(*(F.struct((F.col("_hash.i") * PER_HASH + j).alias("b"), part(16 * j + 1).alias("high"), part(16 * j + 9).alias("low")) for j in range(PER_HASH)))
    d = d.withColumn("_draw", F.explode(each)).filter(F.col("_draw.b") < replicates)
    return d.withColumns({"b": F.col("_draw.b"), "_w": poisson_counts(F.col(n), F.col("_draw.high"), F.col("_draw.low"))}).drop("_hash", "_draw")


#: P(X <= k) of a Poisson variable of mean 1, by which a hash of 32 bits becomes a count.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402]
POISSON_STEPS = [round(p * 2**32) for p in POISSON]
#: Tasks a core among which rows are dealt before they are drawn.
TASKS = 4


def row_count(md5: Column) -> Column:
    """How often a row is drawn: a Poisson count of mean 1 from a hash."""
    count = F.lit(len(POISSON_STEPS))
    for k, t in reversed(list(enumerate(POISSON_STEPS))):
        count = F.when(md5 < f"{t:08x}", k).otherwise(count)
    return count


def drawn_rows(rows: DataFrame, row: str, groups: list[str], sums: dict[str, Column], replicates: int, seed: int = 42) -> DataFrame:
    """groups, b and sums over what replicate b draws; each row, named by ``row``, is drawn by itself, ``_w`` times.

    Rows are dealt by ranges of group and name, so a task has few groups, and one group
    of many rows is dealt among many tasks. The hash is a column of its own, read several times: written in place, or below a
    filter on the count, it would be computed anew for each reading.
    """
    tasks = TASKS * rows.sparkSession.sparkContext.defaultParallelism
    d = rows.repartitionByRange(tasks, *groups, row).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    d = d.withColumn("_md5", hash_order(seed, F.col("b"), F.col(row))).withColumn("_w", row_count(F.col("_md5")))
    return d.groupBy(*groups, "b").agg(*[F.sum(x).alias(name) for name, x in sums.items()])


#: Values of a group in one row, and hashes held at once by a task that draws.
BLOCK = 2**18
HASHES = 2**18


def _draw(slices: int, replicates: int, seed: int, keys: list[str]):
    """For mapInArrow: keys, b, the rows of the group and the sum ``_s`` of what replicate b draws from each block of values.

    A hash is made once for all groups of a batch, as it names the replicate and the
    draw alone.
    """
    from hashlib import md5

    import numpy as np
    import pyarrow as pa

    def sums(members: list[tuple], first: int, stop: int):
        """A row for each replicate from first to stop, a column for each member: rows of its group, place of its first value, values."""
        out = np.zeros((stop - first, len(members)))
        heads = [f"{seed}:{b}:".encode() for b in range(first, stop)]
        step = max(1, HASHES // len(heads))
        most = max(n for n, _, _ in members)
        for start in range(0, most, step):
            draws = [b"%d" % k for k in range(start, min(start + step, most))]
            h = np.frombuffer(b"".join([md5(head + k).digest() for head in heads for k in draws]), ">u4")[::4]
            h = h.astype(np.int64).reshape(len(heads), len(draws))
            for j, (n, low, values) in enumerate(members):
                if n <= start:
                    continue
                at = h[:, : n - start] % n - low
                if len(values) == n:
                    out[:, j] += values[at].sum(axis=1)
                else:  # draws that fall into other blocks count there
                    here = (at >= 0) & (at < len(values))
                    out[:, j] += np.where(here, values[np.where(here, at, 0)], 0.0).sum(axis=1)
        return out

    def run(batches):
        for batch in batches:
            number = batch.column("_slice").to_numpy()
            n, block = (batch.column(c).to_numpy() for c in ("_n", "_block"))
            for s in np.unique(number):
                rows = np.flatnonzero(number == s)
                first, stop = (int(x) * replicates // slices for x in (s, s + 1))
                members = [(int(n[i]), int(block[i]) * BLOCK, batch.column("_values")[int(i)].values.to_numpy(zero_copy_only=False)) for i in rows]
                total = sums(members, first, stop)
                times = stop - first
                whose = batch.select(keys).take(pa.array(np.repeat(rows, times)))
                b = pa.array(np.tile(np.arange(first, stop, dtype=np.int32), len(rows)))
                yield pa.RecordBatch.from_arrays([*whose.columns, b, pa.array(np.repeat(n[rows], times)), pa.array(total.T.ravel())], names=[*keys, "b", "_n", "_s"])

    return run


def drawn_means(rows: DataFrame, keys: list[str], value: str, order: list[str], replicates: int, seed: int = 42) -> DataFrame:
    """keys, b and the mean of what replicate b draws: as many rows as the group has, with replacement, from the rows numbered in ``order``.

    Rows of equal order are numbered by value, so the result does not depend on which
    comes first. A group's values lie in blocks of bounded size, and each task takes some
    of the replicates of all blocks, so one large group is dealt as evenly as many small.
    """
    d = places(rows, keys, [*order, value], "_i", rows="_n")
    d = d.groupBy(*keys, "_n", F.floor(F.col("_i") / BLOCK).alias("_block")).agg(F.sort_array(F.collect_list(F.struct("_i", F.col(value).alias("v")))).alias("_at"))
    slices = min(replicates, TASKS * rows.sparkSession.sparkContext.defaultParallelism)
    d = d.select(*keys, "_n", "_block", F.col("_at.v").alias("_values"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice")).repartitionByRange(slices, "_slice")
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    m = d.mapInArrow(_draw(slices, replicates, seed, keys), f"{kinds}, b int, _n bigint, _s double")
    return m.groupBy(*keys, "b").agg((F.sum("_s") / F.max("_n")).alias("mean"))


def bootstrap_means(df: DataFrame, keys: list[str], value: str, replicates: int, seed: int = 42, resolution: float | None = None, row: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Mean of each resample of a group: keys, b, mean (NULL where nothing was drawn)."""
    v = F.col(value).cast("double")
    if resolution:
        v = F.round(v / resolution) * resolution
    if order is not None:
        d = df.filter(F.col(value).isNotNull()).select(*dict.fromkeys([*keys, *order]), v.alias("_v"))
        return drawn_means(d, keys, "_v", order, replicates, seed)
    if row is not None:
        d = df.filter(F.col(value).isNotNull()).select(*keys, F.col(row).alias("_row"), v.alias("_v"))
        d = drawn_rows(d, "_row", keys, {"_s": F.col("_v") * F.col("_w"), "_c": F.col("_w")}, replicates, seed)
        return d.select(*keys, "b", ratio(F.col("_s"), F.col("_c")).alias("mean"))
    h = df.filter(F.col(value).isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    d = draws(h, F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.col("_v").cast("string")), "_n", replicates, seed)
    return d.groupBy(*keys, "b").agg(F.sum(F.col("_v") * F.col("_w")).alias("_s"), F.sum("_w").alias("_c")).select(*keys, "b", ratio(F.col("_s"), F.col("_c")).alias("mean"))


def bootstrap_ci(df: DataFrame, keys: list[str], value: str, replicates: int = 5000, seed: int = 42, level: float = 0.95, resolution: float | None = None, row: str | None = None, order: list[str] | None = None) -> DataFrame:
    """keys, lo, hi: percentile interval of the resampled means.

    With ``order`` a resample draws as many rows as the group has, with replacement;
    otherwise counts are Poisson, and ``row`` names a row, and each is then drawn by itself.
    """
    q = (1 - level) / 2
    m = bootstrap_means(df, keys, value, replicates, seed, resolution, row, order)
    return m.groupBy(*keys).agg(F.percentile("mean", F.lit(q)).alias("lo"), F.percentile("mean", F.lit(1 - q)).alias("hi"))


def _by_problem(df: DataFrame, agent: str, problem: str, value: str) -> DataFrame:
    """problem and ``_all``, the values of all agents that have one, in the order of agents."""
    d = df.filter(F.col(value).isNotNull() & F.col(agent).isNotNull() & F.col(problem).isNotNull())
    d = d.select(problem, F.struct(F.col(agent).alias("agent"), F.col(value).cast("double").alias("v")).alias("_x"))
    return d.groupBy(problem).agg(F.sort_array(F.collect_list("_x")).alias("_all"))


def _differences(outcomes: DataFrame, *columns: str) -> DataFrame:
    """columns, left, right and the difference ``_d`` of each pair of agents in ``_all``."""
    d = outcomes.select(*columns, "_all", F.explode("_all").alias("_l")).select(*columns, "_l", F.explode("_all").alias("_r")).filter(F.col("_l.agent") < F.col("_r.agent"))
    return d.select(*columns, F.col("_l.agent").alias("left"), F.col("_r.agent").alias("right"), (F.col("_l.v") - F.col("_r.v")).alias("_d"))


def paired_bootstrap(df: DataFrame, agent: str, problem: str, value: str, replicates: int = 5000, seed: int = 42) -> DataFrame:
    """left, right, mean difference and its percentile interval when the problems that both have are resampled.

    Each problem is drawn by itself, once a replicate for all pairs of agents. How
    often problems with the same values were drawn is added up before the pairs are
    taken, so pairs cost by the different outcomes.
    """
    rows = _by_problem(df, agent, problem, value)
    kind = rows.schema["_all"].dataType.simpleString()
    rows = rows.select(problem, F.to_json("_all").alias("_text"))  # a text is a cheaper key than an array
    read = lambda d: d.withColumn("_all", F.from_json("_text", kind))
    m = _differences(read(drawn_rows(rows, problem, ["_text"], {"_w": F.col("_w")}, replicates, seed)), "b", "_w")
    m = m.groupBy("left", "right", "b").agg(ratio(F.sum(F.col("_d") * F.col("_w")), F.sum("_w")).alias("m"))
    bounds = m.groupBy("left", "right").agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    means = _differences(read(rows.groupBy("_text").agg(F.count(F.lit(1)).alias("_n"))), "_n")
    return means.groupBy("left", "right").agg((F.sum(F.col("_d") * F.col("_n")) / F.sum("_n")).alias("mean_diff")).join(bounds, ["left", "right"], "left")


def rank_stability(df: DataFrame, agent: str, problem: str, value: str, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """agent, mean and median rank and share of first ranks when problems are resampled jointly.

    An outcome is a problem's values of all agents: problems alike are drawn together.
    """
    d = df.filter(F.col(value).isNotNull()).select(problem, F.struct(F.col(agent).cast("string").alias("agent"), F.col(value).cast("double").alias("v")).alias("_x"))
    h = d.groupBy(problem).agg(F.sort_array(F.collect_list("_x")).alias("_all")).groupBy("_all").agg(F.count(F.lit(1)).alias("_n"))
    name = F.array_join(F.transform("_all", lambda x: F.concat_ws("=", x["agent"], x["v"].cast("string"))), ",")
    m = draws(h, name, "_n", replicates, seed).filter("_w > 0").select("b", "_w", F.explode("_all").alias("x"))
    m = m.groupBy("b", F.col("x.agent").alias(agent)).agg((F.sum(F.col("x.v") * F.col("_w")) / F.sum("_w")).alias("m"))
    ranked = m.withColumn("rank", F.row_number().over(Window.partitionBy("b").orderBy(F.desc(F.round("m", 9)), agent)))
    return ranked.groupBy(agent).agg(F.avg("rank").alias("mean_rank"), F.percentile("rank", F.lit(0.5)).alias("median_rank"), F.avg((F.col("rank") == 1).cast("double")).alias("p_first"))
