"""Exact centroid clustering on integers with Yinyang bounds.

Vectors are turned into integers, so every distance, sum and mean is exact and any
order of work gives the same result. The centroids are put into groups once. Each
vector keeps an upper bound of the distance to its centroid and one lower bound per
group for the distance to every other centroid of that group. After the centroids
have moved, the bounds move by as much; a vector whose upper bound lies under all
lower bounds stays (global filter), otherwise the groups whose bound lies above it
are left out (group filter), and the centroids of the others are scanned exactly.
Bounds are doubles with a margin far over their rounding, so ties are always scanned
and fall to the smaller number.

Each round reads the table of vectors with their bounds and writes the next one to
the shared folder: no vector crosses the network. Sums change by the vectors that
have moved only: they are added up in each task, then by centroid, and the driver
holds ``k`` sums of ``dim`` numbers. A lost executor costs its tasks of one round.

Defined cases: vectors that are null, have another number of components, or one that
is null or not finite are left out. Repeated rows are clustered one by one. Start
centroids are the ``k`` vectors whose id has the smallest hash (then by id and
components; null ids last); with fewer vectors there are fewer. A centroid without
vectors stays. Columns beside the id and the vector are ignored. An empty table gives
no rows. Distances must fit 64 bits: components whose integer is beyond 2^27 raise.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize

SCALE, DIM, CENTROIDS, ROUNDS, SEED = 256, 64, 40, 5, 2
#: Centroids in a group, on average.
PER_GROUP = 10
#: Largest integer component: 64 squared differences of twice this still fit 64 bits.
LARGEST = 1 << 27
#: Share and amount by which bounds are widened, over what rounding can do.
_WIDER, _MORE = 1 + 1e-9, 1e-6


def to_integers(vectors: DataFrame, key: str, vector: str, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and v (array of long) of the vectors that have ``dim`` finite components."""
    x = F.col("x")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    whole = lambda c: F.floor(F.lit(scale) * c)
    small = F.forall("v", lambda c: F.abs(c) <= LARGEST)
    d = vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    d = d.filter((F.size(x) == dim) & F.coalesce(F.forall(x, finite), F.lit(False)))
    d = d.select("vec_id", F.transform(x, whole).alias("v"))
    return d.select("vec_id", F.when(small, F.col("v")).otherwise(F.raise_error(F.lit("a component is too large"))).alias("v"))


def start_centroids(points: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of seed and id, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = points.select("v", "vec_id", h.alias("h")).orderBy(F.asc_nulls_last("h"), "vec_id", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def group_centroids(centers: np.ndarray, groups: int, turns: int = 5) -> np.ndarray:
    """A group number for each centroid: a few turns of clustering the centroids themselves."""
    x = centers.astype(np.float64)
    seeds = x[np.linspace(0, len(x) - 1, groups).astype(int)]
    for _ in range(turns):
        found = ((x[:, None, :] - seeds[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(groups):
            if (found == g).any():
                seeds[g] = x[found == g].mean(axis=0)
    return np.unique(found, return_inverse=True)[1]


def squared(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all centers, as 64-bit integers."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(centers).max(initial=0)))
    if 4 * points.shape[1] * most * most < 1 << 53:  # every intermediate number is exact in a double
        p, c = points.astype(np.float64), centers.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centers], axis=1)


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each centroid has moved."""
    return np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=1))


class Bounds:
    """The vectors of a batch with their centroid, upper bound and lower bounds by group."""

    def __init__(self, points: np.ndarray, cluster: np.ndarray | None = None, upper: np.ndarray | None = None, lower: np.ndarray | None = None):
        self.points, self.cluster, self.upper, self.lower = points, cluster, upper, lower
        #: Pairs of vector and centroid whose distance was computed.
        self.scanned = 0

    def first(self, centers: np.ndarray, group: np.ndarray) -> None:
        """Assign every vector by scanning all centroids."""
        n, groups = len(self.points), int(group.max()) + 1
        d = squared(self.points, centers)
        self.scanned += d.size
        self.cluster = d.argmin(axis=1)
        self.upper = np.sqrt(d[np.arange(n), self.cluster].astype(np.float64))
        self.lower = self._lower(d, groups, group)

    def _lower(self, d: np.ndarray, groups: int, group: np.ndarray) -> np.ndarray:
        others = np.sqrt(d.astype(np.float64))
        others[np.arange(len(d)), self.cluster] = np.inf
        return np.stack([others[:, group == g].min(axis=1) for g in range(groups)], axis=1)

    def move(self, old: np.ndarray, centers: np.ndarray, group: np.ndarray) -> None:
        """Assign anew after the centroids went from ``old`` to ``centers``."""
        by = drifts(old, centers)
        groups = int(group.max()) + 1
        self.upper = self.upper + by[self.cluster]
        self.lower = self.lower - np.array([by[group == g].max() for g in range(groups)])
        wide = lambda u: u * _WIDER + _MORE
        open_ = np.flatnonzero(wide(self.upper) >= self.lower.min(axis=1))
        if not len(open_):
            return
        self.upper[open_] = np.sqrt(self.to_own(centers, open_).astype(np.float64))
        open_ = open_[wide(self.upper[open_]) >= self.lower[open_].min(axis=1)]
        was, best = self.cluster.copy(), self.to_own(centers, open_)
        rows_of, near = {}, {}
        place = np.full(len(self.points), -1)
        place[open_] = np.arange(len(open_))
        for g in range(groups):  # the upper bound shrinks with each group, so later groups are left out more often
            rows = open_[wide(np.sqrt(best.astype(np.float64))) >= self.lower[open_, g]]
            if not len(rows):
                continue
            inside, at = np.flatnonzero(group == g), place[rows]
            d = squared(self.points[rows], centers[inside])
            self.scanned += d.size
            rows_of[g], near[g] = rows, d
            i = d.argmin(axis=1)
            least, number = d[np.arange(len(rows)), i], inside[i]
            better = (least < best[at]) | ((least == best[at]) & (number < self.cluster[rows]))
            best[at[better]], self.cluster[rows[better]] = least[better], number[better]
        before = self.upper.copy()
        self.upper[open_] = np.sqrt(best.astype(np.float64))
        moved = open_[self.cluster[open_] != was[open_]]
        # a centroid that was left is one of its group's others now
        np.minimum.at(self.lower, (moved, group[was[moved]]), before[moved])
        for g, rows in rows_of.items():
            inside = np.flatnonzero(group == g)
            d = np.sqrt(near[g].astype(np.float64))
            d[inside[None, :] == self.cluster[rows][:, None]] = np.inf
            self.lower[rows, g] = d.min(axis=1)

    def to_own(self, centers: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact squared distances of some vectors to their own centroid."""
        self.scanned += len(rows)
        return ((self.points[rows] - centers[self.cluster[rows]]) ** 2).sum(axis=1)


_ROUND = "vec_id {kind}, v array<long>, cluster int, was int, upper double, lower array<double>, distance long"


def _numbers(column, width: int, dtype) -> np.ndarray:
    """An Arrow column of arrays of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), width)


def _round(table: DataFrame, old: np.ndarray | None, centers: np.ndarray, group: np.ndarray, measure: bool) -> DataFrame:
    """The table with every vector assigned to the nearest of ``centers``; ``was`` is the centroid before, or -1.

    ``distance`` is filled where ``measure`` is set: bounds spare most vectors the computation of it.
    """
    import pyarrow as pa

    dim, groups = centers.shape[1], int(group.max()) + 1

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            points = _numbers(b.column(1), dim, np.int64)
            if old is None:
                x, was = Bounds(points), np.full(b.num_rows, -1)
                x.first(centers, group)
            else:
                was = b.column(2).to_numpy().astype(np.int64)
                x = Bounds(points, was.copy(), b.column(4).to_numpy().copy(), _numbers(b.column(5), groups, np.float64).copy())
                x.move(old, centers, group)
            d = x.to_own(centers, np.arange(b.num_rows)) if measure else np.zeros(b.num_rows, dtype=np.int64)
            lower = pa.ListArray.from_arrays(pa.array(np.arange(0, (b.num_rows + 1) * groups, groups), pa.int32()), pa.array(x.lower.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x.cluster, pa.int32()), pa.array(was, pa.int32()), pa.array(x.upper), lower, pa.array(d, pa.int64())], names=["vec_id", "v", "cluster", "was", "upper", "lower", "distance"])

    return map_arrow(table, run, _ROUND.format(kind=table.schema["vec_id"].dataType.simpleString()))


def moved_sums(table: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed their centroid add to the counts and sums of the centroids.

    Each task adds up its own; then there is a row per task and centroid at most.
    """
    import pyarrow as pa

    names = ["cluster", "n", *(f"s{i}" for i in range(dim))]

    def run(batches):
        n, s = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        for b in batches:
            points = _numbers(b.column(2), dim, np.int64)
            for column, sign in ((0, 1), (1, -1)):
                c = b.column(column).to_numpy()
                rows = np.flatnonzero(c >= 0)
                np.add.at(n, c[rows], sign)
                np.add.at(s, c[rows], sign * points[rows])
        at = np.flatnonzero(n.astype(bool) | s.any(axis=1))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), *(pa.array(np.ascontiguousarray(s[at, i])) for i in range(dim))], names=names)

    moved = table.filter("cluster <> was").select("cluster", "was", "v")
    parts = map_arrow(moved, run, "cluster int, " + ", ".join(f"{x} long" for x in names[1:]))
    n, s = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
    for r in parts.groupBy("cluster").agg(*(F.sum(x).alias(x) for x in names[1:])).collect():
        n[r["cluster"]], s[r["cluster"]] = r["n"], r[2:]
    return n, s


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(table with vec_id, v, cluster, distance; final centroids): ``rounds`` of assigning and averaging, then assigned once more."""
    points = materialize(to_integers(vectors, key, vector, dim, scale), "vectors")
    centers = start_centroids(points, k, seed)
    if not len(centers):
        return points.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centers
    group = group_centroids(centers, max(1, len(centers) // PER_GROUP))
    table, old = points, None
    n, s = np.zeros(len(centers), dtype=np.int64), np.zeros((len(centers), dim), dtype=np.int64)
    for turn in range(rounds + 1):
        after = materialize(_round(table, old, centers, group, turn == rounds), "assigned")
        discard(table)
        table = after
        if turn < rounds:
            more_n, more_s = moved_sums(table, len(centers), dim)
            n, s, old, centers = n + more_n, s + more_s, centers, centers.copy()
            centers[n > 0] = s[n > 0] // n[n > 0][:, None]
    return table.select("vec_id", "v", "cluster", "distance"), centers


def digest(center) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in center).encode()).hexdigest()


def _by_number(values: list, kind: str) -> Column:
    """The value at ``cluster`` of a list with an entry for each centroid."""
    return F.element_at(F.array(*(F.lit(x).cast(kind) for x in values)), F.col("cluster") + 1)


def summarize(table: DataFrame, centers: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, the inertia of the cluster and of all, and a digest of the centroid."""
    sums = {r["cluster"]: int(r["s"]) for r in table.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    k = max(1, len(centers))
    by = [sums.get(i, 0) for i in range(k)]
    marks = [digest(c) for c in centers] or [""]
    return table.select("vec_id", "cluster", "distance", _by_number(by, "long").alias("cluster_inertia"), F.lit(sum(by)).cast("long").alias("inertia"), _by_number(marks, "string").alias("centroid_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every vector's cluster, distance and its centroid's digest."""
    return summarize(*cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def _oracle() -> str:
    steps = [
        """WITH p AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = 64),
x AS MATERIALIZED (SELECT rid, unnest(range(1, 65)) AS d, unnest(v) AS x FROM p),
c0 AS MATERIALIZED (SELECT k, unnest(range(1, 65)) AS d, unnest(v) AS c FROM
  (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR) NULLS LAST, vec_id, v) - 1 AS k, v FROM p) WHERE k < 40)"""
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT rid, arg_min(k, (s, k)) AS k, min(s) AS s FROM
  (SELECT rid, k, sum((x - c) * (x - c))::BIGINT AS s FROM x JOIN c{r} USING (d) GROUP BY rid, k) GROUP BY rid)""")
        if r < ROUNDS:
            steps.append(f"""m{r} AS (SELECT k, d, sum(x)::BIGINT AS t, count(*) AS n FROM a{r} JOIN x USING (rid) GROUP BY k, d),
c{r + 1} AS MATERIALIZED (SELECT k, d, CASE WHEN n IS NULL THEN c ELSE t // n - (t < 0 AND t % n <> 0)::BIGINT END AS c FROM c{r} LEFT JOIN m{r} USING (k, d))""")
    last = f"a{ROUNDS}"
    return ",\n".join(steps) + f""",
h AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY d)) AS h FROM c{ROUNDS} GROUP BY k)
SELECT vec_id, k::INT AS cluster, s AS distance, (sum(s) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(s) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM {last} JOIN p USING (rid) JOIN h USING (k)"""


ORACLE_SQL = _oracle()
