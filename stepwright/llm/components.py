"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, few_tasks, map_arrow, materialize


def contract_locally(edges: DataFrame) -> DataFrame:
    """Replace the edges of each partition by a star per component within it.

    Fewer edges and shorter chains with the same components; no shuffle.
    """
    import pyarrow as pa

    def contract(batches):
        parent: dict[int, int] = {}

        def find(x):
            root = x
            while parent.get(root, root) != root:
                root = parent[root]
            while parent.get(x, x) != root:
                parent[x], x = root, parent[x]
            return root

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a, c = find(u), find(v)
                if a != c:
                    parent[max(a, c)] = min(a, c)
        nodes = [x for x in list(parent) if find(x) != x]
        for i in range(0, len(nodes), 50_000):
            part = nodes[i : i + 50_000]
            yield pa.RecordBatch.from_pydict({"u": pa.array([find(x) for x in part], pa.int64()), "v": pa.array(part, pa.int64())})

    return map_arrow(edges.select("u", "v"), contract, "u long, v long")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node goes to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    up = both.filter("v > u").join(least, "u")
    return up.select(F.least("u", "m").alias("u"), "v").filter("u < v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of these."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    j = edges.join(least, "v")
    down = j.select(F.col("m").alias("u"), F.col("u").alias("v")).filter("u < v")
    return down.unionByName(least.select(F.col("m").alias("u"), "v")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for nodes that are not the smallest of their component.

    ``edges`` has long columns u < v. Each round is written to the shared
    folder, so a lost executor costs a reread. Stars with a third of all edges
    meet in equi-joins whose hot keys the adaptive planner can split.
    """
    spark, mark = edges.sparkSession, None
    now = materialize(contract_locally(edges), "edges", 4 * few_tasks(spark, 0))
    for _ in range(max_rounds):
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == mark or after[0] == 0:
            return now.select(F.col("v").alias("node"), F.col("u").alias("component"))
        mark, before = after, now
        now = materialize(_small_star(_large_star(before)), "edges", few_tasks(spark, after[0]))
        discard(before)
    raise RuntimeError("components did not settle")
