"""Places, ranks, quantiles and frontiers against plain loops."""

import random

import numpy as np
import pytest

from stepwright.operators import order


@pytest.fixture(scope="module")
def hot(spark):
    """Most rows in one group, many ties, missing keys and values, and few values in one group."""
    rng = random.Random(3)
    rows = [("hot" if i % 10 else rng.choice(["a", "b", None]), i, rng.choice([None, 0.0, -1.5, 2.25] + [rng.random() * 100 for _ in range(4)]), float(rng.randint(0, 9))) for i in range(3000)]
    rows += [("one", 9001, 7.0, 1.0), ("none", 9002, None, 1.0), ("two", 9003, 1.0, 5.0), ("two", 9004, 2.0, 5.0)]
    return rows, spark.createDataFrame(rows, "k string, i int, v double, w double").repartition(7)


def groups(rows, keep=lambda r: True):
    out = {}
    for r in rows:
        if keep(r):
            out.setdefault(r[0], []).append(r)
    return out


def test_places_and_shares(hot):
    rows, df = hot
    got = {r["i"]: (r["at"], r["share"]) for r in order.places(df, ["k"], ["v", "i"], "at", "share").collect()}
    for g in groups(rows).values():
        for at, r in enumerate(sorted(g, key=lambda r: (r[2] is not None, r[2] or 0.0, r[1]))):
            assert got[r[1]] == (at, (at + 1) / len(g))
    assert len(got) == len(rows)


def test_places_over_everything_and_over_nothing(spark, hot):
    rows, df = hot
    assert sorted(r["at"] for r in order.places(df, [], ["i"], "at").collect()) == list(range(len(rows)))
    assert order.places(df.limit(0), [], ["i"], "at").collect() == []


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_quantiles_are_exact(spark, hot, ranges):
    rows, df = hot
    before = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the few rows of a test share one range
    try:
        at = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
        got = {r["k"]: list(r)[1:] for r in order.quantiles(df, ["k"], "v", at, [f"q{i}" for i in range(6)]).collect()}
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    want = groups(rows, lambda r: r[2] is not None)
    assert set(got) == set(want)
    for k, g in want.items():
        assert got[k] == pytest.approx(np.quantile([r[2] for r in g], at).tolist(), abs=1e-9)


def test_quantiles_of_nothing(hot):
    assert order.quantiles(hot[1].limit(0), ["k"], "v", [0.5], ["q"]).collect() == []


def test_average_ranks(hot):
    rows, df = hot
    got = {(r["k"], r["w"]): (r["rank"], r["_all"]) for r in order.average_ranks(order.histogram(df, ["k"], "w"), ["k"], "w", "rank").collect()}
    for k, g in groups(rows).items():
        w = sorted(r[3] for r in g)
        for x in set(w):
            assert got[k, x] == (w.index(x) + (w.count(x) + 1) / 2, len(w))


def test_spearman_of_a_hot_group(hot):
    rows, df = hot
    got = {r["k"]: r for r in order.spearman(df, ["k"], "v", "w").collect()}
    mean_rank = lambda v: [sorted(v).index(x) + (v.count(x) + 1) / 2 for x in v]
    for k, g in groups(rows, lambda r: r[2] is not None).items():
        v, w = [r[2] for r in g], [r[3] for r in g]
        assert got[k]["n"] == len(g) and got[k]["mean_abs_diff"] == pytest.approx(np.mean(np.abs(np.array(v) - np.array(w))))
        a, b = mean_rank(v), mean_rank(w)
        if len(g) > 1 and len(set(a)) > 1 and len(set(b)) > 1:
            assert got[k]["rho"] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-9)
        else:
            assert got[k]["rho"] is None


@pytest.mark.parametrize("kind", ["double", "int", "long", "decimal(9,2)"])
def test_frontier_against_all_pairs(spark, kind):
    rng = random.Random(kind)
    rows = [(i, rng.randint(0, 40), rng.randint(0, 40)) for i in range(400)] + [(500, None, 99), (501, 0, None), (502, 0, 41), (503, 0, 41)]
    df = spark.createDataFrame(rows, "i int, c int, v int").selectExpr("i", f"CAST(c AS {kind}) AS c", f"CAST(v AS {kind}) AS v").repartition(6)
    known = [r for r in rows if r[1] is not None and r[2] is not None]
    want = {a[0] for a in known if not any(b[1] <= a[1] and b[2] >= a[2] and (b[1] < a[1] or b[2] > a[2]) for b in known)}
    assert {r["i"] for r in order.frontier(df, "c", "v").collect()} == want
    assert order.frontier(df.limit(0), "c", "v").collect() == []


def test_frontier_where_every_row_is_on_it(spark):
    df = spark.range(5000).selectExpr("id", "CAST(id AS double) AS c", "CAST(id AS double) AS v")
    assert order.frontier(df, "c", "v").count() == 5000
