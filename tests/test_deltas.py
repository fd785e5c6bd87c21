"""Changes carried as deltas give what recomputing everything gives, from touched buckets alone."""

import random

import pytest
from pyspark.sql import functions as F

from stepwright.operators import deltas
from stepwright.operators import steps as st

LABELS = list(st.CLASS_VALUE)


def run_of(spark, rng, n=60):
    rows = [(k, i, i + 1, rng.choice(["code", "none", "answer"]), rng.randint(0, 50), rng.randint(0, 60), rng.uniform(-0.3, 0.3), rng.choice([None, 0.5, -0.5]), float(rng.random() < 0.3), float(rng.random() < 0.1), float(rng.random() < 0.1), rng.random() < 0.3, rng.choice([None, 3])) for k in range(n) for i in range(rng.randint(1, 6))]
    s = spark.createDataFrame(rows, "k int, i int, position int, action_type string, output_tokens int, hidden_tokens int, prm_delta double, critic_signal double, tool_gain double, harmful_repeat double, error_flag double, useful_verification boolean, solution int")
    m = spark.createDataFrame([(k, "abc"[k % 3], k % 4 > 0, rng.choice([0, 1, None]), k % 2, "G2", "symbolic", rng.random()) for k in range(n)], "k int, agent string, valid boolean, C_final int, G int, G_level string, correctness_source string, R double")
    return st.label_steps(s).withColumn("critic_used", F.lit(False)), m


def measured(steps, m):
    q, t = st.quality(steps, "k").select("k", F.col("q_step").alias("Q")), st.token_utility(steps, "k").select("k", F.col("ptu").alias("PTU"))
    m = m.join(q, "k").join(t, "k").withColumn("V", F.col("C_final") * F.col("G"))
    return m.withColumn("E", F.when(F.col("valid"), st.overall(F.col("V"), F.col("PTU"), F.col("Q"), F.col("R"))).otherwise(F.lit(0.0)))


@pytest.mark.parametrize("seed", [1, 2])
def test_deltas_equal_recomputation(spark, tmp_path, seed):
    rng = random.Random(seed)
    s, m = run_of(spark, rng)
    judged = spark.createDataFrame([(k, rng.choice(["success", "error"]), rng.random() < 0.5, 0.5) for k in range(0, 60, 7)], "k int, status string, correct boolean, confidence double")
    critic = spark.createDataFrame([(k, 0, rng.choice(["success", "success", "error"]), rng.choice(LABELS)) for k in range(0, 60, 5)], "k int, i int, status string, label string")
    deltas.store_by_key(s, ["k"], str(tmp_path / "steps"), 16)
    before = measured(s, m)
    touched = deltas.touched_keys(judged, critic, ["k"])
    few = deltas.read_touched(spark, str(tmp_path / "steps"), touched, ["k"], 16)
    changed = deltas.changes(before.join(touched, "k", "left_semi"), few, judged, critic, ["k"], "i", "agent")
    got = deltas.means(deltas.add_changes(deltas.summary_sums(before, "agent"), changed, "agent"), "agent").collect()
    after = st.apply_judge(m.withColumn("V", F.col("C_final") * F.col("G")), judged, ["k"]).drop("V", "changed", "low_confidence")
    want = {r["agent"]: r for r in deltas.means(deltas.summary_sums(measured(st.apply_critic(s, critic, ["k", "i"]), after), "agent"), "agent").collect()}
    for r in got:
        for c in ("n", *deltas.MEASURES):
            assert r[c] == pytest.approx(want[r["agent"]][c], abs=1e-9)
    assert changed.count() == touched.count() < 25


def test_only_touched_buckets_are_read(spark, tmp_path):
    s, _ = run_of(spark, random.Random(3))
    deltas.store_by_key(s, ["k"], str(tmp_path / "steps"), 16)
    touched = spark.createDataFrame([(3,)], "k int")
    d = deltas.read_touched(spark, str(tmp_path / "steps"), touched, ["k"], 16)
    files = {r[0] for r in d.select(F.input_file_name()).distinct().collect()}
    assert len(files) == 1 and d.select("k").distinct().count() == 1
    assert "PartitionFilters: [isnotnull(_bucket" in d._jdf.queryExecution().toString() or "PartitionFilters: [(_bucket" in d._jdf.queryExecution().toString()
    nothing = deltas.read_touched(spark, str(tmp_path / "steps"), touched.limit(0), ["k"], 16)
    assert nothing.collect() == []
