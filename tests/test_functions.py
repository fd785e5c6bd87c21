"""Scalar and sequence operators against stated values and small models in Python."""

import itertools
import math
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepwright.functions import semantics as sem
from stepwright.functions import text as tx
from stepwright.operators import merge, order, replay, resampling, sampling, sequences, stats, steps, summary


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_missing_values(spark):
    rows = spark.createDataFrame([("1.5",), ("nan",), ("inf",), ("",), ("x",), (None,)], "v string").select(sem.num(F.col("v")).alias("v")).collect()
    assert [r["v"] for r in rows] == [1.5, None, None, None, None, None]


def test_last_of_short_lists(spark):
    a = lambda *x: F.array(*[F.lit(i) for i in x]) if x else F.array().cast("array<int>")
    r = one(spark, sem.last_of(a(1, 2, 3), 4).alias("a"), sem.last_of(a(1, 2, 3, 4, 5), 2).alias("b"), sem.last_of(a(), 4).alias("c"))
    assert (r["a"], r["b"], r["c"]) == ([1, 2, 3], [4, 5], [])


def test_canonical_digest_ignores_key_order(spark):
    d = lambda s: sem.canonical_digest(F.lit(s))
    r = one(spark, d('{"a":1,"b":[1.50,null]}').alias("x"), d('{ "b": [1.5, null], "a": 1 }').alias("y"), d('{"a":2}').alias("z"))
    assert r["x"] == r["y"] != r["z"]


@pytest.mark.parametrize(("text", "found"), [("so \\boxed{7}\nAnswer: 7.", ["7", "so \\boxed{7}", "Answer: 7"]), ("x2 3.5 -1/2", ["x2 3.5 -1/2", "3.5", "-1/2"]), ("", [])])
def test_output_candidates(spark, text, found):
    assert one(spark, tx.output_candidates(F.lit(text)).alias("c"))["c"] == found


def test_math_normalize_and_truncate(spark):
    r = one(spark, tx.math_normalize(F.lit("x + 12 = yz")).alias("m"), tx.truncate_middle(F.lit("a" * 300), 100).alias("t"), tx.truncate_middle(F.lit("short"), 100).alias("s"))
    assert r["m"] == "VAR+NUM=yz" and r["t"] == "a" * 10 + tx.CUT_MARK + "a" * 10 and r["s"] == "short"


def test_recovered_verdicts(spark):
    r = one(spark, tx.recovered_verdict(F.lit("correct: true ... finally Correct = False")).alias("v"), tx.recovered_label(F.lit('{"label": "redundant"}')).alias("l"), tx.recovered_verdict(F.lit("none")).alias("n"))
    assert (r["v"], r["l"], r["n"]) == (False, "redundant", None)


def test_created_at(spark):
    r = one(spark, tx.created_at(F.lit("2024-05-01T10:00:00Z"), F.lit("x")).alias("a"), tx.created_at(F.lit(None), F.lit("run_20240501T101112Z.zip")).alias("b"), tx.created_at(F.lit("bad"), F.lit("x")).alias("c"))
    assert r["a"].hour == 10 and (r["b"].minute, r["b"].second) == (11, 12) and r["c"] is None


def test_retryable(spark):
    kind = "stop string, steps array<struct<retry_errors:array<struct<attempt:int,status:int,type:string,message:string>>>>"
    rows = [("api_error", []), ("api_error", [([(1, 429, "X", "")],)]), ("api_error", [([(1, 401, "Auth", "")],)]), ("worker_exception", None), ("max_steps", [])]
    got = spark.createDataFrame(rows, kind).select(tx.is_retryable(F.col("stop"), F.col("steps")).alias("r")).collect()
    assert [r["r"] for r in got] == [True, True, False, True, False]


@pytest.mark.parametrize(("b", "c", "p"), [(3, 9, 0.145996), (0, 1, 1.0), (140, 160, 0.272630), (5, 5, 1.0), (0, 0, 1.0)])
def test_mcnemar(spark, b, c, p):
    assert one(spark, stats.mcnemar_exact(F.lit(b), F.lit(c)).alias("p"))["p"] == pytest.approx(p, abs=1e-6)


@pytest.mark.parametrize(("b", "c"), [(530, 545), (2250, 2300), (1100, 1100), (23000, 23400), (0, 3000)])
def test_mcnemar_of_more_pairs_than_halves_in_a_double(spark, b, c):
    n, k = b + c, min(b, c)
    want = min(1.0, 2 * float(Fraction(sum(itertools.accumulate(range(1, k + 1), lambda t, i: t * (n - i + 1) // i, initial=1)), 2**n)))
    assert one(spark, stats.mcnemar_exact(F.lit(b), F.lit(c)).alias("p"))["p"] == pytest.approx(want, rel=1e-10)


def test_holm_adjusts_p_in_the_order_of_another_column(spark):
    df = spark.createDataFrame([("f", 0, 0.0100001), ("f", 1, 0.01)], "f string, i int, p double").withColumn("p6", F.round("p", 6))
    got = {r["i"]: r["p_holm"] for r in stats.holm(df, "p", ["f"], ["i"], by="p6").collect()}
    assert got == {0: 2 * 0.0100001, 1: 2 * 0.0100001}


@given(st.lists(st.floats(0, 1), min_size=1, max_size=8))
@settings(max_examples=8, deadline=None)
def test_holm_against_a_loop(spark, ps):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate(ps)], "f string, i int, p double")
    got = {r["i"]: r["p_holm"] for r in stats.holm(df, "p", ["f"], ["i"]).collect()}
    top = 0.0
    for rank, i in enumerate(sorted(range(len(ps)), key=lambda i: (ps[i], i))):
        top = max(top, min(1.0, (len(ps) - rank) * ps[i]))
        assert got[i] == pytest.approx(top)


def test_wilson_edges(spark):
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(0, 10), (10, 10), (0, 0)], "k int, n int").select(lo.alias("lo"), hi.alias("hi")).collect()
    assert rows[0]["lo"] == 0 and rows[1]["hi"] == pytest.approx(1) and rows[2]["lo"] is None


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([("m", float(x), float(y)) for x, y in zip((1, 2, 2, 3, 5, 5, 7), (2, 1, 4, 4, 6, 3, 9))], "m string, x double, y double")
    assert order.spearman(df, ["m"], "x", "y").first()["rho"] == pytest.approx(0.743151, abs=1e-6)


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=12))
@settings(max_examples=8, deadline=None)
def test_frontier_against_all_pairs(spark, points):
    df = spark.createDataFrame([(i, float(c), float(v)) for i, (c, v) in enumerate(points)], "i int, c double, v double")
    want = {i for i, (c, v) in enumerate(points) if not any(a <= c and b >= v and (a < c or b > v) for a, b in points)}
    assert {r["i"] for r in order.frontier(df, "c", "v").collect()} == want


def test_numpy_bootstrap_is_seeded(spark):
    df = spark.createDataFrame([("a", i, float(i % 2)) for i in range(40)] + [("b", i, None) for i in range(3)], "g string, i int, v double")
    a = {r["g"]: (r["lo"], r["hi"]) for r in stats.bootstrap_ci_numpy(df, ["g"], "v", ["i"], 500).collect()}
    assert 0.3 < a["a"][0] < 0.5 < a["a"][1] < 0.7 and a["b"][0] is None or math.isnan(a["b"][0])


def test_paced_schedule(spark):
    df = spark.createDataFrame([("l", i, t) for i, t in enumerate((0.0, 0.5, 0.7, 40.0, 40.1))], "l string, i int, t double")
    assert [r["start"] for r in sequences.paced_schedule(df, ["l"], "t", ["t", "i"], 5.0).orderBy("i").collect()] == [0, 5, 10, 40, 45]


def test_failure_streaks(spark):
    df = spark.createDataFrame([("l", i, f) for i, f in enumerate((True, True, False, True, True, True))], "l string, i int, f boolean")
    got = [(r["streak"], r["cooldown"]) for r in sequences.failure_streaks(df, ["l"], ["i"], F.col("f")).orderBy("i").collect()]
    assert got == [(1, 30), (2, 30), (0, 0), (1, 30), (2, 30), (3, 120)]


def test_version_events(spark):
    df = spark.createDataFrame([("k", "A", "x"), ("k", "B", "x"), ("k", "C", "y"), ("k", "D", "y"), ("k", "E", "x")], "k string, archive string, digest string")
    events = merge.change_events(df, ["k"], ["archive"], "digest", ["archive"]).orderBy("archive").collect()
    assert [(r["event"], r["prev_archive"], r["archive"]) for r in events] == [("added", None, "A"), ("replaced", "A", "C"), ("replaced", "C", "E")]
    assert merge.latest_version(df, ["k"], ["archive"], "digest", ["archive"]).first()["archive"] == "E"


def test_unique_by_stops_on_duplicates_and_blanks(spark):
    good = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert merge.unique_by(good, "k").count() == 2
    for bad in ([("a", 1), ("a", 2)], [(" ", 1)], [(None, 1)]):
        with pytest.raises(Exception, match="key"):
            merge.unique_by(spark.createDataFrame(bad, "k string, v int"), "k").collect()


def test_repaired_wins_and_grid(spark):
    o, r = spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string"), spark.createDataFrame([(2, "r"), (3, "r")], "k int, v string")
    assert sorted((x["k"], x["v"], x["origin"]) for x in merge.repaired_wins(o, r, "k").collect()) == [(1, "o", "original"), (2, "r", "repaired"), (3, "r", "repaired")]
    gaps = merge.grid_gaps(spark.createDataFrame([(1, "a"), (2, "c")], "p int, g string"), spark.createDataFrame([(1,), (2,)], "p int"), spark.createDataFrame([("a",)], "g string"))
    assert sorted((x["p"], x["g"], x["gap"]) for x in gaps.collect()) == [(2, "a", "missing"), (2, "c", "unexpected")]


def test_balanced_sample_takes_turns(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", i) for i in range(50, 53)], "g string, k int")
    got = [r["g"] for r in sampling.balanced_sample(df, "g", "k", 8).collect()]
    assert sorted(got) == ["a"] * 5 + ["b"] * 3
    with pytest.raises(ValueError, match="rows"):
        sampling.require_rows(df, 8)


def test_step_labels_and_quality(spark):
    kind = "k string, prm_delta double, critic_signal double, tool_gain double, harmful_repeat double, error_flag double, useful_verification boolean"
    rows = [("a", 0.5, None, 0.0, 0.0, 0.0, False), ("a", 0.5, 0.0, 1.0, 0.0, 1.0, False), ("a", 0.05, 0.0, 0.0, 1.0, 0.0, False), ("a", 0.0, 0.0, 0.0, 0.0, 0.0, True), ("a", 0.0, 0.0, 0.0, 0.0, 0.0, None)]
    s = steps.label_steps(spark.createDataFrame(rows, kind))
    assert sorted(r["label"] for r in s.collect()) == ["neutral_useful", "neutral_waste", "progressive", "redundant", "regressive"]
    assert steps.quality(s, "k").first()["q_step"] == pytest.approx((0 / 5 + 1) / 2)


def test_redundancy_signals(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]], ["a", "", "a"])], "v array<array<double>>, t array<string>")
    got = [(r["max_similarity"], r["exact"], r["semantic"]) for r in steps.redundancy_signals(df, "v", "t").first()["signals"]]
    assert got == [(0.0, False, False), (0.0, False, False), (1.0, True, True)]


def test_ensemble_pads(spark):
    df = spark.createDataFrame([([[0.2, 0.4], [0.6]],), ([[]],), ([],)], "s array<array<double>>")
    got = [r["e"] for r in df.select(steps.ensemble(F.col("s"), F.lit(3)).alias("e")).collect()]
    assert got[0] == pytest.approx([0.4, 0.5, 0.5]) and got[1] == [0.5] * 3 and got[2] == [0.5] * 3


def test_grounding_levels(spark):
    level, g, v = steps.grounding(F.col("c"), F.col("n"), F.col("s"))
    rows = spark.createDataFrame([(1, 0, None), (1, 2, None), (0, 2, 1), (1, 2, 1)], "c int, n int, s int").select(level.alias("l"), g.alias("g"), v.alias("v")).collect()
    assert [(r["l"], r["g"], r["v"]) for r in rows] == [("G0", 0, 0), ("G1", 0, 0), ("G2", 1, 0), ("G3", 1, 1)]


def test_repairs(spark):
    m = spark.createDataFrame([("a", 0, 1, 0, "G2", "x"), ("b", 1, 0, 0, "G0", "x")], "k string, C_final int, G int, V int, G_level string, correctness_source string")
    d = spark.createDataFrame([("a", "success", True, 0.6), ("b", "failed", False, 0.9)], "k string, status string, correct boolean, confidence double")
    got = {r["k"]: (r["C_final"], r["V"], r["G_level"], r["changed"], r["low_confidence"]) for r in steps.apply_judge(m, d, ["k"]).collect()}
    assert got == {"a": (1, 1, "G3", True, True), "b": (1, 0, "G0", False, None)}


TURN = {"success": True, "error": None, "signature": "s", "content": ""}


@pytest.mark.parametrize(
    ("turns", "stop"),
    [
        (["answer"], "explicit_final_answer"),
        (["none", "none"], "format_error_limit"),
        (["code:a", "code:a", "code:b"], "answer_only_violation_limit"),
        (["code:a", "none", "none"], "format_error_limit"),
        (["code:a", "code:b", "code:c", "code:d", "code:e"], "answer_only_violation_limit"),
        (["code:a!", "code:b!", "code:c"], "answer_only_violation_limit"),
        (["code:a", "error"], "api_error"),
        (["none", "answer"], "explicit_final_answer"),
    ],
)
def test_controller_replay(turns, stop):
    rows = []
    for t in turns:
        kind, _, sig = t.partition(":")
        rows.append(TURN | {"action_type": kind, "signature": sig.rstrip("!"), "success": not sig.endswith("!"), "error": "x" if kind == "error" else None})
    assert replay.run_turns(rows)["stop_reason"] == stop


def test_summaries_leave_out_missing_agents(spark):
    kind = "agent string, problem_id int, C int, G int, V int, stop_reason string"
    a = spark.createDataFrame([("a", 1, 1, 1, 1, "explicit_final_answer"), ("a", 2, None, None, None, "api_error"), (None, 3, 1, 1, 1, None)], kind)
    assert summary.correctness_bounds(a).collect()[0].asDict() == {"agent": "a", "n": 2, "unresolved": 1, "lower": 0.5, "upper": 1.0}
    assert {(r["view"], r["n"]) for r in summary.view_sensitivity(a).collect()} == {("all_attempted", 2), ("completed_only", 1), ("infrastructure_clean", 1)}
    assert sum(r["n"] for r in summary.cg_matrix(a).collect()) == 2
    assert summary.health(a).first()["stop_reasons"] == '{"api_error":1,"explicit_final_answer":1}'


def test_rendering(spark):
    col = lambda x: F.lit(x).cast("string")
    r = one(spark, tx.observation_text(F.lit(True), F.lit(0.5), col(" "), col(None), F.lit(False)).alias("o"), tx.format_step(col(" why "), col("x=1"), col("out"), col(None), F.lit("code")).alias("s"), tx.prefix_render(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(2)).alias("p"))
    assert r["o"] == "Execution status: SUCCESS\nElapsed: 0.500s\nNo printed output. Use print(...) to expose a result."
    assert r["s"] == "why\nCode:\nx=1\nObservation:\nout" and r["p"] == "Step 1:\na\n\nStep 2:\nb"


@pytest.mark.parametrize(("source", "ok"), [("import math\nprint(math.pi)", True), ("import os", False), ("from os import path", False), ("open('x')", False), ("x.__class__", False), ("def", False), ("from sympy.abc import x", True)])
def test_code_check(spark, source, ok):
    from stepwright.functions import code

    assert code.check_code(source)[0] is ok
    assert one(spark, code.code_check(F.lit(source)).alias("c"))["c"]["ok"] is ok


@pytest.mark.parametrize(("source", "shown"), [("u = 42\nu * 2", "u = 42\nprint(u * 2)"), ("print(1)", "print(1)"), ("x = 1", "x = 1"), ("def", "def")])
def test_final_expression_is_printed(source, shown):
    from stepwright.functions import code

    assert code.show_last_expression(source) == shown


def test_last_json_object_and_dialogue(spark):
    from stepwright.functions import code

    assert code.last_object('first {"a": 1} then {bad} and {"b": {"c": 2}} end') == '{"c": 2}'
    assert one(spark, code.last_json_object(F.lit('x {"a": 1} y {"b": 2} z')).alias("j"))["j"] == '{"b": 2}'
    steps_ = [{"action_type": "code", "reasoning": "r", "code": "c" * 50, "observation": "o" * 50}, {"action_type": "answer", "reasoning": "r", "final_answer": "4"}]
    assert [m["role"] for m in code.dialogue("sys", "q", steps_)] == ["system", "user", "assistant", "user", "assistant"]
    assert len(code.dialogue("sys", "q", steps_ * 4, max_chars=250)) <= 8


def test_sandbox_sessions():
    from stepwright.functions import sandbox

    s = sandbox.Session()
    assert s.run("x = 20\nprint('once')").stdout == "once\n"
    assert s.run("x + 22").stdout == "42\n"
    assert not s.run("x = 1\nraise ValueError('no')").ok and s.run("print(x)").stdout == "20\n"
    assert s.run("import os").blocked
    assert s.run("u = 42\nu * 2").stdout == "84\n"
    assert sandbox.Session(seconds=1).run("while True: pass").timed_out


def test_problem_rows(spark):
    from stepwright.operators import queues

    rows = spark.createDataFrame([("1", " q ", ["4 "], None, False), ("2", "q", ["4"], "bad", False), ("3", "q", ["4"], "", True), ("4", " ", ["4"], None, None), ("5", "q", [], None, None)], "id string, question string, answers array<string>, error string, is_multiple_answer boolean")
    kept = queues.eligible_problems(rows)
    assert [r["id"] for r in kept.collect()] == ["1"]
    p = queues.map_problems(kept.withColumn("a", F.col("answers")[0]), {"id": "id", "problem": "question", "gold_answer": "a"}, "d").first()
    assert (p["problem"], p["gold_answer"], p["subject"], p["level"]) == ("q", "4", "unknown", "unknown")
    with pytest.raises(ValueError, match="limit"):
        queues.checked_limit(rows, 6)


def test_recovery_queue(spark):
    from stepwright.operators import queues

    kind = "k string, finished boolean, timed_out boolean, stop_reason string, final_answer string, steps array<struct<action_type:string>>"
    t = spark.createDataFrame([("a", True, False, "explicit_final_answer", "4", [("answer",)]), ("b", False, False, "api_error", "", []), ("c", False, False, "format_error_limit", "", [])], kind)
    assert [r["k"] for r in queues.recovery_selection(t, ["k"], skip_protocol=True).collect()] == ["b"]
    chosen = queues.recovery_selection(t, ["k"])
    log = spark.createDataFrame([("b", ["x"]), ("b", ["x"]), ("b", ["x"]), ("c", ["x"])], "k string, validation_reasons array<string>")
    assert [(r["k"], r["attempts"]) for r in queues.pending_attempts(chosen, log, ["k"]).collect()] == [("c", 1)]
    assert [r["k"] for r in queues.pending_attempts(chosen, spark.createDataFrame([("c", [])], log.schema), ["k"]).collect()] == ["b"]


def test_assembled_rows(spark):
    from stepwright.operators import queues

    a, b = spark.createDataFrame([(1, 5)], "k int, x int"), spark.createDataFrame([(1, "y"), (2, "z")], "k int, s string")
    got = {r["k"]: (r["Q"], r["T"]) for r in queues.assemble(["k"], ("Q", a), ("T", b)).collect()}
    assert got[1][0]["x"] == 5 and got[2][0] is None and got[2][1]["s"] == "z"


def test_positions_are_places_in_key_order(spark):
    keys = [None, "b", "a", "c", "b", *[f"k{i:04d}" for i in range(500)]]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = sorted((r["at"], r["k"]) for r in order.places(df, [], ["k"], "at").filter("k is not null").collect())
    assert [k for _, k in got] == sorted(k for k in keys if k) and [a for a, _ in got] == list(range(1, len(keys)))
    assert order.places(df.limit(0), [], ["k"], "at").collect() == []


@pytest.mark.parametrize("mean", [1, 7, 32, 33, 90, 2500])
def test_poisson_counts_have_the_distribution(spark, mean):
    d = spark.range(1).select(F.lit(mean).cast("long").alias("n"))
    w = [r["_w"] for r in resampling.draws(d, F.lit(f"key{mean}"), "n", 20000).collect()]
    m = sum(w) / len(w)
    assert len(w) == 20000 and min(w) >= 0
    assert abs(m - mean) < 5 * (mean / len(w)) ** 0.5
    assert abs(sum((x - m) ** 2 for x in w) / len(w) - mean) < 0.06 * mean
    below = sum(math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) for k in range(mean + 1))
    assert abs(sum(x <= mean for x in w) / len(w) - below) < 0.015


def test_bootstrap_interval_is_near_the_normal_one(spark):
    df = spark.createDataFrame([("g", i, float(i % 10 < 3)) for i in range(400)] + [("h", 1, None), ("one", 1, 4.0)], "g string, i int, v double")
    r = {x["g"]: x for x in resampling.bootstrap_ci(df, ["g"], "v", 2000).collect()}
    half = 1.96 * (0.3 * 0.7 / 400) ** 0.5
    assert abs(r["g"]["lo"] - (0.3 - half)) < 0.008 and abs(r["g"]["hi"] - (0.3 + half)) < 0.008
    assert set(r) == {"g", "one"} and (r["one"]["lo"], r["one"]["hi"]) == (4.0, 4.0)


def test_resolution_moves_bounds_by_half_of_it_at_most(spark):
    df = spark.range(3000).select(F.lit("g").alias("g"), ((F.col("id") * 37) % 1009 / 1000).alias("v"))
    a, b = (resampling.bootstrap_ci(df, ["g"], "v", 1000, resolution=x).first() for x in (None, 0.05))
    assert abs(a["lo"] - b["lo"]) < 0.025 + 0.005 and abs(a["hi"] - b["hi"]) < 0.025 + 0.005


def test_interval_agrees_with_drawing_every_row(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.integers(0, 6, 500) / 5
    df = spark.createDataFrame([("g", float(x)) for x in v], "g string, v double")
    m = v[rng.integers(0, 500, (5000, 500))].mean(axis=1)
    r = resampling.bootstrap_ci(df, ["g"], "v", 5000).first()
    assert abs(r["lo"] - np.quantile(m, 0.025)) < 0.004 and abs(r["hi"] - np.quantile(m, 0.975)) < 0.004


def test_paired_bootstrap_of_a_constant_difference(spark):
    df = spark.createDataFrame([(a, i, float(a == "p")) for a in "pq" for i in range(30)] + [("r", 1, None)], "a string, i int, v double")
    (r,) = resampling.paired_bootstrap(df, "a", "i", "v", 50).collect()
    assert (r["left"], r["right"], r["mean_diff"], r["lo"], r["hi"]) == ("p", "q", 1.0, 1.0, 1.0)


def row_draws(names, replicates):
    """How often each replicate draws each name, by the definition."""
    import hashlib

    h = lambda b, k: int(hashlib.md5(f"42:{b}:{k}".encode()).hexdigest()[:8], 16)
    return [[sum(h(b, k) >= t for t in resampling.POISSON_STEPS) for k in names] for b in range(replicates)]


def test_interval_draws_every_row_by_itself(spark):
    import numpy as np

    v = [0.0, 1.0, 1.0, 0.0, 1.0, 1.0, 3.0]
    df = spark.createDataFrame([("g", 7 * i, x) for i, x in enumerate(v)] + [("h", 1, None), ("one", 1, 4.0)], "g string, i int, v double")
    r = {x["g"]: (x["lo"], x["hi"]) for x in resampling.bootstrap_ci(df, ["g"], "v", 200, row="i").collect()}
    m = [np.dot(w, v) / sum(w) for w in row_draws([7 * i for i in range(7)], 200) if sum(w)]
    assert r == {"g": (pytest.approx(np.quantile(m, 0.025)), pytest.approx(np.quantile(m, 0.975))), "one": (4.0, 4.0)}


def means_with_replacement(v, replicates):
    """Mean of as many draws as there are values, with replacement, for each replicate, by the definition."""
    import hashlib

    pick = lambda b, k: int(hashlib.md5(f"42:{b}:{k}".encode()).hexdigest()[:8], 16) % len(v)
    return [sum(v[pick(b, k)] for k in range(len(v))) / len(v) for b in range(replicates)]


@pytest.mark.parametrize("block, hashes", [(2**18, 2**18), (3, 2**18), (3, 40), (1, 1)])
def test_resample_draws_as_many_rows_as_the_group_has(spark, monkeypatch, block, hashes):
    monkeypatch.setattr(resampling, "BLOCK", block)
    monkeypatch.setattr(resampling, "HASHES", hashes)
    groups = {"a": [0.0, 1.0, 1.0, 0.0, 1.0, 1.0, 3.0], "b": [2.0, -1.0, 0.5], None: [4.0, 8.0], "one": [4.0]}
    rows = [(g, 100 - i, x) for g, v in groups.items() for i, x in reversed(list(enumerate(v)))] + [("h", 1, None), ("a", 200, None)]
    df = spark.createDataFrame(rows, "g string, i int, v double").repartition(5).withColumn("i", -F.col("i"))
    got = {}
    for r in resampling.bootstrap_means(df, ["g"], "v", 60, order=["i"]).collect():
        got.setdefault(r["g"], {})[r["b"]] = r["mean"]
    assert {g: [m[b] for b in range(60)] for g, m in got.items()} == {g: pytest.approx(means_with_replacement(v, 60)) for g, v in groups.items()}


def test_rows_of_equal_order_are_numbered_by_value(spark):
    v = [0.0, 1.0, 1.0, 5.0]
    rows = [("g", 1, x) for x in v]
    a, b = ({r["b"]: r["mean"] for r in resampling.bootstrap_means(spark.createDataFrame(x, "g string, i int, v double"), ["g"], "v", 30, order=["i"]).collect()} for x in (rows, rows[::-1]))
    assert a == b and [a[i] for i in range(30)] == pytest.approx(means_with_replacement(v, 30))


def test_many_replicates_and_large_groups_of_one_value(spark):
    df = spark.range(30000).select((F.col("id") % 2).alias("g"), "id", (F.col("id") % 2 + 0.5).alias("v"))
    m = resampling.bootstrap_means(df, ["g"], "v", 7, order=["id"]).collect()
    assert len(m) == 14 and all(r["mean"] == r["g"] + 0.5 for r in m)


def test_query_draws_with_replacement_from_all_labelled_rows(spark, tmp_path):
    import numpy as np

    from stepwright.plans import registry

    labels = [(3, 1), (1, 0), (2, 1), (7, 0), (5, 1), (4, None), (9, 1)]
    sources = {1: "s", 2: "s", 3: "s", 4: "s", 5: "s", 7: "s", 9: None, 11: "s"}
    spark.createDataFrame([(i, q, 1) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i, "t", "en", s, 14) for i, s in sources.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    (r,) = registry.QUERIES["bootstrap_ci"](spark, str(tmp_path)).collect()
    m = means_with_replacement([0, 1, 1, 1, 0], 5000)
    assert (r["agent"], r["lo"], r["hi"]) == ("s", *(round(float(x), 6) for x in np.quantile(m, [0.025, 0.975])))


def test_paired_bootstrap_draws_every_problem_by_itself(spark):
    import numpy as np

    p, q = [1.0, 0.0, 1.0, 1.0, 0.5, 0.0], [0.0, 0.0, 1.0, 0.0, 0.25, 1.0]
    rows = [("p", i, x) for i, x in enumerate(p)] + [("q", i, x) for i, x in enumerate(q)] + [("p", 9, 1.0), ("q", 9, None), ("r", 0, 0.0), (None, 1, 1.0)]
    r = {(x["left"], x["right"]): x for x in resampling.paired_bootstrap(spark.createDataFrame(rows, "a string, i int, v double"), "a", "i", "v", 200).collect()}
    d = np.subtract(p, q)
    m = [np.dot(w, d) / sum(w) for w in row_draws(range(6), 200) if sum(w)]
    got = r["p", "q"]
    assert set(r) == {("p", "q"), ("p", "r"), ("q", "r")} and (r["p", "r"]["mean_diff"], r["p", "r"]["hi"]) == (1.0, 1.0)
    assert (got["mean_diff"], got["lo"], got["hi"]) == pytest.approx((d.mean(), np.quantile(m, 0.025), np.quantile(m, 0.975)))


def test_ranks_of_agents_that_always_differ(spark):
    df = spark.createDataFrame([(a, i, v) for i in range(50) for a, v in (("x", 1.0), ("y", 0.0), ("z", 0.0))] + [("z", 99, 1.0), ("y", 99, None)], "a string, i int, v double")
    r = {x["a"]: x for x in resampling.rank_stability(df, "a", "i", "v", 300).collect()}
    assert (r["x"]["mean_rank"], r["x"]["p_first"]) == (1.0, 1.0) and r["y"]["median_rank"] == 3.0 and 2 <= r["z"]["mean_rank"] < 3


@pytest.mark.parametrize("rho, n, p", [(0.5, 10, 0.1411), (0.9, 5, 0.0374), (0.0, 8, 1.0), (1.0, 6, 0.0), (0.3, 30, 0.1073), (None, 9, None), (0.5, 2, None)])
def test_rank_p_values(rho, n, p):
    got = stats.rank_p_value(rho, n)
    assert got is None if p is None else abs(got - p) < 1e-4


def test_p_values_of_correlations(spark):
    df = spark.createDataFrame([("m", float(i), float((i * 7) % 11)) for i in range(11)], "k string, x double, y double")
    r = stats.with_p_value(order.spearman(df, ["k"], "x", "y")).first()
    assert abs(r["p"] - stats.rank_p_value(r["rho"], 11)) < 1e-12
