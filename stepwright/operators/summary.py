"""Tables over attempts: coverage, rates, cost, latency, reliability, bounds.

``attempts`` has agent, problem_id and, as the table needs them, C, G, V, Q, PTU,
R, E, dataset, subject, level, tokens, latency, stop_reason, valid, eligible.
Group keys that are NULL are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import keyed, ratio, ratio_floor, share_within, total
from .order import quantiles
from .stats import rate, wilson
from .steps import harmful_repeat

INFRASTRUCTURE = ("api_error", "worker_exception", "trajectory_timeout")
PROTOCOL = ("format_error_limit", "answer_only_violation_limit")


def one(c: str) -> Column:
    return F.coalesce(F.col(c) == 1, F.lit(False))


def run_summary(a: DataFrame, by: str = "agent") -> DataFrame:
    """Per agent: n and 25 measures of all attempts, sorted by V then C."""
    n = F.count(F.lit(1))
    g = keyed(a, by).groupBy(by).agg(
        n.alias("n"), F.avg("C").alias("c"), F.avg("G").alias("g"), F.avg("V").alias("v"), F.avg("Q").alias("q"), F.avg("PTU").alias("ptu"), F.avg("R").alias("r"), F.avg("E").alias("e"),
        ratio(total(F.col("tokens")), n).alias("tokens_per_attempt"), ratio(total(F.col("tokens")), F.sum("V")).alias("tokens_per_verified"),
        F.avg("latency").alias("latency_mean"),
        *[F.avg(c).alias(f"{c}_mean") for c in ("service", "pace", "retry_wait", "total_steps")], rate(F.col("valid")).alias("completion_rate"), rate(F.col("timed_out")).alias("timeout_rate"),
        *[total(F.col(c)).alias(c) for c in ("retry_count", "truncated_steps", "critic_calls", "critic_errors")],
        F.count_if(known("judge_used") | known("needs_judge")).alias("symbolic_inconclusive"), F.count_if(known("judge_used")).alias("judge_fallbacks"), F.count_if(known("needs_judge")).alias("judge_queue"),
    )
    q = quantiles(keyed(a, by), [by], "latency", [0.5, 0.95], ["latency_median", "latency_p95"])
    return g.join(q, by, "left").orderBy(F.desc("v"), F.desc("c"), by)


def known(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def infrastructure() -> Column:
    return F.coalesce(F.col("stop_reason").isin(*INFRASTRUCTURE), F.lit(False))


def repair_summary(a: DataFrame, by: str = "agent") -> DataFrame:
    """Per agent over attempted and over valid attempts; rates over attempted have all attempts below the line."""
    n = F.count(F.lit(1))
    valid = lambda c: F.avg(F.when(F.col("valid"), F.col(c)))
    tokens, seconds = total(F.col("tokens")), total(F.col("latency"))
    g = keyed(a, by).groupBy(by).agg(
        n.alias("attempted"), F.count_if("valid").alias("valid_n"), (F.count_if("valid") / n).alias("coverage"), (1 - F.count_if(F.col("stop_reason").isin(*PROTOCOL)) / n).alias("format_adherence"), rate(infrastructure()).alias("infrastructure_rate"),
        *[(total(F.col(c)) / n).alias(f"{c.lower()}_operational") for c in "CGV"], *[valid(c).alias(f"{c.lower()}_valid") for c in ("C", "G", "V", "Q", "PTU", "R", "E")],
        tokens.alias("tokens"), (tokens / n).alias("tokens_per_attempt"), ratio(tokens, F.sum("C")).alias("tokens_per_correct"), ratio(tokens, F.sum("V")).alias("tokens_per_solve"), ratio(seconds, F.sum("V")).alias("seconds_per_solve"), (seconds / n).alias("latency_mean"),
        F.count_if(F.col("valid") & known("needs_judge")).alias("unresolved"), F.count_if(F.col("valid") & known("judge_used")).alias("judge_fallbacks"),
        total(F.when(F.col("valid"), F.col("critic_calls"))).alias("critic_selected"), total(F.when(F.col("valid"), F.col("critic_calls") - F.col("critic_errors"))).alias("critic_success"),
    )
    return g.orderBy(F.desc("v_operational"), F.desc("c_operational"), by)


def core_table(a: DataFrame, by: str = "agent", recorded: DataFrame | None = None, reason: str = "excluded") -> DataFrame:
    """The final table. Operational C, G, V count attempts that are not valid as 0; V has Wilson bounds; trace measures are of eligible valid attempts.

    ``recorded`` may have an agent's format_adherence; else it is the share of valid attempts.
    """
    n = F.count(F.lit(1))
    solved = lambda c: total(F.when(F.col("valid"), F.col(c)))
    valid = lambda c: F.avg(F.when(F.col("valid"), F.col(c)))
    trace = lambda c: F.avg(F.when(F.col("valid") & F.col("eligible"), F.col(c)))
    tokens = total(F.col("tokens"))
    g = keyed(a, by).groupBy(by).agg(
        n.alias("attempted"), F.count_if("valid").alias("valid_n"), (F.count_if("valid") / n).alias("coverage"), rate(infrastructure()).alias("infrastructure_rate"),
        *[(solved(c) / n).alias(c.lower()) for c in "CGV"], *[valid(c).alias(f"{c.lower()}_valid") for c in "CGV"], solved("V").alias("_v"), *[trace(c).alias(c.lower()) for c in ("Q", "PTU", "R", "E")],
        tokens.alias("tokens"), (tokens / n).alias("tokens_per_attempt"), ratio_floor(tokens, solved("C")).alias("tokens_per_correct"), ratio_floor(tokens, solved("V")).alias("tokens_per_solve"), F.avg("latency").alias("latency_mean"),
        F.coalesce(F.bool_and("eligible"), F.lit(True)).alias("eligible"),
    )
    g = g.join(quantiles(keyed(a, by), [by], "latency", [0.95], ["latency_p95"]), by, "left")
    lo, hi = wilson(F.col("_v"), F.col("attempted"))
    g = g.withColumn("v_lo", lo).withColumn("v_hi", hi).withColumn("exclusion", F.when(F.col("eligible"), "").otherwise(reason)).drop("_v")
    if recorded is None:
        return g.withColumn("format_adherence", F.col("coverage"))
    return g.join(recorded.select(by, "format_adherence"), by, "left").withColumn("format_adherence", F.coalesce("format_adherence", "coverage"))


def health(a: DataFrame, by: str = "agent") -> DataFrame:
    """Records by how they ended, and the histogram of stop reasons as JSON in order of reason."""
    counts = keyed(a, by).groupBy(by, "stop_reason").agg(F.count(F.lit(1)).alias("n"))
    infra, done = F.col("stop_reason").isin(*INFRASTRUCTURE), F.col("stop_reason") == "explicit_final_answer"
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    g = counts.groupBy(by).agg(F.sum("n").alias("records"), some(done).alias("explicit_answers"), some(infra).alias("infrastructure_failures"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("stop_reason").isNotNull(), F.struct("stop_reason", "n")))))).alias("stop_reasons"))
    return g.withColumn("other_incomplete", F.col("records") - F.col("explicit_answers") - F.col("infrastructure_failures")).withColumn("completion_rate", F.col("explicit_answers") / F.col("records"))


def coverage(a: DataFrame, metrics: list[str], by: str = "agent", trace: tuple[str, ...] = ("Q", "PTU", "R")) -> DataFrame:
    """Rows, distinct problems, how attempts and judgements ended and, for each metric, how many are missing and how many are 0.

    A trace metric of an agent that is not eligible counts as missing throughout, and its zeros are not counted.
    """
    out = F.col("eligible")
    g = keyed(a, by).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("problem_id").alias("problems"), rate(F.col("valid")).alias("completion_rate"), rate(infrastructure()).alias("infrastructure_rate"), F.count_if(known("judge_used")).alias("judge_fallbacks"), F.count_if(known("needs_judge")).alias("unresolved"),
        F.coalesce(F.bool_and("eligible"), F.lit(True)).alias("eligible"), *[F.count_if(F.col(m).isNull()).alias(f"{m}_missing") for m in metrics], *[F.count_if(F.col(m) == 0).alias(f"{m}_zero") for m in metrics],
    )
    for m in (m for m in metrics if m in trace):
        g = g.withColumn(f"{m}_missing", F.when(out, F.col(f"{m}_missing")).otherwise(F.col("n"))).withColumn(f"{m}_zero", F.when(out, F.col(f"{m}_zero")))
    return g


def views(a: DataFrame) -> DataFrame:
    """Each attempt once per view that it is in: all_attempted, completed_only, infrastructure_clean. One pass."""
    infra = F.coalesce(F.col("stop_reason").isin(*INFRASTRUCTURE), F.lit(False))
    tags = F.array(F.lit("all_attempted"), F.when(F.coalesce(F.col("stop_reason") == "explicit_final_answer", F.lit(False)), "completed_only"), F.when(~infra, "infrastructure_clean"))
    return a.withColumn("view", F.explode(F.filter(tags, lambda x: x.isNotNull())))


def view_sensitivity(a: DataFrame) -> DataFrame:
    return keyed(views(a), "agent").groupBy("view", "agent").agg(F.count(F.lit(1)).alias("n"), F.avg("C").alias("c"), F.avg("G").alias("g"), F.avg("V").alias("v"))


def cg_matrix(a: DataFrame, by: str = "agent") -> DataFrame:
    """Correct or not by grounded or not: counts and shares within the agent; missing counts as not."""
    d = keyed(a, by).select(by, F.when(one("C"), "correct").otherwise("incorrect").alias("correctness"), F.when(one("G"), "grounded").otherwise("ungrounded").alias("grounding"))
    return d.groupBy(by, "correctness", "grounding").agg(F.count(F.lit(1)).alias("n")).withColumn("share", share_within("n", by))


def retention(a: DataFrame, by: str = "agent") -> DataFrame:
    g = keyed(a, by).groupBy(by).agg(F.avg("C").alias("c"), F.avg("G").alias("g"), F.avg("V").alias("v"))
    return g.withColumn("gap", F.col("c") - F.col("v")).withColumn("retention", ratio(F.col("v"), F.col("c")))


def distribution(a: DataFrame, value: str, by: str = "agent", keep_missing: bool = False) -> DataFrame:
    """Counts of a value and shares within the agent."""
    d = keyed(a, by) if keep_missing else keyed(a, by, value)
    return d.groupBy(by, value).agg(F.count(F.lit(1)).alias("n")).withColumn("share", share_within("n", by))


def breakdown(a: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return keyed(a, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"{m}_mean") for m in metrics], *[F.count(m).alias(f"{m}_count") for m in metrics])


def pivot_mean(a: DataFrame, rows: str, columns: str, values: list, metric: str) -> DataFrame:
    """Mean of a metric with the columns' values named, so the data is read once."""
    return keyed(a, rows).groupBy(rows).pivot(columns, values).agg(F.avg(metric))


def cost_per_solve(a: DataFrame, by: str = "agent") -> DataFrame:
    """Ratios of sums, NULL where nothing was solved; hidden and reporting tokens as shares of the output."""
    sums = {"tokens": "tokens", "seconds": "latency", "solved": "C", "verified": "V", "hidden": "hidden", "reporting": "answer_reporting", "output": "api_output"}
    g = keyed(a, by).groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[total(F.col(c)).alias(k) for k, c in sums.items()])
    each = [ratio(F.col(x), F.col(y)).alias(f"{p}_{q}") for x, p in (("tokens", "per"), ("seconds", "seconds_per")) for y, q in (("solved", "correct"), ("verified", "verified"))]
    return g.select(by, (F.col("tokens") / F.col("n")).alias("per_attempt"), *each, *[(F.col(c) / F.greatest("output", F.lit(1))).alias(f"{c}_share") for c in ("hidden", "reporting")])


def latency_percentiles(a: DataFrame, columns: list[str], by: str = "agent", at=(0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles, in long form: agent, measure, p50, p90, p95, p99."""
    long = keyed(a, by).unpivot(by, columns, "measure", "value") if len(columns) > 1 else keyed(a, by).select(by, F.lit(columns[0]).alias("measure"), F.col(columns[0]).alias("value"))
    q = quantiles(long, [by, "measure"], "value", list(at), [f"p{round(100 * x)}" for x in at])
    return long.select(by, "measure").distinct().join(q, [by, "measure"], "left")


def reliability(a: DataFrame, by: str = "agent") -> DataFrame:
    """Availability, and V and C given completion and over all."""
    infra = F.coalesce(F.col("stop_reason").isin(*INFRASTRUCTURE), F.lit(False))
    done = F.coalesce(F.col("stop_reason") == "explicit_final_answer", F.lit(False))
    return keyed(a, by).groupBy(by).agg(rate(~infra).alias("availability"), rate(done).alias("completion"), F.avg(F.when(done, F.col("C"))).alias("c_completed"), F.avg(F.when(done, F.col("V"))).alias("v_completed"), F.avg("C").alias("c_all"), F.avg("V").alias("v_all"))


def correctness_bounds(a: DataFrame, by: str = "agent") -> DataFrame:
    """C if all unresolved were wrong, and if all were right."""
    n = F.count(F.lit(1))
    return keyed(a, by).groupBy(by).agg(n.alias("n"), F.count_if(F.col("C").isNull()).alias("unresolved"), (total(F.col("C")) / n).alias("lower"), ((total(F.col("C")) + F.count_if(F.col("C").isNull())) / n).alias("upper"))


def observability(steps: DataFrame, a: DataFrame, by: str = "agent", adherence: float = 0.95, unmapped: float = 0.05, reason: str = "reasoning is not mapped to visible actions") -> DataFrame:
    """Attempts and step rates of an agent, and whether its traces may be judged; an agent without steps has rates of 0."""
    s = keyed(steps, by).groupBy(by).agg(F.count(F.lit(1)).alias("steps"), *[rate(F.col(c)).alias(f"{c}_rate") for c in ("actionable", "unmapped", "reasoned", "ran")], total(F.col("hidden_tokens")).alias("hidden_tokens"), total(F.col("reasoning_chars")).alias("reasoning_chars"))
    n = F.count(F.lit(1))
    t = keyed(a, by).groupBy(by).agg(n.alias("attempted"), F.count_if("valid").alias("valid_n"), (1 - F.count_if(F.col("stop_reason").isin(*PROTOCOL)) / n).alias("format_adherence"))
    g = t.join(s, by, "left").fillna(0)
    g = g.withColumn("eligible", (F.col("format_adherence") >= adherence) & (F.col("unmapped_rate") <= unmapped))
    return g.withColumn("exclusion", F.when(F.col("eligible"), "").otherwise(reason))


def evaluator_coverage(a: DataFrame, calls: DataFrame, by: str = "agent") -> DataFrame:
    """Success rate of evaluator calls (0 without calls) and share of valid attempts with a decision."""
    g = calls.groupBy(by).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") == "success").alias("successes"))
    v = keyed(a, by).groupBy(by).agg(F.count_if("valid").alias("valid_n"), F.count_if(F.col("valid") & F.col("C").isNull()).alias("unresolved"))
    j = v.join(g, by, "left").fillna(0, ["calls", "successes"])
    return j.withColumn("success_rate", F.coalesce(ratio(F.col("successes"), F.col("calls")), F.lit(0.0))).withColumn("decision_coverage", 1 - ratio(F.col("unresolved"), F.col("valid_n")))


def impact(before: DataFrame, after: DataFrame, metrics: list[str], by: str = "agent") -> DataFrame:
    """After less before for each metric."""
    j = before.select(by, *[F.col(m).alias(f"{m}_before") for m in metrics]).join(after.select(by, *[F.col(m).alias(f"{m}_after") for m in metrics]), by)
    return j.select("*", *[(F.col(f"{m}_after") - F.col(f"{m}_before")).alias(f"{m}_delta") for m in metrics])


def by_outcome(a: DataFrame, metric: str, by: str = "agent") -> DataFrame:
    """Mean of a metric over correct and over incorrect attempts."""
    return keyed(a, by).groupBy(by).agg(F.avg(F.when(one("C"), F.col(metric))).alias(f"{metric}_correct"), F.avg(F.when(~one("C"), F.col(metric))).alias(f"{metric}_incorrect"))


def threshold_sweep(steps: DataFrame, similarity: str, thresholds, by: str = "agent") -> DataFrame:
    """Share of steps at or above each threshold, with one scan."""
    d = keyed(steps, by).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return d.groupBy(by, "threshold").agg(rate(F.col(similarity) >= F.col("threshold")).alias("repetition"))


def redundancy_sensitivity(steps: DataFrame, thresholds, by: str = "agent") -> DataFrame:
    """Per threshold of similarity: share of steps at or above it, and of those that repeat harmfully by it; one scan.

    ``steps`` has max_similarity, exact, algebraic, useful_verification, tool_gain, action_type.
    """
    d = keyed(steps, by).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    raw = F.coalesce(F.col("max_similarity"), F.lit(0.0)) >= F.col("threshold")
    harm = harmful_repeat(F.col("action_type"), known("exact"), raw, known("algebraic"), known("useful_verification"), F.coalesce("tool_gain", F.lit(0.0)))
    return d.groupBy(by, "threshold").agg(rate(harm > 0).alias("harmful_redundancy"), rate(raw).alias("raw_semantic_repetition"))


def adjudication_sources(a: DataFrame, by: str = "agent") -> DataFrame:
    """How many attempts of each agent were decided by each source, and their share; attempts without a source are left out."""
    return distribution(a, "correctness_source", by)


def solution_table(a: DataFrame, by: str = "agent") -> DataFrame:
    """Shares of attempts whose solution was found, and found in the last step; mean and median of the tokens after it.

    ``a`` has solution, total_steps, post_waste.
    """
    g = keyed(a, by).groupBy(by).agg(rate(F.col("solution").isNotNull()).alias("detection_rate"), rate(F.col("solution") == F.col("total_steps")).alias("terminal_rate"), F.avg("post_waste").alias("mean_post_waste"))
    return g.join(quantiles(keyed(a, by), [by], "post_waste", [0.5], ["median_post_waste"]), by, "left")


def critic_audit(steps: DataFrame, by: str = "agent") -> DataFrame:
    """Steps, share of them that a critic saw, mean change of the process score and mean score."""
    return keyed(steps, by).groupBy(by).agg(F.count(F.lit(1)).alias("steps"), rate(F.col("critic_used")).alias("critic_rate"), F.avg("prm_delta").alias("mean_prm_delta"), F.avg("hybrid_score").alias("mean_hybrid_score"))


def trace_agents(a: DataFrame, excluded: list[str], by: str = "agent") -> DataFrame:
    """Rows of the agents whose traces are looked at."""
    return keyed(a, by).filter(~F.col(by).isin(*excluded)) if excluded else keyed(a, by)


def earliest_error(steps: DataFrame, keys: list[str], by: str = "agent") -> DataFrame:
    """Over failed attempts: mean, median and number of the normalized position of the first regressive step."""
    first = steps.filter((F.coalesce(F.col("C"), F.lit(0)) == 0) & (F.col("label") == "regressive")).groupBy(*{*keys, by}).agg(F.min("normalized_position").alias("p"))
    return first.groupBy(by).agg(F.avg("p").alias("mean"), F.percentile("p", F.lit(0.5)).alias("median"), F.count(F.lit(1)).alias("attempts"))


def compare_runs(runs: dict[str, DataFrame], metrics: list[str], by: str = "agent") -> DataFrame:
    """Several runs in long form: run, agent, metric, value."""
    parts = [d.select(F.lit(name).alias("run"), by, *metrics) for name, d in sorted(runs.items())]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.unpivot(["run", by], metrics, "metric", "value")
