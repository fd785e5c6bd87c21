"""Per-step and per-attempt measures.

Steps come in long form (one row per step, with keys and a position) or as an
array per attempt; prefix comparisons use the array, so an attempt is never
joined with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.algebra import first_equal, restates
from ..functions.text import math_normalize, output_candidates

#: Weights and thresholds of the step score.
W_PRM, W_CRITIC, W_TOOL, W_REDUNDANT, W_ERROR = 0.45, 0.25, 0.15, -0.25, -0.50
SEMANTIC, DELTA_SCALE, PROGRESSIVE, REGRESSIVE, CRITIC_BOUNDARY = 0.85, 0.10, 0.20, -0.20, 0.08
CLASS_VALUE = {"progressive": 1.0, "neutral_useful": 0.5, "neutral_waste": 0.0, "redundant": -0.5, "regressive": -1.0}
CRITIC_SIGNAL = CLASS_VALUE | {"neutral_useful": 0.25}
BUDGETS = (512, 1024, 2048, 4096, 8192)
VERIFY_WORDS = r"verify|check|substitut|simplif|factor|assert|residual"


def lookup(c: Column, table: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def redundancy_signals(attempts: DataFrame, vectors: str, texts: str, threshold: float = SEMANTIC) -> DataFrame:
    """For an array of unit vectors and one of texts: ``signals``, an array of (max_similarity, exact, semantic) by step."""

    def one(v: Column, i: Column) -> Column:
        earlier = F.slice(F.col(vectors), F.lit(1), i)
        top = F.coalesce(F.array_max(F.transform(earlier, lambda u: dot(u, v))), F.lit(0.0))
        text = F.get(F.col(texts), i)
        exact = (F.coalesce(text, F.lit("")) != "") & F.array_contains(F.slice(F.col(texts), F.lit(1), i), text)
        return F.struct(top.alias("max_similarity"), F.coalesce(exact, F.lit(False)).alias("exact"), (top >= threshold).alias("semantic"))

    return attempts.withColumn("signals", F.transform(vectors, one))


def prm_signal(delta: Column) -> Column:
    return F.tanh(delta / max(DELTA_SCALE, 1e-6))


def base_score(signal: Column, gain: Column, harm: Column, error: Column) -> Column:
    """The score before a critic is heard."""
    return W_PRM * signal + W_TOOL * gain + W_REDUNDANT * harm + W_ERROR * error


def wants_critic(base: Column, action: Column) -> Column:
    return (F.abs(base) < CRITIC_BOUNDARY) & (action != "answer")


def step_label(score: Column, error: Column, harm: Column, useful: Column) -> Column:
    """The first that holds: error or low score, harmful repeat, high score, useful check, else waste."""
    return (
        F.when((error > 0) | (score <= REGRESSIVE), "regressive")
        .when(harm > 0, "redundant")
        .when(score >= PROGRESSIVE, "progressive")
        .when(useful, "neutral_useful")
        .otherwise("neutral_waste")
    )


def label_steps(steps: DataFrame, critic: bool = True) -> DataFrame:
    """hybrid_score and label from prm_delta, critic_signal, tool_gain, harmful_repeat, error_flag, useful_verification."""
    base = base_score(prm_signal(F.col("prm_delta")), F.col("tool_gain"), F.col("harmful_repeat"), F.col("error_flag"))
    score = base + (W_CRITIC * F.coalesce(F.col("critic_signal"), F.lit(0.0)) if critic else 0.0)
    return steps.withColumn("hybrid_score", score).withColumn("label", step_label(F.col("hybrid_score"), F.col("error_flag"), F.col("harmful_repeat"), F.coalesce(F.col("useful_verification"), F.lit(False))))


def quality(steps: DataFrame, *keys: str, label: str = "label") -> DataFrame:
    """Q and the five label rates of each attempt; an attempt without steps is not in ``steps`` and has Q 0."""
    value = lookup(F.col(label), CLASS_VALUE)
    g = steps.groupBy(*keys).agg(F.avg(value).alias("signed_quality"), F.count(F.lit(1)).alias("steps"), *[F.avg((F.col(label) == name).cast("double")).alias(f"{name}_rate") for name in CLASS_VALUE])
    return g.withColumn("q_step", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("signed_quality") + 1) / 2)))


def token_utility(steps: DataFrame, *keys: str) -> DataFrame:
    """PTU and token sums from position, solution (position or NULL), action_type, label, output_tokens, hidden_tokens."""
    visible = F.greatest(F.lit(0), F.coalesce(F.col("output_tokens"), F.lit(0)) - F.coalesce(F.col("hidden_tokens"), F.lit(0)))
    kind = (
        F.when(F.col("action_type") == "answer", "answer")
        .when(F.col("position") > F.col("solution"), "post")
        .when(F.col("label").isin("progressive", "neutral_useful"), "useful")
        .otherwise("pre")
    )
    d = steps.withColumn("_v", visible).withColumn("_k", kind)
    part = lambda k: F.coalesce(F.sum(F.when(F.col("_k") == k, F.col("_v"))), F.lit(0))
    g = d.groupBy(*keys).agg(part("useful").alias("t_useful"), part("pre").alias("t_pre_waste"), part("post").alias("t_post_waste"), part("answer").alias("t_answer"))
    process = F.col("t_useful") + F.col("t_pre_waste") + F.col("t_post_waste")
    whole = F.greatest(process, F.lit(1)).cast("double")
    return g.withColumn("t_process", process).withColumn("ptu", F.col("t_useful") / whole).withColumn("pre_waste_rate", F.col("t_pre_waste") / whole).withColumn("post_waste_rate", F.col("t_post_waste") / whole)


def redundancy_rates(steps: DataFrame, *keys: str) -> DataFrame:
    """Rates of exact, semantic, algebraic, useful, circular and harmful repeats."""
    repeat = F.col("exact") | F.col("semantic") | F.col("algebraic")
    r = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return steps.groupBy(*keys).agg(r(F.col("exact")).alias("r_exact"), r(F.col("semantic")).alias("r_semantic"), r(F.col("algebraic")).alias("r_algebraic"), r(F.col("useful_verification")).alias("r_useful"), r(repeat & ~F.col("useful_verification") & (F.col("tool_gain") == 0)).alias("r_circular"), r(F.col("harmful_repeat") > 0).alias("r_harmful"))


def harmful_repeat(action: Column, exact: Column, semantic: Column, algebraic: Column, useful: Column, gain: Column) -> Column:
    return ((action != "answer") & (exact | semantic | algebraic) & ~useful & (gain == 0)).cast("double")


def useful_verification(success: Column, reasoning: Column, code: Column, stdout: Column, final_answer: Column) -> Column:
    """A successful run that speaks of checking and prints the final answer."""
    says = F.lower(F.concat_ws(" ", reasoning, code)).rlike(VERIFY_WORDS)
    asked = success & says
    return F.coalesce(asked & first_equal(F.when(asked, output_candidates(stdout)), final_answer).isNotNull(), F.lit(False))


def algebraic_restatement(now: Column, earlier: Column) -> Column:
    """Do two candidate lists hold values that are written differently and equal?"""
    return restates(now, earlier)


def tool_gain(steps: DataFrame, keys: list[str], order: str) -> DataFrame:
    """1 for a successful run whose normalized output was not seen before in the attempt and is not empty."""
    d = steps.withColumn("_out", math_normalize(F.col("stdout")))
    first = F.row_number().over(Window.partitionBy(*keys, "_out").orderBy(order)) == 1
    return d.withColumn("tool_gain", (F.coalesce(F.col("code_success"), F.lit(False)) & first & (F.col("_out") != "")).cast("double")).drop("_out")


def error_flag(error: Column, action: Column, success: Column) -> Column:
    return ((F.coalesce(error, F.lit("")) != "") | ((action == "code") & ~F.coalesce(success, F.lit(False)))).cast("double")


def provenance(steps: DataFrame, keys: list[str], final_answer: str) -> DataFrame:
    """Per attempt: where a successful run first printed the final answer (step, candidate), how, and how many runs up to it."""
    ran = F.coalesce(F.col("code_success"), F.lit(False))
    d = steps.filter(ran).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("step_num")))
    d = d.withColumn("_all", output_candidates(F.col("stdout")))
    d = d.withColumn("_c", F.get("_all", first_equal(F.col("_all"), F.col(final_answer)) - 1)).drop("_all")
    found = F.when(F.col("_c").isNotNull(), F.struct("step_num", F.col("_c").alias("candidate"), F.col("_n").alias("evidence")))
    g = d.groupBy(*keys).agg(F.min(found).alias("_m"), F.count(F.lit(1)).alias("_runs"))
    method = F.when(F.col("_m").isNotNull(), "symbolic_tool_output_match").otherwise("tool_used_not_traceable")
    g = g.select(*keys, F.col("_m.step_num").alias("evidence_step"), F.col("_m.candidate").alias("candidate"), method.alias("method"), F.coalesce(F.col("_m.evidence"), F.col("_runs")).alias("evidence_count"))
    every = steps.select(*keys).distinct()
    return every.join(g, keys, "left").withColumn("method", F.coalesce("method", F.lit("no_tool_evidence"))).withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0)).cast("int"))


def correctness(symbolic: Column, judged: Column) -> tuple[Column, Column, Column]:
    """C, its source, and whether a judge is still needed."""
    c = F.coalesce(symbolic.cast("int"), judged.cast("int"), F.lit(0))
    source = F.when(symbolic.isNotNull(), "symbolic").when(judged.isNotNull(), "judge_fallback").otherwise("unresolved_needs_adjudication")
    return c, source, symbolic.isNull() & judged.isNull()


def grounding(c: Column, evidence_count: Column, evidence_step: Column) -> tuple[Column, Column, Column]:
    """G level, G and V."""
    level = F.when(F.coalesce(evidence_count, F.lit(0)) == 0, "G0").when(evidence_step.isNull(), "G1").when(c == 1, "G3").otherwise("G2")
    g = level.isin("G2", "G3").cast("int")
    return level, g, c * g


def budget_status(steps: DataFrame, keys: list[str], order: str, budgets=BUDGETS) -> DataFrame:
    """keys, budget, c, g, v: solved and grounded within each token budget. Needs output_tokens, action_type, correct, evidence_step.

    One running sum per attempt; budgets are exploded from a literal list.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = steps.withColumn("_run", F.sum(F.coalesce("output_tokens", F.lit(0))).over(w)).withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets])))
    inside = F.col("_run") <= F.col("budget")
    g = d.groupBy(*keys, "budget").agg(
        F.max((inside & (F.col("action_type") == "answer") & (F.coalesce(F.col("correct"), F.lit(0)) == 1)).cast("int")).alias("c"),
        F.max((inside & (F.col(order) >= F.col("evidence_step"))).cast("int")).alias("g"),
    )
    g = g.withColumn("g", F.coalesce("g", F.lit(0)))
    return g.withColumn("v", F.col("c") * F.col("g"))


def ensemble(scores: Column, n: Column) -> Column:
    """Mean over models of score lists brought to length n: short ones repeat their last value, empty ones are 0.5."""
    padded = F.transform(scores, lambda s: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(s, i.cast("int")), F.try_element_at(s, F.lit(-1)), F.lit(0.5))))
    mean = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(padded, F.lit(0.0), lambda a, s: a + F.get(s, i.cast("int"))) / F.size(padded))
    return F.when(n <= 0, F.array().cast("array<double>")).when(F.size(scores) == 0, F.array_repeat(F.lit(0.5), n.cast("int"))).otherwise(mean)


def prm_long(sheets: DataFrame, sheet: str = "sheet") -> DataFrame:
    """agent, problem_id, model, step, score of nested score sheets."""
    a = sheets.select(F.explode(sheet).alias("agent", "problems"))
    p = a.select("agent", F.explode("problems").alias("problem_id", "s"))
    m = p.select("agent", "problem_id", F.explode("s.by_model").alias("model", "scores"))
    return m.select("agent", "problem_id", "model", F.posexplode("scores").alias("step", "score"))


def apply_judge(metrics: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Put successful judge decisions into rows of (C_final, G, V, G_level, correctness_source); ``changed`` and ``low_confidence`` audit it."""
    d = decisions.filter("status = 'success'").select(*keys, F.col("correct").cast("int").alias("_d"), F.col("confidence").alias("_conf"))
    j = metrics.join(d, keys, "left")
    has, c = F.col("_d").isNotNull(), F.coalesce(F.col("_d"), F.col("C_final"))
    level = F.when(has & (F.col("G") == 1), F.when(c == 1, "G3").otherwise("G2")).otherwise(F.col("G_level"))
    return j.select(*[x for x in metrics.columns if x not in ("C_final", "V", "G_level", "correctness_source")], c.alias("C_final"), (c * F.col("G")).alias("V"), level.alias("G_level"), F.when(has, "judge_fallback").otherwise(F.col("correctness_source")).alias("correctness_source"), (has & (F.col("_d") != F.col("C_final"))).alias("changed"), (F.col("_conf") < 0.70).alias("low_confidence"))


def apply_critic(steps: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Put successful critic labels into steps, and score and label them anew; ``changed`` audits it."""
    v = verdicts.filter("status = 'success'").select(*keys, F.col("label").alias("_said"))
    j = steps.join(v, keys, "left").withColumn("_old", F.col("label"))
    j = j.withColumn("critic_signal", F.coalesce(lookup(F.col("_said"), CRITIC_SIGNAL), F.col("critic_signal"))).withColumn("critic_used", F.col("_said").isNotNull() | F.coalesce("critic_used", F.lit(False)))
    return label_steps(j).withColumn("changed", ~F.col("label").eqNullSafe(F.col("_old"))).drop("_said", "_old")


def overall(v: Column, ptu: Column, q: Column, harmful: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v * ptu * q * (1 - harmful)))


def latency(steps: DataFrame, *keys: str) -> DataFrame:
    """Seconds of requests, service, pacing and retries of each attempt, its request attempts, those beyond a step's first, and cut steps."""
    seconds = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("request_sec", "service_sec", "pace_sec", "retry_wait_sec")]
    tries = F.coalesce(F.col("request_attempts"), F.lit(0))
    return steps.groupBy(*keys).agg(*seconds, F.sum(tries).alias("request_attempts"), F.sum(F.greatest(F.lit(0), tries - 1)).alias("retry_count"), F.count_if(F.coalesce("truncated", F.lit(False))).alias("truncated_steps"))
