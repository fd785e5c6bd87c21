"""Metric rows, which nest their measures, as the flat frames that analyses start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.semantics import num
from .merge import unique_by
from .steps import overall, quality, token_utility
from .summary import INFRASTRUCTURE

#: The short names of an analysis and where a metric row has them, with their types.
COLUMNS = {
    "C": ("C_G_V.C_final", "int"), "G": ("C_G_V.G", "int"), "V": ("C_G_V.V", "int"), "G_level": ("C_G_V.G_level", "string"), "correctness_source": ("C_G_V.correctness_source", "string"),
    "judge_used": ("C_G_V.judge_used", "boolean"), "needs_judge": ("C_G_V.needs_judge", "boolean"), "Q": ("Q.Q_step", "double"), "PTU": ("T.PTU", "double"),
    "billable": ("T.T_billable", "bigint"), "useful": ("T.T_useful", "bigint"), "pre_waste": ("T.T_pre_waste", "bigint"), "post_waste": ("T.T_post_waste", "bigint"), "answer_reporting": ("T.T_answer_reporting", "bigint"),
    "hidden": ("T.T_hidden_reasoning", "bigint"), "solution_step": ("T.solution_evidence_step", "int"), "R_harmful": ("R.R_harmful", "double"), "R_useful": ("R.R_useful_verification", "double"), "R_semantic": ("R.R_semantic_raw", "double"),
    "latency": ("L.L_trajectory_sec", "double"), "service": ("L.L_provider_service_sec", "double"), "pace": ("L.L_rate_limit_wait_sec", "double"), "retry_wait": ("L.L_retry_wait_sec", "double"), "retry_count": ("L.retry_count", "bigint"),
}
ROW = ("agent", "problem_id", "dataset", "subject", "finished", "stop_reason")
TOKENS = ("T_billable", "T_api_input", "T_api_output", "T_hidden_reasoning", "T_useful", "T_pre_waste", "T_post_waste", "T_answer_reporting")


def at(df: DataFrame, path: str, kind: str) -> Column:
    """The column at a dotted path, NULL where the schema lacks it."""
    schema = df.schema
    for part in path.split("."):
        if not isinstance(schema, StructType) or part not in schema.names:
            return F.lit(None).cast(kind)
        schema = schema[part].dataType
    return F.col(path).cast(kind)


def canonical(metrics: DataFrame, trajectories: DataFrame | None = None) -> DataFrame:
    """One flat row per metric row: keys, the 24 measures by short name, whether infrastructure failed it, whether it ended, its level.

    ``level`` comes from the trajectory of the same agent and problem, 'unknown'
    without one; a trajectory that repeats is an error.
    """
    d = metrics.select(*[at(metrics, c, "boolean" if c == "finished" else "string").alias(c) if c != "problem_id" else F.col(c) for c in ROW], *[at(metrics, path, kind).alias(short) for short, (path, kind) in COLUMNS.items()])
    d = d.withColumn("infrastructure_failure", F.coalesce(F.col("stop_reason").isin(*INFRASTRUCTURE), F.lit(False))).withColumn("completed", F.coalesce("finished", F.lit(False)))
    if trajectories is None:
        return d.withColumn("level", F.lit("unknown"))
    levels = unique_by(trajectories.select(F.col("agent_name").alias("agent"), "problem_id", F.col("level").cast("string").alias("level")), "agent", "problem_id")
    return d.join(levels, ["agent", "problem_id"], "left").withColumn("level", F.coalesce("level", F.lit("unknown")))


def metric_rows(metrics: DataFrame, eligibility: DataFrame, source: str) -> DataFrame:
    """The 31 columns of the final table's rows. ``eligibility`` has agent, eligible, reason; an agent that it lacks is eligible.

    Outcomes of attempts that are not valid count as 0; trace measures are NULL
    unless the attempt is valid and its agent eligible.
    """
    d = metrics.join(eligibility.select("agent", F.col("eligible").alias("_ok"), F.col("reason").alias("_why")), "agent", "left")
    valid, ok = F.coalesce("valid_trajectory", F.lit(False)), F.coalesce("_ok", F.lit(True))
    value = lambda path: num(at(metrics, path, "double"))
    trace = lambda path: F.when(valid & ok, value(path))
    outcome = lambda path: F.when(valid, F.coalesce(value(path), F.lit(0.0))).otherwise(0.0)
    return d.select(
        "agent", "problem_id", "dataset", "subject", F.lit(source).alias("source"), valid.alias("valid_trajectory"), "stop_reason", "finished",
        value("C_G_V.C_final").alias("C_final"), value("C_G_V.G").alias("G"), value("C_G_V.V").alias("V"), outcome("C_G_V.C_final").alias("C_operational_row"), outcome("C_G_V.G").alias("G_operational_row"), outcome("C_G_V.V").alias("V_operational_row"),
        trace("Q.Q_step").alias("Q"), trace("T.PTU").alias("PTU"), trace("R.R_harmful").alias("R_harmful"), trace("E_optional").alias("E_optional_row"), *[F.coalesce(value(f"T.{c}"), F.lit(0.0)).alias(c) for c in TOKENS],
        F.coalesce(value("L.L_trajectory_sec"), value("elapsed_sec")).alias("latency_sec"), ok.alias("trace_metric_eligible"), F.when(ok, "").otherwise(F.coalesce("_why", F.lit(""))).alias("trace_exclusion_reason"),
        at(metrics, "C_G_V.correctness_source", "string").alias("correctness_source"), at(metrics, "C_G_V.G_level", "string").alias("G_level"),
    )


def recompute(metrics: DataFrame, steps: DataFrame, touched: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of (V, PTU, Q, R, E, valid) after labels of some keys changed: Q of these keys only, PTU of all, E of valid rows."""
    q = quality(steps.join(touched.select(*keys).distinct(), keys, "left_semi"), *keys).select(*keys, F.col("q_step").alias("_q"))
    t = token_utility(steps, *keys).select(*keys, F.col("ptu").alias("_ptu"))
    j = metrics.join(q, keys, "left").join(t, keys, "left").withColumn("Q", F.coalesce("_q", "Q")).withColumn("PTU", F.coalesce("_ptu", "PTU")).drop("_q", "_ptu")
    return j.withColumn("E", F.when(F.coalesce("valid", F.lit(False)), overall(F.col("V"), F.col("PTU"), F.col("Q"), F.col("R"))).otherwise(F.col("E")))
