"""The entities of the library as views of the test tables, in Spark and in SQL.

Attempts stand on labels and documents, the agent-by-problem grid on events,
steps on conversations. Columns that the tables lack are arithmetic on ones
that they have, the same in both languages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STOPS = ("api_error", "format_error_limit", "trajectory_timeout", "max_steps")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All doubles to some places, for comparison across engines."""
    return df.select(*[F.round(F.col(f"`{c}`"), places).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def _attempt_columns(d: DataFrame) -> DataFrame:
    n = F.col("n_chars")
    stop = F.when(n % 10 == 0, STOPS[0]).when(n % 10 == 1, STOPS[1]).when(n % 10 == 2, STOPS[2]).when(n % 10 == 3, STOPS[3]).otherwise("explicit_final_answer")
    d = d.select(
        F.col("doc_id").alias("problem_id"), F.col("source").alias("agent"), F.col("lang").alias("dataset"), (n % 5).alias("level"), F.col("quality").alias("C"), F.col("toxic").alias("G"), (F.col("quality") * F.col("toxic")).alias("V"),
        n.alias("tokens"), (n / 1000.0).alias("latency"), ((n % 101) / 100.0).alias("Q"), ((n % 97) / 96.0).alias("PTU"), ((n % 13) / 13.0).alias("R"), stop.alias("stop_reason"),
    )
    d = d.withColumn("valid", F.col("stop_reason") == "explicit_final_answer").withColumn("eligible", ~F.col("agent").isin("src3", "src7"))
    n = F.col("tokens")
    d = d.withColumns({
        "total_steps": n % 6 + 1, "service": (n % 211) / 10.0, "pace": (n % 31) / 10.0, "retry_wait": (n % 17) / 10.0, "retry_count": n % 4, "truncated_steps": n % 3, "timed_out": F.col("stop_reason") == "trajectory_timeout",
        "judge_used": n % 8 == 0, "needs_judge": n % 9 == 0, "critic_calls": n % 5, "critic_errors": ((n % 5 > 0) & (n % 7 == 0)).cast("long"), "hidden": n % 19, "answer_reporting": n % 23, "api_output": n % 500,
    })
    return d.withColumn("E", F.col("V") * F.col("PTU") * F.col("Q") * (1 - F.col("R")))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as attempts."""
    return _attempt_columns(table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").drop("text"), "doc_id"))


def all_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as attempts; C, G, V are NULL where there is no label."""
    return _attempt_columns(table(spark, sf_dir, "documents").drop("text").join(table(spark, sf_dir, "labels"), "doc_id", "left"))


_A = """SELECT doc_id AS problem_id, source AS agent, lang AS dataset, n_chars % 5 AS level, quality AS C, toxic AS G, quality * toxic AS V,
  n_chars AS tokens, n_chars / 1000.0::DOUBLE AS latency, (n_chars % 101) / 100.0::DOUBLE AS Q, (n_chars % 97) / 96.0::DOUBLE AS PTU, (n_chars % 13) / 13.0::DOUBLE AS R,
  CASE n_chars % 10 WHEN 0 THEN 'api_error' WHEN 1 THEN 'format_error_limit' WHEN 2 THEN 'trajectory_timeout' WHEN 3 THEN 'max_steps' ELSE 'explicit_final_answer' END AS stop_reason,
  n_chars % 6 + 1 AS total_steps, (n_chars % 211) / 10.0::DOUBLE AS service, (n_chars % 31) / 10.0::DOUBLE AS pace, (n_chars % 17) / 10.0::DOUBLE AS retry_wait, n_chars % 4 AS retry_count, n_chars % 3 AS truncated_steps, n_chars % 10 = 2 AS timed_out,
  n_chars % 8 = 0 AS judge_used, n_chars % 9 = 0 AS needs_judge, n_chars % 5 AS critic_calls, (n_chars % 5 > 0 AND n_chars % 7 = 0)::BIGINT AS critic_errors, n_chars % 19 AS hidden, n_chars % 23 AS answer_reporting, n_chars % 500 AS api_output,
  n_chars % 10 > 3 AS valid, source NOT IN ('src3', 'src7') AS eligible,
  (quality * toxic) * ((n_chars % 97) / 96.0::DOUBLE) * ((n_chars % 101) / 100.0::DOUBLE) * (1 - (n_chars % 13) / 13.0::DOUBLE) AS E"""
ATTEMPTS_SQL = f"a AS ({_A} FROM labels JOIN documents USING (doc_id))"
ALL_ATTEMPTS_SQL = f"a AS ({_A} FROM documents LEFT JOIN labels USING (doc_id))"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as steps."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id")
    n = F.length("text").cast("long")
    last = F.col("turn") == F.max("turn").over(w)
    d = c.select(
        "conv_id", "turn", (F.col("turn") + 1).alias("position"), F.col("role").alias("agent"), F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("output_tokens"), F.when(last, "answer").when(F.col("role") == "user", "none").otherwise("code").alias("action_type"),
        ((n % 100) / 100.0).alias("prm"), (n % 3 == 0).cast("double").alias("tool_gain"), (n % 7 == 0).cast("double").alias("harmful_repeat"), (n % 11 == 0).cast("double").alias("error_flag"), (n % 5 == 0).alias("useful_verification"), ((n % 9 - 4) / 4.0).alias("critic_signal"),
        (n % 2).alias("C"), (n % 4).alias("hidden_tokens"), ((F.col("turn") + 1) / (F.max("turn").over(w) + 1)).alias("normalized_position"),
    )
    return d.withColumn("prm_delta", F.col("prm") - F.lag("prm", 1, 0.5).over(w.orderBy("turn")))


STEPS_SQL = r"""s0 AS (
  SELECT conv_id, turn, turn + 1 AS position, role AS agent, len(regexp_extract_all(text, '\S+'))::BIGINT AS output_tokens,
    CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN 'answer' WHEN role = 'user' THEN 'none' ELSE 'code' END AS action_type,
    (length(text) % 100) / 100.0::DOUBLE AS prm, (length(text) % 3 = 0)::INT::DOUBLE AS tool_gain, (length(text) % 7 = 0)::INT::DOUBLE AS harmful_repeat, (length(text) % 11 = 0)::INT::DOUBLE AS error_flag,
    length(text) % 5 = 0 AS useful_verification, (length(text) % 9 - 4) / 4.0::DOUBLE AS critic_signal, length(text) % 2 AS C, length(text) % 4 AS hidden_tokens,
    (turn + 1)::DOUBLE / (max(turn) OVER (PARTITION BY conv_id) + 1) AS normalized_position FROM conversations
), s1 AS (SELECT *, prm - lag(prm, 1, 0.5::DOUBLE) OVER (PARTITION BY conv_id ORDER BY turn) AS prm_delta FROM s0),
s2 AS (SELECT *, 0.45::DOUBLE * tanh(prm_delta / 0.1::DOUBLE) + 0.15::DOUBLE * tool_gain - 0.25::DOUBLE * harmful_repeat - 0.5::DOUBLE * error_flag AS base FROM s1),
s AS (SELECT *, CASE WHEN error_flag > 0 OR hybrid_score <= -0.2 THEN 'regressive' WHEN harmful_repeat > 0 THEN 'redundant' WHEN hybrid_score >= 0.2 THEN 'progressive' WHEN useful_verification THEN 'neutral_useful' ELSE 'neutral_waste' END AS label
  FROM (SELECT *, round(base + 0.25::DOUBLE * critic_signal, 9) AS hybrid_score FROM s2))"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type (agent) and user (problem): C is whether the mean value is over 50, latency the mean."""
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("agent"), F.col("user_id").alias("problem_id")).agg(F.round(F.avg("value"), 6).alias("latency"))
    return e.withColumn("C", (F.col("latency") > 50).cast("int"))


GRID_SQL = "g AS (SELECT *, (latency > 50)::INT AS C FROM (SELECT event_type AS agent, user_id AS problem_id, round(avg(value), 6) AS latency FROM events GROUP BY ALL))"
