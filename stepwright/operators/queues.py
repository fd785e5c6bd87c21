"""What is to be done next: eligible problems, recovery, evaluation, caches; and the assembled metric row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.semantics import keyed, total
from ..functions.text import first_answer, strip, validation_reasons
from .steps import CRITIC_BOUNDARY
from .summary import INFRASTRUCTURE, PROTOCOL

MAX_ATTEMPTS = 3


def map_problems(rows: DataFrame, columns: dict[str, str], dataset: str) -> DataFrame:
    """Source rows as problems: columns by the given names, trimmed; subject and level 'unknown' where blank."""
    known = lambda c: F.col(columns[c]).cast("string") if c in columns else F.lit(None).cast("string")
    default = lambda c: F.coalesce(F.nullif(strip(known(c)), F.lit("")), F.lit("unknown"))
    plain = lambda c: strip(known(c))
    return rows.select(plain("id").alias("id"), F.lit(dataset).alias("dataset"), plain("problem").alias("problem"), plain("gold_answer").alias("gold_answer"), plain("reference_solution").alias("reference_solution"), default("subject").alias("subject"), default("level").alias("level"))


def eligible_problems(rows: DataFrame, answers: str = "answers", question: str = "question", error: str = "error", multiple: str = "is_multiple_answer") -> DataFrame:
    """Rows without an error, with one answer, and with a question and an answer that are not blank."""
    none = lambda c: F.coalesce(strip(F.col(c).cast("string")), F.lit("")) == ""
    return rows.filter(none(error) & ~F.coalesce(F.col(multiple), F.lit(False)) & ~none(question) & (first_answer(F.col(answers)) != ""))


def recovery_selection(trajectories: DataFrame, keys: list[str], skip_protocol: bool = False) -> DataFrame:
    """Attempts that cannot be published, with their reasons joined by '|', in key order."""
    reasons = validation_reasons(*[F.col(c) for c in ("finished", "timed_out", "stop_reason", "final_answer", "steps")])
    d = trajectories.withColumn("_r", reasons).filter(F.size("_r") > 0)
    if skip_protocol:
        d = d.filter(~F.coalesce(F.col("stop_reason").isin(*PROTOCOL), F.lit(False)))
    return d.withColumn("validation_reasons", F.array_join("_r", "|")).drop("_r").orderBy(*keys)


def pending_attempts(selected: DataFrame, log: DataFrame, keys: list[str], most: int = MAX_ATTEMPTS) -> DataFrame:
    """Selected keys without an accepted attempt and with fewer than ``most`` attempts in the log; ``attempts`` so far."""
    g = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("attempts"), F.max(F.size("validation_reasons") == 0).alias("_ok"))
    j = selected.join(g, keys, "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    return j.filter(~F.coalesce("_ok", F.lit(False)) & (F.col("attempts") < most)).drop("_ok")


def correctness_queue(metrics: DataFrame, keys: list[str], prompt: Column) -> DataFrame:
    """Valid attempts that need a judge: task_id and sha256 of the prompt."""
    d = metrics.filter(F.coalesce("valid", F.lit(False)) & F.coalesce("needs_judge", F.lit(False)))
    return d.select(*keys, F.concat_ws("|", F.lit("correctness"), *keys).alias("task_id"), F.sha2(prompt, 256).alias("prompt_hash"))


def critic_queue(steps: DataFrame, keys: list[str], prompt: Column) -> DataFrame:
    """Steps of valid attempts without a critic whose last call failed, or whose base score is near 0 and that are no answer."""
    near = (F.abs("base") < CRITIC_BOUNDARY) & (F.col("action_type") != "answer")
    d = steps.filter(F.coalesce("valid", F.lit(False)) & ~F.coalesce("critic_used", F.lit(False)) & (near | (F.coalesce("critic_error", F.lit("")) != "")))
    return d.select(*keys, F.concat_ws("|", F.lit("critic"), *keys).alias("task_id"), F.sha2(prompt, 256).alias("prompt_hash"))


def uncached(tasks: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Tasks without a successful result for the same prompt and model."""
    fit = cache.filter((F.col("status") == "success") & (F.col("judge_model") == model)).select("task_id", "prompt_hash").distinct()
    return tasks.join(fit, ["task_id", "prompt_hash"], "left_anti")


def unscored(wanted: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Keys without a score that has no error."""
    done = scores.filter(F.coalesce("error", F.lit("")) == "").select(*keys).distinct()
    return wanted.join(done, keys, "left_anti")


def unresolved(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts that ended in infrastructure or protocol failures, with the class."""
    kind = F.when(F.col("stop_reason").isin(*INFRASTRUCTURE), "infrastructure").when(F.col("stop_reason").isin(*PROTOCOL), "protocol")
    return attempts.select(*keys, "stop_reason", kind.alias("failure")).filter("failure is not null")


def source_summary(records: DataFrame, archive: str, key: str) -> DataFrame:
    """Per archive: records, distinct problems, and how attempts ended."""
    stop = F.col("stop_reason")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return records.groupBy(archive).agg(F.count(F.lit(1)).alias("records"), F.count_distinct(key).alias("problems"), count(stop == "explicit_final_answer").alias("answers"), count(stop.isin(*INFRASTRUCTURE)).alias("infrastructure"), count(stop.isin(*PROTOCOL)).alias("protocol"))


def token_composition(tokens: DataFrame, by: str = "agent") -> DataFrame:
    """Mean useful, early, late and reporting tokens, and their shares of all."""
    parts = ["t_useful", "t_pre_waste", "t_post_waste", "t_answer"]
    g = keyed(tokens, by).groupBy(by).agg(*[F.avg(p).alias(p) for p in parts], *[total(F.col(p)).alias(f"_{p}") for p in parts])
    whole = F.greatest(sum((F.col(f"_{p}") for p in parts[1:]), F.col("_t_useful")), F.lit(1))
    return g.select(by, *parts, *[(F.col(f"_{p}") / whole).alias(f"{p}_share") for p in parts])


def checked_limit(df: DataFrame, n: int) -> int:
    """n, if it is between 1 and the number of rows."""
    rows = df.count()
    if not 1 <= n <= rows:
        raise ValueError(f"limit {n} is not within 1 and {rows}")
    return n


def assemble(keys: list[str], *parts: tuple[str, DataFrame]) -> DataFrame:
    """One row per key with a struct for each part; keys that a part lacks have NULL there."""
    names = [n for n, _ in parts]
    packed = [d.select(*keys, F.struct(*[c for c in d.columns if c not in keys]).alias(n)) for n, d in parts]
    out = packed[0]
    for p in packed[1:]:
        out = out.join(p, keys, "full")
    return out.select(*keys, *names)


def first_solution(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Position of the first step that solves a correct attempt: its evidence step or its first answer, whichever is earlier; NULL if wrong."""
    w = Window.partitionBy(*keys)
    answer = F.min(F.when(F.col("action_type") == "answer", F.col("position"))).over(w)
    at = F.when(F.coalesce(F.col("correct"), F.lit(0)) == 1, F.least(F.col("evidence_step"), answer))
    return steps.withColumn("solution", at)
