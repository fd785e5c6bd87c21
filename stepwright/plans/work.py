"""Queries over what comes in and what is to be done next: problems, recovery, judge and critic results, caches, retries.

Columns that the tables lack are arithmetic on ones that they have, the same in both languages.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import merge, queues
from ..operators import steps as st
from .analysis import r
from .tables import ATTEMPTS_SQL, STEPS_SQL, attempts, rounded, steps, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        ORACLE_SQL[name] = sql
        return f

    return register


@query("problem_rows", "SELECT doc_id::VARCHAR AS id, 'corpus' AS dataset, trim(split_part(text, ' ', 1), E' \\n\\t') AS problem, n_chars::VARCHAR AS gold_answer, '' AS reference_solution, coalesce(nullif(lang, ''), 'unknown') AS subject, CASE WHEN n_chars % 3 = 0 THEN 'unknown' ELSE (n_chars % 5)::VARCHAR END AS level FROM documents")
def problem_rows(spark, d):
    n = F.col("n_chars")
    rows = table(spark, d, "documents").select("doc_id", F.split_part("text", F.lit(" "), F.lit(1)).alias("q"), n.alias("a"), "lang", F.when(n % 3 > 0, (n % 5).cast("string")).otherwise("  ").alias("l"))
    return queues.map_problems(rows, {"id": "doc_id", "problem": "q", "gold_answer": "a", "subject": "lang", "level": "l"}, "corpus")


@query("eligible_problems", "SELECT doc_id FROM documents WHERE n_chars % 7 > 0 AND n_chars % 5 > 0 AND n_chars % 3 > 0 AND n_chars % 11 > 0")
def eligible_problems(spark, d):
    n = F.col("n_chars")
    rows = table(spark, d, "documents").select("doc_id", F.when(n % 7 == 0, "bad").alias("error"), (n % 5 == 0).alias("is_multiple_answer"), F.when(n % 3 == 0, " ").otherwise("q").alias("question"), F.when(n % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit(" 7 "), F.lit(""))).alias("answers"))
    return queues.eligible_problems(rows).select("doc_id")


_REASONS = "list_sort(list_filter([CASE WHEN NOT answered THEN 'answer_step_missing' END, CASE WHEN stop_reason <> 'explicit_final_answer' THEN stop_reason END, CASE WHEN blank THEN 'empty_final_answer' END, CASE WHEN NOT finished THEN 'not_finished' END, CASE WHEN late THEN 'timed_out' END], lambda x: x IS NOT NULL))"


@query("recovery_selection", f"""WITH {ATTEMPTS_SQL}, t AS (SELECT problem_id, stop_reason, valid AS finished, tokens % 13 = 0 AS late, tokens % 17 = 0 AS blank, tokens % 7 > 0 AS answered FROM a), k AS (SELECT *, {_REASONS} AS why FROM t)
 SELECT problem_id, array_to_string(why, '|') AS validation_reasons, problem_id % 4 AS attempts FROM k WHERE len(why) > 0 AND stop_reason <> 'format_error_limit' AND problem_id % 4 < 3 AND NOT (problem_id % 4 > 0 AND problem_id % 3 = 0)""")
def recovery_selection(spark, d):
    n = F.col("tokens")
    a = attempts(spark, d).withColumns({"finished": F.col("valid"), "timed_out": n % 13 == 0, "final_answer": F.when(n % 17 == 0, " ").otherwise("7"), "steps": F.array(F.struct(F.when(n % 7 > 0, "answer").otherwise("code").alias("action_type")))})
    chosen = queues.recovery_selection(a, ["problem_id"], skip_protocol=True).select("problem_id", "validation_reasons")
    tries = a.select("problem_id", F.explode(F.sequence(F.lit(1), (F.col("problem_id") % 4).cast("int"))).alias("i")).filter((F.col("problem_id") % 4 > 0) & (F.col("i") > 0))
    log = tries.select("problem_id", F.when((F.col("problem_id") % 3 == 0) & (F.col("i") == 1), F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("validation_reasons"))
    return queues.pending_attempts(chosen, log, ["problem_id"]).select("problem_id", "validation_reasons", F.col("attempts").cast("long").alias("attempts"))


@query("correctness_queue", f"WITH {ATTEMPTS_SQL} SELECT problem_id, 'correctness|' || problem_id AS task_id, sha256('judge ' || problem_id || ' ' || tokens) AS prompt_hash FROM a WHERE valid AND needs_judge AND NOT (tokens % 2 = 0)")
def correctness_queue(spark, d):
    prompt = F.concat_ws(" ", F.lit("judge"), F.col("problem_id").cast("string"), F.col("tokens").cast("string"))
    a = attempts(spark, d)
    tasks = queues.correctness_queue(a, ["problem_id"], prompt)
    cache = a.select(F.concat_ws("|", F.lit("correctness"), "problem_id").alias("task_id"), F.sha2(prompt, 256).alias("prompt_hash"), F.when(F.col("tokens") % 2 == 0, "success").otherwise("error").alias("status"), F.lit("m").alias("judge_model"))
    return queues.uncached(tasks, cache, "m").select("problem_id", "task_id", "prompt_hash")


@query("judged_outcomes", f"""WITH {ATTEMPTS_SQL}, b AS (SELECT problem_id, C, G, CASE WHEN tokens % 3 = 0 THEN (tokens % 2 = 0)::INT END AS d, (tokens % 10) / 10.0::DOUBLE AS conf FROM a WHERE C IS NOT NULL AND G IS NOT NULL)
 SELECT problem_id, coalesce(d, C)::INT AS "C_final", (coalesce(d, C) * G)::INT AS "V", CASE WHEN d IS NOT NULL AND G = 1 THEN CASE WHEN d = 1 THEN 'G3' ELSE 'G2' END ELSE 'G1' END AS "G_level", CASE WHEN d IS NULL THEN 'symbolic' ELSE 'judge_fallback' END AS correctness_source, d IS NOT NULL AND d <> C AS changed, CASE WHEN d IS NOT NULL THEN conf < 0.7 END AS low_confidence FROM b""")
def judged_outcomes(spark, d):
    n = F.col("tokens")
    a = attempts(spark, d).filter("C is not null and G is not null")
    m = a.select("problem_id", F.col("C").cast("int").alias("C_final"), F.col("G").cast("int").alias("G"), (F.col("C") * F.col("G")).cast("int").alias("V"), F.lit("G1").alias("G_level"), F.lit("symbolic").alias("correctness_source"))
    said = a.select("problem_id", F.when(n % 3 == 0, "success").otherwise("error").alias("status"), (n % 2 == 0).alias("correct"), ((n % 10) / 10.0).alias("confidence"))
    return st.apply_judge(m, said, ["problem_id"]).drop("G")


_CLASS = "CASE WHEN error_flag > 0 OR {0} <= -0.2 THEN 'regressive' WHEN harmful_repeat > 0 THEN 'redundant' WHEN {0} >= 0.2 THEN 'progressive' WHEN useful_verification THEN 'neutral_useful' ELSE 'neutral_waste' END"


@query("criticized_steps", f"""WITH {STEPS_SQL}, n AS (SELECT *, base + 0.25::DOUBLE * critic_signal AS before, CASE WHEN output_tokens % 3 = 0 THEN [1.0, 0.25, 0.0, -0.5, -1.0][output_tokens % 5 + 1]::DOUBLE END AS said FROM s2), m AS (SELECT *, base + 0.25::DOUBLE * coalesce(said, critic_signal) AS after FROM n)
 SELECT conv_id, turn, {r('after')} AS hybrid_score, {_CLASS.format('after')} AS label, said IS NOT NULL AS critic_used, {_CLASS.format('after')} <> {_CLASS.format('before')} AS changed FROM m""")
def criticized_steps(spark, d):
    n = F.col("output_tokens")
    s = st.label_steps(steps(spark, d)).withColumn("critic_used", F.lit(False))
    said = s.select("conv_id", "turn", F.when(n % 3 == 0, "success").otherwise("error").alias("status"), F.get(F.array(*map(F.lit, st.CLASS_VALUE)), (n % 5).cast("int")).alias("label"))
    return st.apply_critic(s, said, ["conv_id", "turn"]).select("conv_id", "turn", "hybrid_score", "label", "critic_used", "changed")


@query("disjoint_batches", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS batch FROM (SELECT DISTINCT doc_id FROM documents)")
def disjoint_batches(spark, d):
    ids = table(spark, d, "documents").select("doc_id").distinct()
    part = lambda k, name: ids.filter(F.col("doc_id") % 2 == k).withColumn("batch", F.lit(name))
    return merge.disjoint_union(part(0, "even"), part(1, "odd"), "doc_id")


_ERROR = "CASE event_id % 6 WHEN 0 THEN 'HTTP 429' WHEN 1 THEN 'Rate Limit reached' WHEN 2 THEN 'bad request 400' WHEN 3 THEN 'connection reset' WHEN 4 THEN NULL ELSE 'value error' END"


@query("retry_plan", f"""WITH e AS (SELECT event_id, {_ERROR} AS error, CASE event_id % 4 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 500 ELSE 408 END AS status, (event_id % 5)::INT AS attempt, CASE WHEN event_id % 9 = 0 THEN 7.5::DOUBLE END AS after, event_id % 2 = 1 AS spent, (event_id % 100)::DOUBLE AS remaining FROM events)
 SELECT event_id, coalesce(event_id % 6 IN (0, 1, 3), false) AS transient, {r('greatest(0, least(CASE WHEN after IS NOT NULL THEN after WHEN status = 429 THEN 60 WHEN status = 503 AND spent THEN 20 ELSE 2 * pow(2, attempt) END, 70, remaining - 1))')} AS pause FROM e""")
def retry_plan(spark, d):
    i = F.col("event_id")
    status = F.when(i % 4 == 0, 429).when(i % 4 == 1, 503).when(i % 4 == 2, 500).otherwise(408)
    pause = tx.backoff_seconds(status, (i % 5).cast("int"), F.when(i % 9 == 0, 7.5), i % 2 == 1, (i % 100).cast("double"))
    return table(spark, d, "events").select("event_id", tx.is_transient(F.expr(_ERROR)).alias("transient"), pause.alias("pause"))


@query("evidence_hashes", "SELECT conv_id, turn, substr(sha256('print(' || turn || ')' || chr(10) || coalesce(text, '')), 1, 16) AS evidence FROM conversations")
def evidence_hashes(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.evidence_hash(F.concat(F.lit("print("), F.col("turn").cast("string"), F.lit(")")), F.col("text")).alias("evidence"))


@query("archive_times", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS created FROM events")
def archive_times(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    iso = F.when(i % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(i % 3 == 1, "not a time")
    name = F.when(i % 3 == 1, F.concat(F.lit("run_"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"), F.lit(".zip"))).otherwise("run.zip")
    return e.select("event_id", F.date_format(tx.created_at(iso, name), "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("unscored_steps", f"WITH {STEPS_SQL} SELECT conv_id, turn FROM s WHERE NOT (output_tokens % 3 = 0 AND hidden_tokens > 0)")
def unscored_steps(spark, d):
    s = steps(spark, d)
    scores = s.filter(F.col("output_tokens") % 3 == 0).select("conv_id", "turn", F.when(F.col("hidden_tokens") == 0, "failed").alias("error"))
    return queues.unscored(s.select("conv_id", "turn"), scores, ["conv_id", "turn"])
