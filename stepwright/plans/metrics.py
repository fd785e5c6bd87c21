"""Queries over the measures of steps and attempts, and over what tools and evaluators say.

Texts, outputs and verdicts that the test tables lack are built from their
columns, the same in both languages; the SQL computes the measures anew.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.algebra import with_equality
from ..operators import deltas, frame, summary
from ..operators import steps as st
from ..operators.order import shared_folder
from .analysis import r
from .tables import ALL_ATTEMPTS_SQL, STEPS_SQL, all_attempts, rounded, steps, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        ORACLE_SQL[name] = sql
        return f

    return register


_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(stdout), ' ', ''), '^(finalanswer|answer|result)[:=]', ''), '\.+$', ''), '\b[a-z]\b', 'VAR', 'g'), '\d+(?:\.\d+)?', 'NUM', 'g')"


@query("tool_gain", f"""WITH {STEPS_SQL}, o AS (SELECT *, CASE hidden_tokens WHEN 0 THEN '' WHEN 1 THEN 'x + y' WHEN 2 THEN 'Answer: ' || output_tokens ELSE 'done.' END AS stdout FROM s), n AS (SELECT *, {_NORMAL} AS norm FROM o)
 SELECT conv_id, turn, (action_type = 'code' AND error_flag = 0 AND norm <> '' AND row_number() OVER (PARTITION BY conv_id, norm ORDER BY turn) = 1)::INT::DOUBLE AS tool_gain FROM n""")
def tool_gain(spark, d):
    h = F.col("hidden_tokens")
    out = F.when(h == 0, "").when(h == 1, "x + y").when(h == 2, F.concat(F.lit("Answer: "), F.col("output_tokens").cast("string"))).otherwise("done.")
    s = steps(spark, d).withColumn("stdout", out).withColumn("code_success", (F.col("action_type") == "code") & (F.col("error_flag") == 0))
    return st.tool_gain(s, ["conv_id"], "turn").select("conv_id", "turn", "tool_gain")


#: Two answers made of the same numbers, and when they are equal (NULL: not decided): multiplied out, added, roots taken
#: out, decimals, powers of too many terms, tuples, sets and boxes; a sine is not decided.
_FORMS = [
    (r"(x+<a>)(x-<b>)", r"x^2+<a - b>x-<a * b>", "true"),
    (r"(x+<a>)^2", r"x^2+<2 * a>x+<b * b>", "a = b"),
    (r"\frac{<a>}{x-<b>}+\frac{<a>}{x+<b>}", r"\frac{<2 * a>x}{x^2-<b * b>}", "true"),
    (r"\sqrt{<a * a * b>}", r"<a>\sqrt{<b>}", "true"),
    (r"\sqrt{<a>}\cdot\sqrt{<b>}", r"\sqrt{<a * b>}", "true"),
    (r"\frac{<a>}{<4 * b>}", r"<a>*0.25/<b>", "true"),
    (r"(x+y+<a>)^{40}", r"(<a>+y+x)^{40}", "true"),
    (r"(x+y+<a>)^{40}", r"(x+y+<b>)^{40}", "a = b"),
    (r"(<a>,<b>)", r"(<b>,<a>)", "a = b"),
    (r"\sin(<a>x)", r"\cos(<b>x)", "NULL"),
    (r"\boxed{x=<a>*<b>}", r"<a * b>.0", "true"),
    (r"\{<a>,<b>\}", r"\{<b>,<a>\}", "true"),
]


def _written(form: str, quote, names: str = r"[ab\d *-]+") -> str:
    """SQL of a text whose <...> are numbers."""
    parts = re.split(rf"<({names})>", form)
    return "concat(" + ", ".join(quote(x) if i % 2 == 0 else f"CAST({x} AS VARCHAR(20))" for i, x in enumerate(parts)) + ")"


def _by_kind(values) -> str:
    return "CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_PARTS = "(SELECT p_partkey, p_size AS a, p_partkey % 17 + 1 AS b FROM part)"
_SAID = ", ".join(f"{_by_kind(_written(x[i], lambda t: f'{chr(39)}{t}{chr(39)}') for x in _FORMS)} AS {name}" for i, name in enumerate(("prediction", "gold")))


@query("answer_equality", f"SELECT p_partkey, {_SAID}, {_by_kind(x[2] for x in _FORMS)} AS equal FROM {_PARTS}")
def answer_equality(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey", "p_size AS a", "p_partkey % 17 + 1 AS b")
    said = lambda i: F.expr(_by_kind(_written(x[i], lambda t: f"r'{t}'") for x in _FORMS))
    return with_equality(p.select("p_partkey", said(0).alias("prediction"), said(1).alias("gold")), "prediction", "gold")


#: Turns made of a number, and what they are read as: (turn, action, content, error).
_TURNS = [
    ("Reasoning step: add\n```python\nprint(<n>)\n```", "code", "print(<n>)", ""),
    ("Reasoning step: done\n```answer\nAnswer: <n>\n```", "answer", "<n>", ""),
    ("```python\nprint(<n>)\n```\n```answer\n<n>\n```", "none", "", "multiple_actions"),
    ("```python\nprint(<n>)", "code", "print(<n>)", ""),
    ("```python\npass\n```", "none", "", "non_executable_template"),
    ("```python\nanswer <n>\n```", "none", "", "answer_text_in_code_block"),
    ("```answer\n<final answer only>\n```", "none", "", "template_placeholder"),
    ("**Final answer:**\n\n<n>", "answer", "<n>", ""),
    ("it follows that the answer is <n>\nObservation: 0", "answer", "<n>", ""),
    ("so \\boxed{<n>} and \\boxed{0}", "answer", "<n>", ""),
    ("**Answer**\n\\[<n>+1\\]", "answer", "<n>+1", ""),
    ("thus\n```latex\n<n>/2\n```", "answer", "<n>/2", ""),
    ("in all \\[ x = y\n = <n> \\] holds as was to be shown in the long text before and again after it", "answer", "<n>", ""),
    ("<n>", "answer", "<n>", ""),
    ("words only", "none", "", "no_visible_action"),
    ("reasoning about <n>", "none", "", "no_visible_action"),
]
_TURN = "CASE output_tokens % 16 " + " ".join(f"WHEN {i} THEN {{{i}}}" for i in range(16)) + " END"


def _turns(column: int, quote) -> str:
    return _TURN.format(*(_written(t[column].replace("<n>", "<position>"), quote, "position") for t in _TURNS))


@query("turn_actions", f"WITH {STEPS_SQL} SELECT conv_id, turn, " + ", ".join(f"{_turns(i, lambda t: chr(39) + t + chr(39))} AS {name}" for i, name in ((1, "action_type"), (2, "content"), (3, "parse_error"))) + " FROM s")
def turn_actions(spark, d):
    said = F.expr(_turns(0, lambda t: f"r'{t}'"))
    p = steps(spark, d).withColumn("p", tx.parse_action(said))
    return p.select("conv_id", "turn", "p.action_type", "p.content", "p.parse_error")


_STATED = [(r"\boxed{<a>/<b>}", "<a>/<b>"), (" Answer: <a>. ", "<a>"), (r"$\left( <a>, x \right)$", "(<a>,x)"), ("Final Answer = P - <b>", "p-<b>"), ("result: <a>,<b>..", "<a>,<b>")]


def _stated(column: int, quote) -> str:
    return "CASE p_partkey % 5 " + " ".join(f"WHEN {i} THEN {_written(x[column], quote)}" for i, x in enumerate(_STATED)) + " END"


@query("normal_answers", f"SELECT p_partkey, {_stated(1, lambda t: chr(39) + t + chr(39))} AS norm FROM {_PARTS}")
def normal_answers(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey", "p_size AS a", "p_partkey % 17 + 1 AS b")
    return p.select("p_partkey", tx.normalize_answer(F.expr(_stated(0, lambda t: f"r'{t}'"))).alias("norm"))


_DEEDS = "CASE output_tokens % 4 WHEN 0 THEN 'Answer: x+' || position || '+x' WHEN 1 THEN 'sum = ' || position WHEN 2 THEN '' ELSE '2*(x+' || turn || ')' END"


@query("answer_provenance", f"""WITH {STEPS_SQL}, o AS (SELECT *, {_DEEDS} AS stdout FROM s), h AS (SELECT conv_id, min(position) FILTER (output_tokens % 4 = 0) AS x0, min(position) FILTER (output_tokens % 4 = 3 AND turn > 0 AND turn % 2 = 0) AS x3 FROM o WHERE action_type = 'code' GROUP BY conv_id),
 g AS (SELECT conv_id, position, stdout, row_number() OVER (PARTITION BY conv_id ORDER BY position) AS n, count(*) OVER (PARTITION BY conv_id) AS runs, (output_tokens % 4 = 0 AND position % 4 = 2) OR (output_tokens % 4 = 3 AND turn = 1) AS hit, output_tokens % 4 = 0 AS labelled FROM o WHERE action_type = 'code'),
 k AS (SELECT conv_id, min_by(position, position) FILTER (hit AND (labelled AND position = 2 OR NOT labelled)) AS evidence_step, any_value(runs) AS runs, min(n) FILTER (hit AND (labelled AND position = 2 OR NOT labelled)) AS n FROM g GROUP BY conv_id)
 SELECT conv_id, evidence_step, CASE WHEN k.conv_id IS NULL THEN 'no_tool_evidence' WHEN evidence_step IS NULL THEN 'tool_used_not_traceable' ELSE 'symbolic_tool_output_match' END AS method, coalesce(n, runs, 0)::INT AS evidence_count FROM (SELECT DISTINCT conv_id FROM s) LEFT JOIN k USING (conv_id)""")
def answer_provenance(spark, d):
    s = steps(spark, d).withColumns({"stdout": F.expr(_DEEDS), "code_success": F.col("action_type") == "code", "step_num": F.col("position"), "gold": F.lit("2x+2")})
    return st.provenance(s, ["conv_id"], "gold").drop("candidate")


_REPEAT = "(hidden_tokens = 0 OR output_tokens % 3 = 0 OR output_tokens % 5 = 0)"


@query("redundancy_rates", f"""WITH {STEPS_SQL} SELECT conv_id, {r('avg((hidden_tokens = 0)::INT)')} AS r_exact, {r('avg((output_tokens % 3 = 0)::INT)')} AS r_semantic, {r('avg((output_tokens % 5 = 0)::INT)')} AS r_algebraic, {r('avg(useful_verification::INT)')} AS r_useful,
 {r(f'avg(({_REPEAT} AND NOT useful_verification AND tool_gain = 0)::INT)')} AS r_circular, {r(f"avg((action_type <> 'answer' AND {_REPEAT} AND NOT useful_verification AND tool_gain = 0)::INT)")} AS r_harmful FROM s GROUP BY conv_id""")
def redundancy_rates(spark, d):
    k = F.col("output_tokens")
    s = steps(spark, d).withColumns({"exact": F.col("hidden_tokens") == 0, "semantic": k % 3 == 0, "algebraic": k % 5 == 0})
    harm = st.harmful_repeat(F.col("action_type"), F.col("exact"), F.col("semantic"), F.col("algebraic"), F.col("useful_verification"), F.col("tool_gain"))
    return st.redundancy_rates(s.withColumn("harmful_repeat", harm), "conv_id")


@query("error_flags", f"WITH {STEPS_SQL} SELECT conv_id, turn, (output_tokens % 7 = 0 OR (action_type = 'code' AND hidden_tokens >= 2))::INT::DOUBLE AS error_flag FROM s")
def error_flags(spark, d):
    s = steps(spark, d)
    return s.select("conv_id", "turn", st.error_flag(F.when(F.col("output_tokens") % 7 == 0, "failed"), F.col("action_type"), F.when(F.col("hidden_tokens") < 2, True)).alias("error_flag"))


@query("attempt_outcomes", f"""WITH {ALL_ATTEMPTS_SQL}, b AS (SELECT *, CASE tokens % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS symbolic, CASE WHEN judge_used THEN (tokens % 2 = 0)::INT END AS judged, tokens % 4 AS evidence_count, CASE WHEN tokens % 4 > 0 AND tokens % 5 < 4 THEN tokens % 5 END AS evidence_step FROM a),
 c AS (SELECT *, coalesce(symbolic, judged, 0) AS c_final, CASE WHEN symbolic IS NOT NULL THEN 'symbolic' WHEN judged IS NOT NULL THEN 'judge_fallback' ELSE 'unresolved_needs_adjudication' END AS source FROM b),
 l AS (SELECT *, CASE WHEN evidence_count = 0 THEN 'G0' WHEN evidence_step IS NULL THEN 'G1' WHEN c_final = 1 THEN 'G3' ELSE 'G2' END AS level_ FROM c)
 SELECT problem_id, c_final, source, symbolic IS NULL AND judged IS NULL AS queued, level_ AS g_level, (level_ IN ('G2', 'G3'))::INT AS g, (c_final * (level_ IN ('G2', 'G3'))::INT) AS v, {r("greatest(0, least(1, c_final * (level_ IN ('G2', 'G3'))::INT * PTU * Q * (1 - R)))")} AS e FROM l""")
def attempt_outcomes(spark, d):
    n = F.col("tokens")
    symbolic, judged = F.when(n % 3 == 0, True).when(n % 3 == 1, False), F.when(F.col("judge_used"), n % 2 == 0)
    c, source, queued = st.correctness(symbolic, judged)
    level, g, v = st.grounding(c, n % 4, F.when((n % 4 > 0) & (n % 5 < 4), n % 5))
    return all_attempts(spark, d).select("problem_id", c.alias("c_final"), source.alias("source"), queued.alias("queued"), level.alias("g_level"), g.alias("g"), v.alias("v"), st.overall(v, F.col("PTU"), F.col("Q"), F.col("R")).alias("e"))


@query("latency_rollup", f"""WITH {STEPS_SQL} SELECT conv_id, {r('sum(output_tokens / 8.0)')} AS request_sec, {r('sum(prm)')} AS service_sec, {r('sum(hidden_tokens / 2.0)')} AS pace_sec, {r('sum(tool_gain)')} AS retry_wait_sec, sum(hidden_tokens)::BIGINT AS request_attempts,
 sum(greatest(0, hidden_tokens - 1))::BIGINT AS retry_count, count(*) FILTER (useful_verification) AS truncated_steps FROM s GROUP BY conv_id""")
def latency_rollup(spark, d):
    s = steps(spark, d).withColumns({"request_sec": F.col("output_tokens") / 8.0, "service_sec": F.col("prm"), "pace_sec": F.col("hidden_tokens") / 2.0, "retry_wait_sec": F.col("tool_gain"), "request_attempts": F.col("hidden_tokens"), "truncated": F.col("useful_verification")})
    return st.latency(s, "conv_id")


@query("useful_checks", f"WITH {STEPS_SQL} SELECT conv_id, turn, error_flag = 0 AND turn % 2 = 0 AND output_tokens % 5 = output_tokens % 3 AS useful FROM s")
def useful_checks(spark, d):
    k = F.col("output_tokens")
    half = lambda m: F.concat((k % m).cast("string"), F.lit("/2"))
    says = F.when(F.col("turn") % 2 == 0, "Verify the sum").otherwise("Add up")
    return steps(spark, d).select("conv_id", "turn", st.useful_verification(F.col("error_flag") == 0, says, F.lit("print(1)"), F.concat(F.lit("Answer: "), half(5)), half(3)).alias("useful"))


@query("restatements", f"WITH {STEPS_SQL} SELECT conv_id, turn, output_tokens % 4 = 2 * (hidden_tokens % 2) + 1 AS restated FROM s")
def restatements(spark, d):
    now = F.array(F.concat((F.col("output_tokens") % 4).cast("string"), F.lit("/2")))
    earlier = F.array(F.lit("x"), F.concat((F.col("hidden_tokens") % 2).cast("string"), F.lit(".5")))
    return steps(spark, d).select("conv_id", "turn", st.algebraic_restatement(now, earlier).alias("restated"))


_SAID = ['{"correct": true, "confidence": 0.9, "reason": "fine"}', "At first correct: true, in the end correct = False", '{"correct": "yes"}', "no verdict"]
_RAW = "CASE turn % 4 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_SAID)) + " END"


@query("evaluator_verdicts", f"""WITH t AS (SELECT conv_id, turn, {_RAW} AS raw FROM conversations), j AS (SELECT *, TRY_CAST(nullif(regexp_extract(raw, '\\{{.*\\}}'), '') AS JSON) AS j FROM t), v AS (SELECT *, coalesce(json_type(j, '$.correct') = 'BOOLEAN', false) AS valid FROM j)
 SELECT conv_id, turn, valid, CASE WHEN valid THEN (j ->> '$.correct')::BOOLEAN ELSE lower(list_extract(regexp_extract_all(raw, '(?i)correct["'']?\\s*[:=]\\s*(true|false)', 1), -1))::BOOLEAN END AS correct,
 CASE WHEN valid THEN coalesce((j ->> '$.confidence')::DOUBLE, 0) END AS confidence, CASE WHEN valid THEN left(coalesce(j ->> '$.reason', ''), 500) END AS reason FROM v""")
def evaluator_verdicts(spark, d):
    m = F.col("turn") % 4
    raw = F.when(m == 0, _SAID[0]).when(m == 1, _SAID[1]).when(m == 2, _SAID[2]).otherwise(_SAID[3])
    v = table(spark, d, "conversations").select("conv_id", "turn", raw.alias("raw")).withColumn("v", tx.verdict(tx.json_object(F.col("raw"))))
    return v.select("conv_id", "turn", F.col("v").isNotNull().alias("valid"), F.coalesce("v.correct", tx.recovered_verdict(F.col("raw"))).alias("correct"), "v.confidence", "v.reason")


_TRIM = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"
_STEP = rf"""f AS (SELECT conv_id, turn, concat_ws(chr(10), nullif({_TRIM}, ''), CASE WHEN turn % 3 = 1 THEN 'Code:' || chr(10) || 'print(1)' END, CASE WHEN turn % 3 = 1 THEN 'Observation:' || chr(10) || 'ok' END, CASE WHEN turn % 3 = 2 THEN 'Final answer: 42' END) AS body FROM conversations)"""


def _bodies(spark, d):
    m = F.col("turn") % 3
    body = tx.format_step(F.col("text"), F.when(m == 1, "print(1)"), F.lit("ok"), F.lit("42"), F.when(m == 1, "code").when(m == 2, "answer").otherwise("none"))
    return table(spark, d, "conversations").select("conv_id", "turn", body.alias("body"))


@query("rendered_steps", f"WITH {_STEP} SELECT conv_id, turn, md5(body) AS digest FROM f")
def rendered_steps(spark, d):
    return _bodies(spark, d).select("conv_id", "turn", F.md5("body").alias("digest"))


@query("prefix_digests", f"WITH {_STEP}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM f) SELECT conv_id, md5(string_agg('Step ' || i || ':' || chr(10) || body, chr(10) || chr(10) ORDER BY i)) AS digest FROM n WHERE i <= 3 GROUP BY conv_id")
def prefix_digests(spark, d):
    all_ = _bodies(spark, d).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "body"))), lambda x: x["body"]).alias("bodies"))
    return all_.select("conv_id", F.md5(tx.prefix_render(F.col("bodies"), F.lit(3))).alias("digest"))


_PARTS = f"""concat_ws(chr(10), 'Execution status: ' || CASE WHEN n % 2 = 0 THEN 'SUCCESS' ELSE 'FAILURE' END, 'Elapsed: ' || printf('%.3f', (n % 100) / 8.0::DOUBLE) || 's', CASE WHEN said <> '' THEN 'STDOUT:' || chr(10) || said END, CASE WHEN n % 4 = 0 THEN 'STDERR:' || chr(10) || 'boom' END,
 CASE WHEN n % 7 = 0 THEN '{tx.TIME_LIMIT_NOTE}' END, CASE WHEN said = '' AND n % 4 <> 0 AND n % 2 = 0 THEN '{tx.NO_OUTPUT_NOTE}' END)"""


@query("observations", f"""WITH t AS (SELECT conv_id, turn, coalesce(length(text), 0) AS n, CASE WHEN turn % 5 = 0 THEN '' ELSE {_TRIM} END AS said FROM conversations), p AS (SELECT conv_id, turn, {_PARTS} AS p FROM t)
 SELECT conv_id, turn, length(p) > 200 AS cut, md5(CASE WHEN length(p) > 200 THEN left(p, 60) || chr(10) || '...[observation truncated]...' || chr(10) || right(p, 60) ELSE p END) AS digest FROM p""")
def observations(spark, d):
    n = F.coalesce(F.length("text"), F.lit(0))
    parts = lambda limit: tx.observation_text(n % 2 == 0, (n % 100) / 8.0, F.when(F.col("turn") % 5 == 0, "").otherwise(F.col("text")), F.when(n % 4 == 0, "boom"), n % 7 == 0, limit)
    return table(spark, d, "conversations").select("conv_id", "turn", (F.length(parts(1 << 30)) > 200).alias("cut"), F.md5(parts(200)).alias("digest"))


def _nested(spark, d):
    """Attempts as metric rows: their measures in structs, some of them absent."""
    s = lambda **c: F.struct(*[x.alias(k) for k, x in c.items()])
    a, f = all_attempts(spark, d), F.col
    return a.select(
        "agent", "problem_id", "dataset", f("level").cast("string").alias("subject"), f("valid").alias("finished"), "stop_reason", f("valid").alias("valid_trajectory"), f("E").alias("E_optional"), f("latency").alias("elapsed_sec"),
        s(C_final=f("C"), G=f("G"), V=f("V"), judge_used=f("judge_used"), needs_judge=f("needs_judge")).alias("C_G_V"), s(Q_step=f("Q")).alias("Q"), s(PTU=f("PTU"), T_billable=f("tokens"), T_hidden_reasoning=f("hidden"), T_api_output=f("api_output")).alias("T"),
        s(R_harmful=f("R")).alias("R"), s(L_trajectory_sec=F.when(f("tokens") % 2 == 0, f("latency")), retry_count=f("retry_count")).alias("L"),
    )


@query("analysis_frame", f"""WITH {ALL_ATTEMPTS_SQL} SELECT agent, problem_id, dataset, level::VARCHAR AS subject, valid AS finished, stop_reason, C::INT AS "C", G::INT AS "G", V::INT AS "V", NULL::VARCHAR AS "G_level", NULL::VARCHAR AS correctness_source, judge_used, needs_judge, {r('Q')} AS "Q", {r('PTU')} AS "PTU", tokens::BIGINT AS billable,
 {', '.join(f'NULL::BIGINT AS {c}' for c in ('useful', 'pre_waste', 'post_waste', 'answer_reporting'))}, hidden::BIGINT AS hidden, NULL::INT AS solution_step, {r('R')} AS "R_harmful", NULL::DOUBLE AS "R_useful", NULL::DOUBLE AS "R_semantic", CASE WHEN tokens % 2 = 0 THEN {r('latency')} END AS latency,
 {', '.join(f'NULL::DOUBLE AS {c}' for c in ('service', 'pace', 'retry_wait'))}, retry_count::BIGINT AS retry_count, stop_reason IN ('api_error', 'worker_exception', 'trajectory_timeout') AS infrastructure_failure, valid AS completed, CASE WHEN problem_id % 3 > 0 THEN (level + 1)::VARCHAR ELSE 'unknown' END AS level FROM a""")
def analysis_frame(spark, d):
    t = all_attempts(spark, d).filter("problem_id % 3 > 0").groupBy(F.col("agent").alias("agent_name"), "problem_id").agg((F.max("level") + 1).alias("level"))
    return frame.canonical(_nested(spark, d), t)


_TRACE = "CASE WHEN valid AND eligible THEN {} END"


@query("metric_rows", f"""WITH {ALL_ATTEMPTS_SQL} SELECT agent, problem_id, dataset, level::VARCHAR AS subject, 'run' AS source, valid AS valid_trajectory, stop_reason, valid AS finished, C::DOUBLE AS "C_final", G::DOUBLE AS "G", V::DOUBLE AS "V",
 {', '.join(f'CASE WHEN valid THEN coalesce({k}, 0) ELSE 0 END::DOUBLE AS "{k}_operational_row"' for k in 'CGV')}, {', '.join(f'{r(_TRACE.format(c))} AS "{n}"' for c, n in (('Q', 'Q'), ('PTU', 'PTU'), ('R', 'R_harmful'), ('E', 'E_optional_row')))},
 tokens::DOUBLE AS "T_billable", 0.0::DOUBLE AS "T_api_input", api_output::DOUBLE AS "T_api_output", hidden::DOUBLE AS "T_hidden_reasoning", {', '.join(f'0.0::DOUBLE AS "T_{c}"' for c in ('useful', 'pre_waste', 'post_waste', 'answer_reporting'))},
 {r('latency')} AS latency_sec, eligible AS trace_metric_eligible, CASE WHEN eligible THEN '' ELSE 'not mapped' END AS trace_exclusion_reason, NULL::VARCHAR AS correctness_source, NULL::VARCHAR AS "G_level" FROM a""")
def metric_rows(spark, d):
    who = spark.createDataFrame([("src3", False, "not mapped"), ("src7", False, "not mapped"), ("src1", True, None)], "agent string, eligible boolean, reason string")
    return frame.metric_rows(_nested(spark, d), who, "run")


_CLASS = "CASE label WHEN 'progressive' THEN 1.0 WHEN 'neutral_useful' THEN 0.5 WHEN 'neutral_waste' THEN 0.0 WHEN 'redundant' THEN -0.5 ELSE -1.0 END::DOUBLE"
_VISIBLE = "greatest(0, output_tokens - hidden_tokens)"


_LABELS = "progressive neutral_useful neutral_waste redundant regressive".split()


@query("delta_summary", f"""WITH {STEPS_SQL}, n AS (SELECT *, base + 0.25::DOUBLE * CASE WHEN conv_id % 4 = 0 AND turn = 1 THEN [1.0, 0.25, 0.0, -0.5, -1.0][conv_id % 5 + 1]::DOUBLE ELSE critic_signal END AS score FROM s2),
 l AS (SELECT *, CASE WHEN error_flag > 0 OR score <= -0.2 THEN 'regressive' WHEN harmful_repeat > 0 THEN 'redundant' WHEN score >= 0.2 THEN 'progressive' WHEN useful_verification THEN 'neutral_useful' ELSE 'neutral_waste' END AS label FROM n),
 k AS (SELECT conv_id, greatest(0, least(1, (avg({_CLASS}) + 1) / 2)) AS q, coalesce(sum({_VISIBLE}) FILTER (action_type <> 'answer' AND label IN ('progressive', 'neutral_useful')), 0)::DOUBLE / greatest(coalesce(sum({_VISIBLE}) FILTER (action_type <> 'answer'), 0), 1) AS ptu FROM l GROUP BY conv_id),
 m AS (SELECT conv_id, conv_id % 5 AS agent, q, ptu, CASE WHEN conv_id % 6 = 0 THEN 1 ELSE conv_id % 2 END AS c, (conv_id % 3 > 0)::INT AS g, conv_id % 8 <> 5 AS valid FROM k)
 SELECT agent, count(*) AS n, {r('avg(c)')} AS "C_final", {r('avg(c * g)')} AS "V", {r('avg(q)')} AS "Q", {r('avg(ptu)')} AS "PTU", {r('avg(CASE WHEN valid THEN greatest(0, least(1, c * g * ptu * q * 0.75::DOUBLE)) ELSE 0 END)')} AS "E" FROM m GROUP BY agent""")
def delta_summary(spark, d):
    i, folder = F.col("conv_id"), shared_folder(spark, "steps")
    s = st.label_steps(steps(spark, d)).withColumns({"solution": F.lit(None).cast("int"), "critic_used": F.lit(False)})
    deltas.store_by_key(s, ["conv_id"], folder, 16)
    q, t = st.quality(s, "conv_id").select("conv_id", F.col("q_step").alias("Q")), st.token_utility(s, "conv_id").select("conv_id", F.col("ptu").alias("PTU"))
    m = q.join(t, "conv_id").withColumns({"agent": i % 5, "C_final": (i % 2).cast("int"), "G": (i % 3 > 0).cast("int"), "G_level": F.lit("G2"), "correctness_source": F.lit("symbolic"), "R": F.lit(0.25), "valid": i % 8 != 5})
    m = m.withColumn("V", F.col("C_final") * F.col("G")).withColumn("E", F.when(F.col("valid"), st.overall(F.col("V"), F.col("PTU"), F.col("Q"), F.col("R"))).otherwise(0.0))
    judged = m.select("conv_id", F.when(i % 6 == 0, "success").otherwise("error").alias("status"), F.lit(True).alias("correct"), F.lit(0.9).alias("confidence"))
    critic = s.filter((i % 4 == 0) & (F.col("turn") == 1)).select("conv_id", "turn", F.lit("success").alias("status"), F.element_at(F.array(*map(F.lit, _LABELS)), (i % 5 + 1).cast("int")).alias("label"))
    touched = deltas.touched_keys(judged, critic, ["conv_id"])
    changed = deltas.changes(m.join(touched, "conv_id", "left_semi"), deltas.read_touched(spark, folder, touched, ["conv_id"], 16), judged, critic, ["conv_id"], "turn", "agent")
    return deltas.means(deltas.add_changes(deltas.summary_sums(m, "agent"), changed, "agent"), "agent")


@query("touched_recompute", f"""WITH {STEPS_SQL}, k AS (SELECT conv_id, (avg({_CLASS}) + 1) / 2 AS q, coalesce(sum({_VISIBLE}) FILTER (action_type <> 'answer' AND label IN ('progressive', 'neutral_useful')), 0)::DOUBLE / greatest(coalesce(sum({_VISIBLE}) FILTER (action_type <> 'answer'), 0), 1) AS ptu FROM s GROUP BY conv_id),
 m AS (SELECT conv_id, conv_id % 2 AS v, conv_id % 3 > 0 AS valid, CASE WHEN conv_id % 4 = 0 THEN greatest(0, least(1, q)) ELSE 0.5 END AS q, ptu FROM k)
 SELECT conv_id, v AS "V", valid, 0.25::DOUBLE AS "R", {r('q')} AS "Q", {r('ptu')} AS "PTU", CASE WHEN valid THEN {r('greatest(0, least(1, v * ptu * q * 0.75::DOUBLE))')} ELSE 0 END::DOUBLE AS "E" FROM m""")
def touched_recompute(spark, d):
    s = steps(spark, d)
    base = F.round(st.base_score(st.prm_signal(F.col("prm_delta")), F.col("tool_gain"), F.col("harmful_repeat"), F.col("error_flag")) + st.W_CRITIC * F.col("critic_signal"), 9)
    s = s.withColumn("label", st.step_label(base, F.col("error_flag"), F.col("harmful_repeat"), F.col("useful_verification"))).withColumn("solution", F.lit(None).cast("int"))
    m = s.select("conv_id").distinct().withColumns({"V": F.col("conv_id") % 2, "valid": F.col("conv_id") % 3 > 0, "Q": F.lit(0.5), "PTU": F.lit(0.0), "R": F.lit(0.25), "E": F.lit(0.0)})
    return frame.recompute(m, s, m.filter("conv_id % 4 = 0"), ["conv_id"])


@query("adjudication_sources", f"""WITH {ALL_ATTEMPTS_SQL}, b AS (SELECT agent, CASE WHEN tokens % 3 < 2 THEN 'symbolic' WHEN judge_used THEN 'judge_fallback' WHEN tokens % 7 > 0 THEN 'unresolved_needs_adjudication' END AS s FROM a), k AS (SELECT agent, s, count(*) AS n FROM b WHERE s IS NOT NULL AND agent IS NOT NULL GROUP BY ALL)
 SELECT agent, s AS correctness_source, n, {r('n::DOUBLE / sum(n) OVER (PARTITION BY agent)')} AS share FROM k""")
def adjudication_sources(spark, d):
    n = F.col("tokens")
    return summary.adjudication_sources(all_attempts(spark, d).withColumn("correctness_source", F.when(n % 3 < 2, "symbolic").when(F.col("judge_used"), "judge_fallback").when(n % 7 > 0, "unresolved_needs_adjudication")))


@query("solution_waste", f"""WITH {STEPS_SQL}, t AS (SELECT conv_id, max(position) AS n, coalesce(sum({_VISIBLE}) FILTER (action_type <> 'answer' AND position > conv_id % 3 + 1 AND conv_id % 2 = 1), 0)::DOUBLE AS w FROM s GROUP BY conv_id)
 SELECT conv_id % 6 AS agent, {r('avg((conv_id % 2 = 1)::INT)')} AS detection_rate, {r('avg((conv_id % 2 = 1 AND conv_id % 3 + 1 = n)::INT)')} AS terminal_rate, {r('avg(w)')} AS mean_post_waste, {r('quantile_cont(w, 0.5)')} AS median_post_waste FROM t GROUP BY 1""")
def solution_waste(spark, d):
    i = F.col("conv_id")
    s = steps(spark, d).withColumn("label", F.lit("")).withColumn("solution", F.when(i % 2 == 1, i % 3 + 1))
    x = s.groupBy("conv_id").agg(F.max("solution").alias("solution"), F.max("position").alias("total_steps")).join(st.token_utility(s, "conv_id").select("conv_id", F.col("t_post_waste").alias("post_waste")), "conv_id")
    return summary.solution_table(x.withColumn("agent", i % 6))


@query("critic_audit", f"WITH {STEPS_SQL} SELECT agent, count(*) AS steps, {r('avg((hidden_tokens = 1)::INT)')} AS critic_rate, {r('avg(prm_delta)')} AS mean_prm_delta, {r('avg(base + 0.25::DOUBLE * critic_signal)')} AS mean_hybrid_score FROM s WHERE agent <> 'system' GROUP BY agent")
def critic_audit(spark, d):
    s = summary.trace_agents(st.label_steps(steps(spark, d)), ["system"])
    return summary.critic_audit(s.withColumn("critic_used", F.col("hidden_tokens") == 1))


_AT = (0.7, 0.75, 0.8, 0.85, 0.9, 0.95)


@query("redundancy_sensitivity", f"""WITH {STEPS_SQL}, t AS (SELECT *, (output_tokens % 101) / 100.0::DOUBLE AS top, unnest({list(_AT)}::DOUBLE[]) AS threshold FROM s)
 SELECT agent, threshold, {r("avg((action_type <> 'answer' AND (hidden_tokens = 0 OR top >= threshold OR output_tokens % 5 = 0) AND NOT useful_verification AND tool_gain = 0)::INT)")} AS harmful_redundancy, {r('avg((top >= threshold)::INT)')} AS raw_semantic_repetition FROM t GROUP BY agent, threshold""")
def redundancy_sensitivity(spark, d):
    n = F.col("output_tokens")
    s = steps(spark, d).withColumns({"max_similarity": (n % 101) / 100.0, "exact": F.col("hidden_tokens") == 0, "algebraic": n % 5 == 0})
    return summary.redundancy_sensitivity(s, _AT)


_SAY = "CASE hidden_tokens WHEN 0 THEN concat('so {\"label\": \"', CASE output_tokens % 3 WHEN 0 THEN 'progressive' WHEN 1 THEN 'redundant' ELSE 'good' END, '\", \"confidence\": 0.', CAST(position AS VARCHAR(9)), '}') WHEN 1 THEN 'label: Regressive' WHEN 2 THEN '{\"label\": \"neutral_waste\", \"reason\": \"r\"}' ELSE 'none' END"


@query("label_verdicts", f"""WITH {STEPS_SQL}, v AS (SELECT conv_id, turn, CASE hidden_tokens WHEN 0 THEN CASE output_tokens % 3 WHEN 0 THEN 'progressive' WHEN 1 THEN 'redundant' END WHEN 2 THEN 'neutral_waste' END AS label, hidden_tokens AS h, position FROM s)
 SELECT conv_id, turn, label, {r("CASE WHEN label IS NULL THEN NULL WHEN h = 0 THEN ('0.' || position)::DOUBLE ELSE 0 END")} AS confidence, CASE WHEN label IS NULL THEN NULL WHEN h = 2 THEN 'r' ELSE '' END AS reason, coalesce(label, CASE h WHEN 1 THEN 'regressive' END) AS recovered FROM v""")
def label_verdicts(spark, d):
    s = steps(spark, d).withColumn("said", F.expr(_SAY)).withColumn("v", tx.label_verdict(tx.json_object(F.col("said")), tuple(_LABELS)))
    return s.select("conv_id", "turn", "v.label", "v.confidence", "v.reason", F.coalesce("v.label", tx.recovered_label(F.col("said"))).alias("recovered"))


@query("prm_ensemble", f"""WITH {STEPS_SQL}, l AS (SELECT conv_id, list(prm ORDER BY turn) AS a FROM s GROUP BY conv_id), b AS (SELECT conv_id, a, CASE WHEN conv_id % 3 > 0 THEN a[1:2] ELSE [] END AS b FROM l),
 u AS (SELECT conv_id, a, b, unnest(range(len(a))) AS step FROM b) SELECT conv_id, step::INT AS step, {r('(a[step + 1] + coalesce(b[step + 1], b[len(b)], 0.5)) / 2')} AS prm FROM u""")
def prm_ensemble(spark, d):
    a = F.transform(F.array_sort(F.collect_list(F.struct("turn", "prm"))), lambda x: x["prm"])
    m = steps(spark, d).groupBy("conv_id").agg(a.alias("a"))
    scores = F.array("a", F.when(F.col("conv_id") % 3 > 0, F.slice("a", 1, 2)).otherwise(F.array().cast("array<double>")))
    return m.select("conv_id", F.posexplode(st.ensemble(scores, F.size("a"))).alias("step", "prm"))


@query("prm_sheets", f"WITH {STEPS_SQL} SELECT agent, conv_id::VARCHAR AS problem_id, {r('max(prm) FILTER (turn % 2 = 0)')} AS even, {r('max(prm) FILTER (turn % 2 = 1)')} AS odd FROM s GROUP BY agent, conv_id")
def prm_sheets(spark, d):
    of = lambda k: F.collect_list(F.when(F.col("turn") % 2 == k, F.col("prm")))
    g = steps(spark, d).groupBy("agent", "conv_id").agg(of(0).alias("e"), of(1).alias("o"))
    sheet = F.create_map("agent", F.create_map(F.col("conv_id").cast("string"), F.struct(F.create_map(F.lit("even"), F.col("e"), F.lit("odd"), F.col("o")).alias("by_model"))))
    return st.prm_long(g.select(sheet.alias("sheet"))).groupBy("agent", "problem_id").pivot("model", ["even", "odd"]).agg(F.max("score"))
