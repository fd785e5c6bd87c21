"""Queries over attempts and grids: summaries, sensitivity, statistics, sampling."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import order, resampling, sampling, stats, summary
from ..operators import sequences as seq
from .tables import ALL_ATTEMPTS_SQL, ATTEMPTS_SQL, GRID_SQL, all_attempts, attempts, grid, rounded, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; its doubles are rounded to six places."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def r(x: str) -> str:
    return f"round(({x})::DOUBLE, 6)"


_Z = stats.Z95
_SV = "count(*) FILTER (valid AND V = 1)"
_P = f"({_SV}::DOUBLE / count(*))"
_HALF = f"sqrt({_P} * (1 - {_P}) / count(*) + {_Z * _Z} / (4.0::DOUBLE * count(*) * count(*))) * {_Z} / (1 + {_Z * _Z} / count(*))"
_CENTRE = f"({_P} + {_Z * _Z} / (2.0::DOUBLE * count(*))) / (1 + {_Z * _Z} / count(*))"
_INFRA = "stop_reason IN ('api_error', 'worker_exception', 'trajectory_timeout')"
_DONE = "stop_reason = 'explicit_final_answer'"


def each(form: str, names: str, alias: str) -> str:
    """The form for every name, rounded and named by the alias; {} is the name, {l} in lower case."""
    return ", ".join(f"{r(form.format(x, l=x.lower()))} AS \"{alias.format(x, l=x.lower())}\"" for x in names.split())


def floored(k: str) -> str:
    n = f"count(*) FILTER (valid AND {k} = 1)"
    return f"CASE WHEN {n} = 0 THEN sum(tokens)::DOUBLE / 1e-12 ELSE {r(f'sum(tokens)::DOUBLE / greatest({n}::DOUBLE, 1e-12)')} END"


@query("core_operational", f"""WITH {ATTEMPTS_SQL} SELECT agent, count(*) AS attempted, count(*) FILTER (valid) AS valid_n, {r('avg(valid::INT)')} AS coverage, {r('avg(valid::INT)')} AS format_adherence, {r(f'avg(({_INFRA})::INT)')} AS infrastructure_rate,
 {each('count(*) FILTER (valid AND {} = 1)::DOUBLE / count(*)', 'C G V', '{l}')}, {each('avg({}) FILTER (valid)', 'C G V', '{l}_valid')}, {each('avg({}) FILTER (valid AND eligible)', 'Q PTU R E', '{l}')},
 sum(tokens)::BIGINT AS tokens, {r('avg(tokens)')} AS tokens_per_attempt, {floored('C')} AS tokens_per_correct, {floored('V')} AS tokens_per_solve, {r('avg(latency)')} AS latency_mean, {r('quantile_cont(latency, 0.95)')} AS latency_p95,
 bool_and(eligible) AS eligible, CASE WHEN bool_and(eligible) THEN '' ELSE 'excluded' END AS exclusion, {r(f'greatest(0, {_CENTRE} - {_HALF})')} AS v_lo, {r(f'least(1, {_CENTRE} + {_HALF})')} AS v_hi FROM a GROUP BY agent""")
def core_operational(spark, d):
    return summary.core_table(attempts(spark, d))


@query("run_summary", f"""WITH {ATTEMPTS_SQL} SELECT agent, count(*) AS n, {each('avg({})', 'C G V Q PTU R E', '{l}')}, {r('sum(tokens)::DOUBLE / count(*)')} AS tokens_per_attempt, {r('sum(tokens)::DOUBLE / nullif(sum(V), 0)')} AS tokens_per_verified,
 {r('avg(latency)')} AS latency_mean, {r('quantile_cont(latency, 0.5)')} AS latency_median, {r('quantile_cont(latency, 0.95)')} AS latency_p95, {each('avg({})', 'service pace retry_wait total_steps', '{}_mean')}, {r('avg(valid::INT)')} AS completion_rate, {r('avg(timed_out::INT)')} AS timeout_rate,
 sum(retry_count)::BIGINT AS retry_count, sum(truncated_steps)::BIGINT AS truncated_steps, sum(critic_calls)::BIGINT AS critic_calls, sum(critic_errors)::BIGINT AS critic_errors,
 count(*) FILTER (judge_used OR needs_judge) AS symbolic_inconclusive, count(*) FILTER (judge_used) AS judge_fallbacks, count(*) FILTER (needs_judge) AS judge_queue FROM a GROUP BY agent""")
def run_summary(spark, d):
    return summary.run_summary(attempts(spark, d))


@query("repair_summary", f"""WITH {ATTEMPTS_SQL} SELECT agent, count(*) AS attempted, count(*) FILTER (valid) AS valid_n, {r('avg(valid::INT)')} AS coverage, {r("1 - count(*) FILTER (stop_reason IN ('format_error_limit', 'answer_only_violation_limit'))::DOUBLE / count(*)")} AS format_adherence, {r(f'avg(({_INFRA})::INT)')} AS infrastructure_rate,
 {each('sum({})::DOUBLE / count(*)', 'C G V', '{l}_operational')}, {each('avg({}) FILTER (valid)', 'C G V Q PTU R E', '{l}_valid')}, sum(tokens)::BIGINT AS tokens, {r('avg(tokens)')} AS tokens_per_attempt, {r('sum(tokens)::DOUBLE / nullif(sum(C), 0)')} AS tokens_per_correct, {r('sum(tokens)::DOUBLE / nullif(sum(V), 0)')} AS tokens_per_solve,
 {r('sum(latency) / nullif(sum(V), 0)')} AS seconds_per_solve, {r('avg(latency)')} AS latency_mean, count(*) FILTER (valid AND needs_judge) AS unresolved, count(*) FILTER (valid AND judge_used) AS judge_fallbacks,
 coalesce(sum(critic_calls) FILTER (valid), 0)::BIGINT AS critic_selected, coalesce(sum(critic_calls - critic_errors) FILTER (valid), 0)::BIGINT AS critic_success FROM a GROUP BY agent""")
def repair_summary(spark, d):
    return summary.repair_summary(attempts(spark, d))


@query("generation_health", f"""WITH {ATTEMPTS_SQL}, k AS (SELECT agent, stop_reason, count(*) AS n FROM a GROUP BY ALL) SELECT agent, sum(n)::BIGINT AS records, coalesce(sum(n) FILTER (stop_reason = 'explicit_final_answer'), 0)::BIGINT AS explicit_answers,
 coalesce(sum(n) FILTER (stop_reason IN ('api_error', 'worker_exception', 'trajectory_timeout')), 0)::BIGINT AS infrastructure_failures, '{{' || string_agg('"' || stop_reason || '":' || n, ',' ORDER BY stop_reason) || '}}' AS stop_reasons,
 (sum(n) - coalesce(sum(n) FILTER (stop_reason IN ('api_error', 'worker_exception', 'trajectory_timeout', 'explicit_final_answer')), 0))::BIGINT AS other_incomplete, {r("coalesce(sum(n) FILTER (stop_reason = 'explicit_final_answer'), 0)::DOUBLE / sum(n)")} AS completion_rate FROM k GROUP BY agent""")
def generation_health(spark, d):
    return summary.health(attempts(spark, d))


@query("cg_matrix", f"""WITH {ATTEMPTS_SQL} SELECT agent, correctness, grounding, n, {r('n::DOUBLE / sum(n) OVER (PARTITION BY agent)')} AS share FROM (SELECT agent, CASE WHEN C = 1 THEN 'correct' ELSE 'incorrect' END AS correctness, CASE WHEN G = 1 THEN 'grounded' ELSE 'ungrounded' END AS grounding, count(*) AS n FROM a GROUP BY ALL)""")
def cg_matrix(spark, d):
    return summary.cg_matrix(attempts(spark, d))


@query("retention_gap", f"""WITH {ATTEMPTS_SQL} SELECT agent, {r('avg(C)')} AS c, {r('avg(G)')} AS g, {r('avg(V)')} AS v, {r('avg(C) - avg(V)')} AS gap, {r('avg(V) / nullif(avg(C), 0)')} AS retention FROM a GROUP BY agent""")
def retention_gap(spark, d):
    return summary.retention(attempts(spark, d))


@query("level_distribution", f"""WITH {ATTEMPTS_SQL} SELECT agent, level, n, {r('n::DOUBLE / sum(n) OVER (PARTITION BY agent)')} AS share FROM (SELECT agent, level, count(*) AS n FROM a GROUP BY ALL)""")
def level_distribution(spark, d):
    return summary.distribution(attempts(spark, d), "level")


@query("stop_distribution", f"""WITH {ATTEMPTS_SQL} SELECT agent, stop_reason, n, {r('n::DOUBLE / sum(n) OVER (PARTITION BY agent)')} AS share FROM (SELECT agent, stop_reason, count(*) AS n FROM a GROUP BY ALL)""")
def stop_distribution(spark, d):
    return summary.distribution(attempts(spark, d), "stop_reason", keep_missing=True)


@query("breakdown", f"""WITH {ATTEMPTS_SQL} SELECT dataset, level, agent, count(*) AS n, {r('avg(C)')} AS "C_mean", {r('avg(V)')} AS "V_mean", {r('avg(Q)')} AS "Q_mean", count(C) AS "C_count", count(V) AS "V_count", count(Q) AS "Q_count" FROM a GROUP BY dataset, level, agent""")
def breakdown(spark, d):
    return summary.breakdown(attempts(spark, d), ["dataset", "level", "agent"], ["C", "V", "Q"])


@query("dataset_metrics", f"""WITH {ATTEMPTS_SQL} SELECT dataset, agent, count(*) AS n, {r('avg(C)')} AS "C_mean", {r('avg(G)')} AS "G_mean", {r('avg(V)')} AS "V_mean", {r('avg(PTU)')} AS "PTU_mean", count(C) AS "C_count", count(G) AS "G_count", count(V) AS "V_count", count(PTU) AS "PTU_count" FROM a GROUP BY dataset, agent""")
def dataset_metrics(spark, d):
    return summary.breakdown(attempts(spark, d), ["dataset", "agent"], ["C", "G", "V", "PTU"])


@query("subject_pivot", f"""WITH {ATTEMPTS_SQL} SELECT level, {', '.join(f"{r(f'avg(C) FILTER (dataset = {chr(39)}{x}{chr(39)})')} AS {x}" for x in ('de', 'en', 'es', 'fr'))} FROM a WHERE level IS NOT NULL GROUP BY level""")
def subject_pivot(spark, d):
    return summary.pivot_mean(attempts(spark, d), "level", "dataset", ["de", "en", "es", "fr"], "C")


_MISSING = ", ".join(f'count(*) FILTER ({m} IS NULL) AS "{m}_missing", count(*) FILTER ({m} = 0) AS "{m}_zero"' for m in "CGV")
_MISSING += ", " + ", ".join(f'CASE WHEN bool_and(eligible) THEN count(*) FILTER ({m} IS NULL) ELSE count(*) END AS "{m}_missing", CASE WHEN bool_and(eligible) THEN count(*) FILTER ({m} = 0) END AS "{m}_zero"' for m in ("Q", "PTU", "R"))


@query("coverage_missingness", f"""WITH {ALL_ATTEMPTS_SQL} SELECT agent, count(*) AS n, count(DISTINCT problem_id) AS problems, {r('avg(valid::INT)')} AS completion_rate, {r(f'avg(({_INFRA})::INT)')} AS infrastructure_rate, count(*) FILTER (judge_used) AS judge_fallbacks, count(*) FILTER (needs_judge) AS unresolved, bool_and(eligible) AS eligible, {_MISSING} FROM a GROUP BY agent""")
def coverage_missingness(spark, d):
    return summary.coverage(all_attempts(spark, d), ["C", "G", "V", "Q", "PTU", "R"])


@query("view_sensitivity", f"""WITH {ATTEMPTS_SQL}, v AS (SELECT 'all_attempted' AS view, * FROM a UNION ALL SELECT 'completed_only', * FROM a WHERE stop_reason = 'explicit_final_answer' UNION ALL SELECT 'infrastructure_clean', * FROM a WHERE stop_reason NOT IN ('api_error', 'worker_exception', 'trajectory_timeout'))
 SELECT view, agent, count(*) AS n, {r('avg(C)')} AS c, {r('avg(G)')} AS g, {r('avg(V)')} AS v FROM v GROUP BY view, agent""")
def view_sensitivity(spark, d):
    return summary.view_sensitivity(attempts(spark, d))


@query("latency_percentiles", f"""WITH l AS (SELECT event_type AS agent, unnest([{{'measure': 'value', 'x': value}}, {{'measure': 'half', 'x': value / 2}}], recursive := true) FROM events)
 SELECT agent, measure, {', '.join(f"{r(f'quantile_cont(x, {q})')} AS p{p}" for q, p in ((0.5, 50), (0.9, 90), (0.95, 95), (0.99, 99)))} FROM l GROUP BY agent, measure""")
def latency_percentiles(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("agent"), "value", (F.col("value") / 2).alias("half"))
    return summary.latency_percentiles(e, ["value", "half"])


@query("latency_ecdf", f"SELECT event_type, event_id, {r('value')} AS value, {r('row_number() OVER (PARTITION BY event_type ORDER BY value, event_id)::DOUBLE / count(*) OVER (PARTITION BY event_type)')} AS ecdf FROM events WHERE value IS NOT NULL")
def latency_ecdf(spark, d):
    return seq.ecdf(table(spark, d, "events").select("event_type", "event_id", "value"), ["event_type"], "value", ["event_id"])


@query("reliability", f"""WITH {ATTEMPTS_SQL} SELECT agent, {r(f'avg((NOT {_INFRA})::INT)')} AS availability, {r(f'avg(({_DONE})::INT)')} AS completion, {r(f'avg(C) FILTER ({_DONE})')} AS c_completed, {r(f'avg(V) FILTER ({_DONE})')} AS v_completed, {r('avg(C)')} AS c_all, {r('avg(V)')} AS v_all FROM a GROUP BY agent""")
def reliability(spark, d):
    return summary.reliability(attempts(spark, d))


@query("correctness_bounds", f"""WITH {ALL_ATTEMPTS_SQL} SELECT agent, count(*) AS n, count(*) FILTER (C IS NULL) AS unresolved, {r('coalesce(sum(C), 0)::DOUBLE / count(*)')} AS lower, {r('(coalesce(sum(C), 0) + count(*) FILTER (C IS NULL))::DOUBLE / count(*)')} AS upper FROM a GROUP BY agent""")
def correctness_bounds(spark, d):
    return summary.correctness_bounds(all_attempts(spark, d))


@query("repair_impact", f"""WITH {ATTEMPTS_SQL}, b AS (SELECT agent, avg(V) AS x FROM a GROUP BY agent), c AS (SELECT agent, avg(V) AS x FROM a WHERE valid GROUP BY agent) SELECT agent, {r('b.x')} AS v_before, {r('c.x')} AS v_after, {r('c.x - b.x')} AS v_delta FROM b JOIN c USING (agent)""")
def repair_impact(spark, d):
    a = attempts(spark, d)
    mean = lambda x: x.groupBy("agent").agg(F.avg("V").alias("v"))
    return summary.impact(mean(a), mean(a.filter("valid")), ["v"])


@query("redundancy_by_outcome", f"""WITH {ATTEMPTS_SQL} SELECT agent, {r('avg(R) FILTER (C = 1)')} AS "R_correct", {r('avg(R) FILTER (C IS DISTINCT FROM 1)')} AS "R_incorrect" FROM a GROUP BY agent""")
def redundancy_by_outcome(spark, d):
    return summary.by_outcome(attempts(spark, d), "R")


@query("cost_per_solve", f"""WITH {ATTEMPTS_SQL} SELECT agent, {r('sum(tokens)::DOUBLE / count(*)')} AS per_attempt, {r('sum(tokens)::DOUBLE / nullif(sum(C), 0)')} AS per_correct, {r('sum(tokens)::DOUBLE / nullif(sum(V), 0)')} AS per_verified, {r('sum(latency) / nullif(sum(C), 0)')} AS seconds_per_correct, {r('sum(latency) / nullif(sum(V), 0)')} AS seconds_per_verified,
 {r('sum(hidden)::DOUBLE / greatest(sum(api_output), 1)')} AS hidden_share, {r('sum(answer_reporting)::DOUBLE / greatest(sum(api_output), 1)')} AS reporting_share FROM a GROUP BY agent""")
def cost_per_solve(spark, d):
    return summary.cost_per_solve(attempts(spark, d))


@query("pareto_frontier", f"""WITH p AS (SELECT l_suppkey, round(avg(l_extendedprice), 6) AS cost, round(avg(l_discount), 6) AS value FROM lineitem GROUP BY l_suppkey)
 SELECT l_suppkey, cost, value FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.cost <= p.cost AND q.value >= p.value AND (q.cost < p.cost OR q.value > p.value))""")
def pareto_frontier(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_extendedprice"), 6).alias("cost"), F.round(F.avg("l_discount"), 6).alias("value"))
    return order.frontier(s, "cost", "value")


_BINOMIAL = "least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, least(left_only, right_only) + 1), lambda i: exp(lgamma(n2 + 1) - lgamma(i + 1) - lgamma(n2 - i + 1) + n2 * ln(0.5::DOUBLE)))))"


@query("paired_tests", f"""WITH {GRID_SQL}, t AS (SELECT a.agent AS left_, b.agent AS right_, count(*) AS n, count(*) FILTER (a.C = 1 AND b.C = 0) AS left_only, count(*) FILTER (a.C = 0 AND b.C = 1) AS right_only, avg(a.C - b.C) AS mean_diff FROM g a JOIN g b ON a.problem_id = b.problem_id AND a.agent < b.agent GROUP BY ALL),
 p AS (SELECT *, CASE WHEN n2 = 0 THEN 1.0::DOUBLE ELSE {_BINOMIAL} END AS p FROM (SELECT *, left_only + right_only AS n2 FROM t)),
 h AS (SELECT *, least(1.0::DOUBLE, (count(*) OVER () - row_number() OVER (ORDER BY round(p, 9), left_, right_) + 1) * p) AS raw, round(p, 9) AS p9 FROM p)
 SELECT left_ AS "left", right_ AS "right", n, left_only, right_only, {r('mean_diff')} AS mean_diff, {r('p')} AS p, {r('max(raw) OVER (ORDER BY p9, left_, right_ ROWS UNBOUNDED PRECEDING)')} AS p_holm FROM h""")
def paired_tests(spark, d):
    t = stats.paired_tests(grid(spark, d), "agent", "problem_id", "C").withColumn("family", F.lit("C")).withColumn("p9", F.round("p", 9))
    h = stats.holm(t, "p", ["family"], ["left", "right"], by="p9")
    return h.drop("family", "p9")


_NORMAL = f"(sqrt(-2 * ln((high + 0.5) / {2**32}.0::DOUBLE)) * cos({2 * math.pi!r}::DOUBLE * ((low + 0.5) / {2**32}.0::DOUBLE)))"
_WIDE = "greatest(0, floor(n + sqrt(n::DOUBLE) * z + (z * z - 1) / 6 + (z - z * z * z) / (72 * sqrt(n::DOUBLE)) + 0.5))::BIGINT"


def _drawn(histogram: str, columns: str, key: str, replicates: int) -> str:
    """Common tables: ``p`` with the thresholds of small means, ``w`` with the columns, b and the count w of each outcome and replicate."""
    word = lambda at: f"('0x' || substr(md5, (b % 2) * 16 + {at}, 8))::BIGINT"
    return f"""p AS (SELECT unnest(range({resampling.EXACT + 1})) AS n, unnest({resampling.TABLE}::BIGINT[][]) AS steps),
 u AS (SELECT *, {word(1)} AS high, {word(9)} AS low FROM (SELECT *, md5('42:' || b // 2 || ':' || {key}) AS md5 FROM (SELECT *, unnest(range({replicates})) AS b FROM {histogram}))),
 w AS (SELECT {columns}, b, CASE WHEN n <= {resampling.EXACT} THEN len(list_filter(steps, lambda t: t <= high)) ELSE {_WIDE} END AS w FROM (SELECT *, {_NORMAL} AS z FROM u) LEFT JOIN p USING (n))"""


_DRAWN = "(" + " + ".join(f"(h >= {t})::INT" for t in resampling.POISSON_STEPS) + ")"


def _hash(key: str) -> str:
    return f"('0x' || substr(md5('42:' || b || ':' || {key}), 1, 8))::BIGINT"


@query("bootstrap_ci", f"""WITH {ATTEMPTS_SQL}, v AS (SELECT agent, C::DOUBLE AS v, row_number() OVER (PARTITION BY agent ORDER BY problem_id, C) - 1 AS i, count(*) OVER (PARTITION BY agent) AS n FROM a WHERE agent IS NOT NULL AND C IS NOT NULL),
 k AS (SELECT DISTINCT agent, n FROM v), b AS (SELECT agent, n, b, unnest(range(n)) AS k FROM (SELECT *, unnest(range(5000)) AS b FROM k)),
 p AS (SELECT agent, b, {_hash('k')} % n AS i FROM b), m AS (SELECT agent, b, avg(v) AS m FROM p JOIN v USING (agent, i) GROUP BY agent, b)
 SELECT agent, {r('quantile_cont(m, 0.025)')} AS lo, {r('quantile_cont(m, 0.975)')} AS hi FROM m GROUP BY agent""")
def bootstrap_ci(spark, d):
    return resampling.bootstrap_ci(attempts(spark, d).filter("agent is not null"), ["agent"], "C", replicates=5000, order=["problem_id"])


@query("paired_bootstrap", f"""WITH {GRID_SQL}, p AS (SELECT a.agent AS left_, b.agent AS right_, problem_id, a.C - b.C AS x FROM g a JOIN g b USING (problem_id) WHERE a.agent < b.agent), d AS (SELECT left_, right_, b, x, {_hash('problem_id')} AS h FROM (SELECT *, unnest(range(5000)) AS b FROM p)),
 m AS (SELECT left_, right_, b, sum(x * {_DRAWN})::DOUBLE / nullif(sum({_DRAWN}), 0) AS m FROM d GROUP BY ALL), k AS (SELECT left_, right_, avg(x) AS mean_diff FROM p GROUP BY ALL)
 SELECT left_ AS "left", right_ AS "right", {r('any_value(mean_diff)')} AS mean_diff, {r('quantile_cont(m, 0.025)')} AS lo, {r('quantile_cont(m, 0.975)')} AS hi FROM m JOIN k USING (left_, right_) GROUP BY left_, right_""")
def paired_bootstrap(spark, d):
    return resampling.paired_bootstrap(grid(spark, d), "agent", "problem_id", "C")


@query("rank_stability", f"""WITH {GRID_SQL}, o AS (SELECT problem_id, list({{'agent': agent, 'v': C::DOUBLE}} ORDER BY agent) AS outcome, string_agg(agent || '=' || C::DOUBLE, ',' ORDER BY agent) AS name FROM g GROUP BY problem_id),
 h AS (SELECT any_value(outcome) AS outcome, name, count(*) AS n FROM o GROUP BY name), {_drawn('h', 'outcome', 'name', 2000)},
 m AS (SELECT b, x.agent AS agent, sum(x.v * w)::DOUBLE / sum(w) AS m FROM (SELECT b, w, unnest(outcome) AS x FROM w WHERE w > 0) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY round(m, 9) DESC, agent) AS rank FROM m)
 SELECT agent, {r('avg(rank)')} AS mean_rank, {r('quantile_cont(rank, 0.5)')} AS median_rank, {r('avg((rank = 1)::INT)')} AS p_first FROM k GROUP BY agent""")
def rank_stability(spark, d):
    return resampling.rank_stability(grid(spark, d), "agent", "problem_id", "C", replicates=2000)


@query("prm_agreement", f"""WITH x AS (SELECT l_returnflag AS model, l_quantity AS x, l_tax AS y FROM lineitem), k AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY x) + (count(*) OVER (PARTITION BY model, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY model ORDER BY y) + (count(*) OVER (PARTITION BY model, y) - 1) / 2.0::DOUBLE AS ry FROM x)
 SELECT model, count(*) AS n, {r('corr(rx, ry)')} AS rho, {r('avg(abs(x - y))')} AS mean_abs_diff FROM k GROUP BY model""")
def prm_agreement(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_quantity").alias("x"), F.col("l_tax").alias("y"))
    return order.spearman(li, ["model"], "x", "y")


_ORDER = "md5('42:' || doc_id)"


@query("balanced_sample", f"SELECT doc_id, source, turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_ORDER}, doc_id) AS turn FROM documents) ORDER BY turn, md5('42:' || source), doc_id LIMIT 100")
def balanced_sample(spark, d):
    return sampling.balanced_sample(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 100)


@query("stratified_batches", f"SELECT doc_id, source, (row_number() OVER (ORDER BY source, {_ORDER}, doc_id) - 1) % 3 AS batch FROM documents")
def stratified_batches(spark, d):
    return sampling.stratified_batches(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 3)


@query("smoke_choice", "SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n FROM documents) WHERE n = 1) WHERE k <= CASE lang WHEN 'en' THEN 3 WHEN 'de' THEN 2 ELSE 0 END")
def smoke_choice(spark, d):
    return sampling.smoke_choice(table(spark, d, "documents").select("doc_id", "lang", "source"), "lang", "source", "doc_id", {"en": 3, "de": 2})


@query("random_sample", f"SELECT doc_id FROM documents ORDER BY {_ORDER}, doc_id LIMIT 150")
def random_sample(spark, d):
    return sampling.random_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 150)


@query("multi_run_compare", f"""WITH {ATTEMPTS_SQL}, k AS (SELECT 'even' AS run, agent, avg(C) AS c, avg(V) AS v FROM a WHERE problem_id % 2 = 0 GROUP BY agent UNION ALL SELECT 'odd', agent, avg(C), avg(V) FROM a WHERE problem_id % 2 = 1 GROUP BY agent)
 SELECT run, agent, metric, {r('value')} AS value FROM (UNPIVOT k ON c, v INTO NAME metric VALUE value)""")
def multi_run_compare(spark, d):
    a = attempts(spark, d)
    mean = lambda k: a.filter(F.col("problem_id") % 2 == k).groupBy("agent").agg(F.avg("C").alias("c"), F.avg("V").alias("v"))
    return summary.compare_runs({"even": mean(0), "odd": mean(1)}, ["c", "v"])
