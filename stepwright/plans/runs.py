"""Queries over steps, versions, texts and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.equivalence import equivalent
from ..functions.semantics import canonical_digest
from ..operators import gates, merge, queues, replay, summary
from ..operators import sequences as seq
from ..operators import steps as st
from ..operators.order import shared_folder
from ..sources import archives
from ..sources.store import Store
from ..streaming import latest
from .analysis import r
from .tables import ATTEMPTS_SQL, GRID_SQL, STEPS_SQL, attempts, grid, rounded, steps, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def labelled(spark, d, critic: bool = True):
    """Steps with score and label; scores are rounded before they are compared with thresholds."""
    s = steps(spark, d)
    base = F.round(st.base_score(st.prm_signal(F.col("prm_delta")), F.col("tool_gain"), F.col("harmful_repeat"), F.col("error_flag")) + (st.W_CRITIC * F.col("critic_signal") if critic else 0.0), 9)
    return s.withColumn("hybrid_score", base).withColumn("label", st.step_label(F.col("hybrid_score"), F.col("error_flag"), F.col("harmful_repeat"), F.col("useful_verification")))


_VERSION = "ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity"
_DIGEST = "md5(l_partkey || ':' || l_suppkey)"
_L = f"l AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, {_DIGEST} AS digest, strftime(l_shipdate, '%Y-%m') AS archive FROM lineitem)"
_EVENTS = f"""e0 AS (SELECT *, lag(digest) OVER w AS before, row_number() OVER w AS n FROM l WINDOW w AS (PARTITION BY l_orderkey, l_linenumber {_VERSION})),
 e AS (SELECT *, lag(archive) OVER w AS prev_archive, CASE WHEN n = 1 THEN 'added' ELSE 'replaced' END AS event FROM e0 WHERE n = 1 OR before IS DISTINCT FROM digest WINDOW w AS (PARTITION BY l_orderkey, l_linenumber {_VERSION}))"""
_KEYS, _ORDER = ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def versions(spark, d):
    li = table(spark, d, "lineitem").select(*_KEYS, *_ORDER)
    return li.withColumn("digest", F.md5(F.concat_ws(":", "l_partkey", "l_suppkey"))).withColumn("archive", F.date_format("l_shipdate", "yyyy-MM"))


@query("merge_events", f"WITH {_L}, {_EVENTS} SELECT l_orderkey, l_linenumber, archive, prev_archive, event, digest FROM e")
def merge_events(spark, d):
    return merge.change_events(versions(spark, d), _KEYS, _ORDER, "digest", ["archive"]).select(*_KEYS, "archive", "prev_archive", "event", "digest")


@query("merge_latest", f"WITH {_L}, {_EVENTS} SELECT l_orderkey, l_linenumber, archive, digest FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS k FROM e) WHERE k = 1")
def merge_latest(spark, d):
    return merge.latest_version(versions(spark, d), _KEYS, _ORDER, "digest", ["archive"]).select(*_KEYS, "archive", "digest")


@query("overlap_audit", f"WITH {_L} SELECT archive, count(DISTINCT (l_orderkey, l_linenumber)) AS keys, count(*) AS records, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS overlap FROM l GROUP BY archive")
def overlap_audit(spark, d):
    return versions(spark, d).groupBy("archive").agg(F.count_distinct(*_KEYS).alias("keys"), F.count(F.lit(1)).alias("records")).withColumn("overlap", F.col("records") - F.col("keys"))


@query("definition_conflicts", f"WITH {_L} SELECT l_orderkey, count(DISTINCT digest) AS versions FROM l GROUP BY l_orderkey HAVING count(DISTINCT digest) > 1")
def definition_conflicts(spark, d):
    return merge.definition_conflicts(versions(spark, d), "l_orderkey", F.col("digest"))


@query("repaired_wins", f"""WITH o AS (SELECT o_orderkey, o_totalprice, 'original' AS origin FROM orders WHERE o_orderkey % 3 < 2), p AS (SELECT o_orderkey, o_totalprice * 2 AS o_totalprice, 'repaired' AS origin FROM orders WHERE o_orderkey % 3 > 0)
 SELECT coalesce(p.o_orderkey, o.o_orderkey) AS o_orderkey, {r('coalesce(p.o_totalprice, o.o_totalprice)')} AS o_totalprice, coalesce(p.origin, o.origin) AS origin FROM o FULL JOIN p USING (o_orderkey)""")
def repaired_wins(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    k = F.col("o_orderkey") % 3
    return merge.repaired_wins(o.filter(k < 2), o.filter(k > 0).withColumn("o_totalprice", F.col("o_totalprice") * 2), "o_orderkey")


@query("grid_gaps", f"""WITH {GRID_SQL}, h AS (SELECT agent, problem_id FROM g WHERE (problem_id + length(agent)) % 7 <> 0) SELECT a.agent, p.problem_id, 'missing' AS gap FROM (SELECT DISTINCT agent FROM g) a CROSS JOIN (SELECT DISTINCT problem_id FROM g) p ANTI JOIN h ON h.agent = a.agent AND h.problem_id = p.problem_id""")
def grid_gaps(spark, d):
    g = grid(spark, d)
    some = g.filter((F.col("problem_id") + F.length("agent")) % 7 != 0)
    return merge.grid_gaps(some, g.select("problem_id").distinct(), g.select("agent").distinct()).select("agent", "problem_id", "gap")


@query("pending_work", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def pending_work(spark, d):
    done = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return merge.pending(table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey")


@query("lane_assignment", "SELECT o_orderkey, lane FROM (SELECT o_orderkey, o_orderstatus, (row_number() OVER (ORDER BY o_orderkey) - 1) % 6 AS lane FROM orders) WHERE o_orderstatus <> 'F'")
def lane_assignment(spark, d):
    o = table(spark, d, "orders")
    return merge.lanes(o.select("o_orderkey"), "o_orderkey", 6, o.filter("o_orderstatus = 'F'").select("o_orderkey"))


@query("step_label_rates", f"WITH {STEPS_SQL} SELECT agent, label, n, {r('n::DOUBLE / sum(n) OVER (PARTITION BY agent)')} AS share FROM (SELECT agent, label, count(*) AS n FROM s GROUP BY ALL)")
def step_label_rates(spark, d):
    return summary.distribution(labelled(spark, d), "label")


@query("prm_delta_labels", f"WITH {STEPS_SQL} SELECT conv_id, turn, {r('prm_delta')} AS prm_delta, {r('hybrid_score')} AS hybrid_score, label FROM s")
def prm_delta_labels(spark, d):
    return labelled(spark, d).select("conv_id", "turn", "prm_delta", "hybrid_score", "label")


_VALUE = "CASE label WHEN 'progressive' THEN 1.0 WHEN 'neutral_useful' THEN 0.5 WHEN 'neutral_waste' THEN 0.0 WHEN 'redundant' THEN -0.5 ELSE -1.0 END::DOUBLE"


@query("step_quality", f"WITH {STEPS_SQL} SELECT conv_id, {r(f'avg({_VALUE})')} AS signed_quality, count(*) AS steps, {', '.join(f'{r(f'avg((label = {chr(39)}{k}{chr(39)})::INT)')} AS {k}_rate' for k in st.CLASS_VALUE)}, {r(f'greatest(0, least(1, (avg({_VALUE}) + 1) / 2))')} AS q_step FROM s GROUP BY conv_id")
def step_quality(spark, d):
    return st.quality(labelled(spark, d), "conv_id")


@query("critic_ablation", f"""WITH {STEPS_SQL}, t AS (SELECT *, CASE WHEN error_flag > 0 OR round(base, 9) <= -0.2 THEN 'regressive' WHEN harmful_repeat > 0 THEN 'redundant' WHEN round(base, 9) >= 0.2 THEN 'progressive' WHEN useful_verification THEN 'neutral_useful' ELSE 'neutral_waste' END AS bare FROM s),
 u AS (SELECT conv_id, avg({_VALUE}) AS q1, avg({_VALUE.replace('label', 'bare')}) AS q0, count(*) FILTER (label <> bare) AS changed FROM t GROUP BY conv_id) SELECT conv_id, {r('(q1 + 1) / 2')} AS q_with, {r('(q0 + 1) / 2')} AS q_without, changed FROM u""")
def critic_ablation(spark, d):
    s = labelled(spark, d)
    bare = F.round(F.col("hybrid_score") - st.W_CRITIC * F.col("critic_signal"), 9)
    s = s.withColumn("bare", st.step_label(bare, F.col("error_flag"), F.col("harmful_repeat"), F.col("useful_verification")))
    q = lambda c: (F.avg(st.lookup(F.col(c), st.CLASS_VALUE)) + 1) / 2
    return s.groupBy("conv_id").agg(q("label").alias("q_with"), q("bare").alias("q_without"), F.count_if(F.col("label") != F.col("bare")).alias("changed"))


@query("earliest_error", f"WITH {STEPS_SQL}, f AS (SELECT conv_id, agent, min(normalized_position) AS p FROM s WHERE C = 0 AND label = 'regressive' GROUP BY ALL) SELECT agent, {r('avg(p)')} AS mean, {r('quantile_cont(p, 0.5)')} AS median, count(*) AS attempts FROM f GROUP BY agent")
def earliest_error(spark, d):
    return summary.earliest_error(labelled(spark, d), ["conv_id"])


_PART = lambda k: f"coalesce(sum(v) FILTER (kind = '{k}'), 0)::BIGINT"
_PROCESS = f"({_PART('useful')} + {_PART('pre')} + {_PART('post')})"


@query("token_utility", f"""WITH {STEPS_SQL}, t AS (SELECT conv_id, greatest(0, output_tokens - hidden_tokens) AS v, CASE WHEN action_type = 'answer' THEN 'answer' WHEN position > conv_id % 5 + 1 THEN 'post' WHEN label IN ('progressive', 'neutral_useful') THEN 'useful' ELSE 'pre' END AS kind FROM s)
 SELECT conv_id, {_PART('useful')} AS t_useful, {_PART('pre')} AS t_pre_waste, {_PART('post')} AS t_post_waste, {_PART('answer')} AS t_answer, {_PROCESS} AS t_process, {', '.join(f"{r(f'{_PART(k)}::DOUBLE / greatest({_PROCESS}, 1)')} AS {n}" for k, n in (('useful', 'ptu'), ('pre', 'pre_waste_rate'), ('post', 'post_waste_rate')))} FROM t GROUP BY conv_id""")
def token_utility(spark, d):
    return st.token_utility(labelled(spark, d).withColumn("solution", F.col("conv_id") % 5 + 1), "conv_id")


@query("budget_curves", f"""WITH {STEPS_SQL}, t AS (SELECT *, sum(output_tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM s), b AS (SELECT conv_id, budget, max((run <= budget AND action_type = 'answer' AND correct = 1)::INT) AS c, max((run <= budget AND turn >= evidence_step)::INT) AS g
 FROM (SELECT *, unnest([32, 64, 128, 512]) AS budget, conv_id % 2 AS correct, conv_id % 3 AS evidence_step FROM t) GROUP BY conv_id, budget) SELECT budget, {r('avg(c)')} AS c, {r('avg(g)')} AS g, {r('avg(c * g)')} AS v FROM b GROUP BY budget""")
def budget_curves(spark, d):
    s = steps(spark, d).withColumn("correct", F.col("conv_id") % 2).withColumn("evidence_step", F.col("conv_id") % 3)
    return st.budget_status(s, ["conv_id"], "turn", (32, 64, 128, 512)).groupBy("budget").agg(F.avg("c").alias("c"), F.avg("g").alias("g"), F.avg("v").alias("v"))


@query("trace_observability", f"""WITH {STEPS_SQL}, t AS (SELECT *, 'a' || conv_id % 4 AS who, output_tokens > 20 AS reasoned, action_type = 'code' AND error_flag = 0 AS ran FROM s),
 k AS (SELECT who, count(*) AS steps, {r("avg((action_type <> 'none')::INT)")} AS actionable_rate, {r('avg((output_tokens = 0)::INT)')} AS unmapped_rate, {r('avg(reasoned::INT)')} AS reasoned_rate, {r('avg(ran::INT)')} AS ran_rate, sum(hidden_tokens)::BIGINT AS hidden_tokens, sum(output_tokens * 4)::BIGINT AS reasoning_chars FROM t GROUP BY who),
 c AS (SELECT DISTINCT conv_id, 'a' || conv_id % 4 AS who FROM s), v AS (SELECT who, count(*) AS attempted, count(*) FILTER (conv_id % 5 > 0) AS valid_n, 1 - count(*) FILTER (conv_id % 28 = 3)::DOUBLE / count(*) AS adherence FROM c GROUP BY who)
 SELECT who AS agent, attempted, valid_n, {r('adherence')} AS format_adherence, steps, actionable_rate, unmapped_rate, reasoned_rate, ran_rate, hidden_tokens, reasoning_chars, adherence >= 0.95 AND unmapped_rate <= 0.05 AS eligible, CASE WHEN adherence >= 0.95 AND unmapped_rate <= 0.05 THEN '' ELSE 'reasoning is not mapped to visible actions' END AS exclusion FROM v JOIN k USING (who)""")
def trace_observability(spark, d):
    who = F.concat(F.lit("a"), (F.col("conv_id") % 4).cast("string"))
    s = steps(spark, d).withColumns({"agent": who, "actionable": F.col("action_type") != "none", "unmapped": F.col("output_tokens") == 0, "reasoned": F.col("output_tokens") > 20, "ran": (F.col("action_type") == "code") & (F.col("error_flag") == 0), "reasoning_chars": F.col("output_tokens") * 4})
    a = s.select("conv_id", "agent").distinct().withColumns({"valid": F.col("conv_id") % 5 > 0, "stop_reason": F.when(F.col("conv_id") % 28 == 3, "format_error_limit").otherwise("explicit_final_answer")})
    return summary.observability(s, a)


@query("evaluator_coverage", f"""WITH a AS (SELECT source AS agent, quality AS C, n_chars % 10 > 3 AS valid FROM documents LEFT JOIN labels USING (doc_id)), k AS (SELECT source AS agent, CASE WHEN n_chars % 6 = 0 THEN 'failed' ELSE 'success' END AS status FROM documents WHERE source < 'src5'),
 c AS (SELECT agent, count(*) AS calls, count(*) FILTER (status = 'success') AS successes FROM k GROUP BY agent), v AS (SELECT agent, count(*) FILTER (valid) AS valid_n, count(*) FILTER (valid AND C IS NULL) AS unresolved FROM a GROUP BY agent)
 SELECT agent, valid_n, unresolved, coalesce(calls, 0) AS calls, coalesce(successes, 0) AS successes, {r('coalesce(successes::DOUBLE / nullif(calls, 0), 0)')} AS success_rate, {r('1 - unresolved::DOUBLE / nullif(valid_n, 0)')} AS decision_coverage FROM v LEFT JOIN c USING (agent)""")
def evaluator_coverage(spark, d):
    docs = table(spark, d, "documents").drop("text")
    a = docs.join(table(spark, d, "labels"), "doc_id", "left").select(F.col("source").alias("agent"), F.col("quality").alias("C"), (F.col("n_chars") % 10 > 3).alias("valid"))
    calls = docs.filter("source < 'src5'").select(F.col("source").alias("agent"), F.when(F.col("n_chars") % 6 == 0, "failed").otherwise("success").alias("status"))
    return summary.evaluator_coverage(a, calls)


_EMB = "(SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, embedding FROM embeddings)"


@query("redundancy_sweep", f"""WITH m AS (SELECT a.label, a.vec_id, round(coalesce(max(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 0), 6) AS top FROM {_EMB} a LEFT JOIN {_EMB} b ON a.label = b.label AND a.pos // 10 = b.pos // 10 AND b.pos < a.pos GROUP BY ALL)
 SELECT label AS agent, threshold, {r('avg((top >= threshold)::INT)')} AS repetition FROM (SELECT *, unnest([0.1, 0.2, 0.3, 0.4])::DOUBLE AS threshold FROM m) GROUP BY label, threshold""")
def redundancy_sweep(spark, d):
    from pyspark.sql.window import Window

    e = table(spark, d, "embeddings").withColumn("pos", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    g = e.groupBy("label", F.floor(F.col("pos") / 10).alias("attempt")).agg(F.array_sort(F.collect_list(F.struct("pos", "vec_id", "embedding"))).alias("s"))
    g = g.select("label", "attempt", F.transform("s", lambda x: x["embedding"]).alias("vectors"), F.transform("s", lambda x: x["vec_id"].cast("string")).alias("texts"))
    s = st.redundancy_signals(g, "vectors", "texts").select(F.col("label").alias("agent"), F.explode("signals").alias("x")).select("agent", F.round("x.max_similarity", 6).alias("top"))
    return summary.threshold_sweep(s, "top", [0.1, 0.2, 0.3, 0.4])


@query("exact_repetition", "SELECT source, doc_id, row_number() OVER (PARTITION BY source, lower(text) ORDER BY doc_id) > 1 AND coalesce(lower(text), '') <> '' AS repeated FROM documents")
def exact_repetition(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", F.lower("text").alias("norm"))
    return seq.earlier_duplicate(docs, ["source"], ["doc_id"], "norm").select("source", "doc_id", "repeated")


@query("output_numbers", r"SELECT doc_id, list_distinct(regexp_extract_all(text, '[0-9]+'))::VARCHAR[] IS NOT NULL AS has_text, len(list_distinct(regexp_extract_all(coalesce(text, ''), '[0-9]+')))::INT AS numbers FROM documents")
def output_numbers(spark, d):
    docs = table(spark, d, "documents")
    n = F.size(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9]+"), F.lit(0))))
    return docs.select("doc_id", F.col("text").isNotNull().alias("has_text"), n.alias("numbers"))


#: Texts and what the functions make of them; the SQL side states the expected values.
ANSWERS = [("\\boxed{1/2}", "1/2"), (" Answer: 48. ", "48"), ("$\\left( x, y \\right)$", "(x,y)"), ("Final Answer = p - q", "p-q"), ("", ""), ("1,000..", "1,000")]
ACTIONS = [
    ("Reasoning step: compute\n```python\n<Python code; always print the result you need>\n```", "none", "", "template_placeholder"),
    ("Reasoning step: conclude\n```answer\n\\n<final answer only>\\n\n```", "none", "", "template_placeholder"),
    ("Reasoning step: conclude\n```answer\nanswer\n48\n```", "answer", "48", ""),
    ("", "none", "", "no_visible_action"),
    ("Reasoning step: compute\n```python\nprint(1)\n```\n```answer\n1\n```", "none", "", "multiple_actions"),
    ("```python\nReasoning step: use the area formula\n```", "none", "", "answer_text_in_code_block"),
    ("```python\nanswer\nmu = 1/(2*n + 1)\n```", "none", "", "answer_text_in_code_block"),
    ("**Answer**\n\n\\[p-q\\]", "answer", "p-q", ""),
    ("**Reasoning step:** done\n\n**Answer:**  \n1", "answer", "1", ""),
    ("```\n3\n```", "answer", "3", ""),
    ("The double series equals the following.\n\\[\\sum_{j,k}a_{j,k}=p-q\\]", "answer", "p-q", ""),
    ("```python\nprint(2)", "code", "print(2)", ""),
    ("```python\nprint(2)\n```\nObservation: 2\n```answer\n2\n```", "code", "print(2)", ""),
]


def _values(rows, names: str) -> str:
    q = lambda x: "NULL" if x is None else f"{x!r}" if not isinstance(x, str) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(q(x) for x in row) + ')' for row in rows)}) t({names})"


@query("answer_normalize", _values(ANSWERS, "raw, norm"))
def answer_normalize(spark, d):
    return spark.createDataFrame([(x,) for x, _ in ANSWERS], "raw string").withColumn("norm", tx.normalize_answer(F.col("raw")))


@query("parse_action", _values(ACTIONS, "raw, action_type, content, parse_error"))
def parse_action(spark, d):
    p = spark.createDataFrame([(x[0],) for x in ACTIONS], "raw string").withColumn("p", tx.parse_action(F.col("raw")))
    return p.select("raw", "p.action_type", "p.content", "p.parse_error")


EQUAL = [("1/2", "0.5", True), ("2", "3", False), ("x", "x ", True), ("x+1", "1+x", None), ("", "1", False), ("\\frac{3}{4}", "0.75", True)]


@query("symbolic_equivalence", _values(EQUAL, "a, b, equal"))
def symbolic_equivalence(spark, d):
    return spark.createDataFrame([(a, b) for a, b, _ in EQUAL], "a string, b string").withColumn("equal", equivalent(F.col("a"), F.col("b")))


TRACE = [("a", 1, "x = 1\n3", True, "7"), ("a", 2, "Answer: 7.0", True, "7"), ("b", 1, "7", False, "7"), ("c", 1, "no number", True, "7"), ("d", 1, "14/2", True, "7")]


@query("provenance_trace", _values([("a", 2, "7.0", "symbolic_tool_output_match", 2), ("b", None, None, "no_tool_evidence", 0), ("c", None, None, "tool_used_not_traceable", 1), ("d", 1, "14/2", "symbolic_tool_output_match", 1)], "k, evidence_step, candidate, method, evidence_count"))
def provenance_trace(spark, d):
    s = spark.createDataFrame(TRACE, "k string, step_num int, stdout string, code_success boolean, final_answer string")
    return st.provenance(s, ["k"], "final_answer")


@query("validation_reasons", _values([(1, ""), (2, "answer_step_missing|api_error|empty_final_answer|not_finished"), (3, "empty_final_answer|missing_stop_reason|no_steps|not_finished|timed_out")], "id, reasons"))
def validation_reasons(spark, d):
    rows = [(1, True, False, "explicit_final_answer", "4", [("answer",)]), (2, False, False, "api_error", " ", [("code",)]), (3, None, True, None, None, [])]
    t = spark.createDataFrame(rows, "id int, finished boolean, timed_out boolean, stop_reason string, final_answer string, steps array<struct<action_type:string>>")
    return t.select("id", F.array_join(tx.validation_reasons(*[F.col(c) for c in ("finished", "timed_out", "stop_reason", "final_answer", "steps")]), "|").alias("reasons"))


@query("json_props", "SELECT event_id, (props ->> '$.k')::BIGINT AS k, event_type FROM events WHERE props IS NOT NULL")
def json_props(spark, d):
    e = table(spark, d, "events").filter("props is not null")
    return e.select("event_id", F.try_variant_get(tx.json_object(F.col("props")), "$.k", "bigint").alias("k"), "event_type")


_SECRETS = " ".join(f"WHEN regexp_matches(text, '{p}') THEN {i}" for i, p in enumerate(archives.SECRET_PATTERNS))


@query("secret_scan", f"SELECT doc_id, pattern FROM (SELECT doc_id, CASE {_SECRETS} END::INT AS pattern FROM documents) WHERE pattern IS NOT NULL")
def secret_scan(spark, d):
    return archives.scan_secrets(table(spark, d, "documents"), "doc_id")


_LOG = "l AS (SELECT event_id, event_type, epoch(ts)::DOUBLE AS t, value > 60 AS failed FROM events)"


@query("paced_schedule", f"WITH {_LOG}, i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) - 1 AS i FROM l) SELECT event_id, event_type, {r('i * 900.0::DOUBLE + max(t - i * 900.0::DOUBLE) OVER (PARTITION BY event_type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)')} AS start FROM i")
def paced_schedule(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us")).withColumn("t", F.col("us") / 1e6)
    return seq.paced_schedule(e, ["event_type"], "t", ["t", "event_id"], 900.0).select("event_id", "event_type", "start")


@query("failure_streaks", f"""WITH {_LOG}, i AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY event_type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM l), k AS (SELECT *, (sum(failed::INT) OVER (PARTITION BY event_type, island ORDER BY t, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS streak FROM i)
 SELECT event_id, streak, CASE WHEN streak = 0 THEN 0.0 WHEN streak >= 3 THEN 120.0 ELSE 30.0 END::DOUBLE AS cooldown FROM k""")
def failure_streaks(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "ts", "value")
    return seq.failure_streaks(e, ["event_type"], ["ts", "event_id"], F.col("value") > 60).select("event_id", "streak", "cooldown")


@query("canonical_digests")
def canonical_digests(spark, d):
    e = table(spark, d, "events")
    return e.select("event_type", canonical_digest(F.col("props")).alias("digest")).groupBy("event_type").agg(F.count_distinct("digest").alias("versions"), F.count("digest").alias("n"))


@query("replay_controller")
def replay_controller(spark, d):
    s = steps(spark, d).join(table(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"])
    fence = F.when(F.col("action_type") == "answer", F.concat(F.lit("```answer\n"), F.col("position").cast("string"), F.lit("\n```"))).when(F.col("action_type") == "code", F.concat(F.lit("```python\nprint('''"), F.col("text"), F.lit("''')\n```"))).otherwise(F.col("text"))
    s = s.withColumn("raw_response", fence).withColumn("code_success", F.col("error_flag") == 0)
    return replay.replay(s, ["conv_id"], "turn")


@query("stream_latest", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def stream_latest(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    folder = shared_folder(spark, "stream")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    latest.upsert_latest(stream.select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return latest.latest_rows(spark, f"{folder}/table")


@query("gate_report", f"""WITH {ATTEMPTS_SQL}, g AS (SELECT agent, count(*) FILTER (stop_reason IN ('api_error', 'worker_exception', 'trajectory_timeout'))::DOUBLE AS infrastructure, avg(valid::INT)::DOUBLE AS completion, sum(truncated_steps)::DOUBLE AS truncated, sum(needs_judge::INT)::DOUBLE AS judge_queue, sum(critic_errors)::DOUBLE AS critic_errors FROM a WHERE agent IS NOT NULL GROUP BY agent),
 u AS (UNPIVOT g ON infrastructure, completion, truncated, judge_queue, critic_errors INTO NAME what VALUE value) SELECT agent || '.' || what AS gate, {r('value')} AS value, CASE what WHEN 'completion' THEN value >= 0.6 WHEN 'truncated' THEN value <= 40 ELSE value = 0 END AS holds FROM u
 UNION ALL SELECT 'rows', count(*), count(*) = 1000 FROM a UNION ALL SELECT 'unknown_agents', count(*) FILTER (agent IS NULL), count(*) FILTER (agent IS NULL) = 0 FROM a""")
def gate_report(spark, d):
    a = attempts(spark, d)
    agents = sorted(r[0] for r in a.select("agent").distinct().collect() if r[0] is not None)
    folder = shared_folder(spark, "gates")
    report = gates.write_observed(a, folder, [gates.count_gate(1000), *gates.smoke_gates(agents, 0.6, 40)])
    Store(spark, folder).remove()
    return spark.createDataFrame([(n, None if v is None else float(v), ok) for n, v, ok, _ in report], "gate string, value double, holds boolean")


@query("trajectory_audit", "SELECT agent, count(*) AS n, count(*) FILTER (publishable) AS publishable FROM (SELECT source AS agent, n_chars % 10 > 3 AS publishable FROM labels JOIN documents USING (doc_id)) GROUP BY agent")
def trajectory_audit(spark, d):
    a = attempts(spark, d)
    reasons = tx.validation_reasons(F.col("valid"), F.lit(False), F.col("stop_reason"), F.lit("x"), F.array(F.struct(F.lit("answer").alias("action_type"))))
    return a.groupBy("agent").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size(reasons) == 0).alias("publishable"))


@query("unresolved_failures", "SELECT doc_id, stop_reason, CASE WHEN stop_reason = 'format_error_limit' THEN 'protocol' ELSE 'infrastructure' END AS failure FROM (SELECT doc_id, CASE n_chars % 10 WHEN 0 THEN 'api_error' WHEN 1 THEN 'format_error_limit' WHEN 2 THEN 'trajectory_timeout' END AS stop_reason FROM labels JOIN documents USING (doc_id)) WHERE stop_reason IS NOT NULL")
def unresolved_failures(spark, d):
    return queues.unresolved(attempts(spark, d).withColumnRenamed("problem_id", "doc_id"), ["doc_id"])


@query("source_summary", "SELECT source AS agent, count(*) AS records, count(DISTINCT doc_id) AS problems, count(*) FILTER (n_chars % 10 > 3) AS answers, count(*) FILTER (n_chars % 10 IN (0, 2)) AS infrastructure, count(*) FILTER (n_chars % 10 = 1) AS protocol FROM labels JOIN documents USING (doc_id) GROUP BY source")
def source_summary(spark, d):
    return queues.source_summary(attempts(spark, d), "agent", "problem_id")


@query("critic_queue", f"""WITH {STEPS_SQL} SELECT conv_id, turn, 'critic|' || conv_id || '|' || turn AS task_id, sha256(conv_id || ':' || turn) AS prompt_hash FROM s2 WHERE conv_id % 3 > 0 AND turn % 4 > 0 AND ((abs(round(base, 9)) < 0.08 AND action_type <> 'answer') OR turn % 5 = 0)""")
def critic_queue(spark, d):
    return queues.critic_queue(queue_steps(spark, d), ["conv_id", "turn"], F.concat_ws(":", "conv_id", "turn"))


def queue_steps(spark, d):
    s = steps(spark, d)
    base = F.round(st.base_score(st.prm_signal(F.col("prm_delta")), F.col("tool_gain"), F.col("harmful_repeat"), F.col("error_flag")), 9)
    return s.withColumn("base", base).withColumn("valid", F.col("conv_id") % 3 > 0).withColumn("critic_used", F.col("turn") % 4 == 0).withColumn("critic_error", F.when(F.col("turn") % 5 == 0, "failed"))


@query("pending_evaluations", f"""WITH {STEPS_SQL}, q AS (SELECT conv_id, turn, 'critic|' || conv_id || '|' || turn AS task_id, sha256(conv_id || ':' || turn) AS prompt_hash FROM s2 WHERE conv_id % 3 > 0 AND turn % 4 > 0 AND ((abs(round(base, 9)) < 0.08 AND action_type <> 'answer') OR turn % 5 = 0))
 SELECT * FROM q WHERE NOT (conv_id % 2 = 0 AND turn % 2 = 1)""")
def pending_evaluations(spark, d):
    q = critic_queue(spark, d)
    done = q.filter((F.col("conv_id") % 2 == 0) & (F.col("turn") % 2 == 1)).withColumn("status", F.lit("success")).withColumn("judge_model", F.lit("m"))
    stale = q.withColumn("prompt_hash", F.lit("other")).withColumn("status", F.lit("success")).withColumn("judge_model", F.lit("m"))
    return queues.uncached(q, done.unionByName(stale), "m")


@query("token_composition", f"""WITH {STEPS_SQL}, t AS (SELECT conv_id, greatest(0, output_tokens - hidden_tokens) AS v, CASE WHEN action_type = 'answer' THEN 'answer' WHEN position > conv_id % 5 + 1 THEN 'post' WHEN label IN ('progressive', 'neutral_useful') THEN 'useful' ELSE 'pre' END AS kind FROM s),
 u AS (SELECT conv_id, {_PART('useful')} AS u, {_PART('pre')} AS p, {_PART('post')} AS w, {_PART('answer')} AS a FROM t GROUP BY conv_id) SELECT conv_id % 6 AS agent, {r('avg(u)')} AS t_useful, {r('avg(p)')} AS t_pre_waste, {r('avg(w)')} AS t_post_waste, {r('avg(a)')} AS t_answer,
 {', '.join(f"{r(f'sum({c})::DOUBLE / greatest(sum(u + p + w + a), 1)')} AS {n}_share" for c, n in (('u', 't_useful'), ('p', 't_pre_waste'), ('w', 't_post_waste'), ('a', 't_answer')))} FROM u GROUP BY 1""")
def token_composition(spark, d):
    t = st.token_utility(labelled(spark, d).withColumn("solution", F.col("conv_id") % 5 + 1), "conv_id")
    return queues.token_composition(t.withColumn("agent", F.col("conv_id") % 6))


@query("solution_audit", f"""WITH {STEPS_SQL}, f AS (SELECT conv_id, min(position) FILTER (action_type = 'answer') AS a, max(position) AS n FROM s GROUP BY conv_id), x AS (SELECT conv_id, n, CASE WHEN conv_id % 2 = 1 THEN least(conv_id % 3 + 1, a) END AS solution FROM f)
 SELECT conv_id % 6 AS agent, {r('avg((solution IS NOT NULL)::INT)')} AS detection_rate, {r('avg(coalesce(solution = n, false)::INT)')} AS terminal_rate FROM x GROUP BY 1""")
def solution_audit(spark, d):
    s = steps(spark, d).withColumn("correct", F.col("conv_id") % 2).withColumn("evidence_step", F.col("conv_id") % 3 + 1)
    x = queues.first_solution(s, ["conv_id"]).groupBy("conv_id").agg(F.max("solution").alias("solution"), F.max("position").alias("n"))
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return x.groupBy((F.col("conv_id") % 6).alias("agent")).agg(rate(F.col("solution").isNotNull()).alias("detection_rate"), rate(F.col("solution") == F.col("n")).alias("terminal_rate"))
