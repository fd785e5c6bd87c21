"""Replay of recorded turns through the controller's rules.

The model and the tool are not run: each row has a turn's raw response and
whether its code succeeded and printed something. Turns are parsed with column
expressions; only the state machine over the few turns of an attempt is Python,
once per attempt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import action_signature, parse_action


@dataclass(frozen=True)
class Limits:
    """What a controller allows in an attempt."""

    steps: int = 6
    tool_actions: int = 4
    format_errors: int = 2
    repeats: int = 2
    answer_only: int = 1
    failures_in_row: int = 2


def run_turns(turns: list[dict], limits: Limits = Limits()) -> dict:
    """The outcome of parsed turns: stop_reason, final_answer, turns read and tool runs."""
    runs = bad = failed = repeats = ignored = 0
    must_answer, last = False, ""
    for i, t in enumerate(turns[: limits.steps], 1):
        end = lambda why, answer="", i=i, runs=runs: {"stop_reason": why, "final_answer": answer, "turns": i, "tool_runs": runs}
        if t.get("error"):
            return end("api_error")
        closing = must_answer or runs >= limits.tool_actions or i == limits.steps
        if t["action_type"] == "answer":
            return end("explicit_final_answer", t["content"])
        if t["action_type"] != "code":
            bad, must_answer = bad + 1, True
            if bad >= limits.format_errors:
                return end("format_error_limit")
        elif closing:
            ignored, must_answer = ignored + 1, True
            if ignored >= limits.answer_only:
                return end("answer_only_violation_limit")
        elif t["signature"] == last:
            repeats, must_answer = repeats + 1, True
            if repeats >= limits.repeats:
                return end("repeated_action_limit")
        else:
            last, repeats, bad, runs = t["signature"], 0, 0, runs + 1
            failed = 0 if t["success"] else failed + 1
            must_answer = failed >= limits.failures_in_row
    return {"stop_reason": "max_steps" if len(turns) >= limits.steps else "api_error", "final_answer": "", "turns": min(len(turns), limits.steps), "tool_runs": runs}


def replay(turns: DataFrame, keys: list[str], order: str, raw: str = "raw_response", success: str = "code_success", error: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """keys, stop_reason, final_answer, turns, tool_runs of each attempt."""
    import pandas as pd

    action = parse_action(F.col(raw))
    p = turns.select(*keys, F.col(order).alias("_order"), action.alias("_a"), F.coalesce(F.col(success), F.lit(False)).alias("success"), (F.col(error) if error else F.lit(None).cast("string")).alias("error"))
    p = p.select(*keys, "_order", F.col("_a.action_type").alias("action_type"), F.col("_a.content").alias("content"), action_signature(F.col("_a.content")).alias("signature"), "success", "error")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = run_turns(pdf.sort_values("_order").to_dict("records"), limits)
        return pd.DataFrame([[*pdf[keys].iloc[0], *out.values()]], columns=[*keys, *out])

    kinds = ", ".join(f"`{k}` {turns.schema[k].dataType.simpleString()}" for k in keys)
    return p.groupBy(*keys).applyInPandas(one, f"{kinds}, stop_reason string, final_answer string, turns int, tool_runs int")
