"""Gates that a table must pass to be published, measured while it is written.

The metrics are observed in the job that writes the rows to a pending folder: no
second scan and nothing collected. Only when every gate holds is the folder renamed
to its name; otherwise it is removed and an error names the gates. A metric that is
missing, as over no rows, does not hold.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.store import Store
from .summary import infrastructure


class GateError(ValueError):
    """A table that is not published, with the gates that do not hold."""


@dataclass
class Gate:
    """``metric`` is an aggregate over all rows; ``holds`` judges its value; ``shows`` is an aggregate that names a case."""

    name: str
    metric: Column
    holds: Callable[[object], bool]
    shows: Column | None = None


def count_gate(rows: int) -> Gate:
    return Gate("rows", F.count(F.lit(1)), lambda n: n == rows)


def infrastructure_gate() -> Gate:
    """No attempt may have ended by a failure of the infrastructure; shows the first that did."""
    case = F.min(F.when(infrastructure(), F.struct("agent", "problem_id", "stop_reason")))
    return Gate("infrastructure", F.count_if(infrastructure()), lambda n: n == 0, case)


def agents_gate(agents: list[str]) -> Gate:
    """Every row is of a known agent."""
    return Gate("unknown_agents", F.count_if(~F.coalesce(F.col("agent").isin(*agents), F.lit(False))), lambda n: n == 0)


def smoke_gates(agents: list[str], min_completion: float = 0.9, max_truncated: int | None = None) -> list[Gate]:
    """Health of each of a few known agents: a full number of rows alone is no sound run.

    ``attempts`` has agent, stop_reason, valid, truncated_steps, needs_judge, critic_errors.
    """
    out = [agents_gate(agents)]
    for a in agents:
        own = F.coalesce(F.col("agent") == a, F.lit(False))
        total = lambda c: F.coalesce(F.sum(F.when(own, F.col(c)).cast("long")), F.lit(0).cast("long"))  # noqa: B023, E731
        out += [
            Gate(f"{a}.infrastructure", F.count_if(own & infrastructure()), lambda n: n == 0),
            Gate(f"{a}.completion", F.avg(F.when(own, F.coalesce("valid", F.lit(False)).cast("double"))), lambda x: x is not None and x >= min_completion),
            Gate(f"{a}.truncated", total("truncated_steps"), lambda n: max_truncated is None or n <= max_truncated),
            Gate(f"{a}.judge_queue", total("needs_judge"), lambda n: n == 0),
            Gate(f"{a}.critic_errors", total("critic_errors"), lambda n: n == 0),
        ]
    return out


def write_observed(df: DataFrame, path: str, gates: list[Gate]) -> list[tuple[str, object, bool, object]]:
    """Write the rows and return each gate's name, value, whether it holds, and the case it shows."""
    seen = Observation()
    metrics = [g.metric.alias(f"m{i}") for i, g in enumerate(gates)] + [g.shows.alias(f"s{i}") for i, g in enumerate(gates) if g.shows is not None]
    df.observe(seen, *metrics).write.parquet(path)
    found = seen.get
    return [(g.name, found.get(f"m{i}"), bool(g.holds(found.get(f"m{i}"))), found.get(f"s{i}")) for i, g in enumerate(gates)]


def publish(df: DataFrame, folder: str, name: str, gates: list[Gate]) -> list[tuple[str, object, bool, object]]:
    """Publish the rows as ``folder/name`` if all gates hold; else nothing is left and GateError is raised."""
    spark, pending = df.sparkSession, f"_pending-{uuid.uuid4().hex}"
    store = Store(spark, folder)
    if store.exists(name):
        raise FileExistsError(f"{folder}/{name}")
    try:
        report = write_observed(df, f"{folder}/{pending}", gates)
        wrong = [f"{n}: {value}" + (f", first {case}" if case is not None else "") for n, value, ok, case in report if not ok]
        if wrong:
            raise GateError("; ".join(wrong))
        store.move(pending, name)
        return report
    finally:
        store.remove(pending)
