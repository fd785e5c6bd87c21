"""The registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import analysis, metrics, runs, work

QUERIES: dict[str, Callable] = {**analysis.QUERIES, **metrics.QUERIES, **runs.QUERIES, **work.QUERIES}
ORACLE_SQL: dict[str, str] = {**analysis.ORACLE_SQL, **metrics.ORACLE_SQL, **runs.ORACLE_SQL, **work.ORACLE_SQL}
