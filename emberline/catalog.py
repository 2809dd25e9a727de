"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from emberline.plans import analysis, core, ingest, whole

PAIRS = core.PAIRS
assert analysis and ingest and whole  # they register their queries


def queries() -> dict:
    return {name: run for name, (run, _) in PAIRS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in PAIRS.items() if sql}
