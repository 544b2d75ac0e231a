"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pagelattice.llm import oracles, queries as q


def queries() -> dict:
    return {k: v for k, v in vars(q).items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return oracles.sql()
