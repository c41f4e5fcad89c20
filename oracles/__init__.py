"""Reference SQL for the registered queries, run by DuckDB beside Spark."""

from __future__ import annotations

import importlib

PARTS = ["rules", "baseline", "flows", "dialogue", "ingest", "tls", "reports", "models", "smtp"]


def all_sql() -> dict[str, str]:
    merged: dict[str, str] = {}
    for part in PARTS:
        merged.update(importlib.import_module(f"oracles.{part}").SQL)
    return merged
