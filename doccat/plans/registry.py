"""Named queries: ``name -> (spark builder, DuckDB oracle SQL or None)``.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
driver tables; nothing is collected.  Oracle SQL uses the same column names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str | Callable[[], str]] = {}


def register(name: str, sql: str | Callable[[], str] | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    # Import for the side effect of registration.
    from doccat.plans import (  # noqa: F401
        q_audit,
        q_catalog,
        q_changes,
        q_dedupe,
        q_export,
        q_html,
        q_ingest,
        q_search,
        q_stream,
        q_text_dates,
        q_upsert,
    )


def queries() -> dict[str, Builder]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return {k: (v() if callable(v) else v) for k, v in ORACLES.items()}
