"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame``
and, where the semantics are SQL-expressible, the DuckDB twin over the
driver's views.  Names are the SURVEY inventory ids in lower case."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    # importing the modules fills the registry
    from floodlens.plans import (q_clean, q_detect, q_learn, q_mitigate, q_model,  # noqa: F401
                                 q_options, q_report, q_scan, q_stream, q_timeline)
