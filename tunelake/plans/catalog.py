"""Registry of named queries: each name maps to a Spark builder
``(spark, sf_dir) -> DataFrame`` and, where the result is expressible in
SQL, the DuckDB oracle text (fixture views inlined as CTEs)."""

from __future__ import annotations

from collections.abc import Callable

from .oracle_views import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def _bigint_counts(sql: str) -> str:
    """DuckDB types COUNT_IF as HUGEINT; COUNT(CASE WHEN .. THEN 1 END) is
    BIGINT like Spark's count_if."""
    out, i, key = [], 0, "COUNT_IF("
    while True:
        j = sql.upper().find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        depth, k = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(f"COUNT(CASE WHEN {sql[j + len(key):k - 1]} THEN 1 END)")
        i = k


def register(name: str, sql: str | None = None, views=()):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(_bigint_counts(sql), *views)
        return fn
    return deco


def load_all():
    # importing the modules fills the registry
    from . import q_data, q_eval, q_tokens, q_packing, q_losses, q_rollout, q_reports, q_stream  # noqa: F401
    return QUERIES, ORACLES
