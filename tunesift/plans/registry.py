"""Query registry: ``name -> (spark_fn(spark, sf_dir), oracle_sql | None)``."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    # importing the modules fills the registry
    from tunesift.plans import (  # noqa: F401
        q_catalog, q_search, q_features, q_similarity, q_evaluation, q_profile, q_ingest, q_models,
        q_streaming,
    )
