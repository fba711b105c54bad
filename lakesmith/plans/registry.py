"""Registry of named queries over the driver tables.

Each entry is ``name -> (build(spark, sf_dir) -> DataFrame, oracle SQL or
None)``. The SQL twin runs in DuckDB over the same Parquet files; entries
whose semantics SQL cannot state (model fits, iterative algorithms,
streams) register ``None`` and are tested in pytest against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


SECTIONS = ("clean_queries", "relational_queries", "profile_queries", "rule_queries", "warehouse_queries",
            "stream_queries", "ml_queries", "series_queries", "retrieval_queries", "corpus_queries",
            "io_queries")


def load_all() -> dict[str, tuple[Builder, str | None]]:
    """Import every section module; each registers its queries."""
    import importlib
    for mod in SECTIONS:
        importlib.import_module(f"{__package__}.{mod}")
    return REGISTRY
