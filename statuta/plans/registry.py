"""The registered queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from statuta.plans import graph_queries, model_queries, more_queries, register_queries, text_queries

_ALL = [*register_queries.QUERIES, *text_queries.QUERIES, *graph_queries.QUERIES, *more_queries.QUERIES, *model_queries.QUERIES]
_NAMES = [f.__name__ for f, _ in _ALL]
if len(set(_NAMES)) < len(_NAMES):
    raise ValueError(f"registered twice: {sorted(n for n in set(_NAMES) if _NAMES.count(n) > 1)}")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f, _ in _ALL}
ORACLES: dict[str, str] = {f.__name__: sql for f, sql in _ALL if sql}
