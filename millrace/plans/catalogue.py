"""All queries of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import evaluation, graphs, lifecycle, loops, search, service, texts

FLAGSHIP = "rrf_hybrid_topk"

_MODULES = (lifecycle, texts, search, graphs, evaluation, loops, service)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.SQL.items()}
