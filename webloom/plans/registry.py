"""The reference operators' queries, gathered from the modules of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webloom.plans import control_queries, data_queries, detail_queries, more_queries, page_queries

MODULES = (page_queries, data_queries, more_queries, control_queries, detail_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
