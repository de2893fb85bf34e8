"""The named queries of the library over the driver's tables, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from canopia.plans import attribute_queries, crown_queries, distribution_queries, feature_queries, model_queries, more_queries, set_queries, site_queries, small_queries, space_queries, tree_queries

MODULES = [attribute_queries, crown_queries, distribution_queries, feature_queries, model_queries, more_queries, set_queries, site_queries, small_queries, space_queries, tree_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
