"""Registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrywork.plans import analytics_queries, candidate_queries, driver_queries, java_queries, prompt_queries, record_queries, retrieval_queries, rule_queries, selection_queries

_ALL = analytics_queries.QUERIES | retrieval_queries.QUERIES | rule_queries.QUERIES | selection_queries.QUERIES | prompt_queries.QUERIES | candidate_queries.QUERIES | java_queries.QUERIES | driver_queries.QUERIES | record_queries.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics_queries.strategy_solve_rate(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
