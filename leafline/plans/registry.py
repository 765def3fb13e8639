"""Names of the registered queries, with their equivalents in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafline.plans import decode_queries, evidence_queries, evidence_sql, layout_queries, layout_sql, review_queries, review_sql, source_queries, source_sql, structure_queries, structure_sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return layout_queries.QUERIES | evidence_queries.QUERIES | review_queries.QUERIES | structure_queries.QUERIES | source_queries.QUERIES | decode_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return layout_sql.ORACLES | evidence_sql.ORACLES | review_sql.ORACLES | structure_sql.ORACLES | source_sql.ORACLES | decode_queries.ORACLES
