"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioforge.plans import coordinates, documents, extracts, pages, regulations, relations, repairs, retrieval, service, tabular

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {**documents.QUERIES, **regulations.QUERIES, **tabular.QUERIES, **service.QUERIES, **pages.QUERIES, **relations.QUERIES, **repairs.QUERIES, **extracts.QUERIES, **retrieval.QUERIES, **coordinates.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**documents.ORACLES, **regulations.ORACLES, **tabular.ORACLES, **service.ORACLES, **pages.ORACLES, **relations.ORACLES, **repairs.ORACLES, **extracts.ORACLES, **retrieval.ORACLES, **coordinates.ORACLES}
