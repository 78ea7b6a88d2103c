"""Every registered query of the path-network engine with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .queries import base, domain, geometry, graph, ingest, routes, scoring, serving  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.QUERIES["distance_by_kind"](spark, sf_dir)


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
