"""Registry of the engine's queries and of the DuckDB statements that state the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.plans import evaluation, fields, layouts, monitoring, operations, pipelines, results, verification

MODULES = [fields, layouts, verification, results, evaluation, operations, pipelines, monitoring]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.invoice_fields(spark, sf_dir)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
