"""All queries of the engine by name, and the SQL to check them with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import extra_plans, job_plans, more_plans, request_plans, search_plans, text_plans

_ALL = {**search_plans.QUERIES, **text_plans.QUERIES, **job_plans.QUERIES, **more_plans.QUERIES, **extra_plans.QUERIES, **request_plans.QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_plans.filtered_search(spark, sf_dir)


def queries() -> dict:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
