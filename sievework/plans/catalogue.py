"""Every query of the engine by name, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievework.plans import model_plans, run_plans, source_plans, text_plans


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_plans.dataset_statistics(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return text_plans.QUERIES | model_plans.QUERIES | run_plans.QUERIES | source_plans.QUERIES


def oracle_sql() -> dict[str, str]:
    return text_plans.SQL | model_plans.SQL | run_plans.SQL | source_plans.SQL
