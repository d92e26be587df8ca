"""The library's queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from allelora.plans import pipeline, variants


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return variants.QUERIES | pipeline.QUERIES


def oracle() -> dict[str, str]:
    return variants.SQL | pipeline.SQL


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return variants.export_pipeline(spark, d)
