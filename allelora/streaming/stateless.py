"""Variant streams: the record-at-a-time operators on a growing folder, and counts per window of load time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelora.operators import filterlang, stats


def read(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def filtered(stream: DataFrame, text: str) -> DataFrame:
    """Filter expression and allele statistics: no state, so it works on streams and tables alike."""
    return stats.with_allele_stats(stream.where(filterlang.compile_filter(text)))


def arrivals(stream: DataFrame, late: str = "30 days", window: str = "1 day") -> DataFrame:
    """Rows per load and window of loaded_at; rows later than ``late`` behind the newest are left out."""
    return stream.withWatermark("loaded_at", late).groupBy(F.window("loaded_at", window).alias("w"), "load_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "load_id", "n")
