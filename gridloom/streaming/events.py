"""Streaming forms: aggregates of formulas over event-time windows, and formula columns on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.compiler import formula_column, outputs, with_formulas


def read_events(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A file stream with the schema of what is there already."""
    return spark.readStream.schema(spark.read.parquet(path).schema).options(**options).parquet(path)


def windowed(df: DataFrame, time: str, width: str, formulas: dict[str, str], by: list[str] | None = None, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Formulas of aggregates per window; with a watermark, so that state is bounded and late rows have a limit."""
    made = {k: formula_column(df, f) for k, f in formulas.items()}
    timed = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if df.isStreaming else df
    return timed.groupBy(F.window(time, width, slide), *(by or [])).agg(*outputs(made, False)).select(F.col("window.start").alias("window_start"), *(by or []), *formulas)


__all__ = ["read_events", "windowed", "with_formulas"]
