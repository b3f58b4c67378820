"""Predictions that arrive as files: parsed as they come, counted per error. The batch operators score them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import parse_prediction


def stream_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of parsed predictions from a folder of JSON lines (id, prediction)."""
    rows = spark.readStream.schema("id string, prediction string").json(folder)
    return rows.withColumn("r", parse_prediction(F.col("prediction"))).select("id", "r.*")


def error_counts(parsed: DataFrame) -> DataFrame:
    """Running counts per error ('none' for a valid line)."""
    return parsed.groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("n"))
