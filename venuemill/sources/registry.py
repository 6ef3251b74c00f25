"""The source dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from venuemill import fixed_values as V

SCHEMA = (
    "id string, name string, url string, prestige string, collection_method string, "
    "scale_min double, scale_max double, sub_scores array<string>, content_types array<string>, "
    "coverage array<string>, country string, enabled boolean"
)


def all_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.SOURCE_DEFINITIONS, SCHEMA)


def enabled_sources(spark: SparkSession) -> DataFrame:
    return all_sources(spark).where("enabled")


def source(spark: SparkSession, source_id: str) -> DataFrame:
    return all_sources(spark).where(F.col("id") == source_id)


def source_ids(spark: SparkSession) -> DataFrame:
    return all_sources(spark).select("id")
