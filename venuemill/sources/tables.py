"""Reading and writing stage tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from venuemill import schemas
from venuemill.operators.ranking import row_number_in_groups
from venuemill.sources import json_arrays


def load_articles(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Article arrays as JSON with the fixed schema; a missing path is empty.

    ``pos`` counts the rows by file path and place in the file, also over several files.
    ``multi_line`` reads files that are JSON arrays, by byte ranges; otherwise they have one record a line."""
    if multi_line and json_arrays.reachable(path):
        placed = json_arrays.read_json_arrays(spark, path, schemas.ARTICLE)
        counted = row_number_in_groups(placed, [], [F.asc("_file"), F.asc("_place")], "pos")
        return counted.withColumn("pos", F.col("pos").cast("long") - 1).drop("_file", "_place")
    rows = _load(spark, path, schemas.ARTICLE, multi_line)
    if rows.isEmpty():
        return rows.withColumn("pos", F.lit(0).cast("long"))
    placed = rows.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row")
    )
    counted = row_number_in_groups(placed, [], [F.asc("_file"), F.asc("_block"), F.asc("_row")], "pos")
    return counted.withColumn("pos", F.col("pos").cast("long") - 1).drop("_file", "_block", "_row")


def load_json(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    if multi_line and json_arrays.reachable(path):
        return json_arrays.read_json_arrays(spark, path, schema).drop("_file", "_place")
    return _load(spark, path, schema, multi_line)


def _load(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    try:
        return spark.read.schema(schema).option("multiLine", multi_line).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def save_articles(df: DataFrame, path: str) -> None:
    df.drop("pos").write.mode("overwrite").json(path)


def load_stage(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """A Parquet stage table; None, or an empty table with ``schema``, when missing."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema) if schema is not None else None


def save_stage(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_serving(serving: DataFrame, path: str) -> None:
    """Compact JSON, one folder per category, sorted by rank within files."""
    (
        serving.repartitionByRange("category", "rank", "idx")
        .sortWithinPartitions("category", "rank", "idx")
        .write.mode("overwrite").partitionBy("category").json(path)
    )


def save_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)
