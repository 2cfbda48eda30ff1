"""Readers with fixed schemas.  Columns a job does not select are never read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from sitelens import schemas


def read(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read(spark, path, schemas.PAGES, fmt)


def fetches(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read(spark, path, schemas.FETCHES, fmt)


def robots_files(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read(spark, path, schemas.ROBOTS_FILES, fmt)


def sitemap_files(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read(spark, path, schemas.SITEMAP_FILES, fmt)


def hops(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read(spark, path, schemas.HOPS, fmt)


def navigations(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read(spark, path, schemas.NAVIGATIONS, fmt)


def nav_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read(spark, path, schemas.NAV_EVENTS, fmt)


def nav_event_stream(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int = 1_000
) -> DataFrame:
    """Files are taken in bounded batches, so a tab's share of a batch is bounded too."""
    return (
        spark.readStream.schema(schemas.NAV_EVENTS)
        .option("maxFilesPerTrigger", files_per_batch)
        .format(fmt)
        .load(path)
    )
