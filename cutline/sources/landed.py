"""Readers of landed inputs, all with declared schemas (nothing is inferred)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cutline import schemas


def read_landed(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options) -> DataFrame:
    return spark.read.schema(schema).options(**options).format(fmt).load(path)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_landed(spark, path, schemas.PAGES, fmt)


def read_feeds(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_landed(spark, path, schemas.FEEDS, fmt)


def read_fetch_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_landed(spark, path, schemas.FETCH_LOG, fmt)


def read_pdf_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_landed(spark, path, schemas.PDF_PAGES, fmt)


def read_sheet_cells(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Cell table of landed workbooks; for CSV pass e.g. ``header="true"``."""
    return read_landed(spark, path, schemas.SHEET_CELLS, fmt, **options)
