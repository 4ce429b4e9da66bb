"""Stock table, one folder for each load of a year, with its warnings and provenance."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutline import fixed_values as fv
from cutline import schemas
from cutline.operators.ordered import latest_by
from cutline.operators.sheet import reference_date
from cutline.sources.versions import publish, published

_LOG = T.StructType([*schemas.STOCK_META.fields, *schemas.struct_of("version bigint, path string").fields])


def write_stock(
    rows: DataFrame, warnings: DataFrame, root: str, year: int, source_url: str, now: Column | None = None
) -> DataFrame:
    """Replace one year of the stock table and return its provenance row.

    Rows and warnings go to a folder of their own.  The provenance row is published last, counts what was stored and
    names the folder, so readers see the year as it was until all of it is complete.  Of two loads of one year that ran
    at the same time the second gets ``VersionTaken``; loads of different years do not meet.
    """
    spark = rows.sparkSession
    now = F.current_timestamp() if now is None else now
    path = f"stock-{uuid.uuid4().hex}"
    earlier = _log(spark, root).where(F.col("year") == year).agg(F.max("version").alias("version")).first()["version"] or 0
    if "book" not in rows.columns:
        rows = rows.withColumn("book", F.lit(None).cast("string"))
    for df, schema, name in ((rows, schemas.STOCK_OF_BOOKS, "rows"), (warnings, schemas.STOCK_WARNINGS, "warnings")):
        df.select(*[c for c in schema.names if c != "year"]).write.parquet(f"{root}/{path}/{name}")
    counts = (
        spark.read.parquet(f"{root}/{path}/rows").select(F.lit(1).alias("row"), F.lit(0).alias("warning"))
        .unionByName(spark.read.parquet(f"{root}/{path}/warnings").select(F.lit(0).alias("row"), F.lit(1).alias("warning")))
        .agg(
            F.coalesce(F.sum("row"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum("warning"), F.lit(0)).alias("warning_count"),
        )
    )
    entry = counts.select(
        F.lit(year).cast("int").alias("year"),
        reference_date(F.lit(year)).alias("reference_date"),
        F.lit(source_url).alias("source_url"),
        F.lit(fv.STOCK_LICENSE).alias("license"),
        now.alias("fetched_at_utc"),
        "row_count",
        "warning_count",
        F.lit(earlier + 1).cast("long").alias("version"),
        F.lit(path).alias("path"),
    )
    publish(entry, f"{root}/loads", f"{year}-{earlier + 1}")
    return read_stock_meta(spark, root).where(F.col("year") == year)


def _log(spark: SparkSession, root: str) -> DataFrame:
    """The newest provenance row of every year, with its version and folder."""
    log = published(spark, f"{root}/loads", _LOG)
    return latest_by(log, ["year"], F.col("version"))


def read_stock_meta(spark: SparkSession, root: str) -> DataFrame:
    return _log(spark, root).select(*schemas.STOCK_META.names)


def latest_year(meta: DataFrame) -> DataFrame:
    """Top-1: the largest stored year."""
    return meta.agg(F.max("year").alias("year"))


def read_stock(spark: SparkSession, root: str, year: int | None = None) -> tuple[int, DataFrame] | None:
    """``(year, rows)`` of the given or latest year; None when that year is not stored.

    An older year never stands in for a missing one.
    """
    log = _log(spark, root)
    if year is not None:
        log = log.where(F.col("year") == year)
    newest = log.agg(F.max_by(F.struct("year", "path"), "year").alias("newest")).first()["newest"]
    if newest is None:
        return None
    stored = T.StructType([f for f in schemas.STOCK_OF_BOOKS.fields if f.name != "year"])
    rows = spark.read.schema(stored).parquet(f"{root}/{newest['path']}/rows").withColumn("year", F.lit(newest["year"]).cast("int"))
    return newest["year"], rows.select(*schemas.STOCK_OF_BOOKS.names)
