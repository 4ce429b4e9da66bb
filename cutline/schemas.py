"""Explicit schemas of every landed and produced table, and the small dimensions.

Dimensions are built from Arrow tables, which Spark plans as a ``LocalRelation``
of known size: the optimizer can prove they are small and broadcasts them on its
own, under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cutline import fixed_values as fv


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def struct_of(columns: str) -> T.StructType:
    """Flat schema from ``name type, ...``; unlike Spark's own parser it needs no session."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[type_]) for name, type_ in pairs])


PARSED = struct_of(
    "model_name string, variant string, body_type string, build_year_from int, build_year_to int, "
    "doors int, fuel_type string, language_code string, parse_confidence string"
)

PAGES = struct_of("url string, html string")
FEEDS = struct_of("url string, json string")
FETCH_LOG = struct_of(
    "url string, http_status int, reason string, content_type string, error string, "
    "timed_out boolean, fetched_at timestamp"
)
PDF_PAGES = struct_of("source_doc string, page_no int, text string")
SHEET_CELLS = struct_of(
    "book string, year int, sheet string, sheet_pos int, row_no int, col_no int, cell_type string, value string"
)

ENTRIES = (
    T.StructType()
    .add("brand", T.StringType())
    .add("source_page_url", T.StringType())
    .add("download_url", T.StringType())
    .add("raw_label", T.StringType())
    .add("entry_pos", struct_of("page bigint, link bigint"))
    .add("parsed", PARSED)
)

CARDS = struct_of(
    "id string, brand string, model_name string, variant string, body_type string, build_year_from int, "
    "build_year_to int, doors int, fuel_type string, language_code string, status string, "
    "source_page_url string, download_url string, failure_reason string, parse_confidence string, "
    "discovered_at_utc timestamp, downloaded_at_utc timestamp, local_pdf_relative_path string, "
    "sibling_model_ids array<string>, estimated_fleet_size int, bundle_priority string"
)

STOCK = struct_of("year int, row_no int, segment string, brand_label string, model_series string, count int")
#: As stored: ``book`` tells the workbooks of one year apart (NULL where a load does not name them).
STOCK_OF_BOOKS = struct_of("year int, row_no int, segment string, brand_label string, model_series string, count int, book string")
STOCK_WARNINGS = struct_of("year int, row_no int, warning string")
STOCK_META = struct_of(
    "year int, reference_date date, source_url string, license string, fetched_at_utc timestamp, "
    "row_count bigint, warning_count bigint"
)

ALIASES = struct_of("pos int, brand string, model_name string, model_series string")
SIBLINGS = struct_of("group_pos int, group_id string, platform_name string, brand string, model_name string")
REPORT = struct_of(
    "brand string, model_name string, card_count bigint, not_downloaded_count bigint, "
    "estimated_fleet_size int, bundle_priority string"
)
BRAND_RUNS = struct_of("brand string, outcome string, note string")


def literal_frame(spark: SparkSession, rows: Iterable[Sequence], schema: T.StructType) -> DataFrame:
    """A small driver-side table, planned as a LocalRelation with a known size."""
    columns = list(zip(*rows)) or [()] * len(schema)
    arrow_schema = to_arrow_schema(schema)
    arrays = [pa.array(list(values), type=field.type) for values, field in zip(columns, arrow_schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow_schema), schema=schema)


def empty_frame(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return literal_frame(spark, [], schema)


def brand_dim(spark: SparkSession) -> DataFrame:
    return literal_frame(spark, [(b, i) for i, b in enumerate(fv.BRANDS)], struct_of("brand string, ordinal int"))


def priority_dim(spark: SparkSession) -> DataFrame:
    return literal_frame(
        spark, [(p, i) for i, p in enumerate(fv.PRIORITIES)], struct_of("bundle_priority string, ordinal int")
    )


def brand_labels(spark: SparkSession) -> DataFrame:
    return literal_frame(spark, fv.BRAND_LABELS, struct_of("brand string, label string"))


def bundled_aliases(spark: SparkSession) -> DataFrame:
    return literal_frame(spark, [(i, *row) for i, row in enumerate(fv.MODEL_ALIASES)], ALIASES)


def bundled_siblings(spark: SparkSession) -> DataFrame:
    rows = [
        (pos, group_id, platform, brand, model)
        for pos, (group_id, platform, members) in enumerate(fv.SIBLING_GROUPS)
        for brand, model in members
    ]
    return literal_frame(spark, rows, SIBLINGS)


def unknown_baselines(spark: SparkSession) -> DataFrame:
    return literal_frame(spark, fv.UNKNOWN_BASELINES, struct_of("brand string, baseline int"))
