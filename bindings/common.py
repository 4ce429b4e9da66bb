"""Shared inputs of the registered queries.

Catalogue tables are derived row by row from the given star-schema tables.  The derivation
expressions are plain SQL both engines understand, so Spark and the SQL check start from
the same rows; what the operators then compute is written out independently in each check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Table rows that become documents in one task.
SPREAD_ROWS = 4_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(df: DataFrame, **columns: str) -> DataFrame:
    """Columns given as SQL expressions over ``df``."""
    return df.select(*[F.expr(sql).alias(name) for name, sql in columns.items()])


def spread(df: DataFrame, rows: int = SPREAD_ROWS, *keys: str) -> DataFrame:
    """``df`` dealt out, by ``keys`` if there are any, so that a task gets about ``rows`` of its rows.

    For tables whose narrow rows become whole documents: by bytes, Spark would read millions of them in one task.
    """
    return df.repartition(-(-df.count() // rows) or 1, *keys)


def sql_columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


# File-name parts of a part row.
YEAR_TOKEN = (
    "CASE WHEN p_partkey % 5 = 0 THEN concat(1950 + p_size, '-', 1955 + p_size) "
    "WHEN p_partkey % 5 = 1 THEN 'old' ELSE concat('', 1950 + p_size) END"
)
YEAR_FROM = "CASE WHEN p_partkey % 5 = 1 THEN NULL ELSE CAST(1950 + p_size AS INT) END"
YEAR_TO = "CASE WHEN p_partkey % 5 = 0 THEN CAST(1955 + p_size AS INT) END"
DOORS_TOKEN = "CASE WHEN p_partkey % 4 = 0 THEN 'many' ELSE concat(2 + p_partkey % 4, 'd') END"
DOORS = "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(2 + p_partkey % 4 AS INT) END"
LANG_TOKEN = "CASE WHEN p_partkey % 3 = 0 THEN 'de' WHEN p_partkey % 3 = 1 THEN 'EN' ELSE 'deu' END"
LANG = "CASE WHEN p_partkey % 3 = 0 THEN 'DE' WHEN p_partkey % 3 = 1 THEN 'EN' END"
CONFIDENCE = (
    "CASE WHEN p_partkey % 5 = 1 AND p_partkey % 4 = 0 THEN 'Unparsed' "
    "WHEN p_partkey % 5 <> 1 AND p_partkey % 4 <> 0 AND p_partkey % 3 <> 2 THEN 'High' ELSE 'Heuristic' END"
)
FILE_NAME = (
    f"concat('Maker_', replace(p_name, ' ', '_'), '_', p_type, '_', {YEAR_TOKEN}, '_', {DOORS_TOKEN}, "
    f"'_GD_', {LANG_TOKEN}, '.pdf')"
)
MODEL = "split_part(p_name, ' ', 1)"
VARIANT = "split_part(p_name, ' ', 2)"

# One German and one English file per part, for page extractors.
GERMAN_FILE = (
    "concat('Maker_', replace(p_name, ' ', '_'), '_', p_type, '_', 1950 + p_size, '_', 2 + p_partkey % 4, 'd_GD_DE.pdf')"
)
ENGLISH_FILE = (
    "concat('Maker_', replace(p_name, ' ', '_'), '_', p_type, '_', 1950 + p_size, '_', 2 + p_partkey % 4, 'd_GD_EN.pdf')"
)

# Flat columns of discovered entries, and the same list for the SQL side.
ENTRY_COLUMNS = (
    "brand", "source_page_url", "download_url", "raw_label", "page", "link", "model_name", "variant", "body_type",
    "build_year_from", "build_year_to", "doors", "fuel_type", "language_code", "parse_confidence",
)


def flat_entries(entries: DataFrame) -> DataFrame:
    return entries.select("*", "entry_pos.page", "entry_pos.link", "parsed.*").select(*ENTRY_COLUMNS)


def entry_sql(source: str, **columns: str) -> str:
    """SELECT of all entry columns, NULL where no expression is given."""
    types = dict.fromkeys(("page", "link"), "BIGINT") | dict.fromkeys(("build_year_from", "build_year_to", "doors"), "INTEGER")
    return "SELECT " + ", ".join(
        f"CAST({columns.get(c, 'NULL')} AS {types.get(c, 'VARCHAR')}) AS {c}" for c in ENTRY_COLUMNS
    ) + f" FROM {source}"
