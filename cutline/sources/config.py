"""Alias and sibling dimensions from their JSON configuration files.

Member names match in any case; a missing file is an empty table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline import fixed_values as fv
from cutline import schemas
from cutline.operators.links import with_json

_ALIASES = "aliases array<struct<brand:string,modelname:string,kbamodelseries:string>>"
_GROUPS = (
    "groups array<struct<groupid:string,platformname:string,"
    "members:array<struct<brand:string,modelname:string,notes:string>>>>"
)


def canonical(c, values):
    """The fixed spelling of an enumeration value given in any case, NULL when unknown."""
    spelled = F.when(F.lower(c) == values[0].lower(), values[0])
    for value in values[1:]:
        spelled = spelled.when(F.lower(c) == value.lower(), value)
    return spelled


def _read_document(spark: SparkSession, path: str, ddl: str) -> DataFrame | None:
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    document = with_json(text, F.col("value"), ddl, "config")
    if document.isEmpty():
        raise ValueError(f"not a valid configuration file: {path}")
    return document.select("config")


def read_aliases(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``(pos, brand, model_name, model_series)``; the bundled table without a path."""
    if path is None:
        return schemas.bundled_aliases(spark)
    document = _read_document(spark, path, _ALIASES)
    if document is None:
        return schemas.empty_frame(spark, schemas.ALIASES)
    return document.select(F.posexplode("config.aliases").alias("pos", "alias")).select(
        "pos",
        canonical(F.col("alias.brand"), fv.BRANDS).alias("brand"),
        F.col("alias.modelname").alias("model_name"),
        F.col("alias.kbamodelseries").alias("model_series"),
    )


def read_siblings(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``(group_pos, group_id, platform_name, brand, model_name)``; the bundled table without a path."""
    if path is None:
        return schemas.bundled_siblings(spark)
    document = _read_document(spark, path, _GROUPS)
    if document is None:
        return schemas.empty_frame(spark, schemas.SIBLINGS)
    groups = document.select(F.posexplode("config.groups").alias("group_pos", "g"))
    return groups.select("group_pos", "g.groupid", "g.platformname", F.explode("g.members").alias("m")).select(
        "group_pos",
        F.col("groupid").alias("group_id"),
        F.col("platformname").alias("platform_name"),
        canonical(F.col("m.brand"), fv.BRANDS).alias("brand"),
        F.col("m.modelname").alias("model_name"),
    )
