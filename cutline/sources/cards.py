"""Card table: versioned parquet store, JSON sidecar scan, per-brand manifests.

A new version is written beside the old one and becomes current by one published entry, so a crash at any point
leaves the previous version readable.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutline import fixed_values as fv
from cutline import schemas
from cutline.functions.names import slug
from cutline.session import stored
from cutline.sources.config import canonical
from cutline.sources.versions import publish, published

_VERSIONS = schemas.struct_of("version bigint, path string")
_TIMESTAMPS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
_ENUMS = {
    "brand": fv.BRANDS,
    "status": fv.STATUSES,
    "parse_confidence": fv.CONFIDENCES,
    "bundle_priority": fv.PRIORITIES,
}
_CORRUPT = "_corrupt_record"


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(part.capitalize() for part in rest)


def camel_enum(c: Column) -> Column:
    """``MetadataOnly`` to ``metadataOnly``; all-capital names go lower as a whole."""
    first_down = F.concat(F.lower(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))
    return F.when(c == F.upper(c), F.lower(c)).otherwise(first_down)


def to_camel(df: DataFrame, enums=tuple(_ENUMS)) -> DataFrame:
    """Columns and enumeration values in the spelling of the JSON files."""
    return df.select(
        *[(camel_enum(F.col(c)) if c in enums else F.col(c)).alias(camel(c)) for c in df.columns]
    )


def _current_path(spark: SparkSession, root: str) -> tuple[int, str] | None:
    log = published(spark, f"{root}/versions", _VERSIONS)
    newest = log.agg(F.max("version").alias("version"), F.max_by("path", "version").alias("path")).first()
    return None if newest["path"] is None else (newest["version"], newest["path"])


def read_cards(spark: SparkSession, root: str) -> DataFrame:
    """Current card table; empty when nothing was written yet. Filters on ``brand`` prune partitions."""
    current = _current_path(spark, root)
    if current is None:
        return schemas.empty_frame(spark, schemas.CARDS)
    return _stored(spark, root, current[1])


def _stored(spark: SparkSession, root: str, path: str) -> DataFrame:
    schema = T.StructType([*schemas.CARDS.fields, T.StructField("model_slug", T.StringType())])
    return spark.read.schema(schema).parquet(f"{root}/{path}").select(*schemas.CARDS.names)


def current_version(spark: SparkSession, root: str) -> int:
    """Number of the version that ``read_cards`` reads now; 0 when nothing was written yet."""
    current = _current_path(spark, root)
    return current[0] if current else 0


def write_cards(cards: DataFrame, root: str, base: int | None = None) -> DataFrame:
    """Write the whole card table as the new current version and return it as stored.

    Files are laid out by brand; rebalancing keeps them even when one brand dominates.  ``base`` is the version the
    cards were made from, the current one if not given.  Of two writers that started from one version the second gets
    ``VersionTaken``, and so does a writer whose base is no longer the current version.
    """
    spark = cards.sparkSession
    version, path = (current_version(spark, root) if base is None else base) + 1, f"cards-{uuid.uuid4().hex}"
    (
        cards.select(*schemas.CARDS.names, slug(F.col("model_name")).alias("model_slug"))
        .hint("rebalance", F.col("brand"))
        .write.partitionBy("brand")
        .parquet(f"{root}/{path}")
    )
    publish(schemas.literal_frame(spark, [(version, path)], _VERSIONS), f"{root}/versions", str(version))
    return _stored(spark, root, path)


def write_manifests(cards: DataFrame, root: str, brands: Sequence[str] | None = None) -> None:
    """JSON lines of all cards, or those of some brands, one folder per brand, in the sidecar spelling.

    A brand's cards are never gathered into one document: any number of files may hold them.  Only the
    folders of brands with cards here are replaced.
    """
    chosen = cards if brands is None else cards.where(F.col("brand").isin(*brands))
    (
        to_camel(chosen.select(*schemas.CARDS.names))
        .hint("rebalance", F.col("brand"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("brand")
        .option("ignoreNullFields", False)
        .option("timestampFormat", _TIMESTAMPS)
        .json(f"{root}/manifest")
    )


#: While small files are listed and read: one counts as so many bytes when files are dealt out to tasks, so many tasks
#: list the folders, and the driver does not keep where each file lies.  By default a file counts as 4 MB, so a task reads
#: a few, and there may be 10,000 listing tasks.
_SMALL_FILES = {
    "spark.sql.files.openCostInBytes": "65536",
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "256",
    "spark.sql.sources.ignoreDataLocality": "true",
}


@contextmanager
def _many_files(spark: SparkSession) -> Iterator[None]:
    before = {key: spark.conf.get(key) for key in _SMALL_FILES}
    for key, value in _SMALL_FILES.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _sidecar_schema() -> T.StructType:
    fields = [T.StructField(camel(f.name), f.dataType) for f in schemas.CARDS.fields]
    return T.StructType([*fields, T.StructField(_CORRUPT, T.StringType())])


def read_card_sidecars(
    spark: SparkSession, root: str, names: str = "*.json", position: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(cards, corrupt)`` of a tree of one-card JSON files; ``position`` names a further column for a card's path.

    Names starting with an underscore (manifests) are skipped. An unreadable file, or one with
    an unknown enumeration value, goes to ``corrupt(file, content)``; the rest load.  The files are read here, once,
    by tasks of many files, and kept in the shared folder.
    """
    try:
        with _many_files(spark):
            scan = (
                spark.read.schema(_sidecar_schema())
                .option("multiLine", True)
                .option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", _CORRUPT)
                .option("recursiveFileLookup", True)
                .option("pathGlobFilter", names)
                .json(root)
            )
            read = stored(scan.select("*", F.col("_metadata.file_path").alias("_file")), "sidecar-rows")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        corrupt = schemas.struct_of("file string, content string")
        none = schemas.empty_frame(spark, schemas.CARDS)
        return none.withColumn(position, F.lit("")) if position else none, schemas.empty_frame(spark, corrupt)
    columns = [
        (canonical(F.col(camel(c)), _ENUMS[c]) if c in _ENUMS else F.col(camel(c))).alias(c)
        for c in schemas.CARDS.names
    ]
    bad = F.col(_CORRUPT).isNotNull()
    for name, values in _ENUMS.items():
        bad |= F.col(camel(name)).isNotNull() & canonical(F.col(camel(name)), values).isNull()
    rows = read.withColumn("_bad", F.coalesce(bad, F.lit(False)))
    return (
        rows.where(~F.col("_bad")).select(*columns, *([F.col("_file").alias(position)] if position else [])),
        rows.where(F.col("_bad")).select(F.col("_file").alias("file"), F.col(_CORRUPT).alias("content")),
    )
