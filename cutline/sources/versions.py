"""Version entries of a store: one small file each, complete as soon as it is there, and never replaced.

A store writes its data beside the old data, then publishes one entry that names it.  Of several writers that started
from one version only one can publish the next; readers see the entry before or after, nothing in between.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutline import schemas

_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


class VersionTaken(RuntimeError):
    """Another writer published this version first; nothing of the store has changed for this writer's part."""


def publish(entry: DataFrame, folder: str, name: str) -> None:
    """Write the one row of ``entry`` as ``folder/name.json``; ``VersionTaken`` if that exists already.

    The row goes to a hidden file first, which then gets its name in one step that refuses an existing one: a rename
    without overwriting, which the shared file system decides, and a link in a local folder, where renaming is not
    exclusive.  On an object store without such a rename writers of one store must take turns.
    """
    spark = entry.sparkSession
    (line,) = entry.select(F.to_json(F.struct("*"), _JSON).alias("line")).first()
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.json")
    hidden = jvm.org.apache.hadoop.fs.Path(f"{folder}/_{name}-{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(hidden)
    out.write(bytearray(f"{line}\n".encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            _link(spark, hidden, target)
        else:
            _rename(spark, hidden, target)
    except Exception as error:
        if "FileAlreadyExistsException" not in str(error):
            raise
        raise VersionTaken(f"{target} already exists: another writer was first") from error
    finally:
        fs.delete(hidden, False)


def _link(spark: SparkSession, hidden, target) -> None:
    files, paths = spark._jvm.java.nio.file.Files, spark._jvm.java.nio.file.Paths
    none = spark._sc._gateway.new_array(spark._jvm.java.lang.String, 0)
    files.createLink(paths.get(target.toUri().getPath(), none), paths.get(hidden.toUri().getPath(), none))


def _rename(spark: SparkSession, hidden, target) -> None:
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark._sc._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context.rename(hidden, target, options)


def published(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All entries of a folder; empty when nothing was published yet."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("timestampFormat", _JSON["timestampFormat"])
    try:
        return reader.json(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return schemas.empty_frame(spark, schema)
