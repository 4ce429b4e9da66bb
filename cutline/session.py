"""Session helpers: shared folder, stored tables, checkpoints and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_SIDE_ROWS = 100_000
SMALL_SIDE_BYTES = 64 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (``spark.checkpoint.dir``); a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="cutline-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, read by column, safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Computed now, kept in the shared folder: lost executors never recompute it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = SMALL_SIDE_ROWS, max_bytes: int = SMALL_SIDE_BYTES) -> DataFrame:
    """Broadcast a join side after measuring that it stays under both bounds.

    For sides Spark cannot size itself, such as rows exploded out of one page.  The side is
    checkpointed first, so neither the measuring nor the joins extract it again.  A larger
    side joins by shuffle.
    """
    kept = checkpointed(df)
    texts = [F.coalesce(F.octet_length(name), F.lit(0)) for name, type_ in kept.dtypes if type_ == "string"]
    row_bytes = sum(texts, F.lit(8 * len(kept.columns)))
    size = kept.agg(F.count(F.lit(1)).alias("rows"), F.sum(row_bytes).alias("bytes")).first()
    if size["rows"] > max_rows or (size["bytes"] or 0) > max_bytes:
        return kept
    return F.broadcast(kept)
