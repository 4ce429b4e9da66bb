"""What several of these operators share: reading, storing, cutting Arrow batches, splitting by id."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.session import scratch_path

#: Text bytes that one step of a Python task works on at a time.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def stored(df: DataFrame, name: str, batch_bytes: int | None = None, codec: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, safe from lost executors.

    ``batch_bytes`` bounds the Arrow batches that Python tasks get meanwhile; a batch is held twice, by the JVM and by Python.
    ``codec`` is the compression of the files, the session's if not given.
    """
    path, conf = scratch_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(_BATCH_BYTES)
    if batch_bytes is not None:
        conf.set(_BATCH_BYTES, str(batch_bytes))
    try:
        (df.write if codec is None else df.write.option("compression", codec)).parquet(path)
    finally:
        conf.set(_BATCH_BYTES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What operators keep in a Python worker from one task to the next; workers are used again by whatever runs after.
CACHES: list[dict] = []


def vacate(keep: dict | None = None) -> None:
    """Empties the caches that earlier operators left in this Python worker, and gives the memory back to the machine."""
    for cache in CACHES:
        if cache is not keep:
            cache.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_bytes(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the text as UTF-8 bytes (null: empty); every other column is left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def remainder(id_: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % modulus


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``limit`` bytes of ``column`` each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // limit)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            if end > start:
                yield batch.slice(start, end - start)


#: A key is hot from this many rows, and from a thousandth of all rows, so there are at most a thousand hot ones.
HOT_ROWS, HOT_KEYS = 10_000, 1_000


def looked_up(rows: DataFrame, lookup: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` (stored) left joined with ``lookup``, which has each of its ``keys`` once.

    A join by shuffle sends all rows of a key to one task.  Keys of more than ``hot_rows`` rows and more than a
    thousandth of all rows are therefore looked up in a broadcast of their entries, a thousand at most.
    """
    counts = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = counts.where(F.col("_rows") > max(hot_rows, rows.count() // HOT_KEYS)).select(*keys)
    if hot.isEmpty():
        return rows.join(lookup, keys, "left")
    hot = F.broadcast(stored(hot, "hot-keys"))
    few = F.broadcast(stored(lookup.join(hot, keys, "left_semi"), "hot-entries"))
    return (
        rows.join(hot, keys, "left_semi").join(few, keys, "left")
        .unionByName(rows.join(hot, keys, "left_anti").join(lookup, keys, "left"))
    )
