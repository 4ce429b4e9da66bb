"""Sharding by proportional stratified interleaving.

Rows of a source are shuffled by a seeded hash and ranked; rank ``r`` of ``n`` becomes the fraction
``(r - u) / n`` where ``u`` in [0, 1) is a seeded phase of the source, so that sources with few rows
do not all meet at the same place.  Sorted by the fraction, every stretch of the order holds the
sources in their proportion of the corpus, and cutting it into equal counts gives every shard the
mixture.

No source and no shard is gathered in one task.  Ranks are taken in two steps: a row's place in its
block (a fixed slice of the hash range, or of the fractions) by a window over that block, and the
number of rows in earlier blocks from a table of block counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutline.llm.common import stored

#: Rows of a block of an ordering, about, and the least number of blocks.  More blocks mean smaller sort tasks and a
#: longer table of counts; results are the same.
ROWS_A_BLOCK, LEAST_BLOCKS = 100_000, 4096


def _fraction(text: Column) -> Column:
    """The first 32 bits of an md5, as a fraction in [0, 1)."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def _ranked(rows: DataFrame, strata: list[str], block: str, order: list[str], rank: str, total: str) -> DataFrame:
    """Adds the rank from 1 within ``strata`` by (block, order), and the number of rows of the stratum."""
    counts = rows.groupBy(*strata, block).agg(F.count(F.lit(1)).alias("_count"))
    whole = Window.partitionBy(*strata)
    before = whole.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *strata,
        block,
        F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"),
        F.sum("_count").over(whole).alias(total),
    )
    local = F.row_number().over(Window.partitionBy(*strata, block).orderBy(*order))
    return (
        rows.withColumn("_local", local)
        .join(offsets, [*strata, block])
        .withColumn(rank, F.col("_before") + F.col("_local"))
        .drop("_local", "_before")
    )


def interleave(docs: DataFrame, shards: int, seed: str = "mixture", blocks: int | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, source) with its shard and its slot in the shard.

    Returns ``doc_id, size, text_crc32, source, shard, slot``.  Row counts of the shards differ by at
    most one; slots are gapless from 0.  A null text is empty; a null source is a stratum of its own;
    a null id ranks like an empty one.  Ties of the hash go by doc_id, checksum and size; rows equal in
    all of these are interchangeable.  An empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    narrow = stored(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("stratum"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.md5(F.concat(F.lit(f"{seed}:"), id_).cast("binary")).alias("shuffle"),
        ),
        "shards",
    )
    if blocks is None:
        blocks = max(LEAST_BLOCKS, narrow.count() // ROWS_A_BLOCK)
    block = F.floor(F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long") * blocks / F.lit(2**32))
    ranked = _ranked(
        narrow.withColumn("block", block), ["stratum"], "block", ["shuffle", "doc_id", "text_crc32", "size"], "rank", "rows"
    )
    phase = _fraction(F.concat(F.lit(f"{seed}/"), F.col("stratum")))
    fraction = (F.col("rank") - phase) / F.col("rows")
    placed = _ranked(
        ranked.withColumn("fraction", fraction).drop("block", "rows").withColumn("place", F.floor(F.col("fraction") * blocks)),
        [], "place", ["fraction", "stratum", "rank"], "position", "rows",
    )
    return placed.withColumn("shard", F.expr(f"cast((position - 1) * {shards} div rows as int)")).select(
        "doc_id", "size", "text_crc32", "source", "shard",
        F.expr(f"position - 1 - (shard * rows + {shards - 1}) div {shards}").alias("slot"),
    )
