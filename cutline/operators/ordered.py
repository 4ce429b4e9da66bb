"""Order-dependent operators: first wins, last wins, ranks, fill-down.

Rows have no order in Spark, so every operator takes an explicit position.  First
and last pick are aggregates rather than windows: they combine on the map side, so
a key holding a third of all rows reaches its reducer as one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutline.session import stored


def _pick(df: DataFrame, keys: Sequence[str], position: Column, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    # A position inside a struct is never NULL itself, so no row is ignored.
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(position)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def first_by(df: DataFrame, keys: Sequence[str], position: Column) -> DataFrame:
    """One row per key, the one with the lowest position."""
    return _pick(df, keys, position, F.min_by)


def latest_by(df: DataFrame, keys: Sequence[str], position: Column) -> DataFrame:
    """One row per key, the one with the highest position (last write wins)."""
    return _pick(df, keys, position, F.max_by)


def first_and_latest_by(df: DataFrame, keys: Sequence[str], position: Column) -> DataFrame:
    """One row per key with the rows of its lowest and highest position as structs ``first`` and ``latest``: one aggregate."""
    row, at = F.struct(*[c for c in df.columns if c not in keys]), F.struct(position)
    return df.groupBy(*keys).agg(F.min_by(row, at).alias("first"), F.max_by(row, at).alias("latest"))


def _numbered(df: DataFrame, order: Sequence[str | Column], at: str) -> DataFrame:
    """``df`` stored with a number for each row that grows along ``order``, over all partitions.

    Range partitions are sorted each on its own; the upper bits of a number are its range, the lower ones count its
    rows from 0.  No task holds more than its range, however the rows are spread over the keys and positions.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranges.withColumn(at, F.monotonically_increasing_id()), "numbered")


#: Lower bits of a number of ``_numbered``: the place of a row in its range.
_PLACE_BITS = 33


def global_rank(df: DataFrame, order: Sequence[str | Column], rank: str = "rank") -> DataFrame:
    """``df`` with the rank from 1 of every row in the order of the whole table; equal rows rank in any order.

    The place of a row in its range plus the number of rows in all ranges before it.  Only the range counts, one row
    for each shuffle partition, are walked in one window.
    """
    rows = _numbered(df, order, "_at")
    range_ = F.shiftright("_at", _PLACE_BITS).alias("_range")
    place = F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(range_).agg(F.count(F.lit(1)).alias("_count"))
    offsets = counts.select("_range", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"))
    return (
        rows.withColumn("_range", range_)
        .join(offsets, "_range")
        .withColumn(rank, F.col("_before") + place + 1)
        .select(*[c for c in df.columns if c != rank], rank)
    )


def fill_down(
    df: DataFrame, keys: Sequence[str], position: str, value: str, block_rows: int = 65_536
) -> DataFrame:
    """Carry the last non-NULL value forward over the rows of a key.

    Rows are numbered in the order of (keys, position) by range partitions, so how positions are spread, and how many
    rows a key has, does not matter.  A block is ``block_rows`` consecutive numbers.  It is reduced to one row, its
    first and last key and the last value of the latter (a combining aggregate), and what a block inherits enters it
    as one leading row, so that one window inside the block fills it.  More blocks than a block may hold rows are
    filled the same way, as rows.  No window holds more than ``block_rows`` rows and a leading one.  Rows with equal
    positions follow each other in any order; NULL keys are one key.
    """
    key = F.struct(*keys)
    rows = _numbered(df, [*keys, position], "_at").withColumn("_block", F.floor(F.col("_at") / block_rows))
    set_ = F.max_by(F.struct(key.alias("key"), F.col(value).alias("value")), F.when(F.col(value).isNotNull(), F.col("_at")))
    ends = rows.groupBy("_block").agg(
        F.min_by(key, "_at").alias("_first"), F.max_by(key, "_at").alias("_key"), set_.alias("_set")
    )
    own = F.when(F.col("_set.key").eqNullSafe(F.col("_key")), F.col("_set.value"))
    blocks = stored(ends.select("_block", "_first", "_key", own.alias("_last")), "blocks")
    if blocks.count() <= block_rows:
        walk = Window.orderBy("_block")
        upto = blocks.withColumn("_last", F.last("_last", ignorenulls=True).over(Window.partitionBy("_key").orderBy("_block")))
        before = upto.withColumn("_before", F.lag(F.struct("_key", "_last")).over(walk))
    else:
        upto = fill_down(blocks.withColumnRenamed("_block", "_pos"), ["_key"], "_pos", "_last", block_rows)
        upto = global_rank(upto.withColumnRenamed("_pos", "_block"), ["_block"], "_number")
        earlier = upto.select((F.col("_number") + 1).alias("_number"), F.struct("_key", "_last").alias("_before"))
        before = upto.join(earlier, "_number")
    inherited = before.where(F.col("_before._key").eqNullSafe(F.col("_first")) & F.col("_before._last").isNotNull())
    leading = inherited.select(*[F.col(f"_first.{k}").alias(k) for k in keys], "_block", F.col("_before._last").alias(value))
    inside = Window.partitionBy(*keys, "_block").orderBy(F.col("_at").asc_nulls_first())
    return (
        rows.unionByName(leading, allowMissingColumns=True)
        .withColumn(value, F.last(value, ignorenulls=True).over(inside))
        .where(F.col("_at").isNotNull())
        .select(*df.columns)
    )


def unambiguous_links(
    links: DataFrame,
    keys: Sequence[str],
    is_wanted: Column,
    href: str = "href",
    position: str = "pos",
) -> DataFrame:
    """First wanted link per item, unless the item uses its href under another label too.

    Two combining aggregates: per (item, href), then per item.
    """
    wanted = F.coalesce(is_wanted, F.lit(False))
    per_href = links.groupBy(*keys, href).agg(
        F.min(F.when(wanted, F.col(position))).alias("_wanted_at"),
        F.count_if(~wanted).alias("_other_labels"),
    )
    first = (
        per_href.where(F.col("_wanted_at").isNotNull())
        .groupBy(*keys)
        .agg(F.min_by(F.struct(href, F.col("_wanted_at").alias(position), "_other_labels"), "_wanted_at").alias("_first"))
    )
    return first.where(F.col("_first._other_labels") == 0).select(
        *keys, F.col(f"_first.{href}").alias(href), F.col(f"_first.{position}").alias(position)
    )
