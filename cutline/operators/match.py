"""Matching cards to fleet counts, and sibling groups.

Everything a card can match is first folded into one lookup table with a unique
(brand, key): direct series, then aliases for keys without a direct series.  Cards
need a single left equi-join on it.  The lookup is as small as the stock table it
comes from; Spark broadcasts it while its size stays under the session's threshold
and otherwise shuffles, with adaptive execution splitting hot names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline import fixed_values as fv
from cutline.functions.names import norm_name, not_blank
from cutline.functions.status import tier


def match_key(name: Column) -> Column:
    """Normalised name; blank names have no key and never match."""
    return F.when(not_blank(name), norm_name(name))


def _join_key(df: DataFrame) -> Column:
    """Match key for the card side of a join. Rows without one get keys no series can have,
    spread by their content, or a shuffle would send all of them to one task."""
    nowhere = F.concat(F.lit("-"), F.xxhash64(*df.columns))
    return F.coalesce(match_key(F.col("model_name")), nowhere)


def brands_of_stock(stock: DataFrame, labels: DataFrame) -> DataFrame:
    """Stock rows with every brand their label stands for; one row may fan out."""
    by_label = labels.select("brand", norm_name(F.col("label")).alias("_label")).distinct()
    return stock.withColumn("_label", norm_name(F.col("brand_label"))).join(by_label, "_label").drop("_label")


def stock_index(stock: DataFrame, labels: DataFrame) -> DataFrame:
    """``(brand, series_key, count)``: the first stock row in file order per brand and series.

    Several workbooks follow each other by name, rows without one first; of rows at one place the smallest count wins.
    """
    place = F.struct(*[c for c in ("book", "row_no", "count") if c in stock.columns])
    return (
        brands_of_stock(stock, labels)
        .groupBy("brand", norm_name(F.col("model_series")).alias("series_key"))
        .agg(F.min_by("count", place).alias("count"))
    )


def alias_targets(aliases: DataFrame) -> DataFrame:
    """``(brand, name_key, series_key)``: the first alias in list order per brand and name."""
    return (
        aliases.groupBy("brand", norm_name(F.col("model_name")).alias("name_key"))
        .agg(F.min_by("model_series", "pos").alias("model_series"))
        .select("brand", "name_key", norm_name(F.col("model_series")).alias("series_key"))
    )


def fleet_lookup(index: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(brand, name_key, fleet, via_alias)``: direct series win; an alias to an absent series is no match.

    One pass over the index: every series answers to its own key and, one rank lower, to the
    keys of its aliases; the best rank per key is kept.
    """
    answers = F.array(
        F.struct(F.col("series_key").alias("name_key"), F.lit(0).alias("rank")),
        F.struct("name_key", F.lit(1).alias("rank")),
    )
    return (
        index.join(alias_targets(aliases), ["brand", "series_key"], "left")
        .select("brand", "count", F.explode(answers).alias("answer"))
        .where(F.col("answer.name_key").isNotNull())
        .groupBy("brand", F.col("answer.name_key").alias("name_key"))
        .agg(F.min_by("count", "answer.rank").alias("fleet"), (F.min("answer.rank") == 1).alias("via_alias"))
    )


def attach_fleet(
    names: DataFrame, lookup: DataFrame, high: int = fv.HIGH_THRESHOLD, medium: int = fv.MEDIUM_THRESHOLD
) -> DataFrame:
    """Add fleet size, tier and ``matched_via_alias`` to rows carrying brand and model_name."""
    columns = [c for c in names.columns if c not in ("estimated_fleet_size", "bundle_priority")]
    matched = names.select(*columns, _join_key(names).alias("name_key")).join(
        lookup, ["brand", "name_key"], "left"
    )
    return matched.select(
        *columns,
        F.col("fleet").cast("int").alias("estimated_fleet_size"),
        tier(F.col("fleet"), high, medium).alias("bundle_priority"),
        F.coalesce("via_alias", F.lit(False)).alias("matched_via_alias"),
    )


def match_fleet(
    cards: DataFrame,
    stock: DataFrame,
    labels: DataFrame,
    aliases: DataFrame,
    high: int = fv.HIGH_THRESHOLD,
    medium: int = fv.MEDIUM_THRESHOLD,
) -> DataFrame:
    """Cards with their fleet size and tier; unmatched cards stay, as Unknown."""
    return attach_fleet(cards, fleet_lookup(stock_index(stock, labels), aliases), high, medium)


def attach_siblings(cards: DataFrame, siblings: DataFrame, out: str = "sibling_model_ids") -> DataFrame:
    """Add the ids of all sibling groups containing a card's model, in configuration order."""
    groups = (
        siblings.groupBy("brand", norm_name(F.col("model_name")).alias("name_key"))
        .agg(F.array_sort(F.collect_set(F.struct("group_pos", "group_id"))).alias("_groups"))
        .select("brand", "name_key", F.col("_groups.group_id").alias("_ids"))
    )
    columns = [c for c in cards.columns if c != out]
    none = F.array().cast("array<string>")
    return (
        cards.select(*columns, _join_key(cards).alias("name_key"))
        .join(groups, ["brand", "name_key"], "left")
        .select(*columns, F.coalesce("_ids", none).alias(out))
    )
