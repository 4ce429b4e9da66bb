"""Priority report, priority distribution and run summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline import fixed_values as fv
from cutline.functions.status import short_note
from cutline.operators.match import attach_fleet

_COUNTS = ("card_count", "not_downloaded_count")


def _counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("card_count"),
        F.count_if(F.col("status") != "Downloaded").alias("not_downloaded_count"),
    ]


def assert_consistent(grouped_keys: Sequence[str], low: Column, high: Column) -> Column:
    """NULL when the smallest and largest match of a group are the same, else an error.

    Comparing the two extremes costs two combining aggregates; counting distinct pairs
    would need a second shuffle of the pairs.
    """
    name = F.concat_ws("/", *[F.coalesce(F.col(k), F.lit("")) for k in grouped_keys])
    text = F.concat(F.lit("Cards of "), name, F.lit(" disagree on fleet size or priority: more than one prioritize run?"))
    return F.when(~low.eqNullSafe(high), F.raise_error(text))


def priority_report(cards: DataFrame) -> DataFrame:
    """One row per raw (brand, model_name) of prioritized cards; disagreeing cards are an error."""
    keys = ["brand", "model_name"]
    fleet, rank = F.coalesce("estimated_fleet_size", F.lit(-1)), _priority_rank(F.col("bundle_priority"))
    grouped = cards.groupBy(*keys).agg(
        *_counts(),
        F.min(fleet).alias("_fleet_low"),
        F.max(fleet).alias("_fleet_high"),
        F.min(rank).alias("_rank_low"),
        F.max(rank).alias("_rank_high"),
    )
    conflict = assert_consistent(
        keys,
        F.struct(F.col("_fleet_low").alias("f"), F.col("_rank_low").alias("r")),
        F.struct(F.col("_fleet_high").alias("f"), F.col("_rank_high").alias("r")),
    ).cast("int")
    # A filter is evaluated for every row whatever is read of it; the check is NULL or an error.
    return ordered_report(
        grouped.where(conflict.isNull()).select(
            *keys,
            *_COUNTS,
            F.nullif(F.col("_fleet_low"), F.lit(-1)).alias("estimated_fleet_size"),
            _priority_name(F.col("_rank_low")).alias("bundle_priority"),
        )
    )


def report_by_model(
    cards: DataFrame, lookup: DataFrame, high: int = fv.HIGH_THRESHOLD, medium: int = fv.MEDIUM_THRESHOLD
) -> DataFrame:
    """The report straight from unmatched cards.

    A match depends on brand and name alone, so cards are counted per name first (one
    combining aggregate) and only distinct names are normalised and joined: the join
    never sees more rows than there are models, however many cards one model has.
    """
    counted = cards.groupBy("brand", "model_name").agg(*_counts())
    return ordered_report(attach_fleet(counted, lookup, high, medium).drop("matched_via_alias"))


def ordered_report(report: DataFrame) -> DataFrame:
    """Largest fleet first, unknown last, then model name in any case; brand breaks ties."""
    return report.orderBy(*report_order())


def report_order() -> list[Column]:
    return [
        F.coalesce("estimated_fleet_size", F.lit(-1)).desc(),
        F.upper("model_name").asc_nulls_first(),
        F.col("brand").asc(),
        F.col("model_name").asc(),
    ]


def _priority_rank(c: Column) -> Column:
    rank = F.when(c == fv.PRIORITIES[0], 0)
    for i, name in enumerate(fv.PRIORITIES[1:], start=1):
        rank = rank.when(c == name, i)
    return rank


def _priority_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in fv.PRIORITIES]), rank + 1)


def zero_fill(dim: DataFrame, counts: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Every member of a dimension with its counts, 0 where there are none."""
    return dim.join(counts, key, "left").fillna(0, subset=list(columns))


def priority_distribution(cards: DataFrame, priorities: DataFrame) -> DataFrame:
    """Cards per priority, in priority order, zeros included."""
    counts = cards.groupBy("bundle_priority").agg(F.count(F.lit(1)).alias("card_count"))
    return zero_fill(priorities, counts, "bundle_priority", ["card_count"]).orderBy("ordinal").drop("ordinal")


def run_summary(results: DataFrame, brand_runs: DataFrame, brands: DataFrame) -> DataFrame:
    """Per brand run: counts by status, outcome and a note, in whole and shortened, in brand order.

    ``results`` has one row per discovered entry (brand, status); ``brand_runs`` one row per brand.
    """
    columns = ["discovered", "downloaded", "metadata_only", "failed"]
    counts = results.groupBy("brand").agg(
        F.count(F.lit(1)).alias("discovered"),
        F.count_if(F.col("status") == "Downloaded").alias("downloaded"),
        F.count_if(F.col("status") == "MetadataOnly").alias("metadata_only"),
        F.count_if(F.col("status") == "Failed").alias("failed"),
    )
    note = (
        F.when(F.col("outcome") == "NotImplemented", F.coalesce("note", F.lit(fv.TEXT_NOTE_NOT_IMPLEMENTED)))
        .when(F.col("outcome") == "DiscoveryFailed", F.coalesce("note", F.lit(fv.TEXT_NOTE_DISCOVERY_FAILED)))
        .otherwise("")
    )
    return (
        zero_fill(brand_runs.join(brands, "brand"), counts, "brand", columns)
        .orderBy("ordinal")
        .select("brand", "outcome", *columns, note.alias("note"), short_note(note).alias("short_note"))
    )


def unexpected_failures(summary: DataFrame) -> DataFrame:
    """Brand runs that must fail the job: discovery broke, or completed without finding anything."""
    return summary.where(
        (F.col("outcome") == "DiscoveryFailed")
        | ((F.col("outcome") == "Completed") & (F.col("discovered") == 0))
    )
