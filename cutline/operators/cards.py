"""Entries plus fetch outcomes to cards; upsert and delete on the card table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline import fixed_values as fv
from cutline.functions.binding import bind
from cutline.functions.names import card_id, card_path
from cutline.functions.status import card_status, fetch_failure, fetch_status_code
from cutline.operators.match import attach_siblings
from cutline.operators.ordered import latest_by


def classify_fetch(fetch_log: DataFrame) -> DataFrame:
    """``(url, success, failure_reason, http_status)`` of the latest fetch of every URL."""
    latest = latest_by(fetch_log, ["url"], F.struct("fetched_at", "http_status", "content_type", "error"))
    failure = fetch_failure(*[F.col(c) for c in ("http_status", "reason", "content_type", "error", "timed_out")])
    code = fetch_status_code(F.col("http_status"), F.col("error"), F.col("timed_out"), failure)
    return latest.select(
        "url",
        failure.isNull().alias("success"),
        failure.alias("failure_reason"),
        code.alias("http_status"),
    )


def attach_fetch(entries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Entries with the outcome of their download; every entry survives.

    Entries without a URL match nothing. They get spread keys, or a shuffle would send all of
    them to one task.
    """
    spread = F.concat(F.lit("no-url-"), F.xxhash64("raw_label", "entry_pos"))
    keyed = entries.withColumn("_key", F.coalesce("download_url", spread))
    return keyed.join(outcomes.withColumnRenamed("url", "_key"), "_key", "left").drop("_key")


def only_language(df: DataFrame, language: str, column: str = "parsed.language_code") -> DataFrame:
    return df.where(F.upper(column) == language.upper())


def select_brands(df: DataFrame, brands: Sequence[str]) -> DataFrame:
    """Keep the chosen brands; on a brand-partitioned table this prunes partitions."""
    return df.where(F.col("brand").isin(*brands))


def build_cards(
    entries: DataFrame, siblings: DataFrame, outcomes: DataFrame | None = None, now: Column | None = None
) -> DataFrame:
    """Cards (all 21 columns, plus ``entry_pos``) of discovered entries.

    Without ``outcomes`` the run is a dry run.  An entry with a URL the fetch log does
    not know was not delivered.  Fleet size and priority start empty again.
    """
    dry_run = outcomes is None
    now = F.current_timestamp() if now is None else now
    none = F.lit(None).cast("string")
    if dry_run:
        fetched = entries.withColumn("success", F.lit(False)).withColumn(
            "failure_reason", F.lit(fv.TEXT_DRY_RUN)
        )
    else:
        fetched = attach_fetch(entries, outcomes.drop("http_status")).withColumn(
            "success", F.coalesce("success", F.lit(False)) & F.col("download_url").isNotNull()
        )
    url, parsed, success = F.col("download_url"), F.col("parsed"), F.col("success")
    identity = card_id(
        F.col("brand"),
        parsed["model_name"],
        parsed["build_year_from"],
        parsed["body_type"],
        parsed["language_code"],
        F.col("raw_label"),
    )
    identified = bind(fetched, id=identity, status=card_status(url, dry_run, success))
    cards = identified.select(
        "id",
        "brand",
        "parsed.model_name",
        "parsed.variant",
        "parsed.body_type",
        "parsed.build_year_from",
        "parsed.build_year_to",
        "parsed.doors",
        "parsed.fuel_type",
        "parsed.language_code",
        "status",
        "source_page_url",
        "download_url",
        F.when(url.isNull(), fv.TEXT_NO_URL).when(success, none).otherwise(F.col("failure_reason")).alias(
            "failure_reason"
        ),
        "parsed.parse_confidence",
        now.alias("discovered_at_utc"),
        F.when(success, now).alias("downloaded_at_utc"),
        card_path(F.col("brand"), parsed["model_name"], F.col("id"), F.col("status")).alias("local_pdf_relative_path"),
        F.lit(None).cast("array<string>").alias("sibling_model_ids"),
        F.lit(None).cast("int").alias("estimated_fleet_size"),
        F.lit("Unknown").alias("bundle_priority"),
        "entry_pos",
    )
    columns = cards.columns
    return attach_siblings(cards, siblings).select(*columns)


def upsert_cards(existing: DataFrame, incoming: DataFrame, position: Column | None = None) -> DataFrame:
    """Existing cards overwritten by id; among incoming cards of one id the last one wins.

    Cards that are not in ``incoming`` stay.
    """
    if position is not None:
        columns = existing.columns
        incoming = latest_by(incoming, ["id"], position).select(*columns)
    return delete_cards(existing, incoming.select("id")).unionByName(incoming)


def delete_cards(cards: DataFrame, ids: DataFrame) -> DataFrame:
    """Cards without the given ids; unknown ids change nothing."""
    return cards.join(ids.select("id"), "id", "left_anti")
