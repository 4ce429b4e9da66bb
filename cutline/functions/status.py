"""Outcome of a fetch, card status, priority tier and issue texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cutline import fixed_values as fv


def fetch_failure(
    http_status: Column, reason: Column, content_type: Column, error: Column, timed_out: Column
) -> Column:
    """Why a fetch failed, NULL when it delivered a document.

    A transport error or time-out has no response; a response fails on its status or,
    when it states a content type, on a type that is no PDF.
    """
    none = F.lit(None).cast("string")
    return (
        F.when(F.coalesce(timed_out, F.lit(False)), F.format_string(fv.TEXT_TIMEOUT, F.coalesce(error, F.lit(""))))
        .when(error.isNotNull(), error)
        .when(
            ~http_status.between(200, 299),
            F.format_string(fv.TEXT_HTTP_STATUS, http_status.cast("string"), F.coalesce(reason, F.lit(""))),
        )
        .when(
            content_type.isNotNull() & ~F.contains(F.lower(content_type), F.lit("pdf")),
            F.format_string(fv.TEXT_CONTENT_TYPE, content_type),
        )
        .otherwise(none)
    )


def fetch_status_code(http_status: Column, error: Column, timed_out: Column, failure: Column) -> Column:
    """HTTP status carried with the outcome: a wrong content type and a time-out carry none."""
    return (
        F.when(failure.isNull(), F.lit(200))
        .when(F.coalesce(timed_out, F.lit(False)), F.lit(None))
        .when(error.isNotNull() | ~http_status.between(200, 299), http_status)
    )


def card_status(url: Column, dry_run: bool, success: Column) -> Column:
    if dry_run:
        return F.when(url.isNull(), "Failed").otherwise("MetadataOnly")
    return F.when(url.isNull(), "Failed").when(success, "Downloaded").otherwise("MetadataOnly")


def tier(fleet: Column, high: int = fv.HIGH_THRESHOLD, medium: int = fv.MEDIUM_THRESHOLD) -> Column:
    return (
        F.when(fleet.isNull(), "Unknown").when(fleet >= high, "High").when(fleet >= medium, "Medium").otherwise("Low")
    )


def short_note(note: Column, width: int = fv.NOTE_WIDTH) -> Column:
    return F.when(F.length(note) > width, F.concat(F.substring(note, 1, width - 1), F.lit("…"))).otherwise(note)


def body_year_text(body: Column) -> Column:
    return F.format_string(fv.TEXT_BODY_YEAR, body)


def fuel_digits_text(fuel: Column) -> Column:
    return F.format_string(fv.TEXT_FUEL_DIGITS, fuel)


def duplicate_text(card: Column, n: Column) -> Column:
    return F.format_string(fv.TEXT_DUPLICATE_ID, card, n)


def brand_unknown_text(n: Column, brand: Column) -> Column:
    return F.format_string(fv.TEXT_BRAND_UNKNOWN, n, brand)


def above_baseline_text(brand: Column, n: Column, baseline: Column) -> Column:
    return F.format_string(fv.TEXT_ABOVE_BASELINE, brand, n, baseline)
