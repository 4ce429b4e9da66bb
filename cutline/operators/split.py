"""Regrouping the pages of combined documents into per-model cards.

A document group may own any number of pages, so its page list stays in long form
(one row per page) next to a one-row-per-group summary; no group is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline import fixed_values as fv
from cutline.functions.binding import bind
from cutline.functions.names import card_id, card_path
from cutline.functions.text import header_text, page_doc_id, parse_header


def identified_pages(pdf_pages: DataFrame) -> DataFrame:
    """``(source_doc, page_no, doc_id, header)``: pages carrying a document id; others are dropped."""
    identified = bind(pdf_pages, doc_id=page_doc_id(F.col("text"))).where(F.col("doc_id").isNotNull())
    return identified.select("source_doc", "page_no", "doc_id", header_text(F.col("text")).alias("header"))


def page_manifest(pdf_pages: DataFrame) -> DataFrame:
    """``(source_doc, doc_id, page_no)``: which pages make up which card, no shuffle."""
    return identified_pages(pdf_pages).select("source_doc", "doc_id", "page_no")


def group_pages(pdf_pages: DataFrame) -> DataFrame:
    """``(source_doc, doc_id, first_page, page_count, header)``: header of the first page that has one.

    Pages of a group need not be adjacent; groups are in order of their first page.
    """
    header_page = F.when(F.col("header").isNotNull(), F.col("page_no"))
    return (
        identified_pages(pdf_pages)
        .groupBy("source_doc", "doc_id")
        .agg(
            F.min("page_no").alias("first_page"),
            F.count(F.lit(1)).alias("page_count"),
            F.min_by("header", header_page).alias("header"),
        )
    )


def split_groups(pdf_pages: DataFrame) -> DataFrame:
    """Groups with the card attributes parsed from their header."""
    return bind(group_pages(pdf_pages), parsed=parse_header(F.col("doc_id"), F.col("header")))


def combined_cards(cards: DataFrame) -> DataFrame:
    """Downloaded combined documents. Split cards carry another variant, so re-runs skip them."""
    return cards.where(
        (F.col("brand") == "Porsche")
        & F.col("local_pdf_relative_path").isNotNull()
        & F.lower("variant").startswith(fv.COMBINED_PREFIX.lower())
    )


def split_cards(combined: DataFrame, groups: DataFrame) -> DataFrame:
    """Cards of the groups of combined documents, with ``combined_id``.

    ``groups.source_doc`` is the stored path of the combined document.  Both timestamps
    are the start of the query.
    """
    joined = groups.join(
        combined.select(
            F.col("local_pdf_relative_path").alias("source_doc"),
            F.col("id").alias("combined_id"),
            "brand",
            "source_page_url",
            "download_url",
        ),
        "source_doc",
    )
    parsed = F.col("parsed")
    identity = card_id(
        F.col("brand"),
        parsed["model_name"],
        parsed["build_year_from"],
        parsed["body_type"],
        parsed["language_code"],
        F.concat_ws("|", "combined_id", "doc_id"),
    )
    identified = bind(joined, id=identity)
    status = F.lit("Downloaded")
    return identified.select(
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
        status.alias("status"),
        "source_page_url",
        "download_url",
        F.lit(None).cast("string").alias("failure_reason"),
        "parsed.parse_confidence",
        F.current_timestamp().alias("discovered_at_utc"),
        F.current_timestamp().alias("downloaded_at_utc"),
        card_path(F.col("brand"), parsed["model_name"], F.col("id"), status).alias("local_pdf_relative_path"),
        F.array().cast("array<string>").alias("sibling_model_ids"),
        F.lit(None).cast("int").alias("estimated_fleet_size"),
        F.lit("Unknown").alias("bundle_priority"),
        "combined_id",
    )


def replace_combined(cards: DataFrame, split: DataFrame) -> DataFrame:
    """Card table with every combined card that produced split cards replaced by them.

    A combined document without a single group stays; a stored card of the same id is overwritten.
    """
    gone = split.select(F.explode(F.array("combined_id", "id")).alias("id")).distinct()
    return cards.join(gone, "id", "left_anti").unionByName(split.drop("combined_id"))


def split_counts(combined: DataFrame, split: DataFrame) -> DataFrame:
    """``(combined_id, card_count)`` of every combined document, zeros kept."""
    counts = split.groupBy("combined_id").agg(F.count(F.lit(1)).alias("card_count"))
    return (
        combined.select(F.col("id").alias("combined_id"))
        .join(counts, "combined_id", "left")
        .fillna(0, subset=["card_count"])
    )


def split_summary(counts: DataFrame) -> DataFrame:
    """One row: combined documents that yielded cards, and how many cards in total."""
    return counts.agg(
        F.count_if(F.col("card_count") > 0).alias("documents_processed"),
        F.coalesce(F.sum("card_count"), F.lit(0)).alias("cards_created"),
    )
