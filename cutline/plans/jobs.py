"""The batch jobs: discover, import_cards, load_stock, prioritize, split, quality, preview.

A job that changes the cards starts from the current version of the store; if another job published a version in the
meantime it ends with ``VersionTaken`` and changes nothing, and can simply be run again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline import fixed_values as fv
from cutline import schemas
from cutline.operators.cards import build_cards, classify_fetch, upsert_cards
from cutline.operators.links import pick_publication
from cutline.operators.match import attach_siblings, fleet_lookup, stock_index, attach_fleet
from cutline.operators.quality import check_quality, quality_gate
from cutline.operators.report import priority_distribution, priority_report, run_summary, unexpected_failures
from cutline.operators.sheet import (
    book_layout,
    data_region,
    preview_sheet,
    sheet_errors,
    sheet_rows,
    stock_rows,
    stock_warnings,
)
from cutline.operators.split import combined_cards, replace_combined, split_cards, split_counts, split_groups, split_summary
from cutline.plans.discover import Landed, missing_model_pages, run_discovery
from cutline.session import checkpointed
from cutline.sources.cards import current_version, read_card_sidecars, read_cards, write_cards, write_manifests
from cutline.sources.config import read_aliases, read_siblings
from cutline.sources.reports import write_report_csv, write_report_json
from cutline.sources.stock import read_stock, write_stock


@dataclass(frozen=True)
class JobResult:
    """What a job leaves behind: its exit code, a small result table, and what it could not read, where it reports that."""

    exit_code: int
    result: DataFrame | None
    message: str = ""
    details: DataFrame | None = None


def discover(
    spark: SparkSession,
    landed: Landed,
    cards_root: str,
    fetch_log: DataFrame | None,
    brands: Sequence[str] = fv.BRANDS,
    siblings_path: str | None = None,
) -> JobResult:
    """Extract entries of the chosen brands, upsert their cards, summarise the run.

    Without a fetch log it is a dry run: cards are stored, manifests are not. Exit code 1
    means a brand failed or found nothing.  The details are the linked model pages that were never landed.
    """
    entries, brand_runs = run_discovery(spark, landed, brands)
    outcomes = None if fetch_log is None else classify_fetch(fetch_log)
    cards = build_cards(entries, read_siblings(spark, siblings_path), outcomes)
    base = current_version(spark, cards_root)
    stored = write_cards(upsert_cards(read_cards(spark, cards_root), cards, F.col("entry_pos")), cards_root, base)
    if fetch_log is not None:
        write_manifests(stored, cards_root, brands)
    # The summary counts every discovered entry, also those overwritten by a later one of the same id.
    summary = checkpointed(run_summary(cards.select("brand", "status"), brand_runs, schemas.brand_dim(spark)))
    failed = not unexpected_failures(summary).isEmpty()
    return JobResult(1 if failed else 0, summary, details=missing_model_pages(landed, brands))


def import_cards(spark: SparkSession, tree_root: str, cards_root: str, names: str = "*.json") -> JobResult:
    """Upsert the cards of a tree of one-card JSON files.

    Of files with one id the last by path counts.  Unreadable files and files without an id or a brand are left out
    and are the details, ``(file, content)``. Exit code 1: there were such files. The result counts both kinds.
    """
    cards, corrupt = read_card_sidecars(spark, tree_root, names, position="file")  # stored
    nameless = cards.where(F.col("id").isNull() | F.col("brand").isNull())
    left_out = checkpointed(corrupt.unionByName(nameless.select("file", F.lit(None).cast("string").alias("content"))))
    incoming = cards.where(F.col("id").isNotNull() & F.col("brand").isNotNull())
    base = current_version(spark, cards_root)
    write_cards(upsert_cards(read_cards(spark, cards_root), incoming, F.col("file")), cards_root, base)
    kinds = incoming.select(F.lit(True).alias("good")).unionByName(left_out.select(F.lit(False).alias("good")))
    counts = kinds.agg(F.count_if("good").alias("imported"), F.count_if(~F.col("good")).alias("left_out"))
    return JobResult(1 if not left_out.isEmpty() else 0, counts, details=left_out)


def load_stock(spark: SparkSession, cells: DataFrame, pages: DataFrame, stock_root: str, year: int) -> JobResult:
    """Parse the landed workbook of a year into the stock table.

    Exit code 1: the publication is in a format that is not supported; 2: it is missing or
    its layout is unknown.
    """
    link = pick_publication(pages.where(F.col("url") == fv.STOCK_PAGE_URL), year).first()
    if link is None:
        return JobResult(2, None, fv.TEXT_NO_STOCK_LINK % year)
    if not link["supported"]:
        return JobResult(1, None, fv.TEXT_STOCK_FORMAT % (year, link["download_url"]))
    book = cells.where(F.col("year") == year)
    # The few facts per workbook and the rows built on them are read several times below.
    rows = checkpointed(sheet_rows(book))
    layout = checkpointed(book_layout(rows))
    error = sheet_errors(book, layout).first()
    if error is not None:
        return JobResult(2, None, error["error"])
    region = data_region(rows, layout)
    meta = write_stock(stock_rows(region), stock_warnings(region, layout), stock_root, year, link["download_url"])
    return JobResult(0, meta)


def prioritize(
    spark: SparkSession,
    cards_root: str,
    stock_root: str,
    report_root: str,
    year: int | None = None,
    aliases_path: str | None = None,
) -> JobResult:
    """Match all cards to the stock of a year, store them, export the report.

    The result table is the priority distribution. Exit code 1: no stock.
    """
    stock = read_stock(spark, stock_root, year)
    if stock is None:
        return JobResult(1, None, "no vehicle stock found")
    index = stock_index(stock[1], schemas.brand_labels(spark))
    lookup = fleet_lookup(index, read_aliases(spark, aliases_path))
    base = current_version(spark, cards_root)
    cards = attach_fleet(read_cards(spark, cards_root), lookup).select(*schemas.CARDS.names)
    # Report and distribution read the stored result, so the match runs once.
    stored = write_cards(cards, cards_root, base)
    report = priority_report(stored)
    write_report_json(report, f"{report_root}/priority-report.json")
    write_report_csv(report, f"{report_root}/priority-report.csv")
    return JobResult(0, priority_distribution(stored, schemas.priority_dim(spark)))


def split(spark: SparkSession, cards_root: str, pdf_pages: DataFrame, siblings_path: str | None = None) -> JobResult:
    """Replace combined cards by the cards found in their pages. Exit code 1: no combined card.

    The details are the cards found in each combined document, zeros included.
    """
    base = current_version(spark, cards_root)
    cards = read_cards(spark, cards_root)
    combined = combined_cards(cards)
    if combined.isEmpty():
        return JobResult(1, None, "no downloaded combined cards found")
    made = attach_siblings(split_cards(combined, split_groups(pdf_pages)), read_siblings(spark, siblings_path))
    made = checkpointed(made.select(*schemas.CARDS.names, "combined_id"))
    counts = checkpointed(split_counts(combined, made))
    summary = split_summary(counts)
    changed = [row["brand"] for row in combined.select("brand").distinct().collect()]  # at most one row a brand
    stored = write_cards(replace_combined(cards, made), cards_root, base)
    write_manifests(stored, cards_root, changed)
    return JobResult(0, summary, details=counts)


def quality(spark: SparkSession, cards_root: str) -> JobResult:
    """All anomalies of the stored cards. Exit code 1: at least one."""
    cards = read_cards(spark, cards_root)
    issues = check_quality(cards, schemas.unknown_baselines(spark))
    gate = quality_gate(issues, cards).first()
    return JobResult(0 if gate["passed"] else 1, issues, f"{gate['issue_count']} issue(s), {gate['card_count']} cards checked")


def preview(cells: DataFrame, rows: int = fv.PREVIEW_ROWS) -> JobResult:
    """First rows of every sheet."""
    return JobResult(0, preview_sheet(cells, rows).orderBy("book", "year", "sheet", "row_no"))
