"""Rule-based anomaly report over the card table.

Three narrow passes over ``cards``: one scan emits both per-card rules, one combining
aggregate per id finds duplicates, one per brand feeds both brand rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutline import fixed_values as fv
from cutline.functions import status as S
from cutline.functions.text import BARE_DIGITS, YEAR_OR_RANGE

_COLUMNS = ("card_id", "brand", "kind", "description")


def _issue(card: Column, brand: Column, kind: str, text: Column) -> Column:
    return F.struct(
        card.alias("card_id"), brand.alias("brand"), F.lit(kind).alias("kind"), text.alias("description")
    )


def card_issues(cards: DataFrame) -> DataFrame:
    """Body types that look like years and fuel types that are bare digits."""
    rules = F.array(
        F.when(
            F.col("body_type").rlike(YEAR_OR_RANGE),
            _issue(F.col("id"), F.col("brand"), fv.ISSUE_KINDS[0], S.body_year_text(F.col("body_type"))),
        ),
        F.when(
            F.col("fuel_type").rlike(BARE_DIGITS),
            _issue(F.col("id"), F.col("brand"), fv.ISSUE_KINDS[1], S.fuel_digits_text(F.col("fuel_type"))),
        ),
    )
    hits = F.filter(rules, lambda issue: issue.isNotNull())
    return cards.select(F.explode(hits).alias("issue")).select("issue.*").select(*_COLUMNS)


def duplicate_issues(cards: DataFrame, position: Column | None = None) -> DataFrame:
    """Ids occurring more than once, with the brand of the first card (lowest brand without a position)."""
    brand = F.min("brand") if position is None else F.min_by("brand", position)
    groups = cards.groupBy("id").agg(F.count(F.lit(1)).alias("n"), brand.alias("brand")).where(F.col("n") > 1)
    return groups.select(
        F.col("id").alias("card_id"),
        "brand",
        F.lit(fv.ISSUE_KINDS[2]).alias("kind"),
        S.duplicate_text(F.col("id"), F.col("n")).alias("description"),
    )


def brand_issues(cards: DataFrame, baselines: DataFrame) -> DataFrame:
    """Brands entirely without priority, and brands with more unknown cards than their baseline.

    Neither fires before any card at all has a priority, which a sum over the per-brand
    counts decides.
    """
    per_brand = cards.groupBy("brand").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("bundle_priority") == "Unknown").alias("unknown"),
    )
    # One row for each brand: few enough for a window over all of them.
    prioritized = F.sum(F.col("n") - F.col("unknown")).over(Window.partitionBy())
    entirely = F.col("unknown") == F.col("n")
    above = F.col("unknown") > F.col("baseline")
    rated = per_brand.withColumn("prioritized", prioritized).where("prioritized > 0").join(baselines, "brand", "left")
    return rated.where(entirely | above).select(
        F.col("brand").alias("card_id"),
        "brand",
        F.when(entirely, fv.ISSUE_KINDS[3]).otherwise(fv.ISSUE_KINDS[4]).alias("kind"),
        F.when(entirely, S.brand_unknown_text(F.col("n"), F.col("brand")))
        .otherwise(S.above_baseline_text(F.col("brand"), F.col("unknown"), F.col("baseline")))
        .alias("description"),
    )


def check_quality(cards: DataFrame, baselines: DataFrame, position: Column | None = None) -> DataFrame:
    """All issues of a card table."""
    return (
        card_issues(cards)
        .unionByName(duplicate_issues(cards, position))
        .unionByName(brand_issues(cards, baselines))
    )


def quality_gate(issues: DataFrame, cards: DataFrame) -> DataFrame:
    """One row ``(issue_count, card_count, passed)``."""
    counts = (
        issues.select(F.lit(1).alias("issue"), F.lit(0).alias("card"))
        .unionByName(cards.select(F.lit(0).alias("issue"), F.lit(1).alias("card")))
        .agg(
            F.coalesce(F.sum("issue"), F.lit(0)).alias("issue_count"),
            F.coalesce(F.sum("card"), F.lit(0)).alias("card_count"),
        )
    )
    return counts.withColumn("passed", F.col("issue_count") == 0)
