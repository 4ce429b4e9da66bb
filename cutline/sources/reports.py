"""Priority report sinks.

Both keep the report's global order across files: part files in name order, read one
after the other, are the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline import fixed_values as fv
from cutline.operators.report import report_order
from cutline.sources.cards import to_camel


def write_report_json(report: DataFrame, path: str) -> None:
    """JSON lines in report order, camel-case names and enumeration values, nulls kept."""
    ordered = report.orderBy(*report_order())
    to_camel(ordered, ("brand", "bundle_priority")).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def csv_field(c: Column) -> Column:
    """Quoted only when it has to be; NULL is empty."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\\n\\r]'), quoted).otherwise(text)


def report_csv_lines(report: DataFrame) -> DataFrame:
    """``(value)``: header line with byte order mark, then one line per row, globally ordered."""
    fields = [
        csv_field(F.col(c))
        for c in (
            "brand", "model_name", "card_count", "not_downloaded_count", "estimated_fleet_size", "bundle_priority",
        )
    ]
    keys = ("estimated_fleet_size", "model_name", "brand")
    lines = report.select(F.lit(1).alias("part"), *keys, F.concat_ws(",", *fields).alias("value"))
    header = lines.sparkSession.range(1).select(
        F.lit(0).alias("part"),
        *[F.lit(None).cast(report.schema[k].dataType).alias(k) for k in keys],
        F.lit(fv.BYTE_ORDER_MARK + fv.REPORT_CSV_HEADER).alias("value"),
    )
    return header.unionByName(lines).orderBy("part", *report_order()).select("value")


def write_report_csv(report: DataFrame, path: str) -> None:
    report_csv_lines(report).write.mode("overwrite").text(path)
