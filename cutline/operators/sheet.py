"""Stock sheet: cells of landed workbooks to stock rows, warnings and a preview.

Cells arrive as one row each, ``(book, year, sheet, sheet_pos, row_no, col_no,
cell_type, value)``.  Any number of workbooks is read at once; ``(book, year)`` keys every
step, so one book name may come in several years.  The cells are read once, into one
stored row per sheet row; everything else is worked out of those rows and of one small
row per workbook that says where its header and end are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline import fixed_values as fv
from cutline.functions.names import trim_ws
from cutline.functions.text import brand_and_series
from cutline.operators.ordered import fill_down
from cutline.session import stored


def _same(c: Column, text: str) -> Column:
    return F.upper(c) == text.upper()


def _filled() -> Column:
    return F.col("value").isNotNull() & (F.col("value") != "")


def sheet_corners(cells: DataFrame) -> DataFrame:
    """``(book, year, sheet, sheet_pos, row0, col0, row1, col1)``: used range of every sheet, NULL when empty."""
    row, col = (F.when(_filled(), F.col(c)) for c in ("row_no", "col_no"))
    return cells.groupBy("book", "year", "sheet", "sheet_pos").agg(
        F.min(row).alias("row0"), F.min(col).alias("col0"), F.max(row).alias("row1"), F.max(col).alias("col1")
    )


def _is_exact() -> Column:
    return _same(F.col("sheet"), fv.SHEET_NAME)


def _is_stock_sheet() -> Column:
    return _is_exact() | F.upper("sheet").startswith(fv.SHEET_PREFIX.upper())


def _first_choice(sheets: DataFrame, *columns: str) -> DataFrame:
    """``(book, year, columns)`` of each workbook's stock sheet: the exactly named one, else the first with the prefix."""
    pick = F.min_by(F.struct(*columns), F.struct(~_is_exact(), "sheet_pos", "sheet"))
    return sheets.groupBy("book", "year").agg(pick.alias("pick")).select("book", "year", "pick.*")


def choose_sheet(cells: DataFrame) -> DataFrame:
    """``(book, year, sheet, row0, col0)`` of the stock sheet of every workbook that has one."""
    return _first_choice(sheet_corners(cells.where(_is_stock_sheet())), "sheet", "row0", "col0")


def _from_corner(cells: DataFrame, corners: DataFrame) -> DataFrame:
    """Non-empty cells with positions counted from the first used row and column of their sheet."""
    return (
        cells.where(_filled())
        .join(corners.select("book", "year", "sheet", "row0", "col0"), ["book", "year", "sheet"])
        .withColumn("row_no", F.col("row_no") - F.col("row0") + 1)
        .withColumn("col_no", F.col("col_no") - F.col("col0") + 1)
        .drop("row0", "col0")
    )


def sheet_rows(cells: DataFrame) -> DataFrame:
    """``(book, year, row_no, segment_cell, series_cell, count_cell, count_type)`` of the chosen sheets, stored.

    The first three used columns of a sheet are only known once all its rows are.  Three columns in a row differ by
    their remainder of 3, and none of a row's wanted cells has another one of its remainder further left; so a row
    keeps the leftmost cell of each remainder, a combining aggregate, and the wanted ones are picked from these.
    """
    cell = F.struct("col_no", "value", "cell_type")
    leftmost = [F.min(F.when(_filled() & (F.pmod("col_no", F.lit(3)) == i), cell)).alias(f"_c{i}") for i in range(3)]
    keys = ["book", "year", "sheet", "sheet_pos"]
    raw = stored(cells.where(_is_stock_sheet()).groupBy(*keys, "row_no").agg(*leftmost), "sheet-rows")
    first = F.least(*[F.col(f"_c{i}.col_no") for i in range(3)])
    corners = raw.groupBy(*keys).agg(
        F.min(F.when(first.isNotNull(), F.col("row_no"))).alias("row0"), F.min(first).alias("col0")
    )
    chosen = _first_choice(corners, "sheet", "sheet_pos", "row0", "col0").where(F.col("row0").isNotNull())
    rows = raw.where(first.isNotNull()).join(chosen, keys)

    def picked(place: int, what: str) -> Column:
        found = F.get(F.array("_c0", "_c1", "_c2"), F.pmod(F.col("col0") + place, F.lit(3)).cast("int"))
        return F.when(found["col_no"] == F.col("col0") + place, found[what])

    def text(place: int) -> Column:
        return F.coalesce(trim_ws(picked(place, "value")), F.lit(""))

    return rows.select(
        "book",
        "year",
        (F.col("row_no") - F.col("row0") + 1).alias("row_no"),
        text(0).alias("segment_cell"),
        text(1).alias("series_cell"),
        F.coalesce(picked(2, "value"), F.lit("")).alias("count_cell"),
        picked(2, "cell_type").alias("count_type"),
    )


def book_layout(rows: DataFrame) -> DataFrame:
    """``(book, year, header_row, header_text, end_row)`` of every workbook with a header.

    The header is the first one within the search window; the end marker counts from two rows
    below it.  Marker rows close to the window are few and kept until the header is known.
    """
    is_header = (
        (F.col("row_no") <= fv.HEADER_SEARCH_ROWS)
        & _same(F.col("segment_cell"), fv.SHEET_SEGMENT_TITLE)
        & _same(F.col("series_cell"), fv.SHEET_SERIES_TITLE)
    )
    is_end = (F.col("series_cell") == "") & _same(F.col("segment_cell"), fv.SHEET_END_MARKER)
    near = F.col("row_no") <= fv.HEADER_SEARCH_ROWS + 2
    header_at = F.when(is_header, F.col("row_no"))
    facts = (
        rows.where(is_header | is_end)
        .groupBy("book", "year")
        .agg(
            F.min(header_at).alias("header_row"),
            F.min_by("count_cell", header_at).alias("header_text"),
            F.collect_set(F.when(is_end & near, F.col("row_no"))).alias("near_ends"),
            F.min(F.when(is_end & ~near, F.col("row_no"))).alias("far_end"),
        )
        .where(F.col("header_row").isNotNull())
    )
    near_end = F.array_min(F.filter("near_ends", lambda r: r >= F.col("header_row") + 2))
    return facts.select("book", "year", "header_row", "header_text", F.coalesce(near_end, "far_end").alias("end_row"))


def data_region(rows: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """Rows from two below the header up to the end marker, segment carried down, subtotal rows dropped."""
    layout = book_layout(rows) if layout is None else layout
    inside = (
        rows.join(layout.select("book", "year", "header_row", "end_row"), ["book", "year"])
        .where(
            (F.col("row_no") >= F.col("header_row") + 2)
            & (F.col("end_row").isNull() | (F.col("row_no") < F.col("end_row")))
        )
        .withColumn("segment", F.nullif(F.col("segment_cell"), F.lit("")))
        .select("book", "year", "row_no", "segment", "series_cell", "count_cell", "count_type")
    )
    filled = fill_down(inside, ["book", "year"], "row_no", "segment")
    return filled.where(F.col("series_cell") != "").withColumn("segment", F.coalesce("segment", F.lit("")))


def _is_number() -> Column:
    return F.coalesce(F.col("count_type") == "number", F.lit(False)) & F.col("count_cell").try_cast("double").isNotNull()


def stock_rows(region: DataFrame) -> DataFrame:
    """``(book, year, row_no, segment, brand_label, model_series, count)`` of a data region; counts are truncated."""
    brand, series = brand_and_series(F.col("series_cell"))
    return region.where(_is_number()).select(
        "book",
        "year",
        "row_no",
        "segment",
        brand.alias("brand_label"),
        series.alias("model_series"),
        F.col("count_cell").try_cast("double").try_cast("int").alias("count"),
    )


def stock_warnings(region: DataFrame, layout: DataFrame) -> DataFrame:
    """``(book, year, row_no, warning)``: a header of another year, and rows whose count is no number."""
    year = F.col("year").cast("string")
    mismatch = layout.where(~F.contains(F.col("header_text"), year)).select(
        "book",
        "year",
        F.col("header_row").alias("row_no"),
        F.format_string(fv.TEXT_HEADER_YEAR, "header_text", year).alias("warning"),
    )
    not_a_number = F.format_string(
        fv.TEXT_NOT_A_NUMBER, F.col("row_no").cast("string"), F.col("series_cell"), F.col("count_cell")
    )
    rejected = region.where(~_is_number()).select("book", "year", "row_no", not_a_number.alias("warning"))
    return mismatch.unionByName(rejected)


def sheet_errors(cells: DataFrame, layout: DataFrame) -> DataFrame:
    """``(book, year, error)``: books without a stock sheet, with an empty one, or without a header row."""
    year = F.col("year").cast("string")
    sheets = cells.groupBy("book", "year", "sheet", "sheet_pos").agg(F.max(_filled()).alias("used"))
    # One pass: sheets of other names never win, but they keep their workbook in.
    order = F.when(_is_stock_sheet(), F.struct(~_is_exact(), "sheet_pos", "sheet"))
    picked = sheets.groupBy("book", "year").agg(F.min_by(F.struct("sheet", "used"), order).alias("pick"))
    headed = layout.select("book", "year", F.lit(True).alias("headed"))
    books = picked.select("book", "year", "pick.*").join(headed, ["book", "year"], "left")
    error = (
        F.when(F.col("sheet").isNull(), F.format_string(fv.TEXT_NO_SHEET, F.lit(fv.SHEET_NAME), year))
        .when(~F.col("used"), F.format_string(fv.TEXT_EMPTY_SHEET, F.col("sheet"), year))
        .when(F.col("headed").isNull(), F.format_string(fv.TEXT_NO_HEADER, year))
    )
    return books.select("book", "year", error.alias("error")).where(F.col("error").isNotNull())


def reference_date(year: Column) -> Column:
    return F.make_date(year, F.lit(1), F.lit(1))


def preview_sheet(cells: DataFrame, rows: int = fv.PREVIEW_ROWS, columns: int = fv.PREVIEW_COLUMNS) -> DataFrame:
    """``(book, year, sheet, row_no, line)``: the first rows of each sheet, first columns joined by `` | ``.

    One row of a preview holds at most ``columns`` cells, so its line is built by one
    conditional maximum per column.
    """
    corners = sheet_corners(cells).where(F.col("row0").isNotNull())
    picked = _from_corner(cells, corners).where((F.col("row_no") <= rows) & (F.col("col_no") <= columns))
    wide = picked.groupBy("book", "year", "sheet", "row_no").agg(
        *[F.max(F.when(F.col("col_no") == i, F.col("value"))).alias(f"_c{i}") for i in range(1, columns + 1)]
    )
    # Rows without any cell still take a line.
    height = F.least(F.col("row1") - F.col("row0") + 1, F.lit(rows))
    width = F.least(F.col("col1") - F.col("col0") + 1, F.lit(columns)).cast("int")
    lines = corners.select(
        "book", "year", "sheet", width.alias("_width"), F.explode(F.sequence(F.lit(1), height)).alias("row_no")
    ).join(wide, ["book", "year", "sheet", "row_no"], "left")
    cells_of_row = F.array(*[F.coalesce(f"_c{i}", F.lit("")) for i in range(1, columns + 1)])
    line = F.array_join(F.slice(cells_of_row, F.lit(1), F.col("_width")), " | ")
    return lines.select("book", "year", "sheet", "row_no", line.alias("line"))
