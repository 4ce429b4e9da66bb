"""Stock sheets, document splitting, quality, runs, upserts and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.common import derive, spread, sql_columns, table
from bindings.matching import CARD, HIGH, MEDIUM, MIN_STOCK, _CARDS_SQL, _MATCH_CTE, cards as plain_cards, flagship
from cutline import fixed_values as fv
from cutline import schemas
from cutline.operators import cards as C
from cutline.operators import ordered as O
from cutline.operators import quality as Q
from cutline.operators import report as R
from cutline.operators import sheet as S
from cutline.operators import split as P
from cutline.session import scratch_path
from cutline.sources import cards as CS
from cutline.sources import config as CF
from cutline.sources import landed as LD
from cutline.sources import reports as RS
from cutline.sources import stock as SS

# --- stock sheets: three workbooks rendered from part, one cell per row; two of them have one name --------------

_BOOK = "concat('book', CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END)"
_BOOK_YEAR = "CASE WHEN p_partkey % 3 = 2 THEN 2025 ELSE 2026 END"
_ROW = "CAST(floor(p_partkey / 3) + 8 AS INT)"
_SEGMENT = "CASE WHEN p_partkey % 40 < 3 THEN concat(' SEG ', p_type, ' ') ELSE '' END"
_SERIES = "CASE WHEN p_partkey % 21 < 3 THEN '' WHEN p_partkey % 33 < 3 THEN 'SONSTIGE' ELSE concat('MAKER ', p_name) END"
_COUNT = "CASE WHEN p_partkey % 10 = 0 THEN '.' ELSE concat(p_size * 100, '.9') END"
_KIND = "CASE WHEN p_partkey % 10 = 0 THEN 'text' ELSE 'number' END"


def _cell(sheet: str, pos: str, row: str, col: str, kind: str, value: str) -> str:
    return (
        f"struct('{sheet}' AS sheet, {pos} AS sheet_pos, {row} AS row_no, {col} AS col_no, "
        f"'{kind}' AS cell_type, {value} AS value)"
    )


_FRAME_CELLS = (
    _cell("Cover", "1", "1", "1", "text", "'x'"),
    _cell("fz 12.1", "2", "3", "2", "text", "'title'"),
    _cell("fz 12.1", "2", "6", "2", "text", "' segment'"),
    _cell("fz 12.1", "2", "6", "3", "text", "'Modellreihe '"),
    _cell("fz 12.1", "2", "6", "4", "text", "CASE WHEN book = 'book1' THEN 'Anzahl 2025' ELSE 'Anzahl 2026' END"),
    _cell("fz 12.1", "2", "last + 1", "2", "text", "'Bestand insgesamt'"),
    _cell("fz 12.1", "2", "last + 1", "4", "number", "'5'"),
    _cell("fz 12.1", "2", "last + 2", "3", "text", "'AFTER END'"),
    _cell("fz 12.1", "2", "last + 2", "4", "number", "'7'"),
)


def sheet_cells(spark, sf):
    """Cells of three workbooks: a cover sheet, and a stock sheet shifted one column, with header,
    data two rows below, end marker behind the last part and junk after it."""
    part = table(spark, sf, "part")
    data = part.selectExpr(
        f"{_BOOK} AS book", f"{_BOOK_YEAR} AS year", "'fz 12.1' AS sheet", "2 AS sheet_pos", f"{_ROW} AS row_no",
        f"inline(array(struct(2 AS col_no, 'text' AS cell_type, {_SEGMENT} AS value), "
        f"struct(3 AS col_no, 'text' AS cell_type, {_SERIES} AS value), struct(4 AS col_no, {_KIND} AS cell_type, {_COUNT} AS value)))",
    )
    # Header, end marker and cover hang on the part rows too: the smallest keys and the last row of each book.
    books = part.groupBy(F.expr(_BOOK).alias("book"), F.expr(_BOOK_YEAR).alias("year")).agg(F.max(F.expr(_ROW)).alias("last"))
    frame = books.selectExpr(
        "book", "year", "last",
        f"inline(array({', '.join(_FRAME_CELLS)}))",
    ).drop("last")
    return data.unionByName(frame)


def stock_from_sheets(spark, sf):
    return S.stock_rows(S.data_region(S.sheet_rows(sheet_cells(spark, sf))))


def sheet_warnings(spark, sf):
    rows = S.sheet_rows(sheet_cells(spark, sf))
    layout = S.book_layout(rows)
    return S.stock_warnings(S.data_region(rows, layout), layout)


def broken_sheets(spark, sf):
    """Workbooks without stock sheet or header: two of three are broken on purpose."""
    cells = sheet_cells(spark, sf).where(
        "NOT (book = 'book0' AND sheet <> 'Cover') AND NOT (year = 2025 AND row_no = 6 AND col_no = 3)"
    )
    return S.sheet_errors(cells, S.book_layout(S.sheet_rows(cells)))


def previews(spark, sf):
    return S.preview_sheet(sheet_cells(spark, sf), 6, 2)


def filled_events(spark, sf):
    """The value of the last signup carried over all following events, one single hot key."""
    events = table(spark, sf, "events").selectExpr(
        "event_id", "'all' AS grp", "CASE WHEN event_type = 'signup' THEN concat('u', user_id) END AS label"
    )
    return O.fill_down(events, ["grp"], "event_id", "label").select("event_id", "label")


# --- combined documents: conversations are documents, turns are pages -----------------

_PAGE_TEXT = (
    "concat(CASE WHEN role = 'assistant' THEN concat('Porsche AG, Boxter ', turn, ', Cabriolet from Model Year 20', 10 + conv_id % 10, ' ') ELSE '' END, text, "
    "CASE WHEN turn % 5 = 4 THEN ' notice' ELSE concat(' ID no. enus - 01-', conv_id % 1000, '-', turn % 3, ' Page ', turn) END)"
)


def pdf_pages(spark, sf):
    return derive(
        table(spark, sf, "conversations"), source_doc="concat('porsche/all/doc', conv_id, '.pdf')",
        page_no="CAST(turn + 1 AS INT)", text=_PAGE_TEXT,
    )


def page_groups(spark, sf):
    groups = P.split_groups(pdf_pages(spark, sf))
    return groups.select(
        "source_doc", "doc_id", "first_page", "page_count", F.md5("header").alias("header_hash"), "parsed.model_name",
        "parsed.build_year_from", "parsed.parse_confidence",
    )


def page_manifest(spark, sf):
    return P.page_manifest(pdf_pages(spark, sf))


_COMBINED_CARD = {
    "id": "concat('c', conv_id)", "brand": "CASE WHEN conv_id % 7 = 0 THEN 'Audi' ELSE 'Porsche' END",
    "model_name": "'All Models'", "variant": "CASE WHEN conv_id % 5 = 0 THEN 'other' ELSE 'RESCUE data sheets x' END",
    "status": "'Downloaded'", "source_page_url": "concat('u', conv_id)",
    "local_pdf_relative_path": "CASE WHEN conv_id % 3 > 0 THEN concat('porsche/all/doc', conv_id, '.pdf') END",
}


def _stored_cards(spark, sf):
    present = table(spark, sf, "conversations").select("conv_id").distinct()
    named = derive(present, **_COMBINED_CARD)
    return named.select(
        *[
            (F.col(f.name) if f.name in named.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schemas.CARDS.fields
        ]
    )


def replaced_cards(spark, sf):
    cards = _stored_cards(spark, sf)
    made = P.split_cards(P.combined_cards(cards), P.split_groups(pdf_pages(spark, sf)))
    return P.replace_combined(cards, made).select(
        "id", "brand", "model_name", "status", "source_page_url", "local_pdf_relative_path"
    )


def split_totals(spark, sf):
    combined = P.combined_cards(_stored_cards(spark, sf))
    return P.split_summary(P.split_counts(combined, P.split_cards(combined, P.split_groups(pdf_pages(spark, sf)))))


# --- quality ---------------------------------------------------------------------------

_FAULTY = {
    "id": "CASE WHEN p_partkey % 10 < 3 THEN concat('same-', p_name) ELSE concat('p', p_partkey) END",
    "brand": "p_brand",
    "pos": "p_partkey",
    "body_type": "CASE p_partkey % 12 WHEN 0 THEN concat(1950 + p_size, '') WHEN 1 THEN concat(1950 + p_size, '-', 1955 + p_size) WHEN 2 THEN NULL ELSE p_type END",
    "fuel_type": "CASE WHEN p_partkey % 17 = 0 THEN concat(p_size, '') WHEN p_partkey % 17 = 1 THEN NULL ELSE 'GD' END",
    "bundle_priority": "CASE WHEN p_brand IN ('Brand#3', 'Brand#8') THEN 'Unknown' WHEN p_partkey % 3 = 0 THEN 'Unknown' ELSE 'Low' END",
}


def _baselines(spark):
    return schemas.literal_frame(
        spark, [("Brand#1", 0), ("Brand#2", 10_000_000), ("Brand#3", 0)], schemas.struct_of("brand string, baseline int")
    )


def quality_issues(spark, sf):
    return Q.check_quality(derive(table(spark, sf, "part"), **_FAULTY), _baselines(spark), F.col("pos"))


def gate(spark, sf):
    cards = derive(table(spark, sf, "part"), **_FAULTY)
    return Q.quality_gate(Q.check_quality(cards, _baselines(spark), F.col("pos")), cards)


def gate_before_prioritize(spark, sf):
    """Brand rules stay silent while no card has a priority; the same cards with some are judged."""
    part, found = table(spark, sf, "part"), []
    for state, priority in (("before", "'Unknown'"), ("after", _FAULTY["bundle_priority"])):
        cards = derive(part, **(_FAULTY | {"bundle_priority": priority}))
        found.append(Q.brand_issues(cards, _baselines(spark)).select(F.lit(state).alias("state"), "brand", "kind"))
    return found[0].unionByName(found[1])


# --- fetch outcomes, cards, run summary ----------------------------------------------------

_FETCH = {
    "url": "concat('https://dl.example/', event_id % 600, '.pdf')",
    "http_status": "CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN NULL WHEN 'view' THEN 404 ELSE 200 END",
    "reason": "CASE event_type WHEN 'view' THEN 'Not Found' ELSE 'OK' END",
    "content_type": "CASE event_type WHEN 'click' THEN 'application/PDF' WHEN 'view' THEN 'text/html' WHEN 'purchase' THEN 'text/html' END",
    "error": "CASE event_type WHEN 'error' THEN 'no route' WHEN 'signup' THEN 'slow' END",
    "timed_out": "event_type = 'signup'",
    "fetched_at": "CAST(ts AS TIMESTAMP)",
}
_ENTRY_URL = "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE concat('https://dl.example/', p_partkey % 650, '.pdf') END"


def fetch_log(spark, sf):
    return derive(table(spark, sf, "events"), **_FETCH)


def fetch_outcomes(spark, sf):
    return C.classify_fetch(fetch_log(spark, sf))


def _entries(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("brand"),
        F.lit("page").alias("source_page_url"),
        F.expr(_ENTRY_URL).alias("download_url"),
        F.concat("p_name", F.lit("/"), F.expr("p_partkey % 5")).alias("raw_label"),
        F.struct(F.lit(0).alias("page"), F.col("p_partkey").cast("int").alias("link")).alias("entry_pos"),
        F.struct(
            *[
                {
                    "model_name": F.col("p_name"), "body_type": F.col("p_type"), "language_code": F.lit("DE"),
                    "parse_confidence": F.lit("High"),
                }.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
                for f in schemas.PARSED.fields
            ]
        ).alias("parsed"),
    )


_CARD_OUT = ("id", "brand", "model_name", "status", "download_url", "failure_reason", "bundle_priority")


def _siblings(spark, sf):
    return table(spark, sf, "part").where("p_name LIKE '%gear'").selectExpr(
        "1 AS group_pos", "'gears' AS group_id", "'x' AS platform_name", "p_brand AS brand", "upper(p_name) AS model_name"
    ).distinct()


def built_cards(spark, sf):
    cards = C.build_cards(_entries(spark, sf), _siblings(spark, sf), fetch_outcomes(spark, sf))
    return cards.select(
        *_CARD_OUT, "local_pdf_relative_path", F.array_join("sibling_model_ids", "|").alias("siblings"),
        F.col("downloaded_at_utc").isNotNull().alias("has_download_time"), F.col("entry_pos.link").alias("link"),
    )


def dry_run_cards(spark, sf):
    return C.build_cards(_entries(spark, sf), _siblings(spark, sf)).select(*_CARD_OUT, F.col("entry_pos.link").alias("link"))


def _segments(spark, sf):
    """Customer segments as brands, in name order, and one brand without any result."""
    segments = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("brand")).distinct()
    extra = schemas.literal_frame(spark, [("SILENT",), ("BROKEN",)], segments.schema)
    return segments.unionByName(extra).withColumn("ordinal", F.ascii("brand"))


def summary(spark, sf):
    results = table(spark, sf, "customer").selectExpr(
        "c_mktsegment AS brand",
        "CASE WHEN c_custkey % 3 = 0 THEN 'Downloaded' WHEN c_custkey % 3 = 1 THEN 'MetadataOnly' ELSE 'Failed' END AS status",
    )
    runs = _segments(spark, sf).selectExpr(
        "brand",
        "CASE WHEN brand = 'BROKEN' THEN 'DiscoveryFailed' WHEN brand LIKE 'A%' THEN 'NotImplemented' ELSE 'Completed' END AS outcome",
        "CASE WHEN brand = 'BROKEN' THEN 'a message that is clearly longer than forty characters' END AS note",
    )
    return R.run_summary(results, runs, _segments(spark, sf))


def failures(spark, sf):
    """Nations as brands, suppliers in debt as their results: some complete without any, some break."""
    brands = table(spark, sf, "nation").selectExpr("n_name AS brand", "n_nationkey AS ordinal", "n_regionkey AS region", "n_nationkey")
    results = table(spark, sf, "supplier").where("s_acctbal < 0").join(brands, F.col("s_nationkey") == F.col("n_nationkey"))
    outcome = "CASE region WHEN 0 THEN 'DiscoveryFailed' WHEN 1 THEN 'NotImplemented' ELSE 'Completed' END AS outcome"
    runs = brands.selectExpr("brand", outcome, "CAST(NULL AS STRING) AS note")
    found = R.run_summary(results.selectExpr("brand", "'Downloaded' AS status"), runs, brands.select("brand", "ordinal"))
    return R.unexpected_failures(found).select("brand", "outcome", "discovered")


# --- upserts and stores --------------------------------------------------------------------

def _order_cards(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey AS id", "o_orderstatus AS status", "o_orderpriority AS note")


def upserted(spark, sf):
    """Later orders overwrite earlier ones of the same customer; other customers stay."""
    orders = _order_cards(spark, sf)
    existing = O.latest_by(orders.where("o_orderkey % 2 = 0"), ["id"], F.col("o_orderkey"))
    incoming = orders.where("o_orderkey % 2 = 1")
    return C.upsert_cards(existing, incoming, F.col("o_orderkey"))


def deleted(spark, sf):
    cards = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS status")
    gone = table(spark, sf, "lineitem").where("l_returnflag = 'R'").selectExpr("l_orderkey AS id")
    return C.delete_cards(cards, gone)


def first_and_latest(spark, sf):
    events = table(spark, sf, "events").selectExpr("user_id", "event_id", "event_type")
    ends = O.first_and_latest_by(events, ["user_id"], F.col("event_id"))
    return ends.select(
        "user_id", F.col("first.event_id").alias("first_id"), F.col("first.event_type").alias("first_type"),
        F.col("latest.event_id").alias("last_id"), F.col("latest.event_type").alias("last_type"),
    )


def _full_cards(spark, sf):
    cards = plain_cards(spark, sf)
    known = {
        "parse_confidence": F.lit("High"), "bundle_priority": F.lit("Medium"), "sibling_model_ids": F.array("brand"),
        "source_page_url": F.lit("p"), "build_year_from": F.lit(2001), "discovered_at_utc": F.lit("2026-01-01 10:11:12").cast("timestamp"),
    }
    return cards.select(
        *[
            (F.col(f.name) if f.name in cards.columns else known.get(f.name, F.lit(None)).cast(f.dataType)).alias(f.name)
            for f in schemas.CARDS.fields
        ]
    )


def card_store(spark, sf):
    """Two versions written, the current one read back."""
    root = scratch_path(spark, "cards")
    cards = _full_cards(spark, sf)
    CS.write_cards(cards, root)
    kept = CS.write_cards(C.upsert_cards(CS.read_cards(spark, root), cards.withColumn("status", F.lit("Failed")).where("brand <> 'Brand#3'")), root)
    return kept.select("id", "brand", "model_name", "status", "build_year_from", F.array_join("sibling_model_ids", "|").alias("siblings"))


def manifests(spark, sf):
    """Manifest lines read back as text: names and enumerations in their JSON spelling."""
    root = scratch_path(spark, "manifest")
    CS.write_manifests(_full_cards(spark, sf).withColumn("brand", F.lit("VW")).withColumn("status", F.lit("MetadataOnly")), root)
    read = spark.read.schema("id string, modelName string, status string, buildYearFrom int, discoveredAtUtc string, brand string").json(f"{root}/manifest")
    return read.select("id", F.col("modelName").alias("model_name"), "status", F.col("buildYearFrom").alias("year"), F.col("discoveredAtUtc").alias("discovered"), "brand")


SIDECAR_FILE = (
    "concat('{\\n \"id\": \"s', s_suppkey, '\", \"brand\": \"', CASE WHEN s_suppkey % 7 = 0 THEN 'vw' WHEN s_suppkey % 7 = 1 THEN 'opel' ELSE 'skoda' END, "
    "'\", \"modelName\": \"', s_name, '\",\\n \"siblingModelIds\": [\"a\"], \"status\": \"metadataOnly\"', CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE '\\n}' END)"
)


#: Sidecar files that one task writes.
SIDECAR_ROWS = 500


def sidecars(spark, sf):
    """One JSON file per supplier card, every tenth one broken: good and corrupt files counted."""
    root = scratch_path(spark, "sidecars")
    files = table(spark, sf, "supplier").selectExpr("s_suppkey AS folder", f"{SIDECAR_FILE} AS value")
    # Each task moves its own files in place; the default has the driver move all of them, one after the other.
    writer = spread(files, SIDECAR_ROWS, "folder").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.partitionBy("folder").option("compression", "none").text(f"{root}/raw")
    # Spark names its text files .txt; the scan takes any name ending in .json or .txt here.
    cards, corrupt = CS.read_card_sidecars(spark, f"{root}/raw", "*.txt")
    return cards.select("id", "brand", "model_name", "status", F.lit(False).alias("corrupt")).unionByName(
        corrupt.select(
            F.concat(F.lit("s"), F.regexp_extract("file", "folder=([0-9]+)", 1)).alias("id"), F.lit(None).cast("string").alias("brand"),
            F.lit(None).cast("string").alias("model_name"), F.lit(None).cast("string").alias("status"), F.lit(True).alias("corrupt"),
        )
    )


def stock_store(spark, sf):
    """Orders per year as stock; the largest year is read without naming it."""
    root = scratch_path(spark, "stock")
    orders = table(spark, sf, "orders").selectExpr(
        "year(o_orderdate) AS year", "CAST(o_orderkey AS INT) AS row_no", "o_orderpriority AS segment", "o_orderstatus AS brand_label",
        "concat('c', o_custkey) AS model_series", "CAST(o_totalprice AS INT) AS count",
    )
    for (year,) in sorted(orders.select("year").distinct().collect()):
        rows = orders.where(F.col("year") == year)
        rejected = rows.where("count % 10 = 0").select("year", "row_no", F.lit("w").alias("warning"))
        SS.write_stock(rows, rejected, root, year, "u")
    year, rows = SS.read_stock(spark, root)
    meta = SS.read_stock_meta(spark, root).where(F.col("year") == year)
    return rows.groupBy("year", "segment").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("total")).join(
        meta.select("year", "row_count", "warning_count", F.col("license"), F.col("reference_date").cast("string").alias("reference_date")), "year"
    )


def csv_report(spark, sf):
    """Report lines with header and byte order mark; two names need quotes."""
    report = flagship(spark, sf).withColumn(
        "model_name", F.expr("CASE WHEN model_name = 'red gear' THEN 'red, \"gear\"' ELSE model_name END")
    )
    return RS.report_csv_lines(report)


def written_reports(spark, sf):
    """Both report files written and read back; the JSON keeps nulls and its own spelling."""
    root = scratch_path(spark, "report")
    report = flagship(spark, sf)
    RS.write_report_csv(report, f"{root}/csv")
    RS.write_report_json(report, f"{root}/json")
    lines = spark.read.text(f"{root}/csv").select(F.lit("csv").alias("kind"), "value")
    return lines.unionByName(spark.read.text(f"{root}/json").select(F.lit("json").alias("kind"), "value"))


# --- configuration documents and landed files, written from the given tables and read by their readers ---

_NATION_BRAND = "CASE n_regionkey WHEN 0 THEN 'vw' WHEN 1 THEN 'AUDI' WHEN 2 THEN 'Skoda' WHEN 3 THEN 'seat' ELSE 'Tesla' END"
_KNOWN_BRAND = "CASE n_regionkey WHEN 0 THEN 'VW' WHEN 1 THEN 'Audi' WHEN 2 THEN 'Skoda' WHEN 3 THEN 'Seat' END"


def _document(spark, name, rows, body):
    """One JSON document over all ``rows`` as a file of its own."""
    path = scratch_path(spark, name)
    rows.agg(F.expr(f"to_json({body}, map('ignoreNullFields', 'false'))").alias("value")).coalesce(1).write.text(path)
    return path


def alias_document(spark, sf):
    nation = table(spark, sf, "nation")
    path = _document(
        spark, "aliases", nation,
        "named_struct('Aliases', array_sort(collect_list(named_struct('order', n_nationkey, "
        f"'Brand', {_NATION_BRAND}, 'modelName', n_name, 'KBAmodelSeries', upper(n_name)))))",
    )
    return CF.read_aliases(spark, path).unionByName(CF.read_aliases(spark, f"{path}/missing.json"))


def sibling_document(spark, sf):
    members = table(spark, sf, "nation").groupBy("n_regionkey").agg(
        F.expr(f"array_sort(collect_list(named_struct('order', n_nationkey, 'brand', {_NATION_BRAND}, 'ModelName', n_name)))").alias("members")
    )
    regions = table(spark, sf, "region").join(members, F.col("r_regionkey") == F.col("n_regionkey"))
    path = _document(
        spark, "siblings", regions,
        "named_struct('groups', array_sort(collect_list(named_struct('order', r_regionkey, "
        "'groupId', concat('g', r_regionkey), 'platformName', r_name, 'members', members))))",
    )
    return CF.read_siblings(spark, path).unionByName(CF.read_siblings(spark, f"{path}/missing.json"))


def landed_pages(spark, sf):
    """Pages landed as JSON lines and as parquet, with a column more than declared."""
    pages = table(spark, sf, "pages")
    read = []
    for fmt in ("json", "parquet"):
        path = scratch_path(spark, "landed")
        pages.write.format(fmt).save(path)
        read.append(LD.read_pages(spark, path, fmt).select(F.lit(fmt).alias("fmt"), "url", F.md5("html").alias("html_md5")))
    return read[0].unionByName(read[1])


QUERIES = {
    "config_aliases": alias_document,
    "config_siblings": sibling_document,
    "landed_pages": landed_pages,
    "stock_rows": stock_from_sheets,
    "stock_warnings": sheet_warnings,
    "sheet_errors": broken_sheets,
    "preview_sheet": previews,
    "fill_down": filled_events,
    "group_pages": page_groups,
    "page_manifest": page_manifest,
    "replace_combined": replaced_cards,
    "split_summary": split_totals,
    "check_quality": quality_issues,
    "quality_gate": gate,
    "brand_issues_before_prioritize": gate_before_prioritize,
    "classify_fetch": fetch_outcomes,
    "build_cards": built_cards,
    "build_cards_dry_run": dry_run_cards,
    "run_summary": summary,
    "unexpected_failures": failures,
    "upsert_cards": upserted,
    "delete_cards": deleted,
    "first_and_latest": first_and_latest,
    "card_store": card_store,
    "manifests": manifests,
    "card_sidecars": sidecars,
    "stock_store": stock_store,
    "report_csv": csv_report,
    "report_files": written_reports,
}

# Sheet rows counted from the first used row (3), so the header is row 4 and data starts at row 6.
_SHEET = f"""
r AS (SELECT {_BOOK} AS book, {_BOOK_YEAR} AS year, {_ROW} - 2 AS row_no, trim({_SEGMENT}) AS seg, {_SERIES} AS series, {_COUNT} AS cnt, p_partkey, p_size FROM part),
f AS (SELECT *, coalesce(last_value(nullif(seg, '') IGNORE NULLS) OVER (PARTITION BY book, year ORDER BY row_no), '') AS segment FROM r),
d AS (SELECT * FROM f WHERE series <> '')"""
_DOC = "'ENUS-01-' || (conv_id % 1000) || '-' || (turn % 3)"
_GROUPS = f"""
pages AS (SELECT 'porsche/all/doc' || conv_id || '.pdf' AS source_doc, conv_id, CAST(turn + 1 AS INTEGER) AS page_no, {_DOC} AS doc_id,
  CASE WHEN role = 'assistant' OR strpos(text, 'Porsche AG,') > 0 THEN
    regexp_replace(substr({_PAGE_TEXT}, strpos({_PAGE_TEXT}, 'Porsche AG,') + 11, 200), '^\\s+|\\s+$', '', 'g') END AS header,
  turn, role FROM conversations WHERE turn % 5 <> 4),
groups AS (SELECT source_doc, conv_id, doc_id, min(page_no) AS first_page, count(*) AS page_count,
  arg_min(header, page_no) FILTER (header IS NOT NULL) AS header,
  min(turn) FILTER (header IS NOT NULL) AS header_turn FROM pages GROUP BY ALL)"""
_MODEL_OF_GROUP = "CASE WHEN header IS NULL THEN doc_id ELSE 'Boxster ' || header_turn END"
_COMBINED = f"cc AS (SELECT {sql_columns(_COMBINED_CARD)}, conv_id FROM (SELECT DISTINCT conv_id FROM conversations))"
_SPLIT = f"""{_GROUPS}, {_COMBINED},
picked AS (SELECT * FROM cc WHERE brand = 'Porsche' AND local_pdf_relative_path IS NOT NULL AND lower(variant) LIKE 'rescue data sheets%'),
made AS (SELECT p.id AS combined_id, {_MODEL_OF_GROUP} AS model_name, doc_id, header IS NULL AS unread, p.source_page_url, p.conv_id
  FROM groups g JOIN picked p ON g.source_doc = p.local_pdf_relative_path),
named AS (SELECT *, lower(replace(model_name, ' ', '-')) AS slug, 'porsche-' || lower(replace(model_name, ' ', '-')) ||
  CASE WHEN unread THEN '' ELSE '-20' || (10 + conv_id % 10) || '-cabriolet' END || '-en-' || substr(sha256(combined_id || '|' || doc_id), 1, 8) AS id FROM made)"""
_FAULTY_SQL = f"c AS (SELECT {sql_columns(_FAULTY)} FROM part)"
_ISSUES = f"""{_FAULTY_SQL},
b AS (SELECT brand, count(*) AS n, count(*) FILTER (bundle_priority = 'Unknown') AS u FROM c GROUP BY brand),
issues AS (
SELECT id AS card_id, brand, 'BodyTypeLooksLikeYear' AS kind, 'BodyType ''' || body_type || ''' looks like a year or year range, not a body style - probably a shifted field.' AS description
  FROM c WHERE pos % 12 IN (0, 1)
UNION ALL SELECT id, brand, 'FuelTypeIsBareDigits', 'FuelType ''' || fuel_type || ''' is just digits, not a fuel/drivetrain description - probably a shifted field.'
  FROM c WHERE pos % 17 = 0
UNION ALL SELECT id, arg_min(brand, pos), 'DuplicateId', 'Id ''' || id || ''' appears ' || count(*) || ' times in this dataset.' FROM c GROUP BY id HAVING count(*) > 1
UNION ALL SELECT brand, brand, 'BrandEntirelyUnknownPriority', 'Every one of ' || n || ' ' || brand || ' cards has BundlePriority.Unknown, even though other brands in this dataset matched real KBA stock rows - likely a brand-matching gap (e.g. a missing BrandNames alias), not genuinely 100% untracked models.'
  FROM b WHERE n = u
UNION ALL SELECT brand, brand, 'BrandUnknownPriorityCountAboveBaseline', brand || ' has ' || u || ' cards with BundlePriority.Unknown, more than the expected baseline of 0 - a newly unmatched model may need a model-aliases.json entry, or an existing alias broke.'
  FROM b WHERE brand = 'Brand#1' AND u > 0 AND n <> u)"""
_OUTCOMES = f"""
outcomes AS (SELECT url, event_type FROM (SELECT {_FETCH['url']} AS url, event_type, ts FROM events)
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts DESC) = 1),
classified AS (SELECT url, event_type = 'click' AS success, CASE event_type WHEN 'view' THEN 'HTTP 404 Not Found'
  WHEN 'purchase' THEN 'Unexpected Content-Type ''text/html'' instead of PDF (possibly an auth-gateway redirect)'
  WHEN 'error' THEN 'no route' WHEN 'signup' THEN 'Timeout: slow' END AS failure_reason,
  CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 404 END AS http_status FROM outcomes)"""
_BUILT = f"""
e AS (SELECT p_partkey, p_brand AS brand, p_name AS model_name, {_ENTRY_URL} AS download_url, lower(p_brand) || '-' || replace(p_name, ' ', '-') || '-' ||
  lower(p_type) || '-de-' || substr(sha256(p_name || '/' || (p_partkey % 5)), 1, 8) AS id FROM part)"""
_REPORT_LINES = f"""
WITH {_MATCH_CTE}, rep AS (SELECT brand, model_name, count(*) AS n, count(*) FILTER (status <> 'Downloaded') AS nd,
  min(estimated_fleet_size) AS fleet, min(bundle_priority) AS prio FROM prioritized GROUP BY brand, model_name)"""
# Reading text files back drops the byte order mark, so only the rendered lines carry it.
_READ_HEADER_LINE = f"SELECT '{fv.REPORT_CSV_HEADER}' AS value"
_HEADER_LINE = f"SELECT chr(65279) || '{fv.REPORT_CSV_HEADER}' AS value"

ORACLE = {
    "config_aliases": f"""
SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS pos, {_KNOWN_BRAND} AS brand, n_name AS model_name, upper(n_name) AS model_series FROM nation""",
    "config_siblings": f"""
SELECT CAST(dense_rank() OVER (ORDER BY r_regionkey) - 1 AS INTEGER) AS group_pos, 'g' || r_regionkey AS group_id, r_name AS platform_name, {_KNOWN_BRAND} AS brand,
  n_name AS model_name FROM region JOIN nation ON n_regionkey = r_regionkey""",
    "landed_pages": "SELECT fmt, url, md5(html) AS html_md5 FROM pages, (VALUES ('json'), ('parquet')) t(fmt)",
    "stock_rows": f"""WITH {_SHEET}
SELECT book, year, row_no, segment, split_part(series, ' ', 1) AS brand_label,
  CASE WHEN series = 'SONSTIGE' THEN '' ELSE substr(series, 7) END AS model_series, CAST(p_size * 100 AS INTEGER) AS count FROM d WHERE cnt <> '.'""",
    "stock_warnings": f"""WITH {_SHEET}
SELECT book, year, row_no, 'Row ' || row_no || ': count for ''' || series || ''' is not a number (''.'') - skipped.' AS warning FROM d WHERE cnt = '.'
UNION ALL SELECT DISTINCT book, 2026, 4, 'The count column header (''Anzahl 2025'') does not contain the expected year 2026.' FROM r WHERE book = 'book1' AND year = 2026""",
    "sheet_errors": f"""
SELECT DISTINCT {_BOOK} AS book, {_BOOK_YEAR} AS year, CASE p_partkey % 3 WHEN 0 THEN 'No ''FZ 12.1'' worksheet found in the FZ12 2026 file - the layout has likely changed.'
  ELSE 'Header row (''Segment''/''Modellreihe'') not found in FZ12 2025 - the layout has likely changed.' END AS error
FROM part WHERE p_partkey % 3 <> 1""",
    "preview_sheet": f"""WITH {_SHEET}, books AS (SELECT DISTINCT book, year FROM r)
SELECT book, year, 'Cover' AS sheet, 1 AS row_no, 'x' AS line FROM books
UNION ALL SELECT book, year, 'fz 12.1', CAST(n AS INTEGER), CASE n WHEN 1 THEN 'title | ' WHEN 4 THEN ' segment | Modellreihe ' ELSE ' | ' END FROM books, range(1, 6) t(n)
UNION ALL SELECT {_BOOK}, {_BOOK_YEAR}, 'fz 12.1', 6, {_SEGMENT} || ' | ' || {_SERIES} FROM part WHERE p_partkey < 3""",
    "fill_down": """SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN 'u' || user_id END IGNORE NULLS) OVER (ORDER BY event_id) AS label FROM events""",
    "group_pages": f"""WITH {_GROUPS}
SELECT source_doc, doc_id, first_page, page_count, md5(header) AS header_hash, {_MODEL_OF_GROUP} AS model_name,
  CAST(CASE WHEN header IS NOT NULL THEN 2010 + conv_id % 10 END AS INTEGER) AS build_year_from,
  CASE WHEN header IS NULL THEN 'Unparsed' ELSE 'Heuristic' END AS parse_confidence FROM groups""",
    "page_manifest": f"WITH {_GROUPS} SELECT source_doc, doc_id, page_no FROM pages",
    "replace_combined": f"""WITH {_SPLIT}
SELECT id, 'Porsche' AS brand, model_name, 'Downloaded' AS status, source_page_url, 'porsche/' || slug || '/' || id || '.pdf' AS local_pdf_relative_path FROM named
UNION ALL SELECT id, brand, model_name, status, source_page_url, local_pdf_relative_path FROM cc WHERE id NOT IN (SELECT combined_id FROM made)""",
    "split_summary": f"""WITH {_SPLIT} SELECT count(DISTINCT combined_id) AS documents_processed, count(*) AS cards_created FROM made""",
    "check_quality": f"WITH {_ISSUES} SELECT * FROM issues",
    "quality_gate": f"WITH {_ISSUES} SELECT (SELECT count(*) FROM issues) AS issue_count, (SELECT count(*) FROM c) AS card_count, (SELECT count(*) FROM issues) = 0 AS passed",
    "brand_issues_before_prioritize": f"""WITH {_ISSUES}
SELECT 'after' AS state, brand, kind FROM issues WHERE kind IN ('BrandEntirelyUnknownPriority', 'BrandUnknownPriorityCountAboveBaseline')""",
    "classify_fetch": f"WITH {_OUTCOMES} SELECT * FROM classified",
    "build_cards": f"""WITH {_OUTCOMES}, {_BUILT}
SELECT id, brand, model_name, CASE WHEN download_url IS NULL THEN 'Failed' WHEN success THEN 'Downloaded' ELSE 'MetadataOnly' END AS status,
  download_url, CASE WHEN download_url IS NULL THEN 'No download URL discovered' ELSE failure_reason END AS failure_reason, 'Unknown' AS bundle_priority,
  CASE WHEN success THEN lower(brand[1]) || brand[2:5] || '#' || split_part(brand, '#', 2) || '/' || replace(model_name, ' ', '-') || '/' || id || '.pdf' END AS local_pdf_relative_path,
  CASE WHEN model_name LIKE '%gear' THEN 'gears' ELSE '' END AS siblings, coalesce(success, false) AS has_download_time, CAST(p_partkey AS INTEGER) AS link
FROM e LEFT JOIN classified ON url = download_url""",
    "build_cards_dry_run": f"""WITH {_BUILT}
SELECT id, brand, model_name, CASE WHEN download_url IS NULL THEN 'Failed' ELSE 'MetadataOnly' END AS status, download_url,
  CASE WHEN download_url IS NULL THEN 'No download URL discovered' ELSE 'dry-run: download skipped' END AS failure_reason,
  'Unknown' AS bundle_priority, CAST(p_partkey AS INTEGER) AS link FROM e""",
    "run_summary": """
SELECT c_mktsegment AS brand, CASE WHEN c_mktsegment LIKE 'A%' THEN 'NotImplemented' ELSE 'Completed' END AS outcome, count(*) AS discovered,
  count(*) FILTER (c_custkey % 3 = 0) AS downloaded, count(*) FILTER (c_custkey % 3 = 1) AS metadata_only, count(*) FILTER (c_custkey % 3 = 2) AS failed,
  CASE WHEN c_mktsegment LIKE 'A%' THEN 'not implemented' ELSE '' END AS note,
  CASE WHEN c_mktsegment LIKE 'A%' THEN 'not implemented' ELSE '' END AS short_note FROM customer GROUP BY c_mktsegment
UNION ALL SELECT 'SILENT', 'Completed', 0, 0, 0, 0, '', '' UNION ALL SELECT 'BROKEN', 'DiscoveryFailed', 0, 0, 0, 0, 'a message that is clearly longer than forty characters', 'a message that is clearly longer than f…'""",
    "unexpected_failures": """
WITH n AS (SELECT n_name AS brand, n_regionkey AS region, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0) AS discovered FROM nation)
SELECT brand, CASE region WHEN 0 THEN 'DiscoveryFailed' ELSE 'Completed' END AS outcome, discovered FROM n WHERE region = 0 OR (region > 1 AND discovered = 0)""",
    "upsert_cards": """
WITH ex AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
inc AS (SELECT * FROM orders WHERE o_orderkey % 2 = 1 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
u AS (SELECT * FROM inc UNION ALL SELECT * FROM ex WHERE o_custkey NOT IN (SELECT o_custkey FROM inc))
SELECT o_orderkey, o_custkey AS id, o_orderstatus AS status, o_orderpriority AS note FROM u""",
    "delete_cards": "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "first_and_latest": """SELECT user_id, min(event_id) AS first_id, arg_min(event_type, event_id) AS first_type, max(event_id) AS last_id,
  arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id""",
    "card_store": f"""
WITH c AS ({_CARDS_SQL}) SELECT id, brand, model_name, CASE WHEN brand <> 'Brand#3' THEN 'Failed' ELSE status END AS status, 2001 AS build_year_from,
  brand AS siblings FROM c""",
    "manifests": f"""
WITH c AS ({_CARDS_SQL}) SELECT id, model_name, 'metadataOnly' AS status, 2001 AS year, '2026-01-01T10:11:12.000000Z' AS discovered, 'vw' AS brand FROM c""",
    "card_sidecars": """
SELECT 's' || s_suppkey AS id, CASE WHEN bad THEN NULL WHEN s_suppkey % 7 = 0 THEN 'VW' ELSE 'Skoda' END AS brand, CASE WHEN NOT bad THEN s_name END AS model_name,
  CASE WHEN NOT bad THEN 'MetadataOnly' END AS status, bad AS corrupt FROM (SELECT *, s_suppkey % 10 = 0 OR s_suppkey % 7 = 1 AS bad FROM supplier)""",
    "stock_store": f"""
WITH o AS (SELECT *, CAST(trunc(o_totalprice) AS BIGINT) AS c FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders))
SELECT CAST(max(year(o_orderdate)) AS INTEGER) AS year, o_orderpriority AS segment, count(*) AS n, CAST(sum(c) AS BIGINT) AS total, (SELECT count(*) FROM o) AS row_count,
  (SELECT count(*) FROM o WHERE c % 10 = 0) AS warning_count, '{fv.STOCK_LICENSE}' AS license, CAST(max(year(o_orderdate)) AS VARCHAR) || '-01-01' AS reference_date FROM o GROUP BY o_orderpriority""",
    "report_csv": f"""{_REPORT_LINES}
{_HEADER_LINE} UNION ALL SELECT brand || ',' || CASE WHEN model_name = 'red gear' THEN '"red, ""gear""' || '"' ELSE coalesce(model_name, '') END || ',' || n || ',' || nd
  || ',' || coalesce(fleet::VARCHAR, '') || ',' || prio FROM rep""",
    "report_files": f"""{_REPORT_LINES}
SELECT 'csv' AS kind, * FROM ({_READ_HEADER_LINE} UNION ALL SELECT brand || ',' || coalesce(model_name, '') || ',' || n || ',' || nd
  || ',' || coalesce(fleet::VARCHAR, '') || ',' || prio FROM rep)
UNION ALL SELECT 'json', '{{"brand":"' || lower(brand[1]) || brand[2:] || '","modelName":' || coalesce('"' || model_name || '"', 'null') || ',"cardCount":' || n
  || ',"notDownloadedCount":' || nd || ',"estimatedFleetSize":' || coalesce(fleet::VARCHAR, 'null') || ',"bundlePriority":"' || lower(prio) || '"}}' FROM rep""",
}
