import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cutline import fixed_values as fv
from cutline import schemas
from cutline.operators import cards as C
from cutline.operators import match as M
from cutline.operators import ordered as O
from cutline.operators import quality as Q
from cutline.operators import report as R
from cutline.operators import sheet as S
from cutline.operators import split as P
from cutline.session import stored


def card_rows(spark, rows, columns):
    df = spark.createDataFrame(rows, columns)
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schemas.CARDS.fields]
    )


@pytest.fixture(scope="module")
def stock(spark):
    rows = [
        (2026, 1, "KLEINWAGEN", "VW", "POLO", 150_000),
        (2026, 2, "KLEINWAGEN", "SKODA", "FABIA", 30_000),
        (2026, 3, "SUVS", "SEAT", "FORMENTOR", 25_000),
        (2026, 4, "SPORT", "PORSCHE", "911", 99_999),
        (2026, 5, "SUVS", "VW", "ID.4, ID.5", 5_000),
        (2026, 6, "KLEINWAGEN", "VOLKSWAGEN", "Polo", 1),
        (2026, 7, "X", "VW", "", 77),
    ]
    return schemas.literal_frame(spark, rows, schemas.STOCK)


def matches(spark, stock, names, **kwargs):
    cards = card_rows(spark, [(str(i), b, n) for i, (b, n) in enumerate(names)], "id string, brand string, model_name string")
    out = M.match_fleet(cards, stock, schemas.brand_labels(spark), schemas.bundled_aliases(spark), **kwargs)
    got = {r["id"]: (r["estimated_fleet_size"], r["bundle_priority"], r["matched_via_alias"]) for r in out.collect()}
    return [got[str(i)] for i in range(len(names))]


def test_match_fleet(spark, stock):
    names = [
        ("VW", "Polo"), ("Skoda", "Fabia"), ("Cupra", "Formentor"), ("Seat", "FORMENTOR"), ("Porsche", "964"),
        ("VW", "ID.4"), ("VW", "ID.3"), ("Audi", "Polo"), ("VW", None), ("VW", "  "), ("VW", "!?"), ("Porsche", "911"),
    ]
    unknown = (None, "Unknown", False)
    assert matches(spark, stock, names) == [
        (150_000, "High", False), (30_000, "Medium", False), (25_000, "Medium", False), (25_000, "Medium", False),
        (99_999, "Medium", True), (5_000, "Low", True), unknown, unknown, unknown, unknown, (77, "Low", False),
        (99_999, "Medium", False),
    ]


def test_match_thresholds_are_parameters(spark, stock):
    assert matches(spark, stock, [("VW", "Polo"), ("Skoda", "Fabia")], high=200_000, medium=31_000) == [
        (150_000, "Medium", False), (30_000, "Low", False),
    ]


def test_direct_match_beats_alias(spark, stock):
    extra = stock.unionByName(schemas.literal_frame(spark, [(2026, 9, "S", "VW", "ID.4", 42)], schemas.STOCK))
    assert matches(spark, extra, [("VW", "ID.4"), ("VW", "ID.5")]) == [(42, "Low", False), (5_000, "Low", True)]


def test_match_is_the_same_without_broadcast(spark, stock):
    names = [("VW", "Polo"), ("Porsche", "996"), ("VW", None)] * 3
    expected = matches(spark, stock, names)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert matches(spark, stock, names) == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_siblings(spark):
    cards = card_rows(
        spark,
        [("1", "VW", "t roc"), ("2", "Cupra", "Ateca"), ("3", "VW", "Up"), ("4", "VW", None), ("5", "Skoda", "Ateca")],
        "id string, brand string, model_name string",
    )
    got = {r["id"]: r["sibling_model_ids"] for r in M.attach_siblings(cards, schemas.bundled_siblings(spark)).collect()}
    assert got == {
        "1": ["mqb-a0-compact-suv-family"], "2": ["mqb-evo-midsize-suv-family"], "3": [], "4": [], "5": [],
    }


def test_siblings_keep_configuration_order(spark):
    rows = [(2, "late", "p", "VW", "Golf"), (0, "z-first", "p", "VW", "GOLF"), (1, "a-second", "p", "VW", "Golf"), (1, "a-second", "p", "VW", "Go-lf")]
    groups = schemas.literal_frame(spark, rows, schemas.SIBLINGS)
    cards = card_rows(spark, [("1", "VW", "golf")], "id string, brand string, model_name string")
    assert M.attach_siblings(cards, groups).first()["sibling_model_ids"] == ["z-first", "a-second", "late"]


PRIORITIZED = "id string, brand string, model_name string, status string, estimated_fleet_size int, bundle_priority string"


def test_priority_report(spark):
    cards = card_rows(
        spark,
        [
            ("1", "VW", "Golf", "Downloaded", 9, "Low"), ("2", "VW", "Golf", "MetadataOnly", 9, "Low"),
            ("3", "VW", "Golf", "Failed", 9, "Low"), ("4", "Seat", "Golf", "Downloaded", None, "Unknown"),
            ("5", "VW", None, "Failed", None, "Unknown"), ("6", "VW", "", "Failed", None, "Unknown"),
            ("7", "Audi", "a4", "Downloaded", 200_000, "High"), ("8", "Audi", "A3", "Downloaded", 9, "Low"),
        ],
        PRIORITIZED,
    )
    assert [tuple(r) for r in R.priority_report(cards).collect()] == [
        ("Audi", "a4", 1, 0, 200_000, "High"), ("Audi", "A3", 1, 0, 9, "Low"), ("VW", "Golf", 3, 2, 9, "Low"),
        ("VW", None, 1, 1, None, "Unknown"), ("VW", "", 1, 1, None, "Unknown"), ("Seat", "Golf", 1, 0, None, "Unknown"),
    ]


@pytest.mark.parametrize("second", [(10, "Low"), (9, "Medium"), (None, "Low")])
def test_disagreeing_cards_are_an_error(spark, second):
    cards = card_rows(
        spark, [("1", "VW", "Golf", "Downloaded", 9, "Low"), ("2", "VW", "Golf", "Downloaded", *second)], PRIORITIZED
    )
    with pytest.raises(PySparkException, match="VW/Golf disagree"):
        R.priority_report(cards).collect()


def test_distribution_is_zero_filled_and_ordered(spark):
    cards = card_rows(spark, [("1", "High"), ("2", "High")], "id string, bundle_priority string")
    got = R.priority_distribution(cards, schemas.priority_dim(spark)).collect()
    assert [tuple(r) for r in got] == [("Unknown", 0), ("Low", 0), ("Medium", 0), ("High", 2)]


def test_run_summary_and_gate(spark):
    results = spark.createDataFrame(
        [("VW", "Downloaded"), ("VW", "MetadataOnly"), ("VW", "Failed"), ("VW", "Downloaded")], "brand string, status string"
    )
    runs = schemas.literal_frame(
        spark,
        [("Seat", "Completed", None), ("Audi", "DiscoveryFailed", "x" * 50), ("VW", "Completed", "ignored"), ("Porsche", "NotImplemented", None)],
        schemas.BRAND_RUNS,
    )
    summary = R.run_summary(results, runs, schemas.brand_dim(spark))
    assert [tuple(r) for r in summary.collect()] == [
        ("VW", "Completed", 4, 2, 1, 1, "", ""), ("Audi", "DiscoveryFailed", 0, 0, 0, 0, "x" * 50, "x" * 39 + "…"),
        ("Seat", "Completed", 0, 0, 0, 0, "", ""), ("Porsche", "NotImplemented", 0, 0, 0, 0, *["not implemented"] * 2),
    ]
    assert {r["brand"] for r in R.unexpected_failures(summary).collect()} == {"Audi", "Seat"}


QUALITY = "id string, brand string, body_type string, fuel_type string, bundle_priority string"


def kinds(spark, rows):
    issues = Q.check_quality(card_rows(spark, rows, QUALITY), schemas.unknown_baselines(spark))
    return sorted((r["kind"], r["card_id"]) for r in issues.collect())


def test_card_quality_rules(spark):
    rows = [
        ("1", "VW", "2018", "GD", "Low"), ("2", "VW", "2019-2023", "7", "Low"), ("3", "VW", "SUV 2018", "E85", "Low"),
        ("4", "VW", None, None, "Low"), ("5", "VW", "1899", "", "Low"), ("d", "VW", "SUV", "GD", "Low"), ("d", "Seat", "SUV", "GD", "Low"),
    ]
    assert kinds(spark, rows) == [
        ("BodyTypeLooksLikeYear", "1"), ("BodyTypeLooksLikeYear", "2"), ("DuplicateId", "d"), ("FuelTypeIsBareDigits", "2"),
    ]


def brand_of(brand, unknown, known):
    states = ["Unknown"] * unknown + ["High"] * known
    return [(f"{brand}{i}", brand, "SUV", "GD", state) for i, state in enumerate(states)]


@pytest.mark.parametrize(
    "rows,expected",
    [
        (brand_of("Cupra", 2, 0) + brand_of("VW", 0, 1), [("BrandEntirelyUnknownPriority", "Cupra")]),
        (brand_of("Cupra", 2, 0) + brand_of("VW", 3, 0), []),
        (brand_of("Porsche", 19, 66), []),
        (brand_of("Porsche", 20, 66), [("BrandUnknownPriorityCountAboveBaseline", "Porsche")]),
        (brand_of("Porsche", 25, 0) + brand_of("VW", 0, 1), [("BrandEntirelyUnknownPriority", "Porsche")]),
        (brand_of("VW", 25, 1), []),
        ([], []),
    ],
)
def test_brand_quality_rules(spark, rows, expected):
    assert kinds(spark, rows) == expected


def test_fill_down_against_loop(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    for key in ("a", "b", "hot"):
        last = None
        for position in range(300 if key == "hot" else 40):
            value = f"{key}{position}" if rng.random() < 0.05 else None
            last = value or last
            rows.append((key, position, value))
            expected[key, position] = last
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, p int, v string").repartition(3)
    got = {(r["k"], r["p"]): r["v"] for r in O.fill_down(df, ["k"], "p", "v", block_rows=16).collect()}
    assert got == expected


def test_fill_down_of_blocks_of_blocks(spark):
    rows = [("hot" if p % 7 else None, p * 3, f"v{p}" if p % 41 == 3 else None) for p in range(400)]
    rows += [(f"k{p}", 0, None) for p in range(60)] + [("z", None, "first"), ("z", 5, None)]
    last, expected = {}, {}
    for key, position, value in sorted(rows, key=lambda r: (r[0] or "", r[1] or 0)):
        last[key] = value or last.get(key)
        expected[key, position] = last[key]
    df = spark.createDataFrame(rows, "k string, p int, v string").repartition(5)
    filled = O.fill_down(df, ["k"], "p", "v", block_rows=4)
    assert {(r["k"], r["p"]): r["v"] for r in filled.collect()} == expected and filled.count() == len(rows)
    assert O.fill_down(df.where("p < 0"), ["k"], "p", "v").isEmpty()


def test_fill_down_of_sparse_positions(spark, monkeypatch):
    """One key, 100,000 positions over the whole range of 64 bits: every window stays within the default block."""
    step = (1 << 63) // 50_000 - 1
    df = spark.range(100_000).selectExpr("'all' AS k", f"(id - 50000) * {step}L AS p", "if(id % 30000 = 7, id, NULL) AS v")
    seen = []
    monkeypatch.setattr(O, "stored", lambda df, name: seen.append((name, kept := stored(df, name))) or kept)
    filled = O.fill_down(df, ["k"], "p", "v").selectExpr("p", "v").orderBy("p").collect()
    assert [r["v"] for r in filled] == [None if i < 7 else (i - 7) // 30_000 * 30_000 + 7 for i in range(100_000)]
    numbered = next(df for name, df in seen if name == "numbered")
    most = numbered.groupBy(F.floor(F.col("_at") / 65_536)).count().agg(F.max("count")).first()[0]
    assert 1 < most <= 65_536


def test_global_rank(spark):
    rows = [(i * 37 % 101, f"x{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(6)
    got = O.global_rank(df, [F.col("a").desc(), "b"]).collect()
    ordered = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["rank"])] == ordered
    assert sorted(r["rank"] for r in got) == list(range(1, 501))
    assert O.global_rank(df.where("a < 0"), ["a"]).isEmpty()


def test_first_and_latest(spark):
    df = spark.createDataFrame([("k", 3, None), ("k", 1, "x"), ("k", 2, "y"), ("m", None, "z")], "k string, p int, v string")
    assert {tuple(r) for r in O.first_by(df, ["k"], F.col("p")).collect()} == {("k", 1, "x"), ("m", None, "z")}
    assert {tuple(r) for r in O.latest_by(df, ["k"], F.col("p")).collect()} == {("k", 3, None), ("m", None, "z")}


def test_unambiguous_links(spark):
    rows = [
        (1, 0, "en.pdf", "ENGLISH"), (1, 1, "de.pdf", "Deutsche"), (1, 2, "de2.pdf", "DEUTSCHE"), (1, 3, "de2.pdf", "OTHER"),
        (2, 0, "zh.pdf", "中文"), (2, 1, "zh.pdf", "DEUTSCHE"), (2, 2, "ok.pdf", "DEUTSCHE"),
        (3, 0, "x.pdf", None), (3, 1, "x.pdf", "DEUTSCHE"), (4, 0, "fr.pdf", "FRANÇAIS"),
    ]
    df = spark.createDataFrame(rows, "item int, pos int, href string, label string")
    got = O.unambiguous_links(df, ["item"], F.upper("label") == fv.GERMAN_BUTTON_LABEL)
    assert [tuple(r) for r in got.collect()] == [(1, "de.pdf", 1)]


def sheet(spark, grid, name="FZ 12.1", book="b", pos=2, top=3, left=2, year=2026):
    rows = []
    for r, line in enumerate(grid):
        for c, value in enumerate(line):
            if value is not None:
                kind = "number" if isinstance(value, (int, float)) else "text"
                rows.append((book, year, name, pos, top + r, left + c, kind, str(value)))
    return schemas.literal_frame(spark, rows, schemas.SHEET_CELLS)


GRID = [
    ["Bestand", None, None],
    ["BESTAND INSGESAMT", None, 1],
    [" SEGMENT ", "modellreihe", "Anzahl 2026"],
    ["units", None, None],
    ["MINIS", "VW UP ", 1234.9],
    [None, "SEAT MII", "."],
    [None, "SONSTIGE", 7],
    ["MINIS ZUSAMMEN", None, 99],
    ["SUVS", "SKODA KAROQ", 500],
    ["Bestand Insgesamt", None, 9999],
    ["LATE", "VW LATE", 1],
]


def test_stock_sheet(spark):
    cells = sheet(spark, [["x"]], name="FZ 12.2", pos=1).unionByName(sheet(spark, GRID))
    rows = S.sheet_rows(cells)
    layout = S.book_layout(rows)
    assert tuple(layout.first()) == ("b", 2026, 3, "Anzahl 2026", 10)
    region = S.data_region(rows, layout)
    got = sorted(tuple(r)[2:] for r in S.stock_rows(region).collect())
    assert got == [
        (5, "MINIS", "VW", "UP", 1234), (7, "MINIS", "SONSTIGE", "", 7), (9, "SUVS", "SKODA", "KAROQ", 500),
    ]
    warnings = [r["warning"] for r in S.stock_warnings(region, layout).collect()]
    assert warnings == ["Row 6: count for 'SEAT MII' is not a number ('.') - skipped."]
    assert S.sheet_errors(cells, layout).isEmpty()


def test_one_book_name_in_two_years(spark):
    """Each workbook has its own sheet, corner, header, segments and end."""
    later = [["Segment", "Modellreihe", "Anzahl 2025", "wide"], [None, None, None], ["VANS", "OPEL COMBO", 5], [None, "OPEL ZAFIRA", "-"]]
    cells = sheet(spark, GRID).unionByName(sheet(spark, later, name="FZ 12", top=9, left=7, year=2025))
    cells = cells.unionByName(sheet(spark, [["x"]], name="Other", year=2024))
    rows = S.sheet_rows(cells)
    layout = S.book_layout(rows)
    region = S.data_region(rows, layout)
    got = sorted(tuple(r)[1:] for r in S.stock_rows(region).collect())
    assert got == [
        (2025, 3, "VANS", "OPEL", "COMBO", 5),
        (2026, 5, "MINIS", "VW", "UP", 1234), (2026, 7, "MINIS", "SONSTIGE", "", 7), (2026, 9, "SUVS", "SKODA", "KAROQ", 500),
    ]
    warnings = sorted((r["year"], r["row_no"]) for r in S.stock_warnings(region, layout).collect())
    assert warnings == [(2025, 4), (2026, 6)]
    assert [r["year"] for r in S.sheet_errors(cells, layout).collect()] == [2024]
    assert S.preview_sheet(cells, 1, 3).count() == 3


def test_sheet_cells_are_read_once(spark, tmp_path):
    """The plan of the rows reads what was stored of the sheet, twice at most, and never the cells again."""
    sheet(spark, GRID).write.parquet(str(tmp_path / "cells"))
    cells = spark.read.parquet(str(tmp_path / "cells"))
    region = S.data_region(S.sheet_rows(cells))
    plan = S.stock_rows(region)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2 and "/cells" not in plan


def test_equal_rows_of_two_books_have_a_stated_winner(spark):
    rows = [(2026, 9, "S", "VW", "POLO", n, book) for n, book in ((5, "b"), (7, "a"), (3, "c"), (9, "a"))]
    stock = spark.createDataFrame(rows, schemas.STOCK_OF_BOOKS)
    labels = schemas.brand_labels(spark)
    assert {r["count"] for r in M.stock_index(stock, labels).collect()} == {7}


def test_stock_sheet_of_another_year_and_fallback_sheet(spark):
    grid = [[a, b, "Anzahl 2025" if c == "Anzahl 2026" else c] for a, b, c in GRID]
    cells = sheet(spark, grid, name="fz 12 neu", pos=5).unionByName(sheet(spark, [["x"]], name="FZ 12 z", pos=9))
    layout = S.book_layout(S.sheet_rows(cells))
    warnings = [r["warning"] for r in S.stock_warnings(S.data_region(S.sheet_rows(cells), layout), layout).collect()]
    assert "The count column header ('Anzahl 2025') does not contain the expected year 2026." in warnings


def test_stock_sheet_errors(spark):
    cells = (
        sheet(spark, [["x"]], name="Other", book="no-sheet")
        .unionByName(sheet(spark, [["Segment", "x", "y"]], book="no-header"))
        .unionByName(sheet(spark, [[""]], book="empty"))
        .unionByName(sheet(spark, GRID, book="fine"))
        .unionByName(sheet(spark, [["x"]] * 20 + GRID, book="late-header"))
    )
    errors = {r["book"]: r["error"] for r in S.sheet_errors(cells, S.book_layout(S.sheet_rows(cells))).collect()}
    assert set(errors) == {"no-sheet", "no-header", "empty", "late-header"}
    assert errors["no-sheet"].startswith("No 'FZ 12.1' worksheet") and errors["empty"].endswith("is empty.")


def test_preview(spark):
    cells = sheet(spark, [["a", None, 3], [None, None, None], ["b", "c", None]]).unionByName(
        sheet(spark, [[str(i) for i in range(12)]], name="wide")
    )
    got = {(r["sheet"], r["row_no"]): r["line"] for r in S.preview_sheet(cells).collect()}
    assert got == {
        ("FZ 12.1", 1): "a |  | 3", ("FZ 12.1", 2): " |  | ", ("FZ 12.1", 3): "b | c | ",
        ("wide", 1): " | ".join(str(i) for i in range(8)),
    }
    assert S.preview_sheet(cells, rows=1).count() == 2


def test_split(spark):
    pages = spark.createDataFrame(
        [
            ("porsche/all-models/c1.pdf", 1, "legal notice"),
            ("porsche/all-models/c1.pdf", 2, "Porsche AG, Macan, Macan S SUV from Model Year 2014 ID no. ENUS-01-710-0001 Version no. 1 Page 1"),
            ("porsche/all-models/c1.pdf", 3, "x ID no. ENUS-01-710-0002 Page 1"),
            ("porsche/all-models/c1.pdf", 4, "y ID no. enus-01-710- 0001 Page 2"),
            ("unrelated.pdf", 1, "Porsche AG, Nope ID no. ENUS-01-710-0009"),
        ],
        schemas.PDF_PAGES,
    )
    manifest = sorted((r["doc_id"], r["page_no"]) for r in P.page_manifest(pages).where("source_doc like 'porsche%'").collect())
    assert manifest == [("ENUS-01-710-0001", 2), ("ENUS-01-710-0001", 4), ("ENUS-01-710-0002", 3)]

    columns = "id string, brand string, variant string, status string, source_page_url string, local_pdf_relative_path string"
    cards = card_rows(
        spark,
        [
            ("c1", "Porsche", "rescue data sheets", "Downloaded", "src", "porsche/all-models/c1.pdf"),
            ("c2", "Porsche", "Rescue Data Sheets classic", "Downloaded", "src", "porsche/all-models/c2.pdf"),
            ("c3", "Porsche", "Rescue Data Sheets lost", "MetadataOnly", "src", None),
            ("c4", "Audi", "Rescue Data Sheets", "Downloaded", "src", "porsche/all-models/c1.pdf"),
            ("c5", "Porsche", "Macan", "Downloaded", "src", "porsche/all-models/c1.pdf"),
        ],
        columns,
    )
    combined = P.combined_cards(cards)
    assert {r["id"] for r in combined.collect()} == {"c1", "c2"}
    made = P.split_cards(combined, P.split_groups(pages))
    rows = {r["model_name"]: r for r in made.collect()}
    assert set(rows) == {"Macan", "ENUS-01-710-0002"}
    macan = rows["Macan"]
    assert (macan["body_type"], macan["build_year_from"], macan["source_page_url"]) == ("SUV", 2014, "src")
    assert macan["id"].startswith("porsche-macan-2014-suv-en-") and macan["discovered_at_utc"] == macan["downloaded_at_utc"]
    assert macan["local_pdf_relative_path"] == f"porsche/macan/{macan['id']}.pdf"
    assert tuple(P.split_summary(P.split_counts(combined, made)).first()) == (1, 2)
    replaced = P.replace_combined(cards, made)
    assert {r["id"] for r in replaced.collect()} == {"c2", "c3", "c4", "c5"} | {r["id"] for r in rows.values()}


def test_upsert(spark):
    existing = card_rows(spark, [("a", "VW", "old"), ("b", "VW", "kept")], "id string, brand string, model_name string")
    incoming = card_rows(
        spark, [("a", "VW", "first"), ("a", "VW", "second"), ("c", "VW", "new")], "id string, brand string, model_name string"
    ).withColumn("pos", F.when(F.col("model_name") == "second", 2).otherwise(1))
    got = {r["id"]: r["model_name"] for r in C.upsert_cards(existing, incoming, F.col("pos")).collect()}
    assert got == {"a": "second", "b": "kept", "c": "new"}
    assert C.delete_cards(existing, existing.where("id = 'a'")).count() == 1
    assert C.delete_cards(existing, existing.limit(0)).count() == 2


def executed_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, stock, tmp_path):
    path = str(tmp_path / "cards")
    card_rows(spark, [("1", "VW", "Golf")], "id string, brand string, model_name string").write.parquet(path)
    cards = spark.read.parquet(path)
    matched = executed_plan(M.match_fleet(cards, stock, schemas.brand_labels(spark), schemas.bundled_aliases(spark)))
    assert "CartesianProduct" not in matched and "BatchEvalPython" not in matched and "ArrowEvalPython" not in matched
    # Cards themselves are not shuffled: the only exchanges belong to the small lookup.
    siblings = executed_plan(M.attach_siblings(cards, schemas.bundled_siblings(spark)))
    assert "BroadcastHashJoin" in siblings and "SortMergeJoin" not in siblings
    prioritized = cards.withColumn("estimated_fleet_size", F.lit(1)).withColumn("bundle_priority", F.lit("Low"))
    report = executed_plan(R.priority_report(prioritized))
    assert report.count("Exchange hashpartitioning") == 1 and "HashAggregate" in report and "Expand" not in report
    selected = executed_plan(C.select_brands(cards, ["VW"]).select("id"))
    assert "PushedFilters: [In(brand" in selected or "PushedFilters: [IsNotNull(brand), EqualTo(brand" in selected
    assert "ReadSchema: struct<id:string,brand:string>" in selected
