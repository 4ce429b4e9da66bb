import json
from concurrent.futures import ThreadPoolExecutor

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from bindings import chain
from bindings.common import spread
from cutline import fixed_values as fv
from cutline import schemas
from cutline.operators import match
from cutline.plans import jobs
from cutline.plans.discover import Landed
from cutline.sources import cards as CS
from cutline.sources import config, landed, reports, stock, versions
from cutline.sources.versions import VersionTaken
from tests.test_discover import AUDI, bentley_item
from tests.test_operators import GRID, sheet

GERMAN_URL = "https://cdn.example/as/Audi_A8_Limousine_2020_4d_Hybrid_(Electric)_DE.pdf"
PORSCHE = """<script type="text/x-template"><link-list :items="[{'link':{'href':'https://c.example/all.pdf','text':'Rescue Data Sheets'}}]"></link-list></script>"""


@pytest.fixture(scope="module")
def inputs(spark):
    pages = schemas.literal_frame(
        spark,
        [
            (fv.PAGE_URLS["Audi"], AUDI),
            (fv.PAGE_URLS["Bentley"], bentley_item("FLYER (ICE) (2019 - 2024)", ("/de.pdf", "DEUTSCHE"))),
            (fv.PAGE_URLS["Porsche"], PORSCHE),
            (fv.STOCK_PAGE_URL, '<a class="c-publication" href="/d/fz12_2026.xlsx">x</a><a class="c-publication" href="/d/fz12_2010.xls">x</a>'),
        ],
        schemas.PAGES,
    )
    log = [
        (GERMAN_URL, 500, "Server Error", None, None, False, "2026-01-01 00:00:00"),
        (GERMAN_URL, 200, "OK", "application/pdf", None, False, "2026-01-02 00:00:00"),
        ("https://c.example/all.pdf", 200, "OK", None, None, False, "2026-01-02 00:00:00"),
    ]
    columns = "url string, http_status int, reason string, content_type string, error string, timed_out boolean, fetched_at string"
    fetch_log = spark.createDataFrame(log, columns).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    return Landed(pages, schemas.empty_frame(spark, schemas.FEEDS)), fetch_log


def by_brand(df):
    return {r["brand"]: r for r in df.collect()}


def test_whole_run(spark, inputs, tmp_path):
    landed_inputs, fetch_log = inputs
    cards_root, stock_root, report_root = (str(tmp_path / d) for d in ("cards", "stock", "reports"))
    brands = ("Audi", "Bentley", "Porsche")

    # nothing to work on yet
    assert jobs.prioritize(spark, cards_root, stock_root, report_root).exit_code == 1
    assert jobs.split(spark, cards_root, schemas.empty_frame(spark, schemas.PDF_PAGES)).exit_code == 1

    # dry run: cards without documents, no manifest
    dry = jobs.discover(spark, landed_inputs, cards_root, None, brands)
    assert dry.exit_code == 0 and [r["metadata_only"] for r in dry.result.collect()] == [1, 1, 1]
    assert by_brand(CS.read_cards(spark, cards_root))["Audi"]["failure_reason"] == fv.TEXT_DRY_RUN
    assert not (tmp_path / "cards" / "manifest").exists()

    run = jobs.discover(spark, landed_inputs, cards_root, fetch_log, brands)
    assert run.exit_code == 0
    assert [tuple(r)[:6] for r in run.result.collect()] == [
        ("Audi", "Completed", 1, 1, 0, 0), ("Porsche", "Completed", 1, 1, 0, 0), ("Bentley", "Completed", 1, 0, 1, 0),
    ]
    cards = by_brand(CS.read_cards(spark, cards_root))
    audi = cards["Audi"]
    assert audi["id"].startswith("audi-a8-2020-limousine-de-") and audi["local_pdf_relative_path"] == f"audi/a8/{audi['id']}.pdf"
    assert audi["downloaded_at_utc"] == audi["discovered_at_utc"] and audi["sibling_model_ids"] == []
    assert cards["Bentley"]["status"] == "MetadataOnly" and cards["Bentley"]["downloaded_at_utc"] is None
    manifest = list((tmp_path / "cards" / "manifest" / "brand=audi").glob("*.json"))
    assert json.loads(manifest[0].read_text())["parseConfidence"] == "high"

    # a brand without entries fails the run but keeps all stored cards
    failed = jobs.discover(spark, landed_inputs, cards_root, fetch_log, ("VW",))
    assert failed.exit_code == 1 and CS.read_cards(spark, cards_root).count() == 3

    # stock
    cells = sheet(spark, [[a, "PORSCHE MACAN" if b == "SKODA KAROQ" else b, c] for a, b, c in GRID])
    assert jobs.load_stock(spark, cells, landed_inputs.pages, stock_root, 2026).exit_code == 0
    assert jobs.load_stock(spark, cells, landed_inputs.pages, stock_root, 2010).exit_code == 1
    missing = jobs.load_stock(spark, cells, landed_inputs.pages, stock_root, 1999)
    assert (missing.exit_code, missing.message) == (2, "No download link for FZ12 1999 found on the KBA product page.")
    meta = stock.read_stock_meta(spark, stock_root).first()
    assert (meta["year"], meta["row_count"], meta["warning_count"], str(meta["reference_date"])) == (2026, 3, 1, "2026-01-01")
    assert meta["source_url"] == "https://www.kba.de/d/fz12_2026.xlsx" and meta["license"] == fv.STOCK_LICENSE
    assert stock.read_stock(spark, stock_root, 2025) is None

    # split the combined card
    combined = cards["Porsche"]["local_pdf_relative_path"]
    pdf_pages = schemas.literal_frame(
        spark,
        [
            (combined, 1, "Porsche AG, Macan / S SUV from Model Year 2014 ID no. ENUS-01-710-0001 Page 1"),
            (combined, 2, "ID no. ENUS-01-710-0002 Page 1"), (combined, 3, "notice"),
        ],
        schemas.PDF_PAGES,
    )
    split = jobs.split(spark, cards_root, pdf_pages)
    assert (split.exit_code, tuple(split.result.first())) == (0, (1, 2))
    assert jobs.split(spark, cards_root, pdf_pages).exit_code == 1  # nothing left to split
    assert CS.read_cards(spark, cards_root).where("brand = 'Porsche'").count() == 2

    # prioritize
    done = jobs.prioritize(spark, cards_root, stock_root, report_root)
    assert [tuple(r) for r in done.result.collect()] == [("Unknown", 3), ("Low", 1), ("Medium", 0), ("High", 0)]
    csv = b"".join(p.read_bytes() for p in sorted((tmp_path / "reports" / "priority-report.csv").glob("part-*")))
    lines = csv.decode("utf-8").splitlines()
    assert lines[0] == "﻿" + fv.REPORT_CSV_HEADER and lines[1] == "Porsche,Macan,1,0,500,Low" and len(lines) == 5
    report = "".join(p.read_text() for p in sorted((tmp_path / "reports" / "priority-report.json").glob("part-*")))
    assert json.loads(report.splitlines()[0]) == {
        "brand": "porsche", "modelName": "Macan", "cardCount": 1, "notDownloadedCount": 0, "estimatedFleetSize": 500, "bundlePriority": "low",
    }

    # quality: Audi and Bentley are entirely unknown while Porsche matched
    checked = jobs.quality(spark, cards_root)
    assert checked.exit_code == 1 and checked.message == "2 issue(s), 4 cards checked"
    assert {r["card_id"] for r in checked.result.collect()} == {"Audi", "Bentley"}

    # re-discovery resets enrichment
    jobs.discover(spark, landed_inputs, cards_root, fetch_log, ("Bentley",))
    assert by_brand(CS.read_cards(spark, cards_root))["Bentley"]["bundle_priority"] == "Unknown"


def test_clean_cards_pass_the_gate(spark, tmp_path):
    assert jobs.quality(spark, str(tmp_path / "none")).exit_code == 0


def test_failed_write_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "store")
    card = schemas.empty_frame(spark, schemas.CARDS)
    one = spark.range(1).select(
        *[(F.lit("x") if f.name in ("id", "brand") else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.CARDS.fields]
    )
    CS.write_cards(one, root)
    broken = one.withColumn("model_name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception):
        CS.write_cards(broken, root)
    assert [r["id"] for r in CS.read_cards(spark, root).collect()] == ["x"]
    CS.write_cards(card, root)
    assert CS.read_cards(spark, root).count() == 0


def test_sidecars(spark, tmp_path):
    good = {"id": "a-1", "brand": "vw", "modelName": "Gölf", "status": "metadataOnly", "siblingModelIds": ["g"], "doors": 5,
            "discoveredAtUtc": "2026-02-03T04:05:06.1234567+00:00", "bundlePriority": "unknown", "parseConfidence": "high"}
    folder = tmp_path / "vw" / "golf"
    folder.mkdir(parents=True)
    (folder / "a-1.json").write_text(json.dumps(good, indent=2, ensure_ascii=False))
    (folder / "a-2.json").write_text(json.dumps(good)[:40])
    (folder / "a-3.json").write_text(json.dumps(good | {"id": "a-3", "status": "exploded"}))
    (tmp_path / "vw" / "_manifest.json").write_text(json.dumps([good]))
    cards, corrupt = CS.read_card_sidecars(spark, str(tmp_path))
    (row,) = cards.collect()
    assert (row["brand"], row["model_name"], row["status"], row["sibling_model_ids"], row["doors"]) == ("VW", "Gölf", "MetadataOnly", ["g"], 5)
    assert str(row["discovered_at_utc"]).startswith("2026-02-03 04:05:06.123456")
    assert sorted(r["file"].rsplit("/", 1)[1] for r in corrupt.collect()) == ["a-2.json", "a-3.json"]
    empty, none = CS.read_card_sidecars(spark, str(tmp_path / "missing"))
    assert empty.isEmpty() and none.isEmpty()


def test_configuration_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"Aliases": [{"Brand": "vw", "modelName": "X", "KbaModelSeries": "Y"}, {"brand": "Audi", "modelName": "Z", "kbaModelSeries": "W"}]}')
    assert [tuple(r) for r in config.read_aliases(spark, str(tmp_path / "a.json")).collect()] == [(0, "VW", "X", "Y"), (1, "Audi", "Z", "W")]
    (tmp_path / "s.json").write_text(
        '{"groups": [{"groupId": "g", "platformName": "P", "members": [{"brand": "VW", "modelName": "A", "notes": "n"}, {"brand": "Seat", "modelName": "B"}]}]}'
    )
    assert [tuple(r) for r in config.read_siblings(spark, str(tmp_path / "s.json")).collect()] == [(0, "g", "P", "VW", "A"), (0, "g", "P", "Seat", "B")]
    assert config.read_aliases(spark, str(tmp_path / "no.json")).isEmpty()
    assert config.read_siblings(spark, str(tmp_path / "no.json")).isEmpty()
    assert config.read_aliases(spark).count() == 24 and config.read_siblings(spark).select("group_id").distinct().count() == 8
    (tmp_path / "bad.json").write_text("{oops")
    with pytest.raises(ValueError):
        config.read_aliases(spark, str(tmp_path / "bad.json"))


def test_csv_fields(spark):
    rows = [("VW", 'a,"b"', 1, 0, None, "Unknown"), ("VW", None, 2, 1, 7, "Low"), ("VW", "line\nbreak", 1, 0, 7, "Low")]
    report = schemas.literal_frame(spark, rows, schemas.REPORT)
    lines = [r["value"] for r in reports.report_csv_lines(report).collect()]
    assert lines[1:] == ["VW,,2,1,7,Low", 'VW,"line\nbreak",1,0,7,Low', 'VW,"a,""b""",1,0,,Unknown']


def test_landed_readers(spark, tmp_path):
    pages = schemas.literal_frame(spark, [("u", "<p>")], schemas.PAGES)
    pages.write.parquet(str(tmp_path / "pages"))
    assert landed.read_pages(spark, str(tmp_path / "pages")).collect() == pages.collect()
    (tmp_path / "cells.csv").write_text("book,year,sheet,sheet_pos,row_no,col_no,cell_type,value\nb,2026,FZ 12.1,1,1,1,text,x\n")
    assert landed.read_sheet_cells(spark, str(tmp_path / "cells.csv"), "csv", header="true").first()["year"] == 2026


def test_books_of_one_year_stay_apart(spark, tmp_path):
    from cutline.sources import stock as SS

    rows = [(2025, 6, "Kleinwagen", "OPEL", "CORSA", n, book) for n, book in ((30, "b"), (20, "a"))]
    none, root = schemas.empty_frame(spark, schemas.STOCK_WARNINGS), str(tmp_path / "stock")
    SS.write_stock(spark.createDataFrame(rows, schemas.STOCK_OF_BOOKS), none, root, 2025, "u")
    stored = SS.read_stock(spark, root)[1]
    assert {tuple(r) for r in stored.collect()} == set(rows)
    assert {r["count"] for r in match.stock_index(stored, schemas.brand_labels(spark)).collect()} <= {20}


def test_a_failed_reload_leaves_the_year_as_it_was(spark, tmp_path):
    from cutline.sources import stock as SS

    rows = spark.createDataFrame([(2025, 6, "Kleinwagen", "OPEL", "CORSA", 10)], schemas.STOCK)
    none = schemas.empty_frame(spark, schemas.STOCK_WARNINGS)
    root = str(tmp_path / "stock")
    SS.write_stock(rows, none, root, 2025, "u")
    broken = rows.withColumn("segment", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        SS.write_stock(broken, none, root, 2025, "v")
    year, kept = SS.read_stock(spark, root)
    assert year == 2025 and [tuple(r) for r in kept.select(*rows.columns).collect()] == [tuple(r) for r in rows.collect()]
    SS.write_stock(rows.union(rows.withColumn("row_no", F.lit(7))), none, root, 2025, "w")
    assert SS.read_stock(spark, root, 2025)[1].count() == 2
    assert [(r["source_url"], r["row_count"]) for r in SS.read_stock_meta(spark, root).collect()] == [("w", 2)]


def _cards(spark, *ids):
    known = {"brand": F.lit("VW"), "id": F.col("id")}
    rows = spark.createDataFrame([(i,) for i in ids], "id string")
    return rows.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.CARDS.fields])


def _ids(spark, root):
    return sorted(r["id"] for r in CS.read_cards(spark, root).collect())


def test_of_two_writers_of_one_version_the_second_fails(spark, tmp_path):
    root = str(tmp_path / "cards")
    assert CS.current_version(spark, root) == 0
    CS.write_cards(_cards(spark, "a"), root)
    first, second = CS.current_version(spark, root), CS.current_version(spark, root)
    CS.write_cards(_cards(spark, "a", "b"), root, first)
    with pytest.raises(VersionTaken, match="already exists"):
        CS.write_cards(_cards(spark, "a", "c"), root, second)
    assert _ids(spark, root) == ["a", "b"] and CS.current_version(spark, root) == 2
    # a log entry is complete or absent, and nothing else is left in its folder
    assert sorted(p.name for p in (tmp_path / "cards" / "versions").iterdir() if not p.name.startswith(".")) == ["1.json", "2.json"]


def test_writers_at_the_same_time_leave_one_version(spark, tmp_path):
    root = str(tmp_path / "cards")

    def write(name):
        try:
            CS.write_cards(_cards(spark, name), root, 0)
            return name
        except VersionTaken:
            return None

    with ThreadPoolExecutor(4) as pool:
        done = [name for name in pool.map(write, "abcd") if name]
    assert len(done) == 1 and _ids(spark, root) == done


def test_entries_take_their_name_by_renaming_too(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "_link", versions._rename)
    entry = spark.createDataFrame([(1, "p")], "version bigint, path string")
    versions.publish(entry, str(tmp_path), "1")
    with pytest.raises(VersionTaken):
        versions.publish(entry.withColumn("path", F.lit("q")), str(tmp_path), "1")
    assert [tuple(r) for r in versions.published(spark, str(tmp_path), entry.schema).collect()] == [(1, "p")]


def test_of_two_loads_of_a_year_the_second_fails(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(2025, 6, "Kleinwagen", "OPEL", "CORSA", 10)], schemas.STOCK)
    none, root = schemas.empty_frame(spark, schemas.STOCK_WARNINGS), str(tmp_path / "stock")
    before = stock._log(spark, root)
    stock.write_stock(rows, none, root, 2025, "u")
    with monkeypatch.context() as patch:
        patch.setattr(stock, "_log", lambda *_: before)  # the second load looked before the first was done
        with pytest.raises(VersionTaken):
            stock.write_stock(rows, none, root, 2025, "v")
        stock.write_stock(rows.withColumn("year", F.lit(2024)), none, root, 2024, "w")
    assert sorted((r["year"], r["source_url"]) for r in stock.read_stock_meta(spark, root).collect()) == [(2024, "w"), (2025, "u")]


def test_a_job_that_was_overtaken_changes_nothing(spark, inputs, tmp_path, monkeypatch):
    root = str(tmp_path / "cards")
    CS.write_cards(_cards(spark, "a"), root)
    monkeypatch.setattr(jobs, "current_version", lambda *_: 0)
    with pytest.raises(VersionTaken):
        jobs.discover(spark, inputs[0], root, None, ("Audi",))
    assert _ids(spark, root) == ["a"]


def test_imported_card_files(spark, tmp_path):
    root, tree = str(tmp_path / "cards"), tmp_path / "tree"
    CS.write_cards(_cards(spark, "old", "kept"), root)
    tree.mkdir()
    bodies = {
        "1": {"id": "old", "brand": "vw", "modelName": "first"}, "2": {"id": "old", "brand": "vw", "modelName": "second"},
        "3": {"id": "new", "brand": "SEAT"}, "4": {"brand": "vw"}, "5": {"id": "x", "brand": "vw", "status": "exploded"},
    }
    for name, body in bodies.items():
        (tree / f"{name}.json").write_text(json.dumps(body))
    (tree / "_manifest.json").write_text("[")
    job = jobs.import_cards(spark, str(tree), root)
    assert (job.exit_code, tuple(job.result.first())) == (1, (3, 2))
    assert sorted(r["file"].rsplit("/", 1)[1] for r in job.details.collect()) == ["4.json", "5.json"]
    assert {(r["id"], r["brand"], r["model_name"]) for r in CS.read_cards(spark, root).collect()} == {
        ("kept", "VW", None), ("old", "VW", "second"), ("new", "Seat", None),
    }
    empty = jobs.import_cards(spark, str(tmp_path / "none"), root)
    assert (empty.exit_code, tuple(empty.result.first())) == (0, (0, 0)) and CS.read_cards(spark, root).count() == 3


def test_manifests_of_other_brands_stay(spark, tmp_path):
    from cutline.sources import cards as CS

    columns = {f.name: F.lit(None).cast(f.dataType) for f in schemas.CARDS.fields}
    cards = spark.createDataFrame([("a", "VW"), ("b", "Seat")], "id string, brand string")
    cards = cards.select(*[F.col(n) if n in cards.columns else c.alias(n) for n, c in columns.items()])
    CS.write_manifests(cards, str(tmp_path))
    CS.write_manifests(cards.withColumn("id", F.lit("c")), str(tmp_path), ["VW"])
    found = spark.read.schema("id string, brand string").json(f"{tmp_path}/manifest")
    assert sorted(r["id"] for r in found.collect()) == ["b", "c"]


def test_missing_model_pages(spark):
    from cutline import fixed_values as fv
    from cutline.plans.discover import Landed, missing_model_pages

    overview = f'<a class="{fv.SEAT_MODEL_CLASS}" href="{fv.SEAT_MODEL_HREF}x">x</a>'
    pages = spark.createDataFrame([(fv.PAGE_URLS["Seat"], overview)], schemas.PAGES)
    found = missing_model_pages(Landed(pages, None)).collect()
    assert len(found) == 1 and found[0]["brand"] == "Seat"


def test_sidecar_files_are_written_by_several_tasks(spark, tmp_path):
    from bindings import tables

    suppliers = spark.range(1_200).selectExpr("id AS s_suppkey", "concat('n', id) AS s_name")
    twice = suppliers.where("s_suppkey = 2")  # two rows of a key share a file, which then is their first card
    suppliers.unionByName(twice).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {*shared.glob("sidecars-*")}
    got = tables.sidecars(spark, str(tmp_path)).collect()
    (made,) = {*shared.glob("sidecars-*")} - before
    files = list(made.glob("raw/folder=*/part-*.txt"))
    assert len(files) == 1_200 and len({f.name.split("-")[1] for f in files}) == 3
    assert sorted(r["id"] for r in got) == sorted(f"s{i}" for i in range(1_200))
    assert sum(r["corrupt"] for r in got) == sum(i % 10 == 0 or i % 7 == 1 for i in range(1_200))
