import json
from html import escape

import pytest

from cutline import fixed_values as fv
from cutline import schemas
from cutline.functions import html as H
from cutline.operators import links as L
from cutline.plans import discover as D


def pages_of(spark, *pages):
    return schemas.literal_frame(spark, pages, schemas.PAGES)


def entries(df):
    return sorted(df.select("*", "parsed.*").collect(), key=lambda r: tuple(r["entry_pos"]))


AUDI = """<html><body><a href="https://cdn.example/as/Audi_A8_Limousine_2020_4d_Hybrid_(Electric)_DE.pdf">x</a>
<a href="https://cdn.example/as/Audi_A8__Sedan_2020_4d_GD_EN.pdf">x</a><a href="Audi_A1_X_2020_4d_GD_DE.pdf?v=1">x</a>
<a href="   ">x</a><a href="/as/Audi_Q2__SUV_2016-2020_5d_GD_1_DE.PDF">upper</a></body></html>"""


def test_audi(spark):
    got = entries(D.discover_audi(pages_of(spark, (fv.PAGE_URLS["Audi"], AUDI))))
    assert len(got) == 1
    row = got[0]
    assert (row["model_name"], row["body_type"], row["build_year_from"], row["fuel_type"]) == ("A8", "Limousine", 2020, "Hybrid (Electric)")
    assert row["raw_label"] == "Audi_A8_Limousine_2020_4d_Hybrid_(Electric)_DE.pdf" and row["language_code"] == "DE"


def test_cupra(spark):
    html = """<a href="/dam/Cupra_Leon__SUV_2022_5d_Hybrid-Electric_DE.pdf">Laden</a><a href='/dam/Cupra_Leon__SUV_2022_5d_Hybrid-Electric_FR.pdf'>T&#233;l</a>"""
    (row,) = entries(D.discover_cupra(pages_of(spark, (fv.PAGE_URLS["Cupra"], html))))
    assert row["download_url"] == "https://www.cupraofficial.ch/dam/Cupra_Leon__SUV_2022_5d_Hybrid-Electric_DE.pdf"
    assert (row["model_name"], row["fuel_type"], row["parse_confidence"]) == ("Leon", "Hybrid-Electric", "High")


def test_lamborghini(spark):
    html = """<nav><a href=/models>all</a></nav><a href="notes/Owner_Handbook.pdf">no sheet</a>
    <A title="a > b" HREF='sheets/Toro%20Nero%20RESCUE%20DATA%20SHEET.pdf'>one</A><a href=/x/Vento_RESCUE_DATA_SHEET_7.pdf>two"""
    got = entries(D.discover_lamborghini(pages_of(spark, (fv.PAGE_URLS["Lamborghini"], html))))
    assert [(r["model_name"], r["language_code"], r["parse_confidence"]) for r in got] == [("Toro Nero", "EN", "High"), ("Vento", "EN", "High")]
    assert got[1]["download_url"] == "https://www.lamborghini.com/x/Vento_RESCUE_DATA_SHEET_7.pdf"


def feed(**overrides):
    document = {
        "config": {"base_url": "https://assets.example/pdf//"},
        "languages": [
            {"name": "lang.EN", "files": ["Volkswagen_Up__Limousine_2012_3d_GD_EN.pdf"]},
            {"name": "lang.de", "files": ["Volkswagen_Up__Limousine_2012_3d_GD_DE.pdf", "odd.pdf"]},
            {"name": "other.DE", "files": ["never.pdf"]},
        ],
    }
    return json.dumps(document | overrides)


def test_vw(spark):
    feeds = schemas.literal_frame(spark, [("u", feed())], schemas.FEEDS)
    got = entries(D.discover_vw(feeds))
    assert [r["download_url"] for r in got] == [
        "https://assets.example/pdf/lang.de/Volkswagen_Up__Limousine_2012_3d_GD_DE.pdf", "https://assets.example/pdf/lang.de/odd.pdf",
    ]
    assert [r["parse_confidence"] for r in got] == ["High", "Unparsed"]


@pytest.mark.parametrize(
    "text",
    [
        feed(config={}), feed(config={"base_url": ""}), feed(languages=[]), feed(languages=[{"name": "x.DE"}]),
        feed(languages=[{"name": None, "files": ["a"]}]), "{broken", feed(languages=None),
    ],
)
def test_incomplete_vw_feed_gives_nothing(spark, text):
    assert D.discover_vw(schemas.literal_frame(spark, [("u", text)], schemas.FEEDS)).isEmpty()


def test_porsche(spark):
    items = "[{'link':{'href':'https://c.example/a.pdf','text':' Rescue Data Sheets '}},{'Link':{'Href':'https://c.example/b.pdf','Text':'RESCUE DATA SHEETS classic'}},{'link':{'href':'','text':'Rescue Data Sheets'}},{'link':{'href':'/x','text':'Manual'}},{}]"
    html = f"""<link-list :items="[{{'link':{{'href':'/outside.pdf','text':'Rescue Data Sheets'}}}}]"></link-list>
    <script>var a;</script><script type="text/x-template" id="app"><div><link-list :items="[oops"></link-list><link-list title="a" :items="{items}"></link-list></div></script>
    <script type="text/x-template"><link-list :items="[{{'link':{{'href':'/second.pdf','text':'Rescue Data Sheets'}}}}]"></link-list></script>"""
    got = entries(D.discover_porsche(pages_of(spark, (fv.PAGE_URLS["Porsche"], html))))
    assert [(r["model_name"], r["variant"], r["download_url"]) for r in got] == [
        ("All Models", "Rescue Data Sheets", "https://c.example/a.pdf"),
        ("All Models Classic", "RESCUE DATA SHEETS classic", "https://c.example/b.pdf"),
    ]
    assert D.discover_porsche(pages_of(spark, ("u", "<html>no template</html>"))).isEmpty()


def bentley_item(title, *links):
    body = "".join(f'<a class="bm-e-button" href="{h}"><span class="bm-e-button__label">\n {l}\n</span></a>' for h, l in links)
    return f'<div class="bm-m-accordion__item" data-x><h3><button class="bm-m-accordion__item-title" aria-x="f">\n {title} </button></h3><div class="bm-m-accordion__item-content">{body}</div></div>'


def test_bentley(spark):
    html = (
        '<div class="accordion">'
        + bentley_item("NEW FLYER (ICE) (2019 - 2024)", ("/en.pdf", "ENGLISH"), ("https://c.example/de.pdf", "DEUTSCHE"), ("/de2.pdf", "DEUTSCHE"))
        + bentley_item("TAIGA (hybrid) (2020 - )", ("/g.pdf", "Deutsche"))
        + bentley_item("SHARED (2021 - )", ("/z.pdf", "&#20013;&#25991;"), ("/z.pdf", "DEUTSCHE"))
        + bentley_item("FRENCH (2017 - 2020)", ("/fr.pdf", "FRAN&#199;AIS"))
        + bentley_item("Technical data", ("/t.pdf", "DEUTSCHE"))
        + '</div><a class="bm-e-button" href="/outside.pdf"><span class="bm-e-button__label">DEUTSCHE</span></a>'
    )
    got = entries(D.discover_bentley(pages_of(spark, (fv.PAGE_URLS["Bentley"], html))))
    assert [(r["model_name"], r["download_url"], r["build_year_from"], r["build_year_to"], r["fuel_type"]) for r in got] == [
        ("NEW FLYER", "https://c.example/de.pdf", 2019, 2024, "ICE"),
        ("TAIGA", "https://www.bentleymotors.com/g.pdf", 2020, None, "hybrid"),
    ]
    assert got[0]["raw_label"] == "NEW FLYER (ICE) (2019 - 2024)"


def test_links_after_the_last_item_do_not_count(spark):
    html = bentley_item("ONE (2019 - )", ("/en.pdf", "ENGLISH")) + '<a href="/late.pdf"><span class="bm-e-button__label">DEUTSCHE</span></a>'
    assert D.discover_bentley(pages_of(spark, ("u", html))).isEmpty()


SEAT = fv.PAGE_URLS["Seat"]


def test_seat(spark):
    overview = f"""<a href="/files/2024/emergency-response-guide-de.pdf">g</a><a href="/rc/x/emergency-response-guide-de.pdf">g</a>
    <a class="link-arrow" href="/kontakt/rettungsblaetter/ateca">A</a><a class="b link-arrow" href="https://www.seat.de/kontakt/rettungsblaetter/ateca">A again</a>
    <a class="link-arrow" href="/kontakt/rettungsblaetter/lost">L</a><a class="link" href="/rettungsblaetter/no">n</a>"""
    model = '<a href="/rc/Seat_Arona__SUV_2019_4d_GD_DE.pdf">d</a><a href="/rc/Seat_Arona__SUV_2019_4d_GD_FR.pdf">f</a>'
    pages = pages_of(spark, (SEAT, overview), ("https://www.seat.de/kontakt/rettungsblaetter/ateca", model), ("https://www.seat.de/rettungsblaetter/no", model))
    landed = D.Landed(pages, None)
    got = entries(D.discover_seat(landed.page("Seat"), pages))
    assert [(r["model_name"], r["raw_label"], r["source_page_url"]) for r in got] == [
        ("General Guide", "seat-emergency-response-guide-de.pdf", SEAT),
        ("Arona", "Seat_Arona__SUV_2019_4d_GD_DE.pdf", "https://www.seat.de/kontakt/rettungsblaetter/ateca"),
    ]
    lost = L.missing_pages(D.seat_model_pages(landed.page("Seat")), pages).collect()
    assert [r["page_url"] for r in lost] == ["https://www.seat.de/kontakt/rettungsblaetter/lost"]


SKODA = fv.PAGE_URLS["Skoda"]


def props(module, document):
    return f"<div data-module='{module}' data-props=\"{escape(json.dumps(document, ensure_ascii=False))}\"></div>"


def test_skoda(spark):
    body = "<p><a href='/service/rettungsdatenblatt-fabia'>Fabia</a> <a href='/service/rettungsdatenblatt-fabia'>Fabia Combi</a><a href='/else'>x</a><a href='/rettungsdatenblatt-empty'> </a></p>"
    overview = "<div data-module='OneColumnText' data-props='{broken'></div>" + props("OneColumnText", {"viewModel": {"body": body}})
    model = props(
        "download-file",
        {"ViewModel": {"Files": [
            {"title": "Rapid III (ab 2020) Combi 4d", "link": "/media/a.pdf"}, {"title": None, "link": "b.pdf"}, {"title": "x", "link": " "},
        ]}},
    )
    pages = pages_of(spark, (SKODA, overview), ("https://www.skoda-auto.de/service/rettungsdatenblatt-fabia", model), ("https://z.example", model))
    got = entries(D.discover_skoda(pages.where(f"url = '{SKODA}'"), pages))
    assert [(r["model_name"], r["raw_label"], r["download_url"], r["parse_confidence"]) for r in got] == [
        ("Fabia", "Rapid III (ab 2020) Combi 4d", "https://www.skoda-auto.de/media/a.pdf", "Heuristic"),
        ("Fabia", "Fabia", "https://www.skoda-auto.de/service/b.pdf", "Unparsed"),
        ("Fabia Combi", "Rapid III (ab 2020) Combi 4d", "https://www.skoda-auto.de/media/a.pdf", "Heuristic"),
        ("Fabia Combi", "Fabia Combi", "https://www.skoda-auto.de/service/b.pdf", "Unparsed"),
    ]
    first = got[0]
    assert (first["body_type"], first["doors"], first["build_year_from"], first["build_year_to"], first["fuel_type"]) == ("Combi", 4, 2020, None, None)


def test_publication(spark):
    html = """<a class="c-publication" href="/d/fz12_2025.xlsx?x=1">25</a><a href="/d/fz12_2026.xlsx">no class</a>
    <a class="c-publication" href="/d/FZ12_2026.xlsx?a=1&amp;v=7">26</a><a class="c-publication" href="/d/fz12_2026.xlsx">later</a>
    <a class="c-publication" href="https://o.example/fz12_2019.pdf">old</a>"""
    pages = pages_of(spark, (fv.STOCK_PAGE_URL, html))
    pick = lambda year: [tuple(r)[1:] for r in L.pick_publication(pages, year).collect()]
    assert pick(2026) == [("https://www.kba.de/d/FZ12_2026.xlsx?a=1&v=7", True)]
    assert pick(2019) == [("https://o.example/fz12_2019.pdf", False)]
    assert pick(2001) == []


def test_registry_isolates_failures(spark):
    good = pages_of(spark, (fv.PAGE_URLS["Audi"], AUDI))
    landed = D.Landed(good, schemas.empty_frame(spark, schemas.FEEDS))

    def fails(_):
        raise ValueError("layout changed")

    def refuses(_):
        raise NotImplementedError("old format")

    registry = {"Audi": D.EXTRACTORS["Audi"], "Seat": fails, "Cupra": refuses, "VW": D.EXTRACTORS["VW"]}
    found, runs = D.run_discovery(spark, landed, ("Audi", "Seat", "Cupra", "VW", "Porsche"), registry)
    assert [r["brand"] for r in found.collect()] == ["Audi"]
    assert [tuple(r) for r in runs.collect()] == [
        ("Audi", "Completed", None), ("Seat", "DiscoveryFailed", "layout changed"), ("Cupra", "NotImplemented", "old format"),
        ("VW", "Completed", None), ("Porsche", "NotImplemented", fv.TEXT_NO_SOURCE),
    ]


def test_extraction_plans(spark, tmp_path):
    pages_of(spark, (fv.PAGE_URLS["Audi"], AUDI)).write.parquet(str(tmp_path / "pages"))
    pages = spark.read.schema(schemas.PAGES).parquet(str(tmp_path / "pages"))
    landed = D.Landed(pages, None)
    for brand, extract in (("Audi", D.discover_audi), ("Bentley", D.discover_bentley), ("Porsche", D.discover_porsche)):
        plan = extract(landed.page(brand))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan
        assert f"EqualTo(url,{fv.PAGE_URLS[brand][:35]}" in plan  # long values are cut in plan texts
        assert plan.count("<!--") <= 3  # markup is cleaned once, with two patterns; Porsche's script once more


def test_larger_sides_are_not_broadcast(spark):
    from cutline.session import broadcast_if_small

    side = spark.range(50).selectExpr("cast(id as string) AS page_url")
    other = spark.range(50).selectExpr("cast(id as string) AS page_url")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for kept, hinted in ((broadcast_if_small(side), True), (broadcast_if_small(side, max_rows=10), False), (broadcast_if_small(side, max_bytes=100), False)):
            joined = other.join(kept, "page_url")
            assert ("BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()) is hinted
            assert joined.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("brand", ["Seat", "Skoda"])
def test_second_hop_shuffles_no_markup_and_runs_nothing_while_it_is_built(spark, tmp_path, brand):
    rows = [(f"https://x.example/{i}", "<a href='/m'>m</a>") for i in range(20)]
    spark.createDataFrame(rows, "url string, html string").write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    overview = pages.where("url = 'https://x.example/1'")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    tracker = spark.sparkContext.statusTracker()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    group = f"building-{brand}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        entries = getattr(D, f"discover_{brand.lower()}")(overview, pages)
        assert not tracker.getJobIdsForGroup(group)
        plan = entries._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    lines = plan.splitlines()
    below = [lines[i + 1] for i, line in enumerate(lines[:-1]) if "Exchange" in line]
    assert below and not any("html" in line for line in below)


def test_linked_only_keeps_every_linked_page(spark):
    pages = spark.range(3_000).selectExpr("concat('u', id) AS url", "'x' AS html")
    links = spark.range(0, 3_000, 3).selectExpr("concat('u', id) AS page_url")
    kept = {r["url"] for r in L.linked_only(pages, links).collect()}
    assert {f"u{i}" for i in range(0, 3_000, 3)} <= kept and len(kept) < 1_020
    assert L.linked_only(pages, links.where("page_url = 'no'")).isEmpty()
    assert len({r["url"] for r in L.linked_only(pages, links, bits=64).collect()}) >= 1_000


def test_pages_of_one_small_file_are_made_in_several_tasks(spark, tmp_path):
    from bindings import common, web

    parts = spark.range(9_000).selectExpr("id AS p_partkey", "concat('red gear ', id) AS p_name", "'BOX' AS p_type", "CAST(id % 50 AS INT) AS p_size")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    pages = web._pages(spark, str(tmp_path), web._FLAT_PAGE)
    sizes = pages.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == 3 and sum(sizes) == 9_000 and max(sizes) <= 1.5 * common.SPREAD_ROWS
    assert sorted(r["url"] for r in pages.collect()) == sorted(f"https://site.example/p/{i}/list.html" for i in range(9_000))
    assert common.spread(spark.range(0)).count() == 0


@pytest.mark.parametrize("brand", ["Seat", "Skoda"])
def test_second_hop_never_broadcasts_what_it_extracts(spark, brand):
    pages = pages_of(spark, *[(f"https://x.example/{i}", "<a href='/m'>m</a>") for i in range(20)])
    entries = getattr(D, f"discover_{brand.lower()}")(pages.where("url = 'https://x.example/1'"), pages)
    plan = entries._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [page_url" in plan and "BroadcastHashJoin [page_url" not in plan


def test_pieces_end_before_the_next_start(apply):
    markup = "x<a href=1>1<b>2</b><A\nhref=2>é<ab><a/>\n<a"
    assert apply(lambda c: H.pieces_from(c, H.ANCHOR), [markup, "", None, "<p>"]) == [["<a href=1>1<b>2</b>", "<A\nhref=2>é<ab>", "<a/>\n<a"], [], None, []]
