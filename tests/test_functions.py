import hashlib
import html
import unicodedata
from urllib.parse import urljoin

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cutline import fixed_values as fv
from cutline.functions import filenames as N
from cutline.functions import html as H
from cutline.functions import names, status, text, urls


def exact_norm(value):
    kept = (c for c in unicodedata.normalize("NFD", value) if unicodedata.category(c) != "Mn")
    letters = [c for c in kept if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd"]
    letters = [c for c in letters if ord(c) < 0x10000]
    return "".join(c if c == "ı" or len(c.upper()) > 1 else c.upper() for c in letters)


def test_norm_name_known(apply):
    values = ["ID.4", "ID 4", "T-Roc", "Škoda", "Coupé", "Straße", "!!", None, "ﬁ ı ŉ", "é"]
    expected = ["ID4", "ID4", "TROC", "SKODA", "COUPE", "STRAßE", "", None, "ﬁıŉ", "E"]
    assert apply(names.norm_name, values) == expected


_LATIN = st.characters(codec="utf-8", max_codepoint=0x17F, exclude_characters="\x00")


@settings(max_examples=5, deadline=None, phases=[Phase.generate], suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(_LATIN, max_size=30), min_size=20, max_size=60))
def test_norm_name_against_unicodedata(apply, values):
    assert apply(names.norm_name, values) == [exact_norm(v) for v in values]


def test_slug(apply):
    values = ["  T-Roc R! ", "Škoda  Fabia", "", None, "---", "ID.4, ID.5", "İX ΣΑΣ", "a_b__c", "a\U0001d538b"]
    expected = ["t-roc-r", "škoda-fabia", "unknown", "unknown", "unknown", "id-4-id-5", "İx-σασ", "a-b-c", "a-b"]
    assert apply(names.slug, values) == expected


def test_blank(apply):
    values = [None, "", " \t 　", " x "]
    assert apply(names.is_blank, values) == [True, True, True, False]
    assert apply(names.trim_ws, ["  a b 　"]) == ["a b"]


def test_card_id(spark):
    df = spark.createDataFrame(
        [("VW", "ID.4", 2021, "SUV", "DE", "label-1"), ("Skoda", None, None, " ", None, "label-2")],
        "b string, m string, y int, body string, l string, raw string",
    )
    got = [r[0] for r in df.select(names.card_id(*[F.col(c) for c in df.columns])).collect()]

    def short(text):
        return hashlib.sha256(text.encode()).hexdigest()[:8]

    assert got == [f"vw-id-4-2021-suv-de-{short('label-1')}", f"skoda-unknown-{short('label-2')}"]


@pytest.mark.parametrize(
    "value,expected",
    [
        ("Octavia (2013 - 2017)", (2013, 2017)),
        ("x 1998-2004 y", (1998, 2004)),
        ("Fabia (ab 2022)", (2022, None)),
        ("Yeti BIS 2014", (None, 2014)),
        ("Solo 2023", (2023, 2023)),
        ("Model Year 2001 to Model Year 2006", (2001, 2006)),
        ("from Model Year 2009 to 2012", (2009, 2012)),
        ("Roadsterfrom Model Year 2013Page 2", (2013, None)),
        ("BENTAYGA (HYBRID) (2022 - )", (2022, None)),
        ("Kabab 2015", (2015, 2015)),
        ("no digits", (None, None)),
        ("1899", (None, None)),
        ("", (None, None)),
        (None, (None, None)),
    ],
)
def test_year_range(apply, value, expected):
    assert tuple(apply(text.year_range, [value])[0]) == expected


def test_vocabulary(apply):
    by_body = lambda c: text.last_vocab(c, fv.PORSCHE_BODY_TYPES)
    values = [
        "Boxster Spyder Cabriolet 2010", "Carrera COUPÉ", "Panamera sport turismo", "Carrera Convertible-D (Hardtop)",
        "Macan", None,
    ]
    assert apply(by_body, values) == ["Cabriolet", "COUPÉ", "sport turismo", "Convertible-D (Hardtop)", None, None]


def test_doors(apply):
    values = ["Kodiaq SUV 5d hybrid", "Fabia 3-Türer", "Golf 5 - turer", "R4 5door", "12d", "none", None]
    assert apply(text.doors, values) == [5, 3, 5, None, 12, None, None]


def test_fuel_type(apply):
    values = [
        "Citigo-e iV", "Karoq PHEV HYBRID", "Scala IV (seit 2020)", "Kodiaq hybrid iV", "Octavia IV MHEV",
        "Enyaq", None, "diViner GD",
    ]
    assert apply(text.fuel_type, values) == ["iV", "PHEV HYBRID", None, "iV", "MHEV", None, None, "GD"]


def test_headers(apply):
    values = ["Cayenne, Cayenne S SUV", "Boxter Spyder / S (2011)", "(odd) name", "718", " 911 Carrera  "]
    assert apply(text.header_model, values) == ["Cayenne", "Boxster Spyder", "(odd) name", "718", "911 Carrera"]
    pages = [
        "cover porsche ag, nothing", "x Porsche AG, Macan SUV  ", "Porsche AG," + "y" * 300, None,
    ]
    assert apply(text.header_text, pages) == [None, "Macan SUV", "y" * 200, None]


def test_doc_id(apply):
    values = [
        "a ID no. ENUS-01-710-0004 Version no. 2", "id no enGB - 01-710 - 041 Page", "no such thing", "ID no. E-1-2-3", None,
    ]
    assert apply(text.page_doc_id, values) == ["ENUS-01-710-0004", "ENGB-01-710-041", None, None, None]


def test_parse_header(spark):
    df = spark.createDataFrame(
        [("A-1-1-1", "Boxter S, Boxter GTS Cabriolet from Model Year 2012"), ("A-1-1-2", None), ("A-1-1-3", " ")],
        "id string, header string",
    )
    rows = [r[0].asDict() for r in df.select(text.parse_header(F.col("id"), F.col("header"))).collect()]
    assert rows[0]["model_name"] == "Boxster S" and rows[0]["body_type"] == "Cabriolet"
    assert (rows[0]["build_year_from"], rows[0]["build_year_to"]) == (2012, None)
    assert rows[0]["parse_confidence"] == "Heuristic" and rows[0]["language_code"] == "EN"
    for row, doc in zip(rows[1:], ("A-1-1-2", "A-1-1-3")):
        assert row["model_name"] == doc and row["variant"] is None and row["parse_confidence"] == "Unparsed"


def test_parentheses_and_powertrain(apply):
    values = ["Flying Spur (ICE) (2019 - 2023)", "BENTAYGA (hybrid)", "PLAIN"]
    assert apply(text.strip_parens, values) == ["Flying Spur", "BENTAYGA", "PLAIN"]
    assert apply(text.powertrain, values) == ["ICE", "hybrid", None]


def test_name_before_sheet(apply):
    values = ["Toro Nero RESCUE DATA SHEET 3", "HURACAN_EVO__rescue_data_sheet", "RESCUE DATA SHEET", "GUIDE"]
    assert apply(text.has_rescue_sheet_name, values) == [True, True, False, False]
    assert apply(text.name_before_sheet, values)[:2] == ["Toro Nero", "HURACAN EVO"]


def test_brand_and_series(spark):
    df = spark.createDataFrame([("VW GOLF  PLUS ",), ("SONSTIGE",), ("SKODA ",)], "v string")
    got = [tuple(r) for r in df.select(*text.brand_and_series(F.col("v"))).collect()]
    assert got == [("VW", "GOLF  PLUS"), ("SONSTIGE", ""), ("SKODA", "")]


FIELDS = ("model_name", "variant", "body_type", "build_year_from", "build_year_to", "doors", "fuel_type",
          "language_code", "parse_confidence")

NAME_CASES = [
    (N.tokens, "https://h/x/Volkswagen_Arteon_eHYBRID_Coupe_2020_5d_Hybrid-Electric_DE.pdf",
     ("Arteon", "eHYBRID", "Coupe", 2020, None, 5, "Hybrid-Electric", "DE", "High")),
    (N.tokens, "Cupra_Terramar__SUV_2024_5d_Hybrid_de.pdf",
     ("Terramar", None, "SUV", 2024, None, 5, "Hybrid", "DE", "High")),
    (N.tokens, "Seat_Leon_ST_X_Kombi_2012-2016_5D_GD_DEU.pdf",
     ("Leon", "ST X", "Kombi", 2012, 2016, 5, "GD", None, "Heuristic")),
    (N.tokens, "Seat_Leon_Kombi_old_many_GD_DE.pdf",
     ("Leon", None, "Kombi", None, None, None, "GD", "DE", "Unparsed")),
    (N.tokens, "Seat_Ibiza.pdf", ("Ibiza", None, None, None, None, None, None, None, "Unparsed")),
    (N.tokens, "guide.pdf", (None, None, None, None, None, None, None, None, "Unparsed")),
    (N.audi_tokens, "Audi_A7_Limousine_2019_5d_Hybrid_(Electric)_DE.pdf",
     ("A7", None, "Limousine", 2019, None, 5, "Hybrid (Electric)", "DE", "High")),
    (N.audi_tokens, "Audi_Q4_Sportback_SUV_2021-2023_5d_Electric_1_2_DE.pdf",
     ("Q4", "Sportback", "SUV", 2021, 2023, 5, "Electric", "DE", "High")),
    (N.audi_tokens, "Audi_A4__Stationwagon_2016-2024_5d_GD_EN.pdf",
     ("A4", None, "Stationwagon", 2016, 2024, 5, "GD", "EN", "High")),
]


@pytest.mark.parametrize("tokenizer,name,expected", NAME_CASES)
def test_file_names(spark, tokenizer, name, expected):
    df = spark.createDataFrame([(name,)], "name string")
    row = N.with_parsed_name(df, "name", tokenizer).first()["parsed"]
    assert tuple(row[f] for f in FIELDS) == expected


def test_tokens(apply):
    values = ["a/b\\c_ d__e.f.pdf", "_x_", "", "1_2_DE.pdf"]
    assert apply(N.tokens, values) == [["c", "d", "e.f"], ["x"], [], ["1", "2", "DE"]]
    assert apply(N.audi_tokens, ["1_2_DE.pdf", "(a)_b_(c)_(d)"]) == [["DE"], ["(a)", "b (c) (d)"]]


RELATIVE = [
    "/a/b.pdf", "c.pdf", "../up/d.pdf", "./e.pdf", "//other.example/x", "?q=1", "#frag", "", "/a/../../b/./c",
    "sub/../f.pdf?x=1#y", "HTTPS://Up.example/A", "mailto:x@y.example", "..",
]


def test_resolve_url(apply):
    base = "https://Host.example/dir/page.html?old=1"
    got = apply(lambda c: urls.resolve_url(F.lit(base), c), RELATIVE)
    expected = [urljoin("https://host.example/dir/page.html?old=1", h) for h in RELATIVE]
    expected[RELATIVE.index("HTTPS://Up.example/A")] = "HTTPS://Up.example/A"
    expected[RELATIVE.index("")] = "https://host.example/dir/page.html?old=1"
    assert got == expected


def test_resolved_urls_are_readable(apply):
    got = apply(lambda c: urls.resolve_url(F.lit("https://h.example/"), c), ["/One%20two%25_%C3%BC_%FF.pdf", "/a%"])
    assert got == ["https://h.example/One two%25_ü_%FF.pdf", "https://h.example/a%"]


def test_url_file_names(apply):
    values = ["https://h.example/a/B c_ü(1).pdf?x=1#y", "https://h.example/a%20b.pdf", "https://h.example/"]
    assert apply(urls.url_file_name, values) == ["B%20c_%C3%BC(1).pdf", "a%20b.pdf", ""]
    assert apply(urls.url_file_stem, values) == ["B c_ü(1)", "a b", ""]


def test_entities(apply):
    values = [
        "a &amp; b", "&quot;x&apos;", "&#20013;&#x6587;", "&unknown; & &", "FRAN&#199;AIS", "&euro;&#150;&#x1F600;",
        "plain", None, "&amp;amp;",
    ]
    expected = [html.unescape(v) if v else v for v in values]
    assert apply(H.decode_entities, values) == expected


def test_attributes(apply):
    tags = [
        "<a class='x' href=\"/a?b=1&amp;c=2\">", "<A HREF = /plain/x.pdf >", "<a data-href='no' title=\"href='bad'\" href='yes'>",
        "<a>", "<a href=''>", "<a hrefs='x'>",
    ]
    assert apply(lambda c: H.attribute(c, "href"), tags) == ["/a?b=1&c=2", "/plain/x.pdf", "yes", None, "", None]


def test_long_attribute_does_not_overflow(apply):
    long_tag = "<div data-module='m' data-props=\"" + "&quot;abc&quot;,x " * 40_000 + "\">"
    assert len(apply(lambda c: H.attribute(c, "data-props"), [long_tag])[0]) == len('"abc",x ') * 40_000


def test_anchors(apply):
    markup = """<p><!-- <a href="gone.pdf">x</a> --><script>"<a href='js.pdf'>"</script>
      <a href="1.pdf">One <b>bold</b></a><area href="no"><a href=2.pdf>open <a class="c d" href='3.pdf'>T&#233;l</a> tail"""
    got = apply(lambda c: H.anchors(H.visible_markup(c)), [markup])[0]
    assert [a["href"] for a in got] == ["1.pdf", "2.pdf", "3.pdf"]
    texts = apply(lambda c: F.transform(H.anchors(H.visible_markup(c)), lambda a: H.anchor_text(a["inner"])), [markup])
    assert texts[0] == ["One bold", "open", "Tél"]


def test_element_pieces_stop_at_their_end(apply):
    markup = (
        "<div class='list'><div class='item a'><div>in</div>1</div> between "
        "<div class='x item'>2</div></div><div class='item-title'>no</div>after"
    )
    got = apply(lambda c: H.element_pieces(c, "item"), [markup])[0]
    assert [g.startswith("<div") for g in got] == [True, True]
    assert "between" not in got[0].split("</div>")[0] and "after" not in got[1]


def test_fetch_failure(spark):
    rows = [
        (200, "OK", "application/pdf", None, False, None, 200),
        (206, "Partial", None, None, None, None, 200),
        (404, "Not Found", "text/html", None, False, "HTTP 404 Not Found", 404),
        (503, None, None, None, False, "HTTP 503 ", 503),
        (200, "OK", "text/html", None, False,
         "Unexpected Content-Type 'text/html' instead of PDF (possibly an auth-gateway redirect)", None),
        (None, None, None, "no route", False, "no route", None),
        (None, None, None, "took too long", True, "Timeout: took too long", None),
    ]
    df = spark.createDataFrame(
        rows, "http_status int, reason string, content_type string, error string, timed_out boolean, want string, code int"
    )
    failure = status.fetch_failure(*[F.col(c) for c in df.columns[:5]])
    code = status.fetch_status_code(F.col("http_status"), F.col("error"), F.col("timed_out"), failure)
    for row in df.select(failure.alias("f"), code.alias("c"), "want", "code").collect():
        assert row["f"] == row["want"] and row["c"] == row["code"]


def test_tier_and_note(apply):
    assert apply(status.tier, [None, 0, 19_999, 20_000, 99_999, 100_000], "int") == [
        "Unknown", "Low", "Low", "Medium", "Medium", "High",
    ]
    assert apply(status.short_note, ["x" * 40, "x" * 41]) == ["x" * 40, "x" * 39 + "…"]
