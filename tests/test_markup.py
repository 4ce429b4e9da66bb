"""Markup and text that a pattern over raw text gets wrong."""

import time

import pytest

from cutline import schemas
from cutline.functions import html as H
from cutline.functions.urls import resolve_url
from cutline.operators import links as L
from cutline.operators import ordered as O
from cutline.operators import report as R
from pyspark.sql import functions as F


def hrefs(spark, page):
    pages = spark.createDataFrame([(page,)], "html string")
    return [r["href"] for r in L.extract_links(pages, suffix=None).orderBy("pos").collect()]


@pytest.mark.parametrize(
    "page",
    [
        """<div data-x="<a href='/ghost.pdf'>g</a>"></div>""", "<textarea><a href='/ghost.pdf'>g</a></textarea>", "<title><a href=/ghost.pdf></title>",
        "<template><a href='/ghost.pdf'>g</a></template>", "<!-- open <a href='/ghost.pdf'>", "<script>var a = '<a href=/ghost.pdf>'",
        "<STYLE>/* <a href=/ghost.pdf> */</STYLE >",
    ],
)
def test_no_invented_links(spark, page):
    assert hrefs(spark, f"<a href='/a.pdf'>a</a>{page}") == ["/a.pdf"]


def test_links_after_odd_markup(spark):
    assert hrefs(spark, """<i title="a > b"><a title='<' href="x?a=1&lt=2">t</a></i><!-- - -- --><a href=y>""") == ["x?a=1&lt=2", "y"]


@pytest.mark.parametrize("page", ["<!-- " * 60_000, "<script>" * 40_000, "<a " * 60_000, "<" * 200_000, "<!--" + "-" * 200_000])
def test_broken_pages_take_linear_time(spark, page):
    hrefs(spark, "<p>warm</p>")
    start = time.perf_counter()
    hrefs(spark, page)
    assert time.perf_counter() - start < 5


def test_references(apply):
    given = ["&#00000065;&#x0000041;", "&sol;&period;&lowbar;", "&amp &copy. &#65 x", "a=1&copy=2", "&NotEqualTilde;", "&bogus; &", "&#0;&#1114112;&#99999999999;", "&Tab;|&NewLine;"]
    assert apply(H.decode_entities, given) == ["AA", "/._", "& ©. A x", "a=1&copy=2", "≂̸", "&bogus; &", "���", "\t|\n"]


def test_default_ports(spark):
    df = spark.createDataFrame([("https://h:443/a/b.html",), ("http://h:80/a/",), ("https://h:80/a/",), ("http://h:8080/",)], "u string")
    found = [r[0] for r in df.select(resolve_url(F.col("u"), F.lit("c.pdf"))).collect()]
    assert found == ["https://h/a/c.pdf", "http://h/a/c.pdf", "https://h:80/a/c.pdf", "http://h:8080/c.pdf"]


def test_nothing_may_follow_the_json(spark):
    raws = ['{"v": {"b": "x"}}', '{"v": {"b": "x"}} junk', '{"v": {"b": "x"}}, {"v": 1}', ' {"V": {"B": "x"}} ', "{", None]
    pages = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    assert sorted(r["i"] for r in L.with_json(pages, F.col("raw"), "v struct<b:string>", "p").collect()) == [0, 3]


def test_positions_of_long_lists_stay_apart(spark):
    item = """{'link': {'href': 'h.pdf', 'text': 'Rescue data sheets %d'}}"""
    lists = "".join(f"""<link-list :items="[{item % i}]"></link-list>""" for i in range(2_200))
    page = f'<script type="text/x-template">{lists}</script>'
    found = L.extract_template_links(spark.createDataFrame([("u", page)], "url string, html string"), "rescue").collect()
    assert [r["text"].split()[-1] for r in sorted(found, key=lambda r: r["pos"])] == [str(i) for i in range(2_200)]


def test_the_invariant_cannot_be_pruned(spark):
    cards = spark.createDataFrame([("VW", "Golf", "Failed", 1, "Low"), ("VW", "Golf", "Failed", 2, "Low")], "brand string, model_name string, status string, estimated_fleet_size int, bundle_priority string")
    for read in (lambda df: df.count(), lambda df: df.select("brand").collect()):
        with pytest.raises(Exception, match="disagree"):
            read(R.priority_report(cards))


def test_first_and_latest_are_one_aggregate(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), ("b", 5, "y"), (None, 3, "z")], "k string, p int, v string")
    found = O.first_and_latest_by(df, ["k"], F.col("p"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    rows = {r["k"]: (r["first"]["v"], r["latest"]["v"]) for r in found.collect()}
    assert rows == {"a": ("x", None), "b": ("y", "y"), None: ("z", "z")}
    assert plan.count("Exchange hashpartitioning") == 1
    assert schemas.ENTRIES["entry_pos"].dataType["page"].dataType.typeName() == "long"


@pytest.mark.parametrize(
    "item",
    [
        '<div class=c-item><h3 class="t x">Head <b>2020</b></h3>rest</div>', "<li title='a > b' class='x c-item'><span class=t>Head <span>2020</span></span></li>",
        '<section data-c="class=c-item" class="c-item"><div class="t">Head <div>2020</div></div></section>',
    ],
)
def test_elements_by_class(spark, item):
    df = spark.createDataFrame([(f"<ul><li class='c-items'>no</li>{item}<p>after</p>",)], "html string")
    pieces = df.select(F.explode(H.element_pieces(H.visible_markup(F.col("html")), "c-item")).alias("e"))
    rows = pieces.select("e", H.labelled_text(F.col("e"), "t").alias("t"), H.labelled_text(F.col("e"), "none").alias("n")).collect()
    assert [(r["t"], r["n"]) for r in rows] == [("Head 2020", None)]
    assert "after" not in rows[0]["e"]


def test_unclosed_labelled_elements_take_linear_time(spark):
    df = spark.createDataFrame([("<div class=t><span>x" * 15_000,)], "html string")
    start = time.perf_counter()
    df.select(H.labelled_text(F.col("html"), "t").alias("t")).collect()
    assert time.perf_counter() - start < 8
