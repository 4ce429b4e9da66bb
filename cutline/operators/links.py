"""Generators over landed pages: links, hydration JSON, template links, joins of hops.

All of them are narrow: a page becomes its rows inside the scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline import fixed_values as fv
from cutline.functions import html as H
from cutline.functions.binding import bind, packed
from cutline.functions.names import not_blank, trim_ws
from cutline.functions.urls import resolve_url

_CORRUPT = "_corrupt_record"
_JSON_PIECE = r'"(?:[^"\\]++|\\.)*+"\s*+:?|[^"]++|"'
_TEMPLATE = r"""(?is)<script\b(?=[^>]*\btype\s*=\s*["']?text/x-template["'\s>])[^>]*+>(.*?)</script\s*+>"""


def extract_links(
    pages: DataFrame, href_test=None, tag_test=None, suffix: str | None = ".pdf", with_text: bool = True
) -> DataFrame:
    """``(page columns except html, pos, href[, text])`` of the anchors of a page.

    ``suffix`` is compared case-sensitively; ``href_test`` and ``tag_test`` take the
    href and the opening tag and return a condition.  Blank hrefs are dropped.
    """
    keep = [c for c in pages.columns if c != "html"]
    pieces = H.pieces_from(H.visible_markup(F.col("html")), H.ANCHOR)
    found = pages.select(*keep, F.posexplode(pieces).alias("pos", "piece"))
    found = bind(bind(found, tag=H.anchor_tag(F.col("piece"))), href=H.attribute(F.col("tag"), "href"))
    wanted = not_blank(F.col("href"))
    if suffix is not None:
        wanted &= F.col("href").endswith(suffix)
    if href_test is not None:
        wanted &= href_test(F.col("href"))
    if tag_test is not None:
        wanted &= tag_test(F.col("tag"))
    columns = [*keep, "pos", "href"]
    if with_text:
        columns.append(H.anchor_text(H.anchor_inner(F.col("piece"), F.col("tag"))).alias("text"))
    return found.where(wanted).select(*columns)


def lower_json_keys(c: Column) -> Column:
    """Lower-case the member names of a JSON text, so they match a schema in any case."""
    pieces = F.regexp_extract_all(c, F.lit(_JSON_PIECE), F.lit(0))
    return F.array_join(
        F.transform(pieces, lambda p: F.when(p.rlike(r'(?s)\A".*:\z'), F.lower(p)).otherwise(p)), ""
    )


def with_json(df: DataFrame, raw: Column, ddl: str, out: str) -> DataFrame:
    """Add strictly parsed JSON; rows whose text is missing or malformed are dropped.

    Member names match in any case: ``ddl`` lists the fields in lower case.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "allowSingleQuotes": "false"}
    read = bind(df, **{out: F.from_json(lower_json_keys(raw), f"{ddl}, {_CORRUPT} string", options)})
    # The reader takes a text whose first value is sound; as the only member of an array nothing may follow that.
    alone = (F.json_array_length(F.concat(F.lit("["), raw, F.lit("]"))) == 1) & F.rtrim(raw, F.lit(" \t\r\n")).endswith("}")
    return read.where(F.col(out).isNotNull() & F.col(f"{out}.{_CORRUPT}").isNull() & alone)


def extract_data_props(pages: DataFrame, module: str, ddl: str) -> DataFrame:
    """``(page columns except html, module_pos, props)``: parsed ``data-props`` of every
    ``div[data-module=module]``; modules with missing or malformed JSON give no row."""
    keep = [c for c in pages.columns if c != "html"]
    tags = pages.select(*keep, F.posexplode(H.opening_tags(F.col("html"), "div")).alias("module_pos", "tag"))
    modules = bind(tags.where(H.attribute(F.col("tag"), "data-module") == module), raw=H.attribute(F.col("tag"), "data-props"))
    return with_json(modules, F.col("raw"), ddl, "props").select(*keep, "module_pos", "props")


def extract_template_links(pages: DataFrame, prefix: str = fv.COMBINED_PREFIX) -> DataFrame:
    """``(page columns except html, pos, href, text)`` of the link lists in a page's first
    template script whose text starts with ``prefix`` in any case."""
    keep = [c for c in pages.columns if c != "html"]
    template = F.regexp_extract(F.regexp_replace(F.col("html"), r"<!--(?:[^-]++|-(?!->))*+(?:-->|\z)", ""), _TEMPLATE, 1)
    lists = H.opening_tags(template, "link-list")
    items = "items array<struct<link:struct<href:string,text:string>>>"
    tags = pages.select(*keep, F.posexplode(lists).alias("list_pos", "tag"))
    raw = bind(tags, raw=H.attribute(F.col("tag"), ":items")).where(not_blank(F.col("raw")))
    as_object = F.concat(F.lit('{"items":'), F.replace(F.col("raw"), F.lit("'"), F.lit('"')), F.lit("}"))
    found = with_json(raw, as_object, items, "parsed").select(
        *keep, "list_pos", F.posexplode("parsed.items").alias("item_pos", "item")
    )
    named = bind(found, text=trim_ws(F.col("item.link.text")))
    return named.where(
        not_blank(F.col("item.link.href"))
        & not_blank(F.col("text"))
        & F.lower("text").startswith(prefix.lower())
    ).select(
        *keep,
        packed(F.col("list_pos"), F.col("item_pos")).alias("pos"),
        F.col("item.link.href").alias("href"),
        "text",
    )


def follow(links: DataFrame, pages: DataFrame, link_url: str = "page_url", url: str = "url") -> DataFrame:
    """Second hop: links joined with the landed page they point to.

    A page many links point to is a skewed key of a plain equi-join, which adaptive
    execution splits at run time.
    """
    return links.join(pages.withColumnRenamed(url, link_url), link_url, "inner")


def linked_only(pages: DataFrame, links: DataFrame, link_url: str = "page_url", bits: int = 1 << 20) -> DataFrame:
    """Pages whose URL may be among those of ``links``, told inside the scan of the pages.

    The links' hashed URLs become a bit field of fixed size, a scalar subquery that runs with the query.  It lets every
    linked page pass and, by chance, few others; a join of what is extracted from the pages settles these.
    """
    at = F.pmod(F.xxhash64(link_url), F.lit(bits)).alias("at")
    used = links.select(at).groupBy(F.shiftright("at", 6).alias("word"))
    words = used.agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits"))
    every = links.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    in_order = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    field = every.agg(in_order["bits"].alias("field")).scalar()
    place = F.pmod(F.xxhash64("url"), F.lit(bits))
    word = F.get(field, F.shiftright(place, 6).cast("int"))
    return pages.where(F.getbit(word, place.bitwiseAND(63).cast("int")) == 1)


def missing_pages(links: DataFrame, pages: DataFrame, link_url: str = "page_url") -> DataFrame:
    """Links whose page was never landed: reported, not fatal."""
    return links.join(pages.select(F.col("url").alias(link_url)), link_url, "left_anti")


def pick_publication(pages: DataFrame, year: int, host: str = fv.STOCK_HOST) -> DataFrame:
    """``(page columns except html, download_url, supported)``: the first publication link of a year.

    A root-relative link gets the host in front.
    """
    keys = [c for c in pages.columns if c != "html"]
    mark = f"{fv.STOCK_LINK_PREFIX}{year}"
    links = extract_links(
        pages,
        href_test=lambda h: F.contains(F.lower(h), F.lit(mark)),
        tag_test=lambda t: H.has_class(t, fv.STOCK_LINK_CLASS),
        suffix=None,
        with_text=False,
    )
    first = links.groupBy(*keys).agg(F.min_by("href", "pos").alias("href"))
    url = F.when(F.lower("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit(host), "href"))
    return first.select(*keys, url.alias("download_url")).withColumn(
        "supported", F.contains(F.lower("download_url"), F.lit(".xlsx"))
    )


def with_absolute_url(links: DataFrame, base: str = "url", href: str = "href") -> DataFrame:
    return bind(links, download_url=resolve_url(F.col(base), F.col(href)))
