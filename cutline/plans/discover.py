"""Discovery of rescue-card entries, one extractor per brand, and the registry that runs them.

An extractor turns landed pages or feeds into entries. Single-page brands are narrow plans:
a page becomes its entries inside the scan stage.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline import fixed_values as fv
from cutline import schemas
from cutline.functions import html as H
from cutline.functions import text as X
from cutline.functions.binding import bind, packed
from cutline.functions.filenames import audi_tokens, tokens, with_parsed_name
from cutline.functions.names import not_blank, trim_ws
from cutline.functions.urls import resolve_url, url_file_name, url_file_stem
from cutline.operators.cards import only_language
from cutline.operators.links import (
    extract_data_props,
    extract_links,
    extract_template_links,
    follow,
    linked_only,
    missing_pages,
    with_absolute_url,
    with_json,
)
from cutline.session import checkpointed


def _entries(
    df: DataFrame,
    brand: str,
    source: Column,
    label: Column,
    page: Column,
    link: Column,
    parsed: Column | None = None,
) -> DataFrame:
    return df.select(
        F.lit(brand).alias("brand"),
        source.alias("source_page_url"),
        "download_url",
        label.alias("raw_label"),
        F.struct(page.cast("long").alias("page"), link.cast("long").alias("link")).alias("entry_pos"),
        (F.col("parsed") if parsed is None else parsed).alias("parsed"),
    )


def _parsed(**known: Column) -> Column:
    """Parsed struct with the given fields, the others NULL."""
    return F.struct(
        *[
            known.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name)
            for field in schemas.PARSED.fields
        ]
    )


def _flat_german(pages: DataFrame, brand: str, tokenizer) -> DataFrame:
    links = with_absolute_url(extract_links(pages, with_text=False))
    german = only_language(with_parsed_name(links, "download_url", tokenizer), fv.GERMAN)
    return _entries(
        german, brand, F.col("url"), url_file_name(F.col("download_url")), F.lit(0), F.col("pos")
    )


def discover_audi(pages: DataFrame) -> DataFrame:
    """Flat list of links in every language on one page; German ones are kept."""
    return _flat_german(pages, "Audi", audi_tokens)


def discover_cupra(pages: DataFrame) -> DataFrame:
    return _flat_german(pages, "Cupra", tokens)


def discover_vw(feeds: DataFrame) -> DataFrame:
    """Files of the first German language bucket of a JSON feed; an incomplete feed gives no rows."""
    ddl = "config struct<base_url:string>, languages array<struct<name:string,files:array<string>>>"
    feed = with_json(feeds, F.col("json"), ddl, "feed")

    def is_german(bucket: Column) -> Column:
        return F.contains(F.upper(F.coalesce(bucket["name"], F.lit(""))), F.lit(fv.GERMAN_BUCKET_MARK))

    bucket = F.try_element_at(F.filter(F.col("feed.languages"), is_german), F.lit(1))
    files = (
        bind(feed, base_url=F.col("feed.config.base_url"), bucket=bucket)
        .where(F.length("base_url") > 0)
        .select("url", "base_url", F.col("bucket.name").alias("bucket"), F.posexplode("bucket.files").alias("pos", "file"))
    )
    url = F.concat_ws("/", F.rtrim("base_url", F.lit("/")), "bucket", "file")
    named = with_parsed_name(files.withColumn("download_url", url), "file")
    return _entries(named, "VW", F.col("url"), F.col("file"), F.lit(0), F.col("pos"))


def discover_lamborghini(pages: DataFrame) -> DataFrame:
    """Model name is what stands before the phrase in the file name; other documents fall out."""
    links = with_absolute_url(extract_links(pages, with_text=False))
    stems = bind(links, stem=url_file_stem(F.col("download_url"))).where(X.has_rescue_sheet_name(F.col("stem")))
    named = bind(stems, name=X.name_before_sheet(F.col("stem")))
    parsed = _parsed(
        model_name=F.col("name"), language_code=F.lit(fv.ENGLISH), parse_confidence=F.lit("High")
    )
    return _entries(named, "Lamborghini", F.col("url"), F.col("name"), F.lit(0), F.col("pos"), parsed)


def discover_porsche(pages: DataFrame) -> DataFrame:
    """Combined documents covering all models, from the page's template script."""
    links = extract_template_links(pages).withColumnRenamed("href", "download_url")
    classic = F.contains(F.upper("text"), F.lit(fv.COMBINED_CLASSIC_MARK.upper()))
    parsed = _parsed(
        model_name=F.when(classic, fv.COMBINED_CLASSIC_NAME).otherwise(fv.COMBINED_NAME),
        variant=F.col("text"),
        language_code=F.lit(fv.ENGLISH),
        parse_confidence=F.lit("Heuristic"),
    )
    return _entries(links, "Porsche", F.col("url"), F.col("text"), F.lit(0), F.col("pos"), parsed)


def discover_bentley(pages: DataFrame) -> DataFrame:
    """Accordion items with a year in their heading and an unambiguous German button.

    A German link whose href also carries another label in the same item is not trusted.
    Items and their links stay arrays of their page row, so nothing is shuffled.
    """
    items = pages.select(
        "url",
        F.posexplode(H.element_pieces(H.visible_markup(F.col("html")), fv.BENTLEY_ITEM_CLASS)).alias("pos", "item"),
    )

    def labelled(anchor: Column) -> Column:
        label = H.labelled_text(anchor["inner"], fv.BENTLEY_LABEL_CLASS)
        german = F.coalesce(F.upper(label) == fv.GERMAN_BUTTON_LABEL, F.lit(False))  # no label is another label
        return F.struct(anchor["href"].alias("href"), german.alias("german"))

    documents = F.filter(
        F.transform(H.anchors(F.col("item")), labelled), lambda a: not_blank(a["href"]) & a["href"].endswith(".pdf")
    )
    headed = bind(items, heading=H.labelled_text(F.col("item"), fv.BENTLEY_TITLE_CLASS)).where(not_blank(F.col("heading")))
    dated = bind(headed, years=X.year_range(F.col("heading"))).where(
        F.col("years.from").isNotNull() | F.col("years.to").isNotNull()
    )
    linked = bind(dated, links=documents)
    picked = bind(linked, href=F.try_element_at(F.filter("links", lambda a: a["german"]), F.lit(1))["href"])
    trusted = picked.where(not_blank(F.col("href"))).where(
        ~F.exists("links", lambda a: (a["href"] == F.col("href")) & ~a["german"])
    )
    parsed = _parsed(
        model_name=X.strip_parens(F.col("heading")),
        variant=F.col("heading"),
        build_year_from=F.col("years.from"),
        build_year_to=F.col("years.to"),
        fuel_type=X.powertrain(F.col("heading")),
        language_code=F.lit(fv.GERMAN),
        parse_confidence=F.lit("Heuristic"),
    )
    return _entries(with_absolute_url(trusted), "Bentley", F.col("url"), F.col("heading"), F.lit(0), F.col("pos"), parsed)


def seat_model_pages(overview: DataFrame) -> DataFrame:
    """``(page_url, page)``: distinct model pages of the overview, in order of their first link."""
    links = extract_links(
        overview,
        href_test=lambda h: F.contains(h, F.lit(fv.SEAT_MODEL_HREF)),
        tag_test=lambda t: H.has_class(t, fv.SEAT_MODEL_CLASS),
        suffix=None,
        with_text=False,
    )
    return (
        links.select(resolve_url(F.col("url"), F.col("href")).alias("page_url"), "pos")
        .groupBy("page_url")
        .agg((F.min("pos") + 1).alias("page"))
    )


def discover_seat(overview: DataFrame, pages: DataFrame) -> DataFrame:
    """First link to the general guide, then the German documents of every distinct model page."""
    guide = (
        with_absolute_url(
            extract_links(
                overview, href_test=lambda h: F.contains(h, F.lit(fv.SEAT_GUIDE_HREF)), suffix=None, with_text=False
            )
        )
        .groupBy("url")
        .agg(F.min_by("download_url", "pos").alias("download_url"))
    )
    guide_parsed = _parsed(
        model_name=F.lit(fv.SEAT_GUIDE_NAME), language_code=F.lit(fv.GERMAN), parse_confidence=F.lit("High")
    )
    guide_entries = _entries(
        guide, "Seat", F.col("url"), F.lit(fv.SEAT_GUIDE_LABEL), F.lit(0), F.lit(0), guide_parsed
    )
    model_pages = seat_model_pages(overview)
    landed = linked_only(pages, model_pages).withColumnRenamed("url", "page_url")
    links = with_absolute_url(extract_links(landed, with_text=False), base="page_url")
    documents = only_language(with_parsed_name(links, "download_url"), fv.GERMAN)
    german = follow(model_pages, documents.hint("merge"), url="page_url")
    model_entries = _entries(
        german, "Seat", F.col("page_url"), url_file_name(F.col("download_url")), F.col("page"), F.col("pos")
    )
    return guide_entries.unionByName(model_entries)


def skoda_model_links(overview: DataFrame) -> DataFrame:
    """``(page_url, model_name, page)``: model links of the overview; repeats are kept."""
    body = (
        extract_data_props(overview, fv.SKODA_OVERVIEW_MODULE, "viewmodel struct<body:string>")
        .select("url", "module_pos", F.col("props.viewmodel.body").alias("html"))
        .where(not_blank(F.col("html")))
    )
    links = extract_links(body, href_test=lambda h: F.contains(h, F.lit(fv.SKODA_MODEL_HREF)), suffix=None)
    return links.where(not_blank(F.col("text"))).select(
        resolve_url(F.col("url"), F.col("href")).alias("page_url"),
        F.col("text").alias("model_name"),
        packed(F.col("module_pos"), F.col("pos")).alias("page"),
    )


def discover_skoda(overview: DataFrame, pages: DataFrame) -> DataFrame:
    """Files of every linked model page; the name comes from the link, the rest from the file title.

    Each landed page is read once, however many links point to it; links then join its files by shuffle, as Spark
    takes rows extracted from pages for as few as the pages' bytes suggest.
    """
    links = skoda_model_links(overview)
    linked = linked_only(pages, links)
    modules = extract_data_props(
        linked, fv.SKODA_MODEL_MODULE, "viewmodel struct<files:array<struct<title:string,link:string>>>"
    )
    found = modules.select(
        F.col("url").alias("page_url"), "module_pos", F.posexplode("props.viewmodel.files").alias("file_pos", "file")
    ).where(not_blank(F.col("file.link")))
    titled = bind(
        found,
        title=trim_ws(F.col("file.title")),
        download_url=resolve_url(F.col("page_url"), F.col("file.link")),
        pos=packed(F.col("module_pos"), F.col("file_pos")),
    )
    title = F.col("title")
    files = bind(
        titled,
        years=X.year_range(title),
        body_type=X.last_vocab(title, fv.SKODA_BODY_TYPES),
        doors=X.doors(title),
        fuel_type=X.fuel_type(title),
    ).drop("file", "module_pos", "file_pos")
    no_year = F.col("years.from").isNull() & F.col("years.to").isNull()
    parsed = _parsed(
        model_name=F.col("model_name"),
        variant=title,
        body_type=F.col("body_type"),
        build_year_from=F.col("years.from"),
        build_year_to=F.col("years.to"),
        doors=F.col("doors"),
        fuel_type=F.col("fuel_type"),
        language_code=F.lit(fv.GERMAN),
        parse_confidence=F.when(no_year, "Unparsed").otherwise("Heuristic"),
    )
    return _entries(
        files.hint("merge").join(links, "page_url"),
        "Skoda",
        F.col("page_url"),
        F.coalesce("title", "model_name"),
        F.col("page"),
        F.col("pos"),
        parsed,
    )


@dataclass(frozen=True)
class Landed:
    """Landed inputs of one discovery run."""

    pages: DataFrame
    feeds: DataFrame

    def page(self, brand: str) -> DataFrame:
        """The brand's overview page; the URL filter reaches the scan."""
        return self.pages.where(F.col("url") == fv.PAGE_URLS[brand])

    def feed(self, brand: str) -> DataFrame:
        return self.feeds.where(F.col("url") == fv.PAGE_URLS[brand])


Extractor = Callable[[Landed], DataFrame]

EXTRACTORS: dict[str, Extractor] = {
    "VW": lambda landed: discover_vw(landed.feed("VW")),
    "Audi": lambda landed: discover_audi(landed.page("Audi")),
    "Skoda": lambda landed: discover_skoda(landed.page("Skoda"), landed.pages),
    "Seat": lambda landed: discover_seat(landed.page("Seat"), landed.pages),
    "Cupra": lambda landed: discover_cupra(landed.page("Cupra")),
    "Porsche": lambda landed: discover_porsche(landed.page("Porsche")),
    "Bentley": lambda landed: discover_bentley(landed.page("Bentley")),
    "Lamborghini": lambda landed: discover_lamborghini(landed.page("Lamborghini")),
}


def missing_model_pages(landed: Landed, brands: Sequence[str] = fv.BRANDS) -> DataFrame:
    """``(brand, page_url)``: model pages that an overview links to and that were never landed."""
    hops = {"Seat": seat_model_pages, "Skoda": skoda_model_links}
    found = [
        missing_pages(links(landed.page(brand)), landed.pages).select(F.lit(brand).alias("brand"), "page_url").distinct()
        for brand, links in hops.items()
        if brand in brands
    ]
    empty = schemas.empty_frame(landed.pages.sparkSession, schemas.struct_of("brand string, page_url string"))
    return reduce(DataFrame.unionByName, found, empty)


def discover_all(landed: Landed, brands: Sequence[str] = fv.BRANDS) -> DataFrame:
    """Lazy union of the entries of several brands, without failure isolation."""
    return reduce(DataFrame.unionByName, [EXTRACTORS[b](landed) for b in brands])


def run_discovery(
    spark: SparkSession,
    landed: Landed,
    brands: Sequence[str] = fv.BRANDS,
    extractors: dict[str, Extractor] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(entries, brand_runs)``: every brand on its own, failures recorded instead of raised.

    Brands run as concurrent Spark jobs. Their entries are checkpointed, which is both the
    action that shows a failure and the cut that keeps later steps from extracting again.
    """
    registry = EXTRACTORS if extractors is None else extractors

    def run(brand: str):
        if brand not in registry:
            return None, (brand, "NotImplemented", fv.TEXT_NO_SOURCE)
        try:
            return checkpointed(registry[brand](landed)), (brand, "Completed", None)
        except NotImplementedError as error:
            return None, (brand, "NotImplemented", str(error))
        except Exception as error:  # one brand's failure must not touch the others
            return None, (brand, "DiscoveryFailed", str(error))

    with ThreadPoolExecutor(max_workers=max(len(brands), 1)) as pool:
        outcomes = list(pool.map(inheritable_thread_target(spark)(run), brands))
    found = [entries for entries, _ in outcomes if entries is not None]
    entries = reduce(DataFrame.unionByName, found) if found else schemas.empty_frame(spark, schemas.ENTRIES)
    return entries, schemas.literal_frame(spark, [row for _, row in outcomes], schemas.BRAND_RUNS)
