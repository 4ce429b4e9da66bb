"""Landed pages: links, URL resolution, hops, hydration JSON, and one extractor per brand.

The generic generators read the given ``pages``. Brand pages are rendered from ``part``, one
page (or overview with model pages) per part, so extraction work grows with the table; the
checks state the expected entries straight from the part columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindings.common import ENGLISH_FILE, GERMAN_FILE, MODEL, VARIANT, derive, entry_sql, flat_entries, spread, table
from cutline import fixed_values as fv
from cutline.functions import html as H
from cutline.functions.urls import resolve_url
from cutline.operators import links as L
from cutline.operators import ordered as O
from cutline.plans import discover as D

_HOST = "https://site.example"


def page_links(spark, sf):
    """All anchors of the given pages, whole documents, with their text."""
    return L.extract_links(table(spark, sf, "pages").select("page_id", "html"), suffix=None)


def suffixed_links(spark, sf):
    """Anchors by a case-sensitive suffix, in document order."""
    return L.extract_links(table(spark, sf, "pages").select("page_id", "html"), suffix="ion", with_text=False)


def resolved_links(spark, sf):
    found = L.extract_links(table(spark, sf, "pages").select("page_id", "url", "html"), suffix=None, with_text=False)
    return L.with_absolute_url(found).select("page_id", "pos", "download_url")


def relative_urls(spark, sf):
    """Dot segments, queries and relative paths against every page URL."""
    hrefs = F.array(*[F.lit(h) for h in ("x/./y.pdf", "../up.pdf", "?q=1", "//cdn.example/a", "HTTP://Z.example/", "a%20b")])
    pages = table(spark, sf, "pages").select("page_id", "url", F.posexplode(hrefs).alias("pos", "href"))
    return pages.select("page_id", "pos", resolve_url(F.col("url"), F.col("href")).alias("download_url"))


def _section_links(spark, sf):
    """Links of all pages to the sections other pages live in (first path segment)."""
    found = L.extract_links(table(spark, sf, "pages").select("page_id", "html"), suffix=None, with_text=False)
    return found.select("page_id", F.col("href").alias("page_url"))


def _sections(spark, sf):
    section = F.concat(F.lit("/"), F.regexp_extract("url", r"\A[a-z]+://[^/]+/([^/?#]*)", 1))
    return table(spark, sf, "pages").select(section.alias("url"), F.col("page_id").alias("target_id"))


def followed_links(spark, sf):
    """Second hop: distinct section links joined with the pages of that section, counted."""
    distinct = _section_links(spark, sf).select("page_url").distinct()
    joined = L.follow(distinct, _sections(spark, sf))
    return joined.groupBy("page_url").agg(F.count(F.lit(1)).alias("pages"), F.min("target_id").alias("first_page"))


def unlanded_links(spark, sf):
    distinct = _section_links(spark, sf).distinct()
    return L.missing_pages(distinct, _sections(spark, sf)).groupBy("page_url").agg(F.count(F.lit(1)).alias("links"))


def first_links(spark, sf):
    """First link of every page, as the pick operators take it."""
    found = L.extract_links(table(spark, sf, "pages").select("page_id", "html"), suffix=None, with_text=False)
    return O.first_by(found, ["page_id"], F.col("pos"))


def guarded_links(spark, sf):
    """First link at an even position per page whose href does not also stand at an odd one."""
    found = L.extract_links(table(spark, sf, "pages").select("page_id", "html"), suffix=None, with_text=False)
    return O.unambiguous_links(found, ["page_id"], F.col("pos") % 2 == 0)


def hydration_props(spark, sf):
    """Event properties embedded in an escaped attribute and read back."""
    escaped = "replace(concat('{\"ViewModel\":', props, '}'), '\"', '&quot;')"
    pages = derive(
        table(spark, sf, "events"), event_id="event_id",
        html=f"concat('<p>x</p><div data-module=\"other\"></div><div data-module=\"m\" data-props=\"', "
        f"CASE WHEN event_id % 10 = 0 THEN '{{broken' ELSE {escaped} END, '\">t</div>')",
    )
    return L.extract_data_props(pages, "m", "viewmodel struct<k:int>").select("event_id", F.col("props.viewmodel.k").alias("k"))


def page_texts(spark, sf):
    """Readable text of whole pages: no comments, scripts or tags, entities decoded."""
    text = H.text_content(H.visible_markup(F.col("html")))
    return table(spark, sf, "pages").select("page_id", F.md5(text).alias("text_hash"), F.length(text).alias("text_length"))


# --- rendered brand pages ------------------------------------------------------

_URL = f"concat('{_HOST}/p/', p_partkey, '/list.html')"
_FLAT_PAGE = (
    f"concat('<html><!-- <a href=\"gone.pdf\">old</a> --><body><a href=\"/dam/', {GERMAN_FILE}, '\">Laden</a>', "
    f"'<a href=''dam/', {ENGLISH_FILE}, '''>Load</a><a href=\"/notes.txt\">x</a></body></html>')"
)
_LAMBORGHINI_PAGE = (
    "concat('<a href=\"/d/GUIDE%20ALL.pdf\">g</a><a href=\"/d/', upper(replace(p_name, ' ', '%20')), '_', p_partkey, "
    "'%20RESCUE_DATA%20SHEET_V1.pdf\">s</a>')"
)
_PORSCHE_PAGE = (
    "concat('<script type=\"text/x-template\" id=\"t\"><div><link-list :items=\"[{''link'':{''href'':''https://cdn.example/', p_partkey, "
    "'.pdf'',''text'':''Rescue Data Sheets ', p_name, '''}},{''link'':{''href'':''/c.pdf'',''text'':''rescue data sheets (classic) '', ''x'':1}},"
    "{''link'':{''href'':''/o.pdf'',''text'':''Other''}}]\"></link-list>', "
    "'<link-list :items=\"[broken\"></link-list></div></script>')"
)
_BENTLEY_PAGE = (
    "concat('<div class=\"acc\"><div class=\"bm-m-accordion__item\" id=\"a\"><h3><button class=\"bm-m-accordion__item-title\"> ', upper(p_name), "
    "' (ICE) (', 1950 + p_size, ' - ', 1960 + p_size, ') </button></h3><div><a href=\"/e', p_partkey, '.pdf\"><span class=\"bm-e-button__label\">ENGLISH</span></a>"
    "<a href=\"/g', p_partkey, '.pdf\"><span class=\"bm-e-button__label\"> deutsche </span></a></div></div>', "
    "'<div class=\"bm-m-accordion__item\"><button class=\"bm-m-accordion__item-title\">SHARED (', 1950 + p_size, ' - )</button><div>"
    "<a href=\"/s.pdf\"><span class=\"bm-e-button__label\">&#20013;&#25991;</span></a><a href=\"/s.pdf\"><span class=\"bm-e-button__label\">DEUTSCHE</span></a></div></div>', "
    "'<div class=\"bm-m-accordion__item\"><button class=\"bm-m-accordion__item-title\">No year</button><a href=\"/n.pdf\"><span class=\"bm-e-button__label\">DEUTSCHE</span></a></div></div>')"
)
_SEAT_OVERVIEW = (
    f"concat('<a href=\"/dam/emergency-response-guide-de.pdf\">g</a><a href=\"/dam/2/emergency-response-guide-de.pdf\">g2</a>"
    f"<a class=\"link-arrow big\" href=\"/rettungsblaetter/', p_partkey, '\">m</a><a class=\"link-arrow\" href=\"{_HOST}/rettungsblaetter/', p_partkey, '\">again</a>"
    f"<a class=\"link\" href=\"/rettungsblaetter/no\">n</a>')"
)
_SKODA_OVERVIEW = (
    "concat('<div data-module=\"OneColumnText\" data-props=\"', replace(replace(replace(concat('{\"viewModel\":{\"body\":\"<p><a href=''/rettungsdatenblatt-', "
    "p_partkey, '''>', p_name, '</a> <a href=''/rettungsdatenblatt-', p_partkey, '''>Twin</a><a href=''/rettungsdatenblatt-x''> </a></p>\"}}'), "
    "'\"', '&quot;'), '<', '&lt;'), '>', '&gt;'), '\"></div>')"
)
_SKODA_MODEL = (
    "concat('<div data-module=\"download-file\" data-props=\"', replace(concat('{\"viewModel\":{\"files\":[{\"title\":\" ', p_name, ' iV Combi ', "
    "CASE WHEN p_partkey % 2 = 0 THEN concat('(ab ', 1950 + p_size, ') 5d') ELSE 'neu' END, '\",\"link\":\"/media/', p_partkey, '.pdf\"},"
    "{\"title\":null,\"link\":\"/media/', p_partkey, 'b.pdf\"},{\"title\":\"x\",\"link\":\" \"}]}}'), '\"', '&quot;'), '\"></div>')"
)
_FEED = (
    "concat('{\"Config\": {\"base_url\": \"https://assets.example/pdf/\"}, \"languages\": [{\"name\": \"l.EN\", \"files\": [\"', "
    f"{ENGLISH_FILE}, '\"]}}, {{\"name\": ', CASE WHEN p_partkey % 9 = 0 THEN 'null' ELSE '\"l.de\"' END, ', \"files\": [\"', {GERMAN_FILE}, '\", \"short.pdf\"]}}]}}')"
)


def _pages(spark, sf, html: str, url: str = _URL) -> DataFrame:
    return derive(spread(table(spark, sf, "part")), url=url, html=html)


def audi_entries(spark, sf):
    return D.discover_audi(_pages(spark, sf, _FLAT_PAGE))


def cupra_entries(spark, sf):
    return D.discover_cupra(_pages(spark, sf, _FLAT_PAGE))


def vw_entries(spark, sf):
    return D.discover_vw(derive(spread(table(spark, sf, "part")), url=_URL, json=_FEED))


def lamborghini_entries(spark, sf):
    return D.discover_lamborghini(_pages(spark, sf, _LAMBORGHINI_PAGE))


def porsche_entries(spark, sf):
    return D.discover_porsche(_pages(spark, sf, _PORSCHE_PAGE))


def bentley_entries(spark, sf):
    return D.discover_bentley(_pages(spark, sf, _BENTLEY_PAGE))


def seat_entries(spark, sf):
    models = _pages(spark, sf, _FLAT_PAGE, f"concat('{_HOST}/rettungsblaetter/', p_partkey)")
    return D.discover_seat(_pages(spark, sf, _SEAT_OVERVIEW), models)


def skoda_entries(spark, sf):
    models = _pages(spark, sf, _SKODA_MODEL, f"concat('{_HOST}/rettungsdatenblatt-', p_partkey)")
    return D.discover_skoda(_pages(spark, sf, _SKODA_OVERVIEW), models)


_ALL = {
    "Audi": audi_entries, "Cupra": cupra_entries, "VW": vw_entries, "Lamborghini": lamborghini_entries,
    "Porsche": porsche_entries, "Bentley": bentley_entries, "Seat": seat_entries, "Skoda": skoda_entries,
}


def _flat(extractor):
    return lambda spark, sf: flat_entries(extractor(spark, sf))


def all_entries(spark, sf):
    """Bag union of every brand's entries, summarised per brand and language."""
    union = reduce(DataFrame.unionByName, [extract(spark, sf) for extract in _ALL.values()])
    return union.groupBy("brand", F.col("parsed.language_code").alias("language_code")).agg(
        F.count(F.lit(1)).alias("entries"), F.min("download_url").alias("first_url"), F.max("raw_label").alias("last_label")
    )


def isolated_runs(spark, sf):
    """A run over five brands: three are found, one fails while its rows are made, one has no extractor."""
    registry = {brand: lambda landed, extract=_ALL[brand]: extract(spark, sf) for brand in ("Audi", "VW", "Lamborghini")}
    registry["Cupra"] = lambda landed: _ALL["Cupra"](spark, sf).withColumn("raw_label", F.raise_error(F.lit("lost")).cast("string"))
    entries, runs = D.run_discovery(spark, D.Landed(None, None), (*registry, "Porsche"), registry)
    return flat_entries(entries).unionByName(runs.select("brand", "outcome"), allowMissingColumns=True)


def publications(spark, sf):
    pages = _pages(
        spark, sf,
        "concat('<a class=\"c-publication\" href=\"/d/fz12_2025.xlsx?v=1&amp;x=2\">a</a><a href=\"/d/fz12_2026.xlsx\">b</a>"
        "<a class=\"c-publication x\" href=\"', CASE WHEN p_partkey % 2 = 0 THEN '/d/FZ12_2026.xlsx?k=1&amp;v=' ELSE 'https://o.example/fz12_2026.pdf?v=' END, p_partkey, '\">c</a>"
        "<a class=\"c-publication\" href=\"/d/fz12_2026.xlsx?late\">d</a>')",
    )
    return L.pick_publication(pages, 2026, "https://stats.example")


QUERIES = {
    "page_links": page_links,
    "page_links_by_suffix": suffixed_links,
    "page_text": page_texts,
    "resolve_page_links": resolved_links,
    "resolve_relative": relative_urls,
    "follow_links": followed_links,
    "missing_pages": unlanded_links,
    "first_link": first_links,
    "unambiguous_links": guarded_links,
    "data_props": hydration_props,
    "pick_publication": publications,
    **{f"discover_{brand.lower()}": _flat(extract) for brand, extract in _ALL.items()},
    "discover_all": all_entries,
    "run_discovery": isolated_runs,
}

# The given pages carry no anchor with several attributes, and four named entities.
_VISIBLE = (
    "regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script.*?</script>', '', 'g'), "
    "'(?is)<style.*?</style>', '', 'g')"
)
_LINKS = f"""
links AS (SELECT page_id, url, CAST(unnest(range(len(m))) AS INTEGER) AS pos, unnest(m) AS a
  FROM (SELECT page_id, url, regexp_extract_all({_VISIBLE}, '<a href="[^"]*">[^<]*') AS m FROM pages)),
found AS (SELECT page_id, url, pos, regexp_extract(a, '"([^"]*)"', 1) AS href, trim(regexp_extract(a, '>(.*)', 1)) AS text FROM links)"""
_DECODED = "replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_ORIGIN = "regexp_extract(url, '^[a-z]+://[^/]+')"
_FOLDER = "regexp_replace(regexp_extract(url, '^[a-z]+://[^?#]*'), '[^/]*$', '')"
_PARENT = "CASE WHEN {0} = {1} || '/' THEN {0} ELSE regexp_replace({0}, '[^/]+/$', '') END".format(_FOLDER, _ORIGIN)


def _german(brand: str, url: str = f"'{_HOST}/dam/' || {GERMAN_FILE}", source: str = _URL, page: str = "0", link: str = "0", label: str = GERMAN_FILE) -> str:
    return entry_sql(
        "part", brand=f"'{brand}'", source_page_url=source, download_url=url, raw_label=label, page=page, link=link,
        model_name=MODEL, variant=VARIANT, body_type="p_type", build_year_from="1950 + p_size", doors="2 + p_partkey % 4",
        fuel_type="'GD'", language_code="'DE'", parse_confidence="'High'",
    )


_ENTRY_SQL = {
    "Audi": _german("Audi"),
    "Cupra": _german("Cupra"),
    "VW": _german("VW", url=f"'https://assets.example/pdf/l.de/' || {GERMAN_FILE}") + " WHERE p_partkey % 9 <> 0 UNION ALL "
    + entry_sql(
        "part", brand="'VW'", source_page_url=_URL, download_url="'https://assets.example/pdf/l.de/short.pdf'",
        raw_label="'short.pdf'", page="0", link="1", parse_confidence="'Unparsed'",
    ) + " WHERE p_partkey % 9 <> 0",
    "Lamborghini": entry_sql(
        "part", brand="'Lamborghini'", source_page_url=_URL,
        download_url=f"'{_HOST}/d/' || upper(p_name) || '_' || p_partkey || ' RESCUE_DATA SHEET_V1.pdf'",
        raw_label="upper(p_name) || ' ' || p_partkey", page="0", link="1", model_name="upper(p_name) || ' ' || p_partkey",
        language_code="'EN'", parse_confidence="'High'",
    ),
    "Porsche": entry_sql(
        "part", brand="'Porsche'", source_page_url=_URL, download_url="'https://cdn.example/' || p_partkey || '.pdf'",
        raw_label="'Rescue Data Sheets ' || p_name", page="0", link="0", model_name="'All Models'",
        variant="'Rescue Data Sheets ' || p_name", language_code="'EN'", parse_confidence="'Heuristic'",
    ) + " UNION ALL " + entry_sql(
        "part", brand="'Porsche'", source_page_url=_URL, download_url="'/c.pdf'", raw_label="'rescue data sheets (classic)'",
        page="0", link="1", model_name="'All Models Classic'", variant="'rescue data sheets (classic)'", language_code="'EN'",
        parse_confidence="'Heuristic'",
    ),
    "Bentley": entry_sql(
        "part", brand="'Bentley'", source_page_url=_URL, download_url=f"'{_HOST}/g' || p_partkey || '.pdf'",
        raw_label="upper(p_name) || ' (ICE) (' || (1950 + p_size) || ' - ' || (1960 + p_size) || ')'", page="0", link="0",
        model_name="upper(p_name)", variant="upper(p_name) || ' (ICE) (' || (1950 + p_size) || ' - ' || (1960 + p_size) || ')'",
        build_year_from="1950 + p_size", build_year_to="1960 + p_size", fuel_type="'ICE'", language_code="'DE'",
        parse_confidence="'Heuristic'",
    ),
    "Seat": entry_sql(
        "part", brand="'Seat'", source_page_url=_URL, download_url=f"'{_HOST}/dam/emergency-response-guide-de.pdf'",
        raw_label="'seat-emergency-response-guide-de.pdf'", page="0", link="0", model_name="'General Guide'",
        language_code="'DE'", parse_confidence="'High'",
    ) + " UNION ALL " + _german("Seat", source=f"'{_HOST}/rettungsblaetter/' || p_partkey", page="3"),
    "Skoda": " UNION ALL ".join(
        entry_sql(
            "part", brand="'Skoda'", source_page_url=f"'{_HOST}/rettungsdatenblatt-' || p_partkey",
            download_url=f"'{_HOST}/media/' || p_partkey || '{suffix}.pdf'", raw_label=label, page=str(page), link=str(link),
            model_name=model, **attrs,
        )
        for page, model in ((0, "p_name"), (1, "'Twin'"))
        for link, suffix, label, attrs in (
            (
                0, "",
                "p_name || ' iV Combi ' || CASE WHEN p_partkey % 2 = 0 THEN '(ab ' || (1950 + p_size) || ') 5d' ELSE 'neu' END",
                {
                    "variant": "p_name || ' iV Combi ' || CASE WHEN p_partkey % 2 = 0 THEN '(ab ' || (1950 + p_size) || ') 5d' ELSE 'neu' END",
                    "body_type": "'Combi'",
                    "build_year_from": "CASE WHEN p_partkey % 2 = 0 THEN 1950 + p_size END",
                    "doors": "CASE WHEN p_partkey % 2 = 0 THEN 5 END",
                    "fuel_type": "'iV'",
                    "language_code": "'DE'",
                    "parse_confidence": "CASE WHEN p_partkey % 2 = 0 THEN 'Heuristic' ELSE 'Unparsed' END",
                },
            ),
            (1, "b", model, {"language_code": "'DE'", "parse_confidence": "'Unparsed'"}),
        )
    ),
}

ORACLE = {
    "page_links": f"WITH {_LINKS} SELECT page_id, pos, href, {_DECODED.format('text')} AS text FROM found",
    "page_links_by_suffix": f"WITH {_LINKS} SELECT page_id, pos, href FROM found WHERE href LIKE '%ion'",
    "page_text": f"""SELECT page_id, md5({_DECODED.format('t')}) AS text_hash, CAST(length({_DECODED.format('t')}) AS INTEGER) AS text_length
FROM (SELECT page_id, regexp_replace({_VISIBLE}, '</?[A-Za-z!][^>]*>', '', 'g') AS t FROM pages)""",
    "resolve_page_links": f"WITH {_LINKS} SELECT page_id, pos, {_ORIGIN} || href AS download_url FROM found",
    "resolve_relative": f"""
SELECT page_id, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN {_FOLDER} || 'x/y.pdf' WHEN 1 THEN {_PARENT} || 'up.pdf'
  WHEN 2 THEN regexp_extract(url, '^[^?#]*') || '?q=1' WHEN 3 THEN regexp_extract(url, '^[a-z]+:') || '//cdn.example/a'
  WHEN 4 THEN 'HTTP://Z.example/' ELSE {_FOLDER} || 'a b' END AS download_url
FROM pages, range(6) t(pos)""",
    "follow_links": f"""
WITH {_LINKS}, s AS (SELECT '/' || regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS section, page_id FROM pages)
SELECT href AS page_url, count(*) AS pages, min(s.page_id) AS first_page
FROM (SELECT DISTINCT href FROM found) JOIN s ON section = href GROUP BY href""",
    "missing_pages": f"""
WITH {_LINKS}, s AS (SELECT '/' || regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS section FROM pages)
SELECT href AS page_url, count(*) AS links FROM (SELECT DISTINCT page_id, href FROM found)
WHERE href NOT IN (SELECT section FROM s) GROUP BY href""",
    "first_link": f"WITH {_LINKS} SELECT page_id, pos, href FROM found QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) = 1",
    "unambiguous_links": f"""
WITH {_LINKS}, f AS (SELECT page_id, pos, href FROM found WHERE pos % 2 = 0 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) = 1)
SELECT page_id, href, pos FROM f WHERE NOT EXISTS (SELECT 1 FROM found o WHERE o.page_id = f.page_id AND o.href = f.href AND o.pos % 2 = 1)""",
    "data_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_id % 10 <> 0",
    "pick_publication": f"""
SELECT {_URL} AS url, CASE WHEN p_partkey % 2 = 0 THEN 'https://stats.example/d/FZ12_2026.xlsx?k=1&v=' || p_partkey
  ELSE 'https://o.example/fz12_2026.pdf?v=' || p_partkey END AS download_url, p_partkey % 2 = 0 AS supported FROM part""",
    **{f"discover_{brand.lower()}": sql for brand, sql in _ENTRY_SQL.items()},
    "discover_all": "SELECT brand, language_code, count(*) AS entries, min(download_url) AS first_url, max(raw_label) AS last_label FROM ("
    + " UNION ALL ".join(_ENTRY_SQL.values()) + ") GROUP BY 1, 2",
    "run_discovery": "SELECT * FROM (" + " UNION ALL ".join(_ENTRY_SQL[f] for f in ("Audi", "VW", "Lamborghini")) + """)
UNION ALL BY NAME SELECT * FROM (VALUES ('Audi', 'Completed'), ('VW', 'Completed'), ('Lamborghini', 'Completed'), ('Cupra', 'DiscoveryFailed'),
  ('Porsche', 'NotImplemented')) t(brand, outcome)""",
}
