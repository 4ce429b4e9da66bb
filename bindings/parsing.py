"""Ids, file names and free text."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.common import (
    CONFIDENCE, DOORS, DOORS_TOKEN, FILE_NAME, LANG, LANG_TOKEN, MODEL, VARIANT, YEAR_FROM, YEAR_TO, YEAR_TOKEN,
    derive, table,
)
from cutline.functions import names as N
from cutline.functions import text as X
from cutline.functions.filenames import audi_tokens, tokens, with_parsed_name
from cutline.functions.urls import url_file_name
from cutline.operators.cards import only_language, select_brands

# A short name every eleventh row: too few tokens to be positional.
_NAME = f"CASE WHEN p_partkey % 11 = 0 THEN concat('/x/Maker_', replace(p_name, ' ', '_'), '.pdf') ELSE concat('/x/', {FILE_NAME}) END"
_QUIRKY = (
    f"concat('https://cdn.example/a/Maker_', replace(p_name, ' ', '_'), '_', p_type, '_', {YEAR_TOKEN}, '_', {DOORS_TOKEN}, "
    f"'_Hybrid', CASE WHEN p_partkey % 2 = 0 THEN '_(Electric)' ELSE '' END, "
    f"CASE WHEN p_partkey % 6 = 0 THEN '_1_22' WHEN p_partkey % 6 = 3 THEN '_7' ELSE '' END, '_', {LANG_TOKEN}, '.pdf')"
)
_TITLE = (
    "CASE p_partkey % 8 WHEN 0 THEN concat(p_name, ' (', 1950 + p_size, ' - ', 1955 + p_size, ')') "
    "WHEN 1 THEN concat(p_name, ' Model Year ', 1950 + p_size, ' to Model Year ', 1960 + p_size) "
    "WHEN 2 THEN concat(p_name, ' (ab ', 1950 + p_size, ')') WHEN 3 THEN concat('BIS ', 1950 + p_size, ' ', p_name) "
    "WHEN 4 THEN concat(p_name, 'from Model Year ', 1950 + p_size, 'Page 1') "
    "WHEN 5 THEN concat(p_name, ' (', 1950 + p_size, ' - )') WHEN 6 THEN concat(p_name, ' ', 1950 + p_size) "
    "ELSE p_name END"
)
_WORDS = (
    "concat(p_name, CASE p_partkey % 5 WHEN 0 THEN ' SUV Combi' WHEN 1 THEN ' pick up' WHEN 2 THEN ' Sedan x' WHEN 3 THEN ' sedansuv' ELSE '' END, "
    "CASE p_partkey % 4 WHEN 0 THEN concat(' ', 1 + p_size % 9, 'd') WHEN 1 THEN concat(' ', 1 + p_size % 9, '-Türer') "
    "WHEN 2 THEN concat(' ', p_size, ' doors') ELSE ' 4 - TURER' END, "
    "CASE p_partkey % 7 WHEN 0 THEN ' iV' WHEN 1 THEN ' iV PHEV HYBRID' WHEN 2 THEN ' IV' WHEN 3 THEN ' hybrid iV' "
    "WHEN 4 THEN ' MHEV' WHEN 5 THEN ' xiV GD' ELSE '' END)"
)
_HEADER = (
    "CASE p_partkey % 6 WHEN 0 THEN concat('Boxter ', p_name, ', more') WHEN 1 THEN concat(p_name, ' / S (x)') "
    "WHEN 2 THEN concat('(x) ', p_name) WHEN 3 THEN concat(' ', p_name, ' (ICE) (y)') WHEN 4 THEN ' ' ELSE NULL END"
)
_FLAT = ("model_name", "variant", "body_type", "build_year_from", "build_year_to", "doors", "fuel_type",
         "language_code", "parse_confidence")


def card_ids(spark, sf):
    part = derive(
        table(spark, sf, "part"), p_partkey="p_partkey", brand="p_brand",
        model="CASE WHEN p_partkey % 50 = 0 THEN NULL WHEN p_partkey % 51 = 0 THEN '--' ELSE concat(p_name, ' É.', p_size, '!') END",
        year="CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 1950 + p_size END",
        body="CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE p_type END", lang="CASE WHEN p_partkey % 5 > 0 THEN 'DE' END",
        label="concat(p_name, '|', p_partkey)",
    )
    identity = N.card_id(*[F.col(c) for c in ("brand", "model", "year", "body", "lang", "label")])
    return part.select(
        "p_partkey", identity.alias("id"), N.slug(F.col("model")).alias("model_slug"),
        N.card_path(F.col("brand"), F.col("model"), F.lit("x"), F.when(F.col("p_partkey") % 2 == 0, "Downloaded")).alias("path"),
    )


def _parsed(spark, sf, name, tokenizer):
    df = derive(table(spark, sf, "part"), p_partkey="p_partkey", name=name)
    return with_parsed_name(df, "name", tokenizer).select("p_partkey", *[F.col(f"parsed.{c}").alias(c) for c in _FLAT])


def parse_names(spark, sf):
    return _parsed(spark, sf, _NAME, tokens)


def parse_quirky_names(spark, sf):
    return _parsed(spark, sf, _QUIRKY, audi_tokens)


def german_names(spark, sf):
    """Language filter and raw labels of the names that stay."""
    df = derive(table(spark, sf, "part"), p_partkey="p_partkey", url=_QUIRKY)
    kept = only_language(with_parsed_name(df, "url", audi_tokens), "de")
    return kept.select("p_partkey", url_file_name(F.col("url")).alias("raw_label"))


def year_ranges(spark, sf):
    df = derive(table(spark, sf, "part"), p_partkey="p_partkey", title=_TITLE)
    years = df.select("p_partkey", X.year_range(F.col("title")).alias("y"))
    return years.select("p_partkey", F.col("y.from").alias("year_from"), F.col("y.to").alias("year_to"))


def year_ranges_of_documents(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", X.year_range(F.col("text")).alias("y"))
    return df.select("doc_id", F.col("y.from").alias("year_from"), F.col("y.to").alias("year_to"))


def attributes(spark, sf):
    df = derive(table(spark, sf, "part"), p_partkey="p_partkey", title=_WORDS)
    t = F.col("title")
    return df.select(
        "p_partkey",
        X.last_vocab(t, ("Combi", "Sedan", "Pick Up", "SUV")).alias("body_type"),
        X.doors(t).alias("doors"),
        X.fuel_type(t).alias("fuel_type"),
    )


def vocabulary_of_documents(spark, sf):
    """Last hit of a word list in whole texts."""
    words = ("the", "le", "der", "el", "the license", "por")
    return table(spark, sf, "documents").select("doc_id", X.last_vocab(F.col("text"), words).alias("last_word"))


def headers(spark, sf):
    df = derive(table(spark, sf, "part"), p_partkey="p_partkey", doc_id="concat('ID-', p_partkey)", header=_HEADER)
    parsed = df.select("p_partkey", X.parse_header(F.col("doc_id"), F.col("header")).alias("p"), "header")
    return parsed.select(
        "p_partkey", "p.model_name", "p.variant", "p.parse_confidence",
        X.strip_parens(F.col("header")).alias("without_parens"), X.powertrain(F.col("header")).alias("powertrain"),
    )


def header_windows(spark, sf):
    """Header window after the first sentence end, over whole texts."""
    return table(spark, sf, "documents").select("doc_id", F.md5(X.header_text(F.col("text"), ". ", 200)).alias("header_hash"))


def brand_series(spark, sf):
    series = derive(table(spark, sf, "part"), p_partkey="p_partkey", s="CASE WHEN p_partkey % 9 = 0 THEN p_type ELSE concat(p_type, ' ', p_name, ' ') END")
    brand, model = X.brand_and_series(F.col("s"))
    return series.select("p_partkey", brand.alias("brand_label"), model.alias("model_series"))


def chosen_brands(spark, sf):
    """Brand selection and blank test, both ahead of any other work."""
    df = derive(table(spark, sf, "part"), p_partkey="p_partkey", brand="p_brand", name="CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE p_name END")
    return select_brands(df, ("Brand#1", "Brand#7")).where(N.not_blank(F.col("name")))


QUERIES = {
    "card_id": card_ids,
    "parse_filename": parse_names,
    "parse_filename_quirks": parse_quirky_names,
    "only_language_raw_label": german_names,
    "year_range": year_ranges,
    "year_range_documents": year_ranges_of_documents,
    "vocabulary_doors_fuel": attributes,
    "last_vocab_documents": vocabulary_of_documents,
    "parse_header": headers,
    "header_window_documents": header_windows,
    "split_brand_series": brand_series,
    "select_brands_not_blank": chosen_brands,
}

_SHORT = "p_partkey % 11 = 0"


def _unless_short(sql: str) -> str:
    return f"CASE WHEN {_SHORT} THEN NULL ELSE {sql} END"


_Y = "((?:19|20)[0-9]{2})"
_YEARS = (
    (f"{_Y}\\s*-\\s*{_Y}", 1, 2),
    (f"(?i)(?:from\\s+)?model\\s+year\\s+{_Y}\\s+to\\s+(?:model\\s+year\\s+)?{_Y}", 1, 2),
    (f"(?i)\\bab\\s+{_Y}\\b", 1, 0),
    (f"(?i)\\bbis\\s+{_Y}\\b", 0, 1),
    (f"(?i)from\\s+model\\s+year\\s+{_Y}", 1, 0),
    (f"{_Y}\\s*-", 1, 0),
    (_Y, 1, 1),
)


def _year_sql(c: str, side: int) -> str:
    cases = " ".join(
        f"WHEN regexp_matches({c}, '{p}') THEN "
        + (f"CAST(regexp_extract({c}, '{p}', {g[side]}) AS INTEGER)" if g[side] else "NULL")
        for p, *g in _YEARS
    )
    return f"CASE {cases} END"


ORACLE = {
    "card_id": """
SELECT p_partkey, lower(p_brand) || '-' || model_slug || coalesce('-' || year, '') || coalesce('-' || body, '') || coalesce('-' || lang, '')
  || '-' || substr(sha256(p_name || '|' || p_partkey), 1, 8) AS id, model_slug,
  CASE WHEN p_partkey % 2 = 0 THEN lower(p_brand) || '/' || model_slug || '/x.pdf' END AS path
FROM (SELECT *, CASE WHEN p_partkey % 50 = 0 OR p_partkey % 51 = 0 THEN 'unknown' ELSE replace(p_name, ' ', '-') || '-é-' || p_size END AS model_slug,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 1950 + p_size END AS year, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE lower(p_type) END AS body,
  CASE WHEN p_partkey % 5 > 0 THEN 'de' END AS lang FROM part)""",
    "parse_filename": f"""
SELECT p_partkey, {MODEL} AS model_name, {_unless_short(VARIANT)} AS variant, {_unless_short('p_type')} AS body_type,
  {_unless_short(YEAR_FROM)} AS build_year_from, {_unless_short(YEAR_TO)} AS build_year_to, {_unless_short(DOORS)} AS doors,
  {_unless_short("'GD'")} AS fuel_type, {_unless_short(LANG)} AS language_code,
  CASE WHEN {_SHORT} THEN 'Unparsed' ELSE {CONFIDENCE} END AS parse_confidence FROM part""",
    "parse_filename_quirks": f"""
SELECT p_partkey, {MODEL} AS model_name, {VARIANT} AS variant, p_type AS body_type, {YEAR_FROM} AS build_year_from,
  {YEAR_TO} AS build_year_to, {DOORS} AS doors, CASE WHEN p_partkey % 2 = 0 THEN 'Hybrid (Electric)' ELSE 'Hybrid' END AS fuel_type,
  {LANG} AS language_code, {CONFIDENCE} AS parse_confidence FROM part""",
    "only_language_raw_label": f"""
SELECT p_partkey, regexp_extract({_QUIRKY}, '[^/]*$') AS raw_label FROM part WHERE p_partkey % 3 = 0""",
    "year_range": """
SELECT p_partkey, CAST(CASE WHEN p_partkey % 8 IN (3, 7) THEN NULL ELSE 1950 + p_size END AS INTEGER) AS year_from,
  CAST(CASE p_partkey % 8 WHEN 0 THEN 1955 + p_size WHEN 1 THEN 1960 + p_size WHEN 3 THEN 1950 + p_size WHEN 6 THEN 1950 + p_size END AS INTEGER) AS year_to
FROM part""",
    "year_range_documents": f"SELECT doc_id, {_year_sql('text', 0)} AS year_from, {_year_sql('text', 1)} AS year_to FROM documents",
    "vocabulary_doors_fuel": """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Combi' WHEN 1 THEN 'pick up' WHEN 2 THEN 'Sedan' WHEN 3 THEN 'suv' END AS body_type,
  CAST(CASE p_partkey % 4 WHEN 0 THEN 1 + p_size % 9 WHEN 1 THEN 1 + p_size % 9 WHEN 3 THEN 4 END AS INTEGER) AS doors,
  CASE p_partkey % 7 WHEN 0 THEN 'iV' WHEN 1 THEN 'PHEV HYBRID' WHEN 3 THEN 'iV' WHEN 4 THEN 'MHEV' WHEN 5 THEN 'GD' END AS fuel_type
FROM part""",
    "last_vocab_documents": """
SELECT doc_id, regexp_extract_all(text, '(?i)the license|the|der|por|le|el')[-1] AS last_word FROM documents""",
    "parse_header": """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Boxster ' || p_name WHEN 1 THEN p_name WHEN 2 THEN '(x) ' || p_name WHEN 3 THEN p_name
    ELSE 'ID-' || p_partkey END AS model_name,
  CASE p_partkey % 6 WHEN 0 THEN 'Boxter ' || p_name || ', more' WHEN 1 THEN p_name || ' / S (x)' WHEN 2 THEN '(x) ' || p_name
    WHEN 3 THEN ' ' || p_name || ' (ICE) (y)' END AS variant,
  CASE WHEN p_partkey % 6 < 4 THEN 'Heuristic' ELSE 'Unparsed' END AS parse_confidence,
  CASE p_partkey % 6 WHEN 0 THEN 'Boxter ' || p_name || ', more' WHEN 1 THEN p_name || ' / S' WHEN 2 THEN p_name WHEN 3 THEN p_name WHEN 4 THEN '' END AS without_parens,
  CASE WHEN p_partkey % 6 = 3 THEN 'ICE' END AS powertrain
FROM part""",
    "header_window_documents": """
SELECT doc_id, CASE WHEN strpos(text, '. ') > 0 THEN md5(regexp_replace(substr(text, strpos(text, '. ') + 2, 200), '^\\s+|\\s+$', '', 'g')) END AS header_hash
FROM documents""",
    "split_brand_series": """
SELECT p_partkey, p_type AS brand_label, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_name END AS model_series FROM part""",
    "select_brands_not_blank": """
SELECT p_partkey, p_brand AS brand, p_name AS name FROM part WHERE p_brand IN ('Brand#1', 'Brand#7') AND p_partkey % 4 <> 0""",
}
