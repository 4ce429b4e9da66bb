"""Attributes read out of free text: years, vocabulary words, doors, fuel, headers."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cutline import fixed_values as fv
from cutline.functions.binding import let
from cutline.functions.names import is_blank, trim_ws

# Java's \s, \b and \d only know ASCII; these classes spell the Unicode meaning out.
WS = r"[\s\x85\p{Z}]"
_WORD = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]"
_START = rf"(?<!{_WORD})"
_END = rf"(?!{_WORD})"
YEAR = r"(?:19|20)[0-9]{2}"

# (pattern, group of the first year, group of the last year), tried in this order.
YEAR_RULES = (
    (rf"({YEAR}){WS}*-{WS}*({YEAR})", 1, 2),
    (rf"(?iu)(?:from{WS}+)?Model{WS}+Year{WS}+({YEAR}){WS}+to{WS}+(?:Model{WS}+Year{WS}+)?({YEAR})", 1, 2),
    (rf"(?iu){_START}ab{WS}+({YEAR}){_END}", 1, None),
    (rf"(?iu){_START}bis{WS}+({YEAR}){_END}", None, 1),
    (rf"(?iu)from{WS}+Model{WS}+Year{WS}+({YEAR})", 1, None),
    (rf"({YEAR}){WS}*-", 1, None),
    (rf"({YEAR})", 1, 1),
)

_DOORS = rf"(?iu)([0-9]{{1,2}}){WS}*-?{WS}*(?:d{_END}|T[üu]rer)"
_POWERTRAIN = r"(?iu)\((ICE|HYBRID)\)"
_PARENS = rf"{WS}*\([^)]*\)"
_RESCUE_SHEET = r"(?iu)\A(.*?)(?:[\s\x85\p{Z}_])+RESCUE[\s\x85\p{Z}_]DATA[\s\x85\p{Z}_]SHEET"
_DOC_ID = (
    rf"(?iu)ID{WS}*no\.?{WS}*([A-Z]{{2,4}}{WS}*-{WS}*[0-9]{{1,4}}{WS}*-{WS}*[0-9]{{1,4}}{WS}*-{WS}*[0-9]{{1,4}})"
)
YEAR_OR_RANGE = r"\A(19|20)[0-9]{2}(-(19|20)[0-9]{2})?\z"
BARE_DIGITS = r"\A\p{Nd}+\z"


def _extract(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def year_range(c: Column) -> Column:
    """``struct<from:int,to:int>`` by the first rule that finds something."""
    nothing = F.lit(None).cast("int")
    rules = None
    for pattern, first, last in YEAR_RULES:
        years = F.struct(
            (F.regexp_extract(c, pattern, first).cast("int") if first else nothing).alias("from"),
            (F.regexp_extract(c, pattern, last).cast("int") if last else nothing).alias("to"),
        )
        hit = c.rlike(pattern)
        rules = F.when(hit, years) if rules is None else rules.when(hit, years)
    no_years = F.struct(nothing.alias("from"), nothing.alias("to"))
    # Most texts carry no year at all: one cheap test skips the whole chain.
    return F.when(c.rlike(YEAR), rules).otherwise(no_years)


def last_vocab(c: Column, words: Sequence[str]) -> Column:
    """Last vocabulary word of the text as written there; longer phrases win over their parts."""
    ordered = sorted(words, key=len, reverse=True)
    pattern = "(?iu)" + "|".join(re.escape(w) for w in ordered)
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.lit(-1))


def doors(c: Column) -> Column:
    return _extract(c, _DOORS, 1).cast("int")


def fuel_type(c: Column, words: Sequence[str] = fv.SKODA_FUEL_TYPES, badge: str = fv.SKODA_ELECTRIC_BADGE) -> Column:
    """The later of the last vocabulary word and the case-sensitive electric badge."""
    word = last_vocab(c, words)
    badge_pattern = rf"(?s)\A(.*?){_START}{badge}{_END}"
    badge_at = F.when(c.rlike(badge_pattern), F.length(F.regexp_extract(c, badge_pattern, 1)) + 1)
    word_at = F.length(c) - F.length(word) - F.instr(F.reverse(c), F.reverse(word)) + 2
    return (
        F.when(badge_at.isNull(), word)
        .when(word.isNull() | (badge_at > word_at), F.lit(badge))
        .otherwise(word)
    )


def has_rescue_sheet_name(c: Column) -> Column:
    return c.rlike(_RESCUE_SHEET)


def name_before_sheet(c: Column) -> Column:
    """Model name standing before the words RESCUE DATA SHEET."""
    return trim_ws(F.translate(F.regexp_extract(c, _RESCUE_SHEET, 1), "_", " "))


def strip_parens(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, _PARENS, ""))


def powertrain(c: Column) -> Column:
    return _extract(c, _POWERTRAIN, 1)


def page_doc_id(c: Column) -> Column:
    """Document id printed on a page, blanks removed, upper case; NULL when there is none."""
    return F.upper(F.replace(_extract(c, _DOC_ID, 1), F.lit(" "), F.lit("")))


def header_text(c: Column, marker: str = fv.HEADER_MARKER, window: int = fv.HEADER_WINDOW) -> Column:
    """Up to ``window`` characters after the first marker, trimmed; NULL without the marker."""
    at = F.instr(c, marker)
    return F.when(at > 0, trim_ws(F.substr(c, at + len(marker), F.lit(window))))


def fix_typos(c: Column, typos: Sequence[tuple[str, str]] = fv.KNOWN_TYPOS) -> Column:
    for wrong, right in typos:
        c = F.regexp_replace(c, f"(?iu){re.escape(wrong)}", right)
    return c


def header_model(c: Column) -> Column:
    """Model name of a header: the part before the first comma, slash or parenthesis,
    or the whole header when it starts with one."""
    head = F.regexp_extract(c, r"\A[^,/(]+", 0)
    return fix_typos(trim_ws(F.when(head == "", c).otherwise(head)))


def parse_header(doc_id: Column, header: Column) -> Column:
    """Parsed card attributes of one document group from its header text."""
    none = F.lit(None).cast("string")
    unreadable = is_blank(header)

    def attributes(years: Column) -> Column:
        return F.struct(
            F.when(unreadable, doc_id).otherwise(header_model(header)).alias("model_name"),
            F.when(unreadable, none).otherwise(header).alias("variant"),
            F.when(unreadable, none).otherwise(last_vocab(header, fv.PORSCHE_BODY_TYPES)).alias("body_type"),
            years["from"].alias("build_year_from"),
            years["to"].alias("build_year_to"),
            F.lit(None).cast("int").alias("doors"),
            none.alias("fuel_type"),
            F.lit(fv.ENGLISH).alias("language_code"),
            F.when(unreadable, "Unparsed").otherwise("Heuristic").alias("parse_confidence"),
        )

    return let(year_range(header), attributes)


def brand_and_series(c: Column) -> tuple[Column, Column]:
    """Split ``BRAND SERIES`` at the first blank; no blank leaves the series empty."""
    brand = F.substring_index(c, " ", 1)
    series = F.when(F.instr(c, " ") > 0, trim_ws(F.substr(c, F.instr(c, " ") + 1))).otherwise(F.lit(""))
    return brand, series
