"""Positional file-name convention:
``Maker_Model[_Variant...]_Body_Year[-Year]_Doors_Fuel_Language.pdf``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.functions.binding import bind
from cutline.functions.text import WS, YEAR

_MIN_TOKENS = 7
_YEARS = rf"\A({YEAR})(?:-({YEAR}))?\z"
_DOORS = r"(?i)\A([0-9]{1,2})d\z"
_LANGUAGE = r"\A[A-Za-z]{2}\z"


def file_stem(c: Column) -> Column:
    """Last path segment (either slash) without its last extension."""
    name = F.substring_index(F.translate(c, "\\", "/"), "/", -1)
    return F.regexp_replace(name, r"\.[^.]*\z", "")


def tokens(c: Column) -> Column:
    """Underscore-separated parts of a file name, trimmed, empty ones dropped."""
    return _split_tokens(file_stem(c))


def audi_tokens(c: Column) -> Column:
    """Tokens after two repairs: a fully parenthesised token belongs to the one before
    it, and all-digit tokens directly before the last one are dropped."""
    joined = F.array_join(tokens(c), "_")
    folded = F.regexp_replace(joined, r"_(\([^_\n]*\))(?=_|\z)", " $1")
    stripped = F.regexp_replace(folded, r"(?:(?:\A|_)\p{Nd}+)+(_[^_]+)\z", "$1")
    return _split_tokens(stripped)


def _split_tokens(c: Column) -> Column:
    # One pass removes white space around separators and at both ends.
    trimmed = F.regexp_replace(c, rf"{WS}*_{WS}*|\A{WS}+|{WS}+\z", "_")
    return F.array_remove(F.split(trimmed, "_"), "")


def parse_tokens(t: Column) -> Column:
    """Parsed attributes of a token array, counted from the right.

    Pass a materialised column: it is referenced once per attribute.
    """
    enough = F.size(t) >= _MIN_TOKENS

    def from_right(k: int) -> Column:
        return F.when(enough, F.try_element_at(t, F.lit(-k)))

    def grab(c: Column, pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).cast("int")

    year_token, doors_token, language = from_right(4), from_right(3), from_right(1)
    year_from, year_to = grab(year_token, _YEARS, 1), grab(year_token, _YEARS, 2)
    door_count = grab(doors_token, _DOORS, 1)
    known_language = language.rlike(_LANGUAGE)
    confidence = (
        F.when(year_from.isNull() & door_count.isNull(), "Unparsed")
        .when(year_from.isNotNull() & door_count.isNotNull() & known_language, "High")
        .otherwise("Heuristic")
    )
    # Model and variant sit between the maker and the body type.
    variant = F.when(
        F.size(t) > _MIN_TOKENS, F.array_join(F.slice(t, F.lit(3), F.greatest(F.size(t) - _MIN_TOKENS, F.lit(0))), " ")
    )
    return F.struct(
        F.try_element_at(t, F.lit(2)).alias("model_name"),
        variant.alias("variant"),
        from_right(5).alias("body_type"),
        year_from.alias("build_year_from"),
        year_to.alias("build_year_to"),
        door_count.alias("doors"),
        from_right(2).alias("fuel_type"),
        F.when(known_language, F.upper(language)).alias("language_code"),
        confidence.alias("parse_confidence"),
    )


def with_parsed_name(df: DataFrame, name_col: str, tokenizer=tokens, out: str = "parsed") -> DataFrame:
    """Add the parsed struct; the token array is computed once per row."""
    return bind(df, _tokens=tokenizer(F.col(name_col))).withColumn(out, parse_tokens(F.col("_tokens"))).drop("_tokens")
