"""Name normalisation, slugs, hashes and card ids as native column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from cutline.functions.binding import let

# A character that is neither a letter nor a decimal digit.  Characters beyond the
# basic plane count as neither: names are compared per UTF-16 unit.
_NOT_ALNUM = r"[^\p{L}\p{Nd}&&[\x{0}-\x{FFFF}]]"
_ASCII_REST = "".join(chr(code) for code in range(0x80) if not chr(code).isalnum())
_PRIVATE_USE = 0xE000


@lru_cache(maxsize=None)
def _accent_fold() -> tuple[str, str]:
    """Every basic-plane character whose canonical decomposition is one base
    character plus non-spacing marks, with that base character.  ASCII characters that
    are no letters or digits follow without a counterpart, which deletes them."""
    source, target = [], []
    for code in range(0xC0, 0x10000):
        if 0xAC00 <= code <= 0xDFFF:
            continue  # Hangul syllables keep their letters; surrogates are no characters
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn")
        if base != char and len(base) == 1:
            source.append(char)
            target.append(base)
    return "".join(source) + _ASCII_REST, "".join(target)


@lru_cache(maxsize=None)
def _unexpanded_upper() -> tuple[str, str]:
    """Letters that upper-casing would change although a per-character invariant
    mapping keeps them (sharp s, ligatures, dotless i), and stand-ins for them.
    The stand-ins are private-use characters, which never survive the letter filter."""
    keep = [
        chr(code)
        for code in range(0xC0, 0xD800)
        if len(chr(code).upper()) > 1 and unicodedata.normalize("NFD", chr(code)) == chr(code)
    ]
    keep += [chr(code) for code in range(0xFB00, 0xFB18) if len(chr(code).upper()) > 1]
    keep.append("ı")
    return "".join(keep), "".join(chr(_PRIVATE_USE + i) for i in range(len(keep)))


def is_blank(c: Column) -> Column:
    """True for NULL, empty and white-space-only text."""
    return ~F.coalesce(c.rlike(r"\P{IsWhite_Space}"), F.lit(False))


def not_blank(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\P{IsWhite_Space}"), F.lit(False))


def trim_ws(c: Column) -> Column:
    """Strip Unicode white space at both ends."""
    return F.regexp_replace(c, r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")


def norm_name(c: Column) -> Column:
    """Matching key of a brand or model name: accents folded, only letters and
    decimal digits kept, upper-cased character by character.

    Most names are plain ASCII and take the short way.
    """
    kept, stand_in = _unexpanded_upper()

    def upper_each(letters: Column) -> Column:
        guarded = F.translate(F.upper(F.translate(letters, kept, stand_in)), stand_in, kept)
        # All kept letters but the dotless i expand, so an unchanged length proves there are none.
        as_long = (F.length(F.upper(letters)) == F.length(letters)) & (F.instr(letters, "ı") == 0)
        return F.when(as_long, F.upper(letters)).otherwise(guarded)

    def normalize(text: Column) -> Column:
        plain = F.upper(F.translate(text, _ASCII_REST, ""))
        folded = F.regexp_replace(F.translate(text, *_accent_fold()), _NOT_ALNUM + "+", "")
        return F.when(F.octet_length(text) == F.length(text), plain).otherwise(let(folded, upper_each))

    return let(c, normalize)


def slug(c: Column) -> Column:
    """File-system-safe lower-case slug; accents stay, blank becomes ``unknown``."""
    dashed = F.regexp_replace(c, _NOT_ALNUM + "+", "-")
    # Dotted capital I keeps its form and sigma has no word-final form in an invariant mapping.
    lowered = F.translate(F.lower(F.translate(dashed, "İΣ", "\ue000σ")), "\ue000", "İ")
    trimmed = F.btrim(lowered, F.lit("-"))
    return F.coalesce(F.nullif(trimmed, F.lit("")), F.lit("unknown"))


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 8)


def card_id(brand: Column, model: Column, year_from: Column, body: Column, lang: Column, label: Column) -> Column:
    """``brand-model[-year][-body][-lang]-hash``; missing parts are left out."""
    return F.concat_ws(
        "-",
        F.lower(brand),
        slug(model),
        year_from.cast("string"),
        F.when(not_blank(body), slug(body)),
        F.when(not_blank(lang), slug(lang)),
        short_hash(label),
    )


def card_path(brand: Column, model: Column, card: Column, status: Column) -> Column:
    """Document path inside the store, only for downloaded cards."""
    return F.when(
        status == "Downloaded",
        F.concat(F.concat_ws("/", F.lower(brand), slug(model), card), F.lit(".pdf")),
    )
