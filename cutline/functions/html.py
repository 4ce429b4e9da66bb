"""Reading landed HTML with column expressions.

No document tree is built: markup is cut at the tags of interest and attributes
are read from single tags.  All patterns use possessive quantifiers, so their
work stays linear in the text and they need no deep recursion on long attributes.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from cutline.functions.binding import let
from cutline.functions.names import trim_ws

_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>]++)"""
_TAG_REST = r"""(?:"[^"]*+"|'[^']*+'|[^'">]++)*+>"""
_RAW_TEXT = (
    r"<!--(?:[^-]++|-(?!->))*+(?:-->|\z)"
    rf"|<(script|style|textarea|title|template|noscript)(?=[\s/>]){_TAG_REST}(?:[^<]++|<(?!/\1[\s/>]))*+(?:</\1[^>]*+>|\z)"
)
# A tag or a quote that never ends takes the rest of the text, so no character is tried twice.
_OPEN_END = r"""(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^'">]++)*+(?:>|\z)"""
_TOKEN = rf"(?is){_RAW_TEXT}|<[a-z]{_OPEN_END}|[^<]++|<"
# What every comment and element of raw or plain text begins with.
_MAY_BE_RAW = r"(?i)\A<[!nst]"
_IS_PLAIN_TEXT = r"(?is)\A<(?:title|textarea)[\s/>]"
_IS_RAW_TEXT = rf"(?is)\A(?:{_RAW_TEXT})"
_FREQUENT = (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"))
_OTHER_REFERENCE = r"&(?!amp;)[#A-Za-z]"
# Without its semicolon a reference counts where no letter, digit or equals sign follows, as in attributes.
_ENTITY = r"&#[0-9]++;?|&#[xX][0-9A-Fa-f]++;?|&[A-Za-z][A-Za-z0-9]*+(?:;|(?!=))|&|[^&]+"


@lru_cache(maxsize=None)
def _named_entities() -> str:
    """``name<TAB>character`` lines; one short literal keeps plans small."""
    # A line feed and a tab are the map's own separators.
    named = {name: text for name, text in html5.items() if text not in "\n\t"}
    return "\n".join(f"&{name}\t{text}" for name, text in sorted(named.items()))


@lru_cache(maxsize=None)
def _windows_controls() -> tuple[str, str]:
    """References to C1 control codes mean the Windows-1252 character of that byte."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    pairs = [(control, char) for control, char in pairs if char]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def decode_entities(c: Column) -> Column:
    """Replace character references; text without an ampersand passes untouched."""
    named = F.str_to_map(F.lit(_named_entities()), F.lit("\n"), F.lit("\t"))

    def char_of(code: Column) -> Column:
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(valid, F.translate(char, *_windows_controls())).otherwise("\ufffd")

    def decode(piece: Column) -> Column:
        decimal = F.regexp_extract(piece, r"\A&#0*+([0-9]++)", 1)
        hexed = F.regexp_extract(piece, r"\A&#[xX]0*+([0-9A-Fa-f]++)", 1)
        return (
            F.when(~piece.startswith("&"), piece)
            .when(piece.rlike(r"\A&(?i:newline|tab);\z"), F.when(piece.rlike("(?i)tab"), "\t").otherwise("\n"))
            .when(piece.rlike(r"\A&#[xX]?0++;?\z"), "\ufffd")
            .when(decimal != "", char_of(decimal.try_cast("long")))
            .when(hexed != "", char_of(F.when(F.length(hexed) <= 8, F.conv(hexed, 16, 10).try_cast("long"))))
            .otherwise(F.coalesce(F.try_element_at(named, piece), piece))
        )

    def decode_rest(text: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0))
        every = F.array_join(F.transform(pieces, decode), "")
        return F.when(text.rlike(_OTHER_REFERENCE), every).otherwise(F.replace(text, F.lit("&amp;"), F.lit("&")))

    def decode_text(text: Column) -> Column:
        # Frequent references first: none of them yields an ampersand, so no reference can form anew.
        rest = text
        for reference, char in _FREQUENT:
            rest = F.replace(rest, F.lit(reference), F.lit(char))
        return F.when(F.instr(text, "&") > 0, let(rest, decode_rest)).otherwise(text)

    return let(c, decode_text)


def visible_markup(html: Column) -> Column:
    """Markup in which every ``<`` before a letter opens a tag.

    Comments, scripts, styles and templates are left out, closed or not; a ``<`` inside a quoted attribute value or a
    title becomes a reference.  One pass over the text.
    """

    def plain(token: Column) -> Column:
        inside = F.concat(F.lit("<"), F.replace(F.substr(token, F.lit(2)), F.lit("<"), F.lit("&lt;")))
        text_only = F.regexp_replace(token, r"(?is)(?!\A)<(?!/(?:title|textarea)\b)", "&lt;")
        markup = F.when(F.instr(F.substr(token, F.lit(2)), "<") > 0, inside).otherwise(token)
        special = F.when(token.rlike(_IS_PLAIN_TEXT), text_only).when(token.rlike(_IS_RAW_TEXT), "").otherwise(markup)
        return F.when(token.rlike(_MAY_BE_RAW), special).otherwise(markup)

    tokens = F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0))
    return F.array_join(F.transform(tokens, plain), "")


def attribute(tag: Column, name: str) -> Column:
    """Decoded value of an attribute of an opening tag, NULL when it is absent."""
    wanted, value = re.escape(name), _VALUE
    pattern = (
        rf"(?is)\A<[a-z][^\s/>]*+(?:[\s/]++(?!{wanted}[\s=/>])[^\s=>/]++(?:\s*+=\s*+{value})?+)*+"
        rf"[\s/]++{wanted}\s*+=\s*+({value})"
    )

    def unquote(raw: Column) -> Column:
        return F.when(raw != "", decode_entities(F.regexp_replace(raw, r"""\A["']|["']\z""", "")))

    return let(F.regexp_extract(tag, pattern, 1), unquote)


def has_class(tag: Column, css_class: str) -> Column:
    classes = F.split(F.coalesce(attribute(tag, "class"), F.lit("")), r"\s+")
    return F.array_contains(classes, css_class)


def text_content(markup: Column) -> Column:
    """Text of a markup fragment: tags dropped, entities decoded."""
    return decode_entities(F.regexp_replace(markup, rf"</?[A-Za-z!]{_TAG_REST}", ""))


def opening_tags(html: Column, element: str) -> Column:
    """All opening tags of an element, in document order."""
    return F.regexp_extract_all(visible_markup(html), F.lit(rf"(?is)<{element}(?=[\s/>]){_TAG_REST}"), F.lit(0))


def pieces_from(markup: Column, start: str) -> Column:
    """Cut markup before every match of ``start``, which begins with ``<``; what stands before the first one is dropped.

    Extracting keeps its compiled pattern, ``split`` compiles it anew for every value.
    """
    return F.regexp_extract_all(markup, F.lit(rf"(?is)(?={start})<(?:[^<]++|(?!{start})<)*+"), F.lit(0))


def _tag_with_class(css_class: str) -> str:
    """Pattern of the start of an opening tag that carries a class, quoted or not, after any other attributes."""
    name = re.escape(css_class)
    quoted = "|".join(rf"{q}(?:[^{q}]*\s)?{name}(?:\s[^{q}]*)?{q}" for q in "\"'")
    return (
        rf"<[a-z][^\s/>]*+(?:[\s/]++(?!class[\s=/>])[^\s=>/]++(?:\s*+=\s*+{_VALUE})?+)*+"
        rf"[\s/]++class\s*+=\s*+(?:{quoted}|{name}(?=[\s>]))"
    )


def element_pieces(markup: Column, css_class: str) -> Column:
    """Markup of every element with a class, whatever its name, from its opening tag to before its closing one."""
    return F.transform(pieces_from(markup, _tag_with_class(css_class)), _first_element)


def _first_element(piece: Column) -> Column:
    """The leading element of a piece of markup without its closing tag, found by counting nested tags of its name."""

    def upto_close(name: Column) -> Column:
        tag = F.concat(F.lit(r"</?\Q"), name, F.lit(r"\E[\s/>]"))
        step = F.concat(F.lit("(?is)(?="), tag, F.lit(")<(?:[^<]++|(?!"), tag, F.lit(")<)*+"))
        steps = F.regexp_extract_all(piece, step, F.lit(0))
        depth_step = F.transform(steps, lambda s: F.when(s.startswith("</"), -1).otherwise(1))
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("kept"), F.lit(False).alias("closed"))

        def count(acc: Column, step: Column) -> Column:
            depth = acc["depth"] + step
            return F.when(acc["closed"], acc).otherwise(
                F.struct(
                    depth.alias("depth"),
                    (acc["kept"] + F.when(depth > 0, 1).otherwise(0)).alias("kept"),
                    (depth <= 0).alias("closed"),
                )
            )

        kept = F.aggregate(depth_step, start, count, lambda acc: acc["kept"])
        return F.array_join(F.slice(steps, F.lit(1), F.greatest(kept, F.lit(1))), "")

    return let(F.regexp_extract(piece, r"(?is)\A<([a-z][^\s/>]*+)", 1), upto_close)


ANCHOR = r"<a(?=[\s/>])"


def anchor_tag(piece: Column) -> Column:
    """Opening tag of a piece of markup that starts with an anchor."""
    return F.regexp_extract(piece, rf"(?is)\A{ANCHOR}{_TAG_REST}", 0)


def anchor_inner(piece: Column, tag: Column) -> Column:
    """Content of an anchor: up to its closing tag or, left open, up to the next anchor."""
    return F.regexp_replace(F.substr(piece, F.length(tag) + 1), r"(?is)</a\b.*", "")


def anchors(markup: Column) -> Column:
    """``array<struct<href, inner>>`` of all anchors, in document order."""

    def describe(piece: Column) -> Column:
        return let(
            anchor_tag(piece),
            lambda tag: F.struct(attribute(tag, "href").alias("href"), anchor_inner(piece, tag).alias("inner")),
        )

    return F.transform(pieces_from(markup, ANCHOR), describe)


def anchor_text(inner: Column) -> Column:
    return trim_ws(text_content(inner))


# Content of a leading element without another of its name inside, and the start of its closing tag.
_SIMPLE_CONTENT = rf"(?is)\A<([a-z][^\s/>]*+){_TAG_REST}((?:[^<]++|<(?!/?\1[\s/>]))*+</)\1[\s/>]"


def labelled_text(markup: Column, css_class: str) -> Column:
    """Trimmed text of the first element carrying a class, NULL when there is none."""

    def content(piece: Column) -> Column:
        nested = F.regexp_replace(_first_element(piece), rf"(?is)\A<[a-z]{_TAG_REST}", "")
        return let(
            F.regexp_extract(piece, _SIMPLE_CONTENT, 2),
            lambda simple: F.when(simple != "", F.substr(simple, F.lit(1), F.length(simple) - 2)).otherwise(nested),
        )

    first = F.try_element_at(pieces_from(markup, _tag_with_class(css_class)), F.lit(1))
    return let(first, lambda piece: F.when(piece.isNotNull(), trim_ws(text_content(content(piece)))))
