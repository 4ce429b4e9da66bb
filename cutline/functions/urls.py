"""URL resolution and file names of URLs, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cutline.functions.binding import let

_BASE = r"\A([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)"
# Escapes that stay escaped in a readable URL: control characters, %, # and ?.
_ESCAPES = r"(?:%(?![01]|7[Ff]|2[35]|3[Ff])[0-9A-Fa-f]{2})+|%|[^%]+"
_ALL_ESCAPES = r"(?:%[0-9A-Fa-f]{2})+|%|[^%]+"
# Characters that may stand unescaped in a path.
_SAFE = r"!$%&'()*+,\-./0-9:;=@A-Z\[\]_a-z~"
_PATH_SAFE = f"[{_SAFE}]+|[^{_SAFE}]+"
_SAFE_START = rf"\A[{_SAFE}]"
_UNSAFE = f"[^{_SAFE}]"


def _decoded(piece: Column) -> Column:
    """Text of a run of percent escapes, or the run itself when it is no valid text."""
    text = F.try_validate_utf8(F.unhex(F.replace(piece, F.lit("%"), F.lit(""))).cast("string"))
    return F.when(piece.rlike(r"\A%[0-9A-Fa-f]{2}"), F.coalesce(text, piece)).otherwise(piece)


def _unescape(c: Column, pieces: str) -> Column:
    def decode(text: Column) -> Column:
        runs = F.regexp_extract_all(text, F.lit(pieces), F.lit(0))
        return F.when(F.instr(text, "%") > 0, F.array_join(F.transform(runs, _decoded), "")).otherwise(text)

    return let(c, decode)


def safe_unescape(c: Column) -> Column:
    """Percent-decode readable characters; reserved and broken escapes stay as they are."""
    return _unescape(c, _ESCAPES)


def _remove_dot_segments(path: Column) -> Column:
    def step(done: Column, segment: Column) -> Column:
        # The first element is the empty text before the leading slash and never goes away.
        parent = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
        return (
            F.when(segment == ".", done)
            .when(segment == "..", parent)
            .otherwise(F.concat(done, F.array(segment)))
        )

    def remove(text: Column) -> Column:
        kept = F.aggregate(F.split(text, "/"), F.array().cast("array<string>"), step)
        tail = F.when(text.rlike(r"/\.\.?\z"), "/").otherwise("")
        return F.when(text.rlike(r"/\.\.?(/|\z)"), F.concat(F.array_join(kept, "/"), tail)).otherwise(text)

    return let(path, remove)


def _default_port(base: Column) -> Column:
    """Pattern of the port that a scheme has without saying so."""
    scheme = F.lower(F.regexp_extract(base, _BASE, 1))
    return F.when(scheme == "https", r":(?:443)?\z").when(scheme == "http", r":(?:80)?\z").otherwise(r":\z")


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute URL of ``href`` on page ``base``; anything starting with ``http`` is kept verbatim."""
    parts = F.struct(
        F.regexp_extract(base, _BASE, 1).alias("scheme"),
        F.regexp_replace(F.lower(F.regexp_extract(base, _BASE, 2)), _default_port(base), "").alias("host"),
        F.regexp_extract(base, _BASE, 3).alias("path"),
        F.regexp_extract(href, r"\A[^?#]*", 0).alias("target"),
        F.regexp_extract(href, r"[?#].*\z", 0).alias("suffix"),
    )

    def resolve(p: Column) -> Column:
        origin = F.concat(p["scheme"], F.lit("://"), p["host"])
        folder = F.when(p["path"] == "", "/").otherwise(F.regexp_extract(p["path"], r"\A.*/", 0))
        page = F.concat(origin, F.when(p["path"] == "", "/").otherwise(p["path"]))
        query = F.regexp_extract(base, r"\?[^#]*", 0)
        return (
            F.when(href.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*:"), href)
            .when(href.startswith("//"), F.concat(p["scheme"], F.lit(":"), href))
            .when(href.startswith("/"), F.concat(origin, _remove_dot_segments(p["target"]), p["suffix"]))
            .when(href.startswith("?"), F.concat(page, href))
            .when(p["target"] == "", F.concat(page, query, href))
            .otherwise(F.concat(origin, _remove_dot_segments(F.concat(folder, p["target"])), p["suffix"]))
        )

    return F.when(F.lower(href).startswith("http"), href).otherwise(safe_unescape(let(parts, resolve)))


def url_path(url: Column) -> Column:
    """Path of an absolute URL in its escaped form."""

    def escape(piece: Column) -> Column:
        return F.when(piece.rlike(_SAFE_START), piece).otherwise(
            F.regexp_replace(F.hex(F.encode(piece, "UTF-8")), "(..)", "%$1")
        )

    def escaped(raw: Column) -> Column:
        pieces = F.regexp_extract_all(raw, F.lit(_PATH_SAFE), F.lit(0))
        return F.when(raw.rlike(_UNSAFE), F.array_join(F.transform(pieces, escape), "")).otherwise(raw)

    return let(F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), escaped)


def url_file_name(url: Column) -> Column:
    """Last segment of the URL path, still percent-encoded."""
    return F.substring_index(url_path(url), "/", -1)


def url_file_stem(url: Column) -> Column:
    """File name of the URL without extension, fully percent-decoded."""
    return _unescape(F.regexp_replace(url_file_name(url), r"\.[^.]*\z", ""), _ALL_ESCAPES)
