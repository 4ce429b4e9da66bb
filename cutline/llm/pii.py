"""Personal data found through disguises, with spans in the original text.

Two passes of the same detectors.  The first reads the text as it is; its finds are the base.  The
second reads a normalised text, made by a chain of transducers.  Each transducer rewrites a piece of
its input and hands on, for every character it writes, the range of source characters it stands for:

1. characters: look-alike letters of other alphabets, full-width and mathematical forms become ASCII,
   invisible characters vanish;
2. words: spelled digits ("four two seven", in the corpus's languages) become digits, and the
   separators between them go;
3. disguises: "(at)", "[dot]", " at ... dot " between address-like parts become "@" and ".".

A find in the normalised text maps back through the ranges to a span of source characters.  It is
added unless it overlaps a base find: base finds always stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cutline.llm.common import slices, text_bytes, vacate

KINDS = ("email", "ip", "card", "phone")

#: (kind, start, end) in code points, end exclusive.
Find = tuple[str, int, int]

# Each pattern reads every character a bounded number of times, however long its runs are.
_BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_AFTER_AT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + at % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Find]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        after = _AFTER_AT.match(text, at + 1) if start < at else None
        if after:
            done = after.end()
            yield "email", start, done
        else:
            done = at + 1
        at = text.find("@", done)


def detect(text: str) -> list[Find]:
    """Leftmost finds of each kind that do not overlap, by start, then kind; failing matches are dropped."""
    finds = list(_emails(text)) if "@" in text else []
    for match in _IP.finditer(text):
        if all(int(part.lstrip("0")[:4] or "0") <= 255 for part in match[0].split(".")):
            finds.append(("ip", *match.span()))
    for match in _CARD.finditer(text):
        digits = _digits(match[0]) if match.end() - match.start() <= 37 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            finds.append(("card", *match.span()))
    for match in _PHONE.finditer(text):
        if 10 <= len(_digits(match[0])) <= 15:
            finds.append(("phone", *match.span()))
    return sorted(finds, key=lambda f: (f[1], KINDS.index(f[0])))


# Letters of other alphabets that look like ASCII ones.
_LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "һ": "h", "Ѕ": "S", "І": "I", "Ј": "J", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H",
    "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "α": "a",
    "ν": "v", "ι": "i", "ρ": "p", "ɡ": "g", "ı": "i", "ɑ": "a", "\u2219": ".", "\u2024": ".", "\u2010": "-", "\u2011": "-",
    "\u2012": "-", "\u2013": "-", "\u2212": "-", "\u00a0": " ", "\u2007": " ", "\u2009": " ", "\u202f": " ", "\u3000": " ",
}
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"

# The digits' names.
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8",
    "nueve": "9",
}
_PLUS_WORDS = {"plus": "+", "más": "+"}


class Tape:
    """A text, and for each of its characters the source range [start, end) it stands for."""

    __slots__ = ("ends", "starts", "text")

    def __init__(self, text: str, starts: list[int] | range, ends: list[int] | range):
        self.text, self.starts, self.ends = text, starts, ends

    @classmethod
    def of(cls, text: str) -> Tape:
        return cls(text, range(len(text)), range(1, len(text) + 1))

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Tape:
        """``edits``: (start, end, replacement), ascending and disjoint; a replacement stands for all it replaces."""
        if not edits:
            return self
        text, starts, ends, at = [], [], [], 0
        for start, end, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:start])
            starts.extend(self.starts[at:start])
            ends.extend(self.ends[at:start])
            text.append(new)
            starts.extend([self.starts[start]] * len(new) if new else ())
            ends.extend([self.ends[end - 1]] * len(new) if new else ())
            at = end
        return Tape("".join(text), starts, ends)

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


# Compatibility forms of ASCII characters: full-width, mathematical, circled, super- and subscript.
_FORMS = re.compile("[²³¹⁰-⁹₀-₉①-⑨⓪！-～\U0001d400-\U0001d7ff]")
_ODD = re.compile(f"[{''.join(map(re.escape, _LOOKALIKES))}{_INVISIBLE}]|{_FORMS.pattern}")


def _plain(char: str) -> str:
    if char in _INVISIBLE:
        return ""
    return _LOOKALIKES.get(char) or unicodedata.normalize("NFKC", char)


def characters(tape: Tape) -> Tape:
    """Look-alikes and compatibility forms to ASCII, invisible characters away."""
    return tape.rewritten([(m.start(), m.end(), _plain(m[0])) for m in _ODD.finditer(tape.text)])


_NAMES = "|".join(sorted([*_DIGIT_WORDS, *_PLUS_WORDS], key=len, reverse=True))
_GAP = r"[ \t\n.,;:/()-]{1,3}"
# Three names or more (digits may stand between them): fewer are ordinary prose.
_SPELLED = re.compile(
    rf"(?<!\w)(?:\+|(?:{'|'.join(_PLUS_WORDS)}){_GAP})?(?:[0-9]{{1,4}}{_GAP})?(?:{_NAMES})"
    rf"(?:{_GAP}(?:{_NAMES}|[0-9]{{1,4}}))*{_GAP}(?:{_NAMES})(?!\w)",
    re.IGNORECASE,
)
_SPELLED_PART = re.compile(rf"\+|[0-9]+|{_NAMES}", re.IGNORECASE)
_LEAST_NAMES = 3
_DOT_NAMES = re.compile(r"\b(?:dot|point|punkt|punto)\b", re.IGNORECASE)
_SPELLED_HINT = re.compile(rf"(?<!\w)(?:{_NAMES}){_GAP}(?:{_NAMES})(?!\w)", re.IGNORECASE)


def spelled_digits(tape: Tape) -> Tape:
    """Runs of digit names to digits, without what separates them; each digit stands for its name."""
    if not _SPELLED_HINT.search(tape.text):
        return tape
    edits = []
    for run in _SPELLED.finditer(tape.text):
        parts = list(_SPELLED_PART.finditer(tape.text, run.start(), run.end()))
        if sum(p[0].lower() in _DIGIT_WORDS for p in parts) < _LEAST_NAMES:
            continue
        at = run.start()
        for part in parts:
            if part.start() > at:
                edits.append((at, part.start(), ""))
            name = part[0].lower()
            edits.append((*part.span(), _DIGIT_WORDS.get(name) or _PLUS_WORDS.get(name) or name))
            at = part.end()
    return tape.rewritten(edits)


_AT = r"\s{0,3}(?:[\[({<]\s{0,2}(?:at|@|arroba|arobase)\s{0,2}[\])}>])\s{0,3}"
_DOT = r"\s{0,3}(?:[\[({<]\s{0,2}(?:dot|\.|point|punkt|punto)\s{0,2}[\])}>])\s{0,3}"
_BARE_AT = r"\s{1,3}(?:at|@|arroba|arobase)\s{1,3}"
_BARE_DOT = r"\s{1,3}(?:dot|point|punkt|punto)\s{1,3}"
_MARK_AT = re.compile(_AT, re.IGNORECASE)
# A domain after an at-sign of any form; bare words count only if a dot word follows, too.
_LABEL = r"[A-Za-z0-9-]{1,63}"
_TAIL = re.compile(rf"({_LABEL})((?:(?:{_DOT}|{_BARE_DOT}|\.){_LABEL})+)", re.IGNORECASE)
_ANY_DOT = re.compile(rf"{_DOT}|{_BARE_DOT}", re.IGNORECASE)
_ANY_AT = re.compile(rf"(?<=[A-Za-z0-9_%+-])(?:{_AT}|{_BARE_AT}|\s{{0,3}}@\s{{0,3}})(?=[A-Za-z0-9])", re.IGNORECASE)
_HINT = re.compile(r"@|(?<![A-Za-z])(?:at|arroba|arobase)(?![A-Za-z])", re.IGNORECASE)
_NAME_PART = r"[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+"
#: Names with written-out dots, whole: each starts behind what is no character of a name.
_DOTTED_NAME = re.compile(rf"(?<![A-Za-z0-9_%+.-]){_NAME_PART}(?:{_DOT}{_NAME_PART})+", re.IGNORECASE)
_MARK_DOT = re.compile(_DOT, re.IGNORECASE)
#: A name that is hardly a word of prose: letters first, then a dot, an underscore, a plus or a digit inside.
_ADDRESS_NAME = re.compile(r"(?<![A-Za-z0-9_%+.-])[A-Za-z]++[0-9A-Za-z%-]*[0-9._+][A-Za-z0-9._%+-]*\Z")
#: Ends of domains that count after a bare word or a spaced sign; two letters are a country's.
_SUFFIX = re.compile(r"\.(?:com|org|net|edu|gov|mil|int|info|biz|name|app|dev|[a-z]{2})\Z", re.IGNORECASE)
_NAME_CHARACTER = re.compile(r"[A-Za-z0-9_%+.-]")


def _name_before(text: str, end: int, least: int) -> str:
    """The characters of a name that end at ``end``, from ``least`` on."""
    start = end
    while start > least and _NAME_CHARACTER.match(text, start - 1):
        start -= 1
    return text[start:end]


def _counts(at: str, name: str, domain: str, dotted: bool) -> bool:
    """Whether an at of this form between a name and a domain makes an address; ``dotted``: a dot is written out, too."""
    sign = at.strip()
    if dotted or sign == at == "@" or not (sign == "@" or sign.isalpha()):
        return True
    return _SUFFIX.search(domain) is not None and (sign == "@" or _ADDRESS_NAME.search(name) is not None)


def disguises(tape: Tape) -> Tape:
    """Written-out at and dot of mail addresses to the characters.

    A bracketed form counts wherever a domain follows.  The bare word " at " counts where " dot " stands, too, as in
    "name at host dot org", or where the name looks like one of an address and the domain ends in a common way, as in
    "first.last at host.org"; a sign between spaces where the domain ends in a common way.
    """
    text = tape.text
    if not _HINT.search(text):
        return tape
    edits, done, names = [], 0, None
    for at in _ANY_AT.finditer(text):
        if at.start() < done or (tail := _TAIL.match(text, at.end())) is None:
            continue
        dots = list(_ANY_DOT.finditer(text, tail.start(2), tail.end(2)))
        name = "" if dots else _name_before(text, at.start(), done)
        if not _counts(at[0], name, tail[0], bool(dots)):
            continue
        if names is None:
            names = {m.end(): m.start() for m in _DOTTED_NAME.finditer(text)}
        start = max(names.get(at.start(), at.start()), done)
        edits += [(*d.span(), ".") for d in _MARK_DOT.finditer(text, start, at.start())]
        edits.append((*at.span(), "@"))
        edits += [(*d.span(), ".") for d in dots]
        done = tail.end()
    return tape.rewritten(edits)


#: A bare-word dot that ends up between digits: spelled network addresses.
_DIGIT_DOT = re.compile(r"(?<=[0-9])(?:\s{0,2}[\[({]\s?(?:dot|\.|point|punkt|punto)\s?[\])}]\s{0,2}|\s(?:dot|point|punkt|punto)\s)(?=[0-9])", re.I)


def digit_dots(tape: Tape) -> Tape:
    if not _DOT_NAMES.search(tape.text) and "[.]" not in tape.text and "(.)" not in tape.text:
        return tape
    return tape.rewritten([(*m.span(), ".") for m in _DIGIT_DOT.finditer(tape.text)])


def _order(find: Find) -> tuple[int, int]:
    return find[1], KINDS.index(find[0])


def _found(text: str) -> tuple[list[Find], list[Find]]:
    """The finds of the text as it is, and those of the normalised text, mapped back."""
    base = detect(text)
    tape = digit_dots(disguises(spelled_digits(characters(Tape.of(text)))))
    if tape.text == text:
        return base, []
    return base, [(kind, *tape.source(start, end)) for kind, start, end in detect(tape.text)]


def find(text: str) -> tuple[list[Find], list[Find]]:
    """The base finds, and all finds: the base and those that only the normalised text shows.

    Of the latter those that overlap a base find or an earlier one are left out.
    """
    base, normalised = _found(text)
    finds = list(base)
    for kind, a, b in normalised:
        if not any(a < f[2] and f[1] < b for f in finds):
            finds.append((kind, a, b))
    return base, sorted(finds, key=_order)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_FOUND = "array<struct<kind:string,start:int,end:int>>"


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id, base, finds`` of every row: arrays of (kind, start, end), code points of the whole text.

    A null or empty text has no finds.  Rows are kept as they come, repeated rows and null ids
    included; other columns are left behind.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            both = [find(text.decode("utf-8", "replace")) for text in batch.column("text").to_pylist()]
            columns = [
                pa.array([[dict(zip(("kind", "start", "end"), f)) for f in row[k]] for row in both], pa.list_(_SPAN))
                for k in (0, 1)
            ]
            yield pa.record_batch([batch.column("doc_id"), *columns], ["doc_id", "base", "finds"])

    return text_bytes(docs).mapInArrow(search, f"doc_id bigint, base {_FOUND}, finds {_FOUND}")


def redact(text: str) -> str:
    """The text with all that any find covers, of the text or of its normalised form, replaced by its kind in brackets.

    Overlapping finds become one, named by the first.
    """
    out, at = [], 0
    base, normalised = _found(text)
    for kind, start, end in sorted(base + normalised, key=_order):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """The same rows and columns, with every text (null stays null) passed through ``redact``."""
    column = docs.schema.names.index("text")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for batch in slices(batches, "text"):
            texts = [None if t is None else redact(t) for t in batch.column(column).to_pylist()]
            yield batch.set_column(column, batch.schema.field(column), pa.array(texts, batch.schema.field(column).type))

    return docs.mapInArrow(rewrite, docs.schema)
