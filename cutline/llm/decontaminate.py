"""Benchmark decontamination with a generalised suffix automaton.

The automaton is built from the word sequences of all test items, each inserted from the root, so
it accepts exactly the word strings that occur inside one item.  A document's words stream through it;
the longest match ending at every word is tracked.  Where it reaches ``window`` words, the last
``window`` words are a window of some item; items shorter than that count as one window of their
own length.  Words inside any such window are hit, and a document with too large a hit share is
contaminated.

Words no item contains reset the automaton, so only runs of known words long enough to hold a window
are streamed at all; the rest of the text is dismissed by one vectorised pass.

Items are a benchmark, not a corpus, but their size is checked all the same: they are packed into
blocks of at most ``BLOCK_WORDS`` words (an item longer than that is cut into pieces that overlap by
``window - 1`` words, which keeps every window), each block is one broadcast automaton, and the hits
of several blocks are merged row by row, as the rows pass from one automaton to the next.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.llm.common import slices, text_bytes

WINDOW = 13
#: A document is contaminated if at least one word in this many is hit.
SHARE = 20
#: Words of test items in one automaton (about 2 kB each in a Python worker).
BLOCK_WORDS = 50_000

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

Hits = tuple[list[tuple[int, int]], set[int]]


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of digits, letters and all characters beyond ASCII."""
    return text.translate(_WORD_BYTES).split()


@dataclass
class Automaton:
    """Suffix automaton over word ids; state 0 is the root."""

    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    longest: list[int] = field(default_factory=lambda: [0])
    #: Items with the full window that ends in a state, and (length, items) of whole short items.
    owners: dict[int, set[int]] = field(default_factory=dict)
    short: dict[int, tuple[int, set[int]]] = field(default_factory=dict)
    #: The state where a match of ``window`` or more words finds its window's owners; short items by state.
    full_at: list[int] = field(default_factory=list)
    short_at: list[tuple[int, ...]] = field(default_factory=list)
    shortest: int = 0

    def _state(self, step: dict[int, int], link: int, longest: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.longest.append(longest)
        return len(self.step) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of ``q`` for the shorter strings that reach it from ``p``."""
        clone = self._state(dict(self.step[q]), self.link[q], self.longest[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        q = self.step[last].get(word)
        if q is not None:
            return q if self.longest[q] == self.longest[last] + 1 else self._split(last, word, q)
        new, p = self._state({}, 0, self.longest[last] + 1), last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][word]
            self.link[new] = q if self.longest[q] == self.longest[p] + 1 else self._split(p, word, q)
        return new

    def build(self, items: Iterable[tuple[int, list[bytes]]]) -> Automaton:
        """Takes (item number, words) pairs; items without words are left out."""
        coded = [
            (number, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in sequence])
            for number, sequence in items
            if sequence
        ]
        for _, sequence in coded:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        # From a state up the links: the first whose strings are as short as a window.
        by_length = np.argsort(self.longest, kind="stable").tolist()
        self.full_at = [-1] * len(self.step)
        for state in by_length:
            if self.longest[state] >= self.window:
                up = self.link[state]
                self.full_at[state] = self.full_at[up] if self.longest[up] >= self.window else state
        for number, sequence in coded:
            state = 0
            for end, word in enumerate(sequence, 1):
                state = self.step[state][word]
                if end >= self.window:
                    self.owners.setdefault(self.full_at[state], set()).add(number)
            if len(sequence) < self.window:
                self.short.setdefault(state, (len(sequence), set()))[1].add(number)
        self.short_at = [()] * len(self.step)
        for state in by_length[1:]:
            self.short_at[state] = self.short_at[self.link[state]] + ((state,) if state in self.short else ())
        self.shortest = min((min(len(s), self.window) for _, s in coded), default=0)
        return self

    def _walk(self, coded: list[int], offset: int, spans: list[tuple[int, int]], items: set[int]) -> None:
        step, link, longest, window = self.step, self.link, self.longest, self.window
        state = length = 0
        for at, word in enumerate(coded, offset + 1):
            while state and word not in step[state]:
                state = link[state]
                length = longest[state]
            if word in step[state]:
                state = step[state][word]
                length += 1
            if length >= window:
                spans.append((at - window, at))
                items |= self.owners[self.full_at[state]]
            for terminal in self.short_at[state]:
                size, owners = self.short[terminal]
                if length >= size:
                    spans.append((at - size, at))
                    items |= owners

    def hits(self, sequence: list[bytes]) -> Hits:
        """Spans of hit words (ascending by end, may overlap) and the items they come from."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        get = self.vocabulary.get
        coded = [get(word, -1) for word in sequence]
        breaks = np.flatnonzero(np.fromiter(coded, np.int64, len(coded)) < 0)
        starts, ends = np.append(0, breaks + 1), np.append(breaks, len(coded))
        worth = ends - starts >= max(self.shortest, 1)
        for start, end in zip(starts[worth].tolist(), ends[worth].tolist()):
            self._walk(coded[start:end], start, spans, items)
        return spans, items


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint spans that cover the same words."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def blocks(benchmark: DataFrame, window: int, block_words: int = BLOCK_WORDS) -> Iterator[tuple[list[str], Automaton]]:
    """Automata over at most ``block_words`` words each, with the ids of their items."""
    ids: list[str] = []
    pending: list[tuple[int, list[bytes]]] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).where("text IS NOT NULL")
    for item_id, text in rows.toLocalIterator():
        sequence = words(bytes(text))
        for start in range(0, max(len(sequence) - window + 1, 1), block_words):
            piece = sequence[start : start + block_words + window - 1]
            if pending and size + len(piece) > block_words:
                yield ids, Automaton(window).build(pending)
                ids, pending, size = [], [], 0
            pending.append((len(ids), piece))
            ids.append("" if item_id is None else item_id)
            size += len(piece)
    yield ids, Automaton(window).build(pending)


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_ADDED = "n_words bigint, spans array<struct<start:int,end:int>>, items array<string>"


def _streamed(rows: DataFrame, benchmark: DataFrame, window: int, block_words: int, automata: list | None = None) -> DataFrame:
    """``rows`` (row, text) with ``n_words, spans, items``; ``row`` is whatever is to be kept of a document.

    The broadcast automata are added to ``automata``.
    """
    schema = f"row {rows.schema['row'].dataType.simpleString()}, text binary, {_ADDED}"
    found = rows
    for ids, automaton in blocks(benchmark, window, block_words):
        shared = rows.sparkSession.sparkContext.broadcast((ids, automaton))
        if automata is not None:
            automata.append(shared)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, automaton = shared.value
            for batch in slices(batches, "text"):
                earlier = batch.num_columns > 2 and [batch.column(3).to_pylist(), batch.column(4).to_pylist()]
                n_words, spans, items = [], [], []
                for at, text in enumerate(batch.column("text").to_pylist()):
                    sequence = words(text)
                    new_spans, new_items = automaton.hits(sequence)
                    names = {ids[i] for i in new_items}
                    if earlier:
                        new_spans += [(s["start"], s["end"]) for s in earlier[0][at]]
                        names.update(earlier[1][at])
                    n_words.append(len(sequence))
                    spans.append([{"start": a, "end": b} for a, b in merged(new_spans)])
                    items.append(sorted(names))
                added = [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array(items, pa.list_(pa.string()))]
                yield pa.record_batch([*batch.columns[:2], *added], ["row", "text", "n_words", "spans", "items"])

        found = found.mapInArrow(search, schema)
    return found


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, n_words, spans, items`` of every row: hit spans in words (disjoint, ascending), item ids (sorted as text).

    Null or empty texts have no words and no hits; null or wordless items have no windows.  Several
    items with one id count once.  Repeated rows and null ids are kept as they are; other columns are
    left behind.  An empty benchmark gives every row no hits.
    """
    rows = text_bytes(docs).select(F.col("doc_id").alias("row"), "text")
    return _streamed(rows, benchmark, window, block_words).select(F.col("row").alias("doc_id"), "n_words", "spans", "items")


def kept(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, columns unchanged."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    found = judged(_streamed(rows, benchmark, window, BLOCK_WORDS), share)
    return found.where("NOT contaminated").select("row.*")


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without these words (disjoint, ascending) and what stands between them; all other bytes stay."""
    known = np.frombuffer(text.translate(_WORD_BYTES), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for first, last in spans:
        out.append(text[at : starts[first]])
        at = int(ends[last - 1])
    return b"".join([*out, text[at:]])


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, hit words cut out of the others; clean rows as they are.

    What a cut joins is searched again until nothing is hit.  ``n_chars``, if there, counts the new text of cut rows.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    automata: list = []
    found = judged(_streamed(rows, benchmark, window, block_words, automata), share).where("NOT contaminated")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = [shared.value[1] for shared in automata]
        for batch in slices(batches, "text"):
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                hit = [(s["start"], s["end"]) for s in spans]
                new = text if hit else None
                while hit:
                    new = without(new, hit)
                    sequence = words(new)
                    hit = merged(span for automaton in searched for span in automaton.hits(sequence)[0])
                texts.append(new)
            yield pa.record_batch([batch.column("row"), pa.array(texts, pa.binary())], ["row", "new"])

    done = found.select("row", "text", "spans").mapInArrow(cut, f"row {rows.schema['row'].dataType.simpleString()}, new binary")
    new = F.col("new").cast("string")
    changed = {"text": new, "n_chars": F.length(new).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return done.select(*[F.when(F.col("new").isNotNull(), changed[c]).otherwise(F.col("row")[c]).alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns])


def judged(found: DataFrame, share: int = SHARE) -> DataFrame:
    """``find``'s rows with ``n_hit`` and ``contaminated``: at least one word in ``share`` is hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    )
