"""Exact removal of long repeated strings with a run-length compressed index.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else in the corpus.  Which windows of
``LENGTH`` bytes are repeated is decided in three steps.

Cutting.  Each window is owned by its anchor, the place of the smallest hash among the 32-byte strings in
it.  Equal windows have equal anchors at equal distances, and consecutive windows share theirs, so a text falls into
stretches: an anchor with the windows it owns.  Equal stretches are repeated in whole, and a count by their hash finds
them.  Of the rest, only stretches can share a window whose bytes around the anchor are equal to those of another one.

Indexing.  Such stretches meet in shards of bounded size.  A shard's texts are indexed by a run-length
compressed Burrows-Wheeler transform with text positions sampled at the ends of its runs.  From these samples alone
follow, for each position of a text that streams through, its neighbours in suffix order, and thereby the length of its
match with any other place.  Windows that match in whole are marked.

Crowds.  A passage that very many texts share would crowd one shard.  Stretches around such an anchor are cut
into shorter ones, whose shared bytes are nearly the whole window, and these into single windows where that is still
not enough, which are counted by their hash.  No text and no window is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.llm.common import slices, stored, text_bytes

LENGTH = 400
GRAM = 32
#: Anchors looked at for one window, and windows that are cut at a time.
_GRAMS, _WINDOWS = LENGTH - GRAM + 1, 1 << 22
#: Bytes of the Arrow batches that Python tasks get.
BATCH_BYTES = 4 << 20
#: Widths of the pieces of a stretch, by the distance of window and anchor: first, for crowds, for their crowds, which are
#: counted window by window.
WIDTHS = (185, 23, 1)
#: Pieces of one shared string that make a crowd, and bytes of text in a shard.
CROWD, SHARD_BYTES = 3_000, 1 << 20


# --- cutting


def _anchors(data: np.ndarray) -> np.ndarray:
    """The anchor of every window of ``data``: of equal hashes the first."""
    n = len(data) - LENGTH + 1
    h = data.astype(np.uint64) + np.uint64(1)
    width = 1
    for factor in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD):
        h = h[: len(h) - width] * np.uint64(factor) + h[width:]
        h ^= h >> np.uint64(31)
        width *= 2
    h *= np.uint64(0x9E3779B97F4A7C15)
    h &= ~np.uint64((1 << 24) - 1)
    h |= np.arange(len(h), dtype=np.uint64)
    blocks = -(-len(h) // _GRAMS)
    table = np.full(blocks * _GRAMS, ~np.uint64(0))
    table[: len(h)] = h
    table = table.reshape(blocks, _GRAMS)
    before = np.minimum.accumulate(table, axis=1).reshape(-1)
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(after[:n], before[_GRAMS - 1 : _GRAMS - 1 + n]) & np.uint64((1 << 24) - 1)).astype(np.int64)


def stretches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, first window, last window, anchor) of every stretch, in the order of the texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    found = []
    for at in range(0, max(len(data) - LENGTH + 1, 0), _WINDOWS):
        anchor = _anchors(data[at : at + _WINDOWS + LENGTH - 1]) + at
        window = np.arange(at, at + len(anchor))
        text = np.searchsorted(starts, window, side="right") - 1
        inside = window + LENGTH <= starts[text] + sizes[text]
        window, anchor, text = window[inside], anchor[inside], text[inside]
        if len(window):
            new = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(window)) - 1
            t = text[first]
            found.append((t, window[first] - starts[t], window[last] - starts[t], anchor[first] - starts[t]))
    if not found:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(c) for c in zip(*found))


def pieces(first: int, last: int, anchor: int, width: int) -> list[tuple[int, int, int, int]]:
    """The windows of a stretch by their distance to the anchor, ``width`` at a time.

    Gives (first window, last window, begin, end): the bytes from begin to end are in each of the windows, at one distance.
    """
    out = []
    for turn in range((anchor - last) // width, (anchor - first) // width + 1):
        high, low = anchor - turn * width, anchor - (turn + 1) * width + 1
        out.append((max(first, low), min(last, high), high, low + LENGTH))
    return out


def _key(text: bytes, begin: int, end: int, anchor: int, offset: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text[begin - offset : end - offset], seed=anchor - begin + 512) - (1 << 63)


_SCAN = (
    "row bigint, doc_id bigint, sha string, n_bytes bigint, "
    "parts array<struct<first:int,last:int,anchor:int,t1:bigint,t2:bigint,keys:array<bigint>>>"
)


def _scanned(docs: DataFrame) -> DataFrame:
    """Every row under a number of its own, with its stretches: their hash (128 bits) and the keys of their pieces."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            text, first, last, anchor = stretches(texts)
            hashes, keys, counts = np.empty((len(text), 2), np.int64), [], []
            for at, (t, a, b, p) in enumerate(zip(text.tolist(), first.tolist(), last.tolist(), anchor.tolist())):
                own = texts[t]
                hashes[at] = np.frombuffer(xxhash.xxh3_128_digest(own[a : b + LENGTH], seed=p - a), np.int64)
                cut = pieces(a, b, p, WIDTHS[0])
                counts.append(len(cut))
                keys.extend(_key(own, x, y, p) for _, _, x, y in cut)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts], dtype=np.int32)), pa.array(keys, pa.int64()))
            rows = pa.StructArray.from_arrays(
                [pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(anchor, pa.int32()), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), lists],
                ["first", "last", "anchor", "t1", "t2", "keys"],
            )
            ends = np.searchsorted(text, np.arange(len(texts) + 1))
            yield pa.record_batch(
                [
                    pa.array(range(next_row, next_row + len(texts)), pa.int64()),
                    batch.column("doc_id"),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rows),
                ],
                ["row", "doc_id", "sha", "n_bytes", "parts"],
            )
            next_row += len(texts)

    return text_bytes(docs).mapInArrow(scan, _SCAN)


# --- indexing


class RunLengthIndex:
    """A Burrows-Wheeler transform as runs, with the text positions at both ends of every run.

    ``segments`` are indexed end to end, each closed by a zero byte; of suffixes equal up to that the
    earlier one is the smaller.
    """

    def __init__(self, segments: list[bytes]):
        self.data = np.frombuffer(b"\0".join([*segments, b""]), np.uint8)
        self.starts = np.cumsum([0, *[len(s) + 1 for s in segments]])[:-1]
        order = self._sorted()
        before = self.data[order - 1]
        # Closing bytes differ from one another, so each is a run of its own.
        opening = np.zeros(len(order), bool)
        opening[self.starts] = True
        closing = opening[order]
        edge = np.flatnonzero((before[1:] != before[:-1]) | closing[1:] | closing[:-1]) + 1
        begin, end = np.append(0, edge), np.append(edge, len(order)) - 1
        self.heads, self.lengths = before[begin], end - begin + 1
        # At the first suffix of a run, the one before it; at the last, the one after it (-1: none).
        self.down = self._samples(order[begin], np.append(-1, order[begin[1:] - 1]))
        self.up = self._samples(order[end], np.append(order[end[:-1] + 1], -1))

    @staticmethod
    def _samples(at: np.ndarray, neighbour: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(at)
        return at[order], neighbour[order]

    def _sorted(self) -> np.ndarray:
        """Suffix order by doubling; keeps the ranks that compare up to 256 bytes."""
        n = len(self.data)
        ends = np.append(self.starts[1:], n) - 1
        left = (np.repeat(ends, np.diff(np.append(self.starts, n))) - np.arange(n) + 1).astype(np.int32)
        packed = np.zeros(n, np.uint64)
        padded = np.append(self.data, np.zeros(8, np.uint8))
        for byte in range(8):
            packed <<= np.uint64(8)
            packed |= np.where(left > byte, padded[byte : byte + n], np.uint8(0))
        # How much of a suffix is left tells a closing zero from a zero byte of the text.
        rank = self._ranks(packed, np.minimum(left, 8).astype(np.uint8))
        del packed
        width = 8
        while width < 256 or rank.max() < n - 1:
            if width == 256:
                self.compared = rank
            following = np.zeros(n, np.int32)
            inside = left > width
            following[inside] = rank[np.flatnonzero(inside) + width] + 1
            wider = self._ranks(rank * np.int64(n + 1) + following)
            width *= 2
            if width > 256 and wider.max() == rank.max():
                break
            rank = wider
        if width <= 256:
            self.compared = rank
        return np.argsort(rank, kind="stable").astype(np.int32)

    @staticmethod
    def _ranks(key: np.ndarray, then: np.ndarray | None = None) -> np.ndarray:
        order = np.argsort(key) if then is None else np.lexsort((then, key))
        new = key[order[1:]] != key[order[:-1]]
        if then is not None:
            new |= then[order[1:]] != then[order[:-1]]
        steps = np.zeros(len(key), np.int32)
        np.cumsum(new, dtype=np.int32, out=steps[1:])
        rank = np.empty(len(key), np.int32)
        rank[order] = steps
        return rank

    def _neighbour(self, samples: tuple[np.ndarray, np.ndarray], places: np.ndarray) -> np.ndarray:
        at = np.searchsorted(samples[0], places, side="right") - 1
        base = samples[1][at]
        return np.where((at < 0) | (base < 0), -1, base + places - samples[0][at])

    def repeated(self, places: np.ndarray) -> np.ndarray:
        """Whether the ``LENGTH`` bytes at each place, all inside its segment, match those of a neighbour in suffix order."""
        out = np.zeros(len(places), bool)
        for samples in (self.down, self.up):
            other = self._neighbour(samples, places)
            near = np.flatnonzero((other >= 0) & (other + LENGTH <= len(self.data)))
            a, b = places[near], other[near]
            tail = LENGTH - 256
            out[near] |= (self.compared[a] == self.compared[b]) & (self.compared[a + tail] == self.compared[b + tail])
        return out


def marked(segments: list[bytes]) -> list[np.ndarray]:
    """For every segment, which of its windows are at least twice in the segments."""
    index = RunLengthIndex(segments)
    counts = np.array([max(0, len(s) - LENGTH + 1) for s in segments])
    offset = np.repeat(index.starts - np.cumsum(counts) + counts, counts)
    return np.split(index.repeated(offset + np.arange(counts.sum())), np.cumsum(counts)[:-1])


def _ranges(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


# --- the corpus

_PIECE = "row bigint, single boolean, first int, last int, anchor int, begin int, text binary, key bigint"
_RANGE = "row bigint, first int, last int"


def _texts(wanted: DataFrame, numbers: DataFrame, docs: DataFrame) -> DataFrame:
    """``wanted`` (row, ...) with the whole text of each row; numbers: row, sha."""
    keyed = text_bytes(docs).select("text", F.sha2("text", 256).alias("sha")).dropDuplicates(["sha"])
    return wanted.join(numbers.select("row", "sha"), "row").join(keyed, "sha").drop("sha")


def _cut(parts: DataFrame, width: int) -> DataFrame:
    """Pieces of ``width`` windows of longer pieces; their text is that of the windows alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 17):
            rows = []
            for row in batch.to_pylist():
                base, text = row["begin"], row["text"]
                for a, b, x, y in pieces(row["first"], row["last"], row["anchor"], width):
                    key = _key(text, x, y, row["anchor"], base)
                    rows.append((row["row"], row["single"], a, b, row["anchor"], a, text[a - base : b + LENGTH - base], key))
            names = ["row", "single", "first", "last", "anchor", "begin", "text", "key"]
            types = [pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names) if rows else pa.record_batch([pa.array([], t) for t in types], names)

    return parts.select("row", "single", "first", "last", "anchor", "begin", "text").mapInArrow(cut, _PIECE)


def _indexed(parts: DataFrame) -> DataFrame:
    """Repeated windows of the single pieces, found in shards of at most about SHARD_BYTES."""
    size = parts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-size // SHARD_BYTES) or 1

    def find(key, pdf):
        marks = marked(pdf["text"].tolist())
        rows = [
            (row, first + a, first + b)
            for row, single, first, mask in zip(pdf["row"], pdf["single"], pdf["first"], marks)
            if single
            for a, b in _ranges(mask)
        ]
        return pdf.iloc[:0][["row", "first"]].assign(last=0) if not rows else type(pdf)(rows, columns=["row", "first", "last"])

    sharded = parts.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return sharded.groupBy("shard").applyInPandas(find, _RANGE)


def _counted(parts: DataFrame) -> DataFrame:
    """Repeated windows of single pieces, by counting the 128-bit hashes of all their windows."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 17):
            rows, at, single, hashes = [], [], [], []
            for row in batch.to_pylist():
                view = memoryview(row["text"])
                n = row["last"] - row["first"] + 1
                rows += [row["row"]] * n
                single += [row["single"]] * n
                at += range(row["first"], row["last"] + 1)
                hashes += [xxhash.xxh3_128_digest(view[i : i + LENGTH]) for i in range(n)]
            pair = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield pa.record_batch(
                [pa.array(rows, pa.int64()), pa.array(single, pa.bool_()), pa.array(at, pa.int32()), pa.array(pair[:, 0]), pa.array(pair[:, 1])],
                ["row", "single", "at", "w1", "w2"],
            )

    every = parts.select("row", "single", "first", "last", "text").mapInArrow(windows, "row bigint, single boolean, at int, w1 bigint, w2 bigint")
    twice = every.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
    found = every.where("single").join(twice, ["w1", "w2"])
    return found.select("row", F.col("at").alias("first"), F.col("at").alias("last"))


def _shared_keys(parts: DataFrame) -> DataFrame:
    """``key, crowd`` of the keys that several pieces have, one of them single."""
    counts = parts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("single").alias("any_single"))
    return counts.where("n > 1 AND any_single").select("key", (F.col("n") > CROWD).alias("crowd"))


def _repeated(scan: DataFrame, docs: DataFrame) -> DataFrame:
    """``row, first, last`` ranges of repeated windows, all rows."""
    parts = scan.select("row", F.explode("parts").alias("p")).select("row", "p.*")
    # Equal stretches are one from here on; the first stands for all.
    distinct = stored(
        parts.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "first", "last", "anchor", "keys")).alias("p")),
        "stretches",
    )
    copied = distinct.where("n > 1").select("t1", "t2")
    whole = parts.select("row", "first", "last", "t1", "t2").join(copied, ["t1", "t2"]).select("row", "first", "last")
    # A stretch has at most two pieces of the first width, counted from the one next to the anchor.
    single = distinct.select((F.col("n") == 1).alias("single"), "p.*")
    keyed = single.select("row", "single", "first", "last", "anchor", F.posexplode("keys").alias("turn", "key"))
    chosen = stored(keyed.join(_shared_keys(keyed), "key"), "pieces")
    by_row = chosen.groupBy("row").agg(F.collect_list(F.struct("single", "first", "last", "anchor", "turn", "key", "crowd")).alias("pieces"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.bool_()]
        names = ["row", "single", "first", "last", "anchor", "begin", "text", "key", "crowd"]
        for batch in slices(batches, "text"):
            rows = []
            for row, text, wanted in zip(*[batch.column(c).to_pylist() for c in ("row", "text", "pieces")]):
                for p in wanted:
                    a, b, _, _ = pieces(p["first"], p["last"], p["anchor"], WIDTHS[0])[p["turn"]]
                    rows.append((row, p["single"], a, b, p["anchor"], a, text[a : b + LENGTH], p["key"], p["crowd"]))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    texts = _texts(by_row, scan, docs).select("row", "text", "pieces")
    picked = stored(texts.mapInArrow(pick, f"{_PIECE}, crowd boolean"), "picked", BATCH_BYTES)
    ordinary = picked.where("NOT crowd").drop("crowd")
    found = whole
    crowd = picked.where("crowd")
    if not crowd.isEmpty():
        finer = _cut(crowd, WIDTHS[1])
        keys = stored(_shared_keys(finer), "finer-keys", BATCH_BYTES)
        finer = stored(finer.join(keys, "key"), "finer", BATCH_BYTES)
        ordinary = ordinary.unionByName(finer.where("NOT crowd").drop("crowd").select(*ordinary.columns))
        found = found.unionByName(_counted(finer.where("crowd")))
    return found.unionByName(_indexed(ordinary))


def removed(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of every row; spans are (start, end) in bytes.

    A null text is empty.  Texts shorter than LENGTH keep all their bytes.  Repeated rows are copies of each other.
    Null ids are kept; other columns are left behind.
    """
    scan = stored(_scanned(docs), "scan", BATCH_BYTES)
    ranges = _repeated(scan.drop("doc_id", "n_bytes"), docs)
    by_row = ranges.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("ranges"))
    rows = stored(scan.drop("parts").join(by_row, "row", "left"), "ranges", BATCH_BYTES)
    # A text all of whose windows are repeated is gone; only the others with ranges are needed again.
    windows = F.aggregate("ranges", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    state = rows.withColumn("gone", F.coalesce(windows == F.col("n_bytes") - LENGTH + 1, F.lit(False)))
    partly = state.where("ranges IS NOT NULL AND NOT gone")
    keyed = text_bytes(docs).select("text", F.sha2("text", 256).alias("sha"))
    partly = partly.join(keyed.dropDuplicates(["sha"]), "sha").select("doc_id", "n_bytes", "ranges", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for ranges, text in zip(batch.column("ranges").to_pylist(), batch.column("text").to_pylist()):
                spans: list[list[int]] = []
                for r in ranges:
                    if spans and r["first"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r["last"] + LENGTH)
                    else:
                        spans.append([r["first"], r["last"] + LENGTH])
                kept, at = hashlib.sha256(), 0
                for start, end in spans:
                    kept.update(text[at:start])
                    at = end
                kept.update(text[at:])
                out.append((sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
            types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, t) for c, t in zip(zip(*out), types)]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:int,end:int>>"
    untouched = state.where("ranges IS NULL").selectExpr(
        "doc_id", "n_bytes", "0L AS n_removed", "0L AS n_spans", "sha AS kept_sha256", "CAST(array() AS array<struct<start:int,end:int>>) AS spans"
    )
    gone = state.where("gone").selectExpr(
        "doc_id", "n_bytes", "n_bytes AS n_removed", "1L AS n_spans", f"'{hashlib.sha256().hexdigest()}' AS kept_sha256",
        "array(named_struct('start', 0, 'end', CAST(n_bytes AS int))) AS spans",
    )
    return untouched.unionByName(gone).unionByName(partly.mapInArrow(cut, schema))
