"""Near-duplicate classes by order MinHash, verified by banded alignment.

A text becomes the sequence of its five-word shingles, each labelled with how often it came before, so
that labels are unique.  One sketch takes the ``MINIMA`` smallest labels under a hash and keeps them in text order;
equal sketches mean that the same shingles came in the same order, so they are as sensitive to moved text as the
edit distance.  Texts that share one of ``SKETCHES`` sketches are candidates.

Two texts are linked if an alignment of their shingle sequences matches enough of them, in order:
``m / (n1 + n2 - m) >= 0.8``.  Such an alignment leaves at most ``(n1 + n2) * 0.2 / 1.8`` shingles
unmatched, so it runs in a band of that width around the diagonal, where a longest increasing chain of equal
labels finds it.

Copies are one text from the start.  A bucket is never gathered: its texts are cut into salted runs of bounded length,
each text is verified against the smallest of its run and its neighbours in a hashed order, and the
runs' smallest against each other's.  Texts in one class already need no further comparison, so a further round
only looks at candidates in different classes, further along the runs.  Classes are connected components of the links.

Buckets that still hold several classes are finished exactly: their texts are dealt into cells, and each pair of cells
with texts of different classes is one group, where all such pairs meet.  A text is there as the parities of its
labels in a bit field.  Two fields differ in no more bits than the texts in labels, so whatever differs in too many
cannot be linked, and only the other pairs are aligned.  First the closest pair of two classes in each group is, and then
what is left between classes; no pair of texts that shares a sketch is passed over.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutline.llm.common import CACHES, slices, vacate
from cutline.llm.common import stored as _stored
from cutline.llm.components import components
from cutline.llm.decontaminate import words

SHINGLE = 5
LEAST = 0.8
#: Two texts of similarity 0.8 share no sketch with a probability of (1 - 0.8 ** 3) ** 16, or 1e-5.
SKETCHES, MINIMA = 16, 3
#: Texts of a bucket in one run.
RUN = 10_000
#: How far along a run a text is compared, round by round.
REACH = (2, 5)
#: Texts of a bucket in one cell, and the most bits of a text's field (texts beyond a quarter as many words share bits).
CELL, MOST_BITS = 512, 1 << 15

#: Bytes of an Arrow batch: rows of pairs carry two whole texts each.
BATCH_BYTES = 4 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_ODD = (np.random.default_rng(11).integers(1, 2**63, SKETCHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def stored(df: DataFrame, name: str) -> DataFrame:
    return _stored(df, name, BATCH_BYTES)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()
CACHES.append(_HASHES)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX
    values = (values ^ (values >> np.uint64(32))) * _MIX
    return values ^ (values >> np.uint64(32))


def labels(text: bytes) -> np.ndarray:
    """Hashes of the text's shingles with their occurrence numbers; fewer than five words are one shingle."""
    sequence = np.fromiter(map(_HASHES.__getitem__, words(text)), np.uint64)
    n = len(sequence)
    if n == 0:
        return sequence
    k = min(n, SHINGLE)
    shingles = np.full(n - k + 1, np.uint64(k), np.uint64)
    for at in range(k):
        shingles = shingles * _BASE + sequence[at : n - k + 1 + at]
    shingles = _mixed(shingles)
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    if len(first) == n - k + 1:
        return shingles
    occurrence = np.arange(len(ranked)) - np.repeat(first, np.diff(np.append(first, len(ranked))))
    shingles[order] = _mixed(ranked + occurrence.astype(np.uint64) * _BASE)
    return shingles


def sketches(text: bytes) -> list[int]:
    """One bucket number for each sketch; none for a text without words."""
    found = labels(text)
    if not len(found):
        return []
    hashed = found * _ODD[:, None]
    hashed ^= hashed >> np.uint64(29)
    if len(found) > MINIMA:
        chosen = np.sort(np.argpartition(hashed, MINIMA - 1, axis=1)[:, :MINIMA], axis=1)
    else:
        chosen = np.tile(np.arange(len(found)), (SKETCHES, 1))
    buckets = np.arange(SKETCHES, dtype=np.uint64)
    for column in chosen.T:
        buckets = _mixed(buckets * _BASE + found[column])
    return buckets.view(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> float:
    """Share of shingles that the best alignment inside the band matches, 0 where it cannot reach ``least``."""
    total = len(a) + len(b)
    needed = least * total / (1 + least)
    if min(len(a), len(b)) < needed or total == 0:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    inside = np.abs(i - j) <= total * (1 - least) / (1 + least)
    i, j = i[inside], j[inside]
    if len(i) < needed:
        return 0.0
    j = j[np.argsort(i)]
    if np.all(j[1:] > j[:-1]):
        matched = len(j)
    else:
        tails: list[int] = []
        for place in j.tolist():
            at = bisect_left(tails, place)
            tails[at : at + 1] = [place]
        matched = len(tails)
    return matched / (total - matched)


def parities(found: np.ndarray) -> bytes:
    """A bit field, about four bits a label: each bit says whether an odd number of labels falls on it."""
    bits = min(max(64, 1 << (4 * len(found) - 1).bit_length()), MOST_BITS)
    at = (_mixed(found) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(fields: np.ndarray, words_: int) -> np.ndarray:
    """The parities in fewer bits."""
    while fields.shape[1] > words_:
        half = fields.shape[1] // 2
        fields = fields[:, :half] ^ fields[:, half:]
    return fields


def close(left: list[tuple], right: list[tuple] | None) -> Iterator[tuple[int, int, float]]:
    """Places in ``left`` and ``right`` (none: pairs inside ``left``) of all texts that may be linked, and how much of what may differ does.

    The texts are (class, labels, bit field); two of one class are left out.
    """
    inside = right is None
    names: dict = {}
    sides = []
    for texts in (left,) if inside else (left, right):
        numbers = np.array([names.setdefault(t[0], len(names)) for t in texts])
        counts = np.array([t[1] for t in texts])
        widths = np.array([len(t[2]) // 8 for t in texts])
        fields = {w: np.frombuffer(b"".join(t[2] for t in texts if len(t[2]) // 8 == w), np.uint64).reshape(-1, w) for w in set(widths.tolist())}
        sides.append((numbers, counts, {w: (np.flatnonzero(widths == w), f) for w, f in fields.items()}))
    (numbers, counts, fields), (numbers_b, counts_b, fields_b) = sides[0], sides[-1]
    for w, (places, own) in fields.items():
        for w_b, (places_b, others) in fields_b.items():
            width = min(w, w_b)
            narrow, against = _folded(own, width), _folded(others, width)
            for at, field in zip(places.tolist(), narrow):
                total = counts[at] + counts_b[places_b]
                fits = np.minimum(counts[at], counts_b[places_b]) >= LEAST * total / (1 + LEAST) - 1e-6
                fits &= numbers_b[places_b] != numbers[at]
                if inside:
                    fits &= places_b > at
                fits = np.flatnonzero(fits)
                if len(fits):
                    differ = np.bitwise_count(against[fits] ^ field).sum(1, dtype=np.int64)
                    share = differ / (total[fits] * (1 - LEAST) / (1 + LEAST) + 1e-6)
                    for b, part in zip(places_b[fits[share <= 1]].tolist(), share[share <= 1].tolist()):
                        yield at, b, part


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text_key``, 128 bits that stand for the whole text (null: empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("text_key", F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32)))


def _sketched(docs: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate(_HASHES)
        for batch in slices(batches, "text"):
            found = [sketches(text) for text in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(found, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "buckets"],
            )

    rows = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), "text_key")
    return rows.mapInArrow(scan, "doc_id bigint, text_key binary, buckets array<bigint>")


def _runs(rows: DataFrame) -> DataFrame:
    """``bucket, run, place, text_key`` of every bucket with several texts."""
    texts = rows.groupBy("text_key").agg(F.min("buckets").alias("buckets"))
    members = texts.select("text_key", F.explode("buckets").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    place = F.xxhash64("bucket", "text_key")
    return members.join(sizes, "bucket").select(
        "bucket", F.pmod(F.xxhash64("text_key"), F.ceil(F.col("size") / RUN)).alias("run"), place.alias("place"), "text_key"
    )


def _candidates(runs: DataFrame, classes: DataFrame | None, first: int, last: int) -> DataFrame:
    """Pairs (a, b) of texts, ``first`` to ``last`` places apart in a run, that are not in one class yet.

    Linear in the number of members, however large a bucket is.  The first round adds the smallest of each run, and
    links the runs of a bucket by theirs.
    """
    if classes is None:
        open_ = runs.withColumn("label", F.col("text_key"))
    else:
        labelled = runs.join(classes.withColumnRenamed("node", "text_key"), "text_key", "left")
        labelled = labelled.withColumn("label", F.coalesce("label", "text_key"))
        mixed = labelled.groupBy("bucket", "run").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
        open_ = labelled.join(mixed.select("bucket", "run"), ["bucket", "run"])
    run = Window.partitionBy("bucket", "run")
    order = run.orderBy("place", "text_key")
    member = F.struct(F.col("text_key").alias("b"), "label")
    named = [F.lead(member, n).over(order).alias(f"b{n}") for n in range(first, last + 1)]
    if classes is None:
        named.append(F.struct(F.min("text_key").over(run).alias("b"), F.min("text_key").over(run).alias("label")).alias("b0"))
    beside = open_.select(F.col("text_key").alias("a"), "label", *named)
    others = F.filter(F.array(*[c for c in beside.columns if c not in ("a", "label")]), lambda s: s["label"] != F.col("label"))
    pairs = beside.select("a", F.explode(others).alias("s")).select("a", "s.b")
    if classes is None:
        heads = runs.groupBy("bucket", "run").agg(F.min("text_key").alias("a"))
        bucket = Window.partitionBy("bucket")
        heads = heads.select("a", F.lead("a").over(bucket.orderBy("run")).alias("b0"), F.min("a").over(bucket).alias("b1"))
        pairs = pairs.unionByName(heads.select("a", F.explode(F.array("b0", "b1")).alias("b")).where("b IS NOT NULL AND a <> b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _fields(texts: DataFrame) -> DataFrame:
    """``text_key, n, bits`` of every text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [labels(text) for text in batch.column("text").to_pylist()]
            columns = [pa.array([len(f) for f in found], pa.int64()), pa.array([parities(f) for f in found], pa.binary())]
            yield pa.record_batch([batch.column("text_key"), *columns], ["text_key", "n", "bits"])

    return texts.select("text_key", "text").mapInArrow(scan, "text_key binary, n bigint, bits binary")


def _open(runs: DataFrame, classes: DataFrame) -> DataFrame:
    """``bucket, text_key, label`` of the buckets that hold several classes."""
    labelled = runs.select("bucket", "text_key").join(classes.withColumnRenamed("node", "text_key"), "text_key", "left")
    labelled = labelled.withColumn("label", F.coalesce("label", "text_key"))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    return labelled.join(mixed.select("bucket"), "bucket")


def _between(open_: DataFrame, fields: DataFrame, once: bool) -> DataFrame:
    """Pairs (a, b) of texts that share a bucket, are in different classes and may be linked.

    With ``once``, only the closest pair of two classes in each group.  A class of more texts than a cell holds has cells
    of its own, which do not meet each other.
    """
    sizes = open_.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("size"))
    large = sizes.where(F.col("size") > CELL)
    few = sizes.where(F.col("size") <= CELL).groupBy("bucket").agg(F.sum("size").alias("few"))
    members = open_.join(large, ["bucket", "label"], "left").join(few, "bucket", "left")
    number = F.pmod(F.xxhash64("text_key"), F.ceil(F.coalesce("size", "few") / CELL))
    members = members.withColumn("own", F.when(F.col("size").isNotNull(), F.hex("label")).otherwise(""))
    members = members.select("bucket", "text_key", "label", "own", F.concat_ws(":", "own", number).alias("cell"))
    cells = stored(members.select("bucket", "own", "cell").distinct(), "cells")
    meets = F.col("x.cell") < F.col("y.cell")
    met = cells.alias("x").join(cells.alias("y"), "bucket").where((meets & ~((F.col("x.own") == F.col("y.own")) & (F.col("x.own") != ""))) | ((F.col("x.cell") == F.col("y.cell")) & (F.col("x.own") == "")))
    met = met.select("bucket", F.col("x.cell").alias("i"), F.col("y.cell").alias("j"))
    sides = F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))
    dealt = met.select("bucket", "i", "j", F.explode(sides).alias("cell"))
    rows = members.drop("own").join(dealt, ["bucket", "cell"]).join(fields, "text_key")
    group = ["bucket", "i", "j"]
    rows = rows.select(*group, (F.col("cell") != F.col("i")).alias("right"), "text_key", "label", "n", "bits")

    def pairs(texts: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        left, right = [t for t in texts if not t[0]], [t for t in texts if t[0]]
        found = close([t[2:] for t in left], [t[2:] for t in right] if right else None)
        best: dict = {}
        for at, b, part in found:
            one, other = left[at], (right or left)[b]
            a_b = min(one[1], other[1]), max(one[1], other[1])
            if not once:
                yield a_b
                continue
            key = min(one[2], other[2]), max(one[2], other[2])
            if key not in best or (part, a_b) < best[key]:
                best[key] = part, a_b
        yield from (a_b for _, a_b in best.values())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(texts: list[tuple]) -> Iterator[pa.RecordBatch]:
            chunk: list = []
            for pair in pairs(texts):
                chunk.append(pair)
                if len(chunk) == 10_000:
                    yield pa.record_batch([pa.array(c, pa.binary()) for c in zip(*chunk)], ["a", "b"])
                    chunk = []
            if chunk:
                yield pa.record_batch([pa.array(c, pa.binary()) for c in zip(*chunk)], ["a", "b"])

        last, texts = None, []
        for batch in slices(batches, "bits"):
            for row in zip(*[column.to_pylist() for column in batch.columns]):
                if row[:3] != last:
                    if len(texts) > 1:
                        yield from flush(texts)
                    last, texts = row[:3], []
                texts.append(row[3:])
        if len(texts) > 1:
            yield from flush(texts)

    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(meet, "a binary, b binary").distinct()


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in slices(batches, "b_text"):
            keep = []
            for a, a_text, b_text in zip(*[batch.column(c).to_pylist() for c in ("a", "a_text", "b_text")]):
                if a != last:
                    last, left = a, labels(a_text)
                keep.append(similarity(left, labels(b_text)) >= LEAST)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda name: texts.select(F.col("text_key").alias(name), F.col("text").alias(f"{name}_text"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_text", "b_text")
    return both.mapInArrow(verify, "a binary, b binary")


def _members(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, class_key`` of every row."""
    rows = stored(_sketched(docs), "sketches")
    runs = stored(_runs(rows), "runs")
    named = runs.select("text_key").distinct()
    wanted = _keyed(docs.select(F.coalesce("text", F.lit("")).alias("text"))).join(named, "text_key", "left_semi")
    texts = stored(wanted.groupBy("text_key").agg(F.first("text").cast("binary").alias("text")), "candidate-texts")
    links: DataFrame | None = None
    found: DataFrame | None = None
    for before, reach in zip((0, *REACH), REACH):
        pairs = stored(_candidates(runs, found, before + 1, reach), "candidates")
        new = stored(_linked(pairs, texts), "links")
        if links is not None and new.isEmpty():
            continue
        links = new if links is None else links.unionByName(new)
        found = components(links)
    open_ = stored(_open(runs, found), "open")
    fields = stored(_fields(texts.join(open_.select("text_key").distinct(), "text_key", "left_semi")), "fields")
    for once in (True, False):
        new = stored(_linked(stored(_between(open_, fields, once), "candidates"), texts), "links")
        if not new.isEmpty():
            links = links.unionByName(new)
            found = components(links)
            open_ = stored(_open(runs, found), "open")
    found = found.withColumnRenamed("node", "text_key")
    return (
        rows.select("doc_id", "text_key")
        .join(found, "text_key", "left")
        .select("doc_id", "text_key", F.coalesce("label", "text_key").alias("class_key"))
    )


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, class_rows`` of every row: the smallest doc_id of its class and the number of its rows.

    Equal texts are always one class.  A null text is an empty one; texts without words are in a class with
    their copies only; texts of fewer than five words are like those with the same words.  Rows with a null
    id take part; a class of nothing else has a null class_id.  Repeated rows are kept and counted.
    """
    members = stored(_members(docs), "members")
    ids = members.groupBy("class_key").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_rows"))
    return members.join(ids, "class_key").select("doc_id", "class_id", "class_rows")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of every class, columns unchanged: a row with the smallest id (nulls last), and its smallest text key.

    Rows equal in id and text are copies; any one of them stays.
    """
    chosen = (
        _members(docs)
        .groupBy("class_key")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("kept"))
        .select(F.col("kept.text_key").alias("text_key"), F.col("kept.doc_id").alias("_kept_id"))
    )
    return (
        _keyed(docs)
        .join(chosen, "text_key")
        .where(F.col("doc_id").eqNullSafe(F.col("_kept_id")))
        .dropDuplicates(["text_key"])
        .select(*docs.columns)
    )
