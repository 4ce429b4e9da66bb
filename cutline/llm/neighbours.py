"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

A fast pseudo-rotation (random signs and a Hadamard transform, three times) turns a vector, and its hash is the
signed axis that it then lies nearest to.  A table's bucket joins several such hashes, the last over as many axes as give
about one bucket for ``ROWS_A_BUCKET`` vectors, so buckets stay small however many vectors there are.  A query probes
in every table the buckets whose axes it lies closest to, and the candidates are ranked by their exact distance.

How many buckets are probed follows from measured recall, whatever the size of the table: a fixed number of queries is
compared with all rows, and probes grow until their true neighbours lie in probed buckets (``effort``).

Dense clusters would fill single buckets.  Where a bounded sample shows a bucket with far more than its share, the
bucket has a table of its own: its vectors are hashed by what sets them apart from their mean.  Equal vectors
are one class with up to ``k + 1`` of its ids, found before anything is hashed.  Queries that meet fewer than ``k``
candidates are compared with all rows, in blocks of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutline.llm.common import stored

TABLES = 14
ROWS_A_BUCKET = 4
#: A query probes effort * PROBES * n ** PROBES_GROW of the n buckets of a table.
PROBES, PROBES_GROW = 18, 0.2
#: The effort grows by steps until this share of the true neighbours of so many queries lies in probed buckets.
RECALL, CHECKED, STEP = 0.93, 128, 1.5
#: Vectors, chosen by a hash of their ids, that show which buckets are crowded; every vector is indexed.
SAMPLE = 20_000
#: A bucket with this many vectors of the sample has a table of its own, up to so many levels down.
CROWD, LEVELS = 100, 4
#: Queries compared with all rows at a time, where the tables find too few candidates.
QUERY_BLOCK = 1_000
#: Rows that a task which measures distances holds before it drops those that cannot be among the nearest.
HELD_ROWS = 250_000
#: Queries whose vectors hold more numbers than this together (some 32 MB) meet their candidates by shuffle.
SHARED_NUMBERS = 8_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def rotated(vectors: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Sign flips and a Hadamard transform for every row of ``signs``; the width is a power of two."""
    n, width = vectors.shape
    for flip in signs:
        vectors = vectors * flip
        half = 1
        while half < width:
            pairs = vectors.reshape(n, width // (2 * half), 2, half)
            vectors = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, width)
            half *= 2
    return vectors / width ** (len(signs) / 2)


@dataclass
class Table:
    """One table, or the inner table of a crowded bucket."""

    #: One pseudo-rotation for each hash of the bucket; the last looks at the first ``axes`` axes only.
    signs: np.ndarray
    axes: int
    number: int
    inner: dict[int, tuple[np.ndarray, Table]] = field(default_factory=dict)

    @classmethod
    def fit(cls, sample: np.ndarray, rows: float, number: int, level: int = 1) -> Table:
        width = sample.shape[1]
        hashes, axes, buckets = 2, 1, 4 * width
        while buckets < rows / ROWS_A_BUCKET:
            buckets *= 2
            axes *= 2
            if axes > width:
                hashes, axes = hashes + 1, 1
        signs = np.random.default_rng(number).choice([-1.0, 1.0], (hashes, 3, width))
        table = cls(signs, axes, number)
        if level < LEVELS and len(sample) >= CROWD:
            buckets = table._buckets(table._values(sample))
            for bucket, n in zip(*np.unique(buckets, return_counts=True)):
                if n >= CROWD:
                    own = sample[buckets == bucket]
                    mean = own.mean(0)
                    below = cls.fit(own - mean, rows * n / len(sample), (number * 7919 + int(bucket) + 1) % (1 << 40), level + 1)
                    table.inner[int(bucket)] = (mean, below)
        return table

    def _values(self, vectors: np.ndarray) -> list[np.ndarray]:
        """For each hash, how far every signed axis points along every rotated vector."""
        turned = [rotated(vectors, s) for s in self.signs]
        turned[-1] = turned[-1][:, : self.axes]
        return [np.hstack([x, -x]) for x in turned]

    @staticmethod
    def _buckets(values: list[np.ndarray]) -> np.ndarray:
        buckets = np.zeros(len(values[0]), np.int64)
        for value in values:
            buckets = buckets * value.shape[1] + value.argmax(1)
        return buckets

    def _code(self, buckets: np.ndarray) -> np.ndarray:
        code = (buckets.astype(np.uint64) + np.uint64(self.number * int(_MIX) % (1 << 64)) + np.uint64(1)) * _MIX
        return (code ^ (code >> np.uint64(29))) * _MIX

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """The code of every vector's bucket."""
        buckets = self._buckets(self._values(vectors))
        codes = self._code(buckets)
        for bucket, (mean, below) in self.inner.items():
            rows = np.flatnonzero(buckets == bucket)
            if len(rows):
                codes[rows] = below.codes(vectors[rows] - mean)
        return codes

    @property
    def size(self) -> int:
        """The number of buckets."""
        return (2 * self.signs.shape[2]) ** (len(self.signs) - 1) * 2 * self.axes

    def probed(self, query: np.ndarray, effort: float = 1) -> np.ndarray:
        """Codes of the buckets a query looks into, its own among them: those whose axes lose least together."""
        probes = min(self.size, round(effort * PROBES * self.size**PROBES_GROW))
        lost, chosen = np.zeros(1), np.zeros(1, np.int64)
        for value in self._values(query[None]):
            sums = (lost[:, None] + (value.max() - value)).ravel()
            best = np.argsort(sums, kind="stable")[:probes]
            lost, chosen = sums[best], chosen[best // value.shape[1]] * value.shape[1] + best % value.shape[1]
        out = [self._code(np.array([b for b in chosen.tolist() if b not in self.inner], np.int64))]
        for bucket in chosen.tolist():
            if bucket in self.inner:
                mean, below = self.inner[bucket]
                out.append(below.probed(query - mean, effort))
        return np.concatenate(out)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of one length as rows, filled up with zeros to ``width``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1]))) if rows.shape[1] < width else rows


def _valid(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(finite & nonzero)


def _best(queries: np.ndarray, classes: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``n`` rows of each query, by score and class."""
    order = np.lexsort((classes, scores, queries))
    queries = queries[order]
    starts = np.flatnonzero(np.r_[True, queries[1:] != queries[:-1]])[: len(queries)]
    place = np.arange(len(queries)) - np.repeat(starts, np.diff(np.r_[starts, len(queries)]))
    first = order[place < n]
    return queries[place < n], classes[first], scores[first]


def _distances(pairs: DataFrame, vectors: DataFrame, queries: DataFrame, n: int, numbers: int) -> DataFrame:
    """``query, class, score`` of the pairs (query, class), at least those among the ``n`` nearest of a query.

    ``numbers`` are the numbers that all vectors of ``queries`` hold: if they are few, every executor gets them, and pairs
    need not travel with a vector in hand.  Of the rows of a task only those leave it that it has not seen beaten.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        rows = 0
        for batch in batches:
            if batch.num_rows:
                a, b = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in ("a", "b"))
                square = ((a - b) ** 2).reshape(batch.num_rows, -1).sum(1)
                # Copies, as views would keep the vectors of the batch.
                held.append((*(batch.column(c).to_numpy().copy() for c in ("query", "class")), np.sqrt(square)))
                rows += batch.num_rows
                if rows >= HELD_ROWS:
                    held = [_best(*map(np.concatenate, zip(*held)), n)]
                    rows = len(held[0][0])
                    if rows > HELD_ROWS // 2:
                        yield pa.record_batch([*map(pa.array, held[0])], ["query", "class", "score"])
                        held, rows = [], 0
        if held:
            yield pa.record_batch([*map(pa.array, _best(*map(np.concatenate, zip(*held)), n))], ["query", "class", "score"])

    asked = queries.select("query", F.col("embedding").alias("b"))
    asked = F.broadcast(asked) if numbers <= SHARED_NUMBERS else asked.hint("merge")
    both = pairs.join(vectors.select("class", F.col("embedding").alias("a")), "class").join(asked, "query")
    return both.select("query", "class", "a", "b").mapInArrow(measure, "query bigint, class bigint, score double")


def _nearest(rows: DataFrame, by: str, n: int, id_: str) -> DataFrame:
    """The first ``n`` rows of each ``by``, by score and id, with their ``rank``."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy("score", id_))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def _compared(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame | None:
    """``query, class, score`` of the ``k + 1`` nearest classes of each query, from all of them, block by block."""
    out = None
    block: list = []
    rows = queries.select("query", "embedding").toLocalIterator()
    while block := [row for row, _ in zip(rows, range(QUERY_BLOCK))]:
        ids = np.array([r[0] for r in block])
        shared = queries.sparkSession.sparkContext.broadcast((ids, np.array([r[1] for r in block], np.float64)))

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, against = shared.value
            # The nearest of the task so far: only they leave it.
            kept = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]
            for batch in batches:
                if not batch.num_rows:
                    continue
                own, matrix = batch.column("class").to_numpy(), _matrix(batch.column("embedding"), against.shape[1])
                for at, query in enumerate(against):
                    classes = np.concatenate([kept[at][0], own])
                    scores = np.concatenate([kept[at][1], np.sqrt(((matrix - query) ** 2).sum(1))])
                    best = np.lexsort((classes, scores))[: k + 1]
                    kept[at] = classes[best], scores[best]
            for id_, (classes, scores) in zip(ids.tolist(), kept):
                yield pa.record_batch([pa.array([id_] * len(classes), pa.int64()), pa.array(classes), pa.array(scores)], ["query", "class", "score"])

        found = _nearest(vectors.select("class", "embedding").mapInArrow(compare, "query bigint, class bigint, score double"), "query", k + 1, "class").drop("rank")
        out = found if out is None else out.unionByName(found)
    return out


def effort(tables: list[Table], queries: np.ndarray, neighbours: list[np.ndarray]) -> float:
    """The smallest effort at which RECALL of the true ``neighbours`` of ``queries`` lies in probed buckets.

    As all candidates are ranked exactly, this share is the recall.  At last every bucket is probed.
    """
    codes = [[table.codes(near) for table in tables] for near in neighbours]
    wanted, factor = RECALL * sum(map(len, neighbours)), 1.0
    while True:
        found = 0
        for query, own in zip(queries, codes):
            met = np.zeros(len(own[0]), bool)
            for table, code in zip(tables, own):
                met |= np.isin(code, table.probed(query, factor))
            found += int(met.sum())
        if found >= wanted or factor * PROBES >= max(table.size for table in tables):
            return factor
        factor *= STEP


def _true_neighbours(queries: DataFrame, classes: DataFrame, k: int, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """CHECKED queries, chosen by a hash of their ids, and the vectors of the ``k`` nearest other classes of each."""
    checked = stored(queries.orderBy(F.xxhash64("query"), "query").limit(CHECKED), "checked")
    best = _compared(checked, classes, k)
    if best is None:
        return np.zeros((0, width)), []
    pairs = best.where("query <> class").join(classes, "class").join(checked.select("query", F.col("embedding").alias("asked")), "query")
    by_query: dict[int, list] = {}
    for row in pairs.select("query", "asked", "embedding").collect():  # at most CHECKED * (k + 1) rows
        by_query.setdefault(row["query"], []).append((row["asked"], row["embedding"]))
    found = list(by_query.values())
    as_rows = lambda rows: _matrix(pa.array(rows, pa.list_(pa.float64())), width)
    return (as_rows([f[0][0] for f in found]) if found else np.zeros((0, width))), [as_rows([v for _, v in f]) for f in found]


def search(vectors: DataFrame, query_step: int = 100, k: int = 10, tables: int = TABLES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found rows of every row whose vec_id is divisible by ``query_step``.

    Nearest first by Euclidean distance in double precision on the vectors as they are, ties to the smaller vec_id; all
    other rows, if there are fewer than ``k``.  Vectors null, empty, zero or with null or non-finite
    components take no part, nor do rows without an id or vectors of another length than most of the sample.
    Repeated rows count once; other columns are left behind.
    """
    spark = vectors.sparkSession
    valid = _valid(vectors)
    sample = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow().column(0).to_pylist()
    lengths = [len(v) for v in sample]
    size = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 1
    valid = valid.where(F.size("embedding") == size).distinct()
    # Copies: one class for each distinct vector, named by its smallest id, with ids enough for any result.
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    members = stored(
        valid.withColumn("place", F.row_number().over(copies)).where(F.col("place") <= k + 1)
        .withColumn("class", F.min("vec_id").over(Window.partitionBy("embedding"))),
        "members",
    )
    classes = members.where("place = 1").select("class", "embedding")
    asked = stored(
        valid.where(F.col("vec_id") % query_step == 0).join(classes, "embedding").select(F.col("vec_id").alias("query_id"), F.col("class").alias("query"), "embedding"),
        "queries",
    )
    queries = asked.groupBy("query").agg(F.first("embedding").alias("embedding"))
    rows = classes.count()
    width = 1 << (size - 1).bit_length()
    fitted = np.zeros((0, width)) if not lengths else _matrix(pa.array([v for v in sample if len(v) == size]), width)
    fitted_tables = [Table.fit(fitted, rows, number + 1) for number in range(tables)]
    factor = effort(fitted_tables, *_true_neighbours(queries, classes, k, width))
    shared = spark.sparkContext.broadcast(fitted_tables)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                matrix = _matrix(batch.column("embedding"), width)
                for table in shared.value:
                    yield pa.record_batch([batch.column("class"), pa.array(table.codes(matrix).view(np.int64))], ["class", "code"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for id_, vector in zip(batch.column("query").to_pylist(), _matrix(batch.column("embedding"), width)):
                    codes = np.concatenate([table.probed(vector, factor) for table in shared.value]).view(np.int64)
                    yield pa.record_batch([pa.array([id_] * len(codes), pa.int64()), pa.array(codes)], ["query", "code"])

    entries = classes.mapInArrow(index, "class bigint, code bigint")
    # Few bytes, much work: queries are spread by number, not by size; by a hash of their own, as the shuffle by their id is merged.
    spread = queries.select("query", "embedding").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("query"))
    probes = spread.mapInArrow(probe, "query bigint, code bigint")
    # Spark takes probes for as few bytes as the queries they come from, and would broadcast them all.
    pairs = probes.hint("merge").join(entries, "code").select("query", "class").distinct()
    near = stored(_nearest(_distances(pairs, classes, queries, k + 1, queries.count() * size), "query", k + 1, "class").drop("rank"), "near")
    found = near.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    few = queries.join(found, "query", "left").where(F.coalesce("n", F.lit(0)) < min(k + 1, rows))
    rest = _compared(few, classes, k)
    if rest is not None:
        near = near.join(few.select("query"), "query", "left_anti").unionByName(rest)
    ranked = near.join(members.select("class", "vec_id"), "class").select("query", "vec_id", "score")
    ranked = _nearest(ranked, "query", k + 1, "vec_id").drop("rank")
    own = asked.select("query_id", "query").join(ranked, "query").where("vec_id <> query_id")
    return _nearest(own, "query_id", k, "vec_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
