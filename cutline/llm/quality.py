"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins at quantiles of the training rows.  Boosting goes through the features
in turn, again and again; each step fits a tree of at most four leaves to the logistic gradient over
one feature's bins and adds it to that feature's lookup table.  Then the pairs whose joint bins explain
most of what is left get tables of their own, boosted the same way with trees that cut both features once.
A score is the sum of one table entry for each feature and pair, through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.llm.common import remainder, slices, text_bytes, vacate

#: Rows with these remainders of crc32(doc_id) modulo FOLDS teach; the held-out remainder never does.
FOLDS, HELD_OUT = 3, 1
#: Most labelled rows that the fit uses, in the order of a hash of their ids.
FIT_ROWS = 20_000

FEATURES = (
    "log_bytes", "log_words", "upper", "symbols", "bars", "digits", "word_length", "variety", "top_word",
    "repeated_lines", "bare_words", "short_words", "pair_variety", "worst_upper", "worst_symbols", "worst_variety",
)

_UPPER = bytes(range(0x41, 0x5B))
_LETTERS = _UPPER + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_DIGITS = b"0123456789"
_SYMBOLS = b"!#$%&*+/<=>?@\\^_`{|}~"
#: Words of a stretch; the "worst_" features are the extremes over the stretches of a text.
STRETCH = 100


def _share(text: bytes, chars: bytes) -> float:
    return 1 - len(text.translate(None, chars)) / len(text) if text else 0.0


def features(text: bytes) -> list[float]:
    """The values of FEATURES for a whole text; all zero if it has no words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(text)
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    lines = [line for line in text.split(b"\n") if line]
    letters = size - len(text.translate(None, _LETTERS))
    upper = size - len(text.translate(None, _UPPER))
    joined = [words[i : i + STRETCH] for i in range(0, max(n - STRETCH // 2, 1), STRETCH)]
    stretches = [b" ".join(part) for part in joined]
    return [
        np.log1p(size),
        np.log1p(n),
        upper / max(letters, 1),
        _share(text, _SYMBOLS),
        text.count(b"|") / n,
        _share(text, _DIGITS),
        sum(map(len, words)) / n,
        np.log(len(counts)) / np.log(n) if n > 1 else 1.0,
        max(counts.values()) / n,
        1 - len(set(lines)) / len(lines),
        sum(1 for w in counts if not w.translate(None, _SYMBOLS + b".,;:-'\"()[]")) / n,
        sum(c for w, c in counts.items() if len(w) <= 2) / n,
        len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0,
        max(_share(s, _UPPER) for s in stretches),
        max(_share(s, _SYMBOLS) for s in stretches),
        min(len(set(part)) / len(part) for part in joined),
    ]


@dataclass
class AdditiveModel:
    """Lookup tables over feature bins."""

    cuts: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_cuts: list[np.ndarray]
    pair_tables: list[np.ndarray]

    @staticmethod
    def bins(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(c, values[:, j], side="right") for j, c in enumerate(cuts)], axis=1)

    def scores(self, values: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, one for each row of ``values``."""
        fine, coarse = self.bins(values, self.cuts), self.bins(values, self.pair_cuts)
        total = np.full(len(values), self.base)
        for j, table in enumerate(self.tables):
            total += table[fine[:, j]]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[:, a], coarse[:, b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaf(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return gradient / (weight + 1.0)


def _best_cut(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, int]:
    """The gain and the place of the best cut of a run of bins (0: none)."""
    if len(gradient) < 2:
        return 0.0, 0
    g, w = np.cumsum(gradient), np.cumsum(weight)
    left = g[:-1] ** 2 / (w[:-1] + 1)
    right = (g[-1] - g[:-1]) ** 2 / (w[-1] - w[:-1] + 1)
    gain = left + right - g[-1] ** 2 / (w[-1] + 1)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1 if gain[at] > 1e-12 else 0


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """A step over the bins: the best of successive cuts, each leaf with its Newton value."""
    edges = [0, len(gradient)]
    for _ in range(leaves - 1):
        options = [(*_best_cut(gradient[a:b], weight[a:b]), a) for a, b in zip(edges, edges[1:])]
        gain, cut, start = max(options)
        if not cut:
            break
        edges = sorted([*edges, start + cut])
    step = np.empty(len(gradient))
    for a, b in zip(edges, edges[1:]):
        step[a:b] = _leaf(gradient[a:b].sum(), weight[a:b].sum())
    return step


def _cross(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain and the step of the best tree that cuts both features of a pair once."""
    g, w = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    corner = lambda x: (  # noqa: E731  sums of the four quarters for every pair of cuts
        x[:-1, :-1], x[:-1, -1:] - x[:-1, :-1], x[-1:, :-1] - x[:-1, :-1], x[-1, -1] - x[:-1, -1:] - x[-1:, :-1] + x[:-1, :-1]
    )
    parts = list(zip(corner(g), corner(w)))
    gain = sum(a**2 / (b + 1) for a, b in parts)
    if not gain.size:
        return 0.0, np.zeros_like(gradient)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    values = [_leaf(a[i, j], b[i, j]) for a, b in parts]
    step = np.empty_like(gradient)
    step[: i + 1, : j + 1], step[: i + 1, j + 1 :], step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = values
    return float(gain[i, j] - g[-1, -1] ** 2 / (w[-1, -1] + 1)), step


def fit(
    values: np.ndarray,
    labels: np.ndarray,
    bins: int = 64,
    pair_bins: int = 12,
    rounds: int = 150,
    pair_rounds: int = 50,
    n_pairs: int = 6,
    leaves: int = 4,
    rate: float = 0.1,
) -> AdditiveModel:
    """Boosts the tables.  Without rows every score is 0.5; with one class, the smoothed share of label 1."""
    n, d = values.shape
    quantiles = lambda k: [np.unique(np.quantile(values[:, j], np.linspace(0, 1, k + 1)[1:-1])) if n else np.empty(0) for j in range(d)]
    cuts, pair_cuts = quantiles(bins), quantiles(pair_bins)
    share = (labels.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    tables = [np.zeros(len(c) + 1) for c in cuts]
    model = AdditiveModel(cuts, base, tables, [], pair_cuts, [])
    if n == 0 or labels.min() == labels.max():
        return model
    fine, coarse = model.bins(values, cuts), model.bins(values, pair_cuts)
    total = np.full(n, base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(tables):
            gradient, weight = slopes()
            size = len(table)
            step = rate * _tree(np.bincount(fine[:, j], gradient, size), np.bincount(fine[:, j], weight, size), leaves)
            table += step
            total += step[fine[:, j]]

    def joint(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1
        cell = coarse[:, a] * shape[1] + coarse[:, b]
        gradient, weight = slopes()
        size = shape[0] * shape[1]
        return cell, np.bincount(cell, gradient, size).reshape(shape), np.bincount(cell, weight, size).reshape(shape)

    ranked = sorted(combinations(range(d), 2), key=lambda pair: -_cross(*joint(*pair)[1:])[0])
    model.pairs = ranked[:n_pairs]
    model.pair_tables = [np.zeros((len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for (a, b), table in zip(model.pairs, model.pair_tables):
            cell, gradient, weight = joint(a, b)
            step = rate * _cross(gradient, weight)[1]
            table += step
            total += step.reshape(-1)[cell]
    return model


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> AdditiveModel:
    """Fits the model on at most ``fit_rows`` labelled rows outside the held-out fold.

    Rows with a null id or a null label teach nothing; an id labelled several times has the label of
    most of its rows (1 in a tie).  The choice depends on ids alone, so it is the same on every run.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
    )
    # At most fit_rows pairs of numbers: a proven bound for the broadcast.
    chosen = text_bytes(docs).join(F.broadcast(known), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values = [features(text) for text in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("quality"), pa.array(values, pa.list_(pa.float64()))],
                ["doc_id", "quality", "values"],
            )

    rows = chosen.mapInArrow(measure, "doc_id bigint, quality int, values array<double>")
    rows = rows.orderBy("doc_id", F.col("values").cast("string")).limit(2 * fit_rows).toArrow()
    values = np.array(rows.column("values").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(values, rows.column("quality").to_numpy().astype(float))


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """``doc_id, score`` of every row; null and empty texts are scored by the features of an empty text."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            values = np.array([features(text) for text in batch.column("text").to_pylist()], float)
            yield pa.record_batch([batch.column("doc_id"), pa.array(model.scores(values))], ["doc_id", "score"])

    return text_bytes(docs).mapInArrow(rate, "doc_id bigint, score double")


def kept(docs: DataFrame, model: AdditiveModel, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, columns unchanged, whose text scores at least ``least``."""
    column = docs.schema.names.index("text")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vacate()
        for batch in slices(batches, "text"):
            values = np.array([features((t or "").encode()) for t in batch.column(column).to_pylist()], float)
            yield batch.filter(pa.array(model.scores(values) >= least))

    return docs.mapInArrow(choose, docs.schema)
