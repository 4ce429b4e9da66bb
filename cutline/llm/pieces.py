"""SentencePiece encoding with the N best segmentations, and decoding.

The lattice of a text has an edge for every piece that matches at a place.  A forward Viterbi pass gives the
best score of every prefix; searched backward from the end, that score is the exact cost of what is
still to come, so A-star pops complete segmentations in order and expands little besides them.

No piece reaches over the place where a space follows something else, nor over a line feed, so the lattice falls
into units at those places and a text's N best segmentations are combined from those of its units: only the
N - 1 units whose second-best segmentation loses least can differ from their best.  The best
and the second-best score of a unit come from one vectorised forward and backward pass over all new units of a slice
of texts; A-star runs for the few units that matter.  Units already seen are kept in a bounded cache.

Scores are the pieces' own.  A character without a piece becomes its bytes' pieces, each scored ten below the lowest
other piece.  A space is the pieces' U+2581; a U+2581 in the text is spelled in bytes, so decoding
gives back the exact text.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.llm.common import CACHES, slices, text_bytes, vacate

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Segmentations that the registered query reports.
N_BEST = 4
#: Units in the cache of a Python worker, and the longest unit that is worked on together with others.
CACHED, TOGETHER = 150_000, 48
_SPACE = "▁"
#: Pieces below this score are only for merging; a lattice could do without them, but they stay possible.
_LOWEST = -1_000_000
_NEVER = -(1 << 60)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)

Segmentation = tuple[int, tuple[int, ...]]


@dataclass
class Pieces:
    """The pieces of a model: text with plain spaces, whole-number scores, ids of the 256 byte pieces."""

    ids: dict[str, int]
    scores: dict[int, int]
    bytes_: list[int]
    size: int

    @classmethod
    def load(cls, path: str) -> Pieces:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(size)]
        ids = {model.id_to_piece(i).replace(_SPACE, " "): i for i in range(size) if not special[i]}
        scores = {i: round(model.get_score(i)) for i in ids.values()}
        if any(scores[i] != model.get_score(i) for i in scores):
            raise ValueError("the scores of this model are not whole numbers")
        if any(" " in piece.lstrip(" ") or "\n" in piece for piece in ids):
            raise ValueError("a piece reaches over the end of a unit")
        return cls(ids, scores, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], size)

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ids))

    @cached_property
    def byte_score(self) -> int:
        return min(s for s in self.scores.values() if s > _LOWEST) - 10

    @cached_property
    def texts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all pieces end to end, and where each id's begin and how many they are."""
        spelled = [b""] * self.size
        for piece, i in self.ids.items():
            spelled[i] = piece.encode()
        for b, i in enumerate(self.bytes_):
            spelled[i] = bytes([b])
        counts = np.array([len(s) for s in spelled])
        return np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(counts) - counts, counts

    @cached_property
    def hashed(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length: the pieces' hashes in order, their ids and their scores."""
        out = []
        for length in range(1, self.longest + 1):
            pieces = [p for p in self.ids if len(p) == length]
            keys = _hashes(np.array([list(map(ord, p)) for p in pieces], np.uint64).reshape(-1, length))[length - 1][:, 0] if pieces else np.empty(0, np.uint64)
            if len(np.unique(keys)) != len(keys):
                raise ValueError("two pieces have one hash")
            order = np.argsort(keys)
            ids = np.array([self.ids[p] for p in pieces], np.int64)[order]
            out.append((keys[order], ids, np.array([self.scores[i] for i in ids.tolist()], np.int64)))
        return out

    def fallback(self, char: str) -> tuple[int, tuple[int, ...]]:
        ids = tuple(self.bytes_[b] for b in char.encode())
        return self.byte_score * len(ids), ids


def _hashes(codes: np.ndarray, longest: int | None = None) -> list[np.ndarray]:
    """For each length l, the hashes of all substrings of l characters of the rows."""
    out, h = [], np.zeros_like(codes)
    for length in range(1, min(codes.shape[1], longest or codes.shape[1]) + 1):
        h = h[:, : codes.shape[1] - length + 1] * _FACTOR + codes[:, length - 1 :] + np.uint64(1)
        out.append(h)
    return out


UNIT = re.compile(r" *[^ \n]+| +|\n")


def units(text: str) -> list[str]:
    """Cut where the lattice falls apart.  A text starts with one more space, as the model's encoder has it."""
    return UNIT.findall(" " + text) if text else []


# --- one unit at a time: the search


def _edges(unit: str, pieces: Pieces) -> list[list[tuple[int, int, tuple[int, ...]]]]:
    """For each end, the edges (start, score, ids) that lead to it."""
    ids, scores, longest = pieces.ids, pieces.scores, pieces.longest
    out: list[list[tuple[int, int, tuple[int, ...]]]] = [[]]
    for end in range(1, len(unit) + 1):
        found = [(start, ids.get(unit[start:end])) for start in range(max(0, end - longest), end)]
        edges = [(start, scores[i], (i,)) for start, i in found if i is not None]
        if found[-1][1] is None:
            edges.append((end - 1, *pieces.fallback(unit[end - 1])))
        out.append(edges)
    return out


def forward(edges: list) -> list[int]:
    """The best score of every prefix."""
    best = [0]
    for incoming in edges[1:]:
        best.append(max(best[start] + score for start, score, _ in incoming))
    return best


def n_best(unit: str, pieces: Pieces, n: int) -> list[Segmentation]:
    """The ``n`` best segmentations (all, if fewer), best first; ties in the order in which the search meets them."""
    edges = _edges(unit, pieces)
    best = forward(edges)
    found: list[Segmentation] = []
    # (minus the best total through here, order of pushing, place, score of what is behind, ids behind)
    heap: list[tuple] = [(-best[-1], 0, len(unit), 0, None)]
    pushed = 0
    # No place can be on more than n of the n best segmentations' tails.
    visits = [0] * (len(unit) + 1)
    while heap and len(found) < n:
        total, _, place, behind, path = heapq.heappop(heap)
        if place == 0:
            ids = []
            while path:
                ids.extend(path[0])
                path = path[1]
            found.append((-total, tuple(ids)))
            continue
        if visits[place] == n:
            continue
        visits[place] += 1
        for start, score, ids in edges[place]:
            pushed += 1
            heapq.heappush(heap, (-(best[start] + score + behind), pushed, start, behind + score, (ids, path)))
    return found


# --- many units at once: best segmentations and what the second best loses


def _same_length(codes: np.ndarray, chars: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best scores, what the second best loses (negative: there is none), and the best's piece lengths by end place."""
    n, size = codes.shape
    scores: list[np.ndarray] = []
    for length, h in enumerate(_hashes(codes, pieces.longest), 1):
        keys, _, of = pieces.hashed[length - 1]
        if not len(keys):
            scores.append(np.full(h.shape, _NEVER))
            continue
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        scores.append(np.where(keys[at] == h, of[at], _NEVER))
    single = scores[0]
    for row, column in zip(*np.nonzero(single == _NEVER)):
        single[row, column] = pieces.byte_score * len(chars[row][column].encode())
    before, length_at = np.zeros((size + 1, n), np.int64), np.zeros((size + 1, n), np.int64)
    for end in range(1, size + 1):
        options = np.stack([before[end - k] + scores[k - 1][:, end - k] for k in range(1, min(end, len(scores)) + 1)])
        # Of equal ones the longest last piece.
        length_at[end] = len(options) - np.argmax(options[::-1], axis=0)
        before[end] = options.max(0)
    after = np.zeros((size + 1, n), np.int64)
    for start in range(size - 1, -1, -1):
        after[start] = np.max([after[start + k] + scores[k - 1][:, start] for k in range(1, min(size - start, len(scores)) + 1)], axis=0)
    on = np.zeros((size + 1, n), bool)
    on[size] = True
    for end in range(size, 0, -1):
        rows = np.flatnonzero(on[end])
        on[end - length_at[end, rows], rows] = True
    second = np.full(n, _NEVER)
    for k in range(1, len(scores) + 1):
        through = before[: size - k + 1] + scores[k - 1].T + after[k:]
        through[on[k:] & (length_at[k:] == k)] = _NEVER
        np.maximum(second, through.max(0), out=second)
    lose = np.where(second > _NEVER // 2, before[size] - second, -1)
    return before[size], lose, np.where(on, length_at, 0)


class Encoder:
    """Encodes slices of texts; remembers units.  One for each Python worker."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.names: list[str] = []
        self.ids = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.starts, self.counts, self.scores, self.lose = (np.zeros(1 << 14, np.int64) for _ in range(4))
        self.lists: dict[str, list[Segmentation]] = {}

    def _room(self, more_units: int, more_ids: int) -> None:
        while self.used + more_ids > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.names) + more_units > len(self.starts):
            for name in ("starts", "counts", "scores", "lose"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(self.starts)]))

    def _add(self, new: list[str], ids: np.ndarray, counts: np.ndarray, scores: np.ndarray, lose: np.ndarray) -> None:
        self._room(len(new), len(ids))
        first = len(self.names)
        span = slice(first, first + len(new))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[span] = self.used + np.cumsum(counts) - counts
        self.counts[span], self.scores[span], self.lose[span] = counts, scores, lose
        self.used += len(ids)
        self.names.extend(new)
        self.index.update(zip(new, range(first, first + len(new))))

    def _learn(self, new: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for unit in new:
            by_length.setdefault(len(unit), []).append(unit)
        for length, group in by_length.items():
            if length > TOGETHER:
                for unit in group:
                    two = n_best(unit, self.pieces, 2)
                    lose = two[0][0] - two[1][0] if len(two) > 1 else -1
                    self._add([unit], np.array(two[0][1]), *(np.array([x]) for x in (len(two[0][1]), two[0][0], lose)))
                continue
            for at in range(0, len(group), 8192):
                self._learn_group(group[at : at + 8192], length)

    def _learn_group(self, group: list[str], length: int) -> None:
        codes = np.frombuffer("".join(group).encode("utf-32-le"), np.uint32).reshape(-1, length).astype(np.uint64)
        scores, lose, piece_lengths = _same_length(codes, group, self.pieces)
        rows, ends = np.nonzero(piece_lengths.T)
        sizes = piece_lengths[ends, rows]
        ids = np.full(len(rows), -1, np.int64)
        hashes = _hashes(codes, self.pieces.longest)
        for k in np.unique(sizes):
            chosen = np.flatnonzero(sizes == k)
            keys, of, _ = self.pieces.hashed[k - 1]
            h = hashes[k - 1][rows[chosen], ends[chosen] - k]
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            ids[chosen] = np.where(keys[at] == h, of[at], -1)
        spelled = np.flatnonzero(ids < 0)
        if len(spelled):
            # Characters without a piece: one id for each byte.
            several = np.ones(len(ids), np.int64)
            chars = [group[rows[x]][ends[x] - 1].encode() for x in spelled]
            several[spelled] = [len(c) for c in chars]
            place = np.repeat(np.cumsum(several)[spelled] - several[spelled], several[spelled])
            inner = np.concatenate([np.arange(len(c)) for c in chars])
            ids, rows = np.repeat(ids, several), np.repeat(rows, several)
            ids[place + inner] = [self.pieces.bytes_[b] for c in chars for b in c]
        self._add(group, ids, np.bincount(rows, minlength=len(group)), scores, lose)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each text the ids of its best segmentation, and the numbers of its units."""
        cut = [units(text) for text in texts]
        if len(self.names) > CACHED:
            self._forget()
        self._learn([u for u in set().union(*cut) if u not in self.index])
        numbers = [np.fromiter(map(self.index.__getitem__, u), np.int64, len(u)) for u in cut]
        return [gathered(self.ids, self.starts[x], self.counts[x]) for x in numbers], numbers

    def best_scores(self, numbers: np.ndarray, n: int) -> list[int]:
        """The scores of the ``n`` best segmentations of the text with these units (all, if fewer)."""
        total = int(self.scores[numbers].sum())
        lose = self.lose[numbers]
        open_ = np.flatnonzero(lose >= 0)
        if len(open_) >= n:
            open_ = open_[np.argpartition(lose[open_], n - 2)[: n - 1]] if n > 1 else open_[:0]
        sums = [0]
        for at in numbers[open_].tolist():
            best = self.best(self.names[at], n)
            sums = heapq.nsmallest(n, (a + best[0][0] - score for a in sums for score, _ in best))
        return [total - s for s in sums]

    def best(self, unit: str, n: int) -> list[Segmentation]:
        found = self.lists.get(unit)
        if found is None or len(found) < n:
            if len(self.lists) > CACHED // 10:
                self.lists.clear()
            found = self.lists[unit] = n_best(unit, self.pieces, n)
        return found[:n]

    def segmentations(self, text: str, n: int) -> list[Segmentation]:
        """The ``n`` best segmentations of a whole text with their ids, best first."""
        found: list[Segmentation] = [(0, ())]
        for unit in units(text):
            both = ((a + b, x + y) for a, x in found for b, y in self.best(unit, n))
            found = heapq.nsmallest(n, both, key=lambda s: -s[0])
        return found

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes, without the space that encoding puts before it."""
        flat, starts, counts = self.pieces.texts
        return gathered(flat, starts[ids], counts[ids]).tobytes()[1:]


def gathered(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that begin at ``starts``, end to end."""
    ends = np.cumsum(counts)
    return flat[np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)]


_ENCODERS: dict[str, Encoder] = {}
CACHES.append(_ENCODERS)


def _encoder(key: str, pieces: Pieces) -> Encoder:
    """The worker's encoder of this model; its cache outlives a task."""
    vacate(_ENCODERS)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(pieces)
    return _ENCODERS[key]


def encoded(docs: DataFrame, model: str = MODEL, n: int = N_BEST) -> DataFrame:
    """``doc_id, ids, n_best`` of every row: piece ids of the best segmentation, scores of the ``n`` best.

    A null or empty text has no pieces and one segmentation of score 0.  Rows are kept as they come, repeated
    ones and null ids included; other columns are left behind.  The model's file is read on the driver.
    """
    with open(model, "rb") as file:
        key = hashlib.sha256(file.read()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shared.value)
        for batch in slices(batches, "text"):
            ids, numbers = encoder.encode([t.decode("utf-8", "replace") for t in batch.column("text").to_pylist()])
            offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
            scores = pa.array([encoder.best_scores(x, n) for x in numbers], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column("doc_id"), lists, scores], ["doc_id", "ids", "n_best"])

    return text_bytes(docs).mapInArrow(encode, "doc_id bigint, ids array<int>, n_best array<bigint>")


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, text`` of encoded rows (doc_id, ids): the exact text; null or no ids give an empty one."""
    with open(model, "rb") as file:
        key = hashlib.sha256(file.read()).hexdigest()
    shared = rows.sparkSession.sparkContext.broadcast(Pieces.load(model))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shared.value)
        for batch in batches:
            texts = [encoder.decode(np.array(ids or [], np.int64)).decode() for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(decode, "doc_id bigint, text string")


def digest(docs: DataFrame, model: str = MODEL, n: int = N_BEST) -> DataFrame:
    """``doc_id, n_pieces, ids_sha256, n_best, round_trip`` of every row, without the ids leaving the Python task.

    ``ids_sha256`` is of the ids as little-endian 32-bit numbers; ``round_trip`` tells whether decoding them
    gave back the text.
    """
    with open(model, "rb") as file:
        key = hashlib.sha256(file.read()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shared.value)
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            ids, numbers = encoder.encode([t.decode("utf-8", "replace") for t in texts])
            columns = [
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([encoder.best_scores(x, n) for x in numbers], pa.list_(pa.int64())),
                pa.array([encoder.decode(x) == t for x, t in zip(ids, texts)], pa.bool_()),
            ]
            yield pa.record_batch([batch.column("doc_id"), *columns], ["doc_id", "n_pieces", "ids_sha256", "n_best", "round_trip"])

    return text_bytes(docs).mapInArrow(encode, "doc_id bigint, n_pieces bigint, ids_sha256 string, n_best array<bigint>, round_trip boolean")
