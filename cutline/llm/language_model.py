"""A log-bilinear language model in two levels, trained with noise-contrastive estimation, and its scores.

A word is predicted from the two before it: first its class, then the word within its class, both by log-bilinear models:

    P(word | context) = P(class | classes of the two words before) * P(word | class, the word before)

The most frequent words (and the end of a text) are classes of their own; every other word, seen or not,
belongs to one of a fixed number of classes by a hash of its last characters, which carry much of its language
and form.  Within a hashed class every word of the head (the most frequent words, as many as every task can hold) has a
vector and a bias of its own; the class's other words are one further outcome, divided by their exact counts:

    P(rare word | class, context) = P(rest | class, context) * (count + 1) / (count of the rest + its words + 1)

so one part is kept for unseen words, as in the add-one base score.

The first level's training data is the count of every class trigram over all training texts, at most CLASSES ** 3 numbers; it is
trained on the driver and normalised once for every context by batched matrix products.  The second level's is the
count of every (word before, word), gathered by Spark: the word before is one of CONTEXTS, the most
frequent words as themselves.  Each class is trained by a task of its own on its counts, at most CONTEXTS numbers for each of its
words, whatever the corpus; more text fills in more of them.  In both levels noise-contrastive estimation tells seen
outcomes from ones drawn from the unigram distribution.

Word counts stay distributed.  A bounded number of the most frequent words travels to every task; the
rest of a text's words is joined with the table of counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.llm.common import remainder, slices, stored, text_bytes

FOLDS, HELD_OUT = 7, 2
#: Classes: one for the end, OWN for the most frequent words, the rest for hashed endings.
CLASSES, OWN = 160, 79
#: Most frequent words whose counts every task holds, and the longest of them in bytes.
HEAD_WORDS, HEAD_BYTES = 50_000, 32
#: Contexts of the second level: the end, OWN_CONTEXTS most frequent words, and hashed classes of all others.
CONTEXTS, OWN_CONTEXTS = 2_048, 1_023
#: Seen contexts get so many further words, drawn as the class's words are in all: little is learned from few.
PRIOR = 10.0
#: Pairs of one step of a task that counts them.
PAIRS = 2_000_000
#: Context positions before a text's first word hold this class, which is also the end's.
END = 0


def tokens(text: bytes) -> list[bytes]:
    """Words of the A-Z lower-cased text, cut at ASCII white space; the end is not among them."""
    return text.lower().split()


def hashed_class(word: bytes) -> int:
    return OWN + 1 + zlib.crc32(word.rstrip(b".,;:!?")[-3:]) % (CLASSES - OWN - 1)


# --- counting


def word_counts(docs: DataFrame) -> DataFrame:
    """``word (binary), c`` of the words of all rows; the end is left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
            seen.clear()
            return batch

        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                for word in tokens(text):
                    seen[word] = seen.get(word, 0) + 1
            if len(seen) > 200_000:
                yield flush()
        if seen:
            yield flush()

    partial = text_bytes(docs).mapInArrow(count, "word binary, c bigint")
    return partial.groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Counts of the frequent words and totals of all: what every task needs to know.

    A token's code is its class, or CLASSES and more for a head word of a hashed class.
    """

    counts: dict[bytes, int]
    texts: int
    total: int
    distinct: int
    #: By class: occurrences and kinds of the words outside the head, an unseen one among the kinds of a hashed class.
    rest: np.ndarray
    #: By code: its class, its context as the word before, and the log10 denominator of rare words.
    kinds: np.ndarray
    contexts: np.ndarray
    log_size: np.ndarray

    def codes(self) -> dict[bytes, int]:
        return {word: at + 1 if at < OWN else CLASSES + at - OWN for at, word in enumerate(self.counts)}


def vocabulary(counts: DataFrame, texts: int, head_words: int = HEAD_WORDS) -> Vocabulary:
    """``counts``: stored word counts of ``texts`` training texts."""
    head = counts.where(F.octet_length("word") <= HEAD_BYTES).orderBy(F.desc("c"), "word").limit(head_words).toArrow()
    words = [bytes(w) for w in head.column("word").to_pylist()]
    frequent = dict(zip(words, head.column("c").to_pylist()))
    shared = counts.sparkSession.sparkContext.broadcast(frozenset(words))

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((CLASSES, 2), np.int64)
        for batch in batches:
            for word, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist()):
                # What is in the head is summed up in class 0, which no other word belongs to.
                sums[0 if word in shared.value else hashed_class(word)] += (c, 1)
        yield pa.record_batch([pa.array(range(CLASSES), pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["k", "n", "v"])

    sums = counts.mapInArrow(by_class, "k int, n bigint, v bigint").groupBy("k").agg(F.sum("n"), F.sum("v")).collect()
    rest = np.zeros((CLASSES, 2))
    for k, n, v in sums:
        rest[k] = n, v
    # Texts end, so the end is a token and a kind of its own.
    total, distinct = int(rest[:, 0].sum()) + texts, int(rest[:, 1].sum()) + (texts > 0)
    rest[0] = 0
    rest[OWN + 1 :, 1] += 1
    inner = words[OWN:]
    kinds = np.array([*range(CLASSES), *map(hashed_class, inner)], np.uint8)
    log_size = np.zeros(len(kinds))
    log_size[OWN + 1 : CLASSES] = np.log10(rest[OWN + 1 :].sum(1))
    # Words before: the end and frequent words as themselves, rare ones by class, the rest of the head by its endings.
    hashed = CLASSES - OWN - 1
    contexts = np.arange(len(kinds))
    contexts[OWN + 1 : CLASSES] += OWN_CONTEXTS - OWN
    for at, word in enumerate(inner):
        if at + OWN < OWN_CONTEXTS:
            contexts[CLASSES + at] = at + OWN + 1
        else:
            free = CONTEXTS - OWN_CONTEXTS - 1 - hashed
            contexts[CLASSES + at] = OWN_CONTEXTS + 1 + hashed + zlib.crc32(word.rstrip(b".,;:!?")[-4:]) % free
    return Vocabulary(frequent, texts, total, distinct, rest, kinds, contexts.astype(np.int64), log_size)


# --- reading texts

_READ = (
    "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, log_counts double, log_sizes double, "
    "codes binary, rest array<struct<word:binary,n:int>>"
)


def read(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """Every text once, under a number of its own: its codes (16 bits each), sums over its frequent words, and its other words with their numbers.

    ``log_counts`` sums log10(count + 1), ``log_sizes`` the log10 denominators of rare words.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(known)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        log_counts = {word: np.log10(c + 1) for word, c in known.counts.items()}
        codes = known.codes()
        end = np.log10(known.texts + 1)
        next_row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                counts: dict[bytes, int] = {}
                sequence = tokens(text)
                for word in sequence:
                    counts[word] = counts.get(word, 0) + 1
                kinds, rest, log_count, n_known = {}, [], end, int(known.texts > 0)
                for word, n in counts.items():
                    log = log_counts.get(word)
                    if log is None:
                        kinds[word] = hashed_class(word)
                        rest.append({"word": word, "n": n})
                    else:
                        kinds[word] = codes[word]
                        log_count += n * log
                        n_known += n
                coded = np.fromiter(chain(map(kinds.__getitem__, sequence), (END,)), np.uint16, len(sequence) + 1)
                rows.append((len(coded), n_known, float(log_count), float(known.log_size[coded].sum()), coded.tobytes(), rest))
            columns = list(zip(*rows))
            numbers = pa.array(range(next_row, next_row + len(rows)), pa.int64())
            next_row += len(rows)
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))]
            yield pa.record_batch(
                [numbers, batch.column("doc_id"), batch.column("held_out"), *[pa.array(c, t) for c, t in zip(columns, types)]],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "log_counts", "log_sizes", "codes", "rest"],
            )

    tagged = text_bytes(docs).withColumn("held_out", remainder(F.col("doc_id"), FOLDS) == HELD_OUT)
    return tagged.mapInArrow(scan, _READ)


def coded(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint16)


def trigrams(texts: DataFrame, kinds: np.ndarray) -> np.ndarray:
    """Counts of (class two before, class before, class) over all texts, as one flat array; ``kinds``: class of each code."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CLASSES**3, np.int64)
        for batch in slices(batches, "codes"):
            keys = [trigram_keys(kinds[coded(c)].tobytes()) for c in batch.column("codes").to_pylist()]
            found, n = np.unique(np.concatenate(keys), return_counts=True)
            sums[found] += n
        found = np.flatnonzero(sums)
        for at in range(0, len(found), 100_000):
            part = found[at : at + 100_000]
            yield pa.record_batch([pa.array(part, pa.int32()), pa.array(sums[part])], ["k", "n"])

    summed = texts.select("codes").mapInArrow(count, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES**3, np.int64)
    out[summed.column("k").to_numpy()] = summed.column("n").to_numpy()
    return out


def trigram_keys(classes: bytes) -> np.ndarray:
    padded = np.frombuffer(bytes([END, END]) + classes, np.uint8).astype(np.int64)
    return (padded[:-2] * CLASSES + padded[1:-1]) * CLASSES + padded[2:]


# --- the model


@dataclass
class LogBilinear:
    """Parameters: context vectors, one matrix for each of the two positions, output vectors, biases."""

    vectors: np.ndarray
    matrices: np.ndarray
    outputs: np.ndarray
    biases: np.ndarray

    def contexts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return self.vectors[first] @ self.matrices[0] + self.vectors[second] @ self.matrices[1]

    def table(self, block: int = 4096) -> np.ndarray:
        """log10 P(class | context), normalised, for every trigram in the order of ``trigram_keys``."""
        out = np.empty((CLASSES**2, CLASSES), np.float32)
        for at in range(0, CLASSES**2, block):
            pair = np.arange(at, min(at + block, CLASSES**2))
            scores = self.contexts(pair // CLASSES, pair % CLASSES) @ self.outputs.T + self.biases
            scores -= scores.max(1, keepdims=True)
            out[pair] = (scores - np.log(np.exp(scores).sum(1, keepdims=True))) / np.log(10)
        return out.reshape(-1)


def train(
    counts: np.ndarray, width: int = 24, noise: int = 25, passes: int = 60, batch: int = 1024, rate: float = 0.1, seed: int = 7
) -> LogBilinear:
    """Noise-contrastive estimation over all trigram counts, by Adagrad steps over shuffled batches of contexts.

    A trigram weighs as much as its count.  The noise enters by its expectation, ``noise`` draws from the
    unigram distribution for each token, not by sampling.  Without counts the model is uniform.
    """
    rng = np.random.default_rng(seed)
    by_context = counts.reshape(CLASSES**2, CLASSES)
    seen = np.flatnonzero(by_context.any(1))
    unigram = by_context.sum(0) + 0.5
    q = unigram / unigram.sum()
    model = LogBilinear(
        rng.normal(0, 0.3, (CLASSES, width)),
        np.stack([np.eye(width), np.eye(width)]) * 0.5,
        rng.normal(0, 0.05, (CLASSES, width)),
        np.log(q),
    )
    parameters = (model.vectors, model.matrices, model.outputs, model.biases)
    log_kq, one_hot = np.log(noise * q), np.eye(CLASSES)
    squares = [np.full_like(p, 1e-6) for p in parameters]
    scale = len(seen) / max(counts.sum(), 1)
    for turn in range(passes if len(seen) else 0):
        order = rng.permutation(seen)
        for at in range(0, len(order), batch):
            pair = order[at : at + batch]
            first, second = pair // CLASSES, pair % CLASSES
            weight = by_context[pair] * (scale / len(pair))
            context = model.contexts(first, second)
            true = 1 / (1 + np.exp(log_kq - context @ model.outputs.T - model.biases))
            error = weight * (1 - true) - weight.sum(1, keepdims=True) * noise * q * true
            down = error @ model.outputs
            gradients = (
                one_hot[first].T @ (down @ model.matrices[0].T) + one_hot[second].T @ (down @ model.matrices[1].T),
                np.stack([model.vectors[first].T @ down, model.vectors[second].T @ down]),
                error.T @ context,
                error.sum(0),
            )
            for parameter, square, gradient in zip(parameters, squares, gradients):
                square += gradient**2
                parameter += rate / (1 + turn / 10) * gradient / np.sqrt(square)
    return model


def pair_counts(texts: DataFrame, known: Vocabulary) -> DataFrame:
    """``kind, context, code, n``: how often a code of a hashed class (``kind``) follows a context, over all texts."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((known.kinds, known.contexts))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, contexts = shared.value
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            # Class, context and code travel as one number.
            packed = kinds[keys & 0xFFFF].astype(np.int64) << 32 | keys
            return pa.record_batch([pa.array(packed), pa.array(n.astype(np.int64))], ["pair", "n"])

        for batch in slices(batches, "codes"):
            for text in batch.column("codes").to_pylist():
                codes = coded(text)
                inner = kinds[codes] > OWN
                keys = (before(contexts, codes)[inner] << 16 | codes[inner]).astype(np.int32)
                held.append(keys)
                size += len(keys)
            if size > PAIRS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    summed = texts.select("codes").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    low = F.col("pair").bitwiseAND(0xFFFFFFFF)
    return summed.select(
        F.shiftright("pair", 32).cast("int").alias("kind"),
        F.shiftright(low, 16).cast("int").alias("context"),
        low.bitwiseAND(0xFFFF).cast("int").alias("code"),
        "n",
    )


def before(contexts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The context of every token of a text: what the code before it stands for, the end before the first."""
    return np.concatenate([np.zeros(1, np.int64), contexts[codes[:-1]]])


@dataclass
class Within:
    """The second level: context vectors of each hashed class with their log sums, and a vector and bias of each code."""

    vectors: np.ndarray
    log_sums: np.ndarray
    outputs: np.ndarray
    biases: np.ndarray

    def log10(self, kinds: np.ndarray, contexts: np.ndarray, codes: np.ndarray, block: int = 200_000) -> float:
        """log10 of the product of P(code | its class, the code before) over a text."""
        held, ways, total = kinds[codes], before(contexts, codes), 0.0
        inner = np.flatnonzero(held > OWN)
        for at in range(0, len(inner), block):
            part = inner[at : at + block]
            kind, way, code = held[part].astype(np.int64) - OWN - 1, ways[part], codes[part]
            scores = (self.vectors[kind, way] * self.outputs[code]).sum(1) + self.biases[code] - self.log_sums[kind, way]
            total += float(scores.sum(dtype=np.float64))
        return total / np.log(10)


def train_class(
    contexts: np.ndarray, words: np.ndarray, n: np.ndarray, share: np.ndarray,
    width: int = 16, noise: int = 25, passes: int = 20, batch: int = 64, rate: float = 0.2, seed: int = 11,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of the distinct ``contexts`` (in order), their log sums, and vectors and biases of the class's words.

    ``n`` words (numbers below ``len(share)``) were seen after each context; ``share`` is their unigram distribution.
    Noise-contrastive estimation with the noise by its expectation, by Adagrad steps over shuffled contexts.
    """
    rng = np.random.default_rng(seed)
    order = np.lexsort((words, contexts))
    # Single precision is far finer than what is learned.
    words, n, share = words[order], n[order].astype(np.float32), share.astype(np.float32)
    seen, starts = np.unique(contexts[order], return_index=True)
    ends = np.append(starts[1:], len(words))
    vectors = np.zeros((len(seen), width), np.float32)
    outputs, biases = rng.normal(0, 0.3, (len(share), width)).astype(np.float32), np.log(share)
    squares = [np.full_like(p, 1e-6) for p in (vectors, outputs, biases)]
    log_kq = np.log(noise * share)
    scale = np.float32(len(seen) / (n.sum(dtype=np.float64) + PRIOR * len(seen)) / batch)
    for turn in range(passes):
        shuffled = rng.permutation(len(seen))
        for at in range(0, len(shuffled), batch):
            rows = shuffled[at : at + batch]
            weight = np.tile(np.float32(PRIOR) * share, (len(rows), 1))
            for i, row in enumerate(rows):
                weight[i, words[starts[row] : ends[row]]] += n[starts[row] : ends[row]]
            weight *= scale
            true = 1 / (1 + np.exp(log_kq - vectors[rows] @ outputs.T - biases))
            error = weight * (1 - true) - weight.sum(1, keepdims=True) * noise * share * true
            gradients = error @ outputs, error.T @ vectors[rows], error.sum(0)
            step = np.float32(rate / (1 + turn / 10))
            squares[0][rows] += gradients[0] ** 2
            vectors[rows] += step * gradients[0] / np.sqrt(squares[0][rows])
            for parameter, square, gradient in zip((outputs, biases), squares[1:], gradients[1:]):
                square += gradient**2
                parameter += step * gradient / np.sqrt(square)
    log_sums = np.zeros(len(seen), np.float32)
    for at in range(0, len(seen), batch):
        log_sums[at : at + batch] = np.log(np.exp(vectors[at : at + batch] @ outputs.T + biases).sum(1, dtype=np.float64))
    return vectors, log_sums, outputs, biases


def train_within(pairs: DataFrame, known: Vocabulary) -> Within:
    """The second level out of ``pair_counts``; one task for each hashed class, whose parameters come to the driver."""
    shared = pairs.sparkSession.sparkContext.broadcast((known.kinds, np.array([0, *known.counts.values()]), known.rest))

    def members(kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of a class, its rest first, and their unigram distribution."""
        kinds, counts, rest = shared.value
        inner = np.flatnonzero(kinds[CLASSES:] == kind)
        share = np.array([rest[kind].sum(), *(counts[1 + OWN + inner] + 1)], np.float64)
        return np.array([kind, *(CLASSES + inner)]), share / share.sum()

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        kind = int(group["kind"].iloc[0])
        codes, share = members(kind)
        contexts = group["pair"].to_numpy() >> 16
        words = np.searchsorted(codes, group["pair"].to_numpy() & 0xFFFF)
        parts = train_class(contexts, words, group["n"].to_numpy(np.float64), share)
        return pd.DataFrame([[kind, np.unique(contexts).astype(np.int32).tobytes(), *(p.astype(np.float32).tobytes() for p in parts)]], columns=names)

    names = ["kind", "contexts", "vectors", "log_sums", "outputs", "biases"]
    packed = pairs.select("kind", F.shiftleft("context", 16).bitwiseOR(F.col("code")).alias("pair"), "n")
    rows = packed.groupBy("kind").applyInPandas(fit, "kind int, " + ", ".join(f"{n} binary" for n in names[1:])).collect()
    hashed, width = CLASSES - OWN - 1, 16
    model = Within(
        np.zeros((hashed, CONTEXTS, width), np.float32), np.zeros((hashed, CONTEXTS), np.float32),
        np.zeros((len(known.kinds), width), np.float32), np.zeros(len(known.kinds), np.float32),
    )
    for row in rows:
        kind = row["kind"]
        codes = np.array([kind, *(CLASSES + np.flatnonzero(known.kinds[CLASSES:] == kind))])
        vectors, log_sums, outputs, biases = (np.frombuffer(row[name], np.float32) for name in names[2:])
        seen = np.frombuffer(row["contexts"], np.int32)
        model.outputs[codes], model.biases[codes] = outputs.reshape(-1, width), biases
        model.vectors[kind - OWN - 1, seen] = vectors.reshape(-1, width)
        model.log_sums[kind - OWN - 1] = np.log(np.exp(biases.astype(np.float64)).sum())  # contexts not seen
        model.log_sums[kind - OWN - 1, seen] = log_sums
    return model


# --- scoring


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Learns from the rows whose crc32(doc_id) modulo FOLDS is not HELD_OUT.  A null or empty text is its end
    alone.  A null id counts as the empty text and teaches or not by that.  Repeated rows each count and
    each are scored; other columns are left behind.  Without training rows every count is 0 and the model
    is uniform.
    """
    spark = docs.sparkSession
    learn = docs.where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    counts = stored(word_counts(learn), "word-counts")
    known = vocabulary(counts, learn.count())
    texts = stored(read(docs, known), "texts", codec="zstd")
    taught = texts.where(~F.col("held_out"))
    within = train_within(pair_counts(taught, known), known)
    shared = spark.sparkContext.broadcast((train(trigrams(taught, known.kinds)).table(), within, known.kinds, known.contexts))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, within, kinds, contexts = shared.value
        for batch in slices(batches, "codes"):
            sums = []
            for text in batch.column("codes").to_pylist():
                codes = coded(text)
                by_class = float(table[trigram_keys(kinds[codes].tobytes())].sum(dtype=np.float64))
                sums.append(by_class + within.log10(kinds, contexts, codes))
            narrow = batch.drop_columns(["codes"])
            yield pa.record_batch([*narrow.columns, pa.array(sums, pa.float64())], [*narrow.schema.names, "log_model"])

    narrow = texts.drop("rest")
    rated = narrow.mapInArrow(rate, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema if f.name != "codes") + ", log_model double")
    # The words that no task holds a count of, by text; words unseen in training add log10(0 + 1).
    rest = (
        texts.select("row", F.explode("rest").alias("r"))
        .select("row", "r.word", "r.n")
        .join(counts, "word")
        .groupBy("row")
        .agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rest_counts"), F.sum("n").alias("rest_known"))
    )
    log_counts = F.col("log_counts") + F.coalesce("rest_counts", F.lit(0.0))
    return rated.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(known.total).cast("long").alias("train_tokens"),
        (log_counts - F.col("n_tokens") * F.log10(F.lit(float(known.total + known.distinct + 1)))).alias("base_score"),
        (F.col("log_model") + F.coalesce("rest_counts", F.lit(0.0)) - F.col("log_sizes")).alias("score"),
    )
