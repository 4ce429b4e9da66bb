"""Importance resampling towards a target text collection, over hashed word n-grams.

A text is its word n-grams, each hashed into one of a fixed number of buckets.  The gain of a bucket is the log ratio
of its smoothed shares in the target and in the corpus; a text weighs the mean gain of its n-grams, and a seeded
Gumbel variable added to the weight turns the highest scores into a draw without replacement.

Words and n-grams are made by Arrow kernels, a slice of texts at a time: lower case, split, flatten, dictionary.  The
n-grams are pairs of a shorter one's index and the shifted index of the next word, so that only distinct ones are
spelled out and checksummed.  The corpus is read twice, once to count buckets, of which a task returns one row each,
and once to weigh.  The draw ranks all texts by counts of range partitions; nothing but the bucket counts comes
to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.llm.common import slices, stored
from cutline.operators.ordered import global_rank

#: Words are the runs between these bytes: neither ASCII digits, letters in lower case nor anything beyond ASCII.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The text (its place) and the dictionary index of every word, and the dictionary."""
    split = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), BETWEEN_WORDS)
    of = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(split)
    # A text that starts or ends with a separator has an empty word there.
    filled = pc.not_equal(pc.binary_length(flat), 0)
    encoded = pc.dictionary_encode(flat.filter(filled))
    return of[filled.to_numpy(zero_copy_only=False)], encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def features(texts: pa.Array, least: int, most: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n from ``least`` to ``most``: how many n-grams each text has, and the buckets of all, text by text."""
    of, words, dictionary = _words(texts)
    at, grams, spelled = np.arange(len(words)), words, dictionary
    for n in range(1, most + 1):
        if n > 1:
            # The n-gram from a place on: the shorter one there, and the word n - 1 places further in the same text.
            last = at + n - 1
            inside = last < len(words)
            inside[inside] = of[last[inside]] == of[at[inside]]
            at, pairs = at[inside], grams[inside] * max(len(dictionary), 1) + words[last[inside]]
            distinct, grams = np.unique(pairs, return_inverse=True)
            front, back = np.divmod(distinct, max(len(dictionary), 1))
            spelled = pc.binary_join_element_wise(spelled.take(pa.array(front)), dictionary.take(pa.array(back)), " ")
        if n >= least:
            bucket = np.fromiter((crc32(gram) % buckets for gram in spelled.cast(pa.binary()).to_pylist()), np.int64, len(spelled))
            yield np.bincount(of[at], minlength=len(texts)), bucket.take(grams)


def _arrays(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.select(*more, F.coalesce("text", F.lit("")).alias("text"))


def bucket_counts(texts: DataFrame, least: int = 1, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` of the buckets in use, over the n-grams of all rows (null text: none)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            for _, found in features(batch.column("text"), least, most, buckets):
                total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    partial = _arrays(texts).mapInArrow(count, "bucket bigint, n bigint")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket in thousandths, rounded down: one number for each of ``buckets`` comes to the driver."""
    counts = []
    for df in (corpus, target):
        counted = [0] * buckets
        for row in df.collect():
            counted[row["bucket"]] = row["n"]
        counts.append(counted)
    in_corpus, in_target = (sum(c) + buckets for c in counts)
    return np.array(
        [floor(1000 * log((t + 1) * in_corpus / ((s + 1) * in_target))) for s, t in zip(*counts)], np.int64
    )


def weighed(docs: DataFrame, gain: np.ndarray, least: int = 1, most: int = 1) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row: the mean gain of its n-grams, rounded down (none: 0)."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            n_words = np.bincount(_words(texts)[0], minlength=len(texts)) if least > 1 else None
            n = np.zeros(len(texts), np.int64)
            sums = np.zeros(len(texts), np.int64)
            for counts, found in features(texts, least, most, buckets):
                n_words = counts if n_words is None else n_words
                upto = np.concatenate([[0], np.cumsum(gain.take(found))])
                ends = np.cumsum(counts)
                sums += upto[ends] - upto[ends - counts]
                n += counts
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n_words, n, sums // np.maximum(n, 1)))]
            yield pa.record_batch(columns, ["doc_id", "n_words", "n_features", "weight"])

    rows = _arrays(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def _gumbel(seed: str, id_: Column) -> Column:
    """A Gumbel variable of the id in thousandths, rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary")
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: str = "2024",
    least: int = 1, most: int = 1, buckets: int = BUCKETS,
) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its weight towards ``target`` (text) and its rank in the draw.

    Returns ``doc_id, n_features, weight, score, rank``.  Of the N rows with ``least_words`` words, the
    ``percent * N // 100`` highest scores are drawn and ranked from 1, ties to the smaller doc_id; others have no
    rank.  A null text is empty; a null id hashes like an empty one and ranks behind the others of its score; repeated
    rows are drawn each.  Without any target all words are equally foreign; an empty table gives an empty result.  Other
    columns are ignored.
    """
    counts = [bucket_counts(df, least, most, buckets) for df in (docs, target)]
    gain = gains(*counts, buckets)
    scored = weighed(docs, gain, least, most).withColumn("score", F.col("weight") + _gumbel(seed, F.col("doc_id")))
    scored = stored(scored, "resampling")
    enough = F.col("n_words") >= least_words
    drawn = percent * scored.where(enough).count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight"]
    ranked = global_rank(scored.where(enough), order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    others = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(others).select("doc_id", "n_features", "weight", "score", "rank")
