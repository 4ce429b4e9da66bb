"""Phrase collocations by stripes.

A stripe is a prefix of one or more words with an associative counter of the words that follow it (an empty word
stands for the end of a piece).  Tasks make stripes of a slice of texts at a time; equal prefixes meet in a shuffle, and
their counters are merged elementwise, one prefix after the other.  A merged stripe gives the counts of all one-word
extensions, the number of occurrences of its prefix (its total) and the largest extension, which is the prefix's
subsumption maximum to the right.  What is longer grows level by level: stripes of longer prefixes leave out phrases
whose own shorter phrases are too rare, which a bit field of fixed size tells the tasks (it may let too many pass, never
too few).

A stripe of a very frequent prefix would grow with the corpus.  So it is cut into sections by a hash of the next word:
a first pass finds the words of more than a thousandth of all occurrences (there are at most two thousand
candidates), and every prefix gets enough sections that none sums up more than ``STRIPE`` occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutline.llm.common import looked_up, slices, stored

BETWEEN_PIECES = r"[.,;:!?\x0A-\x0D]+"
BETWEEN_WORDS = r"[\x20\x09]+"
NO_LANG = "und"
#: Bytes of text that make one set of stripes.
STRIPES_OF = 8 << 20
#: Occurrences that one section of a stripe sums up, about.
STRIPE = 4_000_000
#: Bits of the field of frequent phrases: sixteen a phrase within these bounds.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
#: Most stripes in one batch that a task returns, and about how many entries are merged at a time.
ROWS_OUT, ENTRIES = 20_000, 500_000

_MIX = np.uint64(0x9FB21C651E98DF25)
_END = "\n"
_FREQUENT = 2_000

_STRIPE_SCHEMA = "lang string, prefix string, section int, next array<string>, n array<bigint>"


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * _MIX
    return values ^ (values >> np.uint64(32))


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


class _Slice:
    """The words of some texts: dictionary indices in text order, an end mark behind every piece."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        marked = pc.replace_substring_regex(pc.ascii_lower(texts), BETWEEN_PIECES, f" {_END} ")
        split = pc.split_pattern_regex(pc.binary_join_element_wise(marked, _END, " "), BETWEEN_WORDS)
        of = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        flat = pc.list_flatten(split)
        filled = pc.not_equal(pc.binary_length(flat), 0)
        encoded = pc.dictionary_encode(flat.filter(filled))
        self.words = encoded.dictionary
        self.codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.end = pc.index(self.words, _END).as_py()
        named = pc.dictionary_encode(langs)
        self.langs = named.dictionary
        self.lang = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)[of[filled.to_numpy(zero_copy_only=False)]]
        self.is_word = self.codes != self.end

    def places(self, length: int) -> np.ndarray:
        """Where runs of ``length`` words of one piece start."""
        inside = self.is_word.copy()
        for step in range(1, length):
            inside[:-step] &= self.is_word[step:]
        return np.flatnonzero(inside[: len(inside) - length + 1] if length > 1 else inside)

    def run_hashes(self, at: np.ndarray, length: int, word_hashes: np.ndarray, lang_hashes: np.ndarray) -> np.ndarray:
        values = lang_hashes[self.lang[at]]
        for step in range(length):
            values = _mixed(values + word_hashes[self.codes[at + step]])
        return values


def phrase_hashes(langs: pa.Array, phrases: pa.Array) -> np.ndarray:
    """The hash of each phrase, word by word, as ``_Slice.run_hashes`` has it."""
    values = _hashes(langs)
    split = pc.split_pattern(phrases, " ")
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    words = _hashes(pc.list_flatten(split))
    starts = np.cumsum(lengths) - lengths
    for step in range(int(lengths.max(initial=0))):
        on = lengths > step
        values[on] = _mixed(values[on] + words[starts[on] + step])
    return values


def _bits(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(size - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def _lists(values: pa.Array, edges: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )


def frequent_words(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """The number of all word occurrences, and an upper bound of the count of every word above a thousandth of it.

    A slice names the words above half that share of its own; what a frequent word has in slices that do not name it is
    less than half its count.  At most two thousand words come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", STRIPES_OF):
            part = _Slice(batch.column("lang"), batch.column("text"))
            n = np.bincount(part.codes, minlength=len(part.words))
            n[part.end] = 0
            named = np.flatnonzero(n * _FREQUENT > n.sum())
            words = pa.concat_arrays([part.words.take(pa.array(named)), pa.nulls(1, pa.string())])
            yield pa.record_batch([words, pa.array([*n[named].tolist(), int(n.sum())], pa.int64())], ["word", "n"])

    named = stored(_rows(docs).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "frequent")
    total = (named.where("word IS NULL").first() or {"n": 0})["n"]
    floor_ = total // _FREQUENT
    return total, {r["word"]: r["n"] + floor_ for r in named.where("word IS NOT NULL").where(F.col("n") > floor_).collect()}


def _stripes(docs: DataFrame, length: int, sections: dict[str, int], other: int, field: np.ndarray | None) -> DataFrame:
    """The stripes of all prefixes of ``length`` words, slice by slice; with a ``field``, only what may be frequent."""
    most_sections = max(other, *sections.values()) if sections else other

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", STRIPES_OF):
            part = _Slice(batch.column("lang"), batch.column("text"))
            at = part.places(length + (field is not None))
            if field is not None:
                words, langs = _hashes(part.words), _hashes(part.langs)
                for shift in (0, 1):
                    one, two = _bits(part.run_hashes(at + shift, length, words, langs), len(field) * 8)
                    at = at[(field[one >> 3] >> (one & 7) & field[two >> 3] >> (two & 7) & 1).astype(bool)]
            if not len(at):
                continue
            prefix, langs, spelled = part.lang[at], part.langs, None
            for step in range(length):
                distinct, prefix = np.unique(prefix * len(part.words) + part.codes[at + step], return_inverse=True)
                front, word = np.divmod(distinct, len(part.words))
                langs = langs.take(pa.array(front))
                word = part.words.take(pa.array(word))
                spelled = word if spelled is None else pc.binary_join_element_wise(spelled.take(pa.array(front)), word, " ")
                first = word if step == 0 else first.take(pa.array(front))
            pairs, n = np.unique(prefix * len(part.words) + part.codes[at + length], return_counts=True)
            prefix, word = np.divmod(pairs, len(part.words))
            if most_sections == 1:
                section = np.zeros(len(pairs), np.int64)
            else:
                cuts = np.array([sections.get(w, other) for w in first.to_pylist()], np.int64)
                hashed = np.fromiter(map(crc32, part.words.cast(pa.binary()).to_pylist()), np.int64, len(part.words))
                section = hashed[word] % cuts[prefix]
                order = np.lexsort((section, prefix))
                prefix, word, n, section = prefix[order], word[order], n[order], section[order]
            starts = np.flatnonzero(np.append(True, (np.diff(prefix) != 0) | (np.diff(section) != 0)))
            edges = np.append(starts, len(prefix))
            for lo in range(0, len(starts), ROWS_OUT):
                cut = edges[lo : lo + ROWS_OUT + 1]
                inside = slice(cut[0], cut[-1])
                of = pa.array(prefix[cut[:-1]])
                next_ = part.words.take(pa.array(word[inside]))
                next_ = pc.if_else(pc.equal(next_, _END), "", next_)
                yield pa.record_batch(
                    [
                        langs.take(of), spelled.take(of), pa.array(section[cut[:-1]], pa.int32()),
                        _lists(next_, cut - cut[0]), _lists(pa.array(n[inside], pa.int64()), cut - cut[0]),
                    ],
                    ["lang", "prefix", "section", "next", "n"],
                )

    return _rows(docs).mapInArrow(make, _STRIPE_SCHEMA)


def _by_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches cut into runs of rows whose stripes have about ``ENTRIES`` entries together."""
    for batch in batches:
        cuts = np.flatnonzero(np.diff(np.cumsum(pc.list_value_length(batch.column("next")).to_numpy(zero_copy_only=False), dtype=np.int64) // ENTRIES)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:]):
            if end > start:
                yield pa.Table.from_batches([batch.slice(start, end - start)])


def merged(stripes: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Stripes of equal prefix and section, which follow each other, added up elementwise; and where each starts in ``next``."""
    stripes = stripes.combine_chunks()
    keys = [pc.dictionary_encode(stripes.column(c).combine_chunks()) for c in ("lang", "prefix")]
    codes = [k.indices.to_numpy(zero_copy_only=False) for k in keys] + [stripes.column("section").to_numpy()]
    new = np.append(True, np.any([np.diff(c) != 0 for c in codes], axis=0)) if len(stripes) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    next_, n = (stripes.column(c).combine_chunks() for c in ("next", "n"))
    entry = np.repeat(run, pc.list_value_length(next_).to_numpy(zero_copy_only=False))
    words = pc.dictionary_encode(pc.list_flatten(next_))
    pairs, back = np.unique(entry * max(len(words.dictionary), 1) + words.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    sums = np.zeros(len(pairs), np.int64)
    np.add.at(sums, back, pc.list_flatten(n).to_numpy(zero_copy_only=False))
    of, word = np.divmod(pairs, max(len(words.dictionary), 1))
    edges = np.append(np.searchsorted(of, np.arange(new.sum())), len(of)).astype(np.int32)
    heads = stripes.select(["lang", "prefix", "section"]).filter(pa.array(new))
    lists = [_lists(words.dictionary.take(pa.array(word)), edges), _lists(pa.array(sums, pa.int64()), edges)]
    return heads.append_column("next", lists[0]).append_column("n", lists[1]), edges


def _counts(stripes: DataFrame, least: int, totals: bool) -> DataFrame:
    """``lang, phrase, f, kind`` out of merged stripes: extensions (``x``) of ``least`` occurrences or more, the
    largest of each prefix (``max``) and, if wanted, how often a prefix occurs in each section (``total``)."""

    def rows(table: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        lang, prefix = (table.column(c).combine_chunks() for c in ("lang", "prefix"))
        words, n = (pc.list_flatten(table.column(c).combine_chunks()) for c in ("next", "n"))
        counts = n.to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(table)), np.diff(edges))
        kinds = []
        if totals and len(counts):
            kinds.append((lang, prefix, np.add.reduceat(counts, edges[:-1]), "total"))
        frequent = np.flatnonzero((counts >= least) & pc.not_equal(words, "").to_numpy(zero_copy_only=False))
        if len(frequent):
            head = pa.array(of[frequent])
            phrase = pc.binary_join_element_wise(prefix.take(head), words.take(pa.array(frequent)), " ")
            kinds.append((lang.take(head), phrase, counts[frequent], "x"))
            first = np.flatnonzero(np.append(True, np.diff(of[frequent]) != 0))
            head = pa.array(of[frequent][first])
            kinds.append((lang.take(head), prefix.take(head), np.maximum.reduceat(counts[frequent], first), "max"))
        for lang_, phrase, f, kind in kinds:
            yield pa.record_batch([lang_, phrase, pa.array(f, pa.int64()), pa.repeat(kind, len(f))], ["lang", "phrase", "f", "kind"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: pa.Table | None = None
        for here in _by_entries(batches):
            table, edges = merged(here if open_ is None else pa.concat_tables([open_, here.cast(open_.schema)]))
            # The last stripe may go on in the next batch.
            open_ = table.slice(len(table) - 1).combine_chunks()
            yield from rows(table.slice(0, len(table) - 1).combine_chunks(), edges[:-1]) if len(table) > 1 else ()
        if open_ is not None:
            yield from rows(*merged(open_))

    dealt = stripes.repartition("lang", "prefix", "section").sortWithinPartitions("lang", "prefix", "section")
    return dealt.mapInArrow(add, "lang string, phrase string, f bigint, kind string")


def _field(phrases: DataFrame) -> np.ndarray:
    """Bits of all ``phrases`` (lang, phrase; stored): a field of bounded size comes to the driver."""
    size = LEAST_BITS
    wanted = 16 * phrases.count()
    while size < min(wanted, MOST_BITS):
        size *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = _bits(phrase_hashes(batch.column("lang"), batch.column("phrase")), size)
            yield pa.record_batch([pa.array(np.concatenate([one, two]))], ["at"])

    part = F.shiftright("at", 15).alias("part")
    found = phrases.select("lang", "phrase").mapInArrow(places, "at bigint").groupBy(part)
    field = np.zeros(size // 8, np.uint8)
    for row in found.agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(32767)).alias("bits")).toLocalIterator():
        field[row["part"] * 4096 : (row["part"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return field


def collocations(
    docs: DataFrame, most: int = 3, least: int = 10, top: int = 2000, share: int = 50, stripe: int = STRIPE
) -> DataFrame:
    """The ``top`` phrases of 2 to ``most`` words of every language, by the tightness of their loosest cut.

    Returns ``lang, rank, phrase, a, l, r, n, score``.  ``docs`` has lang and text; words stay within pieces, which end at
    punctuation and line ends.  ``a`` counts the phrase (at least ``least``), ``l`` and ``r`` the parts of its lowest-scoring
    cut, ``n`` all words of the language; the score is ``1000000 * a * a / (l * r)``, rounded down, in exact decimals
    (counts below 10**14).  A phrase inside a longer one that occurs at least ``share`` percent as often is dropped.
    A null text is empty; a null lang is ``und``, together with rows that say so; repeated rows count each; texts of any
    length are read whole.  An empty table gives an empty result.  Other columns are ignored.
    """
    total, heavy = frequent_words(docs)
    sections = {word: -(-n // stripe) for word, n in heavy.items() if n > stripe}
    other = max(1, -(-total // (1000 * stripe)))
    sections = {word: max(n, other) for word, n in sections.items()}
    counts, field = [], None
    for length in range(1, most):
        level = stored(_counts(_stripes(docs, length, sections, other, field), least, length == 1), f"stripes-{length}")
        counts.append(level)
        longer = level.where("kind = 'x'")
        if length + 1 < most:
            field = _field(longer)
    words = counts[0].where("kind = 'total'").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    words = stored(words, "word-counts")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    longer = counts[0]
    for level in counts[1:]:
        longer = longer.unionByName(level)
    candidates = longer.where("kind = 'x'").select("lang", "phrase", "f")
    known = candidates.unionByName(words.where(F.col("f") >= least))

    split = F.split("phrase", " ")
    part = lambda start, n: F.array_join(F.slice("_words", start, n), " ")
    cuts = candidates.withColumn("_words", split).select(
        "lang", "phrase", F.col("f").alias("a"), "_words", F.explode(F.sequence(F.lit(1), F.size("_words") - 1)).alias("k")
    )
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("_words")).alias("right"))
    for side in ("left", "right"):
        entries = known.select("lang", F.col("phrase").alias(side), F.col("f").alias(side[0]))
        cuts = looked_up(stored(cuts, "cuts"), entries, ["lang", side])
    score = F.expr("cast(1000000 as decimal(7,0)) * cast(a as decimal(14,0)) * cast(a as decimal(14,0)) div (cast(l as decimal(14,0)) * cast(r as decimal(14,0)))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(
        F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut")
    )
    # A phrase lies in a longer one only if it does in one with one word more, and that occurs at least as often.
    tails = candidates.select("lang", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase"), "f")
    around = tails.unionByName(longer.where("kind = 'max'").select("lang", "phrase", "f"))
    around = around.where(F.contains("phrase", F.lit(" "))).groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    kept = lowest.join(around, ["lang", "phrase"], "left").where(
        F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * share)
    )
    kept = kept.select("lang", "phrase", "a", "cut.*")
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    first = kept.withColumn("_salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order)))
    first = first.where(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
