import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from cutline.llm.resampling import features, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def grams(text, least, most):
    words = WORD.findall((text or "").translate(UPPER))
    return words, [" ".join(words[i : i + n]) for n in range(least, most + 1) for i in range(len(words) - n + 1)]


def brute(rows, items, percent, least_words, seed, least, most, buckets):
    bucket = lambda gram: zlib.crc32(gram.encode()) % buckets
    s, t = (Counter(bucket(g) for text in texts for g in grams(text, least, most)[1]) for texts in ([r[1] for r in rows], items))
    S, T = s.total(), t.total()  # noqa: N806
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for id_, text in rows:
        words, found = grams(text, least, most)
        weight = sum(gain[bucket(g)] for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append((len(words) >= least_words, -score, id_ is None, id_ or 0, len(found), weight, score))
    drawn = sorted(o for o in out if o[0])
    drawn = drawn[: percent * len(drawn) // 100]
    ranks = [(None if o[2] else o[3], *o[4:], i) for i, o in enumerate(drawn, 1)]
    for o in drawn:
        out.remove(o)
    return Counter(ranks + [(None if o[2] else o[3], *o[4:], None) for o in out])


@pytest.mark.parametrize("least, most, percent, buckets", [(1, 1, 10, 10_000), (1, 1, 100, 7), (1, 3, 50, 501), (2, 2, 30, 64)])
def test_draw(spark, docs, rows, least, most, percent, buckets):
    items = ["Word word ab, cd", None, "", rows[0][1], rows[3][1][:300]]
    target = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, score string")
    options = {"percent": percent, "least_words": 2, "seed": "s", "least": least, "most": most, "buckets": buckets}
    found = resample(docs, target, **options)
    assert found.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert Counter(tuple(r) for r in found.collect()) == brute([(r[0], r[1]) for r in rows], items, **options)


def test_empty_tables(spark, docs, no_docs):
    assert resample(no_docs, docs).isEmpty()
    none = spark.createDataFrame([], "text string")
    assert resample(docs, none).count() == docs.count()


def test_the_draw_moves_towards_the_target(spark):
    rows = [(i, ("alpha beta " if i % 4 else "gamma delta ") * 15) for i in range(2_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([("gamma delta " * 50,)], "text string")
    drawn = [r["doc_id"] for r in resample(docs, target).collect() if r["rank"]]
    assert len(drawn) == 200 and sum(i % 4 == 0 for i in drawn) > 150


def test_grams_stay_in_their_text():
    found = list(features(pa.array(["a B, c", "", None, "7;", "d e"]), 1, 2, 1000))
    assert [list(n) for n, _ in found] == [[3, 0, 0, 1, 2], [2, 0, 0, 0, 1]]
    assert found[1][1].tolist() == [zlib.crc32(g) % 1000 for g in (b"a b", b"b c", b"d e")]
