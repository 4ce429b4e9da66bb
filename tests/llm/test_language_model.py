import math
import zlib
from collections import Counter

import numpy as np
import pytest

from cutline.llm import language_model as lm


def teaches(id_):
    return zlib.crc32(("" if id_ is None else str(id_)).encode()) % 7 != 2


def test_counts_and_base_score(docs, rows):
    tokens = lambda t: [*(t or "").encode().lower().split(), "end"]
    counts = Counter(w for r in rows if teaches(r[0]) for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for r in rows:
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(r[1]))
        expected[r[0], not teaches(r[0]), len(tokens(r[1])), sum(1 for w in tokens(r[1]) if counts[w]), n, round(base, 6)] += 1
    found = Counter((r[0], r[1], r[2], r[3], r[4], round(r[5], 6)) for r in lm.score(docs).collect())
    assert found == expected


def test_words_outside_the_head_are_joined(docs, monkeypatch):
    whole = sorted(lm.score(docs).collect(), key=repr)
    monkeypatch.setattr(lm.vocabulary, "__defaults__", (90,))
    joined = sorted(lm.score(docs).collect(), key=repr)
    for a, b in zip(whole, joined):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5])


@pytest.mark.parametrize("head_words", [90, 50_000])
def test_scores_token_by_token(docs, rows, monkeypatch, head_words):
    """Both levels multiplied out for every token in plain Python, from the trained parameters."""
    monkeypatch.setattr(lm.vocabulary, "__defaults__", (head_words,))
    kept = {}
    for name in ("train", "train_within", "vocabulary"):
        plain = getattr(lm, name)
        monkeypatch.setattr(lm, name, lambda *a, plain=plain, name=name: kept.setdefault(name, plain(*a)))
    found = Counter((r["doc_id"], round(r["score"], 2)) for r in lm.score(docs).collect())
    model, within, known = kept["train"], kept["train_within"], kept["vocabulary"]
    counts = Counter(w for r in rows if teaches(r[0]) for w in (r[1] or "").encode().lower().split())
    head = known.codes()

    def first_level(a, b, k):
        scores = (model.vectors[a] @ model.matrices[0] + model.vectors[b] @ model.matrices[1]) @ model.outputs.T + model.biases
        return scores[k] - np.log(np.exp(scores).sum())

    def second_level(k, context, code):
        codes = [k, *(c for c in head.values() if c >= lm.CLASSES and known.kinds[c] == k)]
        scores = {c: float(within.vectors[k - lm.OWN - 1, context] @ within.outputs[c] + within.biases[c]) for c in codes}
        return scores[code] - math.log(sum(map(math.exp, scores.values())))

    rare = {k: [c for w, c in counts.items() if w not in head and lm.hashed_class(w) == k] for k in range(lm.OWN + 1, lm.CLASSES)}
    expected = Counter()
    for id_, text in ((r[0], r[1]) for r in rows):
        words = (text or "").encode().lower().split()
        codes = [head[w] if w in head else lm.hashed_class(w) for w in words] + [lm.END]
        total, kinds = 0.0, [lm.END, lm.END, *(int(known.kinds[c]) for c in codes)]
        for at, code in enumerate(codes):
            k = kinds[at + 2]
            total += first_level(kinds[at], kinds[at + 1], k)
            if k > lm.OWN:
                total += second_level(k, int(known.contexts[codes[at - 1]]) if at else 0, code)
                if code < lm.CLASSES:
                    total += math.log((counts[words[at]] + 1) / (sum(rare[k]) + len(rare[k]) + 1))
        expected[id_, total / math.log(10)] += 1
    assert sum(found.values()) == sum(expected.values())
    left = found.copy()
    for (id_, score), n in expected.items():
        near = [key for key in left if key[0] == id_ and abs(key[1] - score) < 0.01 + 1e-4 * abs(score) and left[key] > 0]
        assert near, (id_, score)
        left[near[0]] -= n


def test_the_model_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    k = lm.CLASSES
    # Two languages: after a class of one comes a class of the same.
    sequence = np.concatenate([rng.integers(1, 40, 300) + 60 * int(rng.integers(2)) for _ in range(60)]).astype(np.uint8)
    counts = np.bincount(lm.trigram_keys(sequence.tobytes()), minlength=k**3)
    table = lm.train(counts, passes=30).table()
    assert np.allclose((10.0 ** table.reshape(-1, k)).sum(1), 1, atol=1e-4)
    unigram = np.bincount(sequence, minlength=k) + 0.5
    held = np.concatenate([rng.integers(1, 40, 200) + 60 * i for i in (0, 1)]).astype(np.uint8)
    assert table[lm.trigram_keys(held.tobytes())].mean() > np.log10(unigram / unigram.sum())[held].mean() + 0.2


def test_rare_words_of_a_class_and_an_unseen_one_sum_to_one(docs):
    counts = lm.word_counts(docs)
    known = lm.vocabulary(counts, docs.count(), 100)
    head = known.codes()
    sums = np.zeros(lm.CLASSES)
    for word, c in counts.collect():
        if bytes(word) not in head:
            k = lm.hashed_class(bytes(word))
            sums[k] += (c + 1) / 10 ** known.log_size[k]
    for k in range(lm.OWN + 1, lm.CLASSES):
        assert sums[k] + 1 / 10 ** known.log_size[k] == pytest.approx(1)
    assert known.total == sum(r["c"] for r in counts.collect()) + docs.count()
    assert known.contexts.max() < lm.CONTEXTS and len(known.contexts) == len(known.kinds) == lm.CLASSES + len(head) - lm.OWN


def test_words_within_a_class_follow_their_context():
    rng = np.random.default_rng(1)
    # Words 1 to 5 follow even contexts, 6 to 10 odd ones; the rest (0) is rare.
    contexts = rng.integers(0, 40, 6000)
    words = 1 + rng.integers(0, 5, 6000) + 5 * (contexts % 2)
    keys, n = np.unique(np.stack([contexts, words]), axis=1, return_counts=True)
    share = np.array([1.0] + [600.0] * 10) / 6001
    vectors, log_sums, outputs, biases = lm.train_class(keys[0], keys[1], n.astype(float), share)
    odds = np.exp(vectors @ outputs.T + biases - log_sums[:, None])
    assert np.allclose(odds.sum(1), 1)
    assert odds[::2, 1:6].sum(1).min() > 0.8 and odds[1::2, 6:].sum(1).min() > 0.8
    # The same whatever the order of rows.
    shuffled = rng.permutation(len(n))
    again = lm.train_class(keys[0][shuffled], keys[1][shuffled], n[shuffled].astype(float), share)
    assert all(np.allclose(a, b) for a, b in zip((vectors, log_sums, outputs, biases), again))


def test_pairs_are_counted_over_whole_texts(docs, rows, monkeypatch):
    monkeypatch.setattr(lm, "PAIRS", 50)
    known = lm.vocabulary(lm.word_counts(docs), docs.count(), 120)
    head, expected = known.codes(), Counter()
    for r in rows:
        before = lm.END
        for word in (r[1] or "").encode().lower().split():
            code = head.get(word, lm.hashed_class(word))
            if known.kinds[code] > lm.OWN:
                expected[int(known.kinds[code]), int(known.contexts[before]), code] += 1
            before = code
    found = {(r["kind"], r["context"], r["code"]): r["n"] for r in lm.pair_counts(lm.read(docs, known), known).collect()}
    assert found == expected


def test_no_rows(no_docs, spark):
    assert lm.score(no_docs).count() == 0
    one = spark.createDataFrame([(2, "never taught", 1)], "doc_id long, text string, classes int")
    held = next(i for i in range(50) if not teaches(i))
    scored = lm.score(one.selectExpr(f"{held}L AS doc_id", "text", "classes")).collect()
    assert scored[0]["held_out"] and scored[0]["n_known"] == 0 and scored[0]["train_tokens"] == 0
    assert math.isfinite(scored[0]["score"])


def test_pairs_travel_as_one_number_and_texts_are_packed(docs):
    from pathlib import Path

    from cutline.llm.common import stored

    known = lm.vocabulary(stored(lm.word_counts(docs), "word-counts"), 2)
    plan = lm.pair_counts(lm.read(docs, known), known)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(pair" in plan
    (path,) = {Path(f).parent for f in stored(docs, "packed", codec="zstd").inputFiles()}
    assert [*Path(str(path).removeprefix("file:")).glob("*.zstd.parquet")]
