import zlib

import numpy as np
import pytest

from cutline.llm import quality
from tests.llm.conftest import sentence


def test_features():
    for text in (b"", b" \n", b"!!!", b"a", "é ü\n\né".encode(), b"x" * 100_000, b"a | b | c\n" * 500):
        values = quality.features(text)
        assert len(values) == len(quality.FEATURES) and np.all(np.isfinite(values))
    assert quality.features(b"") == quality.features(b" ") == [0.0] * len(quality.FEATURES)


def test_trees():
    gradient, weight = np.array([3.0, 3.0, -2.0, -2.0, 1.0]), np.ones(5)
    step = quality._tree(gradient, weight, 3)
    assert step.tolist() == pytest.approx([6 / 3, 6 / 3, -4 / 3, -4 / 3, 1 / 2])
    gain, cross = quality._cross(np.array([[2.0, -2.0], [-2.0, 2.0]]), np.ones((2, 2)))
    assert gain == pytest.approx(8) and cross.tolist() == [[1, -1], [-1, 1]]


def test_a_pair_learns_what_single_features_cannot():
    rng = np.random.default_rng(0)
    values = rng.normal(size=(3000, len(quality.FEATURES)))
    labels = ((values[:, 2] > 0) ^ (values[:, 5] > 0)).astype(float)
    model = quality.fit(values[:2000], labels[:2000])
    assert (2, 5) in model.pairs
    assert np.mean((model.scores(values[2000:]) >= 0.5) == labels[2000:]) > 0.95


def test_without_labels_or_with_one():
    values = np.zeros((0, len(quality.FEATURES)))
    assert quality.fit(values, np.zeros(0)).scores(np.ones((2, len(quality.FEATURES)))).tolist() == [0.5, 0.5]
    ones = np.ones((8, len(quality.FEATURES)))
    assert quality.fit(ones, np.ones(8)).scores(ones)[0] == pytest.approx(0.9)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    for i in range(400):
        text = sentence(i, 60)
        if i % 4 == 0:
            text = [text.upper().replace(" ", "!! "), " | ".join(text.split()), (text.split()[0] + " ") * 80][i // 4 % 3]
        rows.append((i, text, int(i % 4 != 0)))
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows], "doc_id long, text string, values string, score double")
    labels = [(i, q, 0) for i, _, q in rows] + [(0, None, 0), (None, 1, 0), (5, 1, 1), (9_999, 0, 0)]
    return rows, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(corpus):
    rows, docs, labels = corpus
    found = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.train(docs, labels)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert np.mean([(found[i] >= 0.5) == q for i, _, q in held]) > 0.97
    assert len(found) == len(rows) and all(0 <= s <= 1 for s in found.values())


def test_held_out_labels_teach_nothing(corpus, spark):
    rows, docs, labels = corpus
    flipped = labels.selectExpr("doc_id", f"if(crc32(cast(doc_id AS string)) % {quality.FOLDS} = {quality.HELD_OUT}, 1 - quality, quality) AS quality", "toxic")
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert all(np.array_equal(x, y) for x, y in zip(a.tables, b.tables))
    small = quality.train(docs, labels, fit_rows=40)
    assert small.base != a.base


def test_rows(docs, no_docs, rows, corpus):
    model = quality.train(*corpus[1:])
    assert quality.score(docs, model).count() == len(rows)
    kept = quality.kept(docs, model)
    assert kept.schema == docs.schema
    assert kept.count() == quality.score(docs, model).where("score >= 0.5").count()
    assert quality.score(no_docs, model).count() == quality.kept(no_docs, model).count() == 0
    assert quality.train(no_docs, corpus[2]).scores(np.zeros((1, len(quality.FEATURES)))).tolist() == [0.5]
