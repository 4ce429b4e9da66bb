import itertools
import random

import numpy as np
import pytest

from cutline.llm import pieces as pc


@pytest.fixture(scope="module")
def pieces():
    return pc.Pieces.load(pc.MODEL)


@pytest.fixture(scope="module")
def encoder(pieces):
    return pc.Encoder(pieces)


def every(unit, pieces):
    edges = pc._edges(unit, pieces)

    def paths(place):
        if place == 0:
            return [(0, ())]
        return [(a + score, x + ids) for start, score, ids in edges[place] for a, x in paths(start)]

    return paths(len(unit))


def random_text(seed, n=30):
    return "".join(random.Random(seed).choices("abceinrst  \nüß▁一😀.", k=n))


@pytest.mark.parametrize("seed", range(25))
def test_n_best_of_a_unit_against_all_segmentations(pieces, seed):
    for unit in pc.units(random_text(seed, 8)):
        found = pc.n_best(unit, pieces, 6)
        brute = every(unit, pieces)
        assert [s for s, _ in found] == sorted((s for s, _ in brute), reverse=True)[:6]
        assert set(found) <= set(brute) and len(set(found)) == len(found)


@pytest.mark.parametrize("seed", range(25))
def test_texts(pieces, encoder, seed):
    text = random_text(seed)
    (ids,), (numbers,) = encoder.encode([text])
    assert encoder.decode(ids).decode() == text
    together = encoder.segmentations(text, 5)
    assert encoder.best_scores(numbers, 5) == [s for s, _ in together]
    score = {i: s for i, s in pieces.scores.items()} | {i: pieces.byte_score for i in pieces.bytes_}
    assert sum(score[i] for i in ids.tolist()) == together[0][0]
    for total, segmentation in together:
        assert encoder.decode(np.array(segmentation)).decode() == text
        assert sum(score[i] for i in segmentation) == total
    units = [every(u, pieces) for u in pc.units(text[:12])]
    if np.prod([len(u) for u in units]) < 20_000:
        sums = sorted((sum(s for s, _ in choice) for choice in itertools.product(*units)), reverse=True)[:5]
        assert [s for s, _ in encoder.segmentations(text[:12], 5)] == sums


def test_groups_and_single_units_agree(pieces, encoder, monkeypatch):
    texts = [random_text(s, 200) for s in range(20)]
    alone = pc.Encoder(pieces)
    monkeypatch.setattr(pc, "TOGETHER", 0)
    a = alone.encode(texts)
    for x, y in zip(a[1], encoder.encode(texts)[1]):
        assert np.array_equal(alone.scores[x], encoder.scores[y]) and np.array_equal(alone.lose[x], encoder.lose[y])


def test_the_cache_is_bounded(pieces, monkeypatch):
    monkeypatch.setattr(pc, "CACHED", 50)
    small = pc.Encoder(pieces)
    for seed in range(30):
        text = random_text(seed, 300)
        assert small.decode(small.encode([text])[0][0]).decode() == text
        assert len(small.names) < 350


def test_rows(docs, no_docs, rows):
    found = pc.encoded(docs)
    again = pc.decoded(found)
    assert sorted((repr(r["doc_id"]), r["text"]) for r in again.collect()) == sorted((repr(r[0]), r[1] or "") for r in rows)
    for r in found.where("doc_id = 14").collect():
        assert list(r["ids"]) == [] and list(r["n_best"]) == [0]
    digest = pc.digest(docs).collect()
    assert len(digest) == len(rows) and all(r["round_trip"] for r in digest)
    assert pc.encoded(no_docs).count() == pc.digest(no_docs).count() == 0
