from collections import Counter, defaultdict

import numpy as np

from cutline.llm import near_copies as nc
from cutline.llm.components import components
from tests.llm.conftest import near, sentence


def brute_classes(rows):
    texts = sorted({t or "" for _, t, *_ in rows})
    found = [nc.labels(t.encode()) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if nc.similarity(found[i], found[j]) >= nc.LEAST:
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for row in rows:
        members[root(texts.index(row[1] or ""))].append(row)
    return list(members.values())


def test_labels():
    a = nc.labels(b"a b c d e a b c d e a b c d e")
    assert len(a) == 11 == len(set(a.tolist()))
    assert len(nc.labels(b"one two")) == len(nc.labels(b"One, two!")) == 1
    assert nc.labels(b"one two")[0] == nc.labels(b"One, two!")[0]
    assert len(nc.labels(b"")) == len(nc.labels(b" ?! ")) == 0


def test_similarity_is_of_the_best_alignment_in_the_band():
    text = sentence(1, 200)
    a = nc.labels(text.encode())
    assert nc.similarity(a, a) == 1
    changed = nc.labels(near(text, 100).encode())
    assert nc.similarity(a, changed) == 191 / (2 * 196 - 191)
    words = text.split()
    moved = nc.labels(" ".join([*words[100:], *words[:100]]).encode())
    assert len(np.intersect1d(a, moved)) > 0.9 * len(a) and nc.similarity(a, moved) == 0
    assert nc.similarity(a, nc.labels(sentence(2, 200).encode())) == 0
    assert nc.similarity(a[:0], a[:0]) == 0


def test_classes(docs, rows, no_docs):
    expected = Counter()
    for members in brute_classes(rows):
        ids = [r[0] for r in members if r[0] is not None]
        for r in members:
            expected[r[0], min(ids, default=None), len(members)] += 1
    assert Counter(tuple(r) for r in nc.classes(docs).collect()) == expected
    assert nc.classes(no_docs).count() == 0


def test_one_of_each(docs, rows, no_docs):
    kept = nc.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [min((r[0] for r in m if r[0] is not None), default=None) for m in brute_classes(rows)]
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(ids)
    assert nc.one_of_each(no_docs).count() == 0


def test_a_large_group_in_short_runs(spark, monkeypatch):
    monkeypatch.setattr(nc, "RUN", 16)
    text = sentence(5, 300)
    rows = [(i, near(text, i % 290)) for i in range(120)] + [(1000 + i, sentence(50 + i, 60)) for i in range(30)]
    found = {r[0]: r[1] for r in nc.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i] == 0 for i in range(120))
    assert all(found[1000 + i] == 1000 + i for i in range(30))


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(50, 51), (51, 50), (60, 60), (70, 71), (72, 71), (70, 72), (70, 71)]
    found = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[i] for i in range(1, 41)} == {found[1]} and found[50] == found[51] != found[1]
    assert found[70] == found[71] == found[72] and set(found) == {*range(1, 41), 50, 51, 70, 71, 72}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def loose_family(n, pairs, length=200):
    """Texts that share a template, too different to be linked, and for some of them a near copy of 0.8 to 0.9."""
    rng = np.random.default_rng(3)
    template, out = sentence(77, length).split(), []
    for i in range(n):
        own = list(template)
        for at in rng.choice(length, 9, replace=False):
            own[at] = f"own{i}at{at}"
        out.append((i, " ".join(own)))
        if i < pairs:
            for at in rng.choice(length, 3, replace=False):
                own[at] = f"again{i}at{at}"
            out.append((n + i, " ".join(own)))
    return out


def test_no_link_of_a_large_loose_family_is_lost(spark, monkeypatch):
    monkeypatch.setattr(nc, "CELL", 256)
    rows = loose_family(800, 150)
    found = {r[0]: r[1] for r in nc.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    texts = [nc.labels(t.encode()) for _, t in rows]
    columns = {label: at for at, label in enumerate({x for t in texts for x in t.tolist()})}
    at = np.full((len(texts), len(columns)), False)
    for row, t in enumerate(texts):
        at[row, [columns[x] for x in t.tolist()]] = True
    at = at[:, at.sum(0) > 1].astype(np.float32)
    shared = at @ at.T
    sizes = np.array([len(t) for t in texts])
    a, b = np.nonzero(np.triu(shared >= nc.LEAST * (sizes[:, None] + sizes) / (1 + nc.LEAST) - 1e-6, 1))
    links = [(x, y) for x, y in zip(a.tolist(), b.tolist()) if nc.similarity(texts[x], texts[y]) >= nc.LEAST]
    assert len(links) >= 120
    assert all(found[rows[x][0]] == found[rows[y][0]] for x, y in links)
    assert len(set(found.values())) > 400


def test_bit_fields_never_rule_out_a_link():
    texts = [nc.labels(t.encode()) for _, t in loose_family(60, 40)] + [nc.labels(sentence(8, n).encode()) for n in (1, 2, 6, 40, 44, 300, 330, 361)]
    rows = [(i, len(t), nc.parities(t)) for i, t in enumerate(texts)]
    linked = {(i, j) for j in range(len(texts)) for i in range(j) if nc.similarity(texts[i], texts[j]) >= nc.LEAST}
    assert linked and linked <= {(i, j) for i, j, _ in nc.close(rows, None)}
    half = len(rows) // 2
    assert {(i, j) for i, j in linked if i < half <= j} <= {(i, j + half) for i, j, _ in nc.close(rows[:half], rows[half:])}
    assert not list(nc.close([(0, *r[1:]) for r in rows], None))
