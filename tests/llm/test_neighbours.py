import numpy as np

from cutline.llm import neighbours
from cutline.llm.common import stored
from cutline.llm.neighbours import Table, rotated, search

SCHEMA = "vec_id long, embedding array<float>, score double, query long, code long"


def brute(rows, step, k):
    valid = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, a in valid:
        if q % step == 0:
            scores = [(float(np.sqrt(((np.float32(a).astype(float) - np.float32(b).astype(float)) ** 2).sum())), i) for i, b in valid if i != q]
            out[q] = sorted(scores)[:k]
    return out


def result(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1.0, 2, 3) for i, v in rows], SCHEMA)
    out = {}
    for r in sorted(search(df, **options).collect()):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["score"], r["vec_id"]))
    return out


def test_rotations_keep_lengths():
    vectors = np.random.default_rng(0).normal(size=(5, 16))
    turned = rotated(vectors, np.random.default_rng(1).choice([-1.0, 1.0], (3, 16)))
    assert np.allclose(np.linalg.norm(turned, axis=1), np.linalg.norm(vectors, axis=1))


def test_a_vector_probes_its_own_bucket():
    vectors = np.random.default_rng(2).normal(size=(3000, 32))
    vectors[:1000] = vectors[0] + 0.01 * vectors[:1000]
    for rows in (100, 10_000, 10_000_000):
        table = Table.fit(vectors, rows, 1)
        codes = table.codes(vectors)
        assert all(codes[i] in table.probed(vectors[i]) for i in range(0, 3000, 97))
    assert table.inner


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i), 1.0, 2.0]) for i in range(12)]
    rows += [(20, None), (21, []), (22, [0.0, 0.0, 0.0]), (23, [1.0, None, 2.0]), (24, [nan, 1.0, 1.0]), (25, [inf, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(30, [1.0, 2.0])]
    rows += [(100 + i, [5.0, 5.0, 5.0]) for i in range(30)] + [(100, [5.0, 5.0, 5.0])]
    kept = [r for r in rows if r[0] != 30]
    assert result(spark, rows, query_step=10, k=4) == brute(kept, 10, 4)


def test_few_and_no_rows(spark):
    assert result(spark, []) == {}
    assert result(spark, [(0, [1.0, 2.0])]) == {}
    few = [(i, [float(i * i), 1.0]) for i in range(6)]
    assert result(spark, few, query_step=5) == brute(few, 5, 10)


def test_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 24))
    vectors = centres[rng.integers(8, size=2500)] + 0.7 * rng.normal(size=(2500, 24))
    vectors[:800] = centres[0] + 0.05 * rng.normal(size=(800, 24))  # a third in one place
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    found, best = result(spark, rows), brute(rows, 100, 10)
    hits = sum(len({i for _, i in found[q]} & {i for _, i in best[q]}) for q in best)
    assert hits >= 0.9 * sum(map(len, best.values()))
    assert all(len(v) == 10 for v in found.values())


def test_effort_grows_until_the_neighbours_are_met():
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(4000, 32))  # no structure: the hardest case for hashing
    tables = [Table.fit(vectors, 4_000, number) for number in (1, 2, 3)]
    queries = vectors[:20]
    near = [vectors[np.argsort(((vectors - q) ** 2).sum(1))[1:11]] for q in queries]

    def recall(factor):
        met = [np.any([np.isin(t.codes(n), t.probed(q, factor)) for t in tables], axis=0) for q, n in zip(queries, near)]
        return np.concatenate(met).mean()

    chosen = neighbours.effort(tables, queries, near)
    assert chosen > 1 and recall(1) < neighbours.RECALL <= recall(chosen)
    assert recall(chosen / neighbours.STEP) < neighbours.RECALL
    assert neighbours.effort(tables, queries[:0], []) == 1


def test_recall_is_held_without_structure(spark):
    vectors = np.random.default_rng(7).normal(size=(3000, 32)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    found, best = result(spark, rows, tables=3), brute(rows, 100, 10)
    hits = sum(len({i for _, i in found[q]} & {i for _, i in best[q]}) for q in best)
    assert hits >= 0.9 * sum(map(len, best.values()))


def test_all_rows_are_compared_with_few_queries(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, rng.integers(0, 3, 4).astype(float).tolist()) for i in range(400)]
    df = spark.createDataFrame(vectors, "class long, embedding array<float>").repartition(3)
    asked = df.where("class < 5").withColumnRenamed("class", "query")
    found = {}
    for r in neighbours._compared(asked, df, 9).collect():
        found.setdefault(r["query"], []).append((r["score"], r["class"]))
    for q, a in vectors[:5]:
        assert sorted(found[q]) == sorted((float(np.sqrt(((np.array(a) - b) ** 2).sum())), i) for i, b in vectors)[:10]


def test_the_best_rows_of_each_query_are_kept():
    rng = np.random.default_rng(9)
    queries, classes, scores = rng.integers(0, 5, 100), rng.permutation(100), rng.integers(0, 6, 100).astype(float)
    kept = neighbours._best(queries, classes, scores, 3)
    rows = [(q, s, c) for q, c, s in zip(queries.tolist(), classes.tolist(), scores.tolist())]
    assert [(q, s, c) for q, c, s in zip(*(x.tolist() for x in kept))] == [r for q in range(5) for r in sorted(x for x in rows if x[0] == q)[:3]]
    assert [len(x) for x in neighbours._best(queries[:0], classes[:0], scores[:0], 3)] == [0, 0, 0]


def test_nearest_pairs_are_the_same_however_they_are_measured(spark, monkeypatch):
    rng = np.random.default_rng(10)
    vectors = spark.createDataFrame([(i, rng.integers(0, 3, 4).astype(float).tolist()) for i in range(60)], "class long, embedding array<float>")
    asked = vectors.where("class < 7").withColumnRenamed("class", "query")
    pairs = asked.select("query").crossJoin(vectors.select("class")).repartition(3)

    def nearest(numbers):
        return neighbours._nearest(neighbours._distances(pairs, vectors, asked, 5, numbers), "query", 5, "class").collect()

    best = sorted(neighbours._compared(asked, vectors, 4).collect())
    assert sorted(r[:3] for r in nearest(28)) == best
    monkeypatch.setattr(neighbours, "HELD_ROWS", 10)
    assert sorted(r[:3] for r in nearest(28)) == best
    assert sorted(r[:3] for r in nearest(neighbours.SHARED_NUMBERS + 1)) == best


def test_probes_are_never_broadcast(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(neighbours, "stored", lambda df, name, *a: plans.append((name, df._jdf.queryExecution().toString())) or stored(df, name, *a))
    rows = [(i, np.random.default_rng(i).normal(size=8).tolist()) for i in range(300)]
    result(spark, rows, tables=2)
    optimized = dict(plans)["near"].split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    joins = [line for line in optimized.splitlines() if "Join Inner, (code#" in line]
    assert joins and all("merge" in line for line in joins)
