from collections import Counter

import pytest

import corpus_pipeline
from cutline.llm import near_copies, pii
from cutline.llm.pieces import MODEL, Encoder, Pieces
from cutline.llm.quality import features, train
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_near_copies import brute_classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels", "benchmark")}


def test_stages_against_brute_force(spark, tables):
    import numpy as np

    model = train(tables["documents"], tables["labels"])
    rows = [tuple(r) for r in tables["documents"].collect()]
    good = model.scores(np.array([features((r[1] or "").encode()) for r in rows])) >= 0.5
    rows = [r for r, keep in zip(rows, good) if keep]
    rows = [min(members) for members in brute_classes(rows)]
    items = [tuple(r) for r in tables["benchmark"].select("item_id", "text").collect()]
    bad = {k[0] for k in contaminated([(r[0], r[1]) for r in rows], items) if k[-1]}
    rows = [r for r in rows if r[0] not in bad]
    encoder = Encoder(Pieces.load(MODEL))
    expected = {r[0]: encoder.encode([pii.redact(r[1])])[0][0].tolist() for r in rows}
    found = corpus_pipeline.run(spark, SF).collect()
    assert len(found) == len(expected) < tables["documents"].count()
    assert {r["doc_id"]: list(r["ids"]) for r in found} == expected


def test_every_stage_keeps_the_columns_and_takes_awkward_rows(spark, docs, no_docs):
    for some in (docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, some, SF)
            assert out.columns == some.columns, name
            assert out.count() <= some.count()
        assert corpus_pipeline.STAGES[-1][1](spark, some, SF).count() == some.count()


def test_only_one_of_each_class_stays(spark, docs):
    kept = corpus_pipeline.one_of_near_copies(spark, docs, SF)
    classes = near_copies.classes(docs).select("class_id", "class_rows").distinct().count()
    assert kept.count() >= classes - 1
    assert max(Counter(r["text"] for r in kept.collect() if r["text"]).values()) == 1
