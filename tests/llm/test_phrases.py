import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import pytest

from cutline.llm import phrases
from cutline.llm.phrases import collocations

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, most, least, top, share):
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, most + 1):
                f["und" if lang is None else lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        around = Counter()
        for longer, a in candidates.items():
            for m in range(2, len(longer)):
                for i in range(len(longer) - m + 1):
                    around[longer[i : i + m]] = max(around[longer[i : i + m]], a)
        scored = []
        for p, a in candidates.items():
            if p in around and 100 * around[p] >= share * a:
                continue
            score, k = min((floor(Fraction(10**6 * a * a, counts[p[:k]] * counts[p[k:]])), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def corpus():
    base = ["Of the, of the best of the. New York city; new york! é new york\tcity\nNew  York", "a b c d. a b c e a b c", None, "", " \x0b., ", "x " * 300 + "ends"]
    langs = ["en", "fr", None, "und", "en", "de"]
    rows = [(base[i % 6], langs[i % 5 if i % 6 else 0]) for i in range(120)]
    rows += [(" ".join(f"the w{(i * j) % 97}" for j in range(200)), "en") for i in range(30)]
    return [(*row, i, "clash", 3) for i, row in enumerate(rows)]


SCHEMA = "text string, lang string, doc_id long, phrase string, n long"


@pytest.mark.parametrize("options", [
    dict(most=3, least=10, top=2000, share=50), dict(most=4, least=5, top=7, share=80), dict(most=2, least=1, top=50, share=1),
])
def test_against_counting(spark, monkeypatch, options):
    rows = corpus()
    # Many small slices, batches and sections.
    monkeypatch.setattr(phrases, "STRIPES_OF", 3_000)
    monkeypatch.setattr(phrases, "ROWS_OUT", 7)
    monkeypatch.setattr(phrases, "ENTRIES", 11)
    for stripe in (phrases.STRIPE, 500):
        found = collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), stripe=stripe, **options)
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in found.collect()) == brute([r[:2] for r in rows], **options)


def test_awkward_rows(spark, docs, rows, no_docs):
    found = collocations(docs, least=2)
    assert sorted(tuple(r) for r in found.collect()) == brute([(r[1], r[2]) for r in rows], 3, 2, 2000, 50)
    assert collocations(no_docs).isEmpty()
    assert collocations(spark.createDataFrame([(None, None), ("..", "en")], "text string, lang string")).isEmpty()


def test_a_hot_prefix_is_cut_into_sections(spark):
    rows = [(f"the w{i} the v{i % 5}", "en") for i in range(3_000)]
    df = spark.createDataFrame(rows, "text string, lang string")
    total, heavy = phrases.frequent_words(df)
    assert total == 12_000 and 6_000 <= heavy["the"] <= 6_006 and len(heavy) <= 2_000
    stripes = phrases._stripes(df, 1, {"the": 8}, 1, None).where("prefix = 'the'").collect()
    assert len({r["section"] for r in stripes}) == 8
    of = defaultdict(set)
    for r in stripes:
        for word in r["next"]:
            of[word].add(r["section"])
    assert all(len(s) == 1 for s in of.values())


def test_large_counts_are_exact(spark):
    rows = [("big deal", "en")] * 5
    assert collocations(spark.createDataFrame(rows, "text string, lang string"), least=5).first()["score"] == 1_000_000
    df = spark.sql("SELECT cast(1000000 as decimal(7,0)) * cast(99999999999999 as decimal(14,0)) * cast(99999999999999 as decimal(14,0)) div (cast(99999999999999 as decimal(14,0)) * cast(99999999999998 as decimal(14,0))) AS s")
    assert df.first()["s"] == 10**6 * 99999999999999 // 99999999999998
