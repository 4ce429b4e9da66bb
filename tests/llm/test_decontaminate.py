import re
from collections import Counter

import pytest

from cutline.llm import decontaminate as dc
from tests.llm.conftest import sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items):
    windows = {}
    for item, text in items:
        words = split(text)
        n = min(len(words), dc.WINDOW)
        for at in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[at : at + n]), set()).add("" if item is None else str(item))
    out = Counter()
    for id_, text in rows:
        words, hit, found = split(text), set(), set()
        for size in {len(w) for w in windows}:
            for at in range(len(words) - size + 1):
                owners = windows.get(tuple(words[at : at + size]), ())
                found |= set(owners)
                hit |= set(range(at, at + size)) if owners else set()
        out[id_, len(words), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(words)] += 1
    return out


ITEMS = [
    (1, sentence(1, 20)), (2, "two words"), (10, sentence(2, 13)), (3, sentence(1, 16) + " tail end"), (4, None), (5, "... !"), (None, "ab cd"),
    (6, sentence(3, 30)), (6, "Two WORDS"), (7, "la la la la la la la la la la la la la la"), (8, "a b a b a c"), (9, "b a c"),
]
TEXTS = [
    sentence(1, 20), "x " + sentence(1, 20).upper() + " y", sentence(1, 12), sentence(2, 13).replace(" ", ", "), "two words two words", "Two-words",
    sentence(3, 30)[10:] + " " + sentence(1, 20)[30:], "la " * 13, "la " * 12, "la " * 40, None, "", "a b a b a b a c", "b a b a c", "two words " + sentence(7, 60),
]


def judged(spark, texts, items, **options):
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, spans string, n_words int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = dc.judged(dc.find(docs, benchmark, **options)).collect()
    for r in rows:
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in rows)


@pytest.mark.parametrize("block_words", [50_000, 60])
def test_windows(spark, block_words):
    assert judged(spark, TEXTS, ITEMS, block_words=block_words) == brute(list(enumerate(TEXTS)), ITEMS)


def test_no_rows(spark, no_docs):
    assert judged(spark, TEXTS, []) == brute(list(enumerate(TEXTS)), [])
    assert judged(spark, [], ITEMS) == Counter()


def test_kept(spark, docs, rows, no_docs):
    benchmark = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    kept = dc.kept(docs, benchmark)
    judged_ = brute([(r[0], r[1]) for r in rows], [(1, rows[0][1])])
    assert kept.columns == docs.columns
    expected = Counter()
    for (id_, *_, flag), n in judged_.items():
        if not flag:
            expected[id_] += n
    assert Counter(r["doc_id"] for r in kept.collect()) == expected
    assert dc.kept(no_docs, benchmark).count() == 0


def test_the_automaton_accepts_what_is_in_an_item():
    items = [(0, [b"a", b"b", b"a", b"b", b"c"]), (1, [b"b", b"c", b"a"]), (2, [])]
    automaton = dc.Automaton(2).build(items)
    known = {tuple(s[i:j]) for _, s in items for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for size in (1, 2, 3, 4):
        for at in range(3**size):
            word = tuple(b"abc"[at // 3**k % 3 : at // 3**k % 3 + 1] for k in range(size))
            state = 0
            for w in word:
                state = automaton.step[state].get(automaton.vocabulary[w], -1) if state >= 0 else -1
            assert (state >= 0) == (word in known)


def test_hit_words_are_cut_out_of_documents_under_the_limit(spark):
    item, other = sentence(1, 20), sentence(2, 13)
    words = item.split()
    long = sentence(7, 400)
    inside = " ".join(words[:10]) + " " + other + " " + " ".join(words[10:])
    texts = [long + ",\n" + item.upper() + "! Ünd\t" + long, long + " é " + inside + " " + long * 3, long + "\n", None, item + " " + sentence(8, 30)]
    docs = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, new string")
    items = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    for block_words in (50_000, 20):
        out = dc.cleaned(docs, items, block_words=block_words)
        assert out.columns == docs.columns
        found = {r["doc_id"]: r for r in out.collect()}
        assert set(found) == {0, 1, 2, 3}
        assert found[0]["text"] == long + ",\n! Ünd\t" + long and found[0]["n_chars"] == len(found[0]["text"])
        assert found[1]["text"].split() == (long + " é " + long * 3).split()
        assert (found[2]["text"], found[3]["text"], found[2]["new"]) == (texts[2], None, "x")
        assert all(r["n_hit"] == 0 for r in dc.judged(dc.find(out, items)).collect())
