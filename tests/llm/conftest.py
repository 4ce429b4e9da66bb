"""A small corpus with the awkward cases: nulls, empty texts, copies, repeated rows, clashing extra columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, text_key string, key long"

LONG = "".join(random.Random(1).choice(["la ", "mo ", "ti ", "ka. ", "ru\n", "ß "]) for _ in range(9_000))


def sentence(seed, n=40):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def near(text, at):
    words = text.split()
    words[at] = "changed"
    return " ".join(words)


@pytest.fixture(scope="session")
def rows():
    base = [sentence(s, 150) for s in range(6)]
    texts = [
        *base,
        near(base[0], 3), near(base[0], 149), near(near(base[0], 3), 75),  # near copies
        base[1], base[1], base[2],  # copies
        base[3] + " " + base[4], base[5][:500] + sentence(99, 60),  # shared passages
        None, None, "", "", " \n ", "word", "word", "Word!", "ab cd", LONG, LONG + "x", "\0" * 900, "aa" * 700, "é" * 450,
    ]
    out = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 0, 0.5, 7, "k", 1) for i, t in enumerate(texts)]
    return [*out, out[0], out[9], (None, base[4], None, "s0", None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
