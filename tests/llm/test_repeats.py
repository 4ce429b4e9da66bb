import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cutline.llm import repeats
from cutline.llm.repeats import LENGTH, marked, pieces, removed, stretches


def brute(rows):
    seen = Counter(b[k : k + LENGTH] for _, b in rows for k in range(len(b) - LENGTH + 1))
    out = Counter()
    for id_, b in rows:
        mask = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - LENGTH + 1):
            if seen[b[k : k + LENGTH]] > 1:
                mask[k : k + LENGTH] = True
        kept = bytes(x for x, gone in zip(b, mask) if not gone)
        out[id_, len(b), int(mask.sum()), int((np.diff(mask.astype(int)) == 1).sum() + mask[0]), hashlib.sha256(kept).hexdigest()] += 1
    return out


def digests(df):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def random_bytes(seed, n, letters=b"abcd \n"):
    rng = random.Random(seed)
    return bytes(rng.choice(letters) for _ in range(n))


def test_stretches_own_every_window_once():
    texts = [random_bytes(1, 3_000), b"", random_bytes(2, LENGTH), random_bytes(3, LENGTH - 1), b"a" * 1_000, random_bytes(1, 3_000)]
    text, first, last, anchor = stretches(texts)
    owned = Counter((t, w) for t, a, b in zip(text, first, last) for w in range(a, b + 1))
    assert owned == Counter((t, w) for t, b in enumerate(texts) for w in range(len(b) - LENGTH + 1))
    assert np.all((first <= anchor) & (anchor - last <= anchor - first) & (anchor - first <= LENGTH - repeats.GRAM))
    mine = lambda t: [(a, b, p) for x, a, b, p in zip(text, first, last, anchor) if x == t]
    assert mine(0) == mine(5)


@pytest.mark.parametrize("width", repeats.WIDTHS)
def test_pieces_share_their_bytes(width):
    for first, last, anchor in ((0, 0, 0), (5, 90, 300), (0, 368, 368), (10, 30, 31)):
        cut = pieces(first, last, anchor, width)
        assert sorted(w for a, b, _, _ in cut for w in range(a, b + 1)) == list(range(first, last + 1))
        assert all(b <= begin or begin >= a for a, b, begin, _ in cut)
        assert all(a <= x for a, b, x, _ in cut for _ in [0]) and all(x >= b and y <= a + LENGTH for a, b, x, y in cut)


def test_the_index_marks_what_occurs_twice():
    shared = random_bytes(9, 500)
    segments = [random_bytes(1, 700), shared[:450], b"x" + shared, shared[20:] + b"y", b"\0" * 420, b"\0" * 401, random_bytes(1, 600), random_bytes(8, 400)]
    seen = Counter(s[k : k + LENGTH] for s in segments for k in range(len(s) - LENGTH + 1))
    for segment, mask in zip(segments, marked(segments)):
        assert mask.tolist() == [seen[segment[k : k + LENGTH]] > 1 for k in range(len(segment) - LENGTH + 1)]


def test_a_repetitive_index_has_few_runs():
    base = random_bytes(4, 600)
    index = repeats.RunLengthIndex([base] * 50)
    assert len(index.heads) < 800 and index.lengths.sum() == 50 * 601


def test_rows(docs, rows, no_docs):
    assert digests(removed(docs)) == brute([(r[0], (r[1] or "").encode()) for r in rows])
    assert removed(no_docs).count() == 0


def corpus(seed):
    rng = random.Random(seed)
    passages = [random_bytes(100 + i, rng.choice([380, 399, 400, 401, 430, 900])) for i in range(6)]
    out = []
    for i in range(60):
        parts = [random_bytes(1000 + 7 * i + j, rng.randint(0, 500)) if rng.random() < 0.5 else rng.choice(passages) for j in range(rng.randint(1, 5))]
        out.append((i, b"".join(parts).decode()))
    return out


@pytest.mark.parametrize("crowd", [10_000, 3])
def test_shared_passages_with_and_without_crowds(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 20_000)
    rows = corpus(1)
    found = removed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert digests(found) == brute([(i, t.encode()) for i, t in rows])


def test_an_index_takes_little_memory():
    import tracemalloc

    copies = [random_bytes(i, 584) for i in range(5)] * 40
    segments = copies + [random_bytes(100 + i, 584) for i in range(300)]
    tracemalloc.start()
    try:
        marks = repeats.marked(segments)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert all(m.all() for m in marks[:200]) and not any(m.any() for m in marks[200:])
    assert peak < 70 * sum(map(len, segments))
