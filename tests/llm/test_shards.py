import hashlib
import zlib
from collections import Counter, defaultdict

from cutline.llm.shards import interleave


def brute(rows, shards, seed):
    digest = lambda text: hashlib.md5(text.encode()).hexdigest()
    strata = defaultdict(list)
    for id_, text, source in rows:
        data = (text or "").encode()
        key = digest(f"{seed}:{'' if id_ is None else id_}")
        strata["" if source is None else "=" + source].append((key, id_ is not None, id_ or 0, zlib.crc32(data), len(data) + 1))
    order = []
    for name, members in strata.items():
        phase = int(digest(f"{seed}/{name}")[:8], 16) / 2.0**32
        for rank, (_, known, id_, crc, size) in enumerate(sorted(members), 1):
            order.append(((rank - phase) / len(members), name, rank, id_ if known else None, size, crc))
    n, out, slots = len(order), Counter(), Counter()
    for position, (*_, id_, size, crc) in enumerate(sorted(order, key=lambda o: o[:3])):
        shard = position * shards // n
        out[id_, size, crc, shard, slots[shard]] += 1
        slots[shard] += 1
    return out


def placed(df, shards, **options):
    return Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in interleave(df, shards, **options).collect())


def test_rows(docs, rows, no_docs):
    for shards in (1, 3, 8, 100):
        assert placed(docs, shards) == brute([(r[0], r[1], r[3]) for r in rows], shards, "mixture")
    assert placed(docs, 3, seed="other", blocks=5) == brute([(r[0], r[1], r[3]) for r in rows], 3, "other")
    assert placed(no_docs, 8) == Counter()


def test_every_shard_has_the_mixture(spark):
    rows = [(i, "t", "big" if i % 3 else f"s{i % 7}") for i in range(4_000)] + [(10_000 + i, "t", f"once{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = interleave(df, 8).collect()
    sizes = Counter(r["shard"] for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard in range(8):
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(sizes[shard]))
    for source, n in Counter(r[2] for r in rows).items():
        counts = Counter(r["shard"] for r in found if r["source"] == source)
        if n > 100:
            assert all(abs(counts[s] - n / 8) < 0.1 * n / 8 + 2 for s in range(8))
    singles = Counter(r["shard"] for r in found if r["source"].startswith("once"))
    assert min(singles.values()) > 20
