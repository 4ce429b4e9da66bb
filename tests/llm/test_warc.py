import base64
import gzip
import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cutline.llm import warc
from cutline.llm.common import stored
from cutline.session import scratch_path

LARGE = "é<p>" + "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 30
SMALL = "small " * 10


def page_rows():
    rng = random.Random(5)
    texts = [LARGE, SMALL, None, "", LARGE + "!", "\r\n" * 600, "y" * 1000, "y" * 999, "".join(rng.choices("ab é\n", k=5000))]
    rows = [(i, f"http://h{i % 3}.example/a?q={i}#x", texts[i % len(texts)]) for i in range(40)]
    rows += [rows[0], rows[0], (None, None, LARGE), (None, "no scheme", SMALL), (99, "", "y" * 1000), (100, "http://a\r\nb c", "z" * 2000)]
    return [(*row, "clash", 7, "p") for row in rows]


SCHEMA = "page_id long, url string, html string, payload_digest string, row long, capture_id string"


def digested(captures):
    rows = warc.resolved(stored(captures, "t"))
    return rows.select(
        warc.field("metadata", "page-id").cast("long").alias("page_id"),
        "payload_bytes", "payload_digest", F.col("response.record_type").alias("record_type"),
        warc.field("original.metadata", "page-id").cast("long").alias("refers_to"),
    )


def brute(rows):
    groups = defaultdict(list)
    for at, row in enumerate(rows):
        groups[row[2] or ""].append((row[0] is not None, row[0] or 0, at))
    out = Counter()
    for text, members in groups.items():
        data = text.encode()
        head = max(members)
        for known, id_, at in members:
            revisit = len(data) >= 1000 and (known, id_) != head[:2]
            out[id_ if known else None, len(data), hashlib.sha1(data).hexdigest(), revisit, head[1] if revisit else None] += 1
    return out


@pytest.mark.parametrize("file_bytes", [16 << 20, 5_000])
def test_round_trip(spark, file_bytes):
    rows = page_rows()
    path = scratch_path(spark, "warc")
    warc.write(spark.createDataFrame(rows, SCHEMA).repartition(3), path, file_bytes=file_bytes)
    records = stored(warc.read(spark, path), "records")
    assert Counter(r["record_type"] for r in records.collect())["request"] == len(rows)
    assert records.where("error IS NOT NULL OR digest_ok = false").isEmpty()
    captures = stored(warc.assemble(records), "captures")
    assert captures.count() == len(rows)
    assert captures.where("size(requests) = 1 AND size(metadata) = 1").count() == len(rows)
    # Which of several rows with one page_id and one payload keeps it does not matter: one does.
    found = Counter()
    for r in digested(captures).collect():
        found[tuple(r)] += 1
    expected = Counter()
    for (id_, size, digest, revisit, head), n in brute(rows).items():
        expected[id_, size, digest, "revisit" if revisit else "response", head] += n
    repeated = (0, len(LARGE.encode()), hashlib.sha1(LARGE.encode()).hexdigest())
    assert sum(n for k, n in found.items() if k[:3] == repeated) == 3
    assert found == expected
    uris = {r["target_uri"] for r in captures.collect()}
    assert "http://a%0D%0Ab%20c" in uris and None in uris


def test_repeated_rows_keep_one_response(spark):
    rows = [(7, "u", "x" * 2000)] * 5 + [(None, "u", "y" * 1500)] * 3
    path = scratch_path(spark, "warc")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    found = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in digested(warc.assemble(stored(warc.read(spark, path), "r"))).collect())
    assert found == {(7, "response", None): 1, (7, "revisit", 7): 4, (None, "response", None): 1, (None, "revisit", None): 2}


def test_empty_table(spark):
    path = scratch_path(spark, "warc")
    warc.write(spark.createDataFrame([], SCHEMA), path)
    assert warc.assemble(stored(warc.read(spark, path), "records")).isEmpty()


def record(kind, id_, block=b"", *headers):
    head = "".join(f"{h}\r\n" for h in (f"WARC-Type: {kind}", f"WARC-Record-ID: {id_}", *headers, f"content-length: {len(block)}"))
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def test_records_of_others(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"
    base32 = base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    good = record("warcinfo", "<i>", b"software: x\r\n  folded\r\n", "Content-Type: application/warc-fields")
    # A response that names its request, a chain of metadata, two records that only know each other.
    good += record("response", "<r>", http, "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base32}", "WARC-Concurrent-To: <q>", "WARC-Concurrent-To: <m>")
    good += record("request", "<q>", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request")
    good += record("metadata", "<n>", b"a: 1\r\nb: 2", "WARC-Concurrent-To: <q>", "Content-Type: application/warc-fields")
    good += record("metadata", "<n2>", b"", "WARC-Concurrent-To: <n>") + record("metadata", "<m>")
    good += record("request", "<lost>", b"") + record("metadata", "<lost2>", b"", "WARC-Concurrent-To: <lost>")
    good += record("response", "<bad>", b"body", "WARC-Payload-Digest: sha1:" + "0" * 40)
    members = [good[:300], good[300:]]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(m) for m in members))
    (tmp_path / "e.warc.gz").write_bytes(gzip.compress(b"x" * 99)[:-20])
    (tmp_path / "b.warc").write_bytes(record("metadata", "<x>") + b"WARC/1.1\r\nWARC-Record-ID: <y>\r\ncontent-length: 99\r\n\r\nshort")
    (tmp_path / "c.warc").write_bytes(b"<html>")
    (tmp_path / "d.warc").write_bytes(b"")
    records = stored(warc.read(spark, str(tmp_path)), "records")
    assert sorted(r["error"][:9] for r in records.where("error IS NOT NULL").collect()) == ["no record", "no record", "record at"]
    captures = {r["capture_id"]: r for r in warc.assemble(records).collect()}
    assert set(captures) == {"<i>", "<r>", "<lost>", "<bad>", "<x>"}
    whole = captures["<r>"]
    assert [q["record_id"] for q in whole["requests"]] == ["<q>"] and [m["record_id"] for m in whole["metadata"]] == ["<m>", "<n2>", "<n>"]
    assert (whole["response"]["payload_bytes"], whole["response"]["digest_ok"], whole["response"]["http"]) == (4, True, "HTTP/1.1 200 OK\r\nA: b")
    assert captures["<bad>"]["response"]["digest_ok"] is False
    assert captures["<lost>"]["response"] is None and len(captures["<lost>"]["metadata"]) == 1
    assert captures["<i>"]["metadata"][0]["fields"][0]["value"] == "x folded"


def test_hot_keys_are_looked_up_in_a_broadcast(spark):
    from cutline.llm.common import looked_up

    rows = [(i, "hot" if i % 3 else f"k{i}") for i in range(900)] + [(1000, None)]
    df = spark.createDataFrame(rows, "row long, k string")
    lookup = spark.createDataFrame([("hot", 1), ("k3", 2), ("other", 3)], "k string, v int")
    found = Counter((r["row"], r["k"], r["v"]) for r in looked_up(df, lookup, ["k"], hot_rows=100).collect())
    assert found == Counter((i, k, {"hot": 1, "k3": 2}.get(k)) for i, k in rows)
