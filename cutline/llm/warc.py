"""WARC archives: pages written as request, response and metadata records, read back, assembled to captures.

Writing.  Every page is one transaction of three records.  Its response (or, where an equal payload is stored once
already, its revisit) carries the identifier that request and metadata name as ``WARC-Concurrent-To``.  Records are
made by SQL functions and written by Spark's text writer, whose line separator is the two line ends that close a record.

Reading.  An archive file is one row of the binary reader; a task walks its records by their ``Content-Length``, so
payloads may hold anything, line ends and record headers included.  Payload digests are computed again.

Assembly.  Records meet through concurrent-to identifiers, whichever of the two names the other and over several
steps if need be, and a capture becomes one nested row.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from cutline.llm.common import looked_up, stored

#: Equal payloads from this size are stored once.
LEAST_REVISIT = 1000
#: About how large an archive file gets; a task holds one whole file at a time.
FILE_BYTES = 16 << 20
CAPTURED_AT = "2024-01-01T00:00:00Z"

# Fixed values of the archive format.
VERSION = "WARC/1.1"
END = "\r\n"
HTTP = "application/http;msgtype="
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_HEADS = ("response", "revisit")
_RECORD = pa.schema(
    [
        *((name, pa.string()) for name in ("file", "record_type", "record_id", "refers_to", "target_uri", "date", "http")),
        *((name, pa.string()) for name in ("payload_digest", "error")),
        ("place", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("digest_ok", pa.bool_()),
        ("concurrent_to", pa.list_(pa.string())),
        ("fields", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))),
    ]
)


def _urn(*parts: Column) -> Column:
    """A record identifier that is the same whenever it is made again."""
    h = F.md5(F.concat_ws("\n", *parts).cast("binary"))
    cuts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines of the fields that are not null."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END)), F.lit("")) for name, value in fields])


def _record(kind: Column, id_: Column, block: Column, type_: Column, *fields: tuple[str, Column]) -> Column:
    head = _lines(
        ("WARC-Type", kind), ("WARC-Record-ID", id_), *fields, ("Content-Type", type_), ("Content-Length", F.octet_length(block))
    )
    return F.concat(F.lit(VERSION + END), head, F.lit(END), block)


def one_response_each(rows: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``row, head_row, head_page_id`` of the rows whose payload another row holds as well, the one that is no revisit.

    ``rows`` (row, page_id, payload_digest, payload_bytes) is stored.  Of equal payloads of ``least`` bytes or more, the
    row with the largest page_id (of equal ones, the largest row) keeps the payload.
    """
    large = rows.where(F.col("payload_bytes") >= least)
    heads = large.groupBy("payload_digest").agg(F.max(F.struct("page_id", "row")).alias("head"), F.count(F.lit(1)).alias("n"))
    heads = heads.where("n > 1").select("payload_digest", "head")
    found = looked_up(large.select("row", "payload_digest"), heads, ["payload_digest"])
    found = found.where("head.row <> row")
    return found.select("row", F.col("head.row").alias("head_row"), F.col("head.page_id").alias("head_page_id"))


def write(pages: DataFrame, path: str, least: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES, captured_at: str = CAPTURED_AT) -> None:
    """Archives ``pages`` (page_id, url, html) below ``path``, in compressed files of about ``file_bytes`` before compression.

    A null html is an empty payload, a null url gives no target; control characters and blanks of a url are written as
    percent escapes, as no header may hold them.  A null page_id is left out of the metadata.  Repeated rows are
    captures of their own.  An empty table gives an archive without records.  Other columns are ignored.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digest = F.sha1(payload).alias("payload_digest")
    row = F.monotonically_increasing_id().alias("row")
    size = F.octet_length(payload).cast("long").alias("payload_bytes")
    rows = stored(pages.select(row, F.col("page_id").cast("long").alias("page_id"), "url", digest, size), "captures")
    revisits = one_response_each(rows, least)
    plan = stored(rows.join(revisits, "row", "left"), "archive-plan")
    # Only texts meet by their digest, once each: copies are one before the shuffle, and row numbers stay with the stored rows.
    payloads = pages.select(digest, payload.alias("payload")).groupBy("payload_digest").agg(F.first("payload").alias("payload"))
    is_large = F.col("payload_bytes") >= least
    small = payloads.where(F.octet_length("payload") < least)
    paired = (
        plan.where("head_row IS NOT NULL").withColumn("payload", F.lit(None).cast("binary"))
        .unionByName(plan.where(is_large & F.col("head_row").isNull()).join(payloads, "payload_digest"))
        .unionByName(looked_up(plan.where(~is_large), small, ["payload_digest"]))
    )
    sums = rows.agg(F.sum("payload_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    each = (sums["bytes"] or 0) / max(sums["rows"], 1) + 1500
    per_file = max(3, int(3 * file_bytes / each))
    encode = lambda c: reduce(lambda u, code: F.replace(u, F.lit(chr(code)), F.lit(f"%{code:02X}")), (*range(33), 127), c)
    paired = paired.withColumn("uri", encode(F.col("url")))
    is_revisit = F.col("head_row").isNotNull()
    id_ = lambda kind, row="row": _urn(F.lit(kind), F.col(row).cast("string"))
    named = F.concat(F.lit("sha1:"), F.col("payload_digest"))
    common = (("WARC-Date", F.lit(captured_at)), ("WARC-Target-URI", F.col("uri")))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(END + END),
    )
    response = _record(
        F.when(is_revisit, F.lit("revisit")).otherwise("response"),
        id_("capture"),
        F.concat(http, F.when(is_revisit, F.lit("")).otherwise(F.col("payload").cast("string"))),
        F.lit(HTTP + "response"),
        *common,
        ("WARC-Payload-Digest", named),
        ("WARC-Profile", F.when(is_revisit, F.lit(REVISIT_PROFILE))),
        ("WARC-Refers-To", F.when(is_revisit, id_("capture", "head_row"))),
    )
    host = F.regexp_extract("uri", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    at = F.regexp_extract("uri", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    at = F.when(at.startswith("/"), at).otherwise(F.concat(F.lit("/"), at))
    asked = F.concat(F.lit("GET "), F.coalesce(at, F.lit("/")), F.lit(f" HTTP/1.1{END}Host: "), F.coalesce(host, F.lit("")), F.lit(END + END))
    with_capture = ("WARC-Concurrent-To", id_("capture"))
    request = _record(F.lit("request"), id_("request"), asked, F.lit(HTTP + "request"), *common, with_capture)
    facts = _lines(("page-id", F.col("page_id")))
    metadata = _record(F.lit("metadata"), id_("metadata"), facts, F.lit("application/warc-fields"), *common, with_capture)
    records = paired.select(F.explode(F.array(request, response, metadata)).alias("value"))
    records.write.options(lineSep=END + END, maxRecordsPerFile=per_file, compression="gzip").text(path)


def _digest(named: str | None) -> str | None:
    """A payload digest as bare lower-case hex, written in hex or in base32."""
    algorithm, _, value = (named or "").partition(":")
    if algorithm.lower() != "sha1":
        return None
    if len(value) == 32:
        return base64.b32decode(value.upper()).hex()
    return value.lower()


def _pairs(block: bytes) -> list[tuple[str, str]]:
    """Named fields, one a line; a line that starts blank goes on with the one before."""
    found: list[tuple[str, str]] = []
    for line in block.decode("utf-8", "replace").split("\n"):
        line = line.removesuffix("\r")
        if line[:1] in (" ", "\t") and found:
            found[-1] = found[-1][0], f"{found[-1][1]} {line.strip()}"
        elif ":" in line:
            name, _, value = line.partition(":")
            found.append((name.strip(), value.strip()))
    return found


def _plain(content: bytes) -> bytes:
    """The content of a file, of all its members where it is compressed; up to the damage where one is damaged."""
    plain = [] if content.startswith(b"\x1f\x8b") else [content]
    while content.startswith(b"\x1f\x8b"):
        member = zlib.decompressobj(31)
        try:
            plain.append(member.decompress(content))
        except zlib.error:
            pass
        if not member.eof:
            plain.append(b"damaged")
        content = member.unused_data
    return b"".join(plain)


def parse(content: bytes) -> Iterator[dict]:
    """The records of one archive file, in order.

    What is no record ends the file with a row that says so in ``error``; the records before it stand.
    """
    view, at, place = memoryview(content), 0, 0
    while at < len(content):
        head_end = content.find(b"\r\n\r\n", at)
        record = {"place": place}
        if not content.startswith(b"WARC/", at) or head_end < 0:
            yield record | {"error": f"no record at byte {at}"}
            return
        pairs = _pairs(content[at:head_end])
        named = {name.lower(): value for name, value in pairs[::-1]}
        length = named.get("content-length", "")
        start = head_end + 4
        if not length.isdecimal() or start + int(length) > len(content):
            yield record | {"error": f"record at byte {at} has no whole block"}
            return
        end = start + int(length)
        kind, type_ = named.get("warc-type"), named.get("content-type", "").replace(" ", "").lower()
        record |= {
            "record_type": kind,
            "record_id": named.get("warc-record-id"),
            "concurrent_to": [value for name, value in pairs if name.lower() == "warc-concurrent-to"],
            "refers_to": named.get("warc-refers-to"),
            "target_uri": named.get("warc-target-uri"),
            "date": named.get("warc-date"),
        }
        body = start
        if type_.startswith("application/http"):
            split = content.find(b"\r\n\r\n", start, end)
            body = end if split < 0 else split + 4
            record["http"] = bytes(view[start:body]).decode("utf-8", "replace").strip()
        elif type_ == "application/warc-fields":
            record["fields"] = [{"name": name, "value": value} for name, value in _pairs(bytes(view[start:end]))]
        stated = _digest(named.get("warc-payload-digest"))
        if kind == "revisit":
            record |= {"payload_digest": stated}
        else:
            found = hashlib.sha1(view[body:end]).hexdigest()
            record |= {"payload_bytes": end - body, "payload_digest": found, "digest_ok": None if stated is None else stated == found}
        yield record
        at, place = end, place + 1
        while content.startswith(b"\r\n", at):
            at += 2


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archive files below ``path``, without their payloads: sizes and digests stand for them.

    A revisit has the digest it states and no size, as its payload is elsewhere.  ``digest_ok`` compares a stated digest
    with the payload.  A damaged file gives its sound records and one row with an ``error``.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file, chunk = batch.column("path")[i].as_py(), []
                for record in parse(_plain(batch.column("content")[i].as_py())):
                    chunk.append(dict.fromkeys(_RECORD.names) | {"file": file} | record)
                    if len(chunk) == 5_000:
                        yield pa.RecordBatch.from_pylist(chunk, _RECORD)
                        chunk = []
                if chunk:
                    yield pa.RecordBatch.from_pylist(chunk, _RECORD)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(walk, from_arrow_schema(_RECORD))


def _of_captures(records: DataFrame) -> DataFrame:
    """``record_id, capture_id`` of every record that a chain of concurrent-to identifiers ties to a response or revisit."""
    heads = records.where(F.col("record_type").isin(*_HEADS)).select("record_id", F.col("record_id").alias("capture_id")).distinct()
    others = records.where(~F.coalesce(F.col("record_type"), F.lit("")).isin(*_HEADS))
    # Nearly always a record names the response itself.
    named = others.select("record_id", F.explode("concurrent_to").alias("b"))
    direct = named.join(heads.withColumnRenamed("record_id", "b"), "b").groupBy("record_id").agg(F.min("capture_id").alias("capture_id"))
    known = stored(heads.unionByName(direct), "captured")
    rest = others.select("record_id").join(known, "record_id", "left_anti")
    if rest.isEmpty():
        return known
    # The others go along the links of both directions, a step in a round.
    links = records.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"))
    links = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "concurrent")
    new = known
    while not new.isEmpty():
        # A record next to several captures belongs to the one with the smallest identifier.
        beside = new.withColumnRenamed("record_id", "b").join(links, "b").groupBy(F.col("a").alias("record_id")).agg(F.min("capture_id").alias("capture_id"))
        new = stored(beside.join(known, "record_id", "left_anti"), "captured")
        known = known.unionByName(new)
    return known


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: ``capture_id, target_uri, date, response, requests, metadata``.

    ``records`` is stored.  ``response`` is the response or revisit (a struct), ``requests`` and ``metadata`` are arrays
    of its other records by identifier.  A record that no chain ties to a response makes a capture without one,
    together with what it names; rows with an error or without an identifier are left out.  Records that occur
    several times count once.  A capture has as many records as one exchange with a server left.
    """
    records = records.where("record_id IS NOT NULL AND error IS NULL")
    alone = F.coalesce(F.array_min("concurrent_to"), F.col("record_id"))
    rows = records.join(_of_captures(records), "record_id", "left").withColumn("capture_id", F.coalesce("capture_id", alone))
    is_head = F.col("record_type").isin(*_HEADS)
    head = F.struct("record_id", "record_type", "refers_to", "http", "payload_bytes", "payload_digest", "digest_ok")
    request = F.struct("record_id", "http", "payload_bytes", "payload_digest")
    other = F.struct("record_id", "record_type", "fields")
    is_request = F.col("record_type") == "request"
    return rows.groupBy("capture_id").agg(
        F.coalesce(F.max(F.when(is_head, F.col("target_uri"))), F.max("target_uri")).alias("target_uri"),
        F.coalesce(F.max(F.when(is_head, F.col("date"))), F.max("date")).alias("date"),
        F.min(F.when(is_head, head)).alias("response"),
        F.array_sort(F.collect_set(F.when(is_request, request))).alias("requests"),
        F.array_sort(F.collect_set(F.when(~is_head & ~is_request, other))).alias("metadata"),
    )


def resolved(captures: DataFrame) -> DataFrame:
    """``captures`` (stored) with ``payload_bytes, payload_digest`` of the whole payload and ``original``, the row of
    ``capture_id, metadata`` that a revisit refers to (null for responses and where that is not in the archive)."""
    of = captures.where("response.record_type = 'response'").select(
        F.col("capture_id").alias("_refers"),
        F.struct("capture_id", "metadata", F.col("response.payload_bytes").alias("payload_bytes")).alias("original"),
    )
    refers = F.when(F.col("response.record_type") == "revisit", F.col("response.refers_to"))
    found = looked_up(captures.withColumn("_refers", refers), of, ["_refers"])
    size = F.coalesce("response.payload_bytes", "original.payload_bytes").alias("payload_bytes")
    return found.select(*captures.columns, size, F.col("response.payload_digest").alias("payload_digest"), "original")


def field(metadata: str, name: str) -> Column:
    """The first value of a named field in an array of metadata records."""
    fields = F.flatten(F.transform(F.col(metadata), lambda m: F.coalesce(m["fields"], F.array())))
    return F.get(F.filter(fields, lambda f: f["name"] == name), F.lit(0))["value"]
