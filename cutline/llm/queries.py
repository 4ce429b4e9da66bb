"""The registered queries of these operators, each over its whole table, and their SQL checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm import (
    decontaminate, html_blocks, language_model, near_copies, neighbours, phrases, pieces, pii, quality, repeats, resampling, shards, warc,
)
from cutline.llm.common import remainder, stored, table
from cutline.session import scratch_path


def _joined(finds: Column | str) -> Column:
    return F.array_join(F.transform(finds, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and hash are of the base finds, ``spans`` holds all; ``n_added`` says how many the method adds."""
    found = pii.spans(table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda f: f["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"),
        _joined("finds").alias("spans"),
        (F.size("finds") - F.size("base")).cast("long").alias("n_added"),
    )


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op3_lm_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op4_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_blocks.extract(pages, html_blocks.fitted(pages))


def op5_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``spans`` lists what was cut out, as start:end in bytes."""
    cut = repeats.removed(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return cut.withColumn("spans", spans)


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.classes(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.judged(found).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op8_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: no text, equal to another or not, is tied to a shard; counts are at most one apart."""
    placed = shards.interleave(table(spark, sf_dir, "documents"), 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"))


def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), quality.FOLDS) == quality.HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives are written, read and assembled; every column comes from the captures, page ids from their metadata."""
    archive = scratch_path(spark, "archive")
    warc.write(table(spark, sf_dir, "pages"), archive)
    captures = stored(warc.assemble(stored(warc.read(spark, archive), "records")), "captures")
    return warc.resolved(captures).select(
        warc.field("metadata", "page-id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("response.record_type").alias("record_type"),
        warc.field("original.metadata", "page-id").cast("long").alias("refers_to"),
    )


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_phrase_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii, op2_cross_polytope, op3_lm_log_bilinear, op4_html_blocks, op5_run_length_dedup, op6_order_minhash, op7_decontaminate,
        op8_interleave, op9_nbest_pieces, op10_quality_gam, op11_warc, op12_importance_resampling, op13_phrase_stripes,
    )
}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = f"regexp_extract_all(translate({{}}, '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

# The others are models, spans of disguised text, or copies of the corpus's own bytes: tests/llm has brute-force versions.
ORACLE = {
    "op7_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
ip AS (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS p FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM ip),
dp AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw)),
h AS (SELECT r, p, n, item FROM (SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM dp) JOIN iw USING (n, k)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(s, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)""",
    # The checksum of each text by a table made from its polynomial, byte by byte.
    "op8_interleave": """
WITH RECURSIVE t AS (SELECT i, i AS c, 0 AS k FROM range(256) x(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS l FROM t WHERE k = 8),
hx AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT doc_id, coalesce('=' || source, '') AS stratum, len(h) // 2 + 1 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(range(1, len(h), 2), lambda i: CAST('0x' || h[i:i+1] AS BIGINT))), lambda c, x: xor(c >> 8, l[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32,
  md5('mixture:' || coalesce(doc_id::VARCHAR, '')) AS shuffle FROM hx, tab),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY shuffle, doc_id NULLS FIRST, text_crc32, size) AS rank, count(*) OVER (PARTITION BY stratum) AS n,
  CAST('0x' || substr(md5('mixture/' || stratum), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS phase FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY (rank - phase) / n, stratum, rank) - 1 AS position, count(*) OVER () AS total FROM r)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (position * 8 // total)::INTEGER AS shard, position - ((position * 8 // total) * total + 7) // 8 AS slot, NULL::INTEGER AS grown_shard FROM p""",
    "op11_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS head FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < head THEN head END AS refers_to FROM r""",
    "op12_importance_resampling": f"""
WITH RECURSIVE t AS (SELECT i, i AS c, 0 AS k FROM range(256) x(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS l FROM t WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
dw AS (SELECT r, unnest(w) AS word FROM d),
bw AS (SELECT unnest({_WORDS.format('text')}) AS word FROM benchmark WHERE text IS NOT NULL),
hx AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
wb AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda i: CAST('0x' || h[i:i+1] AS BIGINT))),
  lambda c, x: xor(c >> 8, l[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS b FROM hx, tab),
s AS (SELECT b, count(*) AS s FROM dw JOIN wb USING (word) GROUP BY b), q AS (SELECT b, count(*) AS t FROM bw JOIN wb USING (word) GROUP BY b),
g AS (SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1) * (SELECT sum(s) + 10000 FROM s))::DOUBLE / ((s + 1) * (SELECT coalesce(sum(t), 0) + 10000 FROM q))::DOUBLE))::BIGINT AS gain FROM s LEFT JOIN q USING (b)),
m AS (SELECT r, floor(sum(gain) / count(*))::BIGINT AS weight FROM dw JOIN wb USING (word) JOIN g USING (b) GROUP BY r),
u AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  CAST('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (r)),
v AS (SELECT r, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM u),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS rank FROM v WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM k) THEN rank END AS rank FROM v LEFT JOIN k USING (r)""",
    "op13_phrase_stripes": f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
i AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 4) x(m)),
f AS (SELECT lang, m, w[i:i + m - 1] AS p, count(*) AS a FROM i GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1 AND a >= 10),
b AS (SELECT lang, p, max(a) AS longer FROM (SELECT lang, a, unnest([p[1:2], p[2:3]]) AS p FROM c WHERE m = 3) GROUP BY ALL),
k AS (SELECT lang, p, a, m, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.p, k.a, k.k, l.a AS l, r.a AS r, (1000000::HUGEINT * k.a * k.a // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.p = k.p[1:k.k] JOIN f r ON r.lang = k.lang AND r.p = k.p[k.k + 1:k.m]),
z AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
y AS (SELECT lang, array_to_string(z.p, ' ') AS phrase, a, l, r, score FROM z LEFT JOIN b USING (lang, p) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM y JOIN n USING (lang) QUALIFY rank <= 2000""",
}
