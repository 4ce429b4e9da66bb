"""Fleet matching, priority report, siblings: parts stand in for cards, ordered quantities for stock."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.common import derive, table
from cutline.functions.names import norm_name
from cutline.operators import match as M
from cutline.operators import report as R
from cutline import schemas

HIGH, MEDIUM = 2000, 1000
MIN_STOCK = 600

CARD = {
    "id": "concat('p', p_partkey)",
    "brand": "p_brand",
    "model_name": "CASE WHEN p_partkey % 97 = 0 THEN NULL WHEN p_partkey % 89 = 0 THEN ' ' "
    "WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(replace(p_name, ' ', '.')) END",
    "status": "CASE WHEN p_partkey % 3 = 0 THEN 'Downloaded' ELSE 'MetadataOnly' END",
}


def cards(spark, sf):
    return derive(table(spark, sf, "part"), **CARD)


def stock(spark, sf):
    """Ordered quantity per brand and name, as a sheet would list it; rare names are not published."""
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name")
    sold = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    return (
        sold.join(part, sold["l_partkey"] == part["p_partkey"])
        .groupBy("p_brand", "p_name")
        .agg(F.sum("q").cast("int").alias("count"), F.min("p_partkey").cast("int").alias("row_no"))
        .where(F.col("count") >= MIN_STOCK)
        .select(
            F.lit(2026).alias("year"),
            "row_no",
            F.lit("segment").alias("segment"),
            F.upper("p_brand").alias("brand_label"),
            F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("model_series"),
            "count",
        )
    )


def labels(spark, sf):
    """Every brand under its own label; Brand#25 is also counted under Brand#1."""
    own = table(spark, sf, "part").select("p_brand").distinct()
    own = own.select(F.col("p_brand").alias("brand"), F.col("p_brand").alias("label"))
    extra = schemas.literal_frame(spark, [("Brand#25", "BRAND 1")], own.schema)
    return own.unionByName(extra)


def aliases(spark, sf):
    """Two names per brand under another name's series; the second one names a series twice."""
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("brand")).distinct()
    rows = F.array(
        *[
            F.struct(F.lit(pos).alias("pos"), F.lit(a).alias("model_name"), F.lit(b).alias("model_series"))
            for pos, a, b in ((0, "hot rod", "RED GEAR"), (1, "Cold-Ring", "old bolt"), (2, "cold ring", "hot ring"))
        ]
    )
    return brands.select("brand", F.explode(rows).alias("r")).select("r.pos", "brand", "r.model_name", "r.model_series")


def lookup(spark, sf):
    return M.fleet_lookup(M.stock_index(stock(spark, sf), labels(spark, sf)), aliases(spark, sf))


def flagship(spark, sf):
    return R.report_by_model(cards(spark, sf), lookup(spark, sf), HIGH, MEDIUM)


def report_of_cards(spark, sf):
    matched = M.match_fleet(
        cards(spark, sf), stock(spark, sf), labels(spark, sf), aliases(spark, sf), HIGH, MEDIUM
    )
    return R.priority_report(matched)


def matched_cards(spark, sf):
    return M.attach_fleet(cards(spark, sf), lookup(spark, sf), HIGH, MEDIUM)


def index(spark, sf):
    return M.stock_index(stock(spark, sf), labels(spark, sf))


def alias_table(spark, sf):
    return M.alias_targets(aliases(spark, sf))


def distribution(spark, sf):
    return R.priority_distribution(matched_cards(spark, sf), schemas.priority_dim(spark))


def siblings(spark, sf):
    """Regions as platform groups, nations as their models; suppliers are cards of a nation."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    named = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    by_region = named.selectExpr(
        "r_regionkey AS group_pos", "r_name AS group_id", "r_name AS platform_name", "'B' AS brand", "lower(n_name) AS model_name"
    )
    by_letter = nation.selectExpr(
        "100 - n_regionkey AS group_pos", "concat('letter-', substr(n_name, 1, 1)) AS group_id", "'x' AS platform_name",
        "'B' AS brand", "concat(n_name, '!') AS model_name",
    ).where("n_nationkey % 2 = 0")
    supplier = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    cards_ = supplier.selectExpr(
        "concat('s', s_suppkey) AS id", "CASE WHEN s_suppkey % 10 = 0 THEN 'C' ELSE 'B' END AS brand", "n_name AS model_name"
    )
    out = M.attach_siblings(cards_, by_region.unionByName(by_letter))
    return out.select("id", F.array_join("sibling_model_ids", "|").alias("sibling_ids"))


def normalized_documents(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id",
        F.sha2(norm_name(F.col("text")), 256).alias("norm_hash"),
        F.length(norm_name(F.col("text"))).alias("norm_length"),
    )


def normalized_names(spark, sf):
    """Normalised keys of all words per language; equal words are counted before they are normalised."""
    words = table(spark, sf, "documents").select("lang", F.explode(F.split("text", " ")).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    return (
        counted.groupBy("lang", norm_name(F.col("word")).alias("name_key"))
        .agg(F.sum("n").alias("n"))
        .groupBy("lang")
        .agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("words"), F.max("n").alias("most"))
    )


_NORM = (
    "replace(upper(replace(regexp_replace(strip_accents({0}), '[^\\p{{L}}\\p{{Nd}}]', '', 'g'), 'ß', '{1}')), '{1}', 'ß')"
)


def norm_sql(c: str) -> str:
    return _NORM.format(c, "\ue000")


_CARDS_SQL = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in CARD.items()) + " FROM part"
_KEY = "CASE WHEN trim(model_name) <> '' THEN " + norm_sql("model_name") + " END"
_MATCH_CTE = f"""
cards AS ({_CARDS_SQL}),
stock AS (
  SELECT upper(p_brand) AS brand_label, upper(replace(p_name, ' ', '-')) AS model_series,
         CAST(sum(l_quantity) AS INTEGER) AS cnt, min(p_partkey) AS row_no
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, p_name
  HAVING sum(l_quantity) >= {MIN_STOCK}),
labels AS (SELECT DISTINCT p_brand AS brand, {norm_sql('p_brand')} AS lk FROM part
  UNION SELECT 'Brand#25', 'BRAND1'),
numbered AS (
  SELECT brand, {norm_sql('model_series')} AS k, cnt,
         row_number() OVER (PARTITION BY brand, {norm_sql('model_series')} ORDER BY row_no) AS rn
  FROM stock JOIN labels ON lk = {norm_sql('brand_label')}),
idx AS (SELECT brand, k, cnt FROM numbered WHERE rn = 1),
aliases AS (
  SELECT DISTINCT p_brand AS brand, a.name_key, a.series_key FROM part,
    (VALUES ('HOTROD', 'REDGEAR'), ('COLDRING', 'OLDBOLT')) AS a(name_key, series_key)),
matched AS (
  SELECT c.*, coalesce(d.cnt, v.cnt) AS estimated_fleet_size, d.cnt IS NULL AND v.cnt IS NOT NULL AS matched_via_alias
  FROM (SELECT *, {_KEY} AS k FROM cards) c
  LEFT JOIN idx d ON d.brand = c.brand AND d.k = c.k
  LEFT JOIN aliases a ON a.brand = c.brand AND a.name_key = c.k
  LEFT JOIN idx v ON v.brand = a.brand AND v.k = a.series_key),
prioritized AS (
  SELECT id, brand, model_name, status, estimated_fleet_size,
    CASE WHEN estimated_fleet_size IS NULL THEN 'Unknown' WHEN estimated_fleet_size >= {HIGH} THEN 'High'
         WHEN estimated_fleet_size >= {MEDIUM} THEN 'Medium' ELSE 'Low' END AS bundle_priority, matched_via_alias
  FROM matched)"""
_REPORT_SQL = f"""WITH {_MATCH_CTE}
SELECT brand, model_name, count(*) AS card_count, count(*) FILTER (status <> 'Downloaded') AS not_downloaded_count,
       min(estimated_fleet_size) AS estimated_fleet_size, min(bundle_priority) AS bundle_priority
FROM prioritized GROUP BY brand, model_name"""

QUERIES = {
    "flagship_priority_report": flagship,
    "priority_report_of_cards": report_of_cards,
    "match_fleet": matched_cards,
    "stock_index": index,
    "alias_targets": alias_table,
    "priority_distribution": distribution,
    "attach_siblings": siblings,
    "norm_name_documents": normalized_documents,
    "norm_name_words": normalized_names,
}

ORACLE = {
    "flagship_priority_report": _REPORT_SQL,
    "priority_report_of_cards": _REPORT_SQL,
    "match_fleet": f"WITH {_MATCH_CTE} SELECT * FROM prioritized",
    "stock_index": f"WITH {_MATCH_CTE} SELECT brand, k AS series_key, cnt AS count FROM idx",
    "alias_targets": f"WITH {_MATCH_CTE} SELECT * FROM aliases",
    "priority_distribution": f"""WITH {_MATCH_CTE}
SELECT p.bundle_priority, count(c.id) AS card_count
FROM (VALUES ('Unknown'), ('Low'), ('Medium'), ('High')) p(bundle_priority)
LEFT JOIN prioritized c ON c.bundle_priority = p.bundle_priority GROUP BY 1""",
    "attach_siblings": """
WITH g AS (
  SELECT r_regionkey AS pos, r_name AS gid, n_name AS k FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 100 - n_regionkey, 'letter-' || n_name[1], n_name FROM nation WHERE n_nationkey % 2 = 0),
m AS (SELECT k, string_agg(gid, '|' ORDER BY pos, gid) AS ids FROM (SELECT DISTINCT * FROM g) GROUP BY k)
SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE coalesce(ids, '') END AS sibling_ids
FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN m ON m.k = n_name""",
    "norm_name_documents": f"""SELECT doc_id, sha256({norm_sql('text')}) AS norm_hash,
CAST(length({norm_sql('text')}) AS INTEGER) AS norm_length FROM documents""",
    "norm_name_words": f"""
WITH w AS (SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents),
k AS (SELECT lang, {norm_sql('word')} AS name_key, count(*) AS n FROM w GROUP BY 1, 2)
SELECT lang, count(*) AS keys, CAST(sum(n) AS BIGINT) AS words, max(n) AS most FROM k GROUP BY lang""",
}
