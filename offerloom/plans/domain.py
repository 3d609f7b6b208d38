"""Domain tables, derived from the test tables by SQL that both Spark and DuckDB run.

Only the derivations are shared; what queries do with these tables is written twice, as operators and as SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "pages")

TABLES = {
    "farm": """
        SELECT s_suppkey AS farm_id, s_name AS farm_name, n_name AS country, CASE WHEN s_nationkey % 2 = 0 THEN 'USD'
          ELSE 'EUR' END AS default_currency,
               CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_nationkey END AS origin_id
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "location": """
        SELECT n_nationkey AS location_id, n_name AS country, CASE n_nationkey WHEN 3 THEN 'Quito' WHEN 5 THEN 'BOGOTÁ'
          ELSE 'City ' || CAST(n_nationkey AS STRING) END AS city,
               CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE substr(n_name, 1, 3) END AS code
        FROM {nation}""",
    "article": """
        SELECT l_suppkey * 10000000 + l_partkey AS article_id, l_suppkey AS farm_id, l_partkey AS variant_id, p_type AS product_id,
          p_type AS product_name,
               CASE WHEN l_partkey % 7 = 0 THEN 'Garden ' || p_name ELSE p_name END AS variety, p_brand AS color,
               CASE l_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN CAST(p_size AS STRING) || ' cm'
                 ELSE CAST(p_size AS STRING) END AS stem_length,
               CASE l_partkey % 3 WHEN 0 THEN 'QB' WHEN 1 THEN 'HB' ELSE 'FB' END AS box_type,
               CASE l_partkey % 7 WHEN 0 THEN 20 WHEN 1 THEN 25 WHEN 2 THEN 40 WHEN 3 THEN 50 WHEN 4 THEN 100 WHEN 5 THEN 125
                 ELSE 200 END AS stems_per_box,
               CAST(CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE (l_partkey % 23 + 2) * 0.5 END AS DECIMAL(10,3)) AS box_weight
        FROM (SELECT DISTINCT l_suppkey, l_partkey FROM {lineitem}) x JOIN {part} ON l_partkey = p_partkey""",
    "line": """
        SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS line_id,
               l_orderkey AS offer_id, l_suppkey AS farm_id, l_partkey AS part_id, l_suppkey * 10000000 + l_partkey AS own_article,
               CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE lower(p_type) END AS product_name,
               CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE upper(p_name) || '!' END AS variety,
               CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS length_cm,
               CAST(quantity AS INT) AS quantity,
               CAST((l_partkey % 400 + 5) * 0.0025 AS DECIMAL(10,4)) AS fob,
               CASE WHEN l_suppkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency,
               CASE l_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'STEMS' WHEN 2 THEN 'BUNCHES' WHEN 3 THEN 'KILOGRAMS'
                 ELSE 'BOXES' END AS unit,
               CASE l_orderkey % 3 WHEN 0 THEN 'REVIEWED' WHEN 1 THEN 'DRAFT' ELSE 'REVIEWED' END AS offer_status,
               'Row ' || CAST(l_partkey % 50 AS STRING) || ' ' || p_name || CASE WHEN l_partkey % 10 = 0 THEN ' 40-60 cm'
                 ELSE '' END AS raw_text
        FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(l_quantity) AS quantity FROM {lineitem}
          GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey) x
        JOIN {part} ON l_partkey = p_partkey""",
    "buyer": """
        SELECT c_custkey AS customer_id, c_name AS customer_name, c_nationkey AS destination_id, CASE WHEN c_custkey % 2 = 0 THEN 'USD'
          ELSE 'EUR' END AS target_currency,
               CASE c_custkey % 3 WHEN 0 THEN 'FOB' WHEN 1 THEN 'CFR' ELSE 'DDP' END AS incoterm,
               CAST(CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 10 + c_custkey % 15 END AS DECIMAL(6,3)) AS margin_pct
        FROM {customer}""",
    "request": """
        SELECT o_orderkey AS request_id, o_custkey AS customer_id FROM {orders} UNION SELECT o_orderkey, o_custkey + 1 FROM {orders}""",
    "route": """
        SELECT o.n_nationkey * 100 + d.n_nationkey + 10000 * v AS route_id, o.n_nationkey AS origin_id, d.n_nationkey AS destination_id,
               CASE WHEN (o.n_nationkey + d.n_nationkey + v) % 3 = 0 THEN 'SEA' ELSE 'AIR' END AS transport,
               CAST(CASE WHEN v = 0 THEN '2024-01-02' ELSE '2024-01-01' END AS TIMESTAMP) AS created_at,
               (o.n_nationkey + d.n_nationkey) % 9 <> 1 AS supports_cfr, (o.n_nationkey * 2 + d.n_nationkey) % 8 <> 1 AS supports_ddp
        FROM {nation} o JOIN {nation} d ON o.n_nationkey <> d.n_nationkey JOIN (SELECT 0 AS v UNION ALL SELECT 1 AS v) k ON v = 0
          OR (o.n_nationkey + d.n_nationkey) % 4 = 0""",
    "tariff": """
        SELECT route_id * 10 + v AS tariff_id, route_id,
          CAST(((origin_id * 3 + destination_id * 5 + v) % 40 + 10) * 0.1 AS DECIMAL(10,4)) AS rate,
               CASE (origin_id + destination_id) % 4 WHEN 0 THEN 'PER_BOX' WHEN 1 THEN 'PER_STEM' ELSE 'PER_KG' END AS rate_unit,
               CAST(CASE v WHEN 0 THEN '2024-01-01' WHEN 1 THEN '2024-03-01' ELSE '2025-01-01' END AS TIMESTAMP) AS effective_from,
               CAST(CASE WHEN v = 0 THEN '2024-02-01' END AS TIMESTAMP) AS effective_to, CAST('2024-04-01' AS TIMESTAMP) AS updated_at
        FROM {route} JOIN (SELECT 0 AS v UNION ALL SELECT 1 AS v UNION ALL SELECT 2 AS v) k ON (origin_id * 7 + destination_id) % 6 <> 0
          AND (v = 0 OR (origin_id + v) % 3 <> 0)""",
    "current_tariff": """
        SELECT route_id, rate, rate_unit FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY tariff_id) AS n FROM {tariff}) x
          WHERE n = 1""",
    "cost": """
        SELECT route_id * 10 + v AS cost_id, route_id, CASE WHEN v = 4 THEN NULL ELSE v END AS cost_type_id,
               CASE v WHEN 0 THEN 'CLEARING' WHEN 1 THEN 'INSPECTION' WHEN 2 THEN 'HANDLING' WHEN 3 THEN 'OTHER'
                 ELSE 'HANDLING' END AS category,
               CASE v WHEN 0 THEN 'Customs' WHEN 1 THEN ' customs' WHEN 2 THEN 'Handling' WHEN 3 THEN NULL
                 ELSE 'Extra Handling' END AS name,
               CAST(((origin_id + destination_id * 3 + v) % 30 + 1) * 0.01 AS DECIMAL(10,4)) AS amount,
               CASE v WHEN 0 THEN 'FLAT' WHEN 1 THEN 'PER_KG' WHEN 2 THEN 'PER_STEM' ELSE 'PER_BOX' END AS unit,
               CAST('2024-01-01' AS TIMESTAMP) AS effective_from, CAST(NULL AS TIMESTAMP) AS effective_to,
                 CAST('2024-01-01' AS TIMESTAMP) AS updated_at
        FROM {route} JOIN (SELECT 0 AS v UNION ALL SELECT 1 AS v UNION ALL SELECT 2 AS v UNION ALL SELECT 3 AS v UNION ALL
          SELECT 4 AS v) k ON (origin_id + destination_id + v) % 7 <> 0""",
    "fx": """
        SELECT 'EUR' AS base, 'USD' AS quote, CAST(CASE month(m) % 5 WHEN 0 THEN 1.25 WHEN 1 THEN 1.6 WHEN 2 THEN 0.8 WHEN 3 THEN 2
          ELSE 1 END AS DECIMAL(12,6)) AS rate,
               m AS effective_from, CASE WHEN month(m) % 4 = 0 THEN m + INTERVAL 20 DAY END AS effective_to
        FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m FROM {orders}) x""",
    "offer_text": """
        SELECT part_id * 100 + farm_id % 100 AS text_id, min(
          CASE part_id % 11
            WHEN 0 THEN CAST(part_id % 30 AS STRING) || 'QB x ' || CAST(part_id % 7 * 20 + 20 AS STRING) || ' Rose ' || p_name || ' select $0.' || CAST(part_id % 90 + 10 AS STRING) || ' | tinted 0.' || CAST(part_id % 80 + 11 AS STRING)
            WHEN 1 THEN CAST(part_id % 30 + 1 AS STRING) || 'HBx40 carnations ' || p_name || ' €1,' || CAST(part_id % 90 + 10 AS STRING)
            WHEN 2 THEN 'Hello, good morning ' || p_name || ' $1'
            WHEN 3 THEN p_name || ' (additional time required ' || CAST(part_id % 96 AS STRING) || ' HR) 5 FB * 100 $' || CAST(part_id % 9 AS STRING) || '.50'
            WHEN 4 THEN 'HYD premium blue ' || CAST(part_id % 9 + 1 AS STRING) || ' fb 30'
            WHEN 5 THEN CAST(part_id % 8 * 10 + 20 AS STRING) || ' cm : $0.' || CAST(part_id % 90 + 10 AS STRING)
            WHEN 6 THEN 'Freedom ' || CAST(part_id % 4 * 10 + 30 AS STRING) || '-' || CAST(part_id % 4 * 10 + 50 AS STRING) || 'cm 12QB 40'
            WHEN 7 THEN 'subject: ' || p_name || ' $2'
            WHEN 8 THEN '   '
            WHEN 9 THEN 'Alstro mix tinted $ 1.234,50 10qb×25 | painted $0.9 | mystery'
            ELSE 'Crème Brûlée ' || p_name || ' 60cm $.5' END) AS text
        FROM (SELECT part_id, farm_id, p_name FROM {line} JOIN {part} ON part_id = p_partkey) x GROUP BY part_id * 100 + farm_id % 100""",
    "quote_line": """
        SELECT l.offer_id AS quote_id, l.line_id AS line_id, l.own_article AS article_id, l.farm_id AS farm_id,
          a.stems_per_box AS stems_per_box, l.quantity AS quantity_boxes, a.box_type AS box_type,
               a.product_name AS product_group, a.variety AS variety, a.stem_length AS stem_length, l.raw_text AS raw_text,
               CAST(l.fob * 1.25 AS DECIMAL(12,6)) AS calculated_price, CAST(CASE
                 WHEN l.part_id % 10 = 0 THEN l.fob * 2 END AS DECIMAL(12,6)) AS manual_price
        FROM {line} l JOIN {article} a ON l.own_article = a.article_id""",
}


def needs(sql: str) -> list[str]:
    """Domain tables that a statement refers to, what they need before them."""
    out: list[str] = []
    for name in re.findall(r"\{(\w+)\}", sql):
        if name in TABLES:
            out += [n for n in (*needs(TABLES[name]), name) if n not in out]
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base or domain table."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = TABLES[name]
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in dict.fromkeys(re.findall(r"\{(\w+)\}", sql))})


def duckdb_sql(sql: str) -> str:
    """A statement over {tables} with their derivations before it."""
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    ctes = [f"{n} AS ({plain(TABLES[n])})" for n in needs(sql)]
    body = plain(sql).strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {', '.join([*ctes, body[15:]])}"
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join([*ctes, body[5:]])}" if ctes else body
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
