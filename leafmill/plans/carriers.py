"""Views over the supplied tables that give the operators something to work on.

Each is one SQL text that Spark and DuckDB both read ({name} stands for a table), so both engines
start from the same rows. No table holds headings, pipes, outlines or jobs by itself.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

CARRIERS = {
    # Titles of many numbering schemes, over all parts.
    "titles": """
SELECT p_partkey AS id, (p_partkey - p_partkey % 40) AS doc_id, p_partkey AS ord,
  CASE p_partkey % 20
    WHEN 0 THEN 'A.' || CAST(p_partkey % 7 + 1 AS STRING)
    WHEN 1 THEN 'A.' || CAST(p_partkey % 7 + 1 AS STRING) || '.' || CAST(p_partkey % 3 + 1 AS STRING) || ' Umfang'
    WHEN 2 THEN 'A1-' || CAST(p_partkey % 9 AS STRING)
    WHEN 3 THEN 'A1‑' || CAST(p_partkey % 9 AS STRING) || '.' || CAST(p_partkey % 4 AS STRING) || ' Leistung'
    WHEN 4 THEN 'Teil A'
    WHEN 5 THEN 'Abschnitt A' || CAST(p_partkey % 5 AS STRING) || ' Haftung'
    WHEN 6 THEN 'T e i l   A'
    WHEN 7 THEN 'A(GB)-' || CAST(p_partkey % 6 AS STRING) || ': Terms'
    WHEN 8 THEN '§ 3.' || CAST(p_partkey % 8 AS STRING) || ' Fristen'
    WHEN 9 THEN '3.' || CAST(p_partkey % 8 AS STRING) || '.1'
    WHEN 10 THEN 'المادة ٩'
    WHEN 11 THEN 'الباب الأول'
    WHEN 12 THEN '  ' || p_name || ' – ' || p_brand || '  '
    WHEN 13 THEN 'A'
    WHEN 14 THEN 'A1'
    WHEN 15 THEN 'Was gilt für ' || p_type || '?'
    WHEN 16 THEN 'B' || CAST(p_partkey % 9 AS STRING)
    WHEN 17 THEN 'A.1.' || CAST(p_partkey % 7 + 1 AS STRING) || '.2.1.1.1 Tief'
    WHEN 18 THEN 'Anhang — ' || p_brand
    ELSE p_name END AS title
FROM {part}""",
    # C1: regions, nations and customers as headings of three levels.
    "geo_lines": """
SELECT r.r_regionkey AS doc_id, 0 AS k1, 0 AS k2, '# ' || r.r_name AS line FROM {region} r
UNION ALL SELECT n.n_regionkey, n.n_nationkey + 1, 0, '## ' || n.n_name FROM {nation} n
UNION ALL SELECT n.n_regionkey, n.n_nationkey + 1, CAST(c.c_custkey + 1 AS INT),
  '### ' || c.c_name || chr(10) || 'segment ' || c.c_mktsegment FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    # C13: the same, broken in two of five documents.
    "geo_broken": """
SELECT doc_id, k1, k2, CASE WHEN doc_id = 1 AND k2 % 3 = 1 THEN line || ' �' WHEN doc_id = 3 THEN line || chr(1) || chr(2) || chr(3) || chr(4) ELSE line END AS line
FROM {geo_lines}""",
    # C2: a pipe table of orders per customer.
    "order_lines": """
SELECT o.o_custkey AS doc_id, 0 AS pos0, CAST(0 AS BIGINT) AS k, '| order | status | total |' AS line FROM (SELECT DISTINCT o_custkey FROM {orders}) o
UNION ALL SELECT o.o_custkey, 1, CAST(0 AS BIGINT), '| --- | :-: | ---: |' FROM (SELECT DISTINCT o_custkey FROM {orders}) o
UNION ALL SELECT o_custkey, 2, o_orderkey, '| ' || CAST(o_orderkey AS STRING) || ' | ' || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderstatus END || ' | '
  || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) || ' |' FROM {orders}""",
    # C3: a table cut in two: labels and years, then years only.
    "wide_tables": """
SELECT p_partkey AS doc_id,
  CASE WHEN p_partkey % 5 = 0 THEN 'البند' ELSE 'Item' END AS label, CAST(2015 + p_partkey % 3 AS STRING) AS y1, CAST(2018 + p_partkey % 3 AS STRING) AS y2,
  CASE WHEN p_partkey % 4 = 3 THEN 'Note' ELSE CAST(2021 + p_partkey % 2 AS STRING) END AS y3,
  CASE WHEN p_partkey % 5 = 0 THEN 'قيمة' ELSE p_name END AS n1, CAST(p_size AS STRING) AS v1, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE CAST(p_size + 1 AS STRING) END AS v2,
  CASE WHEN p_partkey % 6 = 0 THEN '' ELSE CAST(p_size + 2 AS STRING) END AS v3
FROM {part}""",
    # C7: nations and suppliers as an outline, customers as headings with pages.
    "outline": """
SELECT n_regionkey AS doc_id, n_nationkey * 100000 AS i, 1 AS level, n_name AS title, n_nationkey * 40 + 1 AS page FROM {nation}
UNION ALL SELECT n.n_regionkey, CAST(n.n_nationkey * 100000 + s.s_suppkey + 1 AS INT), 2, s.s_name, CAST(n.n_nationkey * 40 + 2 + s.s_suppkey % 37 AS INT)
FROM {supplier} s JOIN {nation} n ON s.s_nationkey = n.n_nationkey""",
    "outline_heads": """
SELECT n.n_regionkey AS doc_id, CAST(c.c_custkey AS INT) AS ord,
  CASE WHEN c.c_custkey % 11 = 0 THEN n.n_name WHEN c.c_custkey % 3 = 0 THEN c.c_mktsegment ELSE c.c_name END AS title,
  CAST(n.n_nationkey * 40 + 1 + c.c_custkey % 40 AS INT) AS page
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey""",
    # C9: job events; a user is a job, an event's kind a transition.
    "job_log": """
SELECT CAST(user_id AS STRING) AS job_id, event_id AS seq, event_id * 60 AS ts,
  CASE WHEN event_id % 10 < 3 THEN 'pending' WHEN event_id % 10 < 6 THEN 'processing' WHEN event_id % 10 < 8 THEN 'error' ELSE 'done' END AS event,
  CAST(event_id % 3 + 1 AS INT) AS attempt,
  CASE WHEN event_id % 10 IN (6, 7) THEN CASE event_id % 4 WHEN 0 THEN 'LowQualityTreeError' WHEN 1 THEN 'TimeoutError' WHEN 2 THEN 'MemoryError' ELSE 'OSError' END END AS error,
  CASE WHEN event_id % 10 > 7 THEN 'd' || CAST(event_id AS STRING) END AS doc_id
FROM {events}""",
    # C10: load-test samples.
    "samples": """
SELECT CAST(event_id % 12 AS INT) AS step, event_type AS tool, CAST(floor(value * 100) AS BIGINT) AS latency_ms,
  CASE WHEN event_id % 17 = 0 THEN 500 WHEN event_id % 23 = 0 THEN 404 WHEN event_id % 29 = 0 THEN 0 ELSE 200 END AS status
FROM {events}""",
    # C11: conversations as documents whose turns are pages.
    "turn_nodes": """
SELECT conv_id AS doc_id, 'n' || CAST(turn AS STRING) AS node_id, CAST(turn AS INT) AS ord, role AS title, text,
  CASE WHEN turn % 5 = 4 THEN NULL ELSE CAST(turn AS INT) END AS start_index, CASE WHEN turn % 5 = 4 THEN NULL ELSE CAST(turn + conv_id % 2 AS INT) END AS end_index,
  CASE WHEN role = 'assistant' THEN CAST(turn AS INT) - 1 END AS parent_ord
FROM {conversations}""",
    # C12: uploads of documents, some known, some changed, some under another name.
    "uploads": """
SELECT doc_id, source || '-' || CAST(doc_id % 50 AS STRING) || '.md' AS filename, text FROM {documents}""",
    "objects": """
SELECT 'processed/' || CAST(doc_id AS STRING) || CASE doc_id % 3 WHEN 0 THEN '.meta.json' WHEN 1 THEN '.flat.json' ELSE '.json' END AS key, CAST(doc_id AS STRING) AS doc_id,
  CASE doc_id % 3 WHEN 0 THEN 'meta' WHEN 1 THEN 'flat' ELSE 'tree' END AS kind, CASE WHEN doc_id % 7 > 0 THEN source || '.md' END AS doc_name,
  CASE WHEN doc_id % 2 = 0 THEN source || '.txt' END AS filename, CAST(NULL AS STRING) AS source_url, CAST(n_chars AS STRING) AS processed_at,
  CASE WHEN doc_id % 3 = 1 THEN 'flat_prose' END AS content_class, doc_id % 13 > 0 AS readable FROM {documents}
UNION ALL SELECT 'processed/' || CAST(doc_id AS STRING) || '.v1.json', CAST(doc_id AS STRING), 'tree', 'old ' || source, CAST(NULL AS STRING), 'u', CAST(NULL AS STRING), CAST(NULL AS STRING), true
FROM {documents} WHERE doc_id % 2 = 0 OR doc_id % 13 = 0""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z_]\w*)\}", sql)))


def carrier(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in CARRIERS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = CARRIERS[name]
    return spark.sql(sql, **{n: carrier(spark, sf_dir, n) for n in _names(sql)})


def carrier_sql(sql: str) -> str:
    """A DuckDB query over carriers, each as a common table expression."""
    ctes: dict[str, str] = {}

    def add(name: str) -> None:
        if name in CARRIERS and name not in ctes:
            for n in _names(CARRIERS[name]):
                add(n)
            ctes[name] = CARRIERS[name].format(**{n: n for n in _names(CARRIERS[name])})

    for n in _names(sql):
        add(n)
    body = re.sub(r"\{([a-z_]\w*)\}", r"\1", sql).strip()
    if not ctes:
        return body
    head = "WITH " + ",\n".join(f"{n} AS ({x})" for n, x in ctes.items())
    return f"{head},\n{body[5:]}" if body.startswith("WITH ") else f"{head}\n{body}"
