"""Graphs over ordinary star-schema tables, as SQL that Spark and DuckDB read alike.

``parts``: parts that follow each other in an order; cyclic. ``sales``: nations,
customers, orders, parts and suppliers; deep and acyclic. ``exports``: edge kinds, names
and requested ids on top of ``parts``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "part_edges": """
SELECT src, dst, max(dyn) AS dyn FROM (
  SELECT l_partkey AS src, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS dyn,
    lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem
) t WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst""",
    "export_edges": """
SELECT src, dst, CASE WHEN dyn = 1 AND (src + dst) % 5 = 0 THEN 'dyn' WHEN (src + dst) % 4 = 0 THEN 'imp'
    WHEN (src + dst) % 4 = 3 THEN 'star' ELSE 'reexp' END AS kind,
  concat('m', CAST(src % 12 + 1 AS STRING)) AS name, concat('m', CAST((src + dst) % 12 + 1 AS STRING)) AS id FROM part_edges""",
    "own_names": "SELECT DISTINCT l_partkey AS module, concat('m', CAST(month(l_shipdate) AS STRING)) AS name FROM lineitem WHERE l_linenumber <= 2",
    "order_parts": """
SELECT l_orderkey AS o, l_partkey AS p, max(CASE WHEN l_returnflag = 'R' AND l_quantity >= 40 THEN 1 ELSE 0 END) AS dyn
FROM lineitem GROUP BY l_orderkey, l_partkey""",
    "part_supplier": "SELECT l_partkey AS p, min(l_suppkey) AS s FROM lineitem GROUP BY l_partkey",
    "sales_static": """
SELECT concat('n', CAST(s_nationkey AS STRING)) AS src, concat('s', CAST(s_suppkey AS STRING)) AS dst FROM supplier
UNION SELECT concat('n', CAST(c_nationkey AS STRING)), concat('c', CAST(c_custkey AS STRING)) FROM customer
UNION SELECT concat('o', CAST(l_orderkey AS STRING)), concat('s', CAST(l_suppkey AS STRING)) FROM lineitem
UNION SELECT concat('o', CAST(o AS STRING)), concat('p', CAST(p AS STRING)) FROM order_parts WHERE dyn = 0
UNION SELECT concat('p', CAST(p AS STRING)), concat('s', CAST(s AS STRING)) FROM part_supplier""",
    "sales_dynamic": """
SELECT concat('c', CAST(o_custkey AS STRING)) AS origin, concat('o', CAST(o_orderkey AS STRING)) AS target FROM orders
UNION SELECT concat('o', CAST(o AS STRING)), concat('p', CAST(p AS STRING)) FROM order_parts WHERE dyn = 1""",
    "sales_entries": "SELECT concat('n', CAST(n_nationkey AS STRING)) AS entry FROM nation",
    "file_events": """
SELECT event_id, ts, user_id, event_type, value, concat('/', event_type, '/u', CAST(user_id AS STRING), '/f', CAST(event_id % 50 AS STRING)) AS path,
  CASE WHEN event_type = 'error' THEN 'removed' WHEN event_type = 'signup' THEN 'context' ELSE 'modified' END AS kind FROM events""",
    "page_paths": "SELECT page_id, url, regexp_replace(regexp_replace(url, '^[a-z]+://', '/'), '[?#].*$', '') AS path FROM pages",
}
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def needs(sql: str) -> list[str]:
    """The views that a query reads, those they read themselves first."""
    out: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            out += [x for x in [*needs(VIEWS[name]), name] if x not in out]
    return out


def duckdb_sql(sql: str) -> str:
    """A query that reads views, as one that reads tables only."""
    views = ", ".join(f"{v} AS ({VIEWS[v].strip().replace('AS STRING', 'AS VARCHAR')})" for v in needs(sql))
    if not views:
        return sql
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if not head:
        return f"WITH {views} {sql}"
    return f"WITH {head[1] or ''}{views}, {sql[head.end() :]}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view's DataFrame, over the Parquet tables in sf_dir."""
    sql, inner = VIEWS[name], {}
    for v in VIEWS:
        if re.search(rf"\b{v}\b", sql):
            inner[v] = view(spark, sf_dir, v)
            sql = re.sub(rf"\b{v}\b", "{" + v + "}", sql)
    for t in TABLES:
        if re.search(rf"\bFROM {t}\b", sql):
            inner[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            sql = re.sub(rf"\bFROM {t}\b", "FROM {" + t + "}", sql)
    return spark.sql(sql, **inner)
