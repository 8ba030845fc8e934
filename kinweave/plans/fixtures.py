"""Tables of the engine's shape from the driver's tables: orders are records, the parts of their lines are contexts, orders of one customer and priority are candidate pairs. The text serves Spark and DuckDB alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "er_primary": """SELECT CAST(o_orderkey AS STRING) AS id, o_orderpriority AS title, o_orderstatus AS venue,
        CAST(year(o_orderdate) AS STRING) AS year, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS side FROM orders""",
    "er_mentions": """SELECT CAST(l_orderkey AS STRING) AS id, CAST(row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS pos, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "er_pairs": """SELECT CAST(a.o_orderkey AS STRING) AS ltable_id, CAST(b.o_orderkey AS STRING) AS rtable_id,
        CAST(CASE WHEN a.o_orderstatus = b.o_orderstatus THEN 1 ELSE 0 END AS INT) AS label,
        CASE WHEN (a.o_orderkey + b.o_orderkey) % 5 = 0 THEN 'valid' WHEN (a.o_orderkey + b.o_orderkey) % 5 = 1 THEN 'test' ELSE 'train' END AS split
        FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderkey < b.o_orderkey""",
    "er_hyperedges": "SELECT DISTINCT CAST(l_partkey AS STRING) AS id, CAST(l_suppkey AS STRING) AS ctx FROM lineitem",
    "er_orders_parts": "SELECT DISTINCT CAST(l_orderkey AS STRING) AS id, CAST(l_partkey AS STRING) AS ctx FROM lineitem",
    "er_order_lines": "SELECT CAST(l_orderkey AS STRING) AS id, CAST(l_partkey AS STRING) AS ctx FROM lineitem",
    "er_names": "SELECT doc_id, concat(split_part(text, ' ', 1), ' ', split_part(text, ' ', 2)) AS name FROM documents",
}
_TABLES = ("orders", "lineitem", "part", "documents")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables. Only the columns it names are read."""
    text, tables = SQL[name], {}
    for t in _TABLES:
        if re.search(rf"\b(FROM|JOIN) {t}\b", text):
            text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
            tables[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    # An alias after a formatted table needs its view's name in front; Spark gives each frame one.
    return spark.sql(text, **tables)


def with_fixtures(sql: str, *more: str) -> str:
    """The SQL with the fixtures that it names (and ``more`` parts) in front."""
    used = [n for n in SQL if re.search(rf"\b{n}\b", sql + " ".join(more))]
    parts = [f"{n} AS ({SQL[n]})" for n in used] + list(more)
    return f"WITH RECURSIVE {', '.join(parts)} {sql}"
