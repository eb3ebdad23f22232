"""Catalogs, jobs and results made from the given tables, in SQL that Spark and DuckDB both read.

A relation for every customer and order, a schema for every nation, a result for every
line: the work of the queries over them grows with the tables.  Remainders of the keys
choose between the cases, so every branch has its rows at any size.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehealth.sources import catalog

SCHEMAS = catalog.SCHEMAS | {
    "scanned": "schema_name string, table_name string, source_column string",
    "edges": "parent string, child string",
    "selected": "pos int, node string",
    "selection": "schema_name string, table_name string, checked boolean",
    "jobs": "id long, job_type string, status string, message string",
    "items": "id long, job_id long, status string",
    "results": "id long, job_id long, schema_name string, table_name string, total_rows long, skew_ratio double, status string",
    "segments": "id long, skew_result_id long, segment_id int, row_count long",
    "keys": "id long, distkey string",
    "secrets": "id long, password string",
}


def _text(column: str) -> str:
    return f"CAST({column} AS STRING)"


_SPACES = f"""SELECT n_nationkey AS oid, CASE WHEN n_nationkey = 3 THEN 'pg_catalog' WHEN n_nationkey = 7 THEN 'information_schema' WHEN n_nationkey % 12 = 4 THEN 'pg_temp_' || {_text("n_nationkey")}
WHEN n_nationkey % 12 = 5 THEN 'pgXtempX' || {_text("n_nationkey")} WHEN n_nationkey % 12 = 6 THEN 'pg_toast_temp_' || {_text("n_nationkey")} ELSE lower(n_name) END AS nspname FROM {{nation}}"""
_NAMED = f"(SELECT c_custkey, nspname, 'customer_' || {_text('c_custkey')} AS relname FROM {{customer}} JOIN ({_SPACES}) s ON s.oid = c_nationkey) c"
_LINES = "(SELECT l_orderkey * 10 + l_linenumber AS id, min(l_suppkey) AS job, min(l_partkey) AS part, sum(l_quantity) AS n FROM {lineitem} GROUP BY l_orderkey, l_linenumber) l"
_COLUMNS = (1, 2, 3, 4)


def _each(numbers: tuple[int, ...], one: str) -> str:
    return " UNION ALL ".join(one.replace("#", str(k)) for k in numbers)


#: Each text is SQL for both engines; {list} makes an array, {table} is one of the given tables.
RELATIONS = {
    "namespaces": _SPACES,
    "relations": f"""SELECT c_custkey * 10 AS oid, 'customer_' || {_text("c_custkey")} AS relname, c_nationkey AS relnamespace, CASE c_custkey % 4 WHEN 0 THEN 'v' WHEN 1 THEN 'p' ELSE 'r' END AS relkind, c_custkey % 6 AS relam, c_acctbal AS reltuples, c_custkey * 64 AS total_bytes FROM {{customer}}
UNION ALL SELECT o_orderkey * 10 + 1, 'part_' || {_text("o_orderkey")}, o_custkey % 25, 'r', 1, o_totalprice, o_orderkey * 8 FROM {{orders}}
UNION ALL SELECT o_orderkey * 10 + 2, 'sub_' || {_text("o_orderkey")}, o_custkey % 25, 'r', NULL, NULL, NULL FROM {{orders}} WHERE o_orderkey % 3 = 0""",
    "inheritance": "SELECT o_custkey * 10 AS inhparent, o_orderkey * 10 + 1 AS inhrelid FROM {orders} UNION ALL SELECT o_orderkey * 10 + 1, o_orderkey * 10 + 2 FROM {orders} WHERE o_orderkey % 3 = 0",
    "distribution": "SELECT c_custkey * 10 AS localoid, CASE c_custkey % 5 WHEN 0 THEN 'r' ELSE 'p' END AS policytype, CASE c_custkey % 4 WHEN 0 THEN {list}() WHEN 1 THEN {list}(1) WHEN 2 THEN {list}(2) ELSE {list}(3, 1) END AS distkey FROM {customer} WHERE c_custkey % 7 <> 6",
    "access_methods": "SELECT r_regionkey AS oid, CASE r_regionkey WHEN 1 THEN 'heap' WHEN 2 THEN 'ao_row' WHEN 3 THEN 'ao_column' ELSE lower(r_name) END AS amname FROM {region}",
    "attributes": _each(_COLUMNS, "SELECT c_custkey * 10 AS attrelid, # AS attnum, 'col_#' AS attname, CASE (c_custkey + #) % 5 WHEN 0 THEN 'int8' WHEN 1 THEN 'text' WHEN 2 THEN 'bytea' WHEN 3 THEN 'numeric' ELSE 'timestamp' END AS typname, c_custkey % (# + 1) <> 0 AS attnotnull, (c_custkey + #) % 11 = 0 AS attisdropped FROM {customer}")
    + " UNION ALL SELECT c_custkey * 10, -1, 'ctid', 'tid', true, false FROM {customer}",
    "column_stats": _each(_COLUMNS, f"SELECT nspname AS schemaname, relname AS tablename, 'col_#' AS attname, CASE (c_custkey + #) % 6 WHEN 0 THEN -1.0 WHEN 1 THEN -0.5 WHEN 2 THEN c_custkey + 0.0 WHEN 3 THEN 0.0 ELSE 12.0 END AS n_distinct, CASE (c_custkey + #) % 3 WHEN 0 THEN 0.1 ELSE 0.0 END AS null_frac FROM {_NAMED} WHERE (c_custkey + #) % 4 <> 3"),
    "indexes": _each((1, 2, 3), f"SELECT c_custkey * 10 AS indrelid, c_custkey * 10 + # AS indexrelid, 'index_' || {_text('9 - #')} || '_' || {_text('c_custkey')} AS index_name, # = 1 AND c_custkey % 4 = 0 AS indisprimary, c_custkey % 5 <> # AS indisunique, c_custkey % 11 <> # AS indisvalid, c_custkey % 13 <> # AS indisready, CASE # WHEN 1 THEN {{list}}(1) WHEN 2 THEN {{list}}(2) ELSE {{list}}(1, 2) END AS indkey, c_custkey % 17 = # AS has_predicate, c_custkey % 19 = # AS has_expressions FROM {{customer}} WHERE c_custkey % 3 <> 2"),
    "scanned": f"SELECT nspname AS schema_name, relname AS table_name, 'col_2' AS source_column FROM {_NAMED} WHERE c_custkey % 8 = 2",
    # regions, nations, customers, orders, and below them a hundred nodes that many orders share
    "edges": f"""SELECT 'r' || {_text("n_regionkey")} AS parent, 'n' || {_text("n_nationkey")} AS child FROM {{nation}} UNION ALL SELECT 'n' || {_text("c_nationkey")}, 'c' || {_text("c_custkey")} FROM {{customer}}
UNION ALL SELECT 'c' || {_text("o_custkey")}, 'o' || {_text("o_orderkey")} FROM {{orders}} UNION ALL SELECT 'o' || {_text("o_orderkey")}, 'd' || {_text("o_orderkey % 100")} FROM {{orders}} WHERE o_orderkey % 2 = 0""",
    "selected": f"SELECT n_nationkey AS pos, 'n' || {_text('n_nationkey')} AS node FROM {{nation}} WHERE n_nationkey % 3 = 0 UNION ALL SELECT 100 + n_nationkey, 'n' || {_text('n_nationkey')} FROM {{nation}} WHERE n_nationkey % 6 = 0 UNION ALL SELECT 200 + r_regionkey, 'r' || {_text('r_regionkey')} FROM {{region}} WHERE r_regionkey < 2",
    "selection": f"SELECT 'c' || {_text('o_custkey')} AS schema_name, 'o' || {_text('o_orderkey')} AS table_name, o_orderstatus = 'F' AS checked FROM {{orders}}",
    "jobs": "SELECT s_suppkey AS id, CASE s_suppkey % 2 WHEN 0 THEN 'reorganize' ELSE 'skew' END AS job_type, CASE s_suppkey % 7 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'done' WHEN 3 THEN 'stopping' WHEN 4 THEN 'failed' WHEN 5 THEN 'cancelled' ELSE 'running' END AS status, CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE s_name END AS message FROM {supplier}",
    "items": "SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS job_id, CASE (l_orderkey + l_linenumber) % 7 WHEN 0 THEN 'failed' WHEN 1 THEN 'interrupted' WHEN 2 THEN 'skipped' WHEN 3 THEN 'running' WHEN 4 THEN 'queued' ELSE 'done' END AS status FROM {lineitem}",
    "results": f"SELECT id, CASE WHEN id % 13 = 0 THEN NULL ELSE job END AS job_id, 's' || {_text('part % 7')} AS schema_name, 't' || {_text('id')} AS table_name, CASE WHEN id % 6 = 3 THEN 0 ELSE CAST(n AS BIGINT) END AS total_rows, CASE WHEN id % 17 = 0 THEN NULL ELSE id * 37 % 400 / CAST(100 AS DOUBLE) END AS skew_ratio, CASE id % 7 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'OK' WHEN 3 THEN 'EMPTY' WHEN 4 THEN 'FAILED' WHEN 5 THEN NULL ELSE 'ODD' END AS status FROM {_LINES}",
    "segments": f"SELECT id * 2 AS id, id AS skew_result_id, 0 AS segment_id, CAST(n AS BIGINT) AS row_count FROM {_LINES} UNION ALL SELECT id * 2 + 1, id, 1, id % 3 * 10 FROM {_LINES}",
    "keys": f"""SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' WHEN 3 THEN chr(123) || chr(125) WHEN 4 THEN chr(123) || {_text("o_custkey")} || ',' || {_text("o_orderkey % 50")} || chr(125)
WHEN 5 THEN chr(123) || ' ' || {_text("o_custkey")} || ' , x,,1' || chr(125) WHEN 6 THEN {_text("o_custkey")} WHEN 7 THEN {_text("o_custkey")} || ' 2' ELSE o_orderpriority END AS distkey FROM {{orders}}""",
    "secrets": "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE c_name END AS password FROM {customer}",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The relation over the tables in a folder."""
    text = RELATIONS[name].replace("{list}", "array")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"{(\w+)}", text))}
    columns = [c.split(" ") for c in SCHEMAS[name].split(", ")]
    return spark.sql(text, **tables).select(*[F.col(c).cast(kind).alias(c) for c, kind in columns])


def as_catalog(spark: SparkSession, sf_dir: str) -> catalog.Catalog:
    return catalog.Catalog(**{name: frame(spark, sf_dir, name) for name in catalog.SCHEMAS})


_KINDS = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "array<int>": "INTEGER[]"}


def cte(*names: str) -> str:
    """``name AS (SELECT ...)`` for DuckDB, comma-separated."""
    parts = []
    for name in names:
        text = re.sub(r"{(\w+)}", r"\1", RELATIONS[name].replace("{list}", "list_value"))
        casts = ", ".join(f"CAST({c} AS {_KINDS[kind]}) AS {c}" for c, kind in (x.split(" ") for x in SCHEMAS[name].split(", ")))
        parts.append(f"{name} AS (SELECT {casts} FROM ({text}))")
    return ", ".join(parts)
