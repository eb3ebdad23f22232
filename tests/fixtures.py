"""Small catalogs and job tables that reach every branch; the same rows serve both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablehealth.sources import catalog

ROWS = {
    "namespaces": [(1, "sales"), (2, "dwh"), (3, "pg_catalog"), (4, "pg_temp_7"), (5, "pgXtempX1")],
    "relations": [
        (10, "orders", 1, "r", 1, 1000.0, 4096),
        (20, "fact", 2, "p", 2, 0.0, 0),
        (21, "fact_1", 2, "p", 2, 0.0, 0),
        (22, "fact_1_a", 2, "r", 2, 500.0, 2048),
        (30, "orders_view", 1, "v", None, None, None),
        (40, "pg_class", 3, "r", 1, 10.0, 10),
        (41, "scratch", 4, "r", 1, 10.0, 10),
        (42, "scratch", 5, "r", 1, 10.0, 10),
        (50, "customers", 1, "r", 3, 700.0, 8192),
        (51, "codes", 1, "r", 1, 7.0, 512),
        (52, "logs", 2, "r", 4, 9000.0, 65536),
        (53, "plain", 2, "r", None, 3.0, 64),
    ],
    "inheritance": [(20, 21), (21, 22)],
    "distribution": [(10, "p", [1]), (22, "p", [3, 1]), (50, "p", []), (51, "r", []), (52, "p", [2])],
    "access_methods": [(1, "heap"), (2, "ao_row"), (3, "ao_column"), (4, "zedstore")],
    "attributes": [
        (10, 1, "o_orderkey", "int8", True, False), (10, 2, "o_custkey", "int8", False, False), (10, 3, "gone", "text", False, True), (10, -1, "ctid", "tid", True, False),
        (22, 1, "day", "date", True, False), (22, 2, "amount", "numeric", False, False), (22, 3, "shop", "int4", True, False),
        (50, 1, "c_custkey", "int8", True, False), (50, 2, "c_name", "text", True, False), (50, 3, "c_nick", "text", False, False),
        (51, 1, "code", "text", True, False), (51, 2, "label", "text", True, False),
        (52, 1, "at", "timestamp", True, False), (52, 2, "host", "text", True, False), (52, 3, "line", "text", False, False), (52, 4, "raw", "bytea", True, False),
        (53, 1, "a", "int4", True, False), (53, 2, "b", "int4", True, False), (53, 3, "c", "int4", False, False), (53, 4, "d", "int4", True, False), (53, 5, "e", "int4", False, False), (53, 6, "f", "int4", True, False),
    ],
    "column_stats": [("dwh", "plain", "a", -1.0, 0.0), ("dwh", "plain", "b", -0.5, 0.0), ("dwh", "plain", "c", 100.0, 0.0), ("dwh", "plain", "e", -1.0, 0.1), ("dwh", "plain", "f", 500.0, 0.0), ("dwh", "logs", "host", 12.0, 0.0)],
    "indexes": [
        (10, 100, "orders_pkey", True, True, True, True, [1], False, False),
        (10, 101, "a_orders_custkey", False, True, True, True, [2], False, False),
        (50, 102, "customers_name", False, True, True, True, [2], False, False),
        (50, 103, "customers_both", False, True, True, True, [1, 2], False, False),
        (50, 104, "a_customers_nick", False, True, True, True, [3], False, False),
        (51, 105, "codes_partial", False, True, True, True, [1], True, False),
        (51, 106, "codes_invalid", False, True, False, True, [1], False, False),
        (51, 107, "codes_expression", False, True, True, True, [2], False, True),
        (52, 108, "logs_plain", False, False, True, True, [2], False, False),
    ],
    "scanned": [("dwh", "plain", "a")],
    "edges": [("root", "left"), ("root", "right"), ("left", "both"), ("right", "both"), ("both", "end"), ("alone", "alone_1")],
    "selected": [(1, "left"), (2, "right"), (3, "alone"), (4, "left"), (5, "end")],
    "selection": [("sales", "orders", True), ("sales", "customers", False), ("dwh", "fact", True), ("dwh", "logs", True), ("lab", "x", False)],
    "jobs": [(1, "skew", "queued", None), (2, "skew", "running", "x"), (3, "reorganize", "done", None), (4, "reorganize", "stopping", ""), (5, "skew", "failed", "y")],
    "items": [(1, 1, "done"), (2, 1, "done"), (3, 1, "failed"), (4, 1, "interrupted"), (5, 1, "skipped"), (6, 1, "running"), (7, 2, "done"), (8, 2, "queued"), (9, 2, "running")],
    "results": [
        (1, 5, "s", "a", 400, 1.0, "OK"), (2, 5, "s", "b", 400, 1.5, "WARNING"), (3, 5, "s", "c", 400, 3.0, "CRITICAL"), (4, 5, "s", "d", 0, 0.0, "EMPTY"),
        (5, 5, "t", "e", 200000, 1.5, "OK"), (6, 5, "t", "f", 10, None, None), (7, 5, "t", "g", 400, 3.0, "CRITICAL"), (8, 2, "t", "h", 400, 9.0, "CRITICAL"), (9, None, "t", "i", 400, 8.0, "WARNING"), (10, 5, "t", "j", 30, 1.4999, "ODD"),
    ],
    "segments": [(1, 1, 0, 100), (2, 1, 1, 100), (3, 2, 0, 150), (4, 2, 1, 50), (5, 3, 0, 300), (6, 3, 1, 0)],
    "keys": [(1, None), (2, ""), (3, " "), (4, "{}"), (5, "{1,2}"), (6, "{ 2 , x,,1}"), (7, "7"), (8, "1 2"), (9, "abc")],
    "secrets": [(1, None), (2, ""), (3, "hunter2")],
}
SCHEMAS = catalog.SCHEMAS | {
    "scanned": "schema_name string, table_name string, source_column string",
    "edges": "parent string, child string",
    "selected": "pos int, node string",
    "selection": "schema_name string, table_name string, checked boolean",
    "jobs": "id long, job_type string, status string, message string",
    "items": "id long, job_id long, status string",
    "results": "id long, job_id long, schema_name string, table_name string, total_rows long, skew_ratio double, status string",
    "segments": "id long, skew_result_id long, segment_id int, row_count long",
    "keys": "id int, distkey string",
    "secrets": "id int, password string",
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(ROWS[name], SCHEMAS[name])


def as_catalog(spark: SparkSession) -> catalog.Catalog:
    return catalog.Catalog.of(spark, ROWS)


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, list):
        return "[" + ", ".join(map(_literal, value)) + "]::INTEGER[]"
    return str(value).upper() if isinstance(value, bool) else str(value)


_KINDS = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "array<int>": "INTEGER[]"}


def cte(*names: str) -> str:
    """``name AS (SELECT ... FROM VALUES ...)`` for DuckDB, comma-separated."""
    parts = []
    for name in names:
        columns = [c.split(" ") for c in SCHEMAS[name].split(", ")]
        values = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in ROWS[name])
        casts = ", ".join(f"CAST({c} AS {_KINDS[k]}) AS {c}" for c, k in columns)
        parts.append(f"{name} AS (SELECT {casts} FROM (VALUES {values}) AS v({', '.join(c for c, _ in columns)}))")
    return ", ".join(parts)
