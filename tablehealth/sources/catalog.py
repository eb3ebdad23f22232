"""Catalog relations as DataFrames: from Spark's own catalog, or given rows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "namespaces": "oid long, nspname string",
    "relations": "oid long, relname string, relnamespace long, relkind string, relam long, reltuples double, total_bytes long",
    "inheritance": "inhparent long, inhrelid long",
    "distribution": "localoid long, policytype string, distkey array<int>",
    "access_methods": "oid long, amname string",
    "attributes": "attrelid long, attnum int, attname string, typname string, attnotnull boolean, attisdropped boolean",
    "column_stats": "schemaname string, tablename string, attname string, n_distinct double, null_frac double",
    "indexes": "indrelid long, indexrelid long, index_name string, indisprimary boolean, indisunique boolean, indisvalid boolean, indisready boolean, indkey array<int>, has_predicate boolean, has_expressions boolean",
}


#: Spark's type names in the vocabulary of the catalog relations.
TYPES = {"tinyint": "int2", "smallint": "int2", "int": "int4", "bigint": "int8", "decimal": "numeric", "float": "float4", "double": "float8", "string": "text", "varchar": "varchar", "char": "bpchar", "date": "date", "timestamp": "timestamptz", "timestamp_ntz": "timestamp"}


def type_name(spark_type: str) -> str:
    """The catalog's name of a Spark type; other types keep theirs."""
    return TYPES.get(spark_type.split("(")[0], spark_type)


@dataclass
class Catalog:
    """The relations that exploration and recommendation read."""

    namespaces: DataFrame
    relations: DataFrame
    inheritance: DataFrame
    distribution: DataFrame
    access_methods: DataFrame
    attributes: DataFrame
    column_stats: DataFrame
    indexes: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, rows: dict[str, list[tuple]]) -> Catalog:
        return cls(**{name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()})


def describe(spark: SparkSession, table: str) -> dict:
    """Provider, bucket columns and count, size and row estimate of a catalog table; {} if missing."""
    if not spark.catalog.tableExists(table):
        return {}
    found = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    columns = [c.strip().strip("`") for c in found.get("Bucket Columns", "[]").strip("[]").split(",") if c.strip()]
    replicated = "distribution=REPLICATED" in found.get("Table Properties", "")
    return {
        "provider": found.get("Provider"),
        "location": found.get("Location"),
        "distribution": "REPLICATED" if replicated else "HASH" if columns else "RANDOM",
        "columns": columns,
        "buckets": int(found["Num Buckets"]) if "Num Buckets" in found else None,
        "statistics": found.get("Statistics"),
    }


def size_and_rows(statistics: str | None) -> tuple[int | None, float | None]:
    """Bytes and rows out of a table's statistics text, null where it has none."""
    found = {unit: int(n) for n, unit in re.findall(r"([0-9]+) (bytes|rows)", statistics or "")}
    return found.get("bytes"), float(found["rows"]) if "rows" in found else None


def column_statistics(spark: SparkSession, table: str, rows: float | None) -> list[tuple[str, float, float]]:
    """(name, n_distinct, null_frac) of the analysed columns of a table with ``rows`` rows.

    From the session catalog's own record of the table, asked once for all its columns.
    """
    if not rows:
        return []
    identifier = spark._jsparkSession.sessionState().sqlParser().parseTableIdentifier(table)
    stats = spark._jsparkSession.sessionState().catalog().getTableMetadata(identifier).stats()
    if stats.isEmpty():
        return []
    found, entries = [], stats.get().colStats().iterator()
    while entries.hasNext():
        entry = entries.next()
        distinct, nulls = entry._2().distinctCount(), entry._2().nullCount()
        if distinct.isDefined() and nulls.isDefined():
            n = float(str(distinct.get()))
            # as many values as rows is stated relative to the rows
            found.append((entry._1(), -1.0 if n >= rows else n, float(str(nulls.get())) / rows))
    return found


def from_spark(spark: SparkSession, schema: str | None = None, table: str | None = None) -> Catalog:
    """The session catalog in the same shape: databases, tables with sizes, columns, statistics and bucketing.

    ``schema`` and ``table`` describe that one alone.  Sizes, rows and column statistics are
    those that ANALYZE TABLE left, null without it.  Spark has no indexes.
    """
    rows: dict[str, list[tuple]] = {name: [] for name in SCHEMAS}
    rows["access_methods"] = [(1, "parquet"), (2, "orc"), (3, "heap")]
    methods = {name: oid for oid, name in rows["access_methods"]}
    oid = 1000
    for database in spark.catalog.listDatabases():
        if schema is not None and database.name != schema:
            continue
        oid += 1
        space = oid
        rows["namespaces"].append((space, database.name))
        for entry in spark.catalog.listTables(database.name):
            if entry.isTemporary or table is not None and entry.name != table:
                continue
            oid += 1
            name = f"{database.name}.{entry.name}"
            info = describe(spark, name)
            kind = "v" if entry.tableType == "VIEW" else "r"
            size, count = size_and_rows(info.get("statistics"))
            rows["relations"].append((oid, entry.name, space, kind, methods.get(info.get("provider") or ""), count, size))
            rows["column_stats"] += [(database.name, entry.name, *x) for x in (column_statistics(spark, name, count) if kind == "r" else ())]
            columns = spark.catalog.listColumns(name)
            numbers = {c.name: i for i, c in enumerate(columns, 1)}
            rows["attributes"] += [(oid, i, c.name, type_name(c.dataType), not c.nullable, False) for i, c in enumerate(columns, 1)]
            rows["distribution"].append((oid, "r" if info.get("distribution") == "REPLICATED" else "p", [numbers[c] for c in info.get("columns", [])]))
    return Catalog.of(spark, rows)


def file_sizes(df: DataFrame) -> dict[str, int]:
    """Bytes of each file that a relation reads: names from its plan, sizes from one listing of each folder."""
    spark, wanted, found = df.sparkSession, set(df.inputFiles()), {}
    for folder in {f.rpartition("/")[0] for f in wanted}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        for status in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
            name = f"{folder}/{status.getPath().toUri().getRawPath().rpartition('/')[2]}"
            if name in wanted:
                found[name] = status.getLen()
    return found


def table_bytes(df: DataFrame) -> DataFrame:
    """total_bytes, files: the size of the files a relation reads, without reading them."""
    sizes = file_sizes(df)
    return df.sparkSession.createDataFrame([(sum(sizes.values()), len(sizes))], "total_bytes long, files long")
