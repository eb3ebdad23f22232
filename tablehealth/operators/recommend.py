"""Distribution keys: metadata, unique indexes, and the four-tier recommendation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablehealth.functions import expressions as X
from tablehealth.operators import profile
from tablehealth.sources.catalog import Catalog


def named_relations(catalog: Catalog) -> DataFrame:
    spaces = catalog.namespaces.select(F.col("oid").alias("_space"), F.col("nspname").alias("schema_name"))
    return catalog.relations.join(spaces, F.col("relnamespace") == F.col("_space")).withColumnRenamed("relname", "table_name").drop("_space", "relnamespace")


def key_columns(catalog: Catalog) -> DataFrame:
    """localoid, columns: names of the distribution key in key order."""
    keys = catalog.distribution.select("localoid", F.posexplode("distkey").alias("ord", "attnum"))
    live = catalog.attributes.where(~F.col("attisdropped")).select(F.col("attrelid").alias("localoid"), "attnum", "attname")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "attname"))), lambda x: x.attname)
    return keys.join(live, ["localoid", "attnum"]).groupBy("localoid").agg(ordered.alias("columns"))


def metadata(catalog: Catalog) -> DataFrame:
    """Storage class, distribution and size of every relation."""
    policy = catalog.distribution.select("localoid", "policytype")
    methods = catalog.access_methods.select(F.col("oid").alias("_am"), "amname")
    joined = named_relations(catalog).join(policy, F.col("oid") == F.col("localoid"), "left").join(methods, F.col("relam") == F.col("_am"), "left").drop("localoid")
    joined = joined.join(key_columns(catalog), F.col("oid") == F.col("localoid"), "left")
    columns = F.coalesce("columns", F.array().cast("array<string>"))
    return joined.select("oid", "schema_name", "table_name", X.storage_class(F.col("amname")).alias("storage"), X.distribution_type(F.col("policytype"), columns).alias("current_type"), columns.alias("current_columns"), "total_bytes")


def unique_indexes(catalog: Catalog) -> DataFrame:
    """Per table the preferred index on one not-null column: a primary key, else by name."""
    sound = catalog.indexes.where(F.col("indisunique") & F.col("indisvalid") & F.col("indisready") & ~F.col("has_predicate") & ~F.col("has_expressions"))
    keys = sound.select("indrelid", "indexrelid", "index_name", "indisprimary", F.posexplode("indkey").alias("ord", "attnum"))
    live = catalog.attributes.where(~F.col("attisdropped")).select(F.col("attrelid").alias("indrelid"), "attnum", "attname", "attnotnull")
    names = F.transform(F.array_sort(F.collect_list(F.struct("ord", "attname"))), lambda x: x.attname)
    grouped = keys.join(live, ["indrelid", "attnum"]).groupBy("indrelid", "indexrelid", "index_name", "indisprimary").agg(names.alias("columns"), F.count(F.lit(1)).alias("column_count"), F.bool_and("attnotnull").alias("all_not_null"))
    order = Window.partitionBy("indrelid").orderBy(F.desc("indisprimary"), "index_name")
    return grouped.where((F.col("column_count") == 1) & F.col("all_not_null")).withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).drop("_n", "column_count", "all_not_null", "indexrelid")


def recommend(catalog: Catalog, scanned: DataFrame | None = None) -> DataFrame:
    """A recommendation for every relation of the catalog at once.

    Primary key, then unique index, then a column that a data scan proved unique
    (``scanned``: schema_name, table_name, source_column), then random.
    """
    indexes = unique_indexes(catalog).select("indrelid", "index_name", "indisprimary", F.col("columns").alias("index_columns"))
    joined = metadata(catalog).join(indexes, F.col("oid") == F.col("indrelid"), "left")
    if scanned is None:
        joined = joined.withColumn("source_column", F.lit(None).cast("string"))
    else:
        joined = joined.join(scanned.select("schema_name", "table_name", "source_column"), ["schema_name", "table_name"], "left")
    by_index, by_scan = F.col("index_name").isNotNull(), F.col("source_column").isNotNull()
    kind = F.when(by_index | by_scan, "HASH").otherwise("RANDOM")
    columns = F.when(by_index, F.col("index_columns")).when(by_scan, F.array("source_column")).otherwise(F.array().cast("array<string>"))
    # fixed output texts
    reason = (
        F.when(by_index & F.col("indisprimary"), "PRIMARY KEY unique not null column")
        .when(by_index, "UNIQUE INDEX unique not null column")
        .when(by_scan, "Column found unique by data scan")
        .otherwise("No PRIMARY KEY, UNIQUE INDEX, or unique column found by data scan")
    )
    shaped = joined.select("schema_name", "table_name", "current_type", "current_columns", kind.alias("recommendation_type"), columns.alias("recommended_columns"), reason.alias("reason"), F.col("index_name").alias("source_index"), F.when(~by_index, F.col("source_column")).alias("source_column"))
    same = F.when(F.col("recommendation_type") == "HASH", (F.col("current_type") == "HASH") & (F.col("current_columns") == F.col("recommended_columns"))).otherwise(F.col("current_type") == "RANDOM")
    return shaped.withColumn("already_same", same).withColumn("sql_preview", X.distribution_preview(F.col("schema_name"), F.col("table_name"), F.col("recommendation_type"), F.col("recommended_columns")))


def scan_tables(catalog: Catalog, read: Callable[[str, str], DataFrame], max_candidates: int = profile.MAX_CANDIDATES, scan_without_stats: bool = False) -> DataFrame:
    """schema_name, table_name, source_column: the exact scan of tables without a usable index.

    The loop is over tables, each one a distributed scan; no rows come to the driver.
    """
    spark = catalog.relations.sparkSession
    tables = named_relations(catalog)
    attributes = catalog.attributes.join(tables.select(F.col("oid").alias("attrelid"), F.col("schema_name").alias("schemaname"), F.col("table_name").alias("tablename")), "attrelid")
    left = tables.join(unique_indexes(catalog), F.col("oid") == F.col("indrelid"), "left_anti").select(F.col("schema_name").alias("schemaname"), F.col("table_name").alias("tablename"))
    wanted = profile.candidates(attributes.join(left, ["schemaname", "tablename"], "left_semi"), catalog.column_stats, max_candidates, scan_without_stats).where(~F.col("skipped")).orderBy("schemaname", "tablename", "position").collect()
    by_table: dict[tuple[str, str], list[str]] = {}
    for r in wanted:
        by_table.setdefault((r["schemaname"], r["tablename"]), []).append(r["attname"])
    found = [(s, t, hit["column"]) for (s, t), names in by_table.items() if (hit := profile.find_unique_column(read(s, t), names))]
    return spark.createDataFrame(found, "schema_name string, table_name string, source_column string")
