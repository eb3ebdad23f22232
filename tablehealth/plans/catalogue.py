"""Named queries and the DuckDB SQL they are held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehealth.functions import expressions as X
from tablehealth.operators import hierarchy, history, jobs, layout, machine, profile, ranking, recommend, skew
from tablehealth.plans import derived
from tablehealth.sources import catalog, files, segments
from tablehealth.sources import store as stores
from tablehealth.streaming import progress

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def register(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return register


def _statistics_sql(counts: str, by: str = "") -> str:
    """Skew statistics over ``counts``, a query with segment_id and row_count (and ``by``)."""
    lead = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""
    WITH seg AS ({counts}),
         agg AS (SELECT {lead}CAST(coalesce(sum(row_count), 0) AS BIGINT) total_rows, count(row_count) segment_count, coalesce(avg(CAST(row_count AS DOUBLE)), 0) a,
                        CAST(coalesce(max(row_count), 0) AS BIGINT) max_rows, CAST(coalesce(min(row_count), 0) AS BIGINT) min_rows,
                        CAST(coalesce(sum(CASE WHEN row_count = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) empty_segments FROM seg{group}),
         rat AS (SELECT *, CASE WHEN a > 0 THEN max_rows / a ELSE 0.0::DOUBLE END ratio FROM agg)
    SELECT {lead}total_rows, segment_count, round(a, 2) avg_rows, max_rows, min_rows, round(ratio, 4) skew_ratio, empty_segments,
           CASE WHEN total_rows = 0 THEN 'EMPTY' WHEN ratio < 1.5::DOUBLE THEN 'OK' WHEN ratio < 3.0::DOUBLE THEN 'WARNING' ELSE 'CRITICAL' END status FROM rat
    """


def _counts_sql(segment: str, table: str, where: str = "") -> str:
    return f"SELECT {segment} AS segment_id, count(*) AS row_count FROM {table} {where} GROUP BY 1"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skew of lineitem over l_suppkey % 8."""
    return skew.analyze(_table(spark, sf_dir, "lineitem"), segments.by_modulo("l_suppkey", 8))


# --- skew of one table -------------------------------------------------------------


@query(_statistics_sql(_counts_sql("l_suppkey % 8", "lineitem")))
def skew_modulo_lineitem(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(_statistics_sql(_counts_sql("user_id % 8", "events")))
def skew_modulo_events(spark, sf_dir):
    return skew.analyze(_table(spark, sf_dir, "events"), segments.by_modulo("user_id", 8))


@query(_statistics_sql(_counts_sql("lang", "documents")))
def skew_column_documents(spark, sf_dir):
    return skew.analyze(_table(spark, sf_dir, "documents"), segments.by_column("lang"))


@query(_statistics_sql(_counts_sql("role", "conversations")))
def skew_column_conversations(spark, sf_dir):
    return skew.analyze(_table(spark, sf_dir, "conversations"), segments.by_column("role"))


_CRITICAL = "CASE WHEN l_linenumber < 7 THEN 0 ELSE l_suppkey END"


@query(_statistics_sql(_counts_sql(_CRITICAL, "lineitem")))
def skew_critical(spark, sf_dir):
    return skew.analyze(_table(spark, sf_dir, "lineitem"), F.expr(_CRITICAL))


@query("SELECT l_suppkey % 8 AS segment_id, count(*) AS row_count FROM lineitem GROUP BY 1")
def segment_counts(spark, sf_dir):
    return skew.segment_counts(_table(spark, sf_dir, "lineitem"), segments.by_modulo("l_suppkey", 8))


_ZERO_FILLED = "SELECT r.id AS segment_id, coalesce(c.row_count, 0) AS row_count FROM (SELECT unnest(range(8)) id) r LEFT JOIN (SELECT l_linenumber k, count(*) row_count FROM lineitem GROUP BY 1) c ON c.k = r.id"


@query(_statistics_sql(_ZERO_FILLED))
def skew_zero_filled(spark, sf_dir):
    return skew.analyze(_table(spark, sf_dir, "lineitem"), segments.by_column("l_linenumber"), 8)


@query(_statistics_sql(_counts_sql("user_id % 8", "events", "WHERE event_id < 0")))
def skew_empty_table(spark, sf_dir):
    return skew.analyze(_table(spark, sf_dir, "events").where("event_id < 0"), segments.by_modulo("user_id", 8))


@query()
def skew_hash_what_if(spark, sf_dir):
    """Buckets that a proposed key would give."""
    return skew.analyze(_table(spark, sf_dir, "orders"), segments.by_hash(["o_custkey"], 8), 8)


@query()
def skew_by_partition(spark, sf_dir):
    return skew.analyze(_table(spark, sf_dir, "lineitem").repartition(8, "l_suppkey"), segments.by_partition(), 8)


@query()
def skew_by_file(spark, sf_dir):
    return skew.analyze(_table(spark, sf_dir, "orders"), segments.by_file())


# --- skew of many tables -----------------------------------------------------------

_MANY = {
    "conversations": ("role", "role"),
    "customer": ("c_nationkey", "c_nationkey"),
    "documents": ("lang", "lang"),
    "events": ("user_id % 8", "user_id % 8"),
    "lineitem": (_CRITICAL, _CRITICAL),
    "orders": ("o_orderstatus", "o_orderstatus"),
    "part": ("p_size", "p_size"),
    "supplier": ("s_nationkey", "s_nationkey"),
}


def _many(spark, sf_dir) -> DataFrame:
    found = skew.analyze_many({name: (_table(spark, sf_dir, name), F.expr(segment)) for name, (segment, _) in _MANY.items()})
    return found.drop("error").withColumn("schema_name", F.lit("main"))


_MANY_SQL = _statistics_sql(" UNION ALL ".join(f"SELECT '{t}' AS table_name, 'main' AS schema_name, CAST({s} AS VARCHAR) AS segment_id, count(*) AS row_count FROM {t} GROUP BY 3" for t, (_, s) in _MANY.items()), "table_name, schema_name")
_RANK = "CASE status WHEN 'CRITICAL' THEN 1 WHEN 'WARNING' THEN 2 WHEN 'OK' THEN 3 WHEN 'EMPTY' THEN 4 WHEN 'FAILED' THEN 5 ELSE 6 END"
_ORDER = "skew_ratio DESC NULLS LAST, total_rows DESC NULLS LAST, schema_name, table_name"


@query(_MANY_SQL)
def skew_many_tables(spark, sf_dir):
    return _many(spark, sf_dir)


@query(f"{_MANY_SQL} UNION ALL SELECT 'missing', 'main', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'FAILED'")
def skew_many_with_failure(spark, sf_dir):
    """A table that cannot be read fails alone."""
    tables = {name: (_table(spark, sf_dir, name), F.expr(segment)) for name, (segment, _) in _MANY.items()}
    tables["missing"] = (lambda: _table(spark, sf_dir, "missing"), F.col("x"))
    return skew.analyze_many(tables).drop("error").withColumn("schema_name", F.lit("main"))


@query(f"SELECT *, CAST(row_number() OVER (ORDER BY {_RANK}, {_ORDER}) AS BIGINT) AS position FROM ({_MANY_SQL})")
def skew_ranked(spark, sf_dir):
    return history.ranked(_many(spark, sf_dir))


@query(f"SELECT *, CAST(row_number() OVER (ORDER BY {_RANK}, {_ORDER}) AS BIGINT) AS position FROM ({_MANY_SQL}) WHERE status IN ('CRITICAL', 'WARNING')")
def skew_problems(spark, sf_dir):
    return history.problems(_many(spark, sf_dir))


_PER_USER = _statistics_sql("SELECT user_id, event_type AS segment_id, count(*) AS row_count FROM events GROUP BY 1, 2", "user_id")


def _per_user(spark, sf_dir) -> DataFrame:
    counts = _table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("segment_id")).agg(F.count(F.lit(1)).alias("row_count"))
    return skew.statistics(counts, ("user_id",))


@query(f"""SELECT table_name, skew_ratio, total_rows, CASE WHEN skew_ratio >= 3.0 THEN 'red' WHEN skew_ratio >= 1.5 THEN 'amber' ELSE 'green' END AS color_band, position
FROM (SELECT *, CAST(row_number() OVER (ORDER BY skew_ratio DESC, total_rows DESC, table_name) AS BIGINT) AS position FROM (SELECT *, lpad(CAST(user_id AS VARCHAR), 12, '0') AS table_name FROM ({_PER_USER}))) WHERE position <= 20""")
def skew_top20(spark, sf_dir):
    named = _per_user(spark, sf_dir).withColumn("table_name", F.lpad(F.col("user_id").cast("string"), 12, "0")).withColumn("schema_name", F.lit("events"))
    return history.top(named).select("table_name", "skew_ratio", "total_rows", skew.color_band(F.col("skew_ratio")).alias("color_band"), "position")


@query(f"""SELECT count(*) total_tables, round(coalesce(max(skew_ratio), 0), 4) max_skew, round(coalesce(avg(skew_ratio), 0), 4) avg_skew, count(*) FILTER (status = 'OK') ok, count(*) FILTER (status = 'WARNING') warning,
count(*) FILTER (status = 'CRITICAL') critical, count(*) FILTER (status = 'EMPTY') empty, count(*) FILTER (status = 'FAILED') failed, CAST(0 AS BIGINT) interrupted FROM ({_MANY_SQL})""")
def skew_summary(spark, sf_dir):
    return history.summarize(_many(spark, sf_dir))


@query(f"""WITH {derived.cte("results", "items")} SELECT count(*) total_tables, round(coalesce(max(skew_ratio), 0), 4) max_skew, round(coalesce(avg(skew_ratio), 0), 4) avg_skew,
count(*) FILTER (status = 'OK') ok, count(*) FILTER (status = 'WARNING') warning, count(*) FILTER (status = 'CRITICAL') critical, count(*) FILTER (status = 'EMPTY') empty,
count(*) FILTER (coalesce(status, 'FAILED') = 'FAILED') failed, (SELECT count(*) FROM items WHERE job_id = 1 AND status = 'interrupted') interrupted FROM results WHERE job_id = 5""")
def summary_of_job(spark, sf_dir):
    items = derived.frame(spark, sf_dir, "items").where("job_id = 1")
    return history.summarize(history.of_job(derived.frame(spark, sf_dir, "results"), 5), items)


@query(f"""WITH {derived.cte("results")}, known AS (SELECT unnest(['OK', 'WARNING', 'CRITICAL', 'EMPTY', 'FAILED', 'INTERRUPTED']) status),
found AS (SELECT coalesce(status, 'FAILED') status, count(*) n FROM results GROUP BY 1)
SELECT coalesce(k.status, f.status) status, coalesce(n, 0) n FROM known k FULL JOIN found f ON k.status = f.status""")
def summary_status_counts(spark, sf_dir):
    return history.status_counts(derived.frame(spark, sf_dir, "results")).select(F.explode("status_counts").alias("status", "n"))


@query(f"""WITH {derived.cte("results", "jobs")} SELECT id, schema_name, table_name, status, CAST(row_number() OVER (ORDER BY {_RANK}, {_ORDER}) AS BIGINT) AS position
FROM results WHERE job_id = (SELECT max(id) FROM jobs WHERE job_type = 'skew')""")
def latest_results(spark, sf_dir):
    found = history.latest(derived.frame(spark, sf_dir, "results"), derived.frame(spark, sf_dir, "jobs"))
    return history.ranked(found, -1).select("id", "schema_name", "table_name", "status", "position")


@query(f"""WITH {derived.cte("results")} SELECT id, schema_name, table_name, CAST(row_number() OVER (ORDER BY {_ORDER}) AS BIGINT) AS position FROM results WHERE job_id = 5""")
def results_of_job(spark, sf_dir):
    order = [way(c) for way, c in history.RESULT_ORDER]
    return ranking.numbered(history.of_job(derived.frame(spark, sf_dir, "results"), 5), *order).select("id", "schema_name", "table_name", "position")


@query(f"""WITH {derived.cte("results", "segments")} SELECT s.skew_result_id, r.schema_name, r.table_name, s.segment_id, s.row_count, r.status, r.skew_ratio, r.total_rows FROM segments s JOIN results r ON r.id = s.skew_result_id""")
def segment_detail(spark, sf_dir):
    results = derived.frame(spark, sf_dir, "results")
    named = derived.frame(spark, sf_dir, "segments").join(results.select(F.col("id").alias("skew_result_id"), "schema_name", "table_name"), "skew_result_id")
    return history.segment_detail(results, named)


@query("""WITH c AS (SELECT user_id, event_type AS segment_id, count(*) AS row_count FROM events GROUP BY 1, 2), p AS (SELECT *, max(row_count) OVER (PARTITION BY user_id) peak FROM c)
SELECT user_id, segment_id, row_count, CASE WHEN row_count = 0 THEN 'empty' WHEN row_count >= 0.8::DOUBLE * greatest(peak, 1) THEN 'hot' ELSE 'normal' END heat FROM p""")
def segment_heat(spark, sf_dir):
    counts = _table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("segment_id")).agg(F.count(F.lit(1)).alias("row_count"))
    return history.heat(counts, ("user_id",))


@query(f"SELECT user_id, total_rows, skew_ratio, status, CASE WHEN skew_ratio >= 3.0 THEN 'red' WHEN skew_ratio >= 1.5 THEN 'amber' ELSE 'green' END color_band FROM ({_PER_USER})")
def color_band(spark, sf_dir):
    """Classified on the exact ratio, coloured by the rounded one."""
    return _per_user(spark, sf_dir).select("user_id", "total_rows", "skew_ratio", "status", skew.color_band(F.col("skew_ratio")).alias("color_band"))


# --- uniqueness and recommendation -------------------------------------------------


def _profile_sql(tables: dict[str, list[str]]) -> str:
    one = "SELECT '{t}' table_name, '{c}' column_name, count(*) total_rows, count({c}) not_null_rows, count(DISTINCT {c}) distinct_rows FROM {t}"
    union = " UNION ALL ".join(one.format(t=t, c=c) for t, columns in tables.items() for c in columns)
    return f"SELECT *, total_rows > 0 AND total_rows = not_null_rows AND total_rows = distinct_rows AS is_unique FROM ({union})"


_PROFILED = {
    "orders": ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"],
    "customer": ["c_custkey", "c_name", "c_acctbal"],
    "part": ["p_partkey", "p_name"],
    "lineitem": ["l_orderkey", "l_extendedprice", "l_shipdate"],
}


@query(_profile_sql(_PROFILED))
def unique_profile(spark, sf_dir):
    frames = [profile.profile(_table(spark, sf_dir, t), columns).withColumn("table_name", F.lit(t)) for t, columns in _PROFILED.items()]
    return history.union_all(frames)


def _named_attributes(spark, sf_dir) -> DataFrame:
    tables = recommend.named_relations(derived.as_catalog(spark, sf_dir))
    names = tables.select(F.col("oid").alias("attrelid"), F.col("schema_name").alias("schemaname"), F.col("table_name").alias("tablename"))
    return derived.frame(spark, sf_dir, "attributes").join(names, "attrelid")


_TYPES = ", ".join(f"'{t}'" for t in X.UNIQUE_TYPES)


@query(f"""WITH {derived.cte("attributes", "relations", "namespaces", "column_stats")}, j AS (
SELECT n.nspname schemaname, r.relname tablename, a.attname, a.typname, a.attnotnull, s.n_distinct, s.null_frac FROM attributes a JOIN relations r ON r.oid = a.attrelid JOIN namespaces n ON n.oid = r.relnamespace
LEFT JOIN column_stats s ON s.schemaname = n.nspname AND s.tablename = r.relname AND s.attname = a.attname WHERE a.attnum > 0 AND NOT a.attisdropped AND a.typname IN ({_TYPES})), p AS (
SELECT *, CAST(row_number() OVER (PARTITION BY schemaname, tablename ORDER BY attnotnull DESC, CASE WHEN n_distinct = -1 THEN 1 WHEN n_distinct < 0 THEN 2 WHEN n_distinct > 0 THEN 3 ELSE 4 END, abs(coalesce(n_distinct, 0)) DESC, attname) AS BIGINT) position FROM j)
SELECT schemaname, tablename, position, attname, typname, coalesce(null_frac, 1) > 0 skipped FROM p WHERE position <= 20""")
def unique_candidates(spark, sf_dir):
    return profile.candidates(_named_attributes(spark, sf_dir), derived.frame(spark, sf_dir, "column_stats"))


_INDEX_SQL = """grouped AS (SELECT k.indrelid, k.index_name, k.indisprimary, array_agg(a.attname ORDER BY k.ord) "columns", count(*) n, bool_and(a.attnotnull) nn
FROM (SELECT *, generate_subscripts(indkey, 1) ord, unnest(indkey) attnum FROM indexes WHERE indisunique AND indisvalid AND indisready AND NOT has_predicate AND NOT has_expressions) k
JOIN attributes a ON a.attrelid = k.indrelid AND a.attnum = k.attnum AND NOT a.attisdropped GROUP BY 1, 2, 3, k.indexrelid),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY indrelid ORDER BY indisprimary DESC, index_name) rn FROM grouped WHERE n = 1 AND nn) WHERE rn = 1)"""


@query(f"""WITH {derived.cte("indexes", "attributes")}, {_INDEX_SQL} SELECT indrelid, index_name, indisprimary, array_to_string("columns", ',') "columns" FROM picked""")
def unique_index_pick(spark, sf_dir):
    return recommend.unique_indexes(derived.as_catalog(spark, sf_dir)).withColumn("columns", F.array_join("columns", ","))


_METADATA_SQL = """keyed AS (SELECT d.localoid, array_agg(a.attname ORDER BY d.ord) cols FROM (SELECT localoid, generate_subscripts(distkey, 1) ord, unnest(distkey) attnum FROM distribution) d
JOIN attributes a ON a.attrelid = d.localoid AND a.attnum = d.attnum AND NOT a.attisdropped GROUP BY 1),
meta AS (SELECT r.oid, n.nspname schema_name, r.relname table_name, CASE WHEN m.amname IS NULL THEN 'HEAP' WHEN m.amname = 'heap' THEN 'HEAP' WHEN m.amname = 'ao_row' THEN 'AO' WHEN m.amname = 'ao_column' THEN 'AOCO' ELSE upper(m.amname) END storage,
CASE WHEN d.policytype = 'r' THEN 'REPLICATED' WHEN len(coalesce(k.cols, [])) > 0 THEN 'HASH' ELSE 'RANDOM' END current_type, coalesce(k.cols, []) current_columns, r.total_bytes
FROM relations r JOIN namespaces n ON n.oid = r.relnamespace LEFT JOIN distribution d ON d.localoid = r.oid LEFT JOIN access_methods m ON m.oid = r.relam LEFT JOIN keyed k ON k.localoid = r.oid)"""
_CATALOG_CTE = derived.cte("relations", "namespaces", "distribution", "access_methods", "attributes", "indexes", "scanned")


@query(f"""WITH {_CATALOG_CTE}, {_METADATA_SQL}, {_INDEX_SQL}, r AS (SELECT m.*, p.index_name, p.indisprimary, s.source_column,
CASE WHEN p.index_name IS NOT NULL OR s.source_column IS NOT NULL THEN 'HASH' ELSE 'RANDOM' END kind, CASE WHEN p.index_name IS NOT NULL THEN p."columns" WHEN s.source_column IS NOT NULL THEN [s.source_column] ELSE [] END cols
FROM meta m LEFT JOIN picked p ON p.indrelid = m.oid LEFT JOIN scanned s ON s.schema_name = m.schema_name AND s.table_name = m.table_name)
SELECT schema_name, table_name, current_type, array_to_string(current_columns, ',') current_columns, kind recommendation_type, array_to_string(cols, ',') recommended_columns,
CASE WHEN index_name IS NOT NULL AND indisprimary THEN 'PRIMARY KEY unique not null column' WHEN index_name IS NOT NULL THEN 'UNIQUE INDEX unique not null column' WHEN source_column IS NOT NULL THEN 'Column found unique by data scan'
ELSE 'No PRIMARY KEY, UNIQUE INDEX, or unique column found by data scan' END reason, index_name source_index, CASE WHEN index_name IS NULL THEN source_column END source_column,
CASE WHEN kind = 'HASH' THEN current_type = 'HASH' AND array_to_string(current_columns, ',') = array_to_string(cols, ',') ELSE current_type = 'RANDOM' END already_same,
'ALTER TABLE "' || schema_name || '"."' || table_name || '" SET WITH (REORGANIZE=true) ' || CASE WHEN kind = 'HASH' THEN 'DISTRIBUTED BY ("' || array_to_string(cols, '", "') || '");' ELSE 'DISTRIBUTED RANDOMLY;' END sql_preview FROM r""")
def recommendation(spark, sf_dir):
    found = recommend.recommend(derived.as_catalog(spark, sf_dir), derived.frame(spark, sf_dir, "scanned"))
    return found.withColumn("current_columns", F.array_join("current_columns", ",")).withColumn("recommended_columns", F.array_join("recommended_columns", ","))


@query(f"""WITH {_CATALOG_CTE}, {_METADATA_SQL} SELECT oid, schema_name, table_name, storage, current_type, array_to_string(current_columns, ',') current_columns, total_bytes FROM meta""")
def table_metadata(spark, sf_dir):
    return recommend.metadata(derived.as_catalog(spark, sf_dir)).withColumn("current_columns", F.array_join("current_columns", ","))


#: All columns of these tables that can be a key, in their order.
_SCANNED = {
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "documents": "doc_id text lang source n_chars",
    "conversations": "conv_id turn role text",
}


def _scan_sql(table: str, columns: str) -> str:
    tests = " ".join(f"WHEN count(*) > 0 AND count(*) = count(DISTINCT {c}) THEN '{c}'" for c in columns.split())
    return f"SELECT '{table}' table_name, CASE {tests} END source_column FROM {table}"


@query(" UNION ALL ".join(_scan_sql(t, c) for t, c in _SCANNED.items()))
def unique_scan(spark, sf_dir):
    """The first unique column of each table, all columns tried in order."""
    rows = []
    for name in _SCANNED:
        df = _table(spark, sf_dir, name)
        hit = profile.find_unique_column(df, profile.eligible(df))
        rows.append((name, hit["column"] if hit else None))
    return spark.createDataFrame(rows, "table_name string, source_column string")


# --- catalog trees -----------------------------------------------------------------

_TREE = f"""WITH {derived.cte("relations", "namespaces", "inheritance")}, tree AS (SELECT n.nspname schema_name, r.relname table_name, r.relkind, n.nspname || '.' || r.relname full_name FROM relations r JOIN namespaces n ON n.oid = r.relnamespace
WHERE r.relkind IN ('r', 'p') AND n.nspname NOT IN ('pg_catalog', 'information_schema', 'gp_toolkit', 'pg_toast') AND n.nspname NOT LIKE 'pg_temp_%' AND n.nspname NOT LIKE 'pg_toast_temp_%' AND NOT EXISTS (SELECT 1 FROM inheritance i WHERE i.inhrelid = r.oid))"""


def _tree(spark, sf_dir) -> DataFrame:
    return hierarchy.object_tree(derived.as_catalog(spark, sf_dir))


@query(f"{_TREE} SELECT * FROM tree")
def object_tree_rows(spark, sf_dir):
    return _tree(spark, sf_dir)


@query(f"{_TREE} SELECT full_name, CASE relkind WHEN 'p' THEN 'partitioned' ELSE 'table' END AS label FROM tree")
def object_tree_labels(spark, sf_dir):
    return _tree(spark, sf_dir).select("full_name", X.relkind_label(F.col("relkind")).alias("label"))


@query(f"{_TREE} SELECT schema_name AS schema, string_agg(table_name || ':' || relkind, ',' ORDER BY table_name) tables FROM tree GROUP BY 1")
def object_tree_nested(spark, sf_dir):
    nested = hierarchy.nested_tree(_tree(spark, sf_dir))
    return nested.select("schema", F.array_join(F.transform("tables", lambda t: F.concat(t.table, F.lit(":"), t.relkind)), ",").alias("tables"))


@query(f"{_TREE} SELECT schema_name, count(*) table_count, count(*) FILTER (relkind = 'p') partitioned_count FROM tree GROUP BY 1")
def schema_counts(spark, sf_dir):
    return hierarchy.schema_counts(_tree(spark, sf_dir))


@query(f"{_TREE} SELECT count(DISTINCT schema_name) schemas, count(*) tables FROM tree")
def tree_totals(spark, sf_dir):
    return hierarchy.totals(_tree(spark, sf_dir))


@query(f"{_TREE} SELECT * FROM tree WHERE contains(lower(schema_name), 'n_2') OR contains(lower(full_name), 'n_2')")
def tree_search(spark, sf_dir):
    return hierarchy.search(_tree(spark, sf_dir), " N_2 ")


@query(f"WITH {derived.cte('selection')} SELECT schema_name, CASE WHEN sum(CAST(checked AS INT)) = 0 THEN 'none' WHEN sum(CAST(checked AS INT)) = count(*) THEN 'all' ELSE 'some' END state, count(*) FILTER (checked) selected FROM selection GROUP BY 1")
def tri_state(spark, sf_dir):
    return hierarchy.tri_state(derived.frame(spark, sf_dir, "selection"), "schema_name")


def _world(spark, sf_dir) -> DataFrame:
    region, nation = _table(spark, sf_dir, "region"), _table(spark, sf_dir, "nation")
    top = region.select(F.lit("world").alias("parent"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("child"))
    return top.unionByName(nation.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child")))


_WORLD = """WITH RECURSIVE edges AS (SELECT 'world' parent, 'r' || r_regionkey child FROM region UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation),
tree(root, node, level_no) AS (SELECT 'world', 'world', 0 UNION ALL SELECT t.root, e.child, t.level_no + 1 FROM tree t JOIN edges e ON e.parent = t.node)"""


def _roots(spark, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node string")


@query(f"{_WORLD} SELECT root, node, level_no, NOT EXISTS (SELECT 1 FROM edges e WHERE e.parent = tree.node) is_leaf FROM tree")
def hierarchy_tree(spark, sf_dir):
    return hierarchy.hierarchy(_world(spark, sf_dir), _roots(spark, "world"))


@query(f"{_WORLD} SELECT root, node, level_no FROM tree WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.parent = tree.node)")
def hierarchy_leaves(spark, sf_dir):
    return hierarchy.leaves(_world(spark, sf_dir), _roots(spark, "world"))


@query(f"""WITH RECURSIVE {derived.cte("edges", "selected")}, tree(pos, node, level_no) AS (SELECT pos, node, 0 FROM selected UNION ALL SELECT t.pos, e.child, t.level_no + 1 FROM tree t JOIN edges e ON e.parent = t.node),
first AS (SELECT node, min((pos, level_no)) f FROM tree WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.parent = tree.node) GROUP BY 1)
SELECT node, CAST(row_number() OVER (ORDER BY f, node) AS BIGINT) position FROM first""")
def expanded_targets(spark, sf_dir):
    """Leaves of several roots, a diamond among them, each once."""
    return hierarchy.expand(derived.frame(spark, sf_dir, "edges"), derived.frame(spark, sf_dir, "selected"))


@query(f"""WITH RECURSIVE {derived.cte("relations", "namespaces", "inheritance")}, named AS (SELECT r.oid, r.relkind, n.nspname || '.' || r.relname full_name FROM relations r JOIN namespaces n ON n.oid = r.relnamespace),
tree(root, node, level_no) AS (SELECT full_name, oid, 0 FROM named WHERE relkind = 'p' UNION ALL SELECT t.root, i.inhrelid, t.level_no + 1 FROM tree t JOIN inheritance i ON i.inhparent = t.node)
SELECT root, full_name AS node, level_no FROM tree JOIN named ON oid = node WHERE node NOT IN (SELECT inhparent FROM inheritance)""")
def partition_leaves(spark, sf_dir):
    """The leaf partitions of every partitioned relation."""
    known = derived.as_catalog(spark, sf_dir)
    roots = recommend.named_relations(known).where("relkind = 'p'").select(X.qualified(F.col("schema_name"), F.col("table_name")).alias("node"))
    return hierarchy.leaves(hierarchy.relation_edges(known), roots)


@query("SELECT 'o0' AS root, 'o' || o_orderkey AS node, CAST(o_orderkey AS INTEGER) AS level_no FROM orders")
def deep_hierarchy(spark, sf_dir):
    """All orders as one chain, each the parent of the next: as deep as the table is long."""
    node = lambda c: F.concat(F.lit("o"), c.cast("string"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey")
    edges = orders.where("o_orderkey > 0").select(node(F.col("o_orderkey") - 1).alias("parent"), node(F.col("o_orderkey")).alias("child"))
    return hierarchy.walk(edges, _roots(spark, "o0"))


@query("SELECT 'c' || c_custkey AS node FROM customer ORDER BY node LIMIT 20")
def hierarchy_cycle(spark, sf_dir):
    """The report on customers in a circle, with a way into it and one out of it: the first twenty in the circle."""
    customers = _table(spark, sf_dir, "customer").select("c_custkey")
    n = customers.count()
    node = lambda c: F.concat(F.lit("c"), c.cast("string"))
    ring = customers.select(node(F.col("c_custkey")).alias("parent"), node((F.col("c_custkey") + 1) % n).alias("child"))
    edges = ring.unionByName(spark.createDataFrame([("before", "c0"), ("c1", "after")], "parent string, child string"))
    try:
        hierarchy.walk(edges, _roots(spark, "before"))
    except hierarchy.CycleError as error:
        return spark.createDataFrame([(x,) for x in error.nodes], "node string")
    raise RuntimeError("a circle went unnoticed")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_join_orders(spark, sf_dir):
    large = _table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return _table(spark, sf_dir, "customer").join(large, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


# --- jobs --------------------------------------------------------------------------

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'failed' ELSE 'running' END"
_PROGRESS = "count(*) total_items, count(*) FILTER (status = 'done') done_items, count(*) FILTER (status IN ('failed', 'interrupted')) failed_items, count(*) FILTER (status = 'skipped') skipped_items"
_PERCENT = "CASE WHEN total_items > 0 THEN round((done_items + failed_items + skipped_items) * 100.0::DOUBLE / total_items, 2) ELSE 0.0::DOUBLE END progress_percent"


@query(f"SELECT *, {_PERCENT} FROM (SELECT job_id, {_PROGRESS} FROM (SELECT o_custkey job_id, {_STATUS} status FROM orders) GROUP BY 1)")
def job_progress(spark, sf_dir):
    return jobs.progress(_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.expr(_STATUS).alias("status")))


@query(f"WITH {derived.cte('items')} SELECT *, {_PERCENT} FROM (SELECT job_id, {_PROGRESS} FROM items GROUP BY 1)")
def job_progress_cases(spark, sf_dir):
    return jobs.progress(derived.frame(spark, sf_dir, "items"))


@query("SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1")
def job_latest_state(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return jobs.latest_state(log, "user_id", order=("ts", "event_id"))


@query("SELECT o_custkey, round(epoch_us(max(o_orderdate) - min(o_orderdate)) / 1000000.0::DOUBLE, 2) duration_seconds FROM orders GROUP BY 1")
def job_durations(spark, sf_dir):
    ends = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return ends.select("o_custkey", X.seconds_between(F.col("a"), F.col("b")).alias("duration_seconds"))


@query(f"""WITH {derived.cte("jobs")} SELECT id, job_type, CASE WHEN status IN ('queued', 'running', 'stopping') THEN 'interrupted' ELSE status END status,
CASE WHEN status IN ('queued', 'running', 'stopping') AND coalesce(message, '') = '' THEN '{X.INTERRUPTED_MESSAGE}' ELSE message END message FROM jobs""")
def job_interrupt(spark, sf_dir):
    return jobs.recover(derived.frame(spark, sf_dir, "jobs"))


@query(f"WITH {derived.cte('jobs')} SELECT job_type, max(id) id FROM jobs GROUP BY 1")
def job_newest(spark, sf_dir):
    return jobs.newest(derived.frame(spark, sf_dir, "jobs"))


@query(f"WITH {derived.cte('jobs')} SELECT id AS job_id, job_type, status FROM jobs WHERE status IN ('queued', 'running', 'stopping') AND job_type = 'skew'")
def job_active(spark, sf_dir):
    return jobs.active(derived.frame(spark, sf_dir, "jobs").select(F.col("id").alias("job_id"), "job_type", "status"), "skew")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) k FROM events")
def job_config_json(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").k.alias("k"))


# --- parsing and text --------------------------------------------------------------


@query(f"""WITH {derived.cte("keys")} SELECT id, CASE WHEN regexp_full_match(trim(distkey), '\\{{.*\\}}|[0-9]+') THEN array_to_string(list_filter(list_transform(string_split(regexp_replace(trim(distkey), '[{{}}]', '', 'g'), ','), lambda x: TRY_CAST(trim(x) AS INTEGER)), lambda x: x IS NOT NULL), ',') ELSE '' END parsed FROM keys""")
def distkey_parse(spark, sf_dir):
    return derived.frame(spark, sf_dir, "keys").select("id", F.array_join(F.coalesce(X.parse_distribution_key(F.col("distkey")), F.array().cast("array<int>")), ",").alias("parsed"))


@query(f"WITH {_CATALOG_CTE}, {_METADATA_SQL} SELECT localoid, array_to_string(cols, ',') \"columns\" FROM keyed")
def dist_columns(spark, sf_dir):
    return recommend.key_columns(derived.as_catalog(spark, sf_dir)).withColumn("columns", F.array_join("columns", ","))


@query(f"WITH {derived.cte('secrets')} SELECT id, CASE WHEN coalesce(password, '') = '' THEN '' ELSE '********' END password FROM secrets")
def mask_secret(spark, sf_dir):
    return derived.frame(spark, sf_dir, "secrets").select("id", X.mask_secret(F.col("password")).alias("password"))


@query("SELECT r_name || '.' || n_name AS full_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def qualified_name(spark, sf_dir):
    joined = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.select(X.qualified(F.col("r_name"), F.col("n_name")).alias("full_name"))


# --- layout and upkeep: physical, so rows only ---------------------------------------


def _scratch(spark: SparkSession) -> str:
    spark.sql("CREATE DATABASE IF NOT EXISTS tablehealth_scratch")
    return f"tablehealth_scratch.t_{uuid.uuid4().hex[:12]}"


@query()
def layout_hash(spark, sf_dir):
    """Skew of orders bucketed by its key, read off the files."""
    table = _scratch(spark)
    layout.write_layout(_table(spark, sf_dir, "orders"), table, "HASH", ["o_orderkey"], 8)
    return layout.bucket_skew(spark, table)


@query("SELECT count(*) AS total_rows, 8 AS segment_count, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders")
def layout_rows_kept(spark, sf_dir):
    """All rows and all declared buckets after a rewrite from random to hash."""
    table = _scratch(spark)
    layout.write_layout(_table(spark, sf_dir, "orders"), table, "RANDOM", n=3)
    outcome = layout.relayout(spark, table, "HASH", ["o_orderkey"], 8)
    if not outcome["ok"]:
        raise RuntimeError(outcome["message"])
    sums = spark.table(table).agg(F.sum("o_orderkey").alias("key_sum"))
    return layout.bucket_skew(spark, table).select("total_rows", F.col("segment_count").cast("int").alias("segment_count")).join(sums, F.lit(True))


@query("SELECT CASE WHEN count(*) = count(DISTINCT o_orderkey) THEN 'HASH' ELSE 'RANDOM' END AS recommendation_type, CASE WHEN count(*) = count(DISTINCT o_orderkey) THEN 'o_orderkey' END AS source_column, 'RANDOM' AS current_type, CAST(count(*) AS DOUBLE) AS row_estimate FROM orders")
def recommendation_live(spark, sf_dir):
    """A table of the session's own catalog, written and analysed, gets its distribution key by statistics and scan."""
    table = _scratch(spark)
    layout.write_layout(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), table, "RANDOM", n=3)
    layout.maintain(spark, table, "analyze")
    known = catalog.from_spark(spark)
    own = known.relations.where(F.col("relname") == table.split(".")[-1])
    known.relations = own.join(known.namespaces.where(F.col("nspname") == (table.split(".")[0] if "." in table else spark.catalog.currentDatabase())).select(F.col("oid").alias("relnamespace")), "relnamespace", "left_semi").select(*own.columns)
    scanned = recommend.scan_tables(known, lambda s, t: spark.table(f"{s}.{t}"))
    found = recommend.recommend(known, scanned).select("schema_name", "table_name", "recommendation_type", "source_column", "current_type")
    return found.join(known.relations.select(F.col("relname").alias("table_name"), F.col("reltuples").alias("row_estimate")), "table_name").select("recommendation_type", "source_column", "current_type", "row_estimate")


@query()
def layout_random(spark, sf_dir):
    table = _scratch(spark)
    layout.write_layout(_table(spark, sf_dir, "orders"), table, "RANDOM", n=8)
    return skew.analyze(spark.table(table), segments.by_file())


@query()
def layout_before_after(spark, sf_dir):
    """A table keyed badly, then by its unique column."""
    table = _scratch(spark)
    layout.write_layout(_table(spark, sf_dir, "orders"), table, "HASH", ["o_orderstatus"], 8)
    before = spark.createDataFrame(layout.bucket_skew(spark, table).collect(), layout.bucket_skew(spark, table).schema)
    outcome = layout.relayout(spark, table, "HASH", ["o_orderkey"], 8)
    if not outcome["ok"]:
        raise RuntimeError(outcome["message"])
    return layout.compare(before, layout.bucket_skew(spark, table))


@query()
def maintenance_analyze(spark, sf_dir):
    table = _scratch(spark)
    layout.write_layout(_table(spark, sf_dir, "customer"), table, "RANDOM", n=2)
    outcome = layout.maintain(spark, table, "analyze")
    if not outcome["ok"]:
        raise RuntimeError(outcome["message"])
    return layout.column_statistics(spark, table)


@query()
def table_size(spark, sf_dir):
    return catalog.table_bytes(_table(spark, sf_dir, "orders"))


@query("SELECT count(*) total_rows FROM orders")
def skew_files_total(spark, sf_dir):
    """Rows of all files; the plan reads no column, so footers alone."""
    return skew.analyze(_table(spark, sf_dir, "orders"), segments.by_file()).select("total_rows")


@query("SELECT count(*) AS total_rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum, count(DISTINCT o_orderstatus) - 1 AS partitions FROM orders")
def layout_compact(spark, sf_dir):
    """A partitioned table after its small files were merged; the last partition has one file and stays as it is."""
    table = _scratch(spark)
    orders = _table(spark, sf_dir, "orders")
    # pieces of a sixteenth of a whole file, five at least, so that no task's share grows with the table
    size = sum(catalog.file_sizes(orders).values())
    pieces = max(5, -(-size // (layout.FILE_BYTES // 16)))
    ends = orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("o_orderstatus")).first()
    last, share = (ends["o_orderstatus"], ends["n"] / orders.count()) if ends else (None, 0)
    small = orders.where(~F.col("o_orderstatus").eqNullSafe(last)).withColumn("_part", F.pmod(F.hash("o_orderkey"), F.lit(pieces)))
    small.repartition(2 * pieces + 2, "o_orderstatus", "_part").drop("_part").write.partitionBy("o_orderstatus").saveAsTable(table)
    if last is not None:
        # one partition by name: its rows are written as they come, in whole files
        rows = orders.where(F.col("o_orderstatus") == last).select(*[c for c in orders.columns if c != "o_orderstatus"]).repartition(max(1, int(size * share) // layout.FILE_BYTES), "o_orderkey")
        spark.sql(f"INSERT INTO {table} PARTITION (o_orderstatus = '{last}') SELECT * FROM {{rows}}", rows=rows)
    outcome = layout.compact(spark, table)
    if not outcome["ok"]:
        raise RuntimeError(outcome["message"])
    return spark.table(table).agg(F.count(F.lit(1)).alias("total_rows"), F.sum("o_orderkey").alias("key_sum")).withColumn("partitions", F.lit(outcome["partitions"]).cast("long"))


# --- the store: commits, compaction, other databases -----------------------------------


def _store(spark: SparkSession) -> stores.Store:
    made = stores.Store(spark, files.shared_path(spark, f"store-{uuid.uuid4().hex[:12]}"))
    made.bootstrap()
    return made


@query("SELECT (SELECT count(DISTINCT l_returnflag) FROM lineitem) headers, count(*) segments, CAST(sum(n) AS BIGINT) AS segment_rows, (SELECT count(*) FROM lineitem) AS header_rows FROM (SELECT count(*) n FROM lineitem GROUP BY l_returnflag, l_suppkey)")
def atomic_results(spark, sf_dir):
    """Headers and segments in the store after one write and another that was lost before its commit."""
    store = _store(spark)
    counts = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("table_name"), F.col("l_suppkey").cast("int").alias("segment_id")).agg(F.count(F.lit(1)).alias("row_count"))
    headers = skew.statistics(counts, ("table_name",)).withColumn("schema_name", F.lit("lineitem"))
    stores.save_results(store, headers, counts)
    store.prepare({"skew_results": headers})  # and here the driver went
    found = store.read("skew_results").agg(F.count(F.lit(1)).alias("headers"), F.sum("total_rows").alias("header_rows"))
    parts = store.read("skew_result_segments").agg(F.count(F.lit(1)).alias("segments"), F.sum("row_count").alias("segment_rows"))
    result = files.keep(found.join(parts, F.lit(True)))
    store.files.delete("")
    return result


_AS_EVENTS = "event_id AS seq, user_id AS job_id, CASE event_id * 31 % 11 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'stopping' WHEN 3 THEN 'cancelled' WHEN 4 THEN 'failed' WHEN 5 THEN 'interrupted' WHEN 6 THEN 'stopping' WHEN 7 THEN 'running' WHEN 8 THEN 'interrupted' WHEN 9 THEN 'lost' ELSE 'done' END AS event"
#: One step of a job at a time, by recursion over its numbered events.
_STEPS = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) rn FROM (SELECT {_AS_EVENTS} FROM events)),
s(job_id, rn, status, rejected) AS (SELECT DISTINCT job_id, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT) FROM e
UNION ALL SELECT s.job_id, e.rn, CASE WHEN {{allowed}} THEN e.event ELSE s.status END, s.rejected + CASE WHEN {{allowed}} THEN 0 ELSE 1 END FROM s JOIN e ON e.job_id = s.job_id AND e.rn = s.rn + 1)
SELECT job_id, arg_max(status, rn) status, max(rejected) rejected FROM s GROUP BY 1""".replace("{allowed}", "CASE e.event WHEN 'lost' THEN false WHEN 'done' THEN s.status <> 'cancelled' WHEN 'stopping' THEN s.status IN ('queued', 'running') WHEN 'interrupted' THEN s.status IN ('queued', 'running', 'stopping') ELSE true END")


@query(_STEPS)
def guarded_states(spark, sf_dir):
    """States of jobs whose logs are full of transitions that their state forbids."""
    events = _table(spark, sf_dir, "events").selectExpr(*_split(_AS_EVENTS))
    return machine.fold(events, machine.JOB, ["job_id"], ["seq"], chunk=F.floor(F.col("seq") / 4096))


def _split(columns: str) -> list[str]:
    """The three expressions of ``_AS_EVENTS``."""
    first, second, third = columns.split(", ", 2)
    return [first, second, third]


@query(f"SELECT job_id, status FROM ({_STEPS})")
def event_log_compacted(spark, sf_dir):
    """The same states from a store: events in twelve commits, some compacted twice, some not yet."""
    store = _store(spark)
    events = _table(spark, sf_dir, "events").selectExpr(*_split(_AS_EVENTS))
    for i in range(12):
        store.append("job_events", events.where(F.pmod(F.col("seq"), F.lit(12)) == i))
        if i in (4, 9):
            store.compact("job_events")
            store.vacuum(0)
    result = files.keep(jobs.job_states(store.read("job_events")).select("job_id", "status"))
    store.files.delete("")
    return result


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 1000")
def jdbc_round_trip(spark, sf_dir):
    """Orders through another database, read back by several tasks; the filter runs in that database."""
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("the embedded database lives in one JVM: local sessions only")
    url = f"jdbc:derby:memory:orders_{uuid.uuid4().hex[:8]};create=true"
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").cast("varchar(8)").alias("o_orderstatus"), "o_totalprice")
    rows.coalesce(4).write.format("jdbc").options(url=url, dbtable="orders_copy", createTableColumnTypes="o_orderstatus VARCHAR(8)").save()
    back = stores.open_jdbc(spark, url, "orders_copy", '"o_orderkey"', max(1, rows.count() // 6))
    return back.where("o_totalprice > 1000").select("o_orderkey", "o_custkey", "o_orderstatus")


# --- streaming ---------------------------------------------------------------------


@query("SELECT event_type, count(*) n FROM events GROUP BY 1")
def progress_stream(spark, sf_dir):
    """Status counts of an event log, folded by a stream over all there is."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a folder is followed as it is, a file by its name within its folder
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path) if _is_folder(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return progress.to_memory(progress.status_counts(stream, "event_type"), f"progress_{uuid.uuid4().hex[:8]}")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) status, count(*) n_events FROM events GROUP BY 1")
def progress_resumed(spark, sf_dir):
    """The last status of every user from a stream that was fed in two halves, with a restart between."""
    base = files.Files(spark, files.shared_path(spark, f"resumed-{uuid.uuid4().hex[:12]}"))
    events = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    for half in (0, 1):
        events.where(F.pmod(F.col("event_id"), F.lit(2)) == half).write.mode("append").parquet(f"{base.path}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{base.path}/in")
        found = progress.resume(stream, ["user_id"], ["ts", "event_id"], "event_type", f"{base.path}/out", f"{base.path}/checkpoint")
    result = files.keep(found)
    base.delete("")
    return result


def _is_folder(spark: SparkSession, path: str) -> bool:
    """More than the file itself under ``path``?  Asked through Spark, so any store will do."""
    files = spark.read.format("binaryFile").load(path).select("path").limit(2).collect()
    return not (len(files) == 1 and files[0]["path"].rstrip("/").endswith("/events.parquet"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
