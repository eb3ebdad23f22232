"""The console's calls as functions: validated requests in, (status, payload) out.

A thin front over the operators for whoever serves them over HTTP.  Payloads are plain
dicts, lists and scalars.  Tables are catalog tables named ``schema.table``.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tablehealth.operators import hierarchy, history, jobs, layout, recommend, skew
from tablehealth.sources import catalog, segments
from tablehealth.sources import store as stores
from tablehealth.sources.files import staging

Reply = tuple[int, dict]


#: Rows of a page that do not come with a smaller limit of their own.
PAGE_ROWS = 10_000
#: Segments that a reply about one table carries, the fullest.
REPLY_SEGMENTS = 1000


def _plain(df: DataFrame, most: int = PAGE_ROWS) -> list[dict]:
    """Rows of a result page, ``most`` of them at most."""
    return [{k: v.isoformat(" ", "seconds") if isinstance(v, datetime) else v for k, v in r.asDict(recursive=True).items()} for r in df.limit(most).collect()]


def _bad(message: str, status: int = 400) -> Reply:
    return status, {"ok": False, "message": message}


def physical_segment(spark: SparkSession, table: str) -> tuple[Column, int | None]:
    """Buckets of a bucketed table, all of them; files of any other."""
    info = catalog.describe(spark, table)
    return (segments.by_bucket(), info["buckets"]) if info.get("buckets") else (segments.by_file(), None)


class Service:
    def __init__(self, spark: SparkSession, store: stores.Store, relations: Callable[..., catalog.Catalog] | None = None, segment: Callable[[SparkSession, str], tuple[Column, int | None]] = physical_segment):
        self.spark, self.store, self.log, self.segment = spark, store, jobs.JobLog(store), segment
        self.relations = relations or (lambda *only: catalog.from_spark(spark, *only))

    # sources

    def sources(self) -> Reply:
        return 200, {"ok": True, "sources": _plain(stores.current_sources(self.store))}

    def add_source(self, name: str, location: str, format_: str = "parquet") -> Reply:
        id_ = self.log._next()
        try:
            stores.add_source(self.store, id_, name or "", location or "", format_ or "")
        except ValueError as error:
            return _bad(str(error))
        return 200, {"ok": True, "id": id_}

    def delete_source(self, id_: int) -> Reply:
        stores.remove_source(self.store, id_)
        return 200, {"ok": True}

    def test_source(self, id_: int) -> Reply:
        found = stores.current_sources(self.store).where(F.col("id") == id_).first()
        return (200, stores.probe(self.spark, found["format"], found["location"])) if found else _bad("Source not found", 404)

    # exploration

    def object_tree(self, search: str = "") -> Reply:
        tree = hierarchy.search(hierarchy.object_tree(self.relations()), search)
        return 200, {"ok": True, "database": self.spark.catalog.currentDatabase(), "schemas": _plain(hierarchy.nested_tree(tree).orderBy("schema"))}

    # skew

    def _counts(self, table: str) -> DataFrame:
        segment, declared = self.segment(self.spark, table)
        return skew.segment_counts(self.spark.table(table), segment, declared)

    def analyze(self, tables: list[dict]) -> Reply:
        """At once, without a job: a failing table is a FAILED row.  Of a table's segments the fullest come along."""
        if not tables:
            return _bad("tables are required")
        out = []
        for t in tables:
            name = {"schema_name": t.get("schema"), "table_name": t.get("table")}
            if not all(name.values()):
                out.append(name | {"status": "FAILED", "error": "schema and table are required"})
                continue
            try:
                with staging(self.spark, "analyze") as stage:
                    counts = stage(self._counts(f"{t['schema']}.{t['table']}"))
                    one = skew.statistics(counts).first().asDict()
                    out.append(name | one | {"segments": _plain(skew.top_segments(counts, REPLY_SEGMENTS))})
            except Exception as error:  # the row carries the failure
                out.append(name | {"status": "FAILED", "error": str(error).splitlines()[0]})
        return 200, {"ok": True, "results": out}

    def _record_skew(self, job_id: int):
        """Segments go from the count straight to the store; a table's one row of statistics is folded from what was stored."""

        def work(spark: SparkSession, schema: str, table: str) -> None:
            id_, now = self.log._next(), F.localtimestamp()
            base = {"job_id": F.lit(job_id), "schema_name": F.lit(schema), "table_name": F.lit(table), "checked_at": now}
            counts = self._counts(f"{schema}.{table}")
            if isinstance(counts.schema["segment_id"].dataType, StringType):  # files go by their number in the table's own listing
                files = spark.createDataFrame(list(enumerate(sorted(catalog.file_sizes(spark.table(f"{schema}.{table}"))))), "_number int, _file string")
                name = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
                counts = counts.join(files, name(F.col("segment_id")) == name(F.col("_file"))).select(F.col("_number").alias("segment_id"), "row_count")
            rows = counts.select(F.xxhash64(F.lit(id_), F.col("segment_id")).alias("id"), F.lit(id_).alias("skew_result_id"), "segment_id", "row_count").withColumns(base)
            segments = self.store.prepare({"skew_result_segments": rows})
            stored = spark.read.schema(self.store.schema("skew_result_segments")).parquet(f"{self.store.path}/{segments['skew_result_segments']}")
            header = skew.statistics(stored).withColumns(base | {"id": F.lit(id_)})
            self.store.publish(segments | self.store.prepare({"skew_results": header}))

        return work

    def start_skew(self, tables: list[dict], wait: bool = False) -> Reply:
        if not tables:
            return _bad("tables are required")
        job = self.log.submit("skew", [(t.get("schema") or "", t.get("table") or "") for t in tables], {"tables": tables})
        thread = self.log.start(job, self._record_skew(job))
        if wait:
            thread.join()
        return 200, {"ok": True, "job_id": job}

    def skew_results(self, limit: str | int | None = None) -> Reply:
        jobs_ = self.store.read("jobs")
        found = history.ranked(history.latest(self.store.read("skew_results"), jobs_), history.parse_limit(limit))
        return 200, {"ok": True, "results": _plain(found.orderBy("position"))}

    def problem_tables(self, limit: int = 500) -> Reply:
        found = history.problems(history.latest(self.store.read("skew_results"), self.store.read("jobs")), limit)
        return 200, {"ok": True, "results": _plain(found.orderBy("position"))}

    def job_results(self, job_id: int) -> Reply:
        own = history.of_job(self.store.read("skew_results"), job_id)
        summary = _plain(history.summarize(own, jobs.item_states(self.log.events(job_id))))[0]
        return 200, {"ok": True, "results": _plain(own), "summary": summary}

    def result_segments(self, result_id: int) -> Reply:
        found = _plain(self.store.find("skew_results", result_id))
        if not found:
            return _bad("Result not found", 404)
        own = self.store.read("skew_result_segments").where(F.col("skew_result_id") == result_id).select("segment_id", "row_count")
        return 200, {"ok": True, "segments": _plain(skew.top_segments(own, REPLY_SEGMENTS)), "result": found[0]}

    # jobs

    def job(self, job_id: int) -> Reply:
        found = _plain(self.log.states().where(F.col("job_id") == job_id))
        return (200, {"ok": True, "job": found[0]}) if found else _bad("Job not found", 404)

    def job_items(self, job_id: int) -> Reply:
        items = self.store.read("job_items").where(F.col("job_id") == job_id).select(F.col("id").alias("item_id"), "schema_name", "table_name", "action")
        states = jobs.item_states(self.log.events(job_id)).drop("job_id")
        return 200, {"ok": True, "items": _plain(items.join(states, "item_id", "left").orderBy("item_id"))}

    def stop_job(self, job_id: int) -> Reply:
        self.log.request_stop(job_id)
        return 200, {"ok": True}

    def latest_job(self, job_type: str = "skew") -> Reply:
        newest = jobs.newest(self.store.read("jobs")).where(F.col("job_type") == job_type).first()
        return self.job(newest["id"]) if newest else _bad("Job not found", 404)

    def active_jobs(self, job_type: str | None = None) -> Reply:
        return 200, {"ok": True, "jobs": _plain(jobs.active(self.log.states(), job_type))}

    # layout

    def start_reorganize(self, tables: list[dict], wait: bool = False) -> Reply:
        """Expand to leaf partitions, each once, and rewrite them one by one."""
        named = [(i, f"{t['schema']}.{t['table']}") for i, t in enumerate(tables) if t.get("schema") and t.get("table")]
        if not named:
            return _bad("tables are required")
        known = self.relations()
        selected = self.spark.createDataFrame(named, "pos int, node string")
        targets = [r["node"] for r in hierarchy.expand(hierarchy.relation_edges(known), selected).orderBy("position").collect()]
        items = [tuple(t.split(".", 1)) for t in targets if self.spark.catalog.tableExists(t)]
        if not items:
            return _bad("No tables to reorganize")
        job = self.log.submit("reorganize", items, {"selected_tables": tables, "expanded_tables": targets}, "REORGANIZE")

        def work(spark: SparkSession, schema: str, table: str) -> None:
            done = layout.reorganize(spark, f"{schema}.{table}")
            if not done["ok"]:
                raise RuntimeError(done["message"])

        thread = self.log.start(job, work)
        if wait:
            thread.join()
        return 200, {"ok": True, "job_id": job, "total_items": len(items)}

    def recommendation(self, schema: str, table: str) -> Reply:
        if not schema or not table:
            return _bad("schema and table are required")
        known = self.relations(schema, table)
        scanned = recommend.scan_tables(known, lambda s, t: self.spark.table(f"{s}.{t}"))
        found = _plain(recommend.recommend(known, scanned).where((F.col("schema_name") == schema) & (F.col("table_name") == table)))
        return 200, {"ok": True} | found[0] if found else {"ok": False, "message": "Table not found"}

    def apply_distribution(self, schema: str, table: str, kind: str, columns: list[str] | None = None) -> Reply:
        if not schema or not table or not kind:
            return _bad("schema, table and distribution type are required")
        return 200, layout.relayout(self.spark, f"{schema}.{table}", kind, columns)
