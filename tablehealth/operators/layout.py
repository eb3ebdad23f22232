"""Physical layout: rewriting tables under hash, random or replicated distribution; upkeep."""

from __future__ import annotations

import re
import time
import uuid
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablehealth.operators import skew
from tablehealth.sources import catalog, segments
from tablehealth.sources.files import Leases, shared_path, staging

#: A table is cut into so many bytes a file or bucket where no number is given, and into one of each at least.
FILE_BYTES = 128 << 20
#: Largest list of folders that is sent to every executor.
BROADCAST_BYTES = 16 << 20
# Fixed values.
MAINTENANCE = ("analyze", "full", "freeze", "full_analyze", "freeze_analyze")


def claims(spark: SparkSession) -> Leases:
    """Who rewrites which table: one rewrite at a time, also of several drivers."""
    return Leases(spark, shared_path(spark, "_table_leases"))


def write_layout(df: DataFrame, table: str, kind: str, columns: list[str] | None = None, n: int | None = None, format_: str = "parquet") -> None:
    """Write ``df`` as a new table: HASH buckets by ``columns``, RANDOM spreads rows.

    Without ``n`` the files that ``df`` reads say how many files or buckets there are.

    REPLICATED marks a small table that every reader takes whole; it lies in as many files
    as its size needs.
    """
    kind, n = kind.strip().upper(), n or max(1, -(-sum(catalog.file_sizes(df).values()) // FILE_BYTES))
    if kind == "HASH":
        if not columns:
            raise ValueError("HASH distribution requires columns")
        df.repartition(n, *columns).write.format(format_).bucketBy(n, *columns).saveAsTable(table)
    elif kind == "RANDOM":
        df.repartition(n).write.format(format_).saveAsTable(table)
    elif kind == "REPLICATED":
        df.repartition(n).write.format(format_).saveAsTable(table)
    else:
        raise ValueError(f"Unknown distribution type: {kind}")
    # one file alone does not tell a replicated table from a small one
    df.sparkSession.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('distribution' = '{kind}')")


def parts_for(spark: SparkSession, table: str) -> int:
    """Files or buckets for a table of its size."""
    size = catalog.table_bytes(spark.table(table)).first()["total_bytes"]
    return max(1, -(-size // FILE_BYTES))


def recover(spark: SparkSession, table: str) -> str:
    """Undo a swap that a lost driver left half done: "restored", "cleaned" or "nothing".

    Where the table is gone, its old copy takes its place again; copies that are left over
    go, the staged ones and the old ones of a swap that came through.  Only for those who
    hold the table's lease: another driver's staged copy is no leftover.
    """
    space, _, name = table.rpartition(".")
    names = {t.name for t in (spark.catalog.listTables(space) if space else spark.catalog.listTables()) if not t.isTemporary}
    left = sorted(n for n in names if re.fullmatch(re.escape(name) + "_(old|new)_[0-9a-f]{8}", n))
    done = "nothing"
    if name not in names and (old := [n for n in left if n.startswith(f"{name}_old_")]):
        spark.sql(f"ALTER TABLE {_in(space, old[-1])} RENAME TO {table}")
        left.remove(old[-1])
        done = "restored"
    if name in names or done == "restored":
        for n in left:
            spark.sql(f"DROP TABLE {_in(space, n)}")
            done = "cleaned" if done == "nothing" else done
    return done


def _in(space: str, name: str) -> str:
    return f"{space}.{name}" if space else name


def _swap(spark: SparkSession, table: str, staging: str) -> None:
    """Put the staged table in the place of ``table``; the old one goes last."""
    old = f"{table}_old_{uuid.uuid4().hex[:8]}"
    spark.sql(f"ALTER TABLE {table} RENAME TO {old}")
    try:
        spark.sql(f"ALTER TABLE {staging} RENAME TO {table}")
    except Exception:
        spark.sql(f"ALTER TABLE {old} RENAME TO {table}")
        raise
    spark.sql(f"DROP TABLE {old}")


def _outcome(table: str, began: float, ok: bool, status: str, message: str, **more) -> dict:
    return {"ok": ok, "status": status, "message": message, "table_name": table, "duration_sec": round(time.time() - began, 2)} | more


def relayout(spark: SparkSession, table: str, kind: str, columns: list[str] | None = None, n: int | None = None) -> dict:
    """Rewrite a table under a new distribution; never raises.

    Rows go to a staging table first, so a failure leaves the table as it was; what an
    earlier rewrite left half done is put right before.  One rewrite of a table at a time.
    """
    began = time.time()
    with claims(spark).held(_claim(spark, table)) as lease:
        if lease is None:
            return _outcome(table, began, False, "FAILED", "Table is being rewritten", distribution=kind, columns=list(columns or []))
        staged = f"{table}_new_{uuid.uuid4().hex[:8]}"
        try:
            recover(spark, table)
            info = catalog.describe(spark, table)
            if not info:
                return _outcome(table, began, False, "NOT_FOUND", "Table not found")
            write_layout(spark.table(table), staged, kind, columns, n or info["buckets"] or parts_for(spark, table), info["provider"] or "parquet")
            if lease.lost:
                raise RuntimeError("The claim on the table ran out")
            _swap(spark, table, staged)
            return _outcome(table, began, True, "SUCCESS", "Layout applied", distribution=kind.strip().upper(), columns=list(columns or []))
        except Exception as error:  # the outcome carries the failure
            spark.sql(f"DROP TABLE IF EXISTS {staged}")
            return _outcome(table, began, False, "FAILED", str(error).splitlines()[0], distribution=kind, columns=list(columns or []))


def _claim(spark: SparkSession, table: str) -> str:
    return table if "." in table else f"{spark.catalog.currentDatabase()}.{table}"


def small_files(spark: SparkSession, table: str, file_bytes: int = FILE_BYTES) -> dict[str, dict[str, int]]:
    """Folders of a table in which two files or more would fit into one, with these files and their sizes."""
    folders: dict[str, dict[str, int]] = {}
    for name, size in catalog.file_sizes(spark.table(table)).items():
        if 2 * size <= file_bytes:
            folders.setdefault(name.rpartition("/")[0], {})[name] = size
    return {f: files for f, files in folders.items() if len(files) > 1}


def compact(spark: SparkSession, table: str, file_bytes: int = FILE_BYTES) -> dict:
    """Merge the small files of a partitioned table, partition by partition; never raises.

    A partition is rewritten only if it holds two or more files of at most half the wanted
    size; it gets as many files as its bytes fill, and other partitions' files are not
    touched.  The rows are staged first, and the new partitions then take the old ones'
    places, each in one step.
    """
    began = time.time()
    with claims(spark).held(_claim(spark, table)) as lease:
        if lease is None:
            return _outcome(table, began, False, "FAILED", "Table is being rewritten")
        try:
            columns = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
            if not columns:
                return _outcome(table, began, False, "FAILED", "Only partitioned tables can be rewritten in part")
            wanted = small_files(spark, table, file_bytes)
            if not wanted:
                return _outcome(table, began, True, "SUCCESS", "Nothing to rewrite", partitions=0, files_before=0, files_after=0)
            sizes = catalog.file_sizes(spark.table(table))
            folder = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]*$", 1), "^file:/+", "file:/")
            held = dict.fromkeys(wanted, 0)
            for name, n in sizes.items():
                if (f := name.rpartition("/")[0]) in held:
                    held[f] += n
            parts = {f: max(1, -(-n // file_bytes)) for f, n in held.items()}
            # the names leave out other folders' files before they are opened; the numbers come by a join, as there may be very many
            rows = spark.table(table).withColumn("_folder", folder).where(F.col("_folder").isin([_as_metadata(f) for f in wanted]))
            firsts = [0, *accumulate(parts.values())]  # each new file has a number of its own
            due = spark.createDataFrame([(_as_metadata(f), n, first) for (f, n), first in zip(parts.items(), firsts)], "_due string, _files int, _first int")
            # one row a folder and counted already; shuffled by folder, a task would hold the largest partition
            due = F.broadcast(due) if sum(len(f) + 64 for f in parts) <= BROADCAST_BYTES else due
            numbered = rows.join(due, F.col("_folder") == F.col("_due")).withColumn("_file", (F.col("_first") + F.floor(F.rand(7) * F.col("_files"))).cast("int")).drop("_folder", "_due", "_files", "_first")
            with staging(spark, "compact") as stage:
                staged = stage(numbered)
                if lease.lost:
                    raise RuntimeError("The claim on the table ran out")
                if staged.isEmpty():
                    raise RuntimeError("The small files could not be told by their names")
                _replace_partitions(staged, _claim(spark, table), firsts[-1])
            spark.catalog.refreshTable(table)
            after = catalog.file_sizes(spark.table(table))
            count = lambda found: sum(name.rpartition("/")[0] in wanted for name in found)
            return _outcome(table, began, True, "SUCCESS", "Small files merged", partitions=len(wanted), files_before=count(sizes), files_after=count(after))
        except Exception as error:  # the outcome carries the failure
            return _outcome(table, began, False, "FAILED", str(error).splitlines()[0])


def _as_metadata(folder: str) -> str:
    """A folder's name as the metadata column has it."""
    return re.sub("^file:/+", "file:/", folder)


def _replace_partitions(staged: DataFrame, table: str, files: int) -> None:
    """Overwrite the partitions that ``staged`` has rows of, and no others, by a task for each of so many ``files``.

    In a session of its own, so that the caller's settings stay as they are.
    """
    own = staged.sparkSession.newSession()
    own.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    # a task meets one partition, so its rows need not be sorted by partition first
    own.conf.set("spark.sql.maxConcurrentOutputFileWriters", "1")
    folder = staged.inputFiles()[0].rpartition("/")[0]
    rows = own.read.schema(staged.schema).parquet(folder)
    rows.repartitionById(files, F.col("_file")).select(*own.table(table).columns).write.mode("overwrite").insertInto(table)


def reorganize(spark: SparkSession, table: str) -> dict:
    """Rewrite a table under the distribution it has."""
    info = catalog.describe(spark, table)
    if not info:
        return _outcome(table, time.time(), False, "NOT_FOUND", "Table not found")
    return relayout(spark, table, info["distribution"], info["columns"], info["buckets"])


def maintain(spark: SparkSession, table: str, kind: str) -> dict:
    """analyze gathers statistics, full rewrites the files; freeze has nothing to do in Spark."""
    began, kind = time.time(), kind.strip().lower()
    if kind not in MAINTENANCE:
        raise ValueError(f"Unknown maintenance type: {kind}")
    try:
        if not spark.catalog.tableExists(table):
            return _outcome(table, began, False, "NOT_FOUND", "Table not found", kind=kind)
        if kind.startswith("full") and not (done := reorganize(spark, table))["ok"]:
            return done | {"kind": kind}
        if kind.endswith("analyze"):
            spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")
        return _outcome(table, began, True, "SUCCESS", "Nothing to freeze" if kind == "freeze" else "Done", kind=kind)
    except Exception as error:  # the outcome carries the failure
        return _outcome(table, began, False, "FAILED", str(error).splitlines()[0], kind=kind)


def bucket_skew(spark: SparkSession, table: str) -> DataFrame:
    """Physical skew of a bucketed table over all its buckets, empty ones too, by the bucket in the file names."""
    return skew.analyze(spark.table(table), segments.by_bucket(), catalog.describe(spark, table).get("buckets"))


def column_statistics(spark: SparkSession, table: str) -> DataFrame:
    """attname, n_distinct, null_frac of an analysed table, in the shape of a statistics catalog."""
    rows = catalog.size_and_rows(catalog.describe(spark, table).get("statistics"))[1]
    return spark.createDataFrame(catalog.column_statistics(spark, table, rows), "attname string, n_distinct double, null_frac double")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.withColumn("layout", F.lit("before")).unionByName(after.withColumn("layout", F.lit("after")))
