"""Jobs as an event log: states, progress, durations, cancellation and recovery are derived.

Events of a job have a null item_id.  States are a fold of the events in the order of
``seq`` through guarded transitions (``machine``): a job once cancelled is not done, a job
that ended is not asked to stop, and only what is open is interrupted.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable
from itertools import batched

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablehealth.functions import expressions as X
from tablehealth.operators import machine
from tablehealth.sources.files import Leases
from tablehealth.sources.store import Store, now

#: Rows that one commit carries in the log; commits of events beyond which a job compacts them at its end.
ROWS_A_COMMIT = 10_000
MOST_COMMITS = 200


def latest_state(events: DataFrame, *key: str, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The last event of every key; a maximum over structs, so partial sums do most of the work."""
    rest = [c for c in events.columns if c not in {*key, *order}]
    last = events.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("_last"))
    return last.select(*key, "_last.*")


def item_states(events: DataFrame) -> DataFrame:
    """job_id, item_id, status, started_at, finished_at, duration_seconds, message."""
    items = events.where(F.col("item_id").isNotNull())
    folded = machine.fold(items, machine.ITEM, ["job_id", "item_id"], ["seq"], ("at", "message"), times={"started_at": (F.max, "running", "at")})
    ended = F.when(F.col("status").isin(*X.FINAL), F.col("at"))
    return folded.select("job_id", "item_id", "status", "started_at", ended.alias("finished_at"), X.seconds_between(F.col("started_at"), ended).alias("duration_seconds"), "message")


def job_states(events: DataFrame) -> DataFrame:
    """job_id, status, started_at, finished_at, message, rejected: events that the state at their time refused."""
    own = events.where(F.col("item_id").isNull())
    folded = machine.fold(own, machine.JOB, ["job_id"], ["seq"], ("at", "message"), times={"started_at": (F.min, "running", "at")})
    return folded.select("job_id", "status", "started_at", F.when(F.col("status").isin(*X.FINAL), F.col("at")).alias("finished_at"), "message", "rejected")


def progress(items: DataFrame, by: str = "job_id") -> DataFrame:
    """Counts and percent per job: failed includes interrupted, skipped counts as finished."""
    status = F.col("status")
    counts = items.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(status == "done").alias("done_items"),
        F.count_if(status.isin("failed", "interrupted")).alias("failed_items"),
        F.count_if(status == "skipped").alias("skipped_items"),
    )
    return counts.withColumn("progress_percent", X.percent(F.col("done_items") + F.col("failed_items") + F.col("skipped_items"), F.col("total_items")))


def active(states: DataFrame, job_type: str | None = None) -> DataFrame:
    """Open jobs, newest first, of one type or of all."""
    found = states.where(F.col("status").isin(*X.JOB_OPEN))
    return (found if job_type is None else found.where(F.col("job_type") == job_type)).orderBy(F.desc("job_id"))


def newest(jobs: DataFrame) -> DataFrame:
    """The newest job of each type."""
    return jobs.groupBy("job_type").agg(F.max("id").alias("id"))


def recover(states: DataFrame, open_states: tuple[str, ...] = X.JOB_OPEN) -> DataFrame:
    """States after a restart: what was open is interrupted; a message that is there stays."""
    open_ = F.col("status").isin(*open_states)
    message = X.if_blank(F.col("message"), X.INTERRUPTED_MESSAGE)
    return states.withColumn("message", F.when(open_, message).otherwise(F.col("message"))).withColumn("status", F.when(open_, "interrupted").otherwise(F.col("status")))


def first_occurrence(selection: DataFrame, key: list[str], position: str = "pos") -> DataFrame:
    """Each key once, where it first came up."""
    return selection.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(position))).where(F.col("_n") == 1).drop("_n")


class JobLog:
    """Runs jobs item by item and appends what happens to the store.

    Stopping is cooperative between items and interrupts the Spark work of the item that
    runs; items not reached are skipped and the job ends cancelled.  A running job is held
    by a lease: no other driver runs it too, or declares it interrupted, until that expires.
    Events are rows of the commit log, so recording one starts no Spark job.
    """

    def __init__(self, store: Store, lease_seconds: float = 60.0):
        self.store, self.spark = store, store.spark
        self.leases = Leases(store.spark, f"{store.path}/_leases", lease_seconds)
        self._lock, self._stop, self._seq = threading.Lock(), set(), time.time_ns()

    def _next(self) -> int:
        with self._lock:
            self._seq = max(self._seq + 1, time.time_ns())
            return self._seq

    def _event(self, job_id: int, event: str, item_id: int | None = None, message: str | None = None) -> dict:
        return {"job_id": job_id, "item_id": item_id, "seq": self._next(), "event": event, "message": message, "at": now()}

    def record(self, job_id: int, event: str, item_id: int | None = None, message: str | None = None) -> str:
        return self.store.commit(rows={"job_events": [self._event(job_id, event, item_id, message)]})

    def submit(self, job_type: str, items: Iterable[tuple[str, str]], config: dict | None = None, action: str | None = None) -> int:
        """Append a job and its items, queued; returns the job's id.

        The job itself comes with the last of its items: until then nobody sees it.
        """
        import json

        job_id = self._next()
        job = {"id": job_id, "job_type": job_type, "config_json": json.dumps(config or {}, ensure_ascii=False), "created_at": now()}
        parts = list(batched(items, ROWS_A_COMMIT)) or [()]
        for i, part in enumerate(parts):
            rows = [{"id": self._next(), "job_id": job_id, "schema_name": s, "table_name": t, "action": action or job_type} for s, t in part]
            commit = {"job_items": rows, "job_events": [self._event(job_id, "queued", r["id"]) for r in rows]}
            if i + 1 == len(parts):
                commit["jobs"] = [job]
                commit["job_events"] = commit["job_events"] + [self._event(job_id, "queued")]
            self.store.commit(rows={t: r for t, r in commit.items() if r})
        return job_id

    def items(self, job_id: int) -> list:
        return self.store.read("job_items").where(F.col("job_id") == job_id).orderBy("id").collect()

    def request_stop(self, job_id: int) -> None:
        """Stop an open job; a finished or unknown one is left alone."""
        if job_states(self.events(job_id)).where(F.col("status").isin(*X.JOB_OPEN)).isEmpty():
            return
        self._stop.add(job_id)
        self.record(job_id, "stopping")
        self.spark.interruptTag(f"job-{job_id}")

    def stopping(self, job_id: int, since: str = "") -> bool:
        """Was the job asked to stop, by this process or, through the log, by another one?

        The log's own rows answer, those after the commit ``since``; Spark is asked only where
        they were compacted meanwhile.
        """
        if job_id in self._stop:
            return True
        recent = self.store.recent("job_events", since)
        if recent is None:
            return not self.events(job_id).where(F.col("item_id").isNull() & (F.col("event") == "stopping")).isEmpty()
        return any(r["job_id"] == job_id and r["item_id"] is None and r["event"] == "stopping" for r in recent)

    def run(self, job_id: int, work: Callable[[SparkSession, str, str], object]) -> str:
        """Work through a job's items in this thread; one failure does not stop the rest.

        "taken" if another driver runs the job, "lost" if this one's lease ran out meanwhile:
        then another driver may have the job, and nothing more is recorded.
        """
        with self.leases.held(f"job-{job_id}") as lease:
            if lease is None:
                return "taken"
            self.spark.addTag(f"job-{job_id}")
            try:
                return self._run(job_id, work, lease)
            except Exception as error:  # a job's failure is its state
                self.record(job_id, "failed", message=str(error).splitlines()[0])
                return "failed"
            finally:
                self._stop.discard(job_id)
                self.spark.removeTag(f"job-{job_id}")

    def _run(self, job_id: int, work: Callable[[SparkSession, str, str], object], lease) -> str:
        finished = {r["item_id"] for r in item_states(self.events(job_id)).where(F.col("status").isin("done", "failed", "skipped")).select("item_id").collect()}
        since = self.record(job_id, "running")
        for item in self.items(job_id):
            if lease.lost:
                return "lost"
            if item["id"] in finished:  # before a restart
                continue
            if self.stopping(job_id, since):
                self.record(job_id, "skipped", item["id"], "Stopped by user")
                continue
            if not item["schema_name"] or not item["table_name"]:
                self.record(job_id, "failed", item["id"], "schema_name and table_name are required")
                continue
            self.record(job_id, "running", item["id"])
            try:
                work(self.spark, item["schema_name"], item["table_name"])
                event = ("done", item["id"])
            except Exception as error:  # an item's failure is its state
                event = ("failed", item["id"], str(error).splitlines()[0])
            if lease.lost:
                return "lost"
            self.record(job_id, *event)
        end = "cancelled" if self.stopping(job_id, since) else "done"
        self.record(job_id, end)
        if self.store.commits("job_events") > MOST_COMMITS:
            self.store.compact("job_events")
        return end

    def start(self, job_id: int, work: Callable[[SparkSession, str, str], object]) -> threading.Thread:
        from pyspark import InheritableThread

        thread = InheritableThread(target=self.run, args=(job_id, work), daemon=True)
        thread.start()
        return thread

    def events(self, job_id: int | None = None) -> DataFrame:
        found = self.store.read("job_events")
        return found if job_id is None else found.where(F.col("job_id") == job_id)

    def states(self) -> DataFrame:
        jobs = self.store.read("jobs").select(F.col("id").alias("job_id"), "job_type", "config_json")
        return jobs.join(job_states(self.events()), "job_id").join(progress(item_states(self.events())), "job_id", "left")

    def recover(self) -> list[int]:
        """After a restart: open jobs and items become interrupted; returns the jobs' ids.

        A job that another driver holds is running, not lost, and stays as it is; of several
        drivers that recover at once one interrupts a job.
        """
        open_ = job_states(self.events()).where(F.col("status").isin(*X.JOB_OPEN)).select("job_id", "message").collect()
        found = []
        for job in open_:
            with self.leases.held(f"job-{job['job_id']}") as lease:
                if lease is None:
                    continue
                own = self.events(job["job_id"])
                if job_states(own).where(F.col("status").isin(*X.JOB_OPEN)).isEmpty():
                    continue
                items = item_states(own).where(F.col("status").isin(*X.ITEM_OPEN)).select("item_id", "message").collect()
                rows = [self._event(job["job_id"], "interrupted", i["item_id"], i["message"] or X.INTERRUPTED_ITEM_MESSAGE) for i in items]
                rows.append(self._event(job["job_id"], "interrupted", None, job["message"] or X.INTERRUPTED_MESSAGE))
                self.store.commit(rows={"job_events": rows})
                found.append(job["job_id"])
        return sorted(found)
