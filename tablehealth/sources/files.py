"""Small files that drivers share: exclusive creation, listings, and claims that expire.

Everything goes through Hadoop's file interfaces, so it works wherever Spark's tables lie.
"""

from __future__ import annotations

import atexit
import contextlib
import json
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors see: under ``spark.checkpoint.dir``, or else in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}"


@contextlib.contextmanager
def staging(spark: SparkSession, name: str):
    """A function that writes a frame to the shared folder and reads it back; all of it goes at the end.

    Lineage ends there, and a lost executor costs no more than its own tasks.
    """
    files = Files(spark, shared_path(spark, f"{name}-{uuid.uuid4().hex[:12]}"))
    numbers = iter(range(1 << 30))

    def stage(df: DataFrame) -> DataFrame:
        path = f"{files.path}/{next(numbers)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield stage
    finally:
        files.delete("")


def keep(df: DataFrame) -> DataFrame:
    """A staged copy that outlives its function; it goes when Python's session ends."""
    spark = df.sparkSession
    files = Files(spark, shared_path(spark, f"kept-{uuid.uuid4().hex[:12]}"))
    df.write.parquet(files.path)
    _KEPT.append(files)
    if len(_KEPT) == 1:
        atexit.register(_forget)
    return spark.read.schema(df.schema).parquet(files.path)


_KEPT: list[Files] = []


def _forget() -> None:
    while _KEPT:
        with contextlib.suppress(Exception):  # the session may be gone already
            _KEPT.pop().delete("")


class Files:
    """Files under one folder, by their names within it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def create(self, name: str, content: dict) -> bool:
        """Write a whole file under a name that nobody has taken; False if somebody has.

        The content is complete before the name appears, and of several that try at once one
        succeeds, as far as the file system's own rename refuses names that are taken (HDFS
        does in one step; a local disk looks first, for tests and single drivers).
        """
        hidden, target = self._at(f"_tmp/{uuid.uuid4().hex}"), self._at(name)
        out = self._fs.create(hidden, True)
        try:
            out.write(json.dumps(content, ensure_ascii=False).encode())
        finally:
            out.close()
        self._fs.mkdirs(target.getParent())
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(hidden, target, options)
            return True
        except Exception as error:
            self._fs.delete(hidden, False)
            if "already exist" in str(error):
                return False
            raise

    def read(self, name: str) -> dict | None:
        """The content, none if the file is not there."""
        try:
            stream = self._fs.open(self._at(name))
        except Exception as error:
            if "FileNotFound" in str(error) or "does not exist" in str(error):
                return None
            raise
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def names(self, folder: str = "") -> list[str]:
        """Names in a folder, in order; none if it is not there."""
        where = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def size(self, folder: str) -> tuple[int, int]:
        """Bytes and number of the data files under a folder, from its listing alone."""
        where, total, count = self._at(folder), 0, 0
        if self._fs.exists(where):
            found = self._fs.listFiles(where, True)
            while found.hasNext():
                status = found.next()
                if not status.getPath().getName().startswith(("_", ".")):
                    total, count = total + status.getLen(), count + 1
        return total, count

    def modified(self, name: str) -> int:
        """When a file or folder was last changed, in nanoseconds."""
        return self._fs.getFileStatus(self._at(name)).getModificationTime() * 1_000_000

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class _Held:
    lost, until = False, 0.0


class Leases:
    """Claims on names that expire, so that what a lost driver held is free again.

    Every claim, renewal and release is a new numbered file, made exclusively; the highest
    number counts.  Drivers' clocks may differ by much less than a lease lasts.
    """

    def __init__(self, spark: SparkSession, path: str, seconds: float = 60.0):
        self.files, self.seconds, self.owner = Files(spark, path), seconds, uuid.uuid4().hex

    def _last(self, name: str) -> tuple[int, dict]:
        numbers = [int(n) for n in self.files.names(name)]
        if not numbers:
            return 0, {}
        return max(numbers), self.files.read(f"{name}/{max(numbers):012d}") or {}

    def holder(self, name: str) -> str | None:
        """Who holds a name now."""
        last = self._last(name)[1]
        return last["owner"] if last.get("until", 0) > time.time() else None

    def claim(self, name: str) -> bool:
        """Take or renew a name; False while somebody else holds it."""
        number, last = self._last(name)
        if last.get("until", 0) > time.time() and last["owner"] != self.owner:
            return False
        return self._next(name, number, time.time() + self.seconds)

    @contextlib.contextmanager
    def held(self, name: str):
        """Hold a name and renew the claim until the end; gives none if somebody else has it.

        What it gives has ``lost`` set once a renewal failed: somebody else may hold the name.
        """
        if not self.claim(name):
            yield None
            return
        held, over = _Held(), threading.Event()

        def renew() -> None:
            while not over.wait(self.seconds / 3):
                try:
                    held.lost = not self.claim(name)
                except Exception:  # the file system may come back before the claim ends
                    held.lost = time.time() > held.until
                if held.lost:
                    return
                held.until = time.time() + self.seconds

        held.until = time.time() + self.seconds
        thread = threading.Thread(target=renew, daemon=True)
        thread.start()
        try:
            yield held
        finally:
            over.set()
            thread.join()
            if not held.lost:
                self.release(name)

    def release(self, name: str) -> None:
        number, last = self._last(name)
        if last.get("owner") == self.owner:
            self._next(name, number, 0)

    def _next(self, name: str, number: int, until: float) -> bool:
        made = self.files.create(f"{name}/{number + 1:012d}", {"owner": self.owner, "until": until})
        if made and number > 1:
            self.files.delete(f"{name}/{number - 1:012d}")
        return made
