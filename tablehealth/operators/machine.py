"""State machines over event logs: an ordered fold in which guarded transitions may be refused."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The state before the first event.
START = ""


@dataclass(frozen=True)
class Machine:
    """``moves`` says for each event which state it leads to and from which states it may; none: from any."""

    moves: dict[str, tuple[str, tuple[str, ...] | None]]

    @property
    def states(self) -> list[str]:
        return [START, *dict.fromkeys(target for target, _ in self.moves.values())]

    def allows(self, event: str, state: str) -> bool:
        sources = self.moves[event][1]
        return sources is None or state in sources

    def targets(self) -> Column:
        """Event to the number of the state it leads to, from each state in order; -1 where it is refused."""
        states = self.states
        pairs = [(F.lit(e), F.array(*[F.lit(states.index(self.moves[e][0]) if self.allows(e, s) else -1) for s in states])) for e in self.moves]
        return F.create_map(*[x for pair in pairs for x in pair])


# Fixed guards: a cancelled job is not done, only waiting or running jobs are asked to stop, only open ones are interrupted.
JOB = Machine({
    "queued": ("queued", None),
    "running": ("running", None),
    "stopping": ("stopping", ("queued", "running")),
    "cancelled": ("cancelled", None),
    "failed": ("failed", None),
    "done": ("done", (START, "queued", "running", "stopping", "failed", "interrupted", "done")),
    "interrupted": ("interrupted", ("queued", "running", "stopping")),
})
ITEM = Machine({
    "queued": ("queued", None),
    "running": ("running", None),
    "skipped": ("skipped", None),
    "failed": ("failed", None),
    "done": ("done", None),
    "interrupted": ("interrupted", ("queued", "running")),
})


def fold(events: DataFrame, machine: Machine, key: list[str], order: list[str], keep: tuple[str, ...] = (), chunk: Column | None = None, times: dict[str, tuple[Callable, str, str]] | None = None) -> DataFrame:
    """``key``, status, rejected and ``keep``: the state after all events of a key in ``order``.

    ``events`` has a column ``event``; events the machine does not know, or refuses in the
    state that holds, change nothing and are counted in ``rejected``.  ``keep`` are columns
    of the last event that was accepted; ``times`` adds an aggregate of a column over one
    kind of event, as name: (function, event, column).

    A long log is cut by ``chunk``, which must rise with ``order``: each chunk is folded by
    itself from every state the machine has, and these tables are then chained, so no task
    ever holds more of a key than one chunk and a row for each chunk.
    """
    states, targets, times = machine.states, machine.targets(), times or {}
    own = [F.col(c) for c in keep] or [F.lit(0).alias("_none")]
    entry = F.struct(*order, F.col("event"), F.struct(*own).alias("kept"))
    measured = [way(F.when(F.col("event") == event, F.col(column))).alias(name) for name, (way, event, column) in times.items()]
    logs = events.groupBy(*key, (F.lit(0) if chunk is None else chunk).alias("_chunk")).agg(F.array_sort(F.collect_list(entry)).alias("_log"), *measured)

    kept = logs.schema["_log"].dataType.elementType["kept"].dataType
    nothing = F.lit(None).cast(kept)
    zero = F.array(*[F.struct(F.lit(i).alias("state"), F.lit(0).cast("long").alias("rejected"), nothing.alias("kept")) for i in range(len(states))])

    def step(table: Column, event: Column) -> Column:
        row = F.try_element_at(targets, event["event"])

        def move(a: Column) -> Column:
            target = F.coalesce(F.get(row, a["state"]), F.lit(-1))
            return F.struct(
                F.when(target < 0, a["state"]).otherwise(target).alias("state"),
                (a["rejected"] + F.when(target < 0, 1).otherwise(0)).alias("rejected"),
                F.when(target < 0, a["kept"]).otherwise(event["kept"]).alias("kept"),
            )

        return F.transform(table, move)

    tables = logs.select(*key, "_chunk", F.aggregate("_log", zero, step).alias("_table"), *times)
    # the merged value needs its start as a struct of the same shape
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("rejected"), nothing.alias("kept"))

    def chain(a: Column, c: Column) -> Column:
        t = F.get(c["_table"], a["state"])
        return F.struct(t["state"].alias("state"), (a["rejected"] + t["rejected"]).alias("rejected"), F.coalesce(t["kept"], a["kept"]).alias("kept"))

    whole = tables.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_chunk", "_table"))).alias("_tables"), *[times[n][0](F.col(n)).alias(n) for n in times])
    final = whole.withColumn("_end", F.aggregate("_tables", start, chain))
    names = F.array(*[F.lit(s) for s in states])
    return final.select(*key, F.get(names, F.col("_end.state")).alias("status"), F.col("_end.rejected").alias("rejected"), *[F.col(f"_end.kept.{c}").alias(c) for c in keep], *times)
