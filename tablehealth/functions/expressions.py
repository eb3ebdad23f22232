"""Column expressions: severity, classification, parsing, quoting, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status vocabularies and their orders.
SEVERITY = ("CRITICAL", "WARNING", "OK", "EMPTY", "FAILED")
SUMMARY_STATUSES = ("OK", "WARNING", "CRITICAL", "EMPTY", "FAILED", "INTERRUPTED")
JOB_OPEN = ("queued", "running", "stopping")
ITEM_OPEN = ("queued", "running")
FINAL = ("done", "failed", "cancelled", "interrupted", "skipped")
INTERRUPTED_MESSAGE = "Application restarted while job was running"
INTERRUPTED_ITEM_MESSAGE = "Application restarted while item was running"
STORAGE = {"heap": "HEAP", "ao_row": "AO", "ao_column": "AOCO"}
UNIQUE_TYPES = ("int2", "int4", "int8", "numeric", "float4", "float8", "text", "varchar", "bpchar", "date", "timestamp", "timestamptz", "uuid")
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema", "gp_toolkit", "pg_toast")
TEMPORARY_SCHEMAS = ("pg_temp_%", "pg_toast_temp_%")


def severity_rank(status: Column) -> Column:
    """1 for the most severe status; statuses outside the vocabulary come last."""
    rank = F.when(status == SEVERITY[0], 1)
    for i, name in enumerate(SEVERITY[1:], 2):
        rank = rank.when(status == name, i)
    return rank.otherwise(len(SEVERITY) + 1)


def qualified(schema: Column, table: Column) -> Column:
    return F.concat_ws(".", schema, table)


def relkind_label(relkind: Column) -> Column:
    """How a kind of relation is shown."""
    return F.when(relkind == "p", "partitioned").otherwise("table")


def mask_secret(secret: Column) -> Column:
    return F.when(F.coalesce(secret, F.lit("")) == "", "").otherwise("********")


def if_blank(message: Column, text: str) -> Column:
    """The message, or ``text`` where there is none."""
    return F.when(F.coalesce(message, F.lit("")) == "", text).otherwise(message)


def percent(part: Column, whole: Column) -> Column:
    """Two decimals; 0 of nothing is 0."""
    return F.when(whole > 0, F.round(part * F.lit(100.0) / whole, 2)).otherwise(0.0)


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds with two decimals; null where either end is missing.

    Times without a zone are taken as they are: no hour comes or goes where clocks change.
    """
    apart = end - start
    parts = [F.extract(F.lit(unit), apart) * seconds for unit, seconds in (("DAY", 86_400), ("HOUR", 3600), ("MINUTE", 60))]
    return F.round((sum(parts, F.extract(F.lit("SECOND"), apart))).cast("double"), 2)


def storage_class(access_method: Column) -> Column:
    """HEAP when unknown to the catalog, the upper-cased name when unknown to us."""
    known = F.when(access_method.isNull(), "HEAP")
    for name, label in STORAGE.items():
        known = known.when(F.lower(access_method) == name, label)
    return known.otherwise(F.upper(access_method))


def distribution_type(policy: Column, columns: Column) -> Column:
    return F.when(policy == "r", "REPLICATED").when(F.coalesce(F.size(columns), F.lit(0)) > 0, "HASH").otherwise("RANDOM")


def parse_distribution_key(text: Column, spaces: bool = False) -> Column:
    """Attribute numbers out of ``{1,2}`` or ``7``; anything else is no key.

    Elements in braces that are not numbers are passed over.  ``spaces`` also accepts the
    ``1 2`` form.
    """
    inner = F.trim(text)
    braced = inner.rlike(r"^\{.*\}$")
    split = F.split(F.regexp_replace(inner, r"[{}]", ""), r"[,\s]+" if spaces else ",")
    numbers = F.filter(F.transform(split, lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())
    plain = inner.rlike(r"^[0-9]+([\s]+[0-9]+)*$" if spaces else r"^[0-9]+$")
    return F.when(braced | plain, numbers).otherwise(F.array().cast("array<int>"))


def quoted(name: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(name, '"', '""'), F.lit('"'))


def distribution_preview(schema: Column, table: Column, kind: Column, columns: Column) -> Column:
    """The statement that would change a table's distribution, identifiers quoted."""
    head = F.concat(F.lit("ALTER TABLE "), quoted(schema), F.lit("."), quoted(table), F.lit(" SET WITH (REORGANIZE=true) "))
    by = F.concat(F.lit("DISTRIBUTED BY ("), F.array_join(F.transform(columns, quoted), ", "), F.lit(");"))
    return F.concat(head, F.when(kind == "HASH", by).otherwise(F.lit("DISTRIBUTED RANDOMLY;")))


def tri_state(checked: Column) -> Column:
    """none, all or some of a group (an aggregate over a 0/1 or boolean column)."""
    hits = F.sum(checked.cast("int"))
    return F.when(hits == 0, "none").when(hits == F.count(F.lit(1)), "all").otherwise("some")
