"""Audit columns of versions, as window expressions over one key's timeline."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


def timeline(keys: list[str], updated_at: str) -> WindowSpec:
    """A key's versions in order of time; a null time counts as the latest. All audit columns share this
    window, so one exchange and one sort serve them all."""
    return Window.partitionBy(*(F.col(k) for k in keys)).orderBy(F.col(updated_at).asc_nulls_last())


def is_current(w: WindowSpec) -> Column:
    """The last version has no successor."""
    return F.lead(F.lit(1)).over(w).isNull()


def valid_from(w: WindowSpec, updated_at: Column, created_at: Column | None = None, deleted_at: Column | None = None) -> Column:
    """A key's first version is valid from its deletion or creation, where these are known; others from
    their own time."""
    first = F.coalesce(*(c for c in (deleted_at, created_at, updated_at) if c is not None))
    return F.when(F.lag(updated_at).over(w).isNull(), first).otherwise(updated_at)


def valid_to(w: WindowSpec, updated_at: Column, default: Column) -> Column:
    return F.coalesce(F.lead(updated_at).over(w), default)


def change_type(w: WindowSpec, deleted_at: Column | None = None) -> Column:
    """``D`` for a deleted version, ``I`` for the first one and one that follows a deletion, else ``U``."""
    first = F.lag(F.lit(1)).over(w).isNull()
    if deleted_at is None:
        return F.when(first, "I").otherwise("U")
    return F.when(deleted_at.isNotNull(), "D").when(first, "I").when(F.lag(deleted_at).over(w).isNotNull(), "I").otherwise("U")


def timestamp_literal(value: str, kind: T.DataType | None = None) -> Column:
    """A point in time in the session's zone, or of type ``kind``."""
    return F.lit(value).cast(kind or T.TimestampType())


def comparable(column: Column, kind: T.DataType) -> Column:
    """A form of ``column`` that can be compared and sorted: maps become sorted entries."""
    if isinstance(kind, T.MapType):
        return F.array_sort(F.map_entries(column))
    return column
