"""A slowly changing dimension as a table: plan, write, hooks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import ScdConfig
from .plans.planner import ScdPlan, plan
from .sources.filters import source
from .sources.store import VersionedTable, bucket_of


class ScdTable:
    """The dimension at ``path`` under ``config``.

    Rows are dealt to ``buckets`` by the business key: a merge reads and writes those alone that its batch has keys of. ``sql_header``:
    statements (settings, functions) that are run in the session before each load is planned.
    ``post_hooks`` are called with the table after each successful write; ``comments`` are stored as column
    comments with the data.
    """

    def __init__(self, spark: SparkSession, path: str, config: ScdConfig, post_hooks: Sequence[Callable[["ScdTable"], None]] = (), contract: T.StructType | None = None, comments: dict[str, str] | None = None, buckets: int = 32, sql_header: Sequence[str] = ()):
        self.spark, self.config, self.post_hooks, self.contract, self.comments = spark, config, list(post_hooks), contract, comments or {}
        self.buckets, self.sql_header = buckets, [sql_header] if isinstance(sql_header, str) else list(sql_header)
        self.store = VersionedTable(spark, path)

    @classmethod
    def incremental_scd2(cls, spark: SparkSession, path: str, config: Mapping[str, Any], variables: Mapping[str, Any] | None = None, **more) -> "ScdTable":
        """A type-2 table from plain settings, whatever type these name."""
        return cls(spark, path, ScdConfig.resolve(config, variables, scd_type=2), **more)

    def exists(self) -> bool:
        return self.store.exists()

    def source(self, df: DataFrame, loaded_at: str | None = None, target_loaded_at: str = "_loaded_at", run_started_at: datetime | None = None, full_refresh: bool = False) -> DataFrame:
        """What the next run has to read of ``df``: in a merge, rows loaded after what the table holds; with
        ``exclude_data_after_run_start``, none loaded after ``run_started_at`` (by default now)."""
        until = (run_started_at or datetime.now()) if self.config.exclude_data_after_run_start else None
        target = self.store.read() if loaded_at is not None and self.is_incremental(full_refresh) else None
        return source(df, loaded_at, target, target_loaded_at, until, self.config.default_valid_from)

    def is_incremental(self, full_refresh: bool = False) -> bool:
        """Whether the next run merges into what is there."""
        return self.exists() and not full_refresh

    def is_incremental_scd2(self, full_refresh: bool = False) -> bool:
        return self.config.scd_type == 2 and self.is_incremental(full_refresh)

    def read(self, version: int | None = None) -> DataFrame:
        return self.store.read(version)

    def touched(self, batch: DataFrame) -> list[int] | None:
        """The buckets that ``batch`` has keys of; None where all have to be written (the table is dealt out otherwise)."""
        found = self.store.manifest()
        if (found["buckets"], [k.upper() for k in found["keys"]]) != (self.buckets, [k.upper() for k in self.config.unique_key]):
            return None
        stored = T.StructType.fromJson(found["schema"])
        kinds = {f.name.upper(): f.dataType for f in stored.fields}
        keys = batch.select(*(F.col(k).cast(kinds[k.upper()]).alias(k) for k in self.config.unique_key))
        return sorted(r[0] for r in keys.select(bucket_of(self.config.unique_key, keys.schema, self.buckets)).distinct().collect())

    def plan(self, batch: DataFrame, full_refresh: bool = False, buckets: list[int] | None = None) -> ScdPlan:
        return plan(batch, self.config, self.store.read(buckets=buckets) if self.is_incremental(full_refresh) else None, full_refresh, self.contract)

    def apply(self, batch: DataFrame, full_refresh: bool = False) -> DataFrame:
        """Load ``batch`` and return the table. The batch is computed once: a merge reads it several times, and it may
        hold the time of the run."""
        for statement in self.sql_header:
            self.spark.sql(statement)
        after = self.store.version()
        batch = batch.persist()
        try:
            self.config.check_columns(batch.schema)
            only = self.touched(batch) if self.is_incremental(full_refresh) else None
            result = _commented(self.plan(batch, full_refresh, only).result, self.comments)
            self.store.write(result, after, self.config.unique_key, self.buckets, only)
        finally:
            batch.unpersist()
        for hook in self.post_hooks:
            hook(self)
        return self.read()


def _commented(df: DataFrame, comments: dict[str, str]) -> DataFrame:
    for name, text in comments.items():
        if name in df.columns:
            df = df.withMetadata(name, df.schema[name].metadata | {"comment": text})
    return df
