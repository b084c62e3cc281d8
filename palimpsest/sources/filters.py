"""Sources that read what a target has not seen."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ConfigError


def source(df: DataFrame, loaded_at: str | None = None, target: DataFrame | None = None, target_loaded_at: str = "_loaded_at", run_started_at: datetime | None = None, default_valid_from: str = "1900-01-01 00:00:00") -> DataFrame:
    """``df``, or with ``loaded_at`` its rows that are new.

    ``target`` (given in incremental runs): rows loaded after the latest ``target_loaded_at`` in it, or after
    ``default_valid_from`` where it has none. ``run_started_at``: rows loaded up to then, in whole seconds.
    A null ``loaded_at`` meets neither condition. The watermark is one value, read before planning, so that
    both conditions reach the scan.
    """
    if loaded_at is None:
        return df
    kind = df.schema[loaded_at].dataType
    if target is not None:
        if target_loaded_at.upper() not in {c.upper() for c in target.columns}:
            raise ConfigError(f"the target has no column '{target_loaded_at}' to take a watermark from. Available columns: {', '.join(target.columns)}")
        mark = target.agg(F.max(F.col(target_loaded_at).cast(kind)).cast("string")).first()[0]
        df = df.where(F.col(loaded_at) > F.lit(mark or default_valid_from).cast(kind))
    if run_started_at is not None:
        df = df.where(F.col(loaded_at) <= F.lit(run_started_at.replace(microsecond=0).strftime("%Y-%m-%d %H:%M:%S")).cast(kind))
    return df


def seed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV file with a header, read with declared types; empty cells are null."""
    return spark.read.schema(schema).csv(path, header=True)
