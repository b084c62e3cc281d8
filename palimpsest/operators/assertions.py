"""Data-quality assertions: each returns the rows that break a rule; none means that it holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VALID_FROM, VALID_TO, IS_CURRENT, CHANGE_TYPE = "_valid_from", "_valid_to", "_is_current", "_change_type"


def holds(violations: DataFrame) -> bool:
    return violations.isEmpty()


def _by(keys: Sequence[str], valid_from: str, latest_first: bool = False):
    order = F.col(valid_from).desc_nulls_first() if latest_first else F.col(valid_from).asc_nulls_last()
    return Window.partitionBy(*keys).orderBy(order)


def _true(column: str) -> Column:
    return F.col(column) == F.lit(True)


def one_current_per_key(df: DataFrame, keys: Sequence[str], current: str = IS_CURRENT) -> DataFrame:
    """Keys with several current rows; one without any is not seen (see ``some_current_per_key``)."""
    return df.where(_true(current)).groupBy(*keys).agg(F.count("*").alias("current_count")).where("current_count <> 1")


def some_current_per_key(df: DataFrame, keys: Sequence[str], current: str = IS_CURRENT) -> DataFrame:
    """Keys whose current rows are not exactly one, none included."""
    return df.groupBy(*keys).agg(F.count_if(_true(current)).alias("current_count")).where("current_count <> 1")


def no_validity_overlaps(df: DataFrame, keys: Sequence[str], valid_from: str = VALID_FROM, valid_to: str = VALID_TO) -> DataFrame:
    """Pairs of rows of a key that are valid at the same time, each from both sides. Null keys, and rows
    that begin together, are not compared.

    One pass over each key finds its islands: runs of rows of which each begins before an earlier one ends. Only rows of an island can overlap, so a sound
    history gives no pairs to compare, however long it is."""
    by_time = Window.partitionBy(*keys).orderBy(F.col(valid_from).asc_nulls_last(), F.col(valid_to).asc_nulls_last())
    end = F.max(valid_to).over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.select(*keys, valid_from, valid_to).withColumn("__new", (~F.coalesce(F.col(valid_from) < end, F.lit(False))).cast("long"))
    rows = rows.withColumn("__island", F.sum("__new").over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("__size", F.count("*").over(Window.partitionBy(*keys, "__island"))).where("__size > 1")
    a = rows.select(*keys, "__island", F.col(valid_from).alias("valid_from_1"), F.col(valid_to).alias("valid_to_1"))
    b = rows.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__island").alias("__other"), F.col(valid_from).alias("valid_from_2"), F.col(valid_to).alias("valid_to_2"))
    on = (F.col("__island") == F.col("__other")) & (F.col("valid_from_1") < F.col("valid_to_2")) & (F.col("valid_from_2") < F.col("valid_to_1")) & (F.col("valid_from_1") != F.col("valid_from_2"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return a.join(b, on).drop("__island", "__other", *(f"__{k}" for k in keys))


def has_validity_overlap(df: DataFrame, keys: Sequence[str], valid_from: str = VALID_FROM, valid_to: str = VALID_TO) -> DataFrame:
    """Rows that begin before an earlier row of their key ends: one pass over each key, no pairs."""
    earlier = _by(keys, valid_from).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__end", F.max(valid_to).over(earlier)).where(F.col(valid_from) < F.col("__end")).drop("__end")


def continuous_validity_windows(df: DataFrame, keys: Sequence[str], valid_from: str = VALID_FROM, valid_to: str = VALID_TO) -> DataFrame:
    """Rows that do not end where the next row of the key begins; a null end is not seen."""
    out = df.select(*keys, valid_from, valid_to, F.lead(valid_from).over(_by(keys, valid_from)).alias("next_valid_from"))
    return out.where(F.col("next_valid_from").isNotNull() & (F.col(valid_to) != F.col("next_valid_from")))


def latest_row_is_current(df: DataFrame, keys: Sequence[str], valid_from: str = VALID_FROM, current: str = IS_CURRENT) -> DataFrame:
    """Latest rows of keys that are not current; a null flag passes."""
    out = df.select(*keys, valid_from, current, F.row_number().over(_by(keys, valid_from, latest_first=True)).alias("__k"))
    return out.where((F.col("__k") == 1) & (F.col(current) != F.lit(True))).drop("__k")


def first_record_not_update(df: DataFrame, keys: Sequence[str], valid_from: str = VALID_FROM, change_type: str = CHANGE_TYPE) -> DataFrame:
    """First rows of keys that are updates."""
    out = df.select(*keys, valid_from, change_type, F.row_number().over(_by(keys, valid_from)).alias("__k"))
    return out.where((F.col("__k") == 1) & (F.col(change_type) == "U")).drop("__k")


def _with_previous(df: DataFrame, keys: Sequence[str], change_type: str, valid_from: str) -> DataFrame:
    return df.select(*keys, valid_from, change_type, F.lag(change_type).over(_by(keys, valid_from)).alias("previous_change_type"))


def insert_follows_delete(df: DataFrame, keys: Sequence[str], change_type: str = CHANGE_TYPE, valid_from: str = VALID_FROM) -> DataFrame:
    """Rows after a deletion that are neither an insert nor a deletion; a null type passes."""
    out = _with_previous(df, keys, change_type, valid_from)
    return out.where((F.col("previous_change_type") == "D") & ~F.col(change_type).isin("I", "D"))


def no_consecutive_inserts_or_deletes(df: DataFrame, keys: Sequence[str], change_type: str = CHANGE_TYPE, valid_from: str = VALID_FROM) -> DataFrame:
    """An insert after an insert, an update after a deletion, with the reason; repeated deletions are fine."""
    out = _with_previous(df, keys, change_type, valid_from)
    before, now = F.col("previous_change_type"), F.col(change_type)
    reason = F.when((before == "I") & (now == "I"), "insert follows insert").when((before == "D") & (now == "U"), "update follows delete")
    return out.withColumn("violation_reason", reason).where("violation_reason is not null")


def no_records_after_deletion(df: DataFrame, keys: Sequence[str], deleted_at: str, valid_from: str = VALID_FROM, valid_to: str = VALID_TO) -> DataFrame:
    """Deleted rows that are not valid from their deletion on."""
    return df.select(*keys, deleted_at, valid_from, valid_to).where(F.col(deleted_at).isNotNull() & (F.col(valid_from) != F.col(deleted_at)))


def all_records_current(df: DataFrame, current: str = IS_CURRENT) -> DataFrame:
    """Rows that are not current, or whose flag is null."""
    return df.where(F.col(current).isNull() | (F.col(current) != F.lit(True)))


def valid_window_well_formed(df: DataFrame, valid_from: str = VALID_FROM, valid_to: str = VALID_TO) -> DataFrame:
    """Rows with a null bound, or that end no later than they begin."""
    return df.where(F.col(valid_from).isNull() | F.col(valid_to).isNull() | (F.col(valid_from) >= F.col(valid_to)))


def matches_expected(actual: DataFrame, expected: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that only one side has, with ``_problem`` telling which; how often a row occurs doesn't count."""
    a, e = actual.select(*columns), expected.select(*columns)
    extra = a.subtract(e).withColumn("_problem", F.lit("unexpected"))
    return extra.unionByName(e.subtract(a).withColumn("_problem", F.lit("missing")))


def born_deleted(df: DataFrame, key: str, values: Sequence, deleted_at: str = "deleted_at", valid_from: str = VALID_FROM, current: str = IS_CURRENT, change_type: str = CHANGE_TYPE) -> DataFrame:
    """Rows of keys that came deleted, which are not a current deletion valid from when it was made."""
    right = (F.col(change_type) == "D") & (F.col(valid_from) == F.col(deleted_at)) & _true(current)
    return df.where(F.col(key).isin(list(values)) & ~F.coalesce(right, F.lit(False)))


def unique(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once; nulls do not count."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n_records")).where("n_records > 1")


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())
