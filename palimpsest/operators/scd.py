"""The types as functions: a batch, and a target for incremental runs, give the new target.

Rows of keys that a batch does not touch only pass through. All type-2 windows partition by the business
key or more, so one exchange on the key serves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..config import ConfigError, ScdConfig
from ..functions import audit

_PRIORITY, _STORED, _CHANGED, _RUN, _RANK = "__priority", "__stored", "__changed", "__run", "__rank"


def _kind(df: DataFrame, name: str) -> T.DataType:
    return next(f.dataType for f in df.schema.fields if f.name.upper() == name.upper())


def _audit_kind(df: DataFrame, cfg: ScdConfig) -> T.DataType:
    own = _kind(df, cfg.updated_at_column)
    return own if cfg.audit_timestamp == "match_source" and isinstance(own, (T.TimestampType, T.TimestampNTZType)) else T.TimestampType()


def _business(df: DataFrame, cfg: ScdConfig) -> DataFrame:
    """``df`` without columns that are named like audit columns."""
    cfg.check_columns(df.schema)
    return df.select(*cfg.business_columns(df.columns))


def _like_target(batch: DataFrame, target: DataFrame, cfg: ScdConfig) -> DataFrame:
    """The batch with the target's business columns and types; what the batch lacks is null."""
    names = {n.upper(): n for n in batch.columns}
    columns = cfg.business_columns(target.columns)
    if extra := [n for n in batch.columns if n.upper() not in {c.upper() for c in columns}]:
        raise ConfigError(f"the batch has columns that the target lacks: {', '.join(extra)}")
    return batch.select(*(F.col(names[c.upper()]).cast(_kind(target, c)).alias(c) if c.upper() in names else F.lit(None).cast(_kind(target, c)).alias(c) for c in columns))


def _total_order(df: DataFrame, but: list[str]) -> list[Column]:
    """All other columns, so that the pick among rows of one version does not depend on chance."""
    skip = {b.upper() for b in but}
    return [audit.comparable(F.col(f.name), f.dataType).asc_nulls_last() for f in df.schema.fields if f.name.upper() not in skip and not f.name.startswith("__")]


def _first_by(df: DataFrame, partition: list[Column], order: list[Column]) -> DataFrame:
    return df.withColumn(_RANK, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col(_RANK) == 1).drop(_RANK)


def _same_keys(a: str, b: str, keys: list[str], null_safe: bool) -> Column:
    found = F.lit(True)
    for k in keys:
        left, right = F.col(f"{a}.{k}"), F.col(f"{b}.{k}")
        found = found & (left.eqNullSafe(right) if null_safe else left == right)
    return found


def _match(cfg: ScdConfig, columns: list[str], null_safe: bool) -> Column:
    """When a stored row and a computed one are the same; ``incremental_predicates`` see them by alias."""
    found = _same_keys(cfg.destination_alias, cfg.source_alias, columns, null_safe)
    for predicate in cfg.incremental_predicates:
        found = found & F.expr(predicate)
    return found


def _tracked(df: DataFrame, cfg: ScdConfig) -> Column:
    return F.struct(*(audit.comparable(F.col(c), _kind(df, c)).alias(f"c{i}") for i, c in enumerate(cfg.tracked_columns([c for c in df.columns if not c.startswith("__")]))))


def _optional(name: str | None) -> Column | None:
    return F.col(name) if name else None


# Types 0 and 1


def _constants(df: DataFrame, cfg: ScdConfig) -> DataFrame:
    kind = _audit_kind(df, cfg)
    start = F.coalesce(*(F.col(c) for c in (cfg.created_at_column, cfg.updated_at_column) if c)).cast(kind)
    return df.withColumns({cfg.is_current_column: F.lit(True), cfg.valid_from_column: start, cfg.valid_to_column: audit.timestamp_literal(cfg.default_valid_to, kind), cfg.change_type_column: F.lit("I")})


def _one_per_key(df: DataFrame, cfg: ScdConfig, latest: bool) -> DataFrame:
    time = F.col(cfg.updated_at_column)
    order = time.desc_nulls_first() if latest else time.asc_nulls_last()
    return _first_by(df, [F.col(k) for k in cfg.unique_key], [order, *_total_order(df, [*cfg.unique_key, cfg.updated_at_column])])


def initial_scd0(batch: DataFrame, cfg: ScdConfig) -> DataFrame:
    """The earliest row of each key."""
    return _constants(_one_per_key(_business(batch, cfg), cfg, latest=False), cfg)


def incremental_scd0(target: DataFrame, batch: DataFrame, cfg: ScdConfig) -> DataFrame:
    """``target`` and the earliest row of each key that it lacks; null keys match only with
    ``null_safe_keys``."""
    new = _one_per_key(_like_target(_business(batch, cfg), target, cfg), cfg, latest=False)
    missing = new.alias(cfg.source_alias).join(target.alias(cfg.destination_alias), _match(cfg, cfg.unique_key, cfg.null_safe_keys), "left_anti")
    return target.unionByName(_constants(missing, cfg).select(*target.columns))


def initial_scd1(batch: DataFrame, cfg: ScdConfig) -> DataFrame:
    """The latest row of each key."""
    return _constants(_one_per_key(_business(batch, cfg), cfg, latest=True), cfg)


def incremental_scd1(target: DataFrame, batch: DataFrame, cfg: ScdConfig) -> DataFrame:
    """``target`` with the business columns of each key's latest row in ``batch`` (also where that is older
    than what is stored), and keys that it lacks. Audit columns of stored rows stay."""
    new = _constants(_one_per_key(_like_target(_business(batch, cfg), target, cfg), cfg, latest=True), cfg)
    t, n = target.withColumn("__in_target", F.lit(True)).alias(cfg.destination_alias), new.withColumn("__in_batch", F.lit(True)).alias(cfg.source_alias)
    keys, audits = {k.upper() for k in cfg.unique_key}, {a.upper() for a in cfg.audit_columns}
    both = t.join(n, _match(cfg, cfg.unique_key, cfg.null_safe_keys), "full_outer")

    def pick(name: str) -> Column:
        stored, fresh = F.col(f"{cfg.destination_alias}.{name}"), F.col(f"{cfg.source_alias}.{name}")
        first = F.col("__in_target") if name.upper() in keys | audits else ~F.coalesce("__in_batch", F.lit(False))
        return F.when(first, stored).otherwise(fresh).alias(name)

    return both.select(*(pick(c) for c in target.columns))


# Type 2


def _distinct_versions(df: DataFrame, cfg: ScdConfig) -> DataFrame:
    """One row for each key and time: a stored one before new ones."""
    first = [F.col(_PRIORITY).asc()] if _PRIORITY in df.columns else []
    return _first_by(df, [F.col(c) for c in (*cfg.unique_key, cfg.updated_at_column)], [*first, *_total_order(df, [*cfg.unique_key, cfg.updated_at_column])])


def _mark_changes(df: DataFrame, cfg: ScdConfig) -> DataFrame:
    """Which rows open a run of equal content, by value: nulls equal nulls, and nothing is hashed."""
    tracked = _tracked(df, cfg)
    before = F.lag(tracked).over(audit.timeline(cfg.unique_key, cfg.updated_at_column))
    return df.withColumn(_CHANGED, before.isNull() | ~before.eqNullSafe(tracked))


def _versions(df: DataFrame, cfg: ScdConfig, kind: T.DataType) -> dict[str, Column]:
    w = audit.timeline(cfg.unique_key, cfg.updated_at_column)
    deleted = _optional(cfg.deleted_at_column)
    at = F.col(cfg.updated_at_column)
    return {
        cfg.is_current_column: audit.is_current(w),
        cfg.valid_from_column: audit.valid_from(w, at, _optional(cfg.created_at_column), deleted).cast(kind),
        cfg.valid_to_column: audit.valid_to(w, at.cast(kind), audit.timestamp_literal(cfg.default_valid_to, kind)),
        cfg.change_type_column: audit.change_type(w, deleted),
    }


def initial_scd2(batch: DataFrame, cfg: ScdConfig) -> DataFrame:
    """Versions of each key: rows whose tracked content differs from the one before."""
    df = _business(batch, cfg)
    columns = df.columns
    df = _distinct_versions(df.repartition(*(F.col(k) for k in cfg.unique_key)), cfg)
    kept = _mark_changes(df, cfg).where(_CHANGED).drop(_CHANGED)
    return kept.withColumns(_versions(kept, cfg, _audit_kind(df, cfg))).select(*columns, *cfg.audit_columns)


def incremental_scd2(target: DataFrame, batch: DataFrame, cfg: ScdConfig) -> DataFrame:
    """``target`` after merging ``batch``: timelines of the keys in the batch are built anew from stored and
    new rows; other keys pass through.

    A stored version keeps its content and ``valid_from``, and gets a new ``is_current``, ``valid_to`` and
    (with ``update_all_previous_records``) ``change_type``. With ``collapse_redundant_versions``, stored
    versions that no longer open a run of equal content go.
    """
    kind = _kind(target, cfg.valid_to_column)
    new = _like_target(_business(batch, cfg), target, cfg)
    columns = new.columns
    keys, at = cfg.unique_key, cfg.updated_at_column
    touched = new.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.min(at).alias("__since"), F.lit(True).alias("__touched"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    tagged = target.join(touched, on, "left")
    history = F.coalesce("__touched", F.lit(False))
    if not cfg.update_all_previous_records:
        history = history & F.coalesce(F.col("__since") <= F.col(cfg.valid_to_column), F.lit(False))
    untouched = tagged.where(~history).select(*target.columns)
    stored = tagged.where(history).select(*columns, F.lit(0).alias(_PRIORITY), F.struct(*cfg.audit_columns).alias(_STORED))
    rows = stored.unionByName(new.withColumns({_PRIORITY: F.lit(1), _STORED: F.lit(None).cast(stored.schema[_STORED].dataType)}))
    rows = _mark_changes(_distinct_versions(rows.repartition(*(F.col(k) for k in keys)), cfg), cfg)
    if cfg.collapse:
        run = F.sum(F.col(_CHANGED).cast("long")).over(audit.timeline(keys, at).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        loaded = [F.col(c).asc_nulls_last() for c in columns if c.upper() == cfg.loaded_at_column.upper()]
        kept = _first_by(rows.withColumn(_RUN, run), [*(F.col(k) for k in keys), F.col(_RUN)], [*loaded, F.col(at).asc_nulls_last()]).drop(_RUN)
    else:
        kept = rows.where(F.col(_CHANGED) | (F.col(_PRIORITY) == 0))
    made = _versions(kept, cfg, kind)
    kept = kept.withColumns({f"__{n}": c for n, c in made.items()})
    if cfg.incremental_predicates:
        return untouched.unionByName(_merge_on_predicates(tagged.where(history).select(*target.columns), kept, cfg).select(*target.columns))
    return untouched.unionByName(kept.select(*columns, *_merged(cfg, F.col(_PRIORITY) == 0)).select(*target.columns))


def _merged(cfg: ScdConfig, matched: Column) -> list[Column]:
    """Audit columns of computed versions: what a match keeps comes from the stored row, the rest is new."""
    keeps = [] if cfg.recompute_valid_from else [cfg.valid_from_column]
    if not cfg.update_all_previous_records:
        keeps.append(cfg.change_type_column)
    return [(F.when(matched, F.col(_STORED)[n]).otherwise(F.col(f"__{n}")) if n in keeps else F.col(f"__{n}")).alias(n) for n in cfg.audit_columns]


def _merge_on_predicates(history: DataFrame, computed: DataFrame, cfg: ScdConfig) -> DataFrame:
    """The merge with further conditions on a match: a stored row that fails them stays as it is, and its
    computed version comes beside it."""
    version = [*cfg.unique_key, cfg.updated_at_column]
    business = [c for c in computed.columns if not c.startswith("__")]
    source = computed.select(*business, *(F.col(f"__{n}").alias(n) for n in cfg.audit_columns), F.lit(True).alias("__kept"))
    if cfg.collapse:  # stored versions that went are matched too, to be deleted
        gone = history.alias("h").join(source.alias("s"), _same_keys("h", "s", version, True), "left_anti")
        source = source.unionByName(gone.withColumn("__kept", F.lit(False)))
    on, dest, src = _match(cfg, version, True), cfg.destination_alias, cfg.source_alias
    both = history.alias(dest).join(source.alias(src), on, "left").where(F.coalesce(F.col(f"{src}.__kept"), F.lit(True)))
    renewed = [cfg.is_current_column, cfg.valid_to_column, *([cfg.change_type_column] if cfg.update_all_previous_records else []), *([cfg.valid_from_column] if cfg.recompute_valid_from else [])]
    matched = F.col(f"{src}.__kept").isNotNull()
    updated = both.select(*(F.when(matched, F.col(f"{src}.{c}")).otherwise(F.col(f"{dest}.{c}")).alias(c) if c in renewed else F.col(f"{dest}.{c}").alias(c) for c in history.columns))
    inserted = source.alias(src).where("__kept").join(history.alias(dest), on, "left_anti").select(*history.columns)
    return updated.unionByName(inserted)


def apply_initial(batch: DataFrame, cfg: ScdConfig) -> DataFrame:
    return {0: initial_scd0, 1: initial_scd1, 2: initial_scd2}[cfg.scd_type](batch, cfg)


def apply_incremental(target: DataFrame, batch: DataFrame, cfg: ScdConfig) -> DataFrame:
    return {0: incremental_scd0, 1: incremental_scd1, 2: incremental_scd2}[cfg.scd_type](target, batch, cfg)
