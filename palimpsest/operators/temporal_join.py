"""Joins of histories through time: one row for each stretch in which no side changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import ConfigError
from ..functions.audit import timestamp_literal

VALID_FROM, VALID_TO, IS_CURRENT = "_valid_from", "_valid_to", "_is_current"
_LEFT_OUT = {VALID_FROM, VALID_TO, IS_CURRENT, "_updated_at", "_change_type"}


def temporal_join(relations: Sequence[DataFrame], join_keys: Sequence[str], default_valid_to: str = "2999-12-31 23:59:59", method: str = "auto") -> DataFrame:
    """The histories in ``relations`` joined on ``join_keys`` and time.

    The points at which any of them has a version begin stretches, which end at the next point of the key
    or at ``default_valid_to``. Each relation adds the columns of its version that spans the stretch, nulls
    where it has none (null keys have none). Columns: the keys, each relation's other columns but audit
    ones, ``_is_current, _valid_from, _valid_to`` of the stretch. Names that two relations share are refused.

    ``method``: ``range`` joins each relation by key and range, which also covers overlapping versions and
    relations with several rows for a key and time. ``fill`` takes for each stretch the latest version that
    begins no later: no pairs, so that a key with very many versions costs no more than sorting them, for
    histories without overlaps whose key is ``join_keys``. ``auto``, the default, looks (with a pass over each relation)
    whether they are such, and takes ``fill`` if so, else ``range``, whose pairs grow with the square of a key's versions.
    """
    keys = list(join_keys)
    upper = {k.upper() for k in keys}
    added = [[c for c in r.columns if c.upper() not in upper and c.lower() not in _LEFT_OUT] for r in relations]
    names = [c.upper() for cs in added for c in cs]
    if clash := sorted({n for n in names if names.count(n) > 1}):
        raise ConfigError(f"several relations have columns named {', '.join(clash)}: rename them before the join")
    if method not in ("range", "fill", "auto"):
        raise ConfigError(f"method must be range, fill or auto, got: {method}")
    if method == "auto":
        method = "fill" if all(one_version_at_a_time(r, keys) for r in relations) else "range"
    points = None
    for r in relations:
        own = r.select(*keys, VALID_FROM)
        points = own if points is None else points.unionByName(own)
    kind = points.schema[VALID_FROM].dataType
    w = Window.partitionBy(*keys).orderBy(F.col(VALID_FROM).asc_nulls_last())
    after = F.lead(VALID_FROM).over(w)
    ends = {"__from": F.col(VALID_FROM), "__to": F.coalesce(after, timestamp_literal(default_valid_to, kind)), IS_CURRENT: F.lead(F.lit(1)).over(w).isNull()}
    if method == "fill":
        return _filled(relations, keys, added, w, ends)
    # dealt out by more than the keys: with adaptive plans, what a union of histories that are dealt out alike
    # says of its partitions may not hold
    spine = points.repartition(*(F.col(k) for k in keys), F.col(VALID_FROM)).distinct().withColumns(ends).drop(VALID_FROM)
    out = spine.alias("spine")
    for i, (r, columns) in enumerate(zip(relations, added)):
        a = f"r{i}"
        on = (F.col("__from") >= F.col(f"{a}.{VALID_FROM}")) & (F.col("__to") <= F.col(f"{a}.{VALID_TO}"))
        for k in keys:
            on = on & (F.col(f"spine.{k}") == F.col(f"{a}.{k}"))
        out = out.join(r.select(*keys, VALID_FROM, VALID_TO, *columns).alias(a), on, "left")
    picked = [F.col(f"r{i}.{c}") for i, columns in enumerate(added) for c in columns]
    return out.where("__from < __to").select(*(F.col(f"spine.{k}") for k in keys), *picked, IS_CURRENT, F.col("__from").alias(VALID_FROM), F.col("__to").alias(VALID_TO))


def one_version_at_a_time(relation: DataFrame, keys: Sequence[str]) -> bool:
    """Whether no version of a key begins before an earlier one has ended, or together with another."""
    earlier = Window.partitionBy(*keys).orderBy(F.col(VALID_FROM).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    seen = relation.select(VALID_FROM, F.max(VALID_TO).over(earlier).alias("__end"), F.max(VALID_FROM).over(earlier).alias("__begin"))
    return seen.where((F.col(VALID_FROM) < F.col("__end")) | (F.col(VALID_FROM) == F.col("__begin"))).isEmpty()


def _filled(relations, keys, added, w, ends) -> DataFrame:
    rows = None
    for i, (r, columns) in enumerate(zip(relations, added)):
        version = F.struct(F.col(VALID_TO).alias("until"), *(F.col(c) for c in columns))
        own = r.select(*keys, VALID_FROM, *(version.alias(f"__v{j}") if i == j else F.lit(None).alias(f"__v{j}") for j in range(len(relations))))
        rows = own if rows is None else rows.unionByName(own)
    # versions of several relations that begin at one point become one row of it
    points = rows.repartition(*(F.col(k) for k in keys), F.col(VALID_FROM)).groupBy(*keys, VALID_FROM).agg(*(F.max_by(f"__v{j}", F.when(F.col(f"__v{j}").isNotNull(), 1)).alias(f"__v{j}") for j in range(len(relations))))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    back = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = points.withColumns(ends | {f"__v{j}": F.when(known, F.last(f"__v{j}", ignorenulls=True).over(back)) for j in range(len(relations))}).where("__from < __to")
    picked = [F.when(F.col("__to") <= F.col(f"__v{j}.until"), F.col(f"__v{j}.{c}")).alias(c) for j, columns in enumerate(added) for c in columns]
    return filled.select(*keys, *picked, IS_CURRENT, F.col("__from").alias(VALID_FROM), F.col("__to").alias(VALID_TO))
