"""Registered queries of tables as a whole: store, merges, streams, seeds, settings, helpers; and the same in SQL."""

from __future__ import annotations

import uuid
import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import ConfigError, ScdConfig
from .functions import lists
from .functions.now import sysdate
from .operators import scd
from .queries import _B1, _B2, _EVENTS, _HISTORY, _LATE1, _LATE2, _ORDERS, CUTOFF, Sql, _cfg, _events, _halves, _join_sql, _late, _one, _order_cfg, _orders, _part, _query, _sql, _two_loads
from .operators.temporal_join import temporal_join
from .sources.filters import seed, source
from .sources.shared import shared_dir
from .sources.store import VersionedTable
from .streaming.batches import stream_into
from .table import ScdTable


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _table(spark: SparkSession, cfg: ScdConfig, **more) -> ScdTable:
    return ScdTable(spark, _place(spark, "table"), cfg, **({"buckets": 4} | more))


def _loaded(table: ScdTable, *batches: DataFrame) -> DataFrame:
    for batch in batches:
        table.apply(batch)
    return table.read()


def _rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(names: str, rows: list[tuple]) -> str:
    spell = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(spell, r)) + ')' for r in rows)}) AS t({names})"


# Tables


@_query("table_initial", _sql(_HISTORY.initial("t", "events")))
def _(spark, sf_dir):
    return _loaded(_table(spark, _cfg()), _events(spark, sf_dir))


@_query("table_merge", _sql(_B1, _B2, _HISTORY.initial("s", "b1"), _HISTORY.incremental("t", "s", "b2")))
def _(spark, sf_dir):
    return _loaded(_table(spark, _cfg()), *_halves(_events(spark, sf_dir)))


@_query("table_merge_type_1", _sql(f"s AS ({_one(_ORDERS, 'o_custkey', 'o_orderdate', 'orders', True)})", of="SELECT * FROM s"))
def _(spark, sf_dir):
    return _loaded(_table(spark, _order_cfg(1)), _orders(spark, sf_dir), _orders(spark, sf_dir))


@_query("table_alias", _sql(_LATE1, _LATE2, _HISTORY.initial("s", "b1"), _HISTORY.incremental("t", "s", "b2")))
def _(spark, sf_dir):
    plain = {"scd_type": 0, "meta": {"unique_key": ["user_id"]}, "updated_at_column": "ts", "change_columns": {"include": ["event_type"]}}
    return _loaded(ScdTable.incremental_scd2(spark, _place(spark, "table"), plain, {"default_valid_to": "2999-12-31 23:59:59"}), *_late(_events(spark, sf_dir)))


@_query("table_full_refresh", _sql(_HISTORY.initial("t", "events")))
def _(spark, sf_dir):
    table = _table(spark, _cfg())
    table.apply(_halves(_events(spark, sf_dir))[0])
    return table.apply(_events(spark, sf_dir), full_refresh=True)


@_query("table_rerun", _sql(_HISTORY.initial("t", "events")))
def _(spark, sf_dir):
    return _loaded(_table(spark, _cfg()), _events(spark, sf_dir), _events(spark, sf_dir))


_SIXTH = [f"b{k} AS (SELECT * FROM events WHERE event_id % 6 = {k})" for k in range(6)]


@_query("table_six_batches", _sql(*_SIXTH, _HISTORY.initial("t0", "b0"), *(_HISTORY.incremental(f"t{k}", f"t{k - 1}", f"b{k}") for k in range(1, 6)), of="SELECT * FROM t5"))
def _(spark, sf_dir):
    df = _events(spark, sf_dir)
    return _loaded(_table(spark, _cfg()), *(df.where(F.col("event_id") % 6 == k) for k in range(6)))


@_query("table_versions", _sql(_B1, _B2, _HISTORY.initial("s", "b1"), _HISTORY.incremental("t", "s", "b2"), of="SELECT 1 AS version, count(*) AS n_rows FROM s UNION ALL SELECT 2, count(*) FROM t"))
def _(spark, sf_dir):
    seen: list[int] = []
    table = _table(spark, _cfg(), post_hooks=[lambda t: seen.append(t.store.version())])
    _loaded(table, *_halves(_events(spark, sf_dir)))
    return reduce(DataFrame.unionByName, (table.read(v).agg(F.count("*").alias("n_rows")).select(F.lit(v).alias("version"), "n_rows") for v in seen))


@_query("table_contract", _sql(_HISTORY.initial("t", "events")))
def _(spark, sf_dir):
    kinds = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string", "_is_current": "boolean", "_valid_from": "timestamp_ntz", "_valid_to": "timestamp_ntz", "_change_type": "string"}
    contract = T.StructType.fromDDL(", ".join(f"{c} {k}" for c, k in sorted(kinds.items())))
    return _loaded(_table(spark, _cfg(), contract=contract), _events(spark, sf_dir))


_COMMENTS = {"event_id": "the event", "_valid_from": "when it began"}


@_query("table_comments", _values("name, text", [(c, _COMMENTS.get(c)) for c in [*_EVENTS, "_is_current", "_valid_from", "_valid_to", "_change_type"]]))
def _(spark, sf_dir):
    table = _table(spark, _cfg(), comments=_COMMENTS)
    table.apply(_events(spark, sf_dir))
    found = VersionedTable(spark, table.store.path).read().schema
    return _rows(spark, "name string, text string", [(f.name, f.metadata.get("comment")) for f in found.fields])


@_query("table_written_at", _sql(_HISTORY.initial("t", "events"), of="SELECT *, true AS written FROM t"))
def _(spark, sf_dir):
    batch = _events(spark, sf_dir).withColumn("_written_at", sysdate())
    return _loaded(_table(spark, _cfg()), batch).withColumn("written", F.col("_written_at").isNotNull()).drop("_written_at")


@_query("table_header", _sql(_HISTORY.initial("t", "events"), of="SELECT *, 'UTC' AS zone FROM t"))
def _(spark, sf_dir):
    table = _table(spark, _cfg(), sql_header=["set palimpsest.header = UTC"])
    return _loaded(table, _events(spark, sf_dir)).withColumn("zone", F.lit(spark.conf.get("palimpsest.header")))


@_query("table_stream", _sql(_HISTORY.initial("t", "events")))
def _(spark, sf_dir):
    table = _table(spark, _cfg())
    schema = _events(spark, sf_dir).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream_into(stream, table, _place(spark, "stream")).awaitTermination()
    return table.read()


@_query("store_versions", "SELECT event_id, user_id FROM events")
def _(spark, sf_dir):
    table = VersionedTable(spark, _place(spark, "store"))
    rows = _events(spark, sf_dir).select("event_id", "user_id")
    table.write(rows, keys=["user_id"], buckets=4)
    table.write(rows.where("user_id % 2 = 0"), keys=["user_id"], buckets=4)
    return table.read(1)


@_query("store_seed", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders")
def _(spark, sf_dir):
    rows = _orders(spark, sf_dir).withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority"))).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    path = _place(spark, "seed")
    rows.write.csv(path, header=True)
    return seed(spark, path, rows.schema)


# Settings of merges

_KEPT = f"ts >= TIMESTAMP '{CUTOFF}'"


@_query("scd2_incremental_predicates", _sql(_LATE1, _LATE2, _HISTORY.initial("s", "b1"), _HISTORY.incremental("t", "s", "b2"), of=f"""
SELECT {_HISTORY.list}, _is_current, CASE WHEN pri = 0 AND {_KEPT} THEN old_start ELSE _valid_from END AS _valid_from, _valid_to, _change_type FROM t_n
UNION ALL SELECT * FROM s WHERE NOT ({_KEPT}) OR NOT EXISTS (SELECT 1 FROM t_k WHERE t_k.user_id IS NOT DISTINCT FROM s.user_id)""".strip()))  # fmt: skip
def _(spark, sf_dir):
    cfg = _cfg(incremental_predicates=[f"DEST.ts >= timestamp_ntz'{CUTOFF}'"])
    first, second = _late(_events(spark, sf_dir))
    return scd.apply_incremental(scd.apply_initial(first, cfg), second, cfg)


@_query("scd2_recompute_valid_from", _sql(_LATE1, _LATE2, _HISTORY.initial("s", "b1"), _HISTORY.incremental("t", "s", "b2"), of=f"""
SELECT {_HISTORY.list}, _is_current, _valid_from, _valid_to, _change_type FROM t_n
UNION ALL SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM t_k WHERE t_k.user_id IS NOT DISTINCT FROM s.user_id)""".strip()))  # fmt: skip
def _(spark, sf_dir):
    return _two_loads(_events(spark, sf_dir), _cfg(recompute_valid_from=True), _late)


_NULLS = "(SELECT * REPLACE (CASE WHEN o_custkey % 5 <> 0 THEN o_custkey END AS o_custkey) FROM orders)"
_N1, _N2 = f"b1 AS (SELECT * FROM {_NULLS} WHERE o_orderkey % 10 < 4)", f"b2 AS (SELECT * FROM {_NULLS} WHERE o_orderkey % 10 >= 2)"


def _null_orders(spark: SparkSession, sf_dir: str, cfg: ScdConfig) -> DataFrame:
    df = _orders(spark, sf_dir).withColumn("o_custkey", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")))
    return scd.apply_incremental(scd.apply_initial(df.where("o_orderkey % 10 < 4"), cfg), df.where("o_orderkey % 10 >= 2"), cfg)


for _type, _latest in ((0, False), (1, True)):
    for _safe in (False, True):
        _same = "s.o_custkey IS NOT DISTINCT FROM n.o_custkey" if _safe else "s.o_custkey = n.o_custkey"
        _audits = ", ".join(f"coalesce(s.{c}, n.{c}) AS {c}" for c in ("_is_current", "_valid_from", "_valid_to", "_change_type"))
        _of = {
            0: f"SELECT * FROM s UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE {_same})",
            1: f"SELECT {', '.join('n.' + c for c in _ORDERS)}, {_audits} FROM n LEFT JOIN s ON {_same} UNION ALL SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM n WHERE {_same})",
        }[_type]
        _ctes = (_N1, _N2, f"s AS ({_one(_ORDERS, 'o_custkey', 'o_orderdate', 'b1', _latest)})", f"n AS ({_one(_ORDERS, 'o_custkey', 'o_orderdate', 'b2', _latest)})")
        _query(f"scd{_type}_null_keys{'_safe' if _safe else ''}", _sql(*_ctes, of=_of))(lambda spark, sf_dir, cfg=_order_cfg(_type, null_safe_keys=_safe): _null_orders(spark, sf_dir, cfg))


@_query("source_first_run", "SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00'")
def _(spark, sf_dir):
    df = _events(spark, sf_dir)
    return source(df, "ts", df.where("false").select(F.col("ts").alias("_loaded_at")), default_valid_from="2024-01-10 00:00:00")


@_query("source_of_table", f"SELECT * FROM events WHERE ts > (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '{CUTOFF}')")
def _(spark, sf_dir):
    table, df = _table(spark, _cfg(change_columns={"include": ["event_type", "value"]})), _events(spark, sf_dir)
    table.apply(_halves(df)[0].withColumn("_loaded_at", F.col("ts")))
    return table.source(df, "ts")


@_query("scd2_join_2way_range", _join_sql(["click", "view"], ["user_id"]))
def _(spark, sf_dir):
    df = _events(spark, sf_dir)
    return temporal_join([_part(df, k, ["user_id"]) for k in ("click", "view")], ["user_id"], method="range")


# Helpers and checks

_LEFT, _RIGHT = ["user_id", "ts", "Value", "user_id", "props"], ["VALUE", "other", "ts"]
_IN = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"


@_query("helpers_lists", f"""
WITH a AS (SELECT unnest({_IN(_LEFT)}) AS n, unnest(range({len(_LEFT)})) AS i), b AS (SELECT unnest({_IN(_RIGHT)}) AS n, unnest(range({len(_LEFT)}, {len(_LEFT) + len(_RIGHT)})) AS i),
first AS (SELECT arg_min(n, i) AS n, min(i) AS i, upper(n) AS u FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY upper(n)),
mine AS (SELECT n, min(i) AS i FROM a GROUP BY n)
SELECT 'union' AS helper, string_agg(n, ',' ORDER BY i) AS names FROM first
UNION ALL SELECT 'intersection', string_agg(n, ',' ORDER BY i) FROM mine WHERE upper(n) IN (SELECT upper(n) FROM b)
UNION ALL SELECT 'difference', string_agg(n, ',' ORDER BY i) FROM mine WHERE n NOT IN (SELECT n FROM b)
UNION ALL SELECT 'prefix', string_agg('x.' || n, ',' ORDER BY i) FROM a
UNION ALL SELECT 'csv', string_agg('t.' || n, ', ' ORDER BY i) FROM b""")  # fmt: skip
def _(spark, sf_dir):
    joined = ",".join
    return _rows(spark, "helper string, names string", [
        ("union", joined(lists.list_union(_LEFT, _RIGHT, case_insensitive=True))), ("intersection", joined(lists.list_intersection(_LEFT, _RIGHT, case_insensitive=True))),
        ("difference", joined(lists.list_difference(_LEFT, _RIGHT))), ("prefix", joined(lists.prefix_array_elements(_LEFT, "x."))), ("csv", lists.quoted_csv(_RIGHT, "t")),
    ])


@_query("helpers_objects", _values("step, found", [("nested", "b"), ("place", "y"), ("missing", "none"), ("negative", "none"), ("meta first", "meta"), ("then setting", "setting"), ("then default", "default"), ("list", "true"), ("text", "false"), ("mapping", "false")]))
def _(spark, sf_dir):
    value, config = {"a": {"b": "b"}, "l": ["x", "y"]}, {"meta": {"k": "meta"}, "k": "setting", "j": "setting", "i": None}
    of = lambda *path: lists.get_from_object(value, *path, default="none")
    return _rows(spark, "step string, found string", [
        ("nested", of("a", "b")), ("place", of("l", 1)), ("missing", of("a", "c")), ("negative", of("l", -1)),
        ("meta first", lists.get_config_value(config, "k")), ("then setting", lists.get_config_value(config, "j")), ("then default", lists.get_config_value(config, "i", "default")),
        *((n, str(lists.is_array(v)).lower()) for n, v in (("list", ["a"]), ("text", "a"), ("mapping", {}))),
    ])


@_query("helpers_incremental", _values("moment, type, incremental, incremental_scd2", [("before", 2, False, False), ("after", 2, True, True), ("refresh", 2, False, False), ("before", 1, False, False), ("after", 1, True, False), ("refresh", 1, False, False)]))
def _(spark, sf_dir):
    found = []
    for kind, cfg, rows in ((2, _cfg(), _events(spark, sf_dir)), (1, _order_cfg(1), _orders(spark, sf_dir))):
        table = _table(spark, cfg)
        found.append(("before", kind, table.is_incremental(), table.is_incremental_scd2()))
        table.apply(rows)
        found += [("after", kind, table.is_incremental(), table.is_incremental_scd2()), ("refresh", kind, table.is_incremental(True), table.is_incremental_scd2(True))]
    return _rows(spark, "moment string, type int, incremental boolean, incremental_scd2 boolean", found)


#: Settings that are refused, and some that only warn: name, settings, what comes of them.
_SETTINGS = [
    ("no key", {"unique_key": None}, "error"), ("empty key", {"unique_key": []}, "error"), ("key as text", {"unique_key": "user_id"}, "error"), ("unknown type", {"scd_type": 3}, "error"),
    ("deletions in type 1", {"scd_type": 1, "deleted_at_column": "ts"}, "error"), ("missing created_at", {"created_at_column": "born"}, "error"), ("missing deleted_at", {"deleted_at_column": "gone"}, "error"),
    ("missing key column", {"unique_key": ["nobody"]}, "error"), ("nothing to track", {"change_columns": {"include": ["user_id"]}}, "error"), ("restricted history", {"update_all_previous_records": False, "collapse_redundant_versions": False}, "warning"),
    ("restricted and collapsed", {"update_all_previous_records": False}, "warning"), ("load time tracked", {"change_columns": None, "loaded_at_column": "value"}, "warning"), ("all well", {}, "fine"),
]


@_query("settings_checked", _values("name, outcome", [(n, o) for n, _, o in _SETTINGS]))
def _(spark, sf_dir):
    found, rows = [], _events(spark, sf_dir)
    for name, more, _ in _SETTINGS:
        with warnings.catch_warnings(record=True) as seen:
            warnings.simplefilter("always")
            try:
                scd.initial_scd2(rows, _cfg(**more)) if more.get("scd_type", 2) == 2 else _cfg(**more)
                found.append((name, "warning" if seen else "fine"))
            except ConfigError:
                found.append((name, "error"))
    return _rows(spark, "name string, outcome string", found)


@_query("settings_resolved", _values("setting, found", [("unique_key", "user_id"), ("default_valid_to", "2099-01-01 00:00:00"), ("updated_at_column", "ts"), ("scd_type", "2"), ("collapse_redundant_versions", "True")]))
def _(spark, sf_dir):
    config = {"meta": {"unique_key": ["user_id"]}, "unique_key": ["other"], "updated_at_column": "ts", "collapse_redundant_versions": False, "scd_type": 0}
    cfg = ScdConfig.resolve(config, {"default_valid_to": "2099-01-01 00:00:00"}, scd_type=2)
    return _rows(spark, "setting string, found string", [(n, ",".join(v) if isinstance(v := getattr(cfg, n), list) else str(v)) for n in ("unique_key", "default_valid_to", "updated_at_column", "scd_type", "collapse_redundant_versions")])


