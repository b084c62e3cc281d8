"""The registered queries of the engine itself, and the same in SQL.

Spark and SQL are written from the same description of each query, apart from one another: the SQL
generator below states the semantics with CTEs and knows nothing of the operators.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ScdConfig
from .operators import assertions, scd
from .operators.temporal_join import temporal_join
from .sources.filters import source

CUTOFF = "2024-01-16 00:00:00"
RUN_START = "2024-01-20 12:00:00"
END = "2999-12-31 23:59:59"

_EVENTS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _cfg(**more) -> ScdConfig:
    return ScdConfig(**({"unique_key": ["user_id"], "updated_at_column": "ts", "change_columns": {"include": ["event_type"]}} | more))


def _on_error(offset: str = "0 hours"):
    return F.when(F.col("event_type") == "error", F.col("ts") - F.expr(f"interval {offset}"))


# SQL


def _partition(keys: list[str]) -> str:
    return ", ".join(keys)


class Sql:
    """SQL of type-2 loads: columns, key, time, tracked columns and options of one dimension."""

    def __init__(self, columns: list[str], keys: list[str], at: str, tracked: list[str], created: str | None = None, deleted: str | None = None, collapse: bool = True, all_records: bool = True, loaded: str | None = None, names: tuple[str, str, str, str] = ("_is_current", "_valid_from", "_valid_to", "_change_type")):
        self.columns, self.keys, self.at, self.created, self.deleted = columns, keys, at, created, deleted
        self.collapse, self.all_records, self.loaded, self.names = collapse and all_records, all_records, loaded, names
        self.row = f"row({', '.join(tracked)})"
        self.list = ", ".join(columns)
        self.k = _partition(keys)
        self.rest = ", ".join(f"{c} NULLS LAST" for c in columns if c not in (*keys, at))
        self.w = f"(PARTITION BY {self.k} ORDER BY {at} NULLS LAST)"

    def audits(self) -> str:
        current, start, end, kind = self.names
        first = f"coalesce({', '.join(c for c in (self.deleted, self.created, self.at) if c)})"
        change = f"CASE WHEN lag(1) OVER w IS NULL THEN 'I' ELSE 'U' END"
        if self.deleted:
            change = f"CASE WHEN {self.deleted} IS NOT NULL THEN 'D' WHEN lag(1) OVER w IS NULL OR lag({self.deleted}) OVER w IS NOT NULL THEN 'I' ELSE 'U' END"
        return f"lead(1) OVER w IS NULL AS {current}, CASE WHEN lag({self.at}) OVER w IS NULL THEN {first} ELSE {self.at} END AS {start}, coalesce(lead({self.at}) OVER w, TIMESTAMP '{END}') AS {end}, {change} AS {kind}"

    def initial(self, name: str, rows: str) -> str:
        """CTEs that end in ``name``: the dimension of ``rows``."""
        return f"""
{name}_d AS (SELECT {self.list} FROM {rows} QUALIFY row_number() OVER (PARTITION BY {self.k}, {self.at} ORDER BY {self.rest}) = 1),
{name}_c AS (SELECT {self.list}, lag(1) OVER w IS NULL OR lag({self.row}) OVER w IS DISTINCT FROM {self.row} AS changed FROM {name}_d WINDOW w AS {self.w}),
{name} AS (SELECT {self.list}, {self.audits()} FROM {name}_c WHERE changed WINDOW w AS {self.w})"""

    def incremental(self, name: str, target: str, rows: str) -> str:
        current, start, end, kind = self.names
        same = " AND ".join(f"t.{k} IS NOT DISTINCT FROM b.{k}" for k in self.keys)
        near = "" if self.all_records else f" AND b.since <= t.{end}"
        kept = f"QUALIFY row_number() OVER (PARTITION BY {self.k}, run ORDER BY {self.loaded + ' NULLS LAST, ' if self.loaded else ''}{self.at} NULLS LAST) = 1" if self.collapse else "WHERE changed OR pri = 0"
        change = kind if self.all_records else f"CASE WHEN pri = 0 THEN old_kind ELSE {kind} END"
        return f"""
{name}_k AS (SELECT {self.k}, min({self.at}) AS since FROM {rows} GROUP BY {self.k}),
{name}_a AS (
  SELECT {self.list}, 0 AS pri, {start} AS old_start, {kind} AS old_kind FROM {target} t WHERE EXISTS (SELECT 1 FROM {name}_k b WHERE {same}{near})
  UNION ALL SELECT {self.list}, 1, NULL, NULL FROM {rows}),
{name}_d AS (SELECT * FROM {name}_a QUALIFY row_number() OVER (PARTITION BY {self.k}, {self.at} ORDER BY pri, {self.rest}) = 1),
{name}_c AS (SELECT *, lag(1) OVER w IS NULL OR lag({self.row}) OVER w IS DISTINCT FROM {self.row} AS changed FROM {name}_d WINDOW w AS {self.w}),
{name}_r AS (SELECT *, sum(CAST(changed AS INT)) OVER (PARTITION BY {self.k} ORDER BY {self.at} NULLS LAST ROWS UNBOUNDED PRECEDING) AS run FROM {name}_c),
{name}_v AS (SELECT * FROM {name}_r {kept}),
{name}_n AS (SELECT {self.list}, pri, old_start, old_kind, {self.audits()} FROM {name}_v WINDOW w AS {self.w}),
{name} AS (
  SELECT {self.list}, {current}, CASE WHEN pri = 0 THEN old_start ELSE {start} END AS {start}, {end}, {change} AS {kind} FROM {name}_n
  UNION ALL SELECT * FROM {target} t WHERE NOT EXISTS (SELECT 1 FROM {name}_k b WHERE {same}{near}))"""


_HISTORY = Sql(_EVENTS, ["user_id"], "ts", ["event_type"])
_B1, _B2 = f"b1 AS (SELECT * FROM events WHERE ts < TIMESTAMP '{CUTOFF}')", f"b2 AS (SELECT * FROM events WHERE ts >= TIMESTAMP '{CUTOFF}')"
_LATE1, _LATE2 = "b1 AS (SELECT * FROM events WHERE event_id % 10 <> 0)", "b2 AS (SELECT * FROM events WHERE event_id % 10 = 0)"
_LOADED = ", ts + CASE WHEN event_id % 10 = 0 THEN INTERVAL 60 DAY ELSE INTERVAL 1 DAY END AS _loaded_at"


def _sql(*ctes: str, of: str = "SELECT * FROM t") -> str:
    return "WITH " + ",".join(c.strip() if i else c for i, c in enumerate(ctes)) + "\n" + of


def _halves(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    cut = F.lit(CUTOFF).cast("timestamp_ntz")
    return df.where(F.col("ts") < cut), df.where(F.col("ts") >= cut)


def _late(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("event_id % 10 <> 0"), df.where("event_id % 10 = 0")


def _two_loads(df: DataFrame, cfg: ScdConfig, split) -> DataFrame:
    first, second = split(df)
    return scd.apply_incremental(scd.apply_initial(first, cfg), second, cfg)


_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = (f, sql)
        return f

    return add


# Initial loads


@_query("scd2_initial", _sql(_HISTORY.initial("t", "events")))
def _(spark, sf_dir):
    return scd.initial_scd2(_events(spark, sf_dir), _cfg())


@_query("scd2_initial_include", _sql(Sql(_EVENTS, ["user_id"], "ts", ["event_type", "value"]).initial("t", "events")))
def _(spark, sf_dir):
    return scd.initial_scd2(_events(spark, sf_dir), _cfg(change_columns={"include": ["event_type", "value"]}))


@_query("scd2_initial_exclude", _sql(_HISTORY.initial("t", "events")))
def _(spark, sf_dir):
    return scd.initial_scd2(_events(spark, sf_dir), _cfg(change_columns={"exclude": ["value", "props", "event_id"]}))


@_query("scd2_initial_legacy_check", _sql(_HISTORY.initial("t", "events")))
def _(spark, sf_dir):
    return scd.initial_scd2(_events(spark, sf_dir), _cfg(change_columns=None, scd_check_columns=["event_type", "value"], exclude_columns_from_change_check=["VALUE"]))


_DELETED = Sql([*_EVENTS, "deleted_at"], ["user_id"], "ts", ["event_type"], deleted="deleted_at")
_BORN = Sql([*_EVENTS, "deleted_at", "created_at"], ["user_id"], "ts", ["event_type"], created="created_at", deleted="deleted_at")


@_query("scd2_initial_deleted", _sql("e AS (SELECT *, CASE WHEN event_type = 'error' THEN ts END AS deleted_at FROM events)", _DELETED.initial("t", "e")))
def _(spark, sf_dir):
    return scd.initial_scd2(_events(spark, sf_dir).withColumn("deleted_at", _on_error()), _cfg(deleted_at_column="deleted_at"))


@_query("scd2_initial_born_deleted", _sql("e AS (SELECT *, CASE WHEN event_type = 'error' THEN ts - INTERVAL 1 HOUR END AS deleted_at, ts - INTERVAL 1 DAY AS created_at FROM events)", _BORN.initial("t", "e")))
def _(spark, sf_dir):
    df = _events(spark, sf_dir).withColumns({"deleted_at": _on_error("1 hour"), "created_at": F.col("ts") - F.expr("interval 1 day")})
    return scd.initial_scd2(df, _cfg(deleted_at_column="deleted_at", created_at_column="created_at"))


@_query("scd2_initial_dups", _sql("e AS (SELECT * FROM events UNION ALL SELECT * REPLACE (event_type || '!' AS event_type) FROM events)", _HISTORY.initial("t", "e")))
def _(spark, sf_dir):
    df = _events(spark, sf_dir)
    return scd.initial_scd2(df.unionByName(df.withColumn("event_type", F.concat("event_type", F.lit("!")))), _cfg())


_RENAMED = Sql(_EVENTS, ["user_id"], "ts", ["event_type"], names=("is_now", "from_ts", "to_ts", "kind"))


@_query("scd2_custom_columns", _sql(_RENAMED.initial("t", "events")))
def _(spark, sf_dir):
    return scd.initial_scd2(_events(spark, sf_dir), _cfg(is_current_column="is_now", valid_from_column="from_ts", valid_to_column="to_ts", change_type_column="kind"))


_NULL_KEY = Sql([*_EVENTS, "region"], ["user_id", "region"], "ts", ["event_type"])
_REGION = "CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS region"


@_query("scd2_null_key", _sql(f"e AS (SELECT *, {_REGION} FROM events)", f"b1 AS (SELECT * FROM e WHERE ts < TIMESTAMP '{CUTOFF}')", f"b2 AS (SELECT * FROM e WHERE ts >= TIMESTAMP '{CUTOFF}')", _NULL_KEY.initial("s", "b1"), _NULL_KEY.incremental("t", "s", "b2")))
def _(spark, sf_dir):
    df = _events(spark, sf_dir).withColumn("region", F.when(F.col("event_type") != "error", F.col("event_type")))
    return _two_loads(df, _cfg(unique_key=["user_id", "region"]), _halves)


# Incremental loads


@_query("scd2_incremental", _sql(_B1, _B2, _HISTORY.initial("s", "b1"), _HISTORY.incremental("t", "s", "b2")))
def _(spark, sf_dir):
    return _two_loads(_events(spark, sf_dir), _cfg(), _halves)


@_query("scd2_incremental_backfill", _sql(_LATE1, _LATE2, _HISTORY.initial("s", "b1"), _HISTORY.incremental("t", "s", "b2")))
def _(spark, sf_dir):
    return _two_loads(_events(spark, sf_dir), _cfg(), _late)


_KEEP = Sql(_EVENTS, ["user_id"], "ts", ["event_type"], collapse=False)


@_query("scd2_incremental_keep", _sql(_LATE1, _LATE2, _KEEP.initial("s", "b1"), _KEEP.incremental("t", "s", "b2")))
def _(spark, sf_dir):
    return _two_loads(_events(spark, sf_dir), _cfg(collapse_redundant_versions=False), _late)


_FAST = Sql(_EVENTS, ["user_id"], "ts", ["event_type"], all_records=False)


@_query("scd2_incremental_fast", _sql(_B1, _B2, _FAST.initial("s", "b1"), _FAST.incremental("t", "s", "b2")))
def _(spark, sf_dir):
    return _two_loads(_events(spark, sf_dir), _cfg(update_all_previous_records=False, collapse_redundant_versions=False), _halves)


_BY_LOAD = Sql([*_EVENTS, "_loaded_at"], ["user_id"], "ts", ["event_type"], loaded="_loaded_at")


@_query("scd2_incremental_loaded_at", _sql(f"e AS (SELECT *{_LOADED} FROM events)", "b1 AS (SELECT * FROM e WHERE event_id % 10 <> 0)", "b2 AS (SELECT * FROM e WHERE event_id % 10 = 0)", _BY_LOAD.initial("s", "b1"), _BY_LOAD.incremental("t", "s", "b2")))
def _(spark, sf_dir):
    late = F.expr("case when event_id % 10 = 0 then interval 60 days else interval 1 day end")
    return _two_loads(_events(spark, sf_dir).withColumn("_loaded_at", F.col("ts") + late), _cfg(), _late)


@_query("scd2_incremental_deleted", _sql("e AS (SELECT *, CASE WHEN event_type = 'error' THEN ts END AS deleted_at FROM events)", "b1 AS (SELECT * FROM e WHERE event_id % 10 <> 0)", "b2 AS (SELECT * FROM e WHERE event_id % 10 = 0)", _DELETED.initial("s", "b1"), _DELETED.incremental("t", "s", "b2")))
def _(spark, sf_dir):
    return _two_loads(_events(spark, sf_dir).withColumn("deleted_at", _on_error()), _cfg(deleted_at_column="deleted_at"), _late)


# Types 0 and 1

_ONE = f"true AS _is_current, {{start}} AS _valid_from, TIMESTAMP '{END}' AS _valid_to, 'I' AS _change_type"


def _one(columns: list[str], key: str, at: str, rows: str, latest: bool, start: str | None = None) -> str:
    rest = ", ".join(f"{c} NULLS LAST" for c in columns if c not in (key, at))
    return f"SELECT {', '.join(columns)}, {_ONE.format(start=start or at)} FROM {rows} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {at} {'DESC NULLS FIRST' if latest else 'NULLS LAST'}, {rest}) = 1"


_ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_O1, _O2 = "b1 AS (SELECT * FROM orders WHERE o_orderkey % 10 < 4)", "b2 AS (SELECT * FROM orders WHERE o_orderkey % 10 >= 2)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(*_ORDERS)


def _order_cfg(scd_type: int, **more) -> ScdConfig:
    return ScdConfig(unique_key=["o_custkey"], updated_at_column="o_orderdate", scd_type=scd_type, **more)


def _order_loads(spark: SparkSession, sf_dir: str, scd_type: int) -> DataFrame:
    df, cfg = _orders(spark, sf_dir), _order_cfg(scd_type)
    return scd.apply_incremental(scd.apply_initial(df.where("o_orderkey % 10 < 4"), cfg), df.where("o_orderkey % 10 >= 2"), cfg)


@_query("scd0_initial", _one(_ORDERS, "o_custkey", "o_orderdate", "orders", False))
def _(spark, sf_dir):
    return scd.initial_scd0(_orders(spark, sf_dir), _order_cfg(0))


@_query("scd1_initial", _one(_ORDERS, "o_custkey", "o_orderdate", "orders", True))
def _(spark, sf_dir):
    return scd.initial_scd1(_orders(spark, sf_dir), _order_cfg(1))


@_query("scd1_created_at", _one([*_EVENTS, "created_at"], "user_id", "ts", "(SELECT *, ts - INTERVAL 1 DAY AS created_at FROM events)", True, "coalesce(created_at, ts)"))
def _(spark, sf_dir):
    df = _events(spark, sf_dir).withColumn("created_at", F.col("ts") - F.expr("interval 1 day"))
    return scd.initial_scd1(df, _cfg(scd_type=1, created_at_column="created_at"))


@_query("scd0_incremental", _sql(_O1, _O2, f"s AS ({_one(_ORDERS, 'o_custkey', 'o_orderdate', 'b1', False)})", f"n AS ({_one(_ORDERS, 'o_custkey', 'o_orderdate', 'b2', False)})", of="SELECT * FROM s UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.o_custkey = n.o_custkey)"))
def _(spark, sf_dir):
    return _order_loads(spark, sf_dir, 0)


@_query("scd1_incremental", _sql(_O1, _O2, f"s AS ({_one(_ORDERS, 'o_custkey', 'o_orderdate', 'b1', True)})", f"n AS ({_one(_ORDERS, 'o_custkey', 'o_orderdate', 'b2', True)})", of=f"SELECT {', '.join('n.' + c for c in _ORDERS)}, coalesce(s._is_current, n._is_current) AS _is_current, coalesce(s._valid_from, n._valid_from) AS _valid_from, coalesce(s._valid_to, n._valid_to) AS _valid_to, coalesce(s._change_type, n._change_type) AS _change_type FROM n LEFT JOIN s ON s.o_custkey = n.o_custkey UNION ALL SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM n WHERE s.o_custkey = n.o_custkey)"))
def _(spark, sf_dir):
    return _order_loads(spark, sf_dir, 1)


# Joins through time

_TYPES = {"click": "clicked", "view": "viewed", "purchase": "bought"}


def _part(df: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    name = _TYPES[kind]
    own = df.where(F.col("event_type") == kind).select(*keys, "ts", F.floor("value").alias(f"{name}_value"), F.col("event_id").alias(f"{name}_id"))
    return scd.initial_scd2(own, ScdConfig(unique_key=keys, updated_at_column="ts", change_columns={"include": [f"{name}_value"]})).drop("ts")


def _part_sql(kind: str, keys: list[str]) -> tuple[str, str]:
    name = _TYPES[kind]
    rows = f"{name}_e AS (SELECT {', '.join(keys)}, ts, CAST(floor(value) AS BIGINT) AS {name}_value, event_id AS {name}_id FROM {{source}} WHERE event_type = '{kind}')"
    return rows, Sql([*keys, "ts", f"{name}_value", f"{name}_id"], keys, "ts", [f"{name}_value"]).initial(name, f"{name}_e")


def _join_sql(kinds: list[str], keys: list[str], rows: str = "events") -> str:
    k = ", ".join(keys)
    parts = [p.replace("{source}", rows) for kind in kinds for p in _part_sql(kind, keys)]
    names = [_TYPES[x] for x in kinds]
    points = " UNION ".join(f"SELECT {k}, _valid_from FROM {n}" for n in names)
    spine = f"spine AS (SELECT {k}, lead(1) OVER w IS NULL AS _is_current, _valid_from, coalesce(lead(_valid_from) OVER w, TIMESTAMP '{END}') AS _valid_to FROM ({points}) WINDOW w AS (PARTITION BY {k} ORDER BY _valid_from NULLS LAST))"
    joins = " ".join(f"LEFT JOIN {n} ON {' AND '.join(f'spine.{c} = {n}.{c}' for c in keys)} AND spine._valid_from >= {n}._valid_from AND spine._valid_to <= {n}._valid_to" for n in names)
    added = ", ".join(f"{n}.{n}_value, {n}.{n}_id" for n in names)
    return _sql(*([] if rows == "events" else [_BUCKETED]), *parts, spine, of=f"SELECT {', '.join('spine.' + c for c in keys)}, {added}, spine._is_current, spine._valid_from, spine._valid_to FROM spine {joins} WHERE spine._valid_from < spine._valid_to")


_BUCKETED = "bucketed AS (SELECT *, event_id % 3 AS bucket FROM events)"


@_query("scd2_join_2way", _join_sql(["click", "view"], ["user_id"]))
def _(spark, sf_dir):
    df = _events(spark, sf_dir)
    return temporal_join([_part(df, k, ["user_id"]) for k in ("click", "view")], ["user_id"])


@_query("scd2_join_3way", _join_sql(["click", "view", "purchase"], ["user_id"]))
def _(spark, sf_dir):
    df = _events(spark, sf_dir)
    return temporal_join([_part(df, k, ["user_id"]) for k in _TYPES], ["user_id"])


@_query("scd2_join_3way_fill", _join_sql(["click", "view", "purchase"], ["user_id"]))
def _(spark, sf_dir):
    df = _events(spark, sf_dir)
    return temporal_join([_part(df, k, ["user_id"]) for k in _TYPES], ["user_id"], method="fill")


@_query("scd2_join_composite", _join_sql(["click", "view"], ["user_id", "bucket"], "bucketed"))
def _(spark, sf_dir):
    df = _events(spark, sf_dir).withColumn("bucket", F.col("event_id") % 3)
    return temporal_join([_part(df, k, ["user_id", "bucket"]) for k in ("click", "view")], ["user_id", "bucket"])


# Sources


@_query("source_all", "SELECT * FROM events")
def _(spark, sf_dir):
    return source(_events(spark, sf_dir))


@_query("source_watermark", f"SELECT * FROM events WHERE ts > (SELECT coalesce(max(ts), TIMESTAMP '1900-01-01') FROM events WHERE ts < TIMESTAMP '{CUTOFF}')")
def _(spark, sf_dir):
    df = _events(spark, sf_dir)
    return source(df, "ts", _halves(df)[0].select(F.col("ts").alias("_loaded_at")))


@_query("source_run_cutoff", f"SELECT * FROM events WHERE ts <= TIMESTAMP '{RUN_START}'")
def _(spark, sf_dir):
    return source(_events(spark, sf_dir), "ts", run_started_at=datetime.fromisoformat(RUN_START + ".900000"))


@_query("source_both", f"SELECT * FROM events WHERE ts > (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '{CUTOFF}') AND ts <= TIMESTAMP '{RUN_START}'")
def _(spark, sf_dir):
    df = _events(spark, sf_dir)
    return source(df, "ts", _halves(df)[0], "ts", datetime.fromisoformat(RUN_START))


# Assertions, over a history that is damaged on purpose

_DAMAGED_SQL = f"""{_DELETED.initial('h', 'e').strip()},
t AS (SELECT user_id, event_id, deleted_at,
  CASE WHEN event_id % 11 = 0 THEN NOT _is_current WHEN event_id % 13 = 0 THEN NULL ELSE _is_current END AS _is_current,
  _valid_from,
  CASE WHEN event_id % 7 = 0 THEN _valid_to + INTERVAL 2 DAY WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN _valid_from ELSE _valid_to END AS _valid_to,
  CASE WHEN event_id % 5 = 0 THEN 'I' WHEN event_id % 23 = 0 THEN 'U' ELSE _change_type END AS _change_type FROM h)"""


def _damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = scd.initial_scd2(_events(spark, sf_dir).withColumn("deleted_at", _on_error()), _cfg(deleted_at_column="deleted_at"))
    every = lambda n: F.col("event_id") % n == 0
    return h.select(
        "user_id", "event_id", "deleted_at",
        F.when(every(11), ~F.col("_is_current")).when(every(13), F.lit(None)).otherwise(F.col("_is_current")).alias("_is_current"),
        "_valid_from",
        F.when(every(7), F.col("_valid_to") + F.expr("interval 2 days")).when(every(17), F.lit(None)).when(every(19), F.col("_valid_from")).otherwise(F.col("_valid_to")).alias("_valid_to"),
        F.when(every(5), "I").when(every(23), "U").otherwise(F.col("_change_type")).alias("_change_type"),
    )


def _dq(of: str) -> str:
    return _sql("e AS (SELECT *, CASE WHEN event_type = 'error' THEN ts END AS deleted_at FROM events)", _DAMAGED_SQL, of=of)


_W = "(PARTITION BY user_id ORDER BY _valid_from NULLS LAST)"
_LAGGED = f"(SELECT user_id, _valid_from, _change_type, lag(_change_type) OVER {_W} AS previous_change_type FROM t)"
_K = ["user_id"]

for _name, _check, _of in [
    ("dq_one_current_per_key", lambda t: assertions.one_current_per_key(t, _K), "SELECT user_id, count(*) AS current_count FROM t WHERE _is_current GROUP BY 1 HAVING count(*) <> 1"),
    ("dq_some_current_per_key", lambda t: assertions.some_current_per_key(t, _K), "SELECT user_id, count(*) FILTER (WHERE _is_current) AS current_count FROM t GROUP BY 1 HAVING count(*) FILTER (WHERE _is_current) <> 1"),
    ("dq_no_validity_overlaps", lambda t: assertions.no_validity_overlaps(t, _K), "SELECT a.user_id, a._valid_from AS valid_from_1, a._valid_to AS valid_to_1, b._valid_from AS valid_from_2, b._valid_to AS valid_to_2 FROM t a JOIN t b ON a.user_id = b.user_id AND a._valid_from < b._valid_to AND b._valid_from < a._valid_to AND a._valid_from <> b._valid_from"),
    ("dq_has_validity_overlap", lambda t: assertions.has_validity_overlap(t, _K).select("user_id", "_valid_from"), f"SELECT user_id, _valid_from FROM t QUALIFY _valid_from < max(_valid_to) OVER (PARTITION BY user_id ORDER BY _valid_from NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"),
    ("dq_continuous_validity_windows", lambda t: assertions.continuous_validity_windows(t, _K), f"SELECT user_id, _valid_from, _valid_to, lead(_valid_from) OVER {_W} AS next_valid_from FROM t QUALIFY _valid_to <> lead(_valid_from) OVER {_W}"),
    ("dq_latest_row_is_current", lambda t: assertions.latest_row_is_current(t, _K), "SELECT * FROM (SELECT user_id, _valid_from, _is_current FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY _valid_from DESC NULLS FIRST) = 1) WHERE _is_current <> true"),
    ("dq_first_record_not_update", lambda t: assertions.first_record_not_update(t, _K), f"SELECT * FROM (SELECT user_id, _valid_from, _change_type FROM t QUALIFY row_number() OVER {_W} = 1) WHERE _change_type = 'U'"),
    ("dq_insert_follows_delete", lambda t: assertions.insert_follows_delete(t, _K), f"SELECT * FROM {_LAGGED} WHERE previous_change_type = 'D' AND _change_type NOT IN ('I', 'D')"),
    ("dq_no_consecutive_inserts_or_deletes", lambda t: assertions.no_consecutive_inserts_or_deletes(t, _K), f"SELECT *, 'insert follows insert' AS violation_reason FROM {_LAGGED} WHERE previous_change_type = 'I' AND _change_type = 'I' UNION ALL SELECT *, 'update follows delete' FROM {_LAGGED} WHERE previous_change_type = 'D' AND _change_type = 'U'"),
    ("dq_no_records_after_deletion", lambda t: assertions.no_records_after_deletion(t.withColumn("_valid_from", F.when(F.col("event_id") % 3 == 0, F.col("_valid_from") + F.expr("interval 1 day")).otherwise(F.col("_valid_from"))), _K, "deleted_at"), "SELECT user_id, deleted_at, f AS _valid_from, _valid_to FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN _valid_from + INTERVAL 1 DAY ELSE _valid_from END AS f FROM t) WHERE deleted_at IS NOT NULL AND f <> deleted_at"),
    ("dq_all_records_current", lambda t: assertions.all_records_current(t), "SELECT * FROM t WHERE _is_current IS NULL OR NOT _is_current"),
    ("dq_valid_window_well_formed", lambda t: assertions.valid_window_well_formed(t), "SELECT * FROM t WHERE _valid_from IS NULL OR _valid_to IS NULL OR _valid_from >= _valid_to"),
    ("dq_born_deleted", lambda t: assertions.born_deleted(t, "user_id", [1, 2, 3]), "SELECT * FROM t WHERE user_id IN (1, 2, 3) AND NOT coalesce(_change_type = 'D' AND _valid_from = deleted_at AND _is_current, false)"),
    ("dq_unique", lambda t: assertions.unique(t, "_valid_to"), "SELECT _valid_to, count(*) AS n_records FROM t WHERE _valid_to IS NOT NULL GROUP BY 1 HAVING count(*) > 1"),
    ("dq_not_null", lambda t: assertions.not_null(t, "_valid_to"), "SELECT * FROM t WHERE _valid_to IS NULL"),
]:
    _query(_name, _dq(_of))(lambda spark, sf_dir, check=_check: check(_damaged(spark, sf_dir)))


_SNAPSHOT = ["user_id", "_valid_from", "_valid_to", "_change_type"]
_DIFF = f"SELECT *, 'unexpected' AS _problem FROM (SELECT {', '.join(_SNAPSHOT)} FROM {{a}} EXCEPT SELECT {', '.join(_SNAPSHOT)} FROM {{b}}) UNION ALL SELECT *, 'missing' FROM (SELECT {', '.join(_SNAPSHOT)} FROM {{b}} EXCEPT SELECT {', '.join(_SNAPSHOT)} FROM {{a}})"


@_query("dq_matches_expected", _sql(_B1, _HISTORY.initial("s", "b1"), _HISTORY.initial("t", "events"), of=_DIFF.format(a="t", b="s")))
def _(spark, sf_dir):
    df = _events(spark, sf_dir)
    return assertions.matches_expected(scd.initial_scd2(df, _cfg()), scd.initial_scd2(_halves(df)[0], _cfg()), _SNAPSHOT)


@_query("table_diff_full_vs_incremental", _sql(_B1, _B2, _HISTORY.initial("s", "b1"), _HISTORY.incremental("i", "s", "b2"), _HISTORY.initial("t", "events"), of=_DIFF.format(a="i", b="t")))
def _(spark, sf_dir):
    df = _events(spark, sf_dir)
    return assertions.matches_expected(_two_loads(df, _cfg(), _halves), scd.initial_scd2(df, _cfg()), _SNAPSHOT)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql is not None}
