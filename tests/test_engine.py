"""Type 0 to 2 loads over small change logs with known outcomes."""

import warnings
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from palimpsest import ConfigError, ScdConfig
from palimpsest.operators import assertions as dq
from palimpsest.operators import scd

CUSTOMER = "customer_id int, customer_name string, email string, status string, deleted_at timestamp, _updated_at timestamp"


def ts(text):
    return datetime.strptime(f"2024-{text}" + (":00" if text.count(":") == 1 else ""), "%Y-%m-%d %H:%M:%S") if text else None


JD, JS, BW, AB, CD, DE, EF, FL, MD = "John Doe", "Jane Smith", "Bob Wilson", "Alice Brown", "Charlie Davis", "Diana Evans", "Edward Foster", "Full Lifecycle", "Multi Delete"
# fixed values: the change log's batches, as (times, id, name, mail, status, deleted at, updated at)
BATCHES = [
    [
        (1, 1, JD, "john@", "ACTIVE", None, "01-01 10:00"), (1, 1, JD, "john@", "INACTIVE", None, "01-01 09:00"), (1, 10, MD, "multidelete@", "ACTIVE", None, "01-01 10:00"),
        (16, 2, JS, "jane@", "ACTIVE", None, "01-01 10:00"), (1, 3, BW, "bob@", "INACTIVE", None, "01-01 10:00"), (1, 9, FL + " Resurrected", "lifecycle@", "ACTIVE", None, "01-01 09:30"),
        (1, 9, FL + " Updated", "lifecycle@", "ACTIVE", None, "01-01 08:30"), (1, 9, FL + " Updated", "lifecycle@", "ACTIVE", "01-01 09:00", "01-01 09:00"), (1, 9, FL, "lifecycle@", "ACTIVE", None, "01-01 08:00"),
    ],
    [
        (1, 1, JD + " Jr", "john.doe.final@", "INACTIVE", None, "01-04 10:00"), (1, 1, JD, "john.updated@", "ACTIVE", None, "01-02 10:00"), (1, 10, MD, "multidelete@", "ACTIVE", "01-02 10:00", "01-02 10:00"),
        (1, 2, JS, "jane@", "INACTIVE", None, "01-01 11:00"), (1, 3, BW, "bob@", "ACTIVE", None, "01-02 10:00"), (1, 4, AB, "alice@", "ACTIVE", None, "01-02 10:00"),
    ],
    [
        (1, 1, JD + " Jr", "john.doe.new@", "ACTIVE", "01-03 10:00", "01-03 10:00"), (1, 10, MD, "multidelete@", "ACTIVE", "01-03 10:00", "01-03 10:00"), (1, 2, JS, "jane@", "ACTIVE", None, "01-03 10:00"),
        (1, 4, AB, "alice.brown@", "INACTIVE", None, "01-03 10:00"), (1, 5, CD, "charlie@", "ACTIVE", None, "01-03 10:00"),
    ],
    [
        (29, 1, JD + " Jr", "john.doe.temp@", "ACTIVE", None, "01-04 09:00"), (1, 3, BW, "bob.wilson.updated@", "ACTIVE", "01-04 10:00", "01-04 10:00"), (1, 5, CD, "charlie.davis@", "INACTIVE", None, "01-04 10:00"),
        (1, 6, DE, "diana@", "ACTIVE", None, "01-04 10:00"),
    ],
    [
        (1, 1, JD, "late.john@", "INACTIVE", None, "01-03 10:00:01"), (1, 2, JS, "jane.retroactive@", "INACTIVE", None, "01-04 15:00"), (1, 2, JS + "-Johnson", "jane.married@", "ACTIVE", None, "01-05 10:00"),
        (1, 4, AB, "alice.brown.new@", "ACTIVE", None, "01-05 10:00"), (1, 6, DE, "diana.evans@", "INACTIVE", None, "01-05 10:00"), (1, 7, EF, "edward@", "ACTIVE", None, "01-05 10:00"),
    ],
    [(1, i, n, f"{n.split()[0].lower()}.backfill@", "ACTIVE", None, "01-01 08:00") for i, n in enumerate([JD, JS, BW, AB, CD, DE, EF], 1)],
]
FINAL = {
    1: "01-01 08:00 I · 01-01 09:00 U · 01-01 10:00 U · 01-02 10:00 U · 01-03 10:00 D · 01-03 10:00:01 I · 01-04 09:00 U · 01-04 10:00 U",
    2: "01-01 08:00 I · 01-01 10:00 U · 01-01 11:00 U · 01-03 10:00 U · 01-04 15:00 U · 01-05 10:00 U",
    3: "01-01 08:00 I · 01-01 10:00 U · 01-02 10:00 U · 01-04 10:00 D",
    4: "01-01 08:00 I · 01-02 10:00 U · 01-03 10:00 U · 01-05 10:00 U",
    5: "01-01 08:00 I · 01-03 10:00 U · 01-04 10:00 U",
    6: "01-01 08:00 I · 01-04 10:00 U · 01-05 10:00 U",
    7: "01-01 08:00 I · 01-05 10:00 U",
    9: "01-01 08:00 I · 01-01 08:30 U · 01-01 09:00 D · 01-01 09:30 I",
    10: "01-01 10:00 I · 01-02 10:00 D · 01-03 10:00 D",
}


def batch(spark, k):
    rows = [(i, n, m + "example.com", s, ts(d), ts(u)) for times, i, n, m, s, d, u in BATCHES[k - 1] for _ in range(times)]
    return spark.createDataFrame(rows, CUSTOMER).selectExpr("*", "_updated_at as _created_at", "current_timestamp() as _written_at")


def fixed(df):
    """The rows of ``df`` without its plan, so that plans don't grow from load to load."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


CONFIG = dict(unique_key=["customer_id"], created_at_column="_created_at", deleted_at_column="deleted_at", change_columns={"exclude": ["_written_at"]})


def test_change_log_step_by_step(spark):
    cfg = ScdConfig(**CONFIG)
    table = fixed(scd.initial_scd2(batch(spark, 1), cfg))
    counts = [table.count()]
    for k in range(1, 7):
        table = fixed(scd.incremental_scd2(table, batch(spark, k), cfg))
        counts.append(table.count())
        keys = ["customer_id"]
        for violations in (dq.one_current_per_key(table, keys), dq.continuous_validity_windows(table, keys), dq.first_record_not_update(table, keys), dq.no_consecutive_inserts_or_deletes(table, keys), dq.valid_window_well_formed(table), dq.no_validity_overlaps(table, keys), dq.latest_row_is_current(table, keys), dq.insert_follows_delete(table, keys)):
            assert dq.holds(violations)
    assert counts == [9, 9, 15, 20, 24, 30, 37]
    got = {}
    for r in table.orderBy("customer_id", "_valid_from").collect():
        got.setdefault(r.customer_id, []).append((r._valid_from, r._change_type))
    assert got == {k: [(ts(x.rsplit(" ", 1)[0]), x.rsplit(" ", 1)[1]) for x in v.split(" · ")] for k, v in FINAL.items()}
    last = table.where("_is_current").collect()
    assert len(last) == 9 and all(r._valid_to == datetime(2999, 12, 31, 23, 59, 59) for r in last)


def test_types_0_and_1(spark):
    rows = lambda df: {(r.customer_id, r.customer_name, r.email.split("@")[0], r.status, r._valid_from.strftime("%d %H:%M")) for r in df.collect()}
    expected = {
        0: {(1, JD, "john", "INACTIVE", "01 09:00"), (2, JS, "jane", "ACTIVE", "01 10:00"), (3, BW, "bob", "INACTIVE", "01 10:00"), (4, AB, "alice", "ACTIVE", "02 10:00"), (9, FL, "lifecycle", "ACTIVE", "01 08:00"), (10, MD, "multidelete", "ACTIVE", "01 10:00")},
        1: {(1, JD + " Jr", "john.doe.final", "INACTIVE", "01 10:00"), (2, JS, "jane", "INACTIVE", "01 10:00"), (3, BW, "bob", "ACTIVE", "01 10:00"), (4, AB, "alice", "ACTIVE", "02 10:00"), (9, FL + " Resurrected", "lifecycle", "ACTIVE", "01 09:30"), (10, MD, "multidelete", "ACTIVE", "01 10:00")},
    }
    for kind, want in expected.items():
        cfg = ScdConfig(unique_key=["customer_id"], scd_type=kind, created_at_column="_created_at")
        plain = lambda k: batch(spark, k).drop("deleted_at", "_written_at")
        table = scd.apply_incremental(scd.apply_initial(plain(1), cfg), plain(2), cfg)
        assert rows(table) == want
        assert dq.holds(dq.all_records_current(table)) and dq.holds(dq.unique(table, "customer_id")) and dq.holds(dq.not_null(table, "customer_id"))


def test_born_deleted(spark):
    schema = "customer_id int, status string, deleted_at timestamp, _created_at timestamp, _updated_at timestamp"
    day = lambda m, d=1: datetime(2024, m, d)
    one = [(100, "INACTIVE", day(2), day(1), day(3)), (102, "INACTIVE", day(2, 10), day(1, 10), day(2, 10)), (102, "ACTIVE", None, day(1, 10), day(4, 10))]
    cfg = ScdConfig(unique_key=["customer_id"], created_at_column="_created_at", deleted_at_column="deleted_at")
    table = scd.incremental_scd2(scd.initial_scd2(spark.createDataFrame(one, schema), cfg), spark.createDataFrame([*one, (101, "INACTIVE", day(5), day(4), day(6))], schema), cfg)
    got = {(r.customer_id, r._valid_from, r._valid_to.year > 2900, r._change_type, r._is_current) for r in table.collect()}
    assert got == {(100, day(2), True, "D", True), (101, day(5), True, "D", True), (102, day(2, 10), False, "D", False), (102, day(4, 10), True, "I", True)}
    assert dq.holds(dq.born_deleted(table, "customer_id", [100, 101]))


def test_out_of_order_backfill(spark):
    schema = "k int, v string, _created_at timestamp, _updated_at timestamp"
    first, late = ([(99, "same", datetime(2024, 1, d, 10), datetime(2024, 1, d, 10))] for d in (10, 5))
    for collapse, want in ((True, [(5, True, "I")]), (False, [(5, False, "I"), (10, True, "U")])):
        cfg = ScdConfig(unique_key=["k"], created_at_column="_created_at", change_columns={"exclude": ["_created_at"]}, collapse_redundant_versions=collapse)
        table = scd.incremental_scd2(scd.initial_scd2(spark.createDataFrame(first, schema), cfg), spark.createDataFrame(late, schema), cfg)
        assert [(r._valid_from.day, r._is_current, r._change_type) for r in table.orderBy("_valid_from").collect()] == want


def test_null_in_the_key(spark):
    schema = "customer_id int, region string, status string, _updated_at timestamp"
    d = lambda n: datetime(2024, 1, n)
    cfg = ScdConfig(unique_key=["customer_id", "region"])
    table = scd.initial_scd2(spark.createDataFrame([(1, None, "active", d(1)), (2, "US", "active", d(1))], schema), cfg)
    table = scd.incremental_scd2(table, spark.createDataFrame([(1, None, "suspended", d(2)), (2, "US", "active", d(1))], schema), cfg)
    got = {(r.customer_id, r.region, r.status, r._valid_from.day, r._is_current, r._change_type) for r in table.collect()}
    assert got == {(1, None, "active", 1, False, "I"), (1, None, "suspended", 2, True, "U"), (2, "US", "active", 1, True, "I")}


def test_null_keys_of_types_0_and_1_match_only_on_request(spark):
    rows = spark.createDataFrame([(None, "a", datetime(2024, 1, 1))], "k int, v string, _updated_at timestamp")
    for kind in (0, 1):
        for safe, n in ((False, 2), (True, 1)):
            cfg = ScdConfig(unique_key=["k"], scd_type=kind, null_safe_keys=safe)
            assert scd.apply_incremental(scd.apply_initial(rows, cfg), rows, cfg).count() == n


def test_stale_valid_from(spark):
    schema = "k int, v string, cr timestamp, _updated_at timestamp"
    d = lambda n: datetime(2024, 1, n)
    for recompute, want in ((False, {("a", 1, True), ("b", 1, False)}), (True, {("b", 1, False), ("a", 10, True)})):
        cfg = ScdConfig(unique_key=["k"], created_at_column="cr", change_columns={"include": ["v"]}, recompute_valid_from=recompute)
        table = scd.incremental_scd2(scd.initial_scd2(spark.createDataFrame([(1, "a", d(1), d(10))], schema), cfg), spark.createDataFrame([(1, "b", d(1), d(5))], schema), cfg)
        assert {(r.v, r._valid_from.day, r._is_current) for r in table.collect()} == want
        assert dq.holds(dq.has_validity_overlap(table, ["k"])) == recompute


def test_repeat_observations_do_not_come_back(spark):
    """A@1 A@5 (dropped), then B@3: a full refresh has A@5 again, the incremental run cannot."""
    schema = "k int, v string, _updated_at timestamp"
    d = lambda n: datetime(2024, 1, n)
    cfg = ScdConfig(unique_key=["k"])
    one, two = spark.createDataFrame([(1, "A", d(1)), (1, "A", d(5))], schema), spark.createDataFrame([(1, "B", d(3))], schema)
    assert scd.incremental_scd2(scd.initial_scd2(one, cfg), two, cfg).count() == 2
    assert scd.initial_scd2(one.union(two), cfg).count() == 3


def test_resent_version_keeps_stored_content(spark):
    schema = "k int, v string, _updated_at timestamp"
    cfg = ScdConfig(unique_key=["k"])
    at = datetime(2024, 1, 1)
    table = scd.incremental_scd2(scd.initial_scd2(spark.createDataFrame([(1, "z", at)], schema), cfg), spark.createDataFrame([(1, "a", at)], schema), cfg)
    assert [r.v for r in table.collect()] == ["z"]


def test_incremental_predicates(spark):
    schema = "k int, v string, _updated_at timestamp"
    d = lambda n: datetime(2024, 1, n)
    cfg = ScdConfig(unique_key=["k"], incremental_predicates=["DEST.v <> 'old'"])
    first = scd.initial_scd2(spark.createDataFrame([(1, "old", d(1)), (1, "new", d(2)), (2, "x", d(1))], schema), cfg)
    table = scd.incremental_scd2(first, spark.createDataFrame([(1, "newer", d(3))], schema), cfg)
    assert sorted((r.k, r.v, r._is_current) for r in table.collect()) == [(1, "new", False), (1, "newer", True), (1, "old", False), (1, "old", False), (2, "x", True)]
    plain = ScdConfig(unique_key=["k"], incremental_predicates=["1 = 1"])
    both = [scd.incremental_scd2(first, spark.createDataFrame([(1, "newer", d(3)), (1, "new", d(1))], schema), c) for c in (plain, ScdConfig(unique_key=["k"]))]
    assert dq.holds(dq.matches_expected(*both, both[0].columns))


def test_maps_and_case(spark):
    rows = [(1, {"a": 1, "b": 2}, datetime(2024, 1, 1)), (1, {"b": 2, "a": 1}, datetime(2024, 1, 2)), (1, {"b": 3}, datetime(2024, 1, 3))]
    df = spark.createDataFrame(rows, "K int, M map<string,int>, _UPDATED_AT timestamp")
    assert scd.initial_scd2(df, ScdConfig(unique_key=["k"])).count() == 2


def test_empty_batches(spark):
    schema = "k int, v string, _updated_at timestamp"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([(1, "a", datetime(2024, 1, 1))], schema)
    for kind in (0, 1, 2):
        cfg = ScdConfig(unique_key=["k"], scd_type=kind)
        assert scd.apply_initial(none, cfg).count() == 0
        assert scd.apply_incremental(scd.apply_initial(one, cfg), none, cfg).count() == 1
        assert scd.apply_incremental(scd.apply_initial(none, cfg), one, cfg).count() == 1


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 3), st.sampled_from("abc"), st.booleans()), min_size=1, max_size=18))
def test_in_order_batches_equal_a_full_refresh(spark, log):
    rows = [(k, v, datetime(2024, 1, 1 + i), datetime(2024, 1, 1 + i) if d else None) for i, (k, v, d) in enumerate(log)]
    schema = "k int, v string, _updated_at timestamp, deleted_at timestamp"
    cfg = ScdConfig(unique_key=["k"], deleted_at_column="deleted_at")
    cut = len(rows) // 2
    parts = [spark.createDataFrame(r, schema) for r in (rows[:cut], rows[cut:])]
    table = scd.incremental_scd2(scd.initial_scd2(parts[0], cfg), parts[1], cfg)
    full = scd.initial_scd2(spark.createDataFrame(rows, schema), cfg)
    assert sorted(map(str, table.collect())) == sorted(map(str, full.collect()))


@pytest.mark.parametrize(
    "settings_, message",
    [
        (dict(unique_key=["k"], scd_type=3), "scd_type must be 0, 1 or 2"),
        (dict(unique_key=["k"], scd_type="x"), "scd_type must be 0, 1 or 2"),
        (dict(unique_key=["k"], scd_type=1, deleted_at_column="d"), "deletion tracking is not supported for SCD types 0 and 1"),
        (dict(unique_key=None), "unique_key is missing or empty"),
        (dict(unique_key=[]), "unique_key is missing or empty"),
        (dict(unique_key="k"), "takes a list of column names"),
    ],
)
def test_bad_settings(settings_, message):
    with pytest.raises(ConfigError, match=message):
        ScdConfig(**settings_)


def test_bad_columns(spark):
    df = spark.createDataFrame([(1, "a", datetime(2024, 1, 1))], "k int, v string, _updated_at timestamp")
    for more, message in ((dict(created_at_column="cr"), "which the rows lack"), (dict(change_columns={"include": ["k"]}), "no column is left"), (dict(updated_at_column="u"), "the rows lack column")):
        with pytest.raises(ConfigError, match=message):
            scd.initial_scd2(df, ScdConfig(**({"unique_key": ["k"]} | more)))
    table = scd.initial_scd2(df, ScdConfig(unique_key=["k"]))
    with pytest.raises(ConfigError, match="columns that the target lacks"):
        scd.incremental_scd2(table, df.selectExpr("*", "1 as more"), ScdConfig(unique_key=["k"]))


def test_warnings(spark):
    with pytest.warns(UserWarning, match="several versions of change type I"):
        ScdConfig(unique_key=["k"], update_all_previous_records=False)
    df = spark.sql("select 1 as k, 'a' as v, date '2024-01-01' as _updated_at")
    with pytest.warns(UserWarning, match="TIMESTAMP is recommended"):
        scd.initial_scd2(df, ScdConfig(unique_key=["k"])).collect()


def test_settings_resolve_in_order():
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        cfg = ScdConfig.resolve({"unique_key": ["k"], "scd_type": 1, "updated_at_column": "u", "meta": {"scd_type": 0}, "default_valid_to": "ignored"}, {"valid_to_column": "until", "default_valid_to": "2100-01-01 00:00:00"})
    assert (cfg.scd_type, cfg.updated_at_column, cfg.valid_to_column, cfg.default_valid_to) == (0, "u", "until", "2100-01-01 00:00:00")
    assert ScdConfig.resolve({"unique_key": ["k"]}, scd_type=2).is_current_column == "_is_current"


def test_plan_has_one_exchange(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    out = scd.initial_scd2(df, ScdConfig(unique_key=["user_id"], updated_at_column="ts", change_columns={"include": ["event_type"]}))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange SinglePartition" not in plan
