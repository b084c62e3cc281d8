"""Joins through time, sources, the store, tables, streams, helpers, and the driver's entry points."""

from datetime import datetime

import pytest

from palimpsest import ConfigError, ScdConfig, ScdTable
from palimpsest.functions import lists
from palimpsest.operators import assertions as dq
from palimpsest.operators import scd
from palimpsest.operators.temporal_join import temporal_join
from palimpsest.sources.filters import seed, source
from palimpsest.sources.store import ConcurrentWrite, VersionedTable
from palimpsest.streaming.batches import stream_into


def d(n):
    return datetime(2024, 1, n)


def history(spark, rows, schema, keys):
    return scd.initial_scd2(spark.createDataFrame(rows, schema + ", _updated_at timestamp"), ScdConfig(unique_key=keys))


@pytest.fixture(scope="module")
def sides(spark):
    customers = history(spark, [(1, "alice@old.com", d(1)), (1, "alice@new.com", d(15)), (2, "bob@email.com", d(5))], "customer_id int, email string", ["customer_id"])
    addresses = history(spark, [(1, "NYC", d(1)), (1, "Boston", d(10)), (2, "Chicago", d(5)), (2, "Seattle", d(20))], "customer_id int, city string", ["customer_id"])
    ratings = history(spark, [(1, "A", 750, d(1)), (1, "A", 780, d(12)), (1, "B", 680, d(18)), (2, "B", 650, d(5)), (2, "A", 720, d(25))], "customer_id int, rating string, score int", ["customer_id"])
    return [customers, addresses, ratings]


@pytest.mark.parametrize("method", ["range", "fill", "auto"])
def test_three_way_join(sides, method):
    out = temporal_join(sides, ["customer_id"], method=method)
    assert out.columns == ["customer_id", "email", "city", "rating", "score", "_is_current", "_valid_from", "_valid_to"]
    got = [(r.customer_id, r.email.split("@")[1][:3], r.city, r.rating, r.score, r._valid_from.day, r._valid_to.day, r._is_current) for r in out.orderBy("customer_id", "_valid_from").collect()]
    assert got == [
        (1, "old", "NYC", "A", 750, 1, 10, False), (1, "old", "Boston", "A", 750, 10, 12, False), (1, "old", "Boston", "A", 780, 12, 15, False),
        (1, "new", "Boston", "A", 780, 15, 18, False), (1, "new", "Boston", "B", 680, 18, 31, True),
        (2, "ema", "Chicago", "B", 650, 5, 20, False), (2, "ema", "Seattle", "B", 650, 20, 25, False), (2, "ema", "Seattle", "A", 720, 25, 31, True),
    ]
    for violations in (dq.one_current_per_key(out, ["customer_id"]), dq.no_validity_overlaps(out, ["customer_id"]), dq.continuous_validity_windows(out, ["customer_id"])):
        assert dq.holds(violations)


@pytest.mark.parametrize("method", ["range", "fill"])
def test_composite_join_with_a_missing_side(spark, method):
    orders = history(spark, [(1, 100, "pending", d(2)), (1, 100, "processing", d(3)), (1, 100, "shipped", d(5)), (3, 300, "alone", d(1)), (None, 1, "null", d(1))], "customer_id int, order_id int, status string", ["customer_id", "order_id"])
    items = history(spark, [(1, 100, 2, d(2)), (1, 100, 3, d(4))], "customer_id int, order_id int, quantity int", ["customer_id", "order_id"])
    out = temporal_join([orders, items], ["customer_id", "order_id"], method=method)
    got = [(r.customer_id, r.status, r.quantity, r._valid_from.day) for r in out.orderBy("customer_id", "_valid_from").collect()]
    assert got == [(None, None, None, 1), (1, "pending", 2, 2), (1, "processing", 2, 3), (1, "processing", 3, 4), (1, "shipped", 3, 5), (3, "alone", None, 1)]


def test_auto_sees_fan_out(spark, sides):
    several = history(spark, [(1, 1, "a", d(1)), (1, 2, "b", d(1)), (1, 2, "c", d(4))], "customer_id int, line int, item string", ["customer_id", "line"])
    got = {m: sorted(map(str, temporal_join([sides[0], several], ["customer_id"], method=m).collect())) for m in ("range", "auto")}
    assert got["range"] == got["auto"] and any("line=1" in r for r in got["auto"]) and any("line=2" in r for r in got["auto"])


def test_join_refuses_shared_names(sides):
    with pytest.raises(ConfigError, match="EMAIL"):
        temporal_join([sides[0], sides[0]], ["customer_id"])


def test_sources(spark, tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text("order_id,loaded_at\n1,2024-01-01 10:00:00\n2,2024-01-02 11:00:00\n3,2024-01-03 09:00:00\n4,\n")
    df = seed(spark, str(path), "order_id int, loaded_at timestamp")
    ids = lambda x: sorted(r.order_id for r in x.collect())
    assert ids(source(df)) == [1, 2, 3, 4]
    assert ids(source(df, "loaded_at")) == [1, 2, 3, 4]
    target = spark.sql("select timestamp '2024-01-02 11:00:00' as _loaded_at")
    assert ids(source(df, "loaded_at", target)) == [3]
    assert ids(source(df, "loaded_at", target.limit(0))) == [1, 2, 3]
    assert ids(source(df, "loaded_at", run_started_at=datetime(2024, 1, 2, 11, 0, 0, 999))) == [1, 2]
    with pytest.raises(ConfigError, match="_loaded_at"):
        source(df, "loaded_at", df)


def test_store(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert not table.exists()
    for n in (1, 2, 3):
        assert table.write(spark.range(n)) == n
    assert table.read().count() == 3 and table.read(1).count() == 1
    with pytest.raises(ConcurrentWrite):
        table.write(spark.range(9), after=2)
    assert table.read().count() == 3
    table.vacuum(keep=1)
    assert table.read(1).count() == 1  # readers of it may still run
    table.vacuum(keep=1, retain_hours=0)
    assert table.version() == 3 and table.read().count() == 3
    with pytest.raises(Exception):  # noqa: B017
        table.read(1)
    assert len([d for d in (tmp_path / "t" / "data").iterdir() if not d.name.startswith(".")]) == 1
    with pytest.raises(FileNotFoundError):
        VersionedTable(spark, str(tmp_path / "none")).read()


def files_of(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_a_merge_writes_the_buckets_of_its_keys_alone(spark, tmp_path):
    schema = "k int, v string, _updated_at timestamp"
    table = ScdTable(spark, str(tmp_path / "t"), ScdConfig(unique_key=["k"]), buckets=8)
    table.apply(spark.createDataFrame([(k, "a", d(1)) for k in range(200)], schema))
    first, parts = files_of(tmp_path / "t"), table.store.manifest()["parts"]
    table.apply(spark.createDataFrame([(7, "b", d(2))], schema))
    now = table.store.manifest()["parts"]
    changed = [b for b in now if now[b] != parts.get(b)]
    written = {f for f in files_of(tmp_path / "t") if f not in first}
    assert len(parts) == 8 and len(changed) == 1 and len(written) == 1 and f"__bucket={changed[0]}" in written.pop()
    assert table.read().count() == 201 and table.read(1).count() == 200
    assert sorted(r.v for r in table.read().where("k = 7").collect()) == ["a", "b"]
    whole = scd.apply_incremental(scd.apply_initial(spark.createDataFrame([(k, "a", d(1)) for k in range(200)], schema), table.config), spark.createDataFrame([(7, "b", d(2))], schema), table.config)
    assert sorted(map(str, whole.collect())) == sorted(map(str, table.read().collect()))
    # dealt out otherwise: written anew as a whole, once
    other = ScdTable(spark, str(tmp_path / "t"), table.config, buckets=4)
    assert other.apply(spark.createDataFrame([(7, "c", d(3))], schema)).count() == 202 and len(table.store.manifest()["parts"]) == 4


def test_keys_that_are_equal_share_a_bucket(spark, tmp_path):
    for keys, kind in (([0.0, -0.0, None], "double"), (["a", None], "string"), ([1, None], "int")):
        table = ScdTable(spark, str(tmp_path / kind), ScdConfig(unique_key=["k"]), buckets=16)
        for n, k in enumerate([*keys, *keys], 1):
            table.apply(spark.createDataFrame([(k, f"v{n}", d(n))], f"k {kind}, v string, _updated_at timestamp"))
        assert table.read().where("_is_current").count() == 2


def test_a_writer_that_dies_leaves_the_table_readable(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.write(spark.range(3))

    def die(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(table, "_claim", die)
    with pytest.raises(KeyboardInterrupt):
        table.write(spark.range(5))
    again = VersionedTable(spark, str(tmp_path / "t"))
    (tmp_path / "t" / "versions" / ".aside").write_text("{")  # a manifest that was never moved to its name
    assert again.read().count() == 3 and again.write(spark.range(7)) == 2 and again.read().count() == 7
    again.vacuum(retain_hours=0)
    assert again.read().count() == 7 and again.read(1).count() == 3
    empty = VersionedTable(spark, str(tmp_path / "e"))
    empty.write(spark.range(0))
    assert empty.read().count() == 0 and empty.read().columns == ["id"]


def test_header_and_comments(spark, tmp_path):
    schema = "k int, v string, _updated_at timestamp"
    batch = spark.createDataFrame([(1, "a", d(1))], schema)
    table = ScdTable(spark, str(tmp_path / "t"), ScdConfig(unique_key=["k"]), comments={"v": "a value"}, sql_header=["set palimpsest.test = seen"])
    table.apply(batch)
    assert spark.conf.get("palimpsest.test") == "seen"
    assert VersionedTable(spark, str(tmp_path / "t")).read().schema["v"].metadata == {"comment": "a value"}


def test_table_runs_hooks_and_keeps_its_contract(spark, tmp_path):
    seen = []
    schema = "k int, v string, _updated_at timestamp"
    table = ScdTable(spark, str(tmp_path / "t"), ScdConfig(unique_key=["k"]), post_hooks=[lambda t: seen.append(t.store.version())], comments={"v": "a value"})
    assert not table.is_incremental()
    table.apply(spark.createDataFrame([(1, "a", d(1))], schema))
    assert table.is_incremental() and table.is_incremental_scd2() and not table.is_incremental(full_refresh=True)
    assert table.apply(spark.createDataFrame([(1, "b", d(2))], schema)).count() == 2
    assert table.apply(spark.createDataFrame([(1, "c", d(3))], schema), full_refresh=True).count() == 1
    assert seen == [1, 2, 3] and table.read().schema["v"].metadata["comment"] == "a value"
    wrong = ScdTable(spark, str(tmp_path / "u"), ScdConfig(unique_key=["k"]), contract=spark.createDataFrame([], "k string").schema)
    with pytest.raises(ConfigError, match="breaks its contract"):
        wrong.apply(spark.createDataFrame([(1, "a", d(1))], schema))


def test_table_reads_what_is_new(spark, tmp_path):
    schema = "k int, v string, _updated_at timestamp, _loaded_at timestamp"
    rows = spark.createDataFrame([(1, "a", d(1), d(1)), (2, "b", d(1), d(3)), (3, "c", d(1), d(9)), (4, "d", d(1), None)], schema)
    plain = {"unique_key": ["k"], "scd_type": 0, "change_columns": {"exclude": ["_loaded_at"]}}
    table = ScdTable.incremental_scd2(spark, str(tmp_path / "t"), plain, {"exclude_data_after_run_start": True})
    assert table.config.scd_type == 2
    table.apply(table.source(rows, "_loaded_at", run_started_at=d(2)))
    assert [r.k for r in table.read().collect()] == [1]
    assert [r.k for r in table.source(rows, "_loaded_at", run_started_at=d(5)).collect()] == [2]
    assert table.source(rows, "_loaded_at", run_started_at=d(5), full_refresh=True).count() == 2
    assert table.source(rows).count() == 4


def test_stream(spark, tmp_path):
    schema = "k int, v string, _updated_at timestamp"
    rows = [[(1, "a", d(1)), (2, "x", d(1))], [(1, "b", d(2))]]
    table = ScdTable(spark, str(tmp_path / "t"), ScdConfig(unique_key=["k"]))
    for part in rows:
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        query = stream_into(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), table, str(tmp_path / "checkpoint"))
        query.awaitTermination(60)
        query.stop()
    assert sorted((r.k, r.v, r._is_current) for r in table.read().collect()) == [(1, "a", False), (1, "b", True), (2, "x", True)]


def test_assertions_see_what_they_should(spark):
    rows = [(1, "I", True, d(1), d(5)), (1, "I", True, d(3), d(9)), (2, "D", False, d(1), d(2)), (2, "U", None, d(2), d(2)), (3, "U", True, d(1), None)]
    df = spark.createDataFrame(rows, "k int, _change_type string, _is_current boolean, _valid_from timestamp, _valid_to timestamp")
    n = lambda x: x.count()
    assert n(dq.one_current_per_key(df, ["k"])) == 1 and n(dq.some_current_per_key(df, ["k"])) == 2
    assert n(dq.no_validity_overlaps(df, ["k"])) == 2 and n(dq.has_validity_overlap(df, ["k"])) == 1
    assert n(dq.continuous_validity_windows(df, ["k"])) == 1 and n(dq.latest_row_is_current(df, ["k"])) == 0
    assert n(dq.first_record_not_update(df, ["k"])) == 1 and n(dq.insert_follows_delete(df, ["k"])) == 1
    assert sorted(r.violation_reason for r in dq.no_consecutive_inserts_or_deletes(df, ["k"]).collect()) == ["insert follows insert", "update follows delete"]
    assert n(dq.all_records_current(df)) == 2 and n(dq.valid_window_well_formed(df)) == 2
    assert n(dq.matches_expected(df, df.limit(0), ["k"])) == 3


def test_list_helpers():
    assert lists.list_union(["a", "B"], ["b", "c"], case_insensitive=True) == ["a", "B", "c"]
    assert lists.list_union([["a"], ["b"]]) == ["a", "b"] and lists.list_union(["a", "b"]) == ["a", "b"]
    assert lists.list_intersection(["a", "b", "b"], ["b", "c"]) == ["b"] and lists.list_intersection(["A", "b"], ["a"], case_insensitive=True) == ["A"]
    assert lists.list_difference(["a", "b", "a"], ["B"]) == ["a", "b"] and lists.list_difference(["a", "b"], ["B"], case_insensitive=True) == ["a"]
    assert lists.prefix_array_elements(["a"], "x.") == ["x.a"] and lists.quoted_csv(["a", "b"], "t") == "t.a, t.b"
    for wrong, message in (("ab", "expects an array of strings"), ([1], "all array elements to be strings")):
        with pytest.raises(ValueError, match=message):
            lists.prefix_array_elements(wrong, "x")
    assert lists.get_from_object({"a": [1, {"b": 2}]}, "a", 1, "b") == 2 and lists.get_from_object({"a": [1]}, "a", -1, default=0) == 0
    assert lists.get_config_value({"meta": {"x": 1}, "x": 2}, "x") == 1 and lists.get_config_value({}, "x", 3) == 3
    assert lists.is_array(["a"]) and not lists.is_array("a") and not lists.is_array({"a": 1})


def test_entry_points(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_queries_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from palimpsest import queries, table_queries  # noqa: F401

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("events", "orders"):
        con.execute(f"create view {table} as select * from read_parquet('{sf}/{table}.parquet')")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, sf), con.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(columns), name
        assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want.fetchall())), name
