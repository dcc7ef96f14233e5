"""SQLite tables by ranges of rowids, with their odd cells."""

from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from querent.sources import sqlite, sqlite_table

ROWS = 1000


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    out = str(tmp_path_factory.mktemp("sqlite") / "own.sqlite")
    con = sqlite3.connect(out)
    con.execute('CREATE TABLE many (k INTEGER PRIMARY KEY, n INT, x REAL, "a name" TEXT, b BOOLEAN, day DATE, raw)')
    con.executemany("INSERT INTO many VALUES (?,?,?,?,?,?,?)", [(3 * i - 50, i % 7, i / 4, f"v{i % 10}", i % 2, f"2020-01-{i % 28 + 1:02}", i) for i in range(ROWS)])
    con.execute("CREATE TABLE odd (n INT, x REAL, t TEXT, b BOOLEAN)")
    con.executemany("INSERT INTO odd VALUES (?,?,?,?)", [(1, 2, 3, 4), ("one", "two", b"\xff\x41", "yes"), (1.5, None, None, None), (2.0, "7.5", "x", 0), (None, float("inf"), "", 1), ("12", 1, "it's", 0.5)])
    con.execute("CREATE TABLE keyed (a TEXT PRIMARY KEY, v INT) WITHOUT ROWID")
    con.executemany("INSERT INTO keyed VALUES (?,?)", [("p", 1), ("q", None)])
    con.execute("CREATE VIEW seen AS SELECT k, n FROM many WHERE n = 3")
    con.execute('CREATE TABLE "no rows" (a INT)')
    con.commit()
    con.close()
    return out


def test_ranges_hold_every_row_once(spark, path):
    df = sqlite_table.read(spark, path, "many", rowids=400)
    assert df.rdd.getNumPartitions() == 8  # rowids from -50 to 2947
    assert df.dtypes == [("k", "bigint"), ("n", "bigint"), ("x", "double"), ("a name", "string"), ("b", "boolean"), ("day", "string"), ("raw", "string")]
    got = df.orderBy("k").collect()
    assert [tuple(r) for r in got] == [(3 * i - 50, i % 7, i / 4, f"v{i % 10}", bool(i % 2), f"2020-01-{i % 28 + 1:02}", str(i)) for i in range(ROWS)]


def test_tests_reach_the_database_and_lose_nothing(spark, path):
    held = spark.createDataFrame(sqlite_table.read(spark, path, "many").toPandas())
    for tests in ([("n", "=", 3)], [("x", ">", 200.5)], [("a name", "in", ["v1", "v2"])], [("k", ">=", 100), ("k", "<", 160)], [("day", "=", "2020-01-05")], [("raw", "=", "5")], [("a name", "<=", "v3"), ("n", "in", [1, 2])]):
        want = held
        for column, test, value in tests:
            want = want.where(sqlite_table._TESTS[test](F.col(f"`{column}`"), value))
        got = sqlite_table.read(spark, path, "many", only=["k"], tests=tests, rowids=500)
        assert got.columns == ["k"] and sorted(r["k"] for r in got.collect()) == sorted(r["k"] for r in want.collect()) != []
    kinds = {"n": ("INT", "bigint"), "t": ("TEXT", "string"), "day": ("DATE", "string"), "b": ("BOOLEAN", "boolean")}
    assert sqlite_table.condition("n", "=", 3, kinds) == ('"n" = ?', [3])
    assert sqlite_table.condition("t", "in", ["a", "b"], kinds) == ('"t" IN (?, ?)', ["a", "b"])
    for t in (("day", "=", "2020"), ("b", "=", True), ("n", "=", "3"), ("none", "=", 1), ("n", "=", None), ("n", "in", [])):
        assert sqlite_table.condition(*t, kinds) is None
    reader = sqlite_table.Reader(path, "many", held.select("k").schema, 10**6, [("k", ">", 2900)])
    assert sum(b.num_rows for b in reader.read(reader.partitions()[0])) == 16


def test_cells_of_another_kind_are_null(spark, path):
    got = [tuple(r) for r in sqlite_table.read(spark, path, "odd").collect()]
    assert got == [(1, 2.0, "3", True), (None, None, "A", None), (None, None, None, None), (2, 7.5, "x", False), (None, float("inf"), "", True), (12, 1.0, "it's", True)]
    assert sqlite_table.read(spark, path, "odd").where("n = 2").count() == 1


def test_tables_without_rowids_views_and_empty_ones(spark, path):
    own = sqlite.frames(spark, path)
    assert sorted(own) == ["keyed", "many", "no rows", "odd", "seen"]
    assert sorted(map(tuple, own["keyed"].collect())) == [("p", 1), ("q", None)] and own["keyed"].rdd.getNumPartitions() == 1
    assert own["seen"].count() == sum(i % 7 == 3 for i in range(ROWS)) and own["no rows"].collect() == []


def test_only_some_columns(spark, path):
    df = sqlite_table.read(spark, path, "many", only=["a name", "k"])
    assert df.columns == ["a name", "k"] and df.where("k = -50").first()["a name"] == "v0" and df.count() == ROWS
    with pytest.raises(Exception, match="no table"):
        sqlite_table.read(spark, path, "none").count()


def test_stored_copies_and_distinct_cells(spark, path, monkeypatch):
    monkeypatch.setattr(sqlite_table, "RANGE", 300)
    copy = sqlite.snapshot(spark, path)(spark)["many"]
    assert copy.count() == ROWS and "parquet" in copy._jdf.queryExecution().toString().lower()
    catalog = sqlite.catalog(spark, [("own", path)])
    got = sqlite.cells(spark, [("own", path)], catalog).join(catalog.columns, ["db_id", "col_id"]).where("table_name = 'many' AND column_name = 'a name'")
    assert sorted(r["value"] for r in got.collect()) == [f"v{i}" for i in range(10)]
