"""Statements written for SQLite give on Spark what SQLite gives."""

from __future__ import annotations

import math
import sqlite3

import pytest

from querent.functions import dialect
from querent.operators import voting
from querent.sources import sqlite

DDL = """
CREATE TABLE singer (id INTEGER PRIMARY KEY, name TEXT, country TEXT, age INTEGER, worth REAL, born TEXT, "Song Count (all)" INTEGER, active BOOLEAN);
CREATE TABLE concert (id INTEGER PRIMARY KEY, singer_id INT, theme VARCHAR(20), year TEXT, seats INT, held DATE);
"""
SINGERS = [
    (1, "Ann", "France", 31, 10.5, "1990-02-28", 12, 1), (2, "bob", "france", 40, 7.0, "1981-12-31 23:59:58", 7, 0), (3, "Cé", "Spain", 31, None, None, 5, 1), (4, "D\\e_%", "Spain", 25, 2.25, "not a date", 0, 0),
    (5, "it's", None, 64, 1e10, "2000-01-31", 3, None), (6, "", "Chad", None, -3.5, "2004-02-29T10:20:30", None, 1),
]
CONCERTS = [(1, 1, "Free choice", "2014", 100, "2014-01-31"), (2, 1, "Bleeding", "2015", 250, "2015-06-07"), (3, 2, "free", "12 or so", 33, "2016-02-29"), (4, 3, "Wide Awake", "2014", 7, None), (5, 9, None, None, 0, "1999-12-31")]

STATEMENTS = """
SELECT 5 / 2, -5 / 2, 5 / 2.0, 7 % 3, -7 % 3, 7.9 % 2.9, 1 / 0, 1 % 0, 9 / 2 / 2, 9 / 2 * 1.0, 2 * 7 / 4, 1.0 * 7 / 2
SELECT sum(age) / count(*), avg(age), sum(worth) / count(*), total(worth), max(age) / 7, (max(age) - min(age)) / 4 FROM singer
SELECT id, age / 3, worth / 2, "Song Count (all)" / age, (age + 1) / 2, age % 7 FROM singer
SELECT count(*) * 100 / (SELECT count(*) FROM singer) FROM singer WHERE age > 30
SELECT CAST(sum(CASE WHEN country = 'Spain' THEN 1 ELSE 0 END) AS REAL) * 100 / count(*) FROM singer
SELECT sum(country = 'Spain'), sum(CASE WHEN age > 30 THEN 1 ELSE 0 END) / count(*), avg(age > 30), count(age > 30) FROM singer
SELECT name FROM singer WHERE country LIKE 'FRANCE'
SELECT name FROM singer WHERE name LIKE '%\\%' OR name LIKE '%E_!%%' ESCAPE '!' OR country NOT LIKE "%a%"
SELECT name FROM singer WHERE name LIKE 'c%' || 'é'
SELECT name FROM singer WHERE name GLOB '[A-C]*' OR name GLOB '?o?'
SELECT id FROM singer WHERE country = "Spain" AND "age" > 30
SELECT [name], `country` FROM singer AS s WHERE "s"."id" < 3
SELECT "Song Count (all)" FROM singer WHERE "Song Count (all)" > 4
SELECT name FROM singer WHERE name = 'it''s' OR name = 'D\\e_%'
SELECT id FROM singer WHERE worth IS NOT NULL AND country IS NOT 'France' AND age IS 31
SELECT id FROM singer WHERE country ISNULL OR age NOTNULL AND age < 30
SELECT country, max(age), name FROM singer GROUP BY country
SELECT country, name, count(*) FROM singer WHERE id IN (1, 4, 5, 6) GROUP BY 1
SELECT lower(country) AS c, max(worth), name || '!' FROM singer WHERE worth > 0 GROUP BY c ORDER BY c
SELECT name, min(age) FROM singer WHERE age > 31
SELECT country, count(*) FROM singer GROUP BY country HAVING count(*) > 1 ORDER BY count(*) DESC, country LIMIT 1
SELECT T1.name, count(*) FROM singer AS T1 JOIN concert AS T2 ON T1.id = T2.singer_id GROUP BY T1.id
SELECT T1.name FROM singer T1 JOIN concert T2 ON T1.id = T2.singer_id WHERE T2.year = 2014 GROUP BY T1.id ORDER BY count(*) DESC, T1.name LIMIT 1
SELECT name FROM singer WHERE id NOT IN (SELECT singer_id FROM concert)
SELECT name FROM singer WHERE age = (SELECT max(age) FROM singer)
SELECT name FROM singer WHERE age > (SELECT age FROM singer WHERE id = 1)
SELECT name FROM singer ORDER BY age DESC, id LIMIT 1, 2
SELECT name FROM singer ORDER BY age LIMIT 2 OFFSET 1
SELECT name FROM singer ORDER BY id LIMIT -1
SELECT date(born), strftime('%Y', born), strftime('%m-%d', born), strftime('%H:%M:%S', born), strftime('%j %w', born) FROM singer
SELECT date(born, '+1 month'), date(born, '-1 year', '+1 day'), date(born, 'start of month'), datetime(born, '+90 minutes'), date(born, 'weekday 0'), time(born) FROM singer
SELECT julianday('2020-01-02') - julianday('2020-01-01'), julianday(born) FROM singer
SELECT strftime('%s', born), unixepoch(born), datetime(0, 'unixepoch'), date(2451545), strftime('%d/%m/%Y at %%', born), strftime('%W', born) FROM singer
SELECT count(*) FROM singer WHERE strftime('%Y', born) > '1985' AND date(born) BETWEEN '1980-01-01' AND '2003-01-01'
SELECT strftime('%Y', held) - 2000, CAST(strftime('%Y', held) AS INTEGER) / 4 FROM concert
SELECT (strftime('%Y', '2020-05-05') - strftime('%Y', born)) - (strftime('%m-%d', '2020-05-05') < strftime('%m-%d', born)) FROM singer
SELECT CAST(year AS INTEGER), CAST(theme AS INT), CAST(worth AS INTEGER), CAST(age AS TEXT) || '!', CAST('3.5e1x' AS REAL), CAST(' -12abc' AS INTEGER) FROM concert JOIN singer USING (id)
SELECT upper(name), lower('ÉA'), length(name), substr(name, 2), substr(name, 0, 2), substr(name, -2), substr(name, 1, 1) FROM singer
SELECT replace(name, 'n', 'm'), trim('  x '), ltrim('xxay', 'x'), rtrim(name, 'nb'), instr(name, 'n'), name || '-' || country FROM singer
SELECT iif(age > 30, 'old', 'young'), ifnull(country, 'none'), coalesce(NULL, age, 1), nullif(age, 31), max(age, 31), min(age, worth), abs(worth), round(worth), round(worth, 1) FROM singer
SELECT group_concat(name, '|') FROM (SELECT name FROM singer WHERE id < 2)
SELECT CASE country WHEN 'Spain' THEN 1 WHEN "France" THEN 2 END, CASE WHEN age / 2 > 15 THEN 'x' ELSE 'y' END FROM singer
SELECT country FROM singer UNION SELECT theme FROM concert
SELECT name FROM (SELECT s.name, max(s.worth) FROM singer AS s)
SELECT id FROM singer EXCEPT SELECT singer_id FROM concert
SELECT id FROM singer INTERSECT SELECT singer_id FROM concert ORDER BY id
SELECT country FROM singer UNION ALL SELECT country FROM singer WHERE age > 35
WITH old AS (SELECT * FROM singer WHERE age > 30), c(n) AS (SELECT count(*) FROM old) SELECT name, n FROM old, c
SELECT avg(n) FROM (SELECT count(*) AS n FROM concert GROUP BY singer_id)
SELECT name FROM singer WHERE EXISTS (SELECT 1 FROM concert WHERE singer_id = singer.id AND seats > 50)
SELECT name FROM singer LEFT JOIN concert ON singer.id = concert.singer_id AND concert.theme LIKE 'FREE%' WHERE concert.id IS NULL
SELECT row_number() OVER (ORDER BY id DESC), name FROM singer
SELECT typeof(age), typeof(worth), typeof(name), typeof(NULL) FROM singer WHERE id = 1
SELECT 0x1F, 1e3, .5, 5., 'a' 'b'
SELECT age FROM singer WHERE age BETWEEN 30 AND 40 AND NOT country IN ('Spain', 'Chad') -- a remark
SELECT /* here too */ count(DISTINCT country), count(*), count(country) FROM singer WHERE 1 = 1;
SELECT s.* FROM singer AS s WHERE s.id == 2
SELECT theme, seats * 1.0 / (SELECT sum(seats) FROM concert) FROM concert WHERE seats <> 0
SELECT name FROM singer WHERE active
SELECT name FROM singer WHERE age > 30 AND (worth / 2 > 3 OR country LIKE '%ain')
""".strip().split("\n")


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("dialect") / "music.sqlite")
    con = sqlite3.connect(path)
    con.executescript(DDL)
    con.executemany("INSERT INTO singer VALUES (?,?,?,?,?,?,?,?)", SINGERS)
    con.executemany("INSERT INTO concert VALUES (?,?,?,?,?,?)", CONCERTS)
    con.commit()
    return con, voting.Database(spark, sqlite.snapshot(spark, path))


def cell(x: object) -> str:
    if isinstance(x, bool):
        x = int(x)
    return "null" if x is None else f"{float(x):.9g}" if isinstance(x, int | float) and math.isfinite(x) else str(x)


def rows(got) -> list[list[str]]:
    return sorted([cell(x) for x in r] for r in got)


@pytest.mark.parametrize("sql", [x for x in STATEMENTS if x != "SELECT 0x1F, 1e3, .5, 5., 'a' 'b'"])
def test_results_equal_sqlite(database, sql):
    con, own = database
    want = con.execute(sql).fetchall()
    got = own.frame(sql).collect()
    assert rows(got) == rows(want)
    if "ORDER BY" in sql and "OVER" not in sql:
        assert [[cell(x) for x in r] for r in got] == [[cell(x) for x in r] for r in want]


@pytest.mark.parametrize("sql", ["SELECT year(born) FROM singer", "SELECT concat_ws('a', name) FROM singer", "SELECT (1", "SELECT 1)", "", ";", "SELECT 1; SELECT 2", "SELECT strftime(name, born) FROM singer", "SELECT uuid()", "INSERT INTO singer SELECT * FROM singer", "PRAGMA x"])
def test_what_sqlite_refuses(database, sql):
    with pytest.raises(dialect.Unsupported):
        dialect.to_spark(sql, database[1].names)


@pytest.mark.parametrize("sql", ["SELECT * FROM text.`/etc/passwd`", "SELECT * FROM `csv`.`/etc/passwd`", "SELECT * FROM \"text\".\"/etc/passwd\"", "SELECT * FROM other", "WITH x AS (SELECT 1) SELECT * FROM y", "SELECT * FROM (WITH hid AS (SELECT 1 AS a) SELECT a FROM hid) JOIN hid", "SELECT (SELECT count(*) FROM json.`/tmp`) FROM singer", "SELECT name FROM singer WHERE id IN (SELECT value FROM text.`/etc/passwd`)", "DROP TABLE singer", "INSERT INTO singer SELECT * FROM singer"])
def test_only_tables_of_the_database_are_read(spark, database, sql):
    own = database[1]
    assert not voting.reads_only(own.session, sql, own.names.tables)
    try:
        assert own.frame(sql) is None
    except dialect.Unsupported:
        pass
    got = voting.execute(spark, spark.createDataFrame([("m", sql)], "db_id string, sql string"), tables={"m": lambda session: {"singer": session.range(3).withColumnRenamed("id", "name")}}).first()
    assert got["status"] != "ok" and got["n_rows"] is None


def test_databases_with_tables_of_one_name(spark):
    candidates = spark.createDataFrame([("a", "SELECT sum(x) / 2 FROM t"), ("b", "SELECT sum(x) / 2 FROM t"), ("b", "SELECT x FROM u"), ("none", "SELECT 1"), ("none", "SELECT x FROM t")], "db_id string, sql string")
    tables = {"a": lambda s: {"t": s.range(4).withColumnRenamed("id", "x")}, "b": lambda s: {"t": s.range(6).selectExpr("CAST(id AS double) AS x")}}
    got = {(r["db_id"], r["sql"]): r for r in voting.execute(spark, candidates, tables=tables).collect()}
    prints = {k: r["fingerprint"] for k, r in got.items()}
    assert prints["a", "SELECT sum(x) / 2 FROM t"] == voting.fingerprint(spark.sql("SELECT 3"))[2]
    assert prints["b", "SELECT sum(x) / 2 FROM t"] == voting.fingerprint(spark.sql("SELECT 7.5"))[2]
    assert [got[k]["status"] for k in (("b", "SELECT x FROM u"), ("none", "SELECT 1"), ("none", "SELECT x FROM t"))] == ["refused", "ok", "refused"]
    assert not [t for t in spark.catalog.listTables() if t.name in ("t", "u")]


def test_ordered_results_under_any_order_of_columns(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (3, "x", 5)], "a int, b string, c int").orderBy("a")
    equal = lambda x, y: voting.same_list(x, y).first()["equal"]
    assert equal(a, a.select("b", "c", "a")) and not equal(a, a.orderBy("a", ascending=False)) and not equal(a, a.select("b", "c", F_same("c")))


def F_same(name):
    from pyspark.sql import functions as F

    return F.col(name).alias("again")
