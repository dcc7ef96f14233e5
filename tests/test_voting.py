"""Fingerprints are exact and free of column order; only queries run."""

from __future__ import annotations

import random
from itertools import permutations

import pytest

from querent.operators import voting


def _print(spark, rows, kinds):
    return voting.fingerprint(spark.createDataFrame(rows, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds))))


def test_whole_numbers_keep_their_digits(spark):
    prints = {_print(spark, [(x,)], ["long"]) for x in (10_000_000_000_001, 10_000_000_000_002, 2**62, 2**62 + 1)}
    assert len(prints) == 4
    same = [_print(spark, [(x,)], [k]) for x, k in ((25, "int"), (25, "long"), (25.0, "double"), (25.0, "float"))]
    same.append(voting.fingerprint(spark.sql("select cast(25 as decimal(20, 4))")))
    assert len(set(same)) == 1
    assert _print(spark, [(1.5,)], ["double"]) == voting.fingerprint(spark.sql("select cast(1.5 as decimal(9, 3))")) != _print(spark, [(1.0000000000001,)], ["double"])
    assert len({_print(spark, [(x,)], ["double"]) for x in (0.1, 0.1000000000000001, 1e300, float("nan"), float("inf"))}) == 5


@pytest.mark.parametrize("width", [3, 8])
def test_tied_columns_in_any_order(spark, width):
    """Columns of equal bags: rotations of one column, and copies of one column."""
    rng = random.Random(width)
    rows = [tuple((i + j) % width for j in range(width)) for i in range(width)] + [(0,) * width]
    kinds = ["int"] * width
    want = _print(spark, rows, kinds)
    for _ in range(2):
        order = rng.sample(range(width), width)
        assert _print(spark, [tuple(r[i] for i in order) for r in rows], kinds) == want
    assert _print(spark, [(5,) * width] * 2, kinds) == _print(spark, [(5,) * width] * 2, kinds)
    other = [list(r) for r in rows]
    other[0][0], other[1][0] = other[1][0], other[0][0]
    equal = any(sorted(tuple(r[i] for i in p) for r in other) == sorted(rows) for p in permutations(range(width))) if width < 5 else False
    assert (_print(spark, [tuple(r) for r in other], kinds) == want) is equal


@pytest.mark.parametrize(
    "sql, want",
    [
        ("WITH x AS (SELECT 1 AS a) SELECT a FROM x", True),
        ("SELECT a, row_number() OVER (ORDER BY a) FROM t WHERE a IN (SELECT b FROM u) GROUP BY a HAVING count(*) > 1 ORDER BY 1 LIMIT 3", True),
        ("SELECT a FROM t UNION SELECT b FROM u EXCEPT SELECT c FROM v", True),
        ("(SELECT a FROM t AS x LEFT JOIN u ON x.a = u.b)", True),
        ("VALUES (1), (2)", True),
        ("WITH x AS (SELECT 1 AS a) INSERT INTO t SELECT a FROM x", False),
        ("FROM t INSERT INTO a SELECT 1 INSERT INTO b SELECT 2", False),
        ("CREATE TABLE z AS SELECT 1", False),
        ("INSERT OVERWRITE DIRECTORY '/tmp/x' USING csv SELECT 1", False),
        ("SELECT java_method('java.lang.System', 'lineSeparator')", False),
        ("SELECT 1; DROP TABLE t", False),
        ("SET spark.x=1", False),
        ("not sql", False),
        ("", False),
    ],
)
def test_only_queries_read(spark, sql, want):
    assert voting.reads_only(spark, sql) is want


def test_lists(spark):
    a = spark.range(100).repartition(5).selectExpr("id", "id % 3 as k").orderBy("id")
    equal = lambda x, y: voting.same_list(x, y).first()["equal"]
    assert equal(a, spark.createDataFrame([(float(i), i % 3) for i in range(100)], "x double, y int"))
    assert not equal(a, a.orderBy("id", ascending=False)) and not equal(a, a.limit(99))
    assert equal(a.where("id < 0"), a.where("id < -1"))
