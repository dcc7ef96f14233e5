"""Hand-derived cases of the text functions, and short statements of their rules in plain Python."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from querent.functions import answers, similarity, sql_text
from querent.operators import linking, selection


def one(spark, make, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(make(*(F.col(f"c{i}") for i in range(len(values)))).alias("v")).first()["v"]


@pytest.mark.parametrize("a, b, want", [("", "", 1.0), ("", "x", 0.0), ("a a b", "a b b", 0.5), ("  a b ", "a b", 1.0), ("a  b", "a b", 2 / 3)])
def test_jaccard(spark, a, b, want):
    assert one(spark, similarity.jaccard_multiset, a, b) == pytest.approx(want)
    assert selection.similarity(a, b) == pytest.approx(want)


def test_jaccard_rule(spark):
    rng = random.Random(1)
    rows = [tuple(" ".join(rng.choices("abc", k=rng.randint(0, 5))) for _ in range(2)) for _ in range(60)]
    got = spark.createDataFrame(rows, "a string, b string").select(similarity.jaccard_multiset(F.col("a"), F.col("b")).alias("s")).collect()
    for (a, b), r in zip(rows, got, strict=True):
        x, y = Counter(a.split(" ")), Counter(b.split(" "))
        both = sum((x & y).values())
        assert r["s"] == pytest.approx(both / (sum(x.values()) + sum(y.values()) - both))


@pytest.mark.parametrize(
    "sql, want",
    [
        ('SELECT  A FROM t WHERE b = "X y";', "select a from t where b = 'X y'"),
        ("select a from t order by a", "select a from t order by a asc"),
        ("select description from t order by a", "select description from t order by a"),
        ("select a from t order by count(*) desc", "select a from t order by count ( * ) desc"),
        ("select x.a from t as x join u as y on x.i = y.i", "select t.a from t join u on t.i = u.i"),
        ("select t1.a from t t1 where t1.b = 2", "select t.a from t where t.b = 2"),
        ("select a from t join u as T2 on t.a = T2.b", "select a from t join u on t.a = u.b"),
        ("select x.a, y.b from t as x , u as y", "select t.a , u.b from t , u"),
        ("select a from t where b = 'it''s' or c = ''", "select a from t where b = 'it''s' or c = ''"),
        ("select a from t where b = 'open", "select a from t where b = 'open"),
        ("select q.a from t q where q.b in (select r.c from u as r)", "select t.a from t where t.b in ( select u.c from u )"),
        ("select a from (select b as a from t) as s, u v where v.c = 1", "select a from ( select b from t ) , u where u.c = 1"),
        ("select a from t x order by x.a - 1, b", "select a from t order by t.a - 1 asc , b"),
        ("", ""),
    ],
)
def test_normalize(spark, sql, want):
    assert one(spark, sql_text.normalize, sql) == want


@pytest.mark.parametrize(
    "sql, want",
    [
        ("select a, b from t where a = 1 and b != 'x' or c > 2.5", "select _ from _ where _"),
        ("select a from t join u on t.a = u.b and t.c = u.d", "select _ from _ "),
        ("select a from t order by nothing", "select _ from _ order by _ asc"),
        ("select max(a) from t where b < -3", "select max ( _ ) from _ where _"),
        ("select a from t join u as T2 on t.a = T2.b where c = 1", "select _ from _ where _"),
        ("select a from t join u on t.a = u.b and t.c = u.d or t.a = u.d", "select _ from _ "),
        ("select a from t where a = 1 and b = 2 and c = 3 or d = 4", "select _ from _ where _"),
    ],
)
def test_skeleton(spark, sql, want):
    make = lambda s: sql_text.skeleton(s, F.array(F.lit("t"), F.lit("u")), F.array(*(F.lit(c) for c in "abcd")))
    assert one(spark, make, sql) == want


@pytest.mark.parametrize("gram, name, want", [("order", "order key", True), ("ord", "order key", False), ("order key", "order key", True), ("key", "order key", False), ("(x", "(x y", False), ("order ", "order key", True)])
def test_starts_name(spark, gram, name, want):
    assert one(spark, linking.starts_name, gram, name) is want


def test_answers(spark):
    assert one(spark, answers.answer_sql, " a\n from  t /* x") == "SELECT a from t "
    assert one(spark, answers.gold_answer, "SELECT  a\nFROM t") == "a FROM t"
    assert one(spark, answers.without_distinct, "SELECT DISTINCT a, 'distinct' FROM t; SELECT 2") == "SELECT  a, 'distinct' FROM t;"
    assert one(spark, answers.fixed_year, "x = YEAR ( CURDATE() )  AND y") == "x = 2020AND y"
    assert one(spark, answers.question_tokens, "Who  is it? Me.") == ["Who", "is", "it", "?", "Me", "."]
    assert one(spark, answers.with_evidence, "q ", "") == "q"
    assert one(spark, answers.with_evidence, "q", " e") == "q  e"
