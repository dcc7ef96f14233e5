"""JSON documents split over tasks, and joined from parts; joins of frequent keys."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from querent.operators import linking, skew
from querent.sources import documents, files, sinks

ITEM = "struct<a:string,n:bigint,list:array<struct<x:string>>>"


def items(seed, n):
    rng = random.Random(seed)
    bits = ['"', "\\", "{", "}", "[", "]", ",", ":", "\n", "é", "日本", " ", " ", "a", "\\u0041", "}}", '\\"']
    text = lambda k: "".join(rng.choices(bits, k=rng.randint(0, k)))
    return [{"a": text(30), "n": i, "list": [{"x": text(6)} for _ in range(rng.randint(0, 3))]} for i in range(n)]


@pytest.fixture
def tiny_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("dump", [{}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}, {"indent": 1, "ensure_ascii": False}])
@pytest.mark.parametrize("n", [0, 1, 60])
def test_split_arrays_keep_every_element_and_its_place(spark, tmp_path, tiny_ranges, dump, n):
    own = items(n, n)
    path = tmp_path / "own.json"
    path.write_text("\n " + json.dumps(own, **dump) + "\n\n")
    got = files.json_array(spark, str(path), ITEM, whole=-1).orderBy("idx").collect()
    assert [(r["idx"], r["a"], r["n"], [x["x"] for x in r["list"]]) for r in got] == [(i, x["a"], x["n"], [y["x"] for y in x["list"]]) for i, x in enumerate(own)]
    assert got == files.json_array(spark, str(path), ITEM).orderBy("idx").collect()
    if n == 60:
        assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 20


def test_an_element_over_many_ranges(spark, tmp_path, tiny_ranges):
    own = [{"a": "x" * 1000 + "}" * 50 + '"{', "n": 1, "list": [{"x": "y}" * 200}] * 5}, {"a": "b", "n": 2, "list": []}]
    path = tmp_path / "own.json"
    path.write_text(json.dumps(own))
    got = {r["idx"]: json.loads(r["value"]) for r in documents.elements(spark, str(path)).collect()}
    assert got == dict(enumerate(own))


@pytest.mark.parametrize("text", ['ab"c{d', '"}"', '\\"x"', 'a"b\\', "}{][", '"a\\\\"}', ""])
def test_states_of_pieces(text):
    """A piece read after another is both read as one."""
    for cut in range(len(text) + 1):
        if text[:cut].endswith("\\"):
            continue  # Spark cuts behind a brace only
        assert documents.step(text[:cut]).then(documents.step(text[cut:])) == documents.step(text)


@pytest.mark.parametrize("n", [0, 1, 500])
def test_documents_have_the_bytes_of_one_value(spark, tmp_path, n):
    rows = spark.createDataFrame([(i, f'v"{i}', None if i % 3 else "é\n", i / 4) for i in range(n)], "idx long, a string, b string, c double").repartition(7)
    whole = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.struct("a", "b", "c").alias("row")))), lambda x: x["row"])
    for indent in (False, True):
        sinks.write_json_array(rows, str(tmp_path / f"d{indent}"), indent)
        want = rows.agg(F.to_json(whole, {"pretty": "true"} if indent else {}).alias("v")).first()["v"]
        got = (tmp_path / f"d{indent}" / "part-00000").read_text()
        assert json.loads(got) == json.loads(want) and (not n or got == want + "\n")
    assert [p.name for p in (tmp_path / "dFalse").iterdir() if not p.name.startswith(".")] == ["part-00000"]
    back = files.json_array(spark, str(tmp_path / "dFalse"), "struct<a:string,b:string,c:double>")
    assert sorted(back.collect()) == sorted(rows.select("idx", "a", "b", "c").collect(), key=lambda r: r["idx"]) if n else back.count() == 0


def test_frequent_keys_stay_where_they_are(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.lit("d").alias("d"))
    by = spark.createDataFrame([("d", "hot", 1), ("d", "k1", 2), ("d", "k7", 3), ("x", "hot", 4)], "d string, k string, v int")
    for how in ("inner", "left"):
        plain = sorted(map(tuple, rows.join(by, ["d", "k"], how).select("id", "k", "v").collect()), key=str)
        split = skew.split_join(rows, by, ["d", "k"], how, hot=100, least=100)
        assert sorted(map(tuple, split.select("id", "k", "v").collect()), key=str) == plain
    assert [tuple(r) for r in skew.frequent(rows, ["d", "k"], hot=100, least=100).collect()] == [("d", "hot")]
    assert skew.frequent(rows, ["k"]) is None and skew.frequent(rows.limit(0), ["k"]) is None


def test_a_token_of_every_cell_and_question(spark, monkeypatch):
    """Links are the same whether the frequent token meets its columns in a shuffle or by a broadcast."""
    questions = spark.createDataFrame([(i, "db", ["the", "red", "car", f"w{i % 5}"]) for i in range(200)], "idx long, db_id string, toks array<string>")
    cells = spark.createDataFrame([("db", c, v) for c in range(1, 6) for v in ("red car", f"red w{c - 1}", "blue", "red")], "db_id string, col_id int, value string")
    plain = sorted(map(tuple, linking.value_links(questions, cells).collect()))
    monkeypatch.setattr(skew, "LEAST", 50)
    monkeypatch.setattr(skew, "HOT", 20)
    assert sorted(map(tuple, linking.value_links(questions, cells).collect())) == plain and len(plain) > 1000
