"""Selection, linking, voting, prompts and relations against plain Python on small data."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from querent.operators import linking, prompts, relations, selection, voting


def pool(spark, rows):
    return spark.createDataFrame(rows, "idx long, db_id string, question string, vector array<float>, pre_skeleton string")


def test_gate_and_backfill(spark):
    rng = random.Random(3)
    rows = [(i, "ab"[i % 2], f"q{i % 5}", [rng.choice([0.0, 1.0]), rng.random()], rng.choice(["x y", "x z", "w"])) for i in range(40)]
    rows += [(100 + i, *rows[i][1:]) for i in range(5)]
    frame = pool(spark, rows)
    targets = frame.where("idx % 10 = 0")
    got = defaultdict(list)
    for r in selection.select(frame, targets, selection.STRATEGIES["EUCDISPRESKLSIMTHR"], 6).orderBy("t_idx", "rank").collect():
        got[r["t_idx"]].append(r["c_idx"])
    for t in [r for r in rows if r[0] % 10 == 0]:
        key = lambda c: (selection.similarity(t[4], c[4]) < 0.85, sum((float(spark_float(x)) - float(spark_float(y))) ** 2 for x, y in zip(t[3], c[3], strict=True)) ** 0.5, c[0])  # noqa: B023, E731
        want = sorted((c for c in rows if c[1] != t[1]), key=key)[:6]
        assert got[t[0]] == [c[0] for c in want]


def spark_float(x):
    import numpy as np

    return np.float32(x)


def test_missing_column_is_named(spark):
    frame = pool(spark, [(0, "a", "q", [0.0], "x")]).drop("pre_skeleton")
    with pytest.raises(ValueError, match="pre_skeleton"):
        selection.select(frame, frame, selection.STRATEGIES["EUCDISPRESKLSIMTHR"], 1)


def shifted(matches):
    """The rule of disambiguation in plain Python."""
    by = defaultdict(set)
    for q, kind, target, flag in matches:
        by[q].add((kind, target, flag))
    accepted, out = set(), set()
    for _, q in sorted((len(m), q) for q, m in by.items()):
        own = by[q]
        if accepted & own:
            res = accepted & own
        else:
            res = {m for m in own if m[2] in ("CEM", "TEM")} or own
            accepted |= res
        out |= {(q, *m) for m in res}
    return out


def test_shift(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for idx in range(30):
        own = set()
        for _ in range(rng.randint(1, 9)):
            kind = rng.choice(["col", "tab"])
            own.add((rng.randrange(5), kind, rng.randrange(3), rng.choice({"col": ["CEM", "CPM"], "tab": ["TEM", "TPM"]}[kind])))
        rows += [(idx, "d", *m) for m in own]
        want |= {(idx, *m) for m in shifted(own)}
    frame = spark.createDataFrame(rows, "idx int, db_id string, q_id int, kind string, target_id int, flag string")
    got = {(r["idx"], r["q_id"], r["kind"], r["target_id"], r["flag"]) for r in linking.shifted(frame).collect()}
    assert got == want


def test_value_islands(spark):
    q = spark.createDataFrame([(0, "d", ["show", "Red", "widget", "and", "blue", "?"])], "idx long, db_id string, toks array<string>")
    cells = spark.createDataFrame([("d", 1, "red widget"), ("d", 2, " blue "), ("d", 2, "50% off"), ("d", 3, "dark red"), ("d", 3, None)], "db_id string, col_id int, value string")
    got = {(r["q_id"], r["target_id"], r["flag"]) for r in linking.value_links(q, cells).collect()}
    assert got == {(1, 1, "EXACTMATCH"), (2, 1, "EXACTMATCH"), (4, 2, "EXACTMATCH"), (1, 3, "PARTIALMATCH")}


@pytest.mark.parametrize(
    "a, b, equal",
    [
        ([(1, "x"), (2, "y")], [(1, "x"), (2, "y")], True),
        ([(1, "x")], [(1, "x"), (1, "x")], False),
        ([(1, None)], [(1, None)], True),
        ([], [], True),
    ],
)
def test_fingerprint_of_swapped_columns(spark, a, b, equal):
    left = spark.createDataFrame(a, "i int, s string")
    right = spark.createDataFrame(b, "i int, s string").select("s", F.col("i").cast("double").alias("i"))
    assert (voting.fingerprint(left)[::2] == voting.fingerprint(right)[::2]) is equal


def test_fingerprint_needs_whole_rows(spark):
    a = spark.createDataFrame([(1, 2), (2, 1), (1, 1)], "a int, b int")
    b = spark.createDataFrame([(1, 1), (2, 2), (1, 1)], "a int, b int")
    assert voting.fingerprint(a) != voting.fingerprint(b)


def test_budget_passes_over_long_examples(spark):
    targets = spark.createDataFrame([(0, "d", "ask", "SELECT a"), (1, "d", "ask", "SELECT b")], "idx long, db_id string, prompt string, query string")
    offers = spark.createDataFrame([(0, 1, 7, "a " * 50), (0, 2, 8, "b b"), (0, 3, 9, "c")], "t_idx long, rank int, c_idx long, example string")
    got = {r["idx"]: r for r in prompts.few_shot(targets, offers, "COMPLETE", 2, 20, 5).collect()}
    assert got[0]["chosen"] == [8, 9] and got[0]["prompt"] == "b b\n\nc\n\nask" and got[0]["prompt_tokens"] == 4
    assert got[1]["chosen"] == [] and got[1]["prompt"] == "ask" and got[1]["response"] == "b"


def test_relations(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "idx long, v string")
    assert [r["idx"] for r in relations.later_duplicates(rows, "v").collect()] == [2]
    assert sorted(r["idx"] for r in relations.union_splits(rows, rows).collect()) == [0, 1, 2, 3, 4, 5]
    places = spark.createDataFrame([(0, 2), (1, 0)], "place long, idx long")
    assert sorted((r["idx"], r["v"]) for r in relations.subset(rows, places).collect()) == [(0, "a"), (1, "a")]
    with pytest.raises(Exception, match="differ in length"):
        relations.aligned(rows, places.select("idx"), total=True).collect()


def test_no_cartesian_product(spark):
    """Name and value links join by equality."""
    q = spark.createDataFrame([(0, "d", ["a"])], "idx long, db_id string, toks array<string>")
    cells = spark.createDataFrame([("d", 1, "a")], "db_id string, col_id int, value string")
    plan = linking.value_links(q, cells)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
