"""Selection, its similarity join and its index against plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from querent.operators import nearest, selection, similarity_join, skew

SCHEMA = "idx long, db_id string, question string, vector array<double>, skeleton string, pre_skeleton string"
WORDS = ["select _ from _", "select _ from _ where _", "select _ from _ where _ order by _", "_", "", " select  _ ", "select count ( _ ) from _"]


def rows(seed=1, n=300, dims=6):
    """Grouped vectors, equal ones, zero ones, and rows that have none."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, dims)) * 4
    out = []
    for i in range(n):
        v = (centres[i % 5] + 0.2 * rng.standard_normal(dims)).tolist()
        kind = i % 23
        v = None if kind == 3 else [] if kind == 5 else [None, *v[1:]] if kind == 7 else [math.nan, *v[1:]] if kind == 9 else [0.0] * dims if kind == 11 else v[:-1] if kind == 13 else out[0][3] if kind == 17 else v
        out.append((i, None if kind == 20 else "abc"[i % 3], None if kind == 21 else f"q{i % 7}", v, WORDS[i % len(WORDS)], WORDS[(i * 3 + 1) % len(WORDS)]))
    return out


def usable(v, width=6):
    return v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)


def brute(pool, targets, s, k, cross_domain, threshold=selection.THRESHOLD, width=6):
    at = {"skeleton": 4, "pre_skeleton": 5}.get(s.skeleton)
    out = {}
    for t in targets:
        if not usable(t[3], width):
            continue
        offers = []
        for c in pool:
            if not usable(c[3], width) or cross_domain and c[1] is not None and c[1] == t[1] or s.other_question and c[2] is not None and c[2] == t[2]:
                continue
            if cross_domain and c[1] is None and t[1] is None or s.other_question and c[2] is None and t[2] is None:
                continue
            a, b = np.array(t[3]), np.array(c[3])
            if s.metric == "cosine":
                both = math.sqrt((a * a).sum()) * math.sqrt((b * b).sum())
                key = -((a * b).sum() / both if both else 0.0)
            else:
                key = math.sqrt(((a - b) ** 2).sum())
            if s.most is not None and key > threshold:
                continue
            sim = selection.similarity(t[at], c[at]) if at else None
            late = int(s.gate and sim < threshold)
            if late and not s.backfill:
                continue
            offers.append((late, key - (sim if s.metric == "hybrid" else 0), c[0]))
        out[t[0]] = [x[2] for x in sorted(offers, key=lambda x: (x[0], round(x[1], 9), x[2]))[:k]]
    return {t: x for t, x in out.items() if x}


def got(df):
    out = {}
    for r in df.orderBy("t_idx", "rank").collect():
        out.setdefault(r["t_idx"], []).append(r["c_idx"])
    return out


@pytest.mark.parametrize("name", list(selection.STRATEGIES))
@pytest.mark.parametrize("cross_domain", [True, False])
def test_rows_equal_brute_force(spark, name, cross_domain):
    own = rows()
    pool = spark.createDataFrame(own, SCHEMA).repartition(3)
    targets = [r for r in own if r[0] % 11 == 0]
    s = selection.STRATEGIES[name]
    df = selection.select(pool, pool.where("idx % 11 = 0"), s, 5, cross_domain, 0.6)
    assert got(df) == brute(own, targets, s, 5, cross_domain, 0.6)
    if s.skeleton:
        text = {r[0]: r[4] if s.skeleton == "skeleton" else r[5] for r in own}
        assert all(r["sim"] == pytest.approx(selection.similarity(text[r["t_idx"]], text[r["c_idx"]])) for r in df.collect())


def test_zero_vectors_have_similarity_zero(spark):
    own = [(0, "a", "q0", [0.0, 0.0], "", ""), (1, "a", "q1", [1.0, 0.0], "", ""), (2, "a", "q2", [-1.0, 0.0], "", ""), (3, "a", "q3", None, "", ""), (9, "b", "q9", [1.0, 0.0], "", ""), (10, "b", "q10", [0.0, 0.0], "", "")]
    pool = spark.createDataFrame(own, SCHEMA)
    found = selection.select(pool, pool.where("idx >= 9"), selection.STRATEGIES["COSSIMILAR"], 3).orderBy("t_idx", "rank").collect()
    assert [(r["t_idx"], r["c_idx"], r["score"]) for r in found] == [(9, 1, 1.0), (9, 0, 0.0), (9, 2, -1.0), (10, 0, 0.0), (10, 1, 0.0), (10, 2, 0.0)]


def test_no_usable_vectors(spark):
    pool = spark.createDataFrame([(0, "a", "q", None, "x", "x"), (1, "b", "r", [], None, None)], SCHEMA)
    for s in selection.STRATEGIES.values():
        assert selection.select(pool, pool, s, 2).collect() == [] == selection.select(pool.limit(0), pool, s, 2).collect()
        assert nearest.search(nearest.build(pool, cosine=s.metric == "cosine"), pool, s, 2)[0].collect() == []


@pytest.mark.parametrize("name", ["EUCDISTANCE", "COSSIMILAR", "EUCDISTANCETHRESHOLD", "EUCDISPRESKLSIMTHR", "EUCDISPRESKLSIMPLUS", "EUCDISMASKPRESKLSIMTHRSHIFT"])
def test_index_gives_the_same_rows(spark, name):
    own = rows(7, 600)
    pool = spark.createDataFrame(own, SCHEMA).repartition(3)
    s = selection.STRATEGIES[name]
    index = nearest.build(pool, pivots=8, cosine=s.metric == "cosine", rows=16)
    targets = pool.where("idx % 29 = 0")
    df, report = nearest.search(index, targets, s, 4, True, 0.6)
    assert got(df) == got(selection.select(pool, targets, s, 4, True, 0.6))
    assert 0 < report["seeds"] <= report["read"] <= report["blocks"]


def test_blocks_are_left_out(spark):
    """Ten far groups: the targets of one are found without the blocks of the others."""
    rng = np.random.default_rng(4)
    own = [(i, "ab"[i // 10 % 2], f"q{i}", (np.eye(10)[i % 10] * 50 + rng.standard_normal(10)).tolist(), "x", "x") for i in range(2000)]
    pool = spark.createDataFrame(own, SCHEMA)
    index = nearest.build(pool, pivots=16, rows=20)
    df, report = nearest.search(index, pool.where("idx in (3, 13)"), selection.STRATEGIES["EUCDISTANCE"], 5)
    assert got(df) == brute(own, [own[3], own[13]], selection.STRATEGIES["EUCDISTANCE"], 5, True, width=10)
    assert report["blocks"] >= 100 and report["read"] <= report["blocks"] / 5


def texts(seed, n):
    rng = random.Random(seed)
    out = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(n)]
    return [*out, None, "", " ", "a  a", "a a a a", "a a a", " b c ", "b c", out[0], out[0] + " z"]


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.6, 2 / 3, 0.75, 0.8, 0.9, 1.0])
@pytest.mark.parametrize("hot", [similarity_join.HOT, 3])
def test_similarity_join_equals_brute_force(spark, threshold, hot, monkeypatch):
    monkeypatch.setattr(similarity_join, "HOT", hot)
    a, b = texts(1, 70), texts(2, 90)
    frame = lambda x: spark.createDataFrame([(t,) for t in x], "text string")
    want = {(x, y): selection.similarity(x, y) for x in a for y in b if x is not None and y is not None and selection.similarity(x, y) >= threshold}
    found = similarity_join.similar(frame(a), frame(b), threshold).collect()
    assert {(r["a"], r["b"]): r["sim"] for r in found} == pytest.approx(want) and len(found) == len(want)


def test_similarity_join_of_frequent_elements_and_clashing_codes(spark, monkeypatch):
    """Elements of very many texts are broadcast, and codes that clash are made anew; pairs stay those of brute force."""
    real, seeds = similarity_join._code, []

    def clashing(element, seed):
        seeds.append(seed)
        return F.pmod(real(element, seed), F.lit(3)) if seed == 0 else real(element, seed)

    monkeypatch.setattr(similarity_join, "_code", clashing)
    monkeypatch.setattr(skew, "LEAST", 40)
    a, b = texts(3, 60), texts(4, 60)
    frame = lambda x: spark.createDataFrame([(t,) for t in x], "text string")
    want = {(x, y) for x in a for y in b if x is not None and y is not None and selection.similarity(x, y) >= 0.6}
    found = similarity_join.similar(frame(a), frame(b), 0.6).collect()
    assert {(r["a"], r["b"]) for r in found} == want and len(found) == len(want) and seeds == [0, 1]
    assert similarity_join.similar(frame(a).where("false"), frame(b), 0.6).count() == 0


def test_elements(spark):
    row = spark.sql("SELECT ' b a  b b ' AS t").select(similarity_join.elements(F.col("t")).alias("e")).first()
    assert sorted(row["e"]) == [" 0", "a 0", "b 0", "b 1", "b 2"]
    with pytest.raises(ValueError, match="threshold"):
        similarity_join.similar(spark.sql("SELECT 'a' AS text"), spark.sql("SELECT 'a' AS text"), 0)


def test_random_draw_holds_k_places_a_target():
    """a task's state is k places of each target, not a table of its own for each; rows are those of sorting all pairs."""
    rng = np.random.default_rng(5)
    targets = pd.DataFrame({"t_idx": np.arange(300) * 7, "t_db": [[None, "a", "b"][i % 3] for i in range(300)]})
    ids, db = rng.permutation(2500), np.array([[None, "a", "b", "c"][i % 4] for i in range(2500)], dtype=object)
    draw = selection.Draw(targets, 4, 3, True)
    for at in range(0, 2500, 700):
        draw.add(ids[at : at + 700], db[at : at + 700])
    assert draw.key.shape == draw.c_idx.shape == (300, 4)
    got = pd.concat(draw.rows()).groupby("t_idx")["c_idx"].apply(list)

    def key(t, c):
        x = (c * 0x9E3779B97F4A7C15 + t * 0xC2B2AE3D27D4EB4F + 4) % 2**64
        x = ((x ^ (x >> 31)) * 0xD6E8FEB86659FD93) % 2**64
        return (x ^ (x >> 32)) >> 1

    for t, t_db in targets.itertuples(index=False):
        assert got[t] == sorted((int(c) for c, d in zip(ids, db, strict=True) if d != t_db), key=lambda c: (key(int(t), c), c))[:4]  # noqa: B023
    few = selection.Draw(targets, 4, 0, True)
    few.add(ids[:3], db[:3])
    assert sum(map(len, few.rows())) == sum(d != t for t in targets["t_db"] for d in db[:3])
