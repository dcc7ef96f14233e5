"""Vector near-duplicates against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from querent.llm import embedding_dedup as E
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int, c long, unit string, bucket int, weight int, more string"


def frame(spark, vectors):
    rows = [((11 * i) % 10007 if i != 5 else None, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "u", 3, 4, "m") for i, v in enumerate(vectors)]
    return spark.createDataFrame([*rows, *rows[7:8]], SCHEMA).repartition(3)


def brute(rows, cosine=0.9):
    """vec_id, n_links, component_id, kept of each row."""
    ok = [r["embedding"] is not None and len(r["embedding"]) > 0 and all(x is not None and math.isfinite(x) for x in r["embedding"]) and any(r["embedding"]) for r in rows]
    unit = [np.array(r["embedding"], dtype=float) / np.linalg.norm(np.array(r["embedding"], dtype=float)) if k else None for r, k in zip(rows, ok, strict=True)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine - 1e-12:
                n[i], n[j] = n[i] + 1, n[j] + 1
                root[find(i)] = find(j)
    low: dict[int, int | None] = {}
    for i, r in enumerate(rows):
        if r["vec_id"] is not None:
            low[find(i)] = min(low.get(find(i), r["vec_id"]), r["vec_id"])
    return sorted(((r["vec_id"], n[i], low.get(find(i), r["vec_id"]), r["vec_id"] == low.get(find(i), r["vec_id"])) for i, r in enumerate(rows)), key=str)


def group(rng, centre, n, spread):
    return centre + rng.standard_normal((n, len(centre))) * spread / math.sqrt(len(centre))


def corpus(seed=3):
    """Random vectors, exact, scaled and near copies, a dense group, and two groups whose members are near and far."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, 32))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    near = centres[1] + 0.25 * centres[2]
    parts = [rng.standard_normal((120, 32)), group(rng, centres[0], 90, 0.08), group(rng, centres[1], 60, 0.1), group(rng, near / np.linalg.norm(near), 60, 0.1), group(rng, centres[3], 40, 0.35), np.repeat(centres[4:5], 30, axis=0), 3 * centres[4:5], -centres[4:5]]
    own = [x.tolist() for x in np.concatenate(parts).astype(np.float32)]
    return [*own, None, [], [0.0] * 32, [None] + [1.0] * 31, [float("nan")] * 32, [float("inf")] + [0.0] * 31, [1e-30] * 32, [1e30] * 32, [1.0, 0.0], [1.0, 0.1], own[3][:31], own[3], own[3]]


def rows_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


@pytest.mark.parametrize("crowd", [10, E.CROWD])
def test_rows_equal_all_pairs(spark, crowd, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 24)
    monkeypatch.setattr(E, "BALL", 8)
    vectors = frame(spark, corpus())
    assert rows_of(E.near_duplicates(vectors, crowd=crowd)) == brute(vectors.collect())


def test_dense_groups_take_the_way_of_balls(spark, monkeypatch):
    """Two crowded groups side by side: all of the pairs within them are links by the bound, those between them are compared."""
    seen = []
    real = E._ball_links
    monkeypatch.setattr(E, "_ball_links", lambda *a: seen.append(a[2].count()) or real(*a))
    vectors = frame(spark, corpus(9))
    assert rows_of(E.near_duplicates(vectors, crowd=10)) == brute(vectors.collect())
    assert seen and seen[0] >= 100


def test_query(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert rows_of(E.op12_embedding_dedup(spark, SF)) == brute(vectors.collect())


def test_recall_of_pairs_at_the_threshold(spark):
    """500 pairs just above the least cosine among vectors of no structure, the hardest case for the tables."""
    rng = np.random.default_rng(5)
    a = rng.standard_normal((500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((500, 64))
    b -= (b * a).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    cosine = 0.9005
    both = np.concatenate([a, cosine * a + math.sqrt(1 - cosine**2) * b])
    got = E.near_duplicates(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(both)], "vec_id long, embedding array<double>")).collect()
    found = sum(r["n_links"] >= 1 for r in got) / 1000
    assert found >= 0.97
    assert all(r["n_links"] <= 1 for r in got)


def test_learned_rotations_lose_less_than_random_ones():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16))
    x = centres[rng.integers(0, 40, 3000)] + 0.1 * rng.standard_normal((3000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    start = E.orthogonal(16, rng)
    turned = E.itq(x, start)
    loss = lambda r: float(((np.where(x @ r >= 0, 1, -1) / 4 - x @ r) ** 2).sum())
    assert np.allclose(turned @ turned.T, np.eye(16)) and loss(turned) < 0.95 * loss(start)
    share = (x @ turned >= 0).mean(axis=0)
    assert share.min() > 0.2 and share.max() < 0.8


def test_tables_follow_the_number_of_vectors():
    few, many = E.tables(1000, 0.9), E.tables(10**9, 0.9)
    assert few.bits < many.bits and few.tables < many.tables
    for like in (few, many, E.tables(0, 0.5)):
        apart = math.acos(like.cosine) / math.pi
        assert (1 - (1 - apart) ** like.bits) ** like.tables <= E.MISSED and like.bits * like.tables >= E.CODE_BITS
    with pytest.raises(ValueError, match="cosine"):
        E.tables(5, 1.0)


def test_unit_rows():
    got = E.unit_rows(pa.array([[3.0, 4.0], None, [0.0, 0.0], [None, 1.0], [], [1e-40, 0.0], [-0.0, 1.0], [0.0, 1.0]], pa.list_(pa.float64())))
    assert np.frombuffer(got[0]).tolist() == [0.6, 0.8] and got[1:5] == [None] * 4 and np.frombuffer(got[5]).tolist() == [1.0, 0.0] and got[6] == got[7]


def test_wide_vectors_and_other_sizes():
    like = E.tables(2000, 0.9)
    assert E.rotations(300, like, np.random.default_rng(2).standard_normal((1200, 300))).shape == (300, like.bits * like.tables)
    assert E.rotations(1, like).shape == (1, like.bits * like.tables)


def test_empty(spark):
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    none = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert rows_of(E.near_duplicates(none)) == [(1, 0, 1, True), (2, 0, 2, True)]
