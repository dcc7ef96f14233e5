"""The fitted encoder: exact where it can be, and better than the default at finding a text's other half."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from querent.plans import encoder, hooks


def halves(spark, seed=1, n=240, topics=12):
    """Texts of topics: frequent words of all topics around few of the own one, in two halves."""
    rng = np.random.default_rng(seed)
    common = [f"c{i}" for i in range(30)]
    rows = []
    for i in range(n):
        own = [f"t{i % topics}w{j}" for j in range(25)]
        half = lambda: " ".join(rng.permutation([*rng.choice(common, 30), *rng.choice(own, 5, replace=False)]))  # noqa: B023, E731
        rows.append((i, int(i % topics), half(), half()))
    return spark.createDataFrame(rows, "idx long, topic int, question string, other string")


def found(df, factory):
    """Share of texts whose nearest other half is of their topic."""
    rows = hooks.with_vectors(hooks.with_vectors(df, factory), factory, "other", "answer").toPandas()
    a, b = np.stack(rows["vector"]), np.stack(rows["answer"])
    return float((rows["topic"].to_numpy()[(a @ b.T).argmax(axis=1)] == rows["topic"].to_numpy()).mean())


def test_retrieval_is_better_than_the_default(spark):
    df = halves(spark).repartition(3)
    both = df.select(F.explode(F.array("question", "other")).alias("question"))
    assert found(df, encoder.fit(both, size=32)) > found(df, hooks.HashedWords()) + 0.2


def test_directions_are_those_of_the_whole_matrix(spark):
    """Products of vectors equal those of the rows cut to the leading singular vectors, which numpy finds from all rows at once."""
    df = halves(spark, n=40, topics=4).select("question").repartition(3)
    own = [r["question"] for r in df.collect()]
    model = encoder.fit(df, size=30, slots_=512)
    idf, directions = model.model.value
    m = np.zeros((len(own), 512))
    for i, text in enumerate(own):
        at, values = encoder.weighted(text, idf)
        m[i, at] = values
    _, s, v = np.linalg.svd(m)
    share = np.linalg.norm(m @ directions) ** 2 / (s[:30] ** 2).sum()
    assert directions.shape == (512, 30) and np.allclose(directions.T @ directions, np.eye(30)) and 0.99 < share <= 1 + 1e-9
    counts = np.zeros(512)
    for text in own:
        counts[list(encoder.slots(text, 512))] += 1
    assert np.allclose(idf, np.where(counts > 0, np.log(41 / (1 + counts)) + 1, 0))


def test_odd_texts(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",), ("!",)], "question string")
    rows = hooks.with_vectors(df, encoder.fit(df, size=4, slots_=64)).collect()
    assert [round(float(np.linalg.norm(r["vector"])), 4) for r in rows] == [1, 0, 0, 1]
    none = encoder.fit(df.limit(0), size=4, slots_=64)
    assert not np.any(none()(["a", ""]))
