"""Columns of the user, whatever their names, come back with their values."""

from __future__ import annotations

import pytest

import corpus_pipeline
from querent.llm import decontaminate, minhash_dedup, substring_dedup, toxicity

NAMES = ["_h", "_g", "_id", "_key", "_null", "null", "_n", "_spans", "_items", "_rest", "_own", "_own_text", "score", "predicted", "sender", "values", "places", "salt", "fp", "bucket", "key", "copy", "dealt", "size"]
SHARED = " ".join(f"s{i}" for i in range(40))


def docs(spark):
    own = [" ".join(f"{x}{i}" for i in range(40)) for x in "ab"]
    texts = [f"{own[0]} {SHARED}", f"{own[1]} {SHARED} delta", None, "", "one two three four five six seven eight nine ten eleven", "plain words here"]
    rows = [(i, t, *(f"{n}{i}" for n in NAMES)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES))


def values(df):
    return {r["doc_id"]: tuple(r[n] for n in NAMES) for r in df.collect()}


def test_filters_keep_every_value(spark):
    own = docs(spark)
    want = values(own)
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    for got in (minhash_dedup.representatives(own), substring_dedup.cleaned(own), toxicity.accepted(own, toxicity.Grammar()), corpus_pipeline.drop_near_duplicates(spark, own, "")):
        assert got.columns == own.columns and values(got) == want
    clean = decontaminate.clean(own, bench)
    assert clean.columns == own.columns and values(clean) == {i: x for i, x in want.items() if i != 4}


@pytest.mark.parametrize("index_bytes", [decontaminate.INDEX_BYTES, -1])
def test_decontaminate_keeps_every_value(spark, index_bytes):
    own = docs(spark)
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    got = decontaminate.decontaminate(own, bench, index_bytes)
    assert values(got) == values(own)
    assert [r["doc_id"] for r in got.where("contaminated").collect()] == [4]
