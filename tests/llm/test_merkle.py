"""Merkle manifests against a plain tree."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from querent.llm import merkle
from tests.conftest import SF
from tests.llm.corpus import empty, frame


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def brute(rows: list[dict]) -> list[tuple]:
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    own = lambda r, text: h("".join(map(one, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))))
    by: dict[str | None, list[dict]] = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, own(r, r["text"])))
        trees[s] = levels([own(r, r["text"]) for r in by[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            text = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            node, proof = own(r, text), ""
            for tree, at in ((trees[s], i), (top, k)):
                for nodes in tree[:-1]:
                    run, slot = nodes[at // 3 * 3 : at // 3 * 3 + 3], at % 3
                    proof += "".join(run[:slot] + run[slot + 1 :])
                    node = h("".join([*run[:slot], node, *run[slot + 1 :]]))
                    at //= 3
            out.append((r["doc_id"], own(r, r["text"]), trees[s][-1][0], top[-1][0], h(proof), node, node == top[-1][0]))
    return sorted(out, key=str)


def tampered():
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return {"text": F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}


def odd(spark):
    """Null, empty and repeated rows of many sources, among them a null one, an empty one and one that sorts by bytes."""
    names = [None, "", "a", "Z", "é", "\U0001f600", "￿", "one", "n"]
    docs = frame(spark)
    pick = F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(13)) % 9 + 1).cast("int"))
    return docs.withColumn("source", F.when(F.coalesce("doc_id", F.lit(0)) < 250, F.lit("hot")).otherwise(pick)).withColumn("place", F.lit(9)).withColumn("_part", F.lit(1)).withColumn("tree", F.lit("t"))


@pytest.mark.parametrize("height", [1, 2, 7])
def test_rows_equal_a_plain_tree(spark, height):
    docs = odd(spark)
    manifest = merkle.build(docs, tampered(), height)
    got = merkle.audit(manifest).drop("siblings").collect()
    assert sorted(map(tuple, got), key=str) == brute([r.asDict() for r in docs.collect()])
    if height == 1:
        assert len(manifest.sources) > 2 and len(manifest.top) > 1


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(map(tuple, merkle.op11_merkle(spark, SF).collect()), key=str) == brute([r.asDict() for r in docs.collect()])


def test_stored_preimages_are_the_tree(spark):
    docs = odd(spark).where("source = 'hot'")
    rows = {(r["level"], r["position"]): r for r in merkle.parents(merkle.build(docs, levels=2)).collect()}
    tree = levels([r["leaf"] for r in merkle.audit(merkle.build(docs.orderBy("doc_id"))).orderBy(F.col("doc_id").asc_nulls_first(), "leaf").collect()])
    assert {k: r["node"] for k, r in rows.items()} == {(i, j): x for i, level in enumerate(tree) if i for j, x in enumerate(level)}
    assert all(r["preimage"] == "".join(tree[i - 1][3 * j : 3 * j + 3]) and r["source"] == "hot" for (i, j), r in rows.items())


def test_one_changed_row_changes_the_root_and_its_own_proof_only(spark):
    docs = odd(spark).where("source = 'hot' and doc_id is not null").dropDuplicates(["doc_id"])
    low = docs.agg(F.min("doc_id")).first()[0]
    got = {r["doc_id"]: r for r in merkle.audit(merkle.build(docs, {"lang": F.when(F.col("doc_id") == low, "xx").otherwise(F.col("lang"))})).collect()}
    assert [i for i, r in got.items() if not r["verified"]] == [low]
    assert len({r["root"] for r in got.values()}) == 1 and got[low]["folded_root"] != got[low]["root"]


def test_equal_rows_are_spread_and_kept(spark):
    docs = frame(spark, ["same"] * 40).withColumn("doc_id", F.lit(1).cast("long"))
    got = merkle.audit(merkle.build(docs, levels=1)).collect()
    assert sorted(map(tuple, got), key=str)[0][1] == got[0]["leaf"] and len(got) == 41
    assert all(r["verified"] for r in got)


def test_single_and_empty(spark):
    one = frame(spark, ["a"]).limit(1)
    row = merkle.audit(merkle.build(one)).collect()[0]
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["proof_sha256"] == h("") and row["verified"]
    manifest = merkle.build(empty(spark))
    assert merkle.audit(manifest).collect() == [] and merkle.parents(manifest).collect() == []
