"""Operator 10's seeds: anchors of which one side occurs in another document."""

from __future__ import annotations

import numpy as np
import pytest

from querent.llm import exchange, kernels, run_length_dedup


def _sides_of(spark, rows, n):
    """Places of the marks that repeated_sides finds in (doc_id, text), and those that comparing the bytes gives."""
    docs = exchange.keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r["doc_id"], x) for r in exchange.repeated_sides(docs, run_length_dedup._seeds, n).collect() for x in exchange.unpack(r["places"]).tolist()}
    reach, window = run_length_dedup.REACH, run_length_dedup.WINDOW
    names, held = {}, {}
    for d, text in rows:
        raw = text.encode()
        piece = kernels.Piece(0, np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
        for at, low, high in zip(*(x.tolist() for x in (lambda a: (a[0], a[2], a[3]))(run_length_dedup._anchors(piece))), strict=True):
            left = [(0, raw[at - reach : at + run_length_dedup.ANCHOR])] if low <= at - reach else []
            right = [(1, raw[at : at + window - reach])] if high >= at + window - reach else []
            assert left or right
            names[d, at] = left + right
            for x in left + right:
                held.setdefault(x, set()).add(d)
    return got, {k for k, v in names.items() if any(len(held[x]) > 1 for x in v)}, names


@pytest.mark.parametrize("batch", [1, 2, 10_000])
def test_seeds_that_only_share_an_anchor_are_left_out(spark, batch):
    """Anchors that recur between other bytes are no seeds; a side that another document has makes one, whichever sender has which side."""
    rng = np.random.default_rng(3)
    noise = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    common = noise(run_length_dedup.ANCHOR)
    alone = [(i, "".join(noise(60) + common for _ in range(20)) + noise(60)) for i in range(12)]
    a, b = noise(400), noise(400)
    shared = [(20, a + noise(90)), (21, noise(90) + a), (22, noise(33) + a[:300] + noise(50)), (23, a[100:] + b[:200]), (24, b), (25, noise(70) + b[150:210] + noise(70))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        for n in (1, 7):
            got, want, names = _sides_of(spark, alone, n)
            assert not want and not got and len({x for v in names.values() for x in v}) > 100
            got, want, _ = _sides_of(spark, [x for pair in zip(shared, alone, strict=False) for x in pair], n)
            assert got == want and want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_chance_anchors_are_no_contexts(spark):
    """What the shards get follows what documents repeat, not how often short strings recur by chance."""
    rng = np.random.default_rng(5)
    noise = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    common = [noise(24) for _ in range(40)]
    rows = [(i, "".join(noise(40) + common[j] for j in rng.integers(0, 40, 60))) for i in range(30)]
    passage = noise(200)
    rows += [(100, noise(50) + passage), (101, passage + noise(50))]
    docs = exchange.keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    found = run_length_dedup.marked(docs, exchange.copies(docs), 4, 512, 4096).collect()
    assert {r["doc_id"] for r in found} == {101}
    seeds = exchange.repeated_sides(docs, run_length_dedup._seeds, 4).collect()
    assert {r["doc_id"] for r in seeds} == {100, 101}
    assert {r["doc_id"]: r["n_removed"] for r in run_length_dedup.dedup(docs.select("doc_id", "text"), keep_text=False).where("n_removed > 0").collect()} == {101: 200}
