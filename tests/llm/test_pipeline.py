"""The pipeline stage by stage, each against brute force on its own input."""

from __future__ import annotations

import zlib
from collections import Counter

import corpus_pipeline
from querent.llm import encode, packing, toxicity
from querent.llm.common import table
from tests.conftest import SF
from tests.llm.corpus import words
from tests.llm.test_columns import folded
from tests.llm.test_dedup import shingles


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, held = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        held[name] = docs
        if k < 4:
            assert docs.columns == columns
    rows = {name: {r["doc_id"]: r["text"] for r in df.collect()} for name, df in held.items() if name != "packing"}
    source = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    grammar = toxicity.learn(table(spark, SF, "documents"), table(spark, SF, "labels"))
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.score(table(spark, SF, "documents"), grammar).collect()}
    assert set(rows["toxicity"]) == {d for d in source if not scores[d]}
    own = {d: shingles(t) for d, t in rows["toxicity"].items()}
    kept = rows["minhash_dedup"]
    root = {d: d for d in own}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(own)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if own[a] and own[b] and 100 * len(own[a] & own[b]) >= corpus_pipeline.NEAR_PERCENT * len(own[a] | own[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(kept) == {d for d in own if find(d) == d}
    assert set(rows["substring_dedup"]) == set(kept)
    own_words = {d: words(t) for d, t in kept.items()}
    seen = Counter(tuple(w[p : p + 35]) for w in own_words.values() for p in range(len(w) - 34))
    for d, w in own_words.items():
        gone = {q for p in range(len(w) - 34) if seen[tuple(w[p : p + 35])] > 1 for q in range(p, p + 35)}
        assert words(rows["substring_dedup"][d]) == [x for q, x in enumerate(w) if q not in gone]
    assert sum(map(len, own_words.values())) > sum(len(words(t)) for t in rows["substring_dedup"].values())
    items = [folded(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    windows = {tuple(w[p : p + 10]) for w in items for p in range(max(1, len(w) - 9)) if w}
    dirty = {d for d, t in rows["substring_dedup"].items() for w in [folded(t)] if any(tuple(w[p : p + n]) in windows for n in {len(x) for x in windows} for p in range(len(w) - n + 1))}
    assert set(rows["decontamination"]) == set(kept) - dirty
    enc, want = encode.encoder(), Counter()
    for d, t in rows["decontamination"].items():
        ids, start = [*enc.exact(t or ""), packing.END], 0
        for k in packing.cuts(len(ids)):
            want[d, start, k, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[start : start + k])), len(ids)] += 1
            start += k
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in held["packing"].collect()) == want
