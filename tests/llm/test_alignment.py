"""Token alignment against a plain walk over both tokenizers."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from querent.llm import alignment
from tests.conftest import SF
from tests.llm.corpus import empty, frame

ODD = ["x▁y", "a\x00b\rc\td\n e  f\u00a0 g\u2028h", "  two  spaces  ", " ", "   ", "\n", "<|endoftext|> <s> </s> <0x41> <unk>", "naïve café 日本語 текст 👩‍👩‍👧 \u200b\ufeff", "zzzzzzzzzzzzzzzzzz" * 40, "    indented();\r\n}\r\n", "don't we'll I'm", "ﬁ ½ ①", "a" * 3000, "é" * 900]


def plain(texts: list[str | None]) -> list[tuple]:
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each text."""
    both = alignment.pair()
    seen, held = Counter(), []
    for text in texts:
        a = both.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        of_a, of_b = b"".join(both.bytes_a[i] for i in a), b"".join(both.bytes_b[i] for i in b)
        if not text or {of_a, of_b} != {(" " + text).encode()}:
            held.append(None)
            continue
        groups, i, j, at_a, at_b = [], 0, 0, 0, 0
        while i < len(a):
            own_a, own_b = [a[i]], [b[j]]
            at_a, at_b, i, j = at_a + len(both.bytes_a[a[i]]), at_b + len(both.bytes_b[b[j]]), i + 1, j + 1
            while at_a != at_b:
                if at_a < at_b:
                    own_a.append(a[i])
                    at_a, i = at_a + len(both.bytes_a[a[i]]), i + 1
                else:
                    own_b.append(b[j])
                    at_b, j = at_b + len(both.bytes_b[b[j]]), j + 1
            groups.append((own_a, own_b))
        links = [(x, y) for p, q in groups for x in p for y in q]
        seen.update(set(links))
        held.append((len(a), len(b), groups, links))
    best: dict[int, int] = {}
    for (x, _), n in seen.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for own in held:
        if own is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = own
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(seen[x] == best[x[0]] for x in links), sum(seen[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


def rows(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("mapped", [True, False])
def test_documents_equal_a_plain_walk(spark, mapped):
    docs = frame(spark, [*ODD, None, "", "a b a b", "a b a b", *ODD[5:8]]).withColumn("keys", F.lit(1)).withColumn("times", F.lit("x"))
    held = docs.select("doc_id", "text").collect()
    want = sorted(((r["doc_id"], *x) for r, x in zip(held, plain([r["text"] for r in held]), strict=True)), key=str)
    assert rows(alignment.align(docs, map_shards=mapped)) == want


def test_query(spark):
    held = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(((r["doc_id"], *x) for r, x in zip(held, plain([r["text"] for r in held]), strict=True)), key=str)
    assert rows(alignment.op13_alignment(spark, SF)) == want


def test_pieces_give_what_whole_texts_give():
    import public_tokenizers

    both = alignment.Pair(public_tokenizers.path(alignment.BYTE_BPE), public_tokenizers.path(alignment.PIECE_BPE))
    own = [*ODD, "one two\tthree  four\n\n five\u3000six seven ", " lead", ""]
    assert both.cuts and both.ids(own) == [both.whole(x) for x in own] == both.ids(own)


@pytest.mark.parametrize("outer", [0, 3, alignment.OUTER])
def test_large_groups_and_single_documents(monkeypatch, outer):
    monkeypatch.setattr(alignment, "OUTER", outer)
    both = alignment.pair()
    own = [*ODD, "a b a b", ""]
    got = alignment.aligned(both, both.ids(own))
    start = 0
    for i, text in enumerate(own):
        one = alignment.aligned(both, both.ids([text]))
        assert (one.n_a[0], one.n_b[0], one.n_groups[0], one.n_links[0], one.sha[0]) == (got.n_a[i], got.n_b[i], got.n_groups[i], got.n_links[i], got.sha[i])
        stop = int(got.ends[i])
        assert one.keys.tolist() == got.keys[start:stop].tolist() and one.times.tolist() == got.times[start:stop].tolist() and one.times.sum() == one.n_links[0]
        start = stop


def test_chunks():
    import numpy as np

    n = alignment.CHUNK
    assert list(alignment._chunks(np.array([]))) == [] and list(alignment._chunks(np.array([0, 1]))) == [(0, 2)]
    assert list(alignment._chunks(np.array([n, 1, n, n, 0, 1]))) == [(0, 1), (1, 2), (2, 3), (3, 5), (5, 6)]


def test_counts_over_batches_partitions_and_flushes(spark, monkeypatch):
    lists = [[1, 2, 3], [2, 3], [3], [], [1 << 40, 3], [3, 7]] * 50
    found = spark.createDataFrame([(x,) for x in lists], "keys array<long>").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = {r["key"]: r["n"] for r in alignment.counts(found).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == Counter(x for own in lists for x in own)


def test_shards_answer_all_their_keys(spark, tmp_path):
    found = spark.createDataFrame([([k, k + 1, (k % 9) << 32 | k],) for k in range(500)], "keys array<long>")
    by = alignment.counts(found)
    want = {r["key"]: r["n"] for r in by.collect()}
    shards, _, best = alignment.write_shards(by, str(tmp_path / "shards"))
    assert len(shards) == 4
    import numpy as np

    keys = np.array(sorted(want), dtype=np.int64)
    maps = alignment.Shards(str(tmp_path / "shards"), shards)
    assert maps.of(keys).tolist() == [want[k] for k in keys.tolist()] and all(isinstance(x, np.memmap) for own in maps.open.values() for x in own)
    assert best[3] == max(n for k, n in want.items() if k >> 32 == 3)
    with pytest.raises(ValueError, match="no shard"):
        maps.of(np.array([5 << 50], dtype=np.int64))


def test_pair_counts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, None)], "doc_id long, text string")
    got = {(r["a"], r["b"]): r["n"] for r in alignment.pair_counts(docs).collect()}
    both = alignment.pair()
    of = lambda x: (both.a.encode(" " + x).ids[0], both.b.encode(x)[0])
    assert got == {of("a"): 1, of("b"): 2, of("c"): 1}


def test_folders():
    assert alignment.mounted("file:///a/b") == alignment.mounted("file:/a/b") == alignment.mounted("/a/b") == "/a/b"
    assert alignment.mounted("hdfs://n/a") is None and alignment.mounted("s3a://b/c") is None


def test_empty(spark):
    assert alignment.align(empty(spark)).collect() == [] and alignment.align(empty(spark), map_shards=False).collect() == []
    none = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert rows(alignment.align(none)) == sorted([(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")], key=str)
