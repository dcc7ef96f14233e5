"""Operators 2, 4 and 10 against brute force."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from querent.llm import components, decontaminate, kernels, minhash_dedup, run_length_dedup, substring_dedup
from querent.llm.run_index import RunIndex
from tests.llm.corpus import empty, frame, sha, texts, words


def shingles(text):
    w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("block", [1024, 2])
def test_near_duplicates(spark, block):
    docs = frame(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    want = Counter()
    for i, (d, _) in enumerate(rows):
        known = [x for x in least[root(i)] if x is not None]
        low = min(known) if known else None
        want[d, len(sets[i]), low, d == low] += 1
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(docs, block).collect())
    assert got == want


@pytest.mark.parametrize("block", [1024, 5])
def test_family_of_edited_copies(spark, block):
    """Copies with a few edits each: most pairs are not links, and no copy links to most others."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for _ in range(120):
        own = list(base)
        for _ in range(rng.randint(1, 5)):
            own[rng.randrange(150)] = f"e{rng.random()}"
        rows.append(" ".join(own))
    sets = [shingles(t) for t in rows]
    low = list(range(len(rows)))
    for _ in range(len(rows)):
        for i in range(len(rows)):
            for j in range(i):
                if low[i] != low[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    low[i] = low[j] = min(low[i], low[j])
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs, block).collect()}
    assert got == dict(enumerate(low)) and 1 < len(set(low)) < len(rows)


def test_chain_of_near_copies(spark):
    """Each links to the next only; the ends are far apart."""
    rng = random.Random(2)
    own = [f"w{rng.random()}" for _ in range(120)]
    rows = []
    for _ in range(12):
        rows.append(" ".join(own))
        own = [*own[3:], *(f"w{rng.random()}" for _ in range(3))]
    got = {r["component_id"] for r in minhash_dedup.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == {0}


def test_threshold_is_a_parameter(spark):
    """A pair of Jaccard 0.82 is one in the pipeline and two for op2."""
    base = [f"w{i}" for i in range(204)]
    edited = [*base[:100], "x", *base[101:150], "y", *base[151:180], "z", *base[181:200], "v", *base[201:]]
    a, b = shingles(" ".join(base)), shingles(" ".join(edited))
    assert 80 * len(a | b) <= 100 * len(a & b) < 85 * len(a | b)
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(edited)), (3, "another text")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in minhash_dedup.representatives(docs).collect()) == [1, 2, 3]
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 3]
    like = minhash_dedup.limits(85)
    assert (like.bands, like.rows) == (32, 6)
    for percent in (80, 85):
        like = minhash_dedup.limits(percent)
        assert (1 - (percent / 100) ** like.rows) ** like.bands <= minhash_dedup.MISSED and like.bands * like.rows <= minhash_dedup.PERMUTATIONS


def test_representatives_keep_columns(spark):
    docs = frame(spark)
    kept = minhash_dedup.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids))
    gone = {r["doc_id"] for r in docs.collect()} - set(ids)
    assert gone == {r["doc_id"] for r in minhash_dedup.near_duplicates(docs).where("not kept").collect()}


def test_estimate():
    rng = np.random.default_rng(4)
    for share in (0.5, 0.85, 0.95):
        size = 2000
        both = int(2 * size * share / (1 + share))
        x = rng.integers(0, 2**63, 2 * size - both).astype(np.uint64)
        a, b = (minhash_dedup.odd_sketch(minhash_dedup.signature(s)) for s in (x[:size], x[size - both :]))
        assert minhash_dedup.estimate(int(np.unpackbits(a ^ b).sum())) == pytest.approx(share, abs=0.13)


@pytest.mark.parametrize("n", [0, 3, 4, 8, 15, 16, 17, 29, 30, 200])
def test_winnow_in_stretches(n):
    """Stretches of 16 grams pick the places that the whole array would, ties (equal upper bits) to the left."""
    grams = np.random.default_rng(n).integers(0, 6 << 4, n).astype(np.uint64)
    want = [min(range(i, i + 4), key=lambda j: (int(grams[j]) >> 4, j)) for i in range(n - 3)]
    assert kernels.winnow(grams, 4, bits=4).tolist() == want


def test_winnow_of_more_than_a_stretch():
    grams = kernels.mix(np.arange((1 << 24) + 1000, dtype=np.uint64))
    got = kernels.winnow(grams, 26)
    assert len(got) == len(grams) - 25
    tail = (1 << 24) - 500
    assert (got[tail:] == kernels.winnow(grams[tail:], 26) + tail).all()


def test_components(spark):
    edges = [(5, 4), (4, 9), (1, 2), (2, 3), (3, 1), (7, 7)] + [(100, i) for i in range(101, 150)] + [(i, i + 1) for i in range(200, 260)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got[9] == 4 and got[3] == 1 and got[149] == 100 and got[260] == 200 and 7 not in got


@pytest.mark.parametrize("window, anchor, many, crowd", [(35, 18, 512, 4096), (6, 3, 512, 4096), (35, 18, 0, 4096), (6, 3, 1, 4096), (6, 3, 512, 1), (35, 18, 2, 2)])
def test_repeated_passages(spark, window, anchor, many, crowd):
    docs = frame(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    count = Counter(tuple(w[i : i + window]) for _, t in rows for w in [words(t)] for i in range(len(w) - window + 1))
    want = Counter()
    for d, t in rows:
        w = words(t)
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want[d, len(w), len(gone), sha(kept), kept.decode() if gone else t] += 1
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["text"]) for r in substring_dedup.dedup(docs, window, anchor, many=many, crowd=crowd).collect())
    assert got == want
    cleaned = substring_dedup.cleaned(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()


@pytest.mark.parametrize("many, crowd", [(None, 4096), (64, 1), (1, 4096), (0, 4096), (2, 3)])
def test_smaller_documents_bytes(spark, many, crowd):
    docs = frame(spark)
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    order = lambda d: (d is None, d or 0)
    least: dict[bytes, tuple] = {}
    for d, b in rows:
        for i in range(len(b) - 49):
            s = b[i : i + 50]
            least[s] = min(least.get(s, order(d)), order(d))
    want = Counter()
    for d, b in rows:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < order(d):
                gone[i : i + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want[d, len(b), int(gone.sum()), spans, sha(np.frombuffer(b, dtype=np.uint8)[~gone].tobytes())] += 1
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run_length_dedup.dedup(docs, many=many, crowd=crowd).collect())
    assert got == want


def test_run_index_streams_any_string():
    """Pointers share as many bytes as any text place; windows are found just where the text has them, with their least owner."""
    rng = np.random.default_rng(1)
    for _ in range(40):
        base = bytes(rng.integers(97, 97 + int(rng.integers(1, 5)), 200).astype(np.uint8))
        own = []
        for _ in range(int(rng.integers(1, 30))):
            a, n = int(rng.integers(0, 150)), int(rng.integers(1, 85))
            own.append(base[a : a + n])
        owners, width = rng.integers(0, 10, len(own)), int(rng.integers(8, 30))
        index = RunIndex(np.frombuffer(b"".join(own), dtype=np.uint8), np.array([len(s) for s in own]), owners, width)
        assert all(len(v) <= len(index.starts) + 1 for x, v in vars(index).items() if isinstance(v, np.ndarray) and x not in ("text", "code", "edges"))
        asked = [*own[:5], *(base[a : a + 60] for a in rng.integers(0, 190, 8)), b"zzabbcab" * 6, bytes(rng.integers(97, 101, 80).astype(np.uint8))]
        strings, sizes = np.frombuffer(b"".join(asked), dtype=np.uint8), np.array([len(s) for s in asked])
        pointer, least = index.stream(strings, sizes)
        hit = set(index.matched(strings, sizes, pointer).tolist())
        raw, at = b"\xff".join(own) + b"\xff", 0
        for q in asked:
            for i in range(len(q)):
                most = max(m for m in range(len(q) - i + 1) if q[i : i + m] in raw)
                p = pointer[at + i]
                assert raw[p : p + most] == q[i : i + most] if most else p < 0
                holders = [o for o, x in zip(owners, own, strict=True) if len(q) - i >= width and q[i : i + width] in x]
                assert (at + i in hit) == bool(holders)
                assert not holders or least[at + i] == min(holders)
            at += len(q)


def test_empty_tables(spark):
    assert minhash_dedup.near_duplicates(empty(spark)).count() == 0
    assert minhash_dedup.representatives(empty(spark)).count() == 0
    assert substring_dedup.dedup(empty(spark)).count() == 0
    assert run_length_dedup.dedup(empty(spark)).count() == 0


def test_no_repeats(spark):
    docs = spark.createDataFrame([(1, texts()[0]), (2, None)], "doc_id long, text string")
    assert substring_dedup.dedup(docs).agg({"n_removed": "sum"}).first()[0] == 0
    assert run_length_dedup.dedup(docs).agg({"n_removed": "sum"}).first()[0] == 0
    assert minhash_dedup.near_duplicates(docs).where("kept").count() == 2


def _passages(*rows):
    """joined passages of one anchor: bytes of each, and all end to end."""
    held = [(" ".join(r) + " ").encode() for r in rows]
    return np.array([len(x) for x in held]), np.frombuffer(b"".join(held), dtype=np.uint8)


def test_automata_decide():
    """A phrase counts where it is found, inside longer passages too; candidates that occur once are refuted."""
    a, b = [f"a{i}" for i in range(6)], [f"b{i}" for i in range(9)]
    sizes, data = _passages(["x", *a, "y"], a, b)
    of, start, size = substring_dedup._located(np.array([5, 5, 9], dtype=np.uint64), np.ones(3, dtype=np.int64), sizes, data, 6)
    assert list(zip(of.tolist(), start.tolist(), size.tolist(), strict=True)) == [(0, 1, 6), (1, 0, 6)]
    of, start, size = substring_dedup._located(np.array([5, 9], dtype=np.uint64), np.array([1, 2]), *_passages(a, b), 6)
    assert list(zip(of.tolist(), start.tolist(), size.tolist(), strict=True)) == [(1, 0, 9)]
    assert not len(substring_dedup._located(np.array([9], dtype=np.uint64), np.array([1]), *_passages(b), 6)[0])


def thue_morse(flip):
    out = [flip]
    for _ in range(10):
        out += [1 - x for x in out]
    return "".join("ab"[x] for x in out)


def test_patterned_words_differ(spark):
    """Words of 1024 letters that a polynomial modulo a power of two can't tell apart."""
    x, y = thue_morse(0), thue_morse(1)
    rest = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"{x} {x} {x} {rest}"), (2, f"{y} {y} {y} {rest}"), (3, f"{x} {y}"), (4, f"{y} {x}")], "doc_id long, text string")
    want = {d: len(shingles(t)) for d, t in docs.collect()}
    rows = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(docs).collect()}
    assert {d: r["n_shingles"] for d, r in rows.items()} == want and rows[4]["component_id"] == 4
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup(docs).collect()} == {1: 60, 2: 60, 3: 0, 4: 0}


def test_distinct_spans_confirm():
    """Strings of one hash are told apart by their bytes, whatever their length."""
    own = [b"a", b"b", b"a", b"long enough to need blocks", b"long enough to need blockz", b"long enough to need blocks", b"", b"", b"a\\x00"]
    sizes = np.array([len(x) for x in own])
    data, starts = np.frombuffer(b"".join(own), dtype=np.uint8), np.cumsum(sizes) - sizes
    for hashes in (np.zeros(len(own), dtype=np.uint64), kernels.spans(data, starts, starts + sizes)):
        first, of = kernels.distinct_spans(data, starts, sizes, hashes)
        assert [own[first[i]] for i in of] == own and len(first) == len(set(own))


def test_text_longer_than_a_stretch_of_winnow(spark):
    """One text of over 2**24 bytes: passages near its end are found by operators 4, 8 and 10."""
    rng = np.random.default_rng(1)
    words = np.array(["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 7))) for _ in range(5000)])
    big = " ".join(words[rng.integers(0, 5000, 3_500_000)])
    assert len(big) > 1 << 24
    passage = big[17_000_000:17_002_000]
    docs = spark.createDataFrame([(1, passage), (2, big), (3, f"x {passage[100:900]} y")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in run_length_dedup.dedup(docs, keep_text=False).collect()} == {1: 0, 2: 2000, 3: 800}
    inner = passage.split(" ")
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup(docs, keep_text=False).collect()}
    assert got[1] == got[2] and len(inner) - 2 <= got[1] <= len(inner)
    bench = spark.createDataFrame([(1, " ".join(inner[5:40]))], "item_id long, text string")
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.decontaminate(docs, bench).collect()}[2] == 35


def test_no_two_sets_share_a_name(spark, monkeypatch):
    """Names that clash are made anew; results are those without a clash."""
    from pyspark.sql import functions as F

    real = minhash_dedup.signatures
    monkeypatch.setattr(minhash_dedup, "signatures", lambda docs, like, salt=0: real(docs, like, salt).withColumn("key", F.when(F.lit(salt) == 0, F.col("key") % 3).otherwise(F.col("key"))))
    docs = frame(spark)
    assert minhash_dedup.signed(docs, minhash_dedup.limits(85))[2] == 1
    got = sorted(map(tuple, minhash_dedup.near_duplicates(docs).drop("_h", "key").collect()), key=str)
    monkeypatch.setattr(minhash_dedup, "signatures", real)
    assert minhash_dedup.signed(docs, minhash_dedup.limits(85))[2] == 0
    assert got == sorted(map(tuple, minhash_dedup.near_duplicates(docs).drop("_h", "key").collect()), key=str)
