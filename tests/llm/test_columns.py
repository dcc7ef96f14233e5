"""Operators 1, 3, 5, 6, 7, 8 and 9: brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querent.llm.common import texts as plain_texts
from querent.llm import decontaminate, encode, kernels, language_id, media_columns, packing, sharding, token_counts, toxicity
from querent.llm.transducers import Machine, compose
from tests.llm.corpus import empty, frame, sha, texts

# --- media -------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=20_000))
def test_container_round_trip(data):
    payload = media_columns.padded(data)
    assert len(payload) % 192 == 0 and payload.startswith(data)
    (track,) = media_columns.demux(media_columns.mux(payload))
    media = media_columns.mux(payload)
    assert media_columns.payload(media, track) == payload
    assert track.codec == "raw " and track.duration == len(payload)
    assert all(media[s:e] == payload[i * 16 * 192 : i * 16 * 192 + 192] for i, (s, e) in enumerate(track.key_ranges))


def test_foreign_container():
    """Sizes by sample, several chunk runs, 64-bit offsets and a 64-bit box size."""
    box, full = media_columns.box, media_columns.full
    stsz = full(b"stsz", struct.pack(">5I", 0, 3, 4, 5, 6))
    stsc = full(b"stsc", struct.pack(">7I", 2, 1, 2, 1, 2, 1, 1))
    stsd = full(b"stsd", struct.pack(">I", 1), box(b"avc1", b"\0" * 70))
    stts = full(b"stts", struct.pack(">5I", 2, 2, 10, 1, 20))
    mdhd = full(b"mdhd", struct.pack(">4I2H", 0, 0, 1000, 40, 0, 0))
    make = lambda at: box(b"moov", box(b"trak", box(b"mdia", mdhd, box(b"minf", box(b"stbl", stsd, stts, full(b"stss", struct.pack(">2I", 1, 3)), stsc, stsz, full(b"co64", struct.pack(">I2Q", 2, at, at + 20)))))))
    head = make(0)
    data = bytes(range(64))
    wide = struct.pack(">I4sQ", 1, b"mdat", 16 + len(data)) + data
    media = make(len(head) + 16) + wide
    (track,) = media_columns.demux(media)
    assert (track.codec, track.duration) == ("avc1", 40)
    assert media_columns.payload(media, track) == data[:9] + data[20:26]
    assert [media[s:e] for s, e in track.key_ranges] == [data[20:26]]


@pytest.mark.parametrize("duration", [1000, (1 << 32) - 1, 1 << 32, 1 << 40])
def test_durations_of_any_size(duration):
    media = media_columns.box(b"moov", media_columns.box(b"trak", media_columns.box(b"mdia", media_columns.timed(b"mdhd", struct.pack(">I", 8000), duration, struct.pack(">2H", 0, 0)))))
    (track,) = media_columns.demux(media)
    assert (track.timescale, track.duration) == (8000, duration)


def test_media_query_rows(spark):
    docs = frame(spark)
    rows = media_columns.append(docs.select("doc_id", "text"), "text", media_columns.DIGEST, media_columns._digest).collect()
    assert len(rows) == docs.count()
    for r in rows:
        payload = media_columns.padded((r["text"] or "").encode())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((r["text"] or "").encode()), len(payload), sha(payload), zlib.crc32(payload[-16:]))
    stored = media_columns.inspect(media_columns.store(docs))
    assert stored.where("error is not null or codec <> 'raw '").count() == 0
    broken = spark.createDataFrame([(b"",), (b"\0\0\0\x05moov",), (None,), (b"junk" * 9,)], "media binary")
    assert media_columns.inspect(broken).where("error is null").count() == 0


# --- tokens ------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_cached_ids_are_exact(text):
    enc = encode.encoder()
    got = enc.ids([text])[0]
    assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == enc.exact(text)


@pytest.mark.parametrize("text", ["a's don't", "<|endoftext|> b", "<|ENDOFTEXT|> b", "x$$$. y", "...  ,a, .", "İ ΣΑΣ ß", "É́ é . ", "12ab. x y\x1cz", "µª º"])
def test_odd_texts(text):
    test_cached_ids_are_exact.hypothesis.inner_test(text)


@pytest.mark.parametrize("n", [1, 2, 3, 255, 4095, 4096, 4097, 12_288 + 77])
def test_cuts(n):
    own = packing.cuts(n)
    assert sum(own) == n and own == sorted(own, reverse=True) and all(k & (k - 1) == 0 and k <= 4096 for k in own)
    assert len({k for k in own if k < 4096}) == sum(k < 4096 for k in own)


def test_packing(spark):
    """Every piece that the documents' ids give, once each, and no other; repeated rows and null ids too."""
    docs = frame(spark)
    rows = packing.pieces(docs, keep_ids=True).collect()
    enc = encode.encoder()
    want = Counter()
    for r in docs.collect():
        ids, start = [*enc.exact(r["text"] or ""), packing.END], 0
        for k in packing.cuts(len(ids)):
            own = tuple(ids[start : start + k])
            want[r["doc_id"], start, k, own, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own)), len(ids)] += 1
            start += k
        assert start == len(ids)
    assert Counter((r["doc_id"], r["start"], r["length"], tuple(r["ids"]), r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    assert len({r["sequence_id"] for r in rows}) == len(rows) and all(r["offset"] == 0 and r["length"] == 1 << r["bucket"] for r in rows)
    with pytest.raises(ValueError):
        packing.pieces(docs, context=1000)


def test_histogram(spark):
    docs = frame(spark)
    enc = encode.encoder()
    lengths = [len(enc.exact(r["text"] or "")) for r in docs.collect()]
    sums = token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(docs)))
    rows = {r["n_tokens"]: r for r in sums.collect()}
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"]) == (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert (r["docs_total"], r["tokens_total"], r["truncated_total"]) == (len(lengths), sum(lengths), sum(min(x, n) for x in lengths))
    assert token_counts.truncated_total(sums, 17).first()[0] == sum(min(x, 17) for x in lengths)
    assert token_counts.quantile(sums, 0.5).first()[0] == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    none = token_counts.suffix_sums(token_counts.histogram(token_counts.lengths(empty(spark))))
    assert none.count() == 0 and token_counts.quantile(none, 0.5).first()[0] is None and token_counts.truncated_total(none, 5).first()[0] == 0


# --- sharding ----------------------------------------------------------------------------


def test_shards(spark):
    rows = [*texts(), *["same text"] * 40, *["pair", "pair"]]
    docs = frame(spark, rows)
    got = sharding.assign(docs).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == docs.count() and max(counts.values()) - min(counts[s] for s in range(8)) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    size = {r["doc_id"]: (len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()}
    assert all((r["size"], r["text_crc32"]) == size[r["doc_id"]] for r in got if r["doc_id"] is not None)
    places = defaultdict(Counter)
    for r in got:
        places[r["size"], r["text_crc32"]][r["shard"]] += 1
    assert len(places[10, zlib.crc32(b"same text")]) <= 4  # larger than a shard: as few shards as can hold it
    assert sum(len(p) > 1 for p in places.values()) == 1


def _parted(spark, groups):
    """The groups, lists of nodes, that more than one shard has; row counts are at most one apart."""
    nodes = spark.createDataFrame([(i,) for g in groups for i in g], "node long")
    members = spark.createDataFrame([(i, k) for k, g in enumerate(groups) for i in g], "node long, grp long")
    shard = {r["node"]: r["shard"] for r in sharding.propagate(nodes, members, 8).collect()}
    counts = Counter(shard.values())
    assert len(shard) == sum(map(len, groups)) and max(counts.values()) - min(counts.values()) <= 1
    return [g for g in groups if len({shard[i] for i in g}) > 1]


@pytest.mark.parametrize("alone", [0, 150])
def test_copies_gather_without_unlinked_documents(spark, alone):
    """600 pairs and 40 triples, with no or few documents that could make room."""
    groups, at = [], 0
    for size in [2] * 600 + [3] * 40 + [1] * alone:
        groups.append(list(range(at, at + size)))
        at += size
    parted = _parted(spark, groups)
    assert len(parted) <= 32


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 4), st.integers(0, 4)).filter(lambda x: x[0] != x[1]), st.integers(1, 9)), st.lists(st.integers(0, 9), min_size=5, max_size=5))
def test_quotas_keep_counts(asked, free):
    go, back = sharding._quotas(asked, free)
    assert set(go) == set(asked) and all(0 <= go[x] <= asked[x] for x in asked)
    both = [*go.items(), *back.items()]
    assert all(sum(n for (a, _), n in both if a == s) == sum(n for (_, b), n in both if b == s) for s in range(5))
    assert all(sum(n for (a, _), n in back.items() if a == s) <= free[s] for s in range(5))
    assert not any(asked[a, b] > go[a, b] and asked.get((b, a), 0) > go.get((b, a), 0) for a, b in asked)


def test_overlapping_groups_gather(spark):
    nodes = spark.range(400).withColumnRenamed("id", "node")
    members = spark.createDataFrame([(i, g) for g in range(40) for i in (3 * g, 3 * g + 1, 3 * g + 2, 3 * g + 3)], "node long, grp long")
    shard = {r["node"]: r["shard"] for r in sharding.propagate(nodes, members, 8).collect()}
    cut = lambda at: sum(at[3 * g + i] != at[3 * g + j] for g in range(40) for i in range(4) for j in range(i))
    counts = Counter(shard.values())
    assert len(shard) == 400 and max(counts.values()) - min(counts.values()) <= 1
    rng = random.Random(0)
    assert cut(shard) < 0.5 * cut({i: rng.randrange(8) for i in range(400)})


def test_shards_of_nothing(spark):
    assert sharding.assign(empty(spark)).count() == 0


# --- decontamination ---------------------------------------------------------------------

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def folded(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


@pytest.mark.parametrize("index_bytes", [decontaminate.INDEX_BYTES, -1])
def test_decontamination(spark, index_bytes):
    docs = frame(spark)
    own = texts()
    items = [(1, own[1][40:300]), (2, "short one"), (3, None), (4, "!!!"), (5, own[0].upper()), (5, "a b c d"), (None, "b"), (10, (own[2] or "").replace(" ", "--")), (6, "A")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = folded(t)
        n = min(10, len(w))
        if i is not None and n:
            for p in range(len(w) - n + 1):
                windows[tuple(w[p : p + n])].add(str(i))
    want = Counter()
    for r in docs.collect():
        w, hit, found = folded(r["text"]), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if (key := tuple(w[p : p + n])) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[key]
        want[r["doc_id"], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    got = Counter(tuple(r) for r in decontaminate.decontaminate(docs.select("doc_id", "text"), bench, index_bytes).select("doc_id", *decontaminate.NAMES).collect())
    assert got == want
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({k[0]: 0 for k in want} | Counter(k[0] for k, n in want.items() for _ in range(n) if not k[-1])) - Counter()


def test_decontamination_of_frequent_windows(spark):
    """A window in every document, often in one of them, is dealt over salts by its measured count; rows are those of the map."""
    passage = "a phrase that is in every document of this table " * 2
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit(passage), F.when(F.col("id") == 7, F.lit(passage * 300)).otherwise(F.concat(F.lit("and then "), F.col("id")))).alias("text"))
    bench = spark.createDataFrame([(i, f"{passage} {i}") for i in range(3)] + [(9, "every document")], "item_id long, text string")
    ways = [Counter(map(tuple, decontaminate.decontaminate(docs, bench, n).select("doc_id", *decontaminate.NAMES).collect())) for n in (decontaminate.INDEX_BYTES, -1)]
    assert ways[0] == ways[1] and sum(ways[0].values()) == 5000 and all(row[-1] for row in ways[0])


def test_salts_follow_counts(spark):
    rows = spark.range(9000).select(F.when(F.col("id") < 6000, 1).otherwise(F.col("id")).cast("long").alias("fp"), F.col("id").cast("string").alias("_key"))
    by = rows.select("fp").distinct().withColumn("item", F.lit("x"))
    joined = decontaminate.salted_join(rows, by, rows.groupBy("fp").agg(F.count(F.lit(1)).alias("_n")), 9000, ["fp"])
    assert joined.columns == ["fp", "_key", "item"] and joined.distinct().count() == joined.count() == 9000
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan
    salts = rows.where("fp = 1").groupBy(F.expr("pmod(xxhash64(_key), 6)")).count().collect()
    assert len(salts) == 6 and max(r["count"] for r in salts) < 2 * 1024


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0
    assert decontaminate.decontaminate(frame(spark), bench).where("contaminated").count() == 0
    assert decontaminate.decontaminate(frame(spark), bench, -1).where("contaminated").count() == 0


def test_buckets_hold_one_length(spark, tmp_path):
    packed = packing.pieces(frame(spark))
    packing.write_buckets(packed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == packed.count()
    for folder in (tmp_path / "out").glob("bucket=*"):
        sizes = {r["length"] for r in spark.read.parquet(str(folder)).select("length").distinct().collect()}
        assert sizes == {1 << int(folder.name.split("=")[1])}


# --- learned operators -------------------------------------------------------------------


def test_language_id(spark):
    rng = random.Random(1)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "eit", "ver"], "cc": ["éa", "ou", "ré", "ço"]}
    make = lambda lang, k: " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(k))
    rows = [(i, make(lang, rng.randint(3, 40)), lang) for i, lang in enumerate(list(parts) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs.where("doc_id % 3 <> 1 or doc_id % 2 = 0").select("text", "lang"))
    assert sorted(model.langs) == ["aa", "bb", "cc"] and (model.rates < 0.01).all()
    got = language_id.identify(docs, model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.97 * len(rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "日本"), (5, "K"), (6, "x" * 100_000)], "doc_id long, text string")
    pred = {r["doc_id"]: r for r in language_id.identify(odd, model).collect()}
    assert [pred[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(pred[i]["lang_pred"] in parts for i in (4, 5, 6))
    assert all(0 <= r["score"] <= 1 for r in pred.values())
    none = language_id.fit(docs.where("false").select("text", "lang"))
    assert {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"}


def test_sliced_filters_hold_what_was_put_in():
    import numpy as np

    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 2**63, 5000).astype(np.uint64)
    owners = rng.integers(0, 70, 5000)
    model = language_id.build([f"l{i}" for i in range(70)], hashes, owners)
    masks = model.masks(hashes)
    assert all(masks[i, o // 64] >> np.uint64(o % 64) & np.uint64(1) for i, o in enumerate(owners))


def test_shares_against_plain_counting(spark):
    """Corrected popcounts of the filters are the shares of n-grams in plain sets of each language's frequent ones."""
    rng = random.Random(4)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["ka", "ung", "eit", "ver"], "cc": ["éa", "ou", "lo", "ço"]}
    rows = [(" ".join("".join(rng.choices(parts[x], k=3)) for _ in range(rng.randint(1, 30))), x) for x in [*parts] * 30]
    plain = lambda t: " " + re.sub("[^a-zé-ÿç]+", " ", t.lower())

    def found(text):
        raw = plain(text).encode()
        return [raw[i : i + n] for n in language_id.GRAMS for i in range(len(raw) - n + 1)]

    sets = {}
    for x in parts:
        count = Counter(g for t, y in rows if x == y for g in found(t))
        total = {n: sum(c for g, c in count.items() if len(g) == n) for n in language_id.GRAMS}
        sets[x] = {g for g, c in count.items() if c / total[len(g)] >= language_id.LEAST}
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    asked = [t for t, _ in rows[:40]] + ["kalo zzz ungver", "qq"]
    (piece,) = kernels.pieces(pa.array(asked))
    shares = model.shares(piece)
    for i, t in enumerate(asked):
        own = found(t)
        assert shares[i].tolist() == pytest.approx([sum(g in sets[x] for g in own) / len(own) for x in model.langs], abs=1e-6)


def test_toxicity(spark):
    rng = random.Random(2)
    clean = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    bad = ["zorkel", "mufftan"]
    rows, labels = [], []
    for i in range(600):
        own = rng.choices(clean, k=30)
        toxic = int(i % 5 == 0)
        if toxic:
            # aimed at someone, or twice
            word = rng.choice(bad) + rng.choice(["", "er", "ish"])
            own[5:7], own[20] = ("you", word) if i % 2 else (word, own[6]), own[20] if i % 2 else word
        rows.append((i, " ".join(own) + ". And so on.", "en"))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([*labels, *labels[:3], (None, 1), (7, None)], "doc_id long, toxic int")
    grammar = toxicity.learn(docs, marks)
    got = {r["doc_id"]: r for r in toxicity.score(docs, grammar).withColumn("held", toxicity.held_out()).collect()}
    held = [(got[i]["predicted"], t) for i, t in labels if got[i]["held"]]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    kept = toxicity.accepted(frame(spark), grammar)
    assert kept.columns == frame(spark).columns and kept.count() == frame(spark).count()


def test_grammar_scores_clauses():
    g = toxicity.Grammar({"idiot": 3.0, "lowei*": 2.0}, {"kill": 1.0})
    bare, aimed = 3.0 * toxicity.UNDIRECTED, 3.0 * toxicity.TARGETED
    assert g.clause(["an", "idiot"]) == g.clause(["not", "a", "b", "c", "idiot"]) == bare
    assert g.clause(["you", "are", "an", "idiot"]) == g.clause(["idiot", "that", "you", "are"]) == aimed
    assert g.clause(["not", "an", "idiot"]) == bare * toxicity.NEGATED
    assert g.clause(["she", "said", "idiot"]) == pytest.approx(aimed * toxicity.REPORTED)
    assert g.clause(["an", "idiot"], quoted=True) == pytest.approx(bare * toxicity.REPORTED)
    assert g.clause(["i", "kill", "you"]) == toxicity.TARGETED and g.clause(["you", "kill", "time"]) == g.clause(["kill", "a", "b", "c", "d", "you"]) == toxicity.UNDIRECTED
    assert g.clause(["loweiig"]) == 2.0 * toxicity.UNDIRECTED and g.clause(["lowei"]) == 0.0
    assert g.clause(["idiot", "idiot"]) == 2 * bare


def test_one_undirected_insult_is_not_toxic(spark):
    rows = [(i, "a b zorkel c. d zorkel" if i % 2 else f"a b c{i % 7} d", i % 2) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    grammar = toxicity.fit(docs.select("text", "toxic"))
    got = toxicity.score(spark.createDataFrame([(1, "a zorkel b"), (2, "you zorkel"), (3, "zorkel. b zorkel"), (4, ""), (5, None)], "doc_id long, text string"), grammar).collect()
    assert [r["predicted"] for r in got] == [0, 1, 1, 0, 0] and got[0]["score"] > got[3]["score"] == got[4]["score"]


def test_threats_end_to_end(spark):
    """With a grammar learned from labels: aimed threats are toxic; negated, reported and undirected ones score less."""
    grammar = toxicity.learn(plain_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    own = ["I will kill you", "we burn them", "I will not kill you", "she said I will kill you", "kill time", "a fire to burn wood", "", "plain words"]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, grammar).collect()}
    assert got[0] >= toxicity.THRESHOLD and got[1] >= toxicity.THRESHOLD
    assert max(got[2], got[3]) < got[0] and max(got[4], got[5]) < toxicity.THRESHOLD and got[6] == got[7] < got[4]


def test_threats_are_learned(spark):
    """A threat that clean documents aim at someone as often as toxic ones do loses its weight; one that only toxic ones aim keeps it."""
    rows = [(i, f"x{i % 9} we hurt you now" if i % 4 else "nothing here", int(i % 2)) for i in range(200)] + [(300 + i, "they shoot you" if i % 2 else "nothing", i % 2) for i in range(100)]
    grammar = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int").select("text", "toxic"))
    assert grammar.threats.get("hurt", 0.0) < grammar.threats["kill"] and grammar.threats["shoot"] > 3


_SYMBOLS = st.lists(st.sampled_from([*toxicity._PLAIN, toxicity.INSULT, toxicity.THREAT]), max_size=9)


def _run(machine, symbols):
    """Weight of the one path of a deterministic machine."""
    state, weight = machine.start, 1.0
    for x in symbols:
        if (state, x) not in machine.arcs:
            return 0.0
        ((state, written, own),) = machine.arcs[state, x]
        assert written == x
        weight *= own
    return weight * machine.final.get(state, 0.0)


@settings(max_examples=400, deadline=None)
@given(_SYMBOLS, st.booleans())
def test_composition_is_the_product_of_its_machines(symbols, quoted):
    rest = _run(toxicity.negation_machine(), symbols) * _run(toxicity.report_machine(quoted), symbols)
    insult, threat = toxicity.grammar_machines(quoted)
    path = [[(x, 1.0)] for x in symbols]
    assert insult.weight(path) == pytest.approx(_run(toxicity.insult_machine(), symbols) * _run(toxicity.target_machine(), symbols) * rest)
    assert threat.weight(path) == pytest.approx(_run(toxicity.threat_machine(), symbols) * rest)


def test_compose_follows_what_is_written():
    """The second machine reads what the first writes, over all paths of both."""
    a = Machine(0, {(0, "x"): [(0, "y", 2.0), (1, "z", 3.0)], (1, "x"): [(1, "y", 1.0)]}, {1: 1.0})
    b = Machine(0, {(0, "y"): [(0, "p", 0.5)], (0, "z"): [(0, "q", 4.0), (1, "q", 7.0)]}, {0: 1.0, 1: 10.0})
    both = compose(a, b)
    assert both.weight([[("x", 1.0)]]) == 3 * 4 + 3 * 7 * 10
    # the nucleus is first (then y in state 0 only) or second
    assert both.weight([[("x", 1.0)]] * 2) == 3 * 4 * 0.5 + 2 * 0.5 * (3 * 4 + 3 * 7 * 10)


_CLAUSE = re.compile(r"[\n!.;?]")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["idiot", "IDIOT", "loweiig", "töten", "don'tcare", "kill", "not", "you", "é", "日", "x", "²", "٣", "'", "’", "“", "”", "¡", "…", "«", "\u00a0", "»", "_", "7", " ", ".", "\n", "𝒳", "\U0001F600"]), max_size=8).map("".join), max_size=5))
def test_every_clause_of_a_word_is_read(rows):
    """Scores of batches equal those of a grammar that reads every clause."""
    g = toxicity.Grammar({"idiot": 3.0, "lowei*": 2.0, "don'tcare": 4.0, "é'x": 1.5}, {"kill": 1.0, "töten": 1.0})
    low = [t.translate(toxicity._FOLD) for t in rows]
    want = [sum(g.clause(toxicity._WORD.findall(c), c.count('"') >= 2 or "“" in c or "«" in c) for c in _CLAUSE.split(t)) for t in low]
    assert g.raws(pa.array(rows, pa.string()), g.compiled()).sum(axis=1).tolist() == pytest.approx(want)


@pytest.mark.parametrize("text", ["¡idiota!", "“idiota”", "l’idiota", "…idiota", "«\u00a0idiota\u00a0»", "idiota—", "don'tcare", "x'don'tcare"])
def test_words_at_typographic_punctuation(text):
    g = toxicity.Grammar({"idiot*": 3.0, "don'tcare": 3.0, "tcare": 3.0}, {})
    assert g.raws(pa.array([text, "nothing"]), g.compiled())[0].sum() > 0


def test_broken_bytes_are_no_letters():
    data = [b"\xc3", b"\xa9t idiot\xff", b"\xe2\x80idiot", b"\xc0\xafidiot", b"\xed\xa0\x80idiot", b"\xf4\x90\x80\x80idiot", b"\xf0\x9f"]
    offsets = pa.array([0, *(sum(map(len, data[: i + 1])) for i in range(len(data)))], pa.int32())
    texts = pa.Array.from_buffers(pa.string(), len(data), [None, offsets.buffers()[1], pa.py_buffer(b"".join(data))])
    g = toxicity.Grammar({"idiot": 3.0}, {})
    assert g.raws(texts, g.compiled()).sum(axis=1).tolist() == [0.0, 1.5, 1.5, 1.5, 1.5, 1.5, 0.0]


def test_grammar_without_labels(spark):
    docs = frame(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.learn(docs, none)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty(spark), toxicity.Grammar()).count() == 0
