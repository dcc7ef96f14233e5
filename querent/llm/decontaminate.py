"""Operator 8, benchmark decontamination by winnowing.

A window is WINDOW consecutive words (an item of fewer, but not none, is one window). From
every window the least hash of its GRAM-word grams is its fingerprint. Equal windows have
equal fingerprints, so joining the documents' fingerprints with the items' and extending
each hit to the windows that it stands for finds every shared window. Found windows are
compared word by word.

Where the index of the benchmark's windows, measured as built, is at most INDEX_BYTES, the
windows travel to the documents and the plan is one map without any shuffle. Beyond that,
fingerprints are joined by a shuffle, then windows, and hits return to their documents. How
many documents have a fingerprint of the benchmark is counted over all of them, and in both
joins a frequent one is dealt over as many salts as its count asks for: a document sends a
window once, with all its places, so a window is no more frequent than its fingerprint.
Both ways give the same rows.
"""

from __future__ import annotations

import hashlib
import io
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm import kernels as K
from querent.llm.common import append, fresh, hot_limit, probed, table, texts

WINDOW = 10
GRAM = 5
#: Most bytes of an index that travels, and what a window takes there besides its words and its item's id (342 in all were measured at 60 bytes of words).
INDEX_BYTES, ENTRY_BYTES = 64 << 20, 280
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _folded(piece: K.Piece) -> tuple[K.Piece, K.Words]:
    piece = K.Piece(piece.first, K.lower(piece.data), piece.offsets)
    return piece, K.words(piece, K.ALNUM, False)


def _phrase(piece: K.Piece, w: K.Words, start: int, length: int) -> bytes:
    return b" ".join(piece.data[s:e].tobytes() for s, e in zip(w.starts[start : start + length], w.ends[start : start + length], strict=True))


def _fingerprints(w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, place of each window's fingerprint, gram hashes, window hashes)."""
    starts = K.spread(w.first, WINDOW)
    if not len(starts):
        none = np.empty(0, dtype=np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams = K.windows(w.hashes, GRAM)
    return starts, K.winnow(grams, WINDOW - GRAM + 1)[starts], grams, K.windows(w.hashes, WINDOW)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """size, fp (fingerprint), hash, phrase, item_id (as text) of each item's distinct windows; items without id or words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for piece in K.pieces(batch.column(1)):
                piece, w = _folded(piece)
                owner = K.owners(w.first)
                starts, places, grams, hashes = _fingerprints(w)
                rows += [(WINDOW, int(grams[p].view(np.int64)), int(hashes[s].view(np.int64)), _phrase(piece, w, s, WINDOW), ids[piece.first + owner[s]]) for s, p in zip(starts, places, strict=True)]
                for d in np.flatnonzero((w.counts > 0) & (w.counts < WINDOW)):
                    n, s = int(w.counts[d]), int(w.first[d])
                    h = int(K.windows(w.hashes[s : s + n], n)[0].view(np.int64))
                    rows.append((n, h, h, _phrase(piece, w, s, n), ids[piece.first + d]))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["size", "fp", "hash", "phrase", "item_id"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    return items.mapInArrow(run, "size int, fp long, hash long, phrase binary, item_id string").distinct()


class Index:
    """The windows of a benchmark of checked size, by length."""

    def __init__(self, rows: pa.Table):
        self.sizes: dict[int, np.ndarray] = {}
        self.fps = np.unique(rows["fp"].to_numpy().view(np.uint64)[rows["size"].to_numpy() == WINDOW])
        self.bits = np.zeros(1 << 16, dtype=bool)
        self.bits[self.fps >> np.uint64(48)] = True
        self.items: dict[bytes, list[str]] = defaultdict(list)
        for phrase, item in zip(rows["phrase"].to_pylist(), rows["item_id"].to_pylist(), strict=True):
            self.items[phrase].append(item)
        size, hashes = rows["size"].to_numpy(), rows["hash"].to_numpy().view(np.uint64)
        for n in np.unique(size):
            self.sizes[int(n)] = np.unique(hashes[size == n])

    def has_fp(self, grams: np.ndarray) -> np.ndarray:
        out = self.bits[grams >> np.uint64(48)]
        at = np.flatnonzero(out)
        out[at] = _member(self.fps, grams[at])
        return out


def _member(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _hits(index: Index, piece: K.Piece, w: K.Words) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Mask over the words of a piece, and items by document."""
    n = len(w.hashes)
    edge = np.zeros(n + 1, dtype=np.int32)
    found: dict[int, set[str]] = defaultdict(set)
    for size, hashes in index.sizes.items():
        if size == WINDOW:
            starts, places, grams, windows = _fingerprints(w)
            if not len(starts):
                continue
            picked = np.unique(places)
            hit = np.zeros(len(grams), dtype=bool)
            hit[picked] = index.has_fp(grams[picked])
            starts = starts[hit[places]]
        else:
            starts, windows = K.spread(w.first, size), K.windows(w.hashes, size)
        starts = starts[_member(hashes, windows[starts])]
        if not len(starts):
            continue
        owner = np.searchsorted(w.first, starts, side="right") - 1
        for s, d in zip(starts, owner, strict=True):
            items = index.items.get(_phrase(piece, w, s, size))
            if items:
                found[int(d)].update(items)
                edge[s] += 1
                edge[s + size] -= 1
    return np.cumsum(edge[:-1]) > 0, found


def _row(n_words: int, n_hit: int, items: set[str]) -> tuple:
    return n_words, n_hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n_hit > 0


def _arrays(rows: list[tuple]) -> list[pa.Array]:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)]


def _by_map(docs: DataFrame, windows: DataFrame) -> DataFrame:
    rows = windows.toArrow()
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    sent = docs.sparkSession.sparkContext.broadcast(sink.getvalue())
    held: list[Index] = []

    def work(array: pa.Array) -> list[pa.Array]:
        if not held:
            held.append(Index(pa.ipc.open_stream(sent.value).read_all()))
        out: list[tuple] = []
        for piece in K.pieces(array):
            piece, w = _folded(piece)
            mask, found = _hits(held[0], piece, w)
            total = np.concatenate(([0], np.cumsum(mask)))
            hit = total[w.first[1:]] - total[w.first[:-1]]
            out += [_row(int(n), int(h), found.get(d, set())) for d, (n, h) in enumerate(zip(w.counts, hit, strict=True))]
        return _arrays(out)

    return append(docs, "text", RESULT, work)


def salted_join(rows: DataFrame, by: DataFrame, counts: DataFrame, total: int, on: list[str]) -> DataFrame:
    """rows (_key, fp, ...) joined with by (fp, ...). counts has the rows of each fp (_n), total in all. Beyond hot_limit(total),
    which at most common.HOT keys exceed, a key's rows are dealt by _key over _n / hot_limit salts, and its rows of by go to each."""
    limit = hot_limit(total)
    hot = F.broadcast(counts.where(F.col("_n") > limit).select("fp", F.ceil(F.col("_n") / limit).cast("int").alias("_g")))
    groups = F.coalesce("_g", F.lit(1))
    dealt = rows.join(hot, "fp", "left").withColumn("_salt", F.pmod(F.xxhash64("_key"), groups).cast("int")).drop("_g")
    each = by.join(hot, "fp", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), groups - 1))).drop("_g")
    return dealt.join(each, [*on, "_salt"]).drop("_salt")


def _by_shuffle(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Fingerprints join, then windows join; every group is one document's hits. A text's hash tells documents of one id apart."""
    key, span_name, item_name, count_name = (fresh(x, docs) for x in ("_key", "_spans", "_items", "_n"))
    keyed = docs.withColumn(key, F.sha2("text", 256))
    short = sorted(r[0] for r in windows.where(F.col("size") < WINDOW).select("size").distinct().collect())

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.pieces(batch.column(1)):
                piece, w = _folded(piece)
                _, places, grams, _ = _fingerprints(w)
                fp = [np.unique(np.stack([np.searchsorted(w.first, p := np.unique(places), side="right") - 1, grams[p].view(np.int64)]), axis=1)] if len(places) else []
                for size in short:
                    if len(s := K.spread(w.first, size)):
                        fp.append(np.unique(np.stack([np.searchsorted(w.first, s, side="right") - 1, K.windows(w.hashes, size)[s].view(np.int64)]), axis=1))
                both = np.concatenate(fp, axis=1) if fp else np.empty((2, 0), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[1]), batch.column(0).take(pa.array(both[0] + piece.first))], names=["fp", "_key"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(2).to_pylist()
            for piece in K.pieces(batch.column(1)):
                piece, w = _folded(piece)
                owner = K.owners(w.first)
                starts, places, grams, _ = _fingerprints(w)
                own = [set(x) for x in fps[piece.first : piece.first + piece.n]]
                todo = [(WINDOW, s, fp) for s, p in zip(starts, places, strict=True) if (fp := int(grams[p].view(np.int64))) in own[owner[s]]]
                for size in short:
                    h = K.windows(w.hashes, size)
                    todo += [(size, s, fp) for s in K.spread(w.first, size) if (fp := int(h[s].view(np.int64))) in own[owner[s]]]
                spots: dict[tuple, list[int]] = defaultdict(list)
                for size, s, fp in todo:
                    spots[piece.first + owner[s], fp, size, _phrase(piece, w, s, size)].append(int(s - w.first[owner[s]]))
                cols = list(zip(*spots, strict=True)) or [()] * 4
                spans = [np.array(x, dtype="<i8").tobytes() for x in spots.values()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary()), pa.array(spans, pa.binary())], names=["_key", "fp", "size", "phrase", "spots"])

    unique = keyed.select(F.col(key).alias("_key"), "text").dropDuplicates(["_key"])
    marked = unique.mapInArrow(marks, "fp long, _key string")
    fps = windows.select("fp").distinct()
    counts, seen = probed(marked.groupBy("fp").agg(F.count(F.lit(1)).alias("_n")).join(fps, "fp", "left_semi"), [F.coalesce(F.sum("_n"), F.lit(0))])
    candidates = salted_join(marked, counts.select("fp"), counts, seen[1], ["fp"]).groupBy("_key").agg(F.collect_set("fp").alias("fps"))
    found = unique.join(candidates, "_key").mapInArrow(extend, "_key string, fp long, size int, phrase binary, spots binary")
    hits = salted_join(found, windows.select("fp", "phrase", "item_id"), counts, seen[1], ["fp", "phrase"])
    by_doc = hits.groupBy(F.col("_key").alias(key)).agg(F.collect_set(F.struct("spots", "size")).alias(span_name), F.array_sort(F.collect_set("item_id")).alias(item_name))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, items, count = (batch.column(batch.schema.get_field_index(x)).to_pylist() for x in (span_name, item_name, count_name))
            rows = []
            for own, found, n in zip(spans, items, count, strict=True):
                mask = np.zeros(n, dtype=bool)
                for x in own or ():
                    for at in np.frombuffer(x["spots"], dtype="<i8"):
                        mask[at : at + x["size"]] = True
                rows.append(_row(n, int(mask.sum()), set(found or ())))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(x)) for x in plain] + _arrays(rows), names=plain + NAMES)

    def count(array: pa.Array) -> list[pa.Array]:
        return [pa.array(np.concatenate([_folded(p)[1].counts for p in K.pieces(array)] or [np.empty(0, dtype=np.int64)]))]

    plain = [c for c in docs.columns if c not in NAMES]
    joined = append(keyed.join(by_doc, key, "left"), "text", f"`{count_name}` long", count)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in plain) + ", " + RESULT
    return joined.mapInArrow(finish, schema)


NAMES = [x.split()[0] for x in RESULT.split(", ")]


def decontaminate(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs with n_words, n_hit (words inside any occurrence of an item's window), n_items, items_sha256, contaminated.

    Null texts have no words; an empty benchmark hits nothing; repeated documents and items count as they stand.
    """
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.coalesce(F.col("text").cast("string"), F.lit(""))})
    size = F.octet_length("phrase") + F.octet_length("item_id") + ENTRY_BYTES
    windows, seen = probed(item_windows(benchmark), [F.coalesce(F.sum(size), F.lit(0))])
    return (_by_map if seen[1] <= index_bytes else _by_shuffle)(docs, windows)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any window of the benchmark; their columns and texts are unchanged."""
    own = [F.col(c).alias(f"_own_{c}") for c in docs.columns]
    found = decontaminate(docs.select(*own, "doc_id", "text"), benchmark)
    return found.where("not contaminated").select(*(F.col(f"_own_{c}").alias(c) for c in docs.columns))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    return decontaminate(texts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark")).select("doc_id", *NAMES)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8_SQL = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (
  SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
h AS (SELECT doc_id, p, size, item_id FROM dw JOIN iw USING (size, phrase)),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS x FROM (SELECT DISTINCT doc_id, p, size FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
