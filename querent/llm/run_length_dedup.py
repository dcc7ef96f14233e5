"""Operator 10, suffix-array dedup by a run-length index.

A byte goes if a WINDOW-byte string that covers it also starts in a document of smaller
doc_id. An index of the whole corpus in one place can't be had, so the corpus is cut where
matches are possible at all:

0. A document whose whole text a smaller one has is settled; only its smallest copy goes on.
1. Seeds. Every window has an anchor, the least of its hashed ANCHOR-byte strings; equal
   windows have equal anchors. Short strings recur by chance, more of them the larger the corpus,
   so an anchor has two names: REACH bytes before it and itself, and itself and what follows up to
   WINDOW - REACH bytes in all. A window has one of both whole, so ``repeated_sides`` finds the
   anchors of which one name is in several documents.
2. Shards. Around each such anchor, the bytes of the windows that have it (its context) go to
   the shard of the anchor's hash. A sender sends equal contexts once, from its smallest
   document; contexts that are equal in the shard are one string there. Hashes propose which
   are equal, their bytes decide.
3. Index. The strings of a shard that a newer document could repeat become a run-compressed
   Burrows-Wheeler index with sampled run ends, and those that an older document could have
   stream through it. Matching statistics truncated at WINDOW give the windows that the index
   has, and the run that a window lands in the smallest document of all that have it. A
   window is marked if that is smaller than its own. A context that is whole in a smaller
   document is marked throughout.
4. An anchor in over MANY different contexts of one sender, or CROWD of all in its shard (the edge
   of a line that very many documents share), would fill an index that grows with the corpus. Its
   windows go out one by one instead, equal ones of a sender once, to buckets of the hash of their
   bytes: from the sender, or from the shard, which is told so. There equal windows meet whole: their bytes are
   compared, and the smallest document of each decides.
5. Marks return to their documents, whose covered bytes go, judged on the input alone.

Every pair of equal windows meets in the shard of their common anchor, or in the bucket of
their hash, so marks are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm import kernels as K
from querent.llm.common import buckets, grouped, stored_bytes, table
from querent.llm.exchange import FIELDS, SENT, by_sender, copies, groups, keyed, pack, record, repeated_sides, row, sender_ids, senders, unpack, with_places
from querent.llm.run_index import RunIndex

WINDOW = 50
ANCHOR = 16
#: A window has so many bytes before its anchor, or all that are left of it from there on.
REACH = (WINDOW - ANCHOR) // 2
#: Bytes of documents whose anchors are found at a time: what is computed for them stays in the processor's caches.
PIECE = 1 << 18
#: Stored bytes of input for each shard of anchors and contexts.
SHARD_BYTES = 2 << 20
#: Different contexts of an anchor that a sender sends to its shard at most.
MANY = 512
#: Different contexts of an anchor that a shard puts in an index at most.
CROWD = 4096
#: Stored bytes of a sender, about; of many senders each sends fewer contexts of an anchor to its shard, LEAST_MANY at least.
SENDER_BYTES, LEAST_MANY = 16 << 20, 8
#: Bytes of contexts in one index; all contexts of an anchor are in the same one.
INDEX_BYTES = 1 << 18


def _anchors(piece: K.Piece, total: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first byte, byte after the last) of the anchors of a piece and of the windows that have them. total: ``K.sums`` of its bytes."""
    starts = K.spread(piece.offsets, WINDOW)
    if not len(starts):
        return starts, np.empty(0, dtype=np.uint64), starts, starts
    grams = K.windows(K._BYTE[piece.data], ANCHOR, total)
    places = K.winnow(grams, WINDOW - ANCHOR + 1)[starts]
    first, size = groups(places)
    at = places[first]
    return at, grams[at], starts[first], starts[first + size - 1] + WINDOW


def _seeds(piece: K.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    total = K.sums(K._BYTE[piece.data])
    at, hashes, low, high = _anchors(piece, total)
    doc = np.searchsorted(piece.offsets, at, side="right") - 1
    sides = np.zeros((len(at), 2), dtype=np.uint64)
    left, right = np.flatnonzero(low <= at - REACH), np.flatnonzero(high >= at + WINDOW - REACH)
    sides[left, 0] = np.maximum(K.runs(total, at[left] - REACH, ANCHOR + REACH), np.uint64(1))
    sides[right, 1] = np.maximum(K.runs(total, at[right], WINDOW - REACH), np.uint64(1))
    return doc, at - piece.offsets[doc], hashes, sides


def _gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """data[starts[i]:starts[i]+lengths[i]] end to end."""
    total = int(lengths.sum())
    base = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return data[base + np.arange(total)]


def _every(lengths: np.ndarray) -> np.ndarray:
    """A bit for each window of contexts of these lengths (WINDOW bytes at least)."""
    return (np.uint64(1) << (lengths - WINDOW + 1).astype(np.uint64)) - np.uint64(1)


def _later(own: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether a smaller document has the same string, least document of each string)."""
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, of, own)
    return own > least[of], least


def _send(n: int, many: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sender, batch in senders(batches):
            order_of = np.frombuffer(sender_ids(batch), dtype=np.int64)[: batch.num_rows]
            parts: list[tuple[np.ndarray, ...]] = []
            shift = 0
            for piece in K.pieces(batch.column(1), PIECE):
                wanted = np.zeros(len(piece.data), dtype=bool)
                for d, x in enumerate(batch.column(3).slice(piece.first, piece.n).to_pylist()):
                    wanted[piece.offsets[d] + unpack(x)] = True
                at, hashes, low, high = _anchors(piece)
                own = wanted[at]
                at, hashes, low, high = at[own], hashes[own], low[own], high[own]
                doc = np.searchsorted(piece.offsets, at, side="right") - 1
                sizes = high - low
                parts.append((doc + piece.first, low - piece.offsets[doc], sizes, hashes, K.spans(piece.data, low, high), np.cumsum(sizes) - sizes + shift, _gathered(piece.data, low, sizes)))
                shift += len(parts[-1][-1])
            if not shift:
                continue
            docs, base, lengths, hashes, content, starts, data = map(np.concatenate, zip(*parts, strict=True))
            own = order_of[docs]
            first, of = K.distinct_spans(data, starts, lengths, content)
            later, _ = _later(own, of, len(first))
            rows = [row(-1, sender, ids=sender_ids(batch), docs=pack(docs[later]), places=pack(base[later]), values=_every(lengths[later]).astype("<u8").tobytes())]
            asks = np.flatnonzero(~later)
            order = asks[np.lexsort((of[asks], hashes[asks]))]
            first, size = groups(hashes[order])
            new = np.ones(len(order), dtype=np.int64)
            new[1:] = of[order][1:] != of[order][:-1]
            wide = np.add.reduceat(new, first) > many if len(first) else np.empty(0, dtype=bool)
            hot = order[np.repeat(wide, size)]
            if len(hot):
                named = hashes[order[first[wide]]]
                for b in np.unique(named % np.uint64(n)):
                    rows.append(row(int(b), sender, values=named[named % np.uint64(n) == b].tobytes()))
                rows += _windows_sent(sender, n, docs[hot], own[hot], base[hot], lengths[hot], _gathered(data, starts[hot], lengths[hot]))
            asks = np.sort(order[~np.repeat(wide, size)])
            to = (hashes % np.uint64(n)).astype(np.int64)
            by = asks[np.argsort(to[asks], kind="stable")]
            edges = np.searchsorted(to[by], np.arange(n + 1))
            for b in np.flatnonzero(np.diff(edges)):
                k = by[edges[b] : edges[b + 1]]
                head = own[k].tobytes() + hashes[k].tobytes() + lengths[k].astype(np.uint8).tobytes()
                rows.append(row(int(b), sender, docs=pack(docs[k]), places=pack(base[k]), values=head + _gathered(data, starts[k], lengths[k]).tobytes()))
            yield record(rows)

    return send


#: Contexts that are cut into windows at a time.
SLICE = 1 << 14


def _windows_sent(sender: int, n: int, docs: np.ndarray, own: np.ndarray, base: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> list[tuple]:
    """Rows for each window of some contexts of a sender: equal ones once to buckets from n on, those of later documents as marks."""
    ends, rows = np.cumsum(lengths), []
    for at in range(0, len(lengths), SLICE):
        low = int(ends[at] - lengths[at])
        offsets = np.concatenate(([low], ends[at : at + SLICE])) - low
        part = data[low : low + int(offsets[-1])]
        starts = K.spread(offsets, WINDOW)
        of = at + np.searchsorted(offsets, starts, side="right") - 1
        place, owner, doc = base[of] + starts - offsets[of - at], own[of], docs[of]
        hashes = K.spans(part, starts, starts + WINDOW)
        first, same = K.distinct_spans(part, starts, np.full(len(starts), WINDOW), hashes)
        later, _ = _later(owner, same, len(first))
        if later.any():
            rows.append(row(-1, sender, docs=pack(doc[later]), places=pack(place[later]), values=np.ones(int(later.sum()), dtype="<u8").tobytes()))
        left = np.flatnonzero(~later)
        to = n + (hashes[left] % np.uint64(n)).astype(np.int64)
        left = left[np.argsort(to, kind="stable")]
        edges = np.searchsorted(np.sort(to), n + np.arange(n + 1))
        for b in np.flatnonzero(np.diff(edges)):
            k = left[edges[b] : edges[b + 1]]
            rows.append(row(n + int(b), sender, docs=pack(doc[k]), places=pack(place[k]), values=owner[k].tobytes() + _gathered(part, starts[k], np.full(len(k), WINDOW)).tobytes()))
    return rows


def _windows_answered(group: pa.Table) -> pa.Table:
    """Marks of the windows of a bucket that a smaller document has; marks pass."""
    group = group.select(FIELDS)
    cols = {x: group[x].to_pylist() for x in FIELDS}
    if cols["bucket"][0] < 0:
        return group
    sizes = [len(x) // 4 for x in cols["docs"]]
    owner = np.concatenate([np.frombuffer(v, dtype=np.int64, count=k) for v, k in zip(cols["values"], sizes, strict=True)])
    data = np.concatenate([np.frombuffer(v, dtype=np.uint8, offset=8 * k) for v, k in zip(cols["values"], sizes, strict=True)])
    starts = np.arange(len(owner)) * WINDOW
    first, of = K.distinct_spans(data, starts, np.full(len(starts), WINDOW), K.spans(data, starts, starts + WINDOW))
    later, _ = _later(owner, of, len(first))
    rows, at = [], 0
    for i, size in enumerate(sizes):
        hit = later[at : at + size]
        at += size
        if hit.any():
            rows.append(row(-1, cols["sender"][i], docs=pack(unpack(cols["docs"][i])[hit]), places=pack(unpack(cols["places"][i])[hit]), values=np.ones(int(hit.sum()), dtype="<u8").tobytes()))
    return pa.Table.from_batches([record(rows)])


def _marks(own: np.ndarray, hashes: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For each context of a shard, a bit for each of its windows that a smaller document has. hashes: of their anchors."""
    starts = np.cumsum(lengths) - lengths
    first, string = K.distinct_spans(data, starts, lengths, K.spans(data, starts, starts + lengths))
    later, least = _later(own, string, len(first))
    out = np.where(later, _every(lengths), np.uint64(0))
    # an anchor with one context in the shard is settled by that
    anchor = np.unique(hashes[first], return_inverse=True)[1]
    many = np.flatnonzero(np.bincount(anchor)[anchor] > 1)
    if not len(many):
        return out
    many = many[np.argsort(anchor[many], kind="stable")]
    begins, count = groups(anchor[many])
    newest = np.repeat(np.maximum.reduceat(least[many], begins), count)
    oldest = np.repeat(np.minimum.reduceat(least[many], begins), count)
    size = np.cumsum(lengths[first[many]])
    ends = begins + count
    every = np.zeros(len(first), dtype=np.uint64)
    begin = 0
    for end in ends[np.searchsorted(size[ends - 1] // INDEX_BYTES, np.arange(int(size[-1]) // INDEX_BYTES + 1), side="right") - 1].tolist() + [len(many)]:
        if end > begin:
            of = many[begin:end]
            held, asked = of[least[of] < newest[begin:end]], of[least[of] > oldest[begin:end]]
            if len(held):
                every[asked] = _window_bits(data, starts[first], lengths[first], least, held, asked)
            begin = end
    return np.where(out > 0, out, every[string])


def _window_bits(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, own: np.ndarray, held: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """For each asked string, a bit for each of its windows that a smaller document has in a held one."""
    index = RunIndex(_gathered(data, starts[held], lengths[held]), lengths[held], own[held], WINDOW)
    queries, sizes = _gathered(data, starts[asked], lengths[asked]), lengths[asked]
    pointer, least = index.stream(queries, sizes)
    at = index.matched(queries, sizes, pointer)
    begins = np.cumsum(sizes) - sizes
    of = np.searchsorted(begins, at, side="right") - 1
    smaller = least[at] < own[asked][of]
    bits = np.zeros(len(asked), dtype=np.uint64)
    np.bitwise_or.at(bits, of[smaller], np.uint64(1) << (at - begins[of])[smaller].astype(np.uint64))
    return bits


def _answer(n: int, crowd: int):
    def answer(group: pa.Table) -> pa.Table:
        group = group.select(FIELDS)
        cols = {x: group[x].to_pylist() for x in FIELDS}
        bucket = cols["bucket"][0]
        if bucket < 0 or bucket >= n:
            return group
        rows, asked, named = [], [], [np.empty(0, dtype=np.uint64)]
        for i in range(group.num_rows):
            if cols["docs"][i] is None:
                named.append(np.frombuffer(cols["values"][i], dtype=np.uint64))
            else:
                asked.append(i)
        if asked:
            sizes = [len(cols["docs"][i]) // 4 for i in asked]
            held = [cols["values"][i] for i in asked]
            own = np.concatenate([np.frombuffer(h, dtype=np.int64, count=k) for h, k in zip(held, sizes, strict=True)])
            hashes = np.concatenate([np.frombuffer(h, dtype=np.uint64, count=k, offset=8 * k) for h, k in zip(held, sizes, strict=True)])
            lengths = np.concatenate([np.frombuffer(h, dtype=np.uint8, count=k, offset=16 * k) for h, k in zip(held, sizes, strict=True)]).astype(np.int64)
            data = np.concatenate([np.frombuffer(h, dtype=np.uint8, offset=17 * k) for h, k in zip(held, sizes, strict=True)])
            docs = np.concatenate([unpack(cols["docs"][i]) for i in asked])
            base = np.concatenate([unpack(cols["places"][i]) for i in asked])
            sender = np.repeat([cols["sender"][i] for i in asked], sizes)
            starts = np.cumsum(lengths) - lengths
            wide = np.isin(hashes, np.concatenate([*named, K.crowded(data, starts, lengths, hashes, crowd)]))
            for s in np.unique(sender[wide]):
                k = np.flatnonzero(wide & (sender == s))
                rows += _windows_sent(int(s), n, docs[k], own[k], base[k], lengths[k], _gathered(data, starts[k], lengths[k]))
            k = np.flatnonzero(~wide)
            if len(k):
                marks = np.zeros(len(own), dtype=np.uint64)
                marks[k] = _marks(own[k], hashes[k], lengths[k], _gathered(data, starts[k], lengths[k]) if wide.any() else data)
                edges = np.concatenate(([0], np.cumsum(sizes)))
                for j, i in enumerate(asked):
                    at = np.flatnonzero(marks[edges[j] : edges[j + 1]]) + edges[j]
                    if len(at):
                        rows.append(row(-1, cols["sender"][i], docs=pack(docs[at]), places=pack(base[at]), values=marks[at].astype("<u8").tobytes()))
        return pa.Table.from_batches([record(rows)])

    return answer


def marked(docs: DataFrame, whole: DataFrame, n: int, many: int, crowd: int) -> DataFrame:
    """(doc_id, _h, places, values) of keyed documents that are no copies (whole): starts of contexts, and bits of the windows from there that are marked."""
    docs = with_places(docs, whole).where("copy is null").drop("copy")
    seeds = repeated_sides(docs, _seeds, n, PIECE)
    found = with_places(docs, seeds, "inner").select("doc_id", "text", "_h", "places").mapInArrow(_send(n, many), SENT)

    def split(df: DataFrame) -> DataFrame:
        # rows that are answered have bucket -1 and are dealt by their sender
        return df.withColumn("dealt", F.when(F.col("bucket") < 0, F.col("sender")).otherwise(-1))

    first = grouped(split(found), n, ["bucket", "dealt"], _answer(n, crowd), SENT)
    return by_sender(grouped(split(first), n, ["bucket", "dealt"], _windows_answered, SENT), 8, n)


def _gone(piece: K.Piece, copy: list[bool | None], places: list[bytes | None], values: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, byte after the last) of the maximal runs of covered bytes in the documents of a piece, ascending; no run crosses documents."""
    of = [d for d, x in enumerate(places) if x and not copy[d]]
    at = [unpack(places[d]) for d in of]
    base = np.repeat(piece.offsets[of], [len(x) for x in at])
    starts = np.concatenate([*at, np.empty(0, dtype=np.int64)]) + base
    bits = np.unpackbits(np.frombuffer(b"".join(values[d] for d in of), dtype=np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    context, offset = np.nonzero(bits)
    low = np.sort(starts[context] + offset)  # contexts of a document can overlap
    high = low + WINDOW
    sizes = np.diff(piece.offsets)
    whole = np.flatnonzero(np.array([bool(x) for x in copy]) & (sizes >= WINDOW))
    low, high = np.concatenate([low, piece.offsets[whole]]), np.concatenate([high, piece.offsets[whole + 1]])
    order = np.argsort(low, kind="stable")
    low, high = low[order], high[order]
    doc = np.searchsorted(piece.offsets, low, side="right")
    new = np.ones(len(low) + 1, dtype=bool)
    new[1:-1] = (low[1:] > high[:-1]) | (doc[1:] != doc[:-1])
    return low[new[:-1]], high[new[1:]]


def dedup(docs: DataFrame, keep_text: bool = True, many: int | None = None, crowd: int = CROWD) -> DataFrame:
    """doc_id, _h, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and kept (binary) if wanted.

    Null and empty texts have no bytes. Documents of one doc_id are not smaller than each other. kept need not be valid UTF-8.
    """
    docs = keyed(docs)
    schema = "doc_id long, _h long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.pieces(batch.column(1), PIECE):
                own = batch.slice(piece.first, piece.n)
                low, high = _gone(piece, *(own.column(i).to_pylist() for i in (3, 4, 5)))
                edge = np.zeros(len(piece.data) + 1, dtype=np.int8)
                edge[low] += 1
                edge[high] -= 1  # of one document, where that of another may begin
                data = piece.data[np.cumsum(edge[:-1], dtype=np.int8) == 0]
                doc = np.searchsorted(piece.offsets, low, side="right") - 1
                removed = np.bincount(doc, weights=high - low, minlength=piece.n).astype(np.int64)
                sizes = np.diff(piece.offsets)
                ends = np.cumsum(sizes - removed).tolist()
                kept = [data[a:b].data for a, b in zip([0, *ends], ends, strict=False)]
                arrays = [own.column(0), own.column(2), pa.array(sizes), pa.array(removed), pa.array(np.bincount(doc, minlength=piece.n).astype(np.int64))]
                arrays.append(pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()))
                if keep_text:
                    arrays.append(pa.array([x.tobytes() for x in kept], pa.binary()))
                names = ["doc_id", "_h", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                yield pa.RecordBatch.from_arrays(arrays, names=names[: 6 + keep_text])

    if many is None:
        many = max(LEAST_MANY, min(MANY, 8 * CROWD * SENDER_BYTES // max(1, stored_bytes(docs))))
    whole = copies(docs)
    found = marked(docs, whole, buckets(docs, SHARD_BYTES), many, crowd)
    return with_places(with_places(docs, whole), found).select("doc_id", "text", "_h", "copy", "places", "values").mapInArrow(run, schema)


def op10_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that a smaller document repeats."""
    return dedup(table(spark, sf_dir, "documents"), keep_text=False).drop("_h")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, p, sha256(substr(x, 2 * p + 1, 100)) AS h FROM (SELECT doc_id, x, unnest(range(0, CAST(length(x) // 2 - 49 AS BIGINT))) AS p FROM d WHERE length(x) >= 100)),
m AS (SELECT h, min(doc_id) AS low FROM s GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM s JOIN m USING (h) WHERE s.doc_id > m.low),
k AS (SELECT doc_id, x, unnest(range(0, CAST(length(x) // 2 AS BIGINT))) AS p FROM d),
o AS (SELECT k.doc_id, string_agg(substr(k.x, 2 * k.p + 1, 2), '' ORDER BY k.p) AS kept FROM k ANTI JOIN g ON k.doc_id = g.doc_id AND k.p = g.p GROUP BY k.doc_id),
r AS (SELECT doc_id, count(*) AS n, count(DISTINCT p - i) AS spans FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM g) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(r.spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(o.kept, ''))) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id) LEFT JOIN r USING (doc_id)
"""
