"""Operator 4, substring dedup by repeated-phrase automata.

A window is WINDOW consecutive words of one document; a word is removed if a window that
covers it starts anywhere else too.

1. Seeds. Every window has an anchor, the least of its hashed phrases of ANCHOR words, so
   equal windows have equal anchors. ``exchange`` finds the anchors that recur.
2. Candidates. Only windows whose anchor recurs are compared, by hash, again by ``exchange``.
   It leaves out what does not recur; what it lets through is not yet believed.
3. Automata. The passages of candidate windows, as their words, go to the shard of their anchor;
   a sender sends equal ones once, with how often it has them. A shard compiles the phrases
   that cover its passages into Aho-Corasick automata over words told apart by their bytes,
   and streams the passages of all documents through them. A phrase found at two places or
   more is a recurring one: the words of every place where it was found go.
4. An anchor in over MANY different passages of one sender, or CROWD of all in its shard, would make
   an automaton that grows with the corpus. Its windows go one by one, equal ones of a sender
   once, to buckets of the hash of their words, where automata decide as in a shard: from the
   sender, or from the shard, which is told so.

All windows of an anchor's place lie in one passage, and windows that are equal have equal
anchors, so each place of a phrase is found once. Decisions use the whole input, never what
is left after a removal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm import kernels as K
from querent.llm.common import buckets, fresh, grouped, table
from querent.llm.exchange import FIELDS, SENT, by_sender, groups, keyed, pack, record, repeated, row, sender_ids, senders, unpack, with_places

WINDOW = 35
ANCHOR = 18
#: Different passages of an anchor that a sender sends to its shard at most.
MANY = 512
#: Different passages of an anchor in an automaton at most.
CROWD = 4096


def _anchors(piece: K.Piece, window: int, anchor: int) -> tuple[K.Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, window starts, anchor place of each, phrase hashes)."""
    w = K.words(piece, K.SPACE, False)
    starts = K.spread(w.first, window)
    grams = K.windows(w.hashes, anchor)
    places = K.winnow(grams, window - anchor + 1)[starts] if len(starts) else starts
    return w, starts, places, grams


def _places(column: pa.Array) -> list[np.ndarray]:
    return [unpack(x) for x in column.to_pylist()]


def recurring_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, _h, places): starts, as word numbers, of the windows of a keyed document that start anywhere else too."""
    n = buckets(docs)

    def seeds(piece: K.Piece, _: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w, _, places, grams = _anchors(piece, window, anchor)
        at = np.unique(places)
        doc = np.searchsorted(w.first, at, side="right") - 1
        return doc, at - w.first[doc], grams[at]

    def candidates(piece: K.Piece, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w, starts, places, _ = _anchors(piece, window, anchor)
        seed = np.zeros(len(w.hashes), dtype=bool)
        for d, own in enumerate(_places(rows.column(3))):
            seed[w.first[d] + own] = True
        starts = starts[seed[places]]
        doc = np.searchsorted(w.first, starts, side="right") - 1
        return doc, starts - w.first[doc], K.windows(w.hashes, window)[starts]

    found = repeated(docs, seeds, n, bytes_each=6)
    return repeated(with_places(docs, found, "inner").select("doc_id", "text", "_h", "places"), candidates, n)


def _joined(data: np.ndarray, w: K.Words, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words low to high of some passages, each word followed by a space, end to end; and the bytes of each passage."""
    n = high - low
    words = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    sizes = w.ends[words] - w.starts[words] + 1
    ends = np.cumsum(sizes)
    out = np.append(data, np.uint8(0))[np.repeat(w.starts[words] - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
    out[ends - 1] = 0x20
    return out, np.add.reduceat(sizes, np.cumsum(n) - n)


def _parted(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of joined passages."""
    ends = np.flatnonzero(data == 0x20)
    return np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends, ends


def _cut(sizes: np.ndarray, data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(passage, first word, first byte, bytes) of the windows of joined passages."""
    starts, ends = _parted(data)
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    at = K.spread(first, window)
    of = np.searchsorted(first, at, side="right") - 1
    return of, at - first[of], starts[at], ends[at + window - 1] + 1 - starts[at]


def _slices(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return data[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


def _rows(bucket: np.ndarray, sender: int, number: np.ndarray, offset: np.ndarray, count: np.ndarray, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> list[tuple]:
    """One row for each bucket: the passages that go there, each with its number, offset, count (2: or more), anchor and bytes."""
    order = np.argsort(bucket, kind="stable")
    out = []
    for a, k in zip(*groups(bucket[order]), strict=True):
        own = order[a : a + k]
        head = hashes[own].tobytes() + sizes[own].astype("<u4").tobytes()
        out.append(row(int(bucket[own[0]]), sender, docs=pack(number[own]), places=pack(4 * offset[own] + np.minimum(count[own], 2)), values=head + _slices(data, starts[own], sizes[own]).tobytes()))
    return out


def _send(n: int, window: int, anchor: int, many: int):
    """Sends the passages of recurring windows to the shards of their anchors, equal ones of a sender once."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sender, batch in senders(batches):
            parts: list[tuple[np.ndarray, ...]] = []
            for piece in K.pieces(batch.column(1)):
                w, starts, places, grams = _anchors(piece, window, anchor)
                wanted = np.zeros(len(w.hashes), dtype=bool)
                for d, own in enumerate(_places(batch.column(3).slice(piece.first, piece.n))):
                    wanted[w.first[d] + own] = True
                own = wanted[starts]
                starts, places = starts[own], places[own]
                first, size = groups(places)
                if not len(first):
                    continue
                low, high = starts[first], starts[first + size - 1] + window
                doc = np.searchsorted(w.first, low, side="right") - 1
                data, sizes = _joined(piece.data, w, low, high)
                parts.append((doc + piece.first, low - w.first[doc], grams[places[first]], sizes, data))
            if not parts:
                continue
            doc, place, hashes, sizes, data = map(np.concatenate, zip(*parts, strict=True))
            starts = np.cumsum(sizes) - sizes
            first, of = K.distinct_spans(data, starts, sizes, K.spans(data, starts, starts + sizes))
            count = np.bincount(of)
            _, anchor_of, times = np.unique(hashes[first], return_inverse=True, return_counts=True)
            wide = times[anchor_of] > many
            cold, hot = first[~wide], first[wide]
            number = np.cumsum(~wide) - 1
            own = ~wide[of]
            told = [(doc[own], place[own], number[of[own]])]
            rows = _rows((hashes[cold] % np.uint64(n)).astype(np.int64), sender, np.arange(len(cold)), np.zeros(len(cold), dtype=np.int64), count[~wide], hashes[cold], starts[cold], sizes[cold], data)
            if len(hot):
                named = np.unique(hashes[hot])
                rows += [row(int(b), sender, values=named[named % np.uint64(n) == b].tobytes()) for b in np.unique(named % np.uint64(n))]
                everywhere = np.flatnonzero(wide[of])  # every place of a hot passage, cut into its windows
                body = _slices(data, starts[everywhere], sizes[everywhere])
                passage, offset, at, size = _cut(sizes[everywhere], body, window)
                own = K.spans(body, at, at + size)
                one, same = K.distinct_spans(body, at, size, own)
                told.append((doc[everywhere][passage], place[everywhere][passage] + offset, len(cold) + same))
                rows += _rows(n + (own[one] % np.uint64(n)).astype(np.int64), sender, len(cold) + np.arange(len(one)), np.zeros(len(one), dtype=np.int64), np.bincount(same), own[one], at[one], size[one], body)
            doc, place, number = map(np.concatenate, zip(*told, strict=True))
            rows.append(row(-1, sender, ids=sender_ids(batch), docs=pack(doc), places=pack(place), values=pack(number)))
            yield record(rows)

    return send


#: Passages in one automaton (all of an anchor are in the same one).
AUTOMATON = 2000


def _located(hashes: np.ndarray, count: np.ndarray, sizes: np.ndarray, data: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, first word, words) of the stretches that windows with two or more places cover.

    The first and the last window of every passage, which cover it, are the phrases of Aho-Corasick automata over words;
    all passages of their anchors stream through them, and every place where a phrase is found counts. Words are told apart
    by their bytes.
    """
    import ahocorasick

    starts = np.cumsum(sizes) - sizes
    first, of = K.distinct_spans(data, starts, sizes, K.spans(data, starts, starts + sizes))
    first = first[order := np.argsort(hashes[first], kind="stable")]
    of = np.argsort(order)[of]
    times = np.bincount(of, weights=count).astype(np.int64)
    body = _slices(data, starts[first], sizes[first])
    low, high = _parted(body)
    known, word = K.distinct_spans(body, low, high - low, K.spans(body, low, high))
    edges = np.searchsorted(low, np.concatenate(([0], np.cumsum(sizes[first]))))
    # a word is so many letters, each of an alphabet of 256 of its own: no node of an automaton has more arcs, and no match starts within a word
    letters = 1 if len(known) <= 1 << 8 else 2 if len(known) <= 1 << 16 else 4
    code = np.stack([0x1000 * (k + 1) + (word >> 8 * k & 255) for k in range(letters)], axis=1).astype("<u4")
    text = code.tobytes().decode("utf-32-le")
    passages = [text[letters * a : letters * b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    begins, size = groups(hashes[first])
    ends = begins + size
    found: list[tuple[int, int]] = []
    begin = 0
    for end in ends[np.searchsorted(ends // AUTOMATON, np.arange(len(first) // AUTOMATON + 1), side="right") - 1].tolist() + [len(first)]:
        if end <= begin:
            continue
        automaton, seen = ahocorasick.Automaton(), {}
        for p in passages[begin:end]:
            for phrase in (p[: letters * window], p[-letters * window :]):
                if phrase not in seen:
                    automaton.add_word(phrase, len(seen))
                    seen[phrase] = 0
        automaton.make_automaton()
        hits = [(i, stop, phrase) for i in range(begin, end) for stop, phrase in automaton.iter(passages[i])]
        at, stop, phrase = np.array(hits, dtype=np.int64).T
        total = np.bincount(phrase, weights=times[at])
        again = total[phrase] > 1
        found.append(np.stack([at[again], (stop[again] + 1) // letters - window]))
        begin = end
    at, start = np.concatenate(found, axis=1)
    order = np.lexsort((start, at))
    at, start = at[order], start[order]
    fresh = np.ones(len(at), dtype=bool)
    fresh[1:] = (at[1:] != at[:-1]) | (start[1:] > start[:-1] + window)
    head = np.flatnonzero(fresh)
    tail = np.append(head, len(at))[1:] - 1
    at, start, size = at[head], start[head], start[tail] + window - start[head]
    # of every passage, the stretches of its distinct one
    edges = np.searchsorted(at, np.arange(len(first) + 1))
    n = np.diff(edges)[of]
    pick = np.repeat(edges[of] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return np.repeat(np.arange(len(of)), n), start[pick], size[pick]


def _answer(n: int, window: int, first_round: bool, crowd: int):
    """Answers the passages of a shard; those of an anchor that a sender names as hot go on, window by window, to buckets of their hash."""

    def answer(group: pa.Table) -> pa.Table:
        group = group.select(FIELDS)
        cols = {x: group[x].to_pylist() for x in FIELDS}
        if cols["bucket"][0] < 0 or first_round and cols["bucket"][0] >= n:
            return group
        asked = [i for i, x in enumerate(cols["docs"]) if x is not None]
        rows: list[tuple] = []
        if asked:
            named = np.frombuffer(b"".join(v for v, d in zip(cols["values"], cols["docs"], strict=True) if d is None), dtype=np.uint64)
            k = [len(cols["docs"][i]) // 4 for i in asked]
            held = [cols["values"][i] for i in asked]
            sender = np.repeat([cols["sender"][i] for i in asked], k)
            number = np.concatenate([unpack(cols["docs"][i]) for i in asked])
            offset, count = np.divmod(np.concatenate([unpack(cols["places"][i]) for i in asked]), 4)
            hashes = np.concatenate([np.frombuffer(h, dtype=np.uint64, count=m) for h, m in zip(held, k, strict=True)])
            sizes = np.concatenate([np.frombuffer(h, dtype="<u4", count=m, offset=8 * m) for h, m in zip(held, k, strict=True)]).astype(np.int64)
            data = np.concatenate([np.frombuffer(h, dtype=np.uint8, offset=12 * m) for h, m in zip(held, k, strict=True)])
            starts = np.cumsum(sizes) - sizes
            # a window of the second round has a key of its own
            wide = np.isin(hashes, np.concatenate([named, K.crowded(data, starts, sizes, hashes, crowd)])) if first_round else np.zeros(len(hashes), dtype=bool)
            for s in np.unique(sender[wide]):
                own = np.flatnonzero(wide & (sender == s))
                body = _slices(data, starts[own], sizes[own])
                passage, at, begin, size = _cut(sizes[own], body, window)
                to = K.spans(body, begin, begin + size)
                rows += _rows(n + (to % np.uint64(n)).astype(np.int64), int(s), number[own][passage], at, count[own][passage], to, begin, size, body)
            own = np.flatnonzero(~wide)
            if len(own):
                of, start, size = _located(hashes[own], count[own], sizes[own], _slices(data, starts[own], sizes[own]) if wide.any() else data, window)
                of = own[of]
                for s in np.unique(sender[of]):
                    i = np.flatnonzero(sender[of] == s)
                    rows.append(row(-1, int(s), docs=pack(number[of[i]]), places=pack(offset[of[i]] + start[i]), values=size[i].astype("<u4").tobytes()))
        return pa.Table.from_batches([record(rows)])

    return answer


def _told(group: pa.Table, bytes_each: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, words as bytes) of the covered stretches of a sender: answers meet the places of their passage."""
    cols = {x: group[x].to_pylist() for x in FIELDS}
    mine = [i for i, x in enumerate(cols["ids"]) if x is not None]
    answers = [i for i, x in enumerate(cols["ids"]) if x is None]
    doc, place, number = (np.concatenate([unpack(cols[c][i]) for i in mine]) for c in ("docs", "places", "values"))
    none = [np.empty(0, dtype=np.int64)]
    of, start = (np.concatenate([unpack(cols[c][i]) for i in answers] or none) for c in ("docs", "places"))
    size = np.concatenate([np.frombuffer(cols["values"][i], dtype="<u4").astype(np.int64) for i in answers] or none)
    order = np.argsort(of, kind="stable")
    of, start, size = of[order], start[order], size[order]
    low = np.searchsorted(of, number)
    n = np.searchsorted(of, number, side="right") - low
    pick = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return np.repeat(doc, n), np.repeat(place, n) + start[pick], size[pick].astype("<u4").view(np.uint8).reshape(-1, bytes_each)


def covered_words(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, many: int = MANY, crowd: int = CROWD) -> DataFrame:
    """(doc_id, _h, places, values): of keyed documents the first words, and numbers of words, of the stretches that recurring windows cover."""
    n = buckets(docs)
    wanted = with_places(docs, recurring_windows(docs, window, anchor), "inner").select("doc_id", "text", "_h", "places")

    def split(df: DataFrame) -> DataFrame:
        # rows that are answered have bucket -1 and are dealt by their sender
        return df.withColumn("dealt", F.when(F.col("bucket") < 0, F.col("sender")).otherwise(-1))

    keys = ["bucket", "dealt"]
    first = grouped(split(wanted.mapInArrow(_send(n, window, anchor, many), SENT)), n, keys, _answer(n, window, True, crowd), SENT)
    return by_sender(grouped(split(first), n, keys, _answer(n, window, False, crowd), SENT), 4, n, _told)


def _removed(w: K.Words, starts: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
    """Mask of the words of a piece in covered stretches."""
    edge = np.zeros(len(w.hashes) + 1, dtype=np.int64)
    for d, own in enumerate(starts):
        np.add.at(edge, w.first[d] + own, 1)
        np.add.at(edge, w.first[d] + own + sizes[d], -1)
    return np.cumsum(edge[:-1]) > 0


def _kept(piece: K.Piece, w: K.Words, gone: np.ndarray, d: int) -> bytes:
    a, b = int(w.first[d]), int(w.first[d + 1])
    keep = np.flatnonzero(~gone[a:b]) + a
    if not len(keep):
        return b""
    raw, starts, ends = piece.data, w.starts, w.ends
    return b" ".join([raw[s:e].tobytes() for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, keep_text: bool = True, many: int = MANY, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with keep_text also text (the kept words joined by one space; as it
    was, null included, where nothing is removed) and _rest (the other columns of the row).

    Null and empty texts have no words. Repeated rows repeat all their windows.
    """
    own = keyed(docs)
    found = covered_words(own, window, anchor, many, crowd)
    null = fresh("null", docs)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    if keep_text:
        full = keyed(docs.withColumn(null, F.col("text").isNull()), rest=True)
        schema += f", text string, _rest {full.schema['_rest'].dataType.simpleString()}"
        own = full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.pieces(batch.column(1)):
                w = K.words(piece, K.SPACE, False)
                rows = batch.slice(piece.first, piece.n)
                gone = _removed(w, _places(rows.column(3)), [np.frombuffer(x or b"", dtype="<u4") for x in rows.column(4).to_pylist()])
                total = np.concatenate(([0], np.cumsum(gone)))
                removed = total[w.first[1:]] - total[w.first[:-1]]
                kept = [_kept(piece, w, gone, d) for d in range(piece.n)]
                cols = [rows.column(0), pa.array(w.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if keep_text:
                    rest = rows.column(5)
                    empty = rest.field(null).to_pylist()
                    cols += [pa.array([x.decode() if r else None if empty[d] else piece.text(d).decode() for d, (x, r) in enumerate(zip(kept, removed, strict=True))], pa.string()), rest]
                    names += ["text", "_rest"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return with_places(own, found).select("doc_id", "text", "_h", "places", "values", *["_rest"] * keep_text).mapInArrow(run, schema)


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents with recurring passages taken out of their texts; n_chars, if there, follows the text. No row goes."""
    out = dedup(docs)
    columns = [F.col("text") if c == "text" else F.col("_rest")[c].alias(c) for c in docs.columns]
    out = out.select(*columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of windows that recur."""
    return dedup(table(spark, sf_dir, "documents"), keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, p, sha256(array_to_string(w[p:p + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY h) AS n FROM s) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS p FROM r),
k AS (SELECT d.doc_id, t.p, d.w[t.p] AS word FROM d, (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p FROM d) t WHERE d.doc_id = t.doc_id),
o AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.p) AS kept, count(*) AS n FROM k ANTI JOIN g ON k.doc_id = g.doc_id AND k.p = g.p GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(o.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256
FROM d LEFT JOIN o ON d.doc_id = o.doc_id
"""
