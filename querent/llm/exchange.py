"""Which fingerprints occur more than once, and where: a shuffle that no hot fingerprint can skew.

Every Arrow batch of documents is a sender. It looks for repeats within itself, then
sends each fingerprint packed by hash bucket: one that recurs within the sender goes out
once, as news for others, so a fingerprint in a third of all rows costs its bucket one
entry for each batch, not one for each row. A bucket finds the fingerprints that several
senders have and answers each sender; the answers of a sender, a bounded group, become
places in its documents. One linear plan, no join.

Documents are told apart by doc_id and a hash of the text, so repeated rows get the same
places. A null doc_id ranks after all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.llm import kernels as K
from querent.llm.common import grouped, hold

LAST = 2**63 - 1

FIELDS = ["bucket", "sender", "ids", "docs", "places", "values"]
SENT = "bucket int, sender long, ids binary, docs binary, places binary, values binary"
_KINDS = (pa.int32(), pa.int64(), *[pa.binary()] * 4)

#: (document in the piece, position, fingerprint) of the marks of a piece, in order of document and position.
Marks = Callable[[K.Piece, pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]


def keyed(docs: DataFrame, rest: bool = False) -> DataFrame:
    """doc_id, text (null as empty), _h, which tells texts of one doc_id apart, and _rest: the row as it was, if wanted."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = [F.struct(*(F.col(c) for c in docs.columns if c != "text")).alias("_rest")] if rest else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_h"), *row)


def pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, all lowest bytes first: the upper planes of small or ascending numbers compress to little."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpack(data: bytes | None) -> np.ndarray:
    planes = np.frombuffer(data or b"", dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4")[:, 0].astype(np.int64)


def row(bucket: int, sender: int, **parts: bytes) -> tuple:
    return (bucket, sender, *(parts.get(x) for x in FIELDS[2:]))


def record(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KINDS, strict=True)], names=FIELDS)


def sender_ids(batch: pa.RecordBatch) -> bytes:
    """doc_id and _h of a sender's documents."""
    return np.stack([batch.column(0).fill_null(LAST).to_numpy(), batch.column(2).to_numpy()]).tobytes()


def senders(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    task = TaskContext.get().partitionId()
    for number, batch in enumerate(batches):
        yield (task << 32) | number, batch


def collected(batch: pa.RecordBatch, marks: Marks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The marks of all pieces of a batch; documents are numbered in the batch."""
    parts = [(d + piece.first, p, f) for piece in K.pieces(batch.column(1)) for d, p, f in [marks(piece, batch.slice(piece.first, piece.n))]]
    if not parts:
        none = np.empty(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of equal values of an ordered array."""
    if not len(values):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return first, np.diff(np.concatenate((first, [len(values)])))


def _as_sent(group: pa.Table, bytes_each: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(document, place, value) of all answers to a sender."""
    value = np.frombuffer(b"".join(x or b"" for x in group["values"].to_pylist()), dtype=np.uint8).reshape(-1, bytes_each) if bytes_each else None
    return np.concatenate([unpack(x) for x in group["docs"].to_pylist()]), np.concatenate([unpack(x) for x in group["places"].to_pylist()]), value


def by_sender(answers: DataFrame, bytes_each: int, n: int, read: Callable[[pa.Table, int], tuple[np.ndarray, np.ndarray, np.ndarray | None]] = _as_sent) -> DataFrame:
    """(doc_id, _h, places, values) from answers of n buckets; values hold bytes_each bytes for each place (0: null)."""

    def gather(group: pa.Table) -> pa.Table:
        ids = next(x for x in group["ids"].to_pylist() if x is not None)
        own = np.frombuffer(ids, dtype=np.int64).reshape(2, -1)
        doc, pos, value = read(group, bytes_each)
        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order]
        first, size = groups(doc)
        ends = list(zip(first, first + size, strict=True))
        values = [value[order[a:b]].tobytes() for a, b in ends] if bytes_each else [None] * len(ends)
        return pa.table({"doc_id": pa.array(own[0][doc[first]]), "_h": pa.array(own[1][doc[first]]), "places": pa.array([pack(pos[a:b]) for a, b in ends], pa.binary()), "values": pa.array(values, pa.binary())})

    found = grouped(answers, n, ["sender"], gather, "doc_id long, _h long, places binary, values binary")
    # repeated rows of one text have equal places and values
    return found.groupBy("doc_id", "_h").agg(F.max(F.struct("places", "values")).alias("_own")).select("doc_id", "_h", "_own.places", "_own.values")


def repeated(docs: DataFrame, marks: Marks, n: int, bytes_each: int = 8) -> DataFrame:
    """(doc_id, _h, places): for each document its marks whose fingerprint occurs at another place too.

    docs has doc_id, text, _h first, then what marks needs; n is the number of buckets. Other places of the same
    document count. bytes_each: bytes of a fingerprint that are compared within a bucket, the upper ones (fewer
    where a false match does no harm). places are packed positions, ascending. Documents without any are left out.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sender, batch in senders(batches):
            doc, pos, fp = collected(batch, marks)
            if not len(fp):
                continue
            order = np.argsort(fp, kind="stable")
            first, size = groups(fp[order])
            known = size > 1
            is_known = np.empty(len(fp), dtype=bool)
            is_known[order] = np.repeat(known, size)
            rows = [row(sender % n, sender, ids=sender_ids(batch), docs=pack(doc[is_known]), places=pack(pos[is_known]))]
            news = np.sort(order[first[known]])
            asks = np.flatnonzero(~is_known)
            to = (fp % np.uint64(n)).astype(np.int64)
            top = np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8)[:, 8 - bytes_each :]
            ask_by, news_by = asks[np.argsort(to[asks], kind="stable")], news[np.argsort(to[news], kind="stable")]
            buckets = np.arange(n + 1)
            ask_edges, news_edges = np.searchsorted(to[ask_by], buckets), np.searchsorted(to[news_by], buckets)
            for b in np.flatnonzero(np.diff(ask_edges) + np.diff(news_edges)):
                a, k = ask_by[ask_edges[b] : ask_edges[b + 1]], news_by[news_edges[b] : news_edges[b + 1]]
                rows.append(row(int(b), sender, docs=pack(doc[a]), places=pack(pos[a]), values=top[a].tobytes() + top[k].tobytes()))
            yield record(rows)

    def wide(data: bytes) -> np.ndarray:
        out = np.zeros((len(data) // bytes_each, 8), dtype=np.uint8)
        out[:, 8 - bytes_each :] = np.frombuffer(data, dtype=np.uint8).reshape(-1, bytes_each)
        return out.view(np.uint64)[:, 0]

    def answer(group: pa.Table) -> pa.Table:
        cols = {x: group[x].to_pylist() for x in FIELDS}
        rows = [tuple(cols[c][i] for c in FIELDS) for i, x in enumerate(cols["values"]) if x is None]
        asked = [i for i, x in enumerate(cols["values"]) if x is not None]
        if asked:
            fps = [wide(cols["values"][i]) for i in asked]
            every, where = np.unique(np.concatenate(fps), return_inverse=True)
            holders = np.zeros(len(every), dtype=np.int32)
            at, spans = 0, []
            for f, i in zip(fps, asked, strict=True):
                own, asks = where[at : at + len(f)], len(cols["docs"][i]) // 4
                holders[np.unique(own)] += 1
                holders[own[asks:]] += 1  # recurs within its sender already
                spans.append((i, own[:asks]))
                at += len(f)
            for i, own in spans:
                hit = holders[own] > 1
                if hit.any():
                    rows.append(row(cols["bucket"][i], cols["sender"][i], docs=pack(unpack(cols["docs"][i])[hit]), places=pack(unpack(cols["places"][i])[hit])))
        return pa.Table.from_batches([record(rows)])

    return by_sender(grouped(docs.mapInArrow(send, SENT), n, ["bucket"], answer, SENT), 0, n).drop("values")


#: Bits of a name that ``repeated_sides`` compares, and the bit above them: documents of the sender differ on this one already.
_NAME = np.uint64((1 << 31) - 1)
_FLAG = np.uint64(1 << 31)

#: (document in the piece, position, fingerprint, two 64-bit names) of the marks of a piece; a name of 0 is none.
Sides = Callable[[K.Piece], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _told(to: np.ndarray, names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For marks with buckets and names: whether other documents have the name too, and whether the mark is the first with it."""
    known, first_of = np.zeros(len(to), dtype=bool), np.zeros(len(to), dtype=bool)
    at = np.flatnonzero(names)
    if len(at):
        key = to[at].astype(np.uint64) << np.uint64(31) | names[at]
        bits = len(at).bit_length()
        if int(key.max()).bit_length() + bits <= 64:
            # key and place fit one word, and sorting words is faster than sorting places by them
            packed = np.sort(key << np.uint64(bits) | np.arange(len(at), dtype=np.uint64))
            key, order = packed >> np.uint64(bits), (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
        first, size = groups(key)
        own = doc[at[order]]
        known[at[order]] = np.repeat(np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first), size)
        first_of[at[order[first]]] = True
    return known, first_of


def _shared(names: np.ndarray, sender: np.ndarray) -> np.ndarray:
    """For names (the flag above them) in order of their senders: whether another sender has the name too, or one has it with the flag."""
    at = np.flatnonzero(names & _NAME)
    packed = np.sort((names[at] & _NAME) << np.uint64(32) | at.astype(np.uint64))
    order = (packed & np.uint64((1 << 32) - 1)).astype(np.int64)
    first, size = groups(packed >> np.uint64(32))
    out = np.zeros(len(names), dtype=bool)
    if len(first):
        more = sender[order[first]] != sender[order[first + size - 1]]
        out[order] = np.repeat(more | np.logical_or.reduceat((names[order] & _FLAG) > 0, first), size)
    return out


def repeated_sides(docs: DataFrame, marks: Sides, n: int, piece_bytes: int = K.PIECE) -> DataFrame:
    """(doc_id, _h, places) as ``repeated`` gives, of marks of which one of two names (what lies to the left of the mark, to the
    right) occurs in another document, on the same side. Marks that can share a name have one fingerprint, which deals them.

    A sender tells each name once for each bucket: with the mark that asks for it, or, of marks that documents of its own
    settle, with the first that has it.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sender, batch in senders(batches):
            parts = [(d + piece.first, p, f, s) for piece in K.pieces(batch.column(1), piece_bytes) for d, p, f, s in [marks(piece)]]
            if not parts:
                continue
            doc, pos, fp, sides = (np.concatenate(x) for x in zip(*parts, strict=True))
            if not len(fp):
                continue
            to = (fp % np.uint64(n)).astype(np.int64)
            names = np.where(sides != 0, np.maximum(sides >> np.uint64(33), np.uint64(1)), np.uint64(0))
            (known_l, first_l), (known_r, first_r) = (_told(to, names[:, i], doc) for i in (0, 1))
            is_known = known_l | known_r
            tells = [np.where(f, names[:, i] | np.where(k, _FLAG, np.uint64(0)), np.uint64(0)) for i, (k, f) in enumerate([(known_l, first_l), (known_r, first_r)])]
            entry = np.where(is_known, tells[0] << np.uint64(32) | tells[1], names[:, 0] << np.uint64(32) | names[:, 1])
            rows = [row(sender % n, sender, ids=sender_ids(batch), docs=pack(doc[is_known]), places=pack(pos[is_known]))]
            asks, news = np.flatnonzero(~is_known), np.flatnonzero(is_known & (entry > 0))
            ask_by, news_by = asks[np.argsort(to[asks], kind="stable")], news[np.argsort(to[news], kind="stable")]
            ask_edges, news_edges = np.searchsorted(to[ask_by], np.arange(n + 1)), np.searchsorted(to[news_by], np.arange(n + 1))
            for b in np.flatnonzero(np.diff(ask_edges) + np.diff(news_edges)):
                a, k = ask_by[ask_edges[b] : ask_edges[b + 1]], news_by[news_edges[b] : news_edges[b + 1]]
                rows.append(row(int(b), sender, docs=pack(doc[a]), places=pack(pos[a]), values=entry[a].tobytes() + entry[k].tobytes()))
            yield record(rows)

    def answer(group: pa.Table) -> pa.Table:
        cols = {x: group[x].to_pylist() for x in FIELDS}
        rows = [tuple(cols[c][i] for c in FIELDS) for i, x in enumerate(cols["values"]) if x is None]
        asked = [i for i, x in enumerate(cols["values"]) if x is not None]
        if asked:
            entries = [np.frombuffer(cols["values"][i], dtype=np.uint64) for i in asked]
            every, sender = np.concatenate(entries), np.repeat(np.arange(len(entries)), [len(e) for e in entries])
            shared = _shared(every >> np.uint64(32), sender) | _shared(every & np.uint64((1 << 32) - 1), sender)
            ends = np.cumsum([len(e) for e in entries])
            for own, end, i in zip(entries, ends.tolist(), asked, strict=True):
                hit = shared[end - len(own) : end][: len(cols["docs"][i]) // 4]
                if hit.any():
                    rows.append(row(cols["bucket"][i], cols["sender"][i], docs=pack(unpack(cols["docs"][i])[hit]), places=pack(unpack(cols["places"][i])[hit])))
        return pa.Table.from_batches([record(rows)])

    return by_sender(grouped(docs.mapInArrow(send, SENT), n, ["bucket"], answer, SENT), 0, n).drop("values")


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, _h, copy): keyed documents whose whole text a document of smaller doc_id has. Texts are compared by their SHA-256.

    The texts that have copies are held first: a join of two plain shuffles can split a text with very many copies over tasks.
    """
    order = F.coalesce("doc_id", F.lit(LAST))
    own = docs.select(order.alias("doc_id"), "_h", F.unhex(F.sha2("text", 256)).alias("_k"))
    least = own.groupBy("_h", "_k").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("_h", "_k", "least")
    least = hold(least)
    return own.join(least, ["_h", "_k"]).where("doc_id > least").select("doc_id", "_h").distinct().withColumn("copy", F.lit(True))


def with_places(docs: DataFrame, places: DataFrame, how: str = "left") -> DataFrame:
    """keyed documents with the other columns of places (null: none)."""
    own = places.withColumnsRenamed({"doc_id": "_id", "_h": "_g"})
    same = (F.coalesce(F.col("doc_id"), F.lit(LAST)) == F.col("_id")) & (F.col("_h") == F.col("_g"))
    return docs.join(own.hint("merge"), same, how).drop("_id", "_g")
