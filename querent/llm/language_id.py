"""Operator 9, language identification by language-bitmask n-gram filters.

Each language has a Bloom filter of its frequent byte n-grams. The filters are bit-sliced:
row r of the table holds, for all languages at once, bit r of each filter, so one lookup
(the AND of HASHES rows) gives the mask of all languages that have the n-gram. Popcounts of
a document's masks per language, corrected for each filter's false positive rate, decide.

Learning counts n-grams over every training document, pre-aggregated in each task. An
n-gram belongs to a language if it is at least LEAST of the language's n-grams, so a
language has at most 1 / LEAST of them for each n: what reaches the driver is bounded by
the number of languages, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm import kernels as K
from querent.llm.common import append, table, texts

GRAMS = (3, 4)
LEAST = 2e-5
ROWS = 1 << 22
HASHES = 3
UNKNOWN = "und"
#: Documents whose masks are counted at once.
DOCS = 4096
#: The eight bits of each byte, lowest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)

_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True


def letters(piece: K.Piece) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of a piece's documents, each after a space, with runs of other ASCII as one space; and the documents' offsets.

    Folding covers ASCII and the two-byte letters from U+00C0 to U+00DE.
    """
    data = K.lower(piece.data)
    if len(data) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        data[1:][upper] += 0x20
    letter = _LETTER[data]
    data[~letter] = 0x20
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[piece.offsets] = True
    keep = letter.copy()
    if len(data):
        keep[:-1] |= letter[:-1]
        keep[1:] |= letter[:-1] & ~edge[1:-1]
    total = np.concatenate(([0], np.cumsum(keep)))
    n = piece.n
    offsets = total[piece.offsets] + np.arange(n + 1)
    out = np.full(int(offsets[-1]), 0x20, dtype=np.uint8)
    shift = np.repeat(np.arange(1, n + 1), np.diff(piece.offsets))
    at = np.flatnonzero(keep)
    out[total[at] + shift[at]] = data[at]
    return out, offsets


def grams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams within documents, and each one's document."""
    starts = K.spread(offsets, n)
    coded = data.astype(np.uint64) + np.uint64(n << 8)
    return K.windows(K.mix(coded), n)[starts], np.repeat(np.arange(len(offsets) - 1), np.maximum(np.diff(offsets) - n + 1, 0))


@dataclass
class Model:
    """langs in order of training documents, most first; slices[row, word of 64 languages]; rates of false positives."""

    langs: list[str]
    slices: np.ndarray
    rates: np.ndarray

    def rows(self, hashes: np.ndarray) -> list[np.ndarray]:
        low = np.uint64(ROWS - 1)
        return [((hashes >> np.uint64(21 * i)) & low).astype(np.int64) for i in range(HASHES)]

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        out = None
        for rows in self.rows(hashes):
            out = self.slices[rows] if out is None else out & self.slices[rows]
        return out

    def shares(self, piece: K.Piece) -> np.ndarray:
        """For each document and language, the share of its n-grams that the language has, false positives taken off."""
        data, offsets = letters(piece)
        hits = np.zeros((piece.n, len(self.langs)))
        count = np.zeros(piece.n)
        for n in GRAMS:
            hashes, owner = grams(data, offsets, n)
            if not len(hashes):
                continue
            count += np.bincount(owner, minlength=piece.n)
            masks = np.ascontiguousarray(self.masks(hashes)).view(np.uint8).reshape(len(hashes), -1)
            # eight languages at a time: how often a document has each byte of masks, times the bits of the byte
            edges = np.searchsorted(owner, np.arange(0, piece.n + DOCS, DOCS))
            for part, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                first, last = part * DOCS, min(part * DOCS + DOCS, piece.n)
                for i in range(0, len(self.langs), 8):
                    seen = np.bincount((owner[a:b] - first) << 8 | masks[a:b, i // 8], minlength=(last - first) << 8).reshape(-1, 256)
                    hits[first:last, i : i + 8] += (seen @ BITS)[:, : len(self.langs) - i]
        with np.errstate(invalid="ignore", divide="ignore"):
            share = np.where(count[:, None] > 0, hits / np.maximum(count, 1)[:, None], 0)
        return np.clip((share - self.rates) / (1 - self.rates), 0, 1)


def build(langs: list[str], hashes: np.ndarray, owners: np.ndarray) -> Model:
    """Fills the sliced filters with (n-gram, language) pairs."""
    model = Model(langs, np.zeros((ROWS, max(1, -(-len(langs) // 64))), dtype=np.uint64), np.zeros(len(langs)))
    for i in range(len(langs)):
        own = hashes[owners == i]
        for rows in model.rows(own):
            model.slices[rows, i // 64] |= np.uint64(1 << (i % 64))
        fill = np.count_nonzero(model.slices[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) / ROWS
        model.rates[i] = fill**HASHES
    return model


def counts(train: DataFrame) -> DataFrame:
    """lang, n, gram, count over (text, lang) rows; rows without lang are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            if len(parts) == 1:
                return parts[0]
            u, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return u, np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        for batch in batches:
            lang = np.array(batch.column(1).to_pylist(), dtype=object)
            for piece in K.pieces(batch.column(0)):
                data, offsets = letters(piece)
                own = lang[piece.first : piece.first + piece.n]
                names, code = np.unique(own.astype(str), return_inverse=True)
                for n in GRAMS:
                    hashes, owner = grams(data, offsets, n)
                    by = code[owner]
                    for i, name in enumerate(names):
                        parts = held.setdefault((str(name), n), [])
                        parts.append(np.unique(hashes[by == i], return_counts=True))
                        if len(parts) >= 16:
                            parts[:] = [merged(parts)]
        for (name, n), parts in held.items():
            u, c = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(u), pa.string()), pa.array(np.full(len(u), n, dtype=np.int32)), pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "n", "gram", "count"])

    rows = train.select(F.col("text").cast("string"), F.col("lang").cast("string")).where("lang is not null and text is not null")
    return rows.mapInArrow(run, "lang string, n int, gram long, count long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))


def fit(train: DataFrame) -> Model:
    """Learns from the text and lang of all rows; no rows: a model without languages."""
    counted = counts(train)
    total = counted.groupBy("lang", "n").agg(F.sum("count").alias("total")).withColumnRenamed("lang", "l").withColumnRenamed("n", "m")
    share = counted.join(F.broadcast(total), (F.col("lang") == F.col("l")) & (F.col("n") == F.col("m"))).withColumn("share", F.col("count") / F.col("total"))
    frequent = share.where(F.col("share") >= LEAST).select("lang", "n", "gram", "share").toArrow().to_pandas()
    docs = {r["lang"]: r["count"] for r in train.where("lang is not null").groupBy(F.col("lang").cast("string").alias("lang")).count().collect()}
    langs = sorted(docs, key=lambda x: (-docs[x], x))
    place = {x: i for i, x in enumerate(langs)}
    return build(langs, frequent["gram"].to_numpy(dtype=np.int64).view(np.uint64), np.array([place[x] for x in frequent["lang"]], dtype=np.int64))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score; `und` and 0 for null texts, texts without a letter, and a model without languages.

    Equal shares go to the language with more training documents. score is the winner's corrected share.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(array: pa.Array) -> list[pa.Array]:
        model = sent.value
        text = array.to_pylist()
        pred: list[str] = []
        score: list[float] = []
        for piece in K.pieces(array):
            shares = model.shares(piece) if model.langs else np.zeros((piece.n, 1))
            best = shares.argmax(axis=1)
            for i in range(piece.n):
                t = text[piece.first + i]
                known = bool(model.langs) and t is not None and any(map(str.isalpha, t))
                pred.append(model.langs[best[i]] if known else UNKNOWN)
                score.append(float(shares[i, best[i]]) if known else 0.0)
        return [pa.array(pred, pa.string()), pa.array(score, pa.float64())]

    return append(docs, "text", "lang_pred string, score double", work)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from the two thirds whose remainder is not 1."""
    docs = texts(table(spark, sf_dir, "documents"), "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = fit(docs.where(~held_out).select("text", "lang"))
    return identify(docs.drop("lang"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
