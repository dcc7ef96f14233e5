"""A sentence encoder that is fitted on the corpus itself: TF-IDF and a truncated SVD.

Words and pairs of neighbours are hashed to SLOTS; a slot's weight follows the number of texts
that have it. The directions of the vectors are the leading right singular vectors of the
weighted texts, found by a randomised method in a fixed number of passes over the corpus: one
for the weights, two that multiply a random matrix by the corpus and back, one for the small
matrix whose eigenvectors finish it. A pass sums a matrix of SLOTS rows in every task and then
over tasks; its size does not grow with the corpus, and the model's, which tasks read, neither.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.plans.hooks import Encoder

#: Slots of words, directions, and those more that the method works with.
SLOTS, SIZE, MORE = 1 << 14, 128, 10
#: Rows of a matrix in one message between tasks.
BLOCK = 256
_PART = re.compile(r"\w+|[^\w\s]")


def slots(text: str, size: int) -> dict[int, float]:
    """How often each slot's parts occur, damped: 1 + the logarithm of the count."""
    words = _PART.findall(text.lower())
    found: dict[int, float] = {}
    for part in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
        h = zlib.crc32(part.encode()) % size
        found[h] = found.get(h, 0.0) + 1.0
    return {h: 1.0 + float(np.log(n)) for h, n in found.items()}


def weighted(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text's row, of length one."""
    found = slots(text, len(idf))
    at = np.fromiter(found.keys(), dtype=np.int64, count=len(found))
    values = np.fromiter(found.values(), dtype=np.float64, count=len(found)) * idf[at]
    length = np.sqrt((values * values).sum())
    return at, values / length if length else values


@dataclass(frozen=True)
class FittedWords:
    """A factory of encoders by a fitted model: vectors of length one; a text without any known word is zero."""

    model: Broadcast

    def __call__(self) -> Encoder:
        idf, directions = self.model.value

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), directions.shape[1]))
            for i, text in enumerate(texts):
                at, values = weighted(text, idf)
                out[i] = values @ directions[at]
            return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)

        return encode


def _summed(texts: DataFrame, shape: tuple[int, int], work: Callable[[str, np.ndarray], None]) -> np.ndarray:
    """The sum, over all texts, of what work adds to a matrix: one in every task, then BLOCK rows of all tasks together."""
    n, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                work(text or "", total)
        touched = [a for a in range(0, n, BLOCK) if total[a : a + BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(touched, pa.int32()), pa.array([total[a : a + BLOCK].tobytes() for a in touched], pa.binary())], names=["at", "rows"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(rows)
                held[at] = own if at not in held else held[at] + own
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["at", "rows"])

    kind = "at int, rows binary"
    sums = texts.mapInArrow(run, kind).repartition(max(1, min(64, n // BLOCK)), "at").mapInArrow(add, kind).toArrow()
    out = np.zeros(shape)
    for at, rows in zip(sums["at"].to_pylist(), sums["rows"].to_pylist(), strict=True):
        out[at : at + BLOCK] = np.frombuffer(rows).reshape(-1, width)
    return out


def fit(corpus: DataFrame, column: str = "question", size: int = SIZE, slots_: int = SLOTS, seed: int = 0) -> FittedWords:
    """An encoder fitted on a column of texts. Null texts are empty ones; a corpus without words gives zero vectors."""
    texts = corpus.select(F.col(column).cast("string").alias("text"))
    width = min(slots_, size + MORE)

    def count(text: str, total: np.ndarray) -> None:
        found = slots(text, slots_)
        total[list(found), 0] += 1
        total[0, 1] += 1

    counts = _summed(texts, (slots_, 2), count)
    idf = np.where(counts[:, 0] > 0, np.log((1 + counts[0, 1]) / (1 + counts[:, 0])) + 1, 0.0)

    def times(basis: np.ndarray) -> np.ndarray:
        """The corpus, transposed, times the corpus times a matrix."""
        sent = texts.sparkSession.sparkContext.broadcast((idf, basis))

        def work(text: str, total: np.ndarray) -> None:
            weights, own = sent.value
            at, values = weighted(text, weights)
            total[at] += np.outer(values, values @ own[at])

        return _summed(texts, basis.shape, work)

    basis = np.random.Generator(np.random.PCG64(seed)).standard_normal((slots_, width))
    for _ in range(2):
        basis, _ = np.linalg.qr(times(basis))
    small = basis.T @ times(basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    directions = basis @ vectors[:, np.argsort(values)[::-1][:size]]
    return FittedWords(texts.sparkSession.sparkContext.broadcast((idf, directions)))
