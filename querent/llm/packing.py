"""Operator 5, packing by power-of-two decomposition.

A document's ids are cut, from the left, into pieces of the largest power of two that
still fits (at most the context limit): whole contexts first, then the binary digits of
the rest. A piece is a sequence of its own in the bucket of its length, so no sequence
crosses documents and none is padded. The plan is one map over the documents without any
shuffle: a sequence's id is its task's number and its place there, which a repeated task
reproduces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm.common import strings, table, texts
from querent.llm.encode import encoder

CONTEXT = 4096
END = 2


def cuts(n: int, context: int = CONTEXT) -> list[int]:
    """Lengths of a document's pieces, none growing; context must be a power of two."""
    whole, rest = divmod(n, context)
    return [context] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, context: int = CONTEXT, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, bucket (log2 of the length), ids_crc32, doc_tokens, sequence_id, offset, and ids if wanted.

    A null or empty text is its end mark alone: one piece of length 1. Repeated rows are packed each.
    """
    if context < 1 or context & (context - 1):
        raise ValueError("context must be a power of two")
    schema = "doc_id long, start long, length long, bucket int, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, size, begin, length, crc, total, held = [], [], [], [], [], [], []
                for doc_id, data in zip(part.column(0).to_pylist(), enc.ids(strings(part.column(1))), strict=True):
                    data += end
                    n = len(data) // 4
                    start = 0
                    for k in cuts(n, context):
                        own = data[4 * start : 4 * (start + k)]
                        ids.append(doc_id)
                        begin.append(start)
                        length.append(k)
                        size.append(k.bit_length() - 1)
                        crc.append(zlib.crc32(own))
                        total.append(n)
                        if keep_ids:
                            held.append(np.frombuffer(own, dtype="<i4"))
                        start += k
                cols = [pa.array(ids, pa.int64()), pa.array(begin, pa.int64()), pa.array(length, pa.int64()), pa.array(size, pa.int32()), pa.array(crc, pa.int64()), pa.array(total, pa.int64())]
                names = ["doc_id", "start", "length", "bucket", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    cols.append(pa.array(held, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    out = texts(docs).mapInArrow(run, schema)
    return out.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes pieces to a folder for each length (bucket=k), so a reader gets all sequences of one length without a scan of the others.

    Every task writes its own files, without a shuffle; most documents being long or all of one length skews nothing.
    """
    packed.write.partitionBy("bucket").parquet(path)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return pieces(table(spark, sf_dir, "documents"))
