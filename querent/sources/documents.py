"""JSON documents as they are written by one process, read and written by many.

Reading: a file that is one JSON array is split over tasks anywhere, not at its lines. Spark
cuts it at `}`; a first pass finds, for every range of bytes, how many quotes and brackets it
has (for both cases, that it begins within a string or not), so that prefix sums tell the state
in which each range begins; a second pass cuts the elements, and those that lie in several
ranges are put together. Positions are exact.

Writing: rows are range-partitioned by idx and each part is written as a piece of the
document; the pieces are then joined byte by byte, with what stands before and behind them.
No row, task or driver holds more than a part.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.sources.stored import folder, stored

#: Bytes up to which an array is read as one value.
WHOLE = 32 << 20
_STRING = re.compile(r'"(?:[^"\\]|\\.)*("|\\?$)', re.DOTALL)
_REST = re.compile(r'(?:[^"\\]|\\.)*("|\\?$)', re.DOTALL)


@dataclass(frozen=True)
class Step:
    """What a piece of text does to the state: where it ends if it begins outside a string, and if it begins inside, and by how many brackets it goes deeper."""

    inside: tuple[bool, bool] = (False, True)
    deeper: tuple[int, int] = (0, 0)

    def then(self, other: Step) -> Step:
        return Step(tuple(other.inside[x] for x in self.inside), tuple(d + other.deeper[x] for d, x in zip(self.deeper, self.inside, strict=True)))


def step(text: str) -> Step:
    return Step(*zip(*(_state(text, x) for x in (False, True)), strict=True))


def _state(text: str, inside: bool) -> tuple[bool, int]:
    """Whether a text ends within a string, and by how many brackets it goes deeper."""
    if inside:
        m = _REST.match(text)
        if m[1] != '"':
            return True, 0
        text = text[m.end() :]
    bare, ends = [], False
    at = 0
    for m in _STRING.finditer(text):
        bare.append(text[at : m.start()])
        at, ends = m.end(), m[1] != '"'
    rest = "".join([*bare, text[at:]])
    return ends, rest.count("{") + rest.count("[") - rest.count("}") - rest.count("]")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """start (of the range of bytes), value (text up to and with a `}`), in the order of the file within each range."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_block_start").alias("start"), F.concat("value", F.lit("}")).alias("value"))


def elements(spark: SparkSession, path: str) -> DataFrame:
    """idx, value: the elements of a JSON array of objects, as text."""
    chunks = _chunks(spark, path)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Step] = {}
        for batch in batches:
            for start, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[start] = found.get(start, Step()).then(step(text))
        rows = [(k, *s.inside, *s.deeper) for k, s in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, (pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["start", "i0", "i1", "d0", "d1"])

    # one row for each range of bytes
    ranges = sorted(map(tuple, chunks.mapInArrow(steps, "start long, i0 boolean, i1 boolean, d0 long, d1 long").collect()))
    begins, now, depth = {}, False, 0
    for start, i0, i1, d0, d1 in ranges:
        begins[start] = now, depth
        now, depth = (i1, depth + d1) if now else (i0, depth + d0)
    # the last `}` was put there by the reader, unless the file ends with it
    sent = spark.sparkContext.broadcast(begins)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """start, number (of the element within the range; -1 for the rest of one that began before), done, value."""
        at, state = None, {}
        for batch in batches:
            out: list[tuple] = []
            for start, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if start != at:
                    out += _open(at, state)
                    at = start
                    inside, depth = sent.value[start]
                    state = {"inside": inside, "depth": depth, "n": -1, "text": []}
                if state["depth"] == 1 and not state["inside"]:
                    first = text.find("{")
                    if first < 0:
                        state["depth"] = 0
                        continue
                    state["depth"] += _state(text[:first], False)[1]
                    text, state["n"], state["text"] = text[first:], state["n"] + 1, []
                elif state["depth"] < 1:
                    first = text.find("[")
                    second = text.find("{", first)
                    if first < 0 or second < 0 or state["n"] >= 0:
                        continue
                    text, state["n"], state["text"], state["depth"] = text[second:], 0, [], 1
                state["inside"], deeper = _state(text, state["inside"])
                state["depth"] += deeper
                state["text"].append(text)
                if state["depth"] == 1 and not state["inside"]:
                    out.append((at, state["n"], True, "".join(state["text"])))
                    state["text"] = []
            yield _record(out)
        yield _record(_open(at, state))

    pieces = stored(chunks.mapInArrow(cut, "start long, number long, done boolean, value string"), "elements")
    last = {r["start"]: r["n"] for r in pieces.groupBy("start").agg(F.max("number").alias("n")).collect()}
    before, total = [], 0
    for start, *_ in ranges:
        before.append((start, total))
        total += last.get(start, -1) + 1
    offsets = F.broadcast(spark.createDataFrame(before, "start long, before long"))  # one row for each range of bytes
    numbered = pieces.join(offsets, "start").withColumn("idx", F.col("before") + F.col("number"))
    # elements of several ranges: two pieces of a range at most are of such
    parted = numbered.where("number < 0 or not done")
    whole = parted.groupBy("idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda x: x["value"]), "").alias("value"))
    return numbered.where("number >= 0 and done").select("idx", "value").union(whole.select("idx", "value"))


def _open(start: int | None, state: dict) -> list[tuple]:
    """What a range leaves of an element that goes on behind it."""
    return [(start, state["n"], False, "".join(state["text"]))] if state.get("text") else []


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)], names=["start", "number", "done", "value"])


def size(spark: SparkSession, path: str) -> int:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def write(df: DataFrame, value: Column, path: str, head: str = "[", tail: str = "]", between: str = ",") -> None:
    """Writes path/part-00000: head, a value for each row in order of idx with `between` between them, tail, and a line end."""
    spark = df.sparkSession
    place = f"{folder(spark)}/document-{uuid.uuid4().hex}"
    # one row after the other, each with what stands between; the last one's is cut off
    df.select("idx", value.alias("value")).orderBy("idx").select("value").write.option("lineSep", between).text(place)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = (jvm.org.apache.hadoop.fs.Path(x) for x in (place, path))
    fs, other = source.getFileSystem(conf), target.getFileSystem(conf)
    parts = sorted((str(s.getPath()), s.getLen()) for s in fs.listStatus(source) if s.getPath().getName().startswith("part-") and s.getLen())
    other.delete(target, True)
    out = other.create(jvm.org.apache.hadoop.fs.Path(target, "part-00000"))
    try:
        out.write(bytearray(head.encode()))
        for i, (part, length) in enumerate(parts):
            data = fs.open(jvm.org.apache.hadoop.fs.Path(part))
            # a copy inside the JVM, by blocks: the bytes pass through the driver, none is held
            jvm.org.apache.commons.io.IOUtils.copyLarge(data, out, 0, length - len(between.encode()) * (i == len(parts) - 1))
            data.close()
        out.write(bytearray((tail + "\n").encode()))
    finally:
        out.close()
    fs.delete(source, True)
