"""An index of a selection pool: exact nearest neighbours from few of its blocks.

Pool rows lie with the nearest of some pivots, in order of their distance from it, in blocks;
a table of blocks has the pivot and the least and greatest distance of each. A target's
distance from a row is at least the gap between the row's and the target's distances from
the pivot (the triangle inequality). So a search first reads, for every target, the blocks
that may be nearest, which bounds the distance of its k-th row; then it reads those blocks
alone that can hold a nearer row for some target. Rows equal those of ``selection.select``.

How many blocks a search reads depends on the data: few for pools with groups, nearly all
for vectors without structure. Cosine is searched as the distance of vectors at length 1;
zero vectors lie in blocks of their own, which are always read. Under a gate, blocks may
only be left out once a target has k rows that pass it.

Pivots are learned on a bounded sample (``SAMPLE``); they decide which blocks are read, never
which rows are found.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from querent.operators import selection
from querent.operators.selection import Strategy, vectors
from querent.sources.stored import folder, stored

#: Vectors that pivots are learned from, turns of learning, and rows of a block.
SAMPLE, TURNS, ROWS = 4096, 5, 2048
#: Blocks that are read for each target to bound its k-th row.
SEEDS = 2
#: Slack of bounds on distances, in parts of the lengths.
SLACK = 1e-6


@dataclass(frozen=True)
class Index:
    path: str
    pivots: np.ndarray
    cosine: bool
    schema: StructType

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def blocks(self, spark: SparkSession) -> DataFrame:
        """_block, _pivot, low, high, n of each block."""
        return spark.read.parquet(f"{self.path}/blocks")


def _at_one(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(axis=1))[:, None]
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0))


def _learned(pool: DataFrame, n: int, cosine: bool) -> np.ndarray:
    """At most n pivots: means of groups of a sample."""
    held = pool.select(F.col("vector").cast("array<double>").alias("vector"), F.xxhash64("idx").alias("h")).orderBy("h").limit(SAMPLE).toArrow()["vector"]
    _, m = vectors(held.combine_chunks() if held.num_chunks != 1 else held.chunk(0))
    if not len(m):
        return np.zeros((1, 1))
    m = _at_one(m) if cosine else m
    # each next pivot is the vector farthest from those before
    chosen, far = [0], distances(m, m[:1])[:, 0]
    while len(chosen) < min(n, len(m)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(m, m[chosen[-1:]])[:, 0])
    pivots = m[chosen]
    for _ in range(TURNS):
        own = distances(m, pivots).argmin(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, own, m)
        size = np.bincount(own, minlength=len(pivots))[:, None]
        pivots = np.divide(sums, size, out=pivots.copy(), where=size > 0)
    return pivots


def build(pool: DataFrame, pivots: int = 64, cosine: bool = False, rows: int = ROWS) -> Index:
    """An index of a pool (idx, db_id, question, vector, and more columns), in the shared folder. Rows without a usable vector are left out."""
    spark = pool.sparkSession
    own = pool.withColumn("vector", F.col("vector").cast("array<double>"))
    schema = own.withColumns({"_pivot": F.lit(0), "_dist": F.lit(0.0)}).schema
    whole = own.withColumns({"_dist": F.lit(0.0), "_block": F.lit(0).cast("long"), "_pivot": F.lit(0)}).schema
    index = Index(f"{folder(spark)}/index-{uuid.uuid4().hex}", _learned(pool, pivots, cosine), cosine, whole)
    sent = spark.sparkContext.broadcast(index.pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, m = vectors(batch.column(batch.schema.get_field_index("vector")), sent.value.shape[1])
            zero = ~m.any(axis=1)
            d = distances(_at_one(m) if cosine else m, sent.value)
            near = d.argmin(axis=1) if len(m) else np.empty(0, dtype=np.int64)
            dist = np.where(zero & cosine, 0.0, d[np.arange(len(m)), near])
            kept = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.where(zero & cosine, -1, near), pa.int32()), pa.array(dist)], names=schema.names)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, last, n = TaskContext.get().partitionId() << 32, -1, None, 0
        for batch in batches:
            out = []
            for x in batch.column(batch.schema.get_field_index("_pivot")).to_pylist():
                if x != last or n == rows:
                    block, last, n = block + 1, x, 0
                n += 1
                out.append(part | block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*schema.names, "_block"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.mapInArrow(assign, schema).repartitionByRange(parts, "_pivot", "_dist", "idx").sortWithinPartitions("_pivot", "_dist", "idx")
    numbered = dealt.mapInArrow(number, dealt.withColumn("_block", F.lit(0).cast("long")).schema)
    numbered.write.partitionBy("_pivot").parquet(f"{index.path}/rows")
    summary = index.rows(spark).groupBy("_block").agg(F.first("_pivot").alias("_pivot"), F.min("_dist").alias("low"), F.max("_dist").alias("high"), F.count(F.lit(1)).alias("n"))
    summary.write.parquet(f"{index.path}/blocks")
    return index


def _lower(index: Index, to_pivots: np.ndarray, blocks: pd.DataFrame) -> np.ndarray:
    """The least distance that each target can have from a row of each block."""
    d = to_pivots[:, np.maximum(blocks["_pivot"].to_numpy(), 0)]
    gap = np.maximum(np.maximum(blocks["low"].to_numpy()[None, :] - d, d - blocks["high"].to_numpy()[None, :]), 0)
    gap = np.maximum(gap - SLACK * (1 + d), 0)
    return np.where(blocks["_pivot"].to_numpy()[None, :] < 0, 0, gap)


def _keys(index: Index, strategy: Strategy, lower: np.ndarray) -> np.ndarray:
    """The least key of a row at that distance."""
    if index.cosine:
        return lower**2 / 2 - 1
    return lower - 1 if strategy.metric == "hybrid" else lower


def search(index: Index, targets: DataFrame, strategy: Strategy, k: int, cross_domain: bool = True, threshold: float = selection.THRESHOLD) -> tuple[DataFrame, dict[str, int]]:
    """What ``selection.select`` gives over the indexed pool, and {blocks, seeds, read}: all blocks of the pool, those read first and those read in all, for each part of the targets."""
    if (strategy.metric == "cosine") != index.cosine:
        raise ValueError("the index is for another metric")
    spark = targets.sparkSession
    names = ["idx", "db_id", "question", "vector", *([strategy.skeleton] if strategy.skeleton else [])]
    held = selection._held(targets.select(*names).orderBy("idx"))
    at, tv = vectors(pa.array([None if v is None else list(v) for v in held["vector"]], pa.list_(pa.float64())), index.pivots.shape[1])
    held = held.iloc[at].reset_index(drop=True)
    tv = _at_one(tv) if index.cosine else tv
    parts, report = [], {"blocks": index.blocks(spark).count(), "seeds": 0, "read": 0}
    for start in range(0, len(held), selection.BLOCK):
        own = held.iloc[start : start + selection.BLOCK].reset_index(drop=True)
        sent = spark.sparkContext.broadcast(distances(tv[start : start + selection.BLOCK], index.pivots))
        seeds = stored(_seeds(index, strategy, spark, sent), "seeds")
        rows = index.rows(spark)
        near = stored(_scan(rows.join(F.broadcast(seeds), ["_pivot", "_block"], "left_semi"), own, strategy, k, cross_domain, threshold), "near")
        late, key = _bounds(near, own, k)
        wanted = stored(_wanted(index, strategy, spark, sent, late, key, threshold).join(seeds, ["_pivot", "_block"], "left_anti"), "wanted")
        # blocks are as many as rows by the thousand; the plan broadcasts them or not by their size
        rest = _scan(rows.join(wanted, ["_pivot", "_block"], "left_semi"), own, strategy, k, cross_domain, threshold, (late, key))
        parts += [near, rest]
        report["seeds"] += seeds.count()
        report["read"] += seeds.count() + wanted.count()
    if not parts:
        return spark.createDataFrame([], "t_idx long, c_idx long, rank int, score double, sim double"), report
    return selection.ranked(parts, strategy, k), report


def _scan(rows: DataFrame, own: pd.DataFrame, strategy: Strategy, k: int, cross_domain: bool, threshold: float, bounds: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    rows = selection._gated(rows, own, strategy, threshold) if strategy.gate else rows
    return selection._block(rows, own, strategy, k, cross_domain, threshold, bounds)


def _seeds(index: Index, strategy: Strategy, spark: SparkSession, sent) -> DataFrame:
    """The SEEDS blocks that may be nearest to each target, and those of zero vectors: so many times the targets, at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lower = _lower(index, sent.value, batch)
            if lower.size:
                first = np.argsort(lower, axis=1, kind="stable")[:, :SEEDS]
                t = np.repeat(np.arange(len(lower)), first.shape[1])
                yield pd.DataFrame({"t": t, "_pivot": batch["_pivot"].to_numpy()[first.ravel()], "_block": batch["_block"].to_numpy()[first.ravel()], "lower": lower[t, first.ravel()]})

    best = index.blocks(spark).mapInPandas(run, "t int, _pivot int, _block long, lower double")
    order = Window.partitionBy("t").orderBy("lower", "_block")
    return best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SEEDS).select("_pivot", "_block").distinct()


def _bounds(near: DataFrame, own: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """late and key of each target's k-th row so far; 2 and infinity where it has fewer. A row for each target comes to the driver."""
    order = Window.partitionBy("t_idx").orderBy("late", "key", "c_idx")
    kth = near.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("t_idx", "late", "key").toPandas()
    place = {x: i for i, x in enumerate(own["idx"].tolist())}
    late, key = np.full(len(own), 2), np.full(len(own), np.inf)
    at = [place[x] for x in kth["t_idx"].tolist()]
    late[at], key[at] = kth["late"].to_numpy(), kth["key"].to_numpy()
    return late, key


def _wanted(index: Index, strategy: Strategy, spark: SparkSession, sent, late: np.ndarray, key: np.ndarray, threshold: float) -> DataFrame:
    """Blocks that can hold one of some target's k first rows."""
    bound = np.where(late == 0, key + SLACK * (1 + np.abs(key)), np.inf)
    if strategy.most is not None:
        bound = np.minimum(bound, threshold + SLACK)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hit = (_keys(index, strategy, _lower(index, sent.value, batch)) <= bound[:, None]).any(axis=0)
            yield batch.loc[hit | (batch["_pivot"].to_numpy() < 0), ["_pivot", "_block"]]

    return index.blocks(spark).mapInPandas(run, "_pivot int, _block long")
