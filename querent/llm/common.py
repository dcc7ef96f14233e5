"""What the corpus operators share: input columns, Arrow maps, parallelism, cut lineage.

Conventions of every operator here. The input has ``doc_id`` (whole number) and
``text`` (string); other columns are carried by operators that return documents and
ignored by the rest, whatever their names. A null text counts as an empty one.
A row with a null ``doc_id`` is a document like any other unless its docstring says
otherwise. Repeated rows are separate documents. Empty tables give empty results.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Bytes of stored input for which one more hash bucket is opened.
BUCKET_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as a whole number, text as a string, and the named columns."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the tables below a plan, as far as the optimizer knows them. Only degrees of parallelism depend on it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def buckets(df: DataFrame, per: int = BUCKET_BYTES) -> int:
    """Hash buckets for data that grows with this input: one for so many stored bytes, at least as many as shuffle partitions."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1 << 22, math.ceil(stored_bytes(df) / per)))


#: Hash buckets that a task takes at most.
TASK_BUCKETS = 8


def grouped(df: DataFrame, n: int, keys: list[str], work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """groupBy(keys).applyInArrow, over tasks whose number follows that of the buckets, n."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, math.ceil(n / TASK_BUCKETS)), *keys).groupBy(*keys).applyInArrow(work, schema)


#: Keys that can each have more than one in so many rows of a table: at most as many.
HOT = 10_000


def hot_limit(rows: int) -> int:
    """Rows from which a key is hot: so many that at most HOT keys of a table of this many rows are."""
    return max(1024, rows // HOT)


def hot_join(rows: DataFrame, by: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows inner joined with by, which has one row a key and the number of rows that have it. Hot keys, HOT at most,
    travel to the rows, which stay where they are; only the rest meet in a shuffle."""
    few = F.broadcast(by.where(F.col(count) > hot_limit(total)))
    rest = rows.join(few.select(key), key, "left_anti").join(by.where(F.col(count) <= hot_limit(total)), key)
    return rows.join(few, key).unionByName(rest)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has: name, with underscores added until it is new (names are compared as Spark does)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what is set on the context, else spark.checkpoint.dir. Only a local master, as in tests, gets one of its own."""
    held = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if held:
        return held
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="querent-checkpoint-")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: later reads survive a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hold(df: DataFrame, rows: int = 500_000, memory: bool = True) -> DataFrame:
    """A reliable checkpoint in one file for so many rows, for the tables of an iteration: plans and lineage start anew there."""
    return probed(df, [], rows, memory)[0]


def probed(df: DataFrame, exprs: list[Column], rows: int = 500_000, memory: bool = True) -> tuple[DataFrame, Row]:
    """hold(df), and one row of aggregates over it: the number of rows, then exprs."""
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.persist(StorageLevel.MEMORY_AND_DISK if memory else StorageLevel.DISK_ONLY)
    seen = kept.agg(F.count(F.lit(1)), *exprs).first()
    out = kept.coalesce(max(1, math.ceil(seen[0] / rows))).checkpoint(eager=True)
    kept.unpersist()
    return out, seen


def append(df: DataFrame, column: str, schema: str, work: Callable[[pa.Array], list]) -> DataFrame:
    """df with new columns computed from one string column, batch by batch; equal names are replaced.

    work gets the Arrow strings of a batch and returns one Arrow array for each new column.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    new = _parse_datatype_string(schema)
    kept = [f for f in df.schema.fields if f.name not in new.names]
    out = StructType(kept + new.fields)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [batch.column(batch.schema.get_field_index(x)) for x in names]
            yield pa.RecordBatch.from_arrays(arrays + list(work(batch.column(batch.schema.get_field_index(column)))), names=out.names)

    return df.mapInArrow(run, out)


def strings(array: pa.Array) -> list[str]:
    """Python strings; null as empty."""
    return [x or "" for x in array.to_pylist()]
