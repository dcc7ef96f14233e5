"""Positional relations of datasets: unions in order, alignment by row number, subsets, duplicates, resumption.

Frames that have order carry ``idx``, a row number from 0. It is never made up from a
splittable file's partitions; see ``querent.sources.files``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_splits(*parts: DataFrame) -> DataFrame:
    """Rows of all parts, idx counted on over them; each part's idx is gapless from 0."""
    sizes = [p.agg(F.count(F.lit(1)).alias("n")) for p in parts]
    out = []
    for k, part in enumerate(parts):
        if k:
            before = reduce(DataFrame.union, sizes[:k]).agg(F.sum("n").alias("_before"))
            part = part.join(F.broadcast(before)).withColumn("idx", F.col("idx") + F.col("_before")).drop("_before")
        out.append(part)
    return reduce(DataFrame.unionByName, out)


def aligned(left: DataFrame, right: DataFrame, total: bool = False) -> DataFrame:
    """Rows of equal idx, as far as the shorter side reaches; total: a difference in length is an error."""
    if not total:
        return left.join(right, "idx")
    both = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), "idx", "full")
    same = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.where(F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("the two sides differ in length")).isNull())).drop("_l", "_r")


def subset(rows: DataFrame, positions: DataFrame) -> DataFrame:
    """The rows at given positions (place, idx), numbered in the order of the list."""
    return rows.join(positions, "idx").withColumn("idx", F.col("place")).drop("place")


def batches(rows: DataFrame, size: int, start: int, end: int) -> DataFrame:
    """Rows whose batch number is from start to before end."""
    batch = F.floor(F.col("idx") / size)
    return rows.where((batch >= start) & (batch < end))


def later_duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of which an earlier one has the same keys; equal nulls too. Each key's first place is a minimum with partial sums, and rows of a frequent key are not gathered."""
    named = [f"_key{i}" for i in range(len(keys))]
    first = rows.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, named, strict=True))).agg(F.min("idx").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, named, strict=True)])
    return rows.join(first, same).where(F.col("idx") > F.col("_first")).select(*rows.columns)


def resumed(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose idx is not written yet."""
    return rows.join(done.select("idx"), "idx", "left_anti")


def not_blank(lines: DataFrame, value: str | Column = "value") -> DataFrame:
    value = F.col(value) if isinstance(value, str) else value
    return lines.where(F.length(F.regexp_replace(value, r"^\s+|\s+$", "")) > 0)
