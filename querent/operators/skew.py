"""Joins that a frequent key cannot skew, and rows dealt evenly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.sources.stored import stored

#: Keys that can each have more than one in so many rows: at most as many. And rows below which no key is frequent.
HOT, LEAST = 10_000, 100_000
#: Bytes of text that a table may have to be broadcast whole, once they have been counted.
SMALL = 16 << 20


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt over tasks by keys before work that is much for each: a small file, or one of few row groups, is read by few tasks.

    The number of parts is given, so that parts of few bytes are not merged again.
    """
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def frequent(rows: DataFrame, keys: list[str], hot: int | None = None, least: int | None = None) -> DataFrame | None:
    """The keys of more than one in HOT rows, HOT at most; None if there are none. Rows are counted with partial sums, never gathered."""
    counts = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "counts")
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    limit = max(LEAST if least is None else least, (total or 0) // (hot or HOT))
    return counts.where(F.col("_n") > limit).select(*keys) if (most or 0) > limit else None


def split_join(rows: DataFrame, by: DataFrame, keys: list[str], how: str = "inner", hot: int | None = None, least: int | None = None) -> DataFrame:
    """rows joined (inner or left) with by, which has one row a key: the rows of frequent keys stay where they are and get
    their few rows of by as a broadcast; the others meet in a shuffle.

    by is never broadcast whole: how large it is can't be told from the sizes of the files that it is made of.
    """
    few = frequent(rows, keys, hot, least)
    if few is None:
        return rows.join(by.hint("merge"), keys, how)
    few = F.broadcast(few)
    columns = [*keys, *(c for c in rows.columns if c not in keys), *(c for c in by.columns if c not in keys)]
    own = rows if how == "inner" else rows.join(few, keys, "left_semi")
    own = own.join(F.broadcast(by.join(few, keys, "left_semi")), keys, how)
    rest = rows.join(few, keys, "left_anti").join(by.hint("merge"), keys, how)
    return own.select(*columns).union(rest.select(*columns))


def measured_join(rows: DataFrame, by: DataFrame, keys: list[str], how: str = "inner", hot: int | None = None, least: int | None = None, costly: bool = False) -> DataFrame:
    """``split_join`` unless by, which is written and measured first, is small: then it is broadcast whole and all rows stay in their tasks.

    costly rows are written before ``split_join`` counts them.
    """
    by = stored(by, "by")
    if (by.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0) <= SMALL:
        return rows.join(F.broadcast(by), keys, how)
    return split_join(stored(rows, "rows") if costly else rows, by, keys, how, hot, least)
