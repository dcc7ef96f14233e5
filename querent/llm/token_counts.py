"""Operator 6, token counts: an exact histogram of encoded lengths and its suffix sums.

Documents are pre-aggregated by length before the shuffle, so the histogram has at most
one row for each distinct length. Suffix sums run in two levels: totals of spans of
lengths (a bounded number: lengths divided by SPAN), then a window within each span, so
no step needs the histogram in one place.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querent.llm.common import append, cut, strings, table, texts
from querent.llm.encode import encoder

SPAN = 64


def lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every whole text; null or empty: 0."""

    def work(array: pa.Array) -> list[pa.Array]:
        enc, text = encoder(path), strings(array)
        return [pa.array([len(x) // 4 for at in range(0, len(text), 512) for x in enc.ids(text[at : at + 512])], type=pa.int64())]

    return append(texts(docs), "text", "n_tokens long", work).drop("text")


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs: one row for each length that occurs; null lengths are none."""
    return lengths.where(F.col("n_tokens").isNotNull()).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L of the histogram, as a context limit: docs and tokens of documents of at least L tokens,
    docs_over and tokens_over of longer ones, docs_total and tokens_total of all, and
    truncated_total, what remains if every document is cut at L."""
    span = F.floor(F.col("n_tokens") / SPAN)
    own = hist.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("span", span)
    spans = own.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    above = spans.select(
        F.col("span").alias("above_span"),
        *(F.coalesce(F.sum(x).over(after), F.lit(0)).alias(f"above_{x}") for x in "dt"),
        *(F.sum(x).over(every).alias(f"all_{x}") for x in "dt"),
    )
    within = Window.partitionBy("span").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    joined = own.join(above, F.col("span") == F.col("above_span"))
    at_least_d = F.col("above_d") + F.sum("n_docs").over(within)
    at_least_t = F.col("above_t") + F.sum("tokens").over(within)
    out = joined.withColumns({"docs_at_least": at_least_d, "tokens_at_least": at_least_t})
    return out.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("docs_at_least") - F.col("n_docs")).alias("docs_over"),
        (F.col("tokens_at_least") - F.col("tokens")).alias("tokens_over"),
        F.col("all_d").alias("docs_total"), F.col("all_t").alias("tokens_total"),
        (F.col("all_t") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("truncated_total"),
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the least length that at least a share q of the documents does not exceed; null over no documents."""
    return sums.where(F.col("docs_total") - F.col("docs_over") >= F.lit(q) * F.col("docs_total")).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: tokens that remain if every document is cut at any limit, one of the lengths or not."""
    longer = F.col("n_tokens") > limit
    return sums.agg(F.coalesce(F.sum(F.when(longer, F.lit(limit)).otherwise(F.col("n_tokens")) * F.col("n_docs")), F.lit(0)).alias("tokens"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of the encoded lengths of all documents with suffix sums for every limit."""
    return suffix_sums(cut(histogram(lengths(table(spark, sf_dir, "documents")))))
