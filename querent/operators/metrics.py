"""Quality of chosen examples, and cost of prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.functions.similarity import jaccard_multiset

# US dollars for 1000 tokens.
PRICES = {
    "text-davinci-003": 0.0200,
    "code-davinci-002": 0.0200,
    "gpt-3.5-turbo": 0.0020,
    "gpt-3.5-turbo-0613": 0.0020,
    "gpt-3.5-turbo-16k": 0.003,
    "gpt-3.5-turbo-0301": 0.0020,
    "gpt-4": 0.03,
}


def quality(chosen: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row, quality: mean similarity of two token strings over all chosen pairs; 1 if there are none."""
    return chosen.agg(F.coalesce(F.avg(jaccard_multiset(a, b)), F.lit(1.0)).alias("quality"))


def quality_per_target(chosen: DataFrame, a: Column, b: Column, by: str = "t_idx") -> DataFrame:
    return chosen.groupBy(by).agg(F.avg(jaccard_multiset(a, b)).alias("quality"))


def costs(spark: SparkSession, prompts: DataFrame, answer_tokens: int = 200) -> DataFrame:
    """model, prompts, tokens, tokens_per_prompt, cost of answering all prompts (prompt_tokens), answers at their limit."""
    totals = prompts.agg(F.count(F.lit(1)).alias("prompts"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("tokens"), F.avg("prompt_tokens").alias("tokens_per_prompt"))
    prices = spark.createDataFrame(list(PRICES.items()), "model string, price double")
    cost = F.col("price") * (F.col("tokens") + F.col("prompts") * answer_tokens) / 1000
    return prices.join(F.broadcast(totals)).select("model", "prompts", "tokens", "tokens_per_prompt", cost.alias("cost"))
