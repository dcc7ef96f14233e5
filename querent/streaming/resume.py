"""Answering a growing folder of prompts: the streaming form of a resumable run.

Which idx has been seen is state of the stream, kept with its checkpoint, so a prompt is taken
once however often its idx arrives, and no batch reads what was written before. A micro-batch
writes a folder of its own, named by its number: one that is repeated after a failure writes the
same folder again. What a repeated batch has paid for is found again if ``answer`` keeps a ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

PROMPT = "idx long, db_id string, prompt string"


def answer_stream(spark: SparkSession, prompts: str, out: str, checkpoint: str, answer: Callable[[DataFrame], DataFrame], per_trigger: int = 100) -> StreamingQuery:
    """Starts a query from JSON-lines prompts to Parquet answers (idx, what ``answer`` gives, and batch); it ends when all files are read."""

    def batch(rows: DataFrame, number: int) -> None:
        answer(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(PROMPT).option("maxFilesPerTrigger", per_trigger).json(prompts).dropDuplicates(["idx"])
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
