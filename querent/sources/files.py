"""Readers of dataset files. Position is identity there, so every reader gives ``idx`` from 0.

A small JSON array or a line-aligned file is one value that Spark reads whole (wholetext) and
explodes with positions; a large array is split over tasks with exact positions (``documents``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.functions.answers import stripped
from querent.sources import documents

QUESTION = "struct<db_id:string,question:string,question_toks:array<string>,query:string,SQL:string,evidence:string,question_id:bigint>"
LINKING = (
    "struct<raw_question:string,db_id:string,question:array<string>,question_for_copying:array<string>,"
    "sc_link:struct<q_col_match:map<string,string>,q_tab_match:map<string,string>>,"
    "cv_link:struct<num_date_match:map<string,string>,cell_match:map<string,string>>,"
    "columns:array<array<string>>,tables:array<array<string>>,table_bounds:array<int>,column_to_table:map<string,int>,"
    "table_to_columns:map<string,array<int>>,foreign_keys:map<string,int>,foreign_keys_tables:map<string,array<int>>,primary_keys:array<int>>"
)
TASK = "struct<questions:array<struct<prompt_tokens:bigint,prompt:string,response:string,n_examples:int,db_id:string>>>"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def digest(spark: SparkSession, path: str) -> str:
    """A name for the contents of a file, or of the parts of a folder in order."""
    parts = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("d"))
    return parts.agg(F.sha2(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("path", "d"))), lambda x: x["d"])), 256)).first()[0]


def json_array(spark: SparkSession, path: str, item: str, whole: int = documents.WHOLE) -> DataFrame:
    """idx and the item's fields of a JSON array of structs; a file of more bytes than ``whole`` is split over tasks."""
    if documents.size(spark, path) > whole:
        return documents.elements(spark, path).select("idx", F.from_json("value", item).alias("item")).select("idx", "item.*")
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.posexplode(F.from_json("value", f"array<{item}>")).alias("idx", "item")).select(F.col("idx").cast("long"), "item.*")


def questions(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, QUESTION)


def lines(spark: SparkSession, path: str, keep_blank: bool = True) -> DataFrame:
    """idx, value of a text file's lines, outer white space off; a last line end opens no line. Blank lines count unless left out."""
    whole = spark.read.text(path, wholetext=True)
    text = F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), "\n$", "")
    parts = F.transform(F.split(text, "\n"), stripped)
    if not keep_blank:
        parts = F.filter(parts, lambda t: t != "")
    return whole.where("value <> ''").select(F.posexplode(parts).alias("idx", "value")).withColumn("idx", F.col("idx").cast("long"))


def json_lines(spark: SparkSession, path: str, item: str) -> DataFrame | None:
    """idx and the item's fields of a JSON-lines file, blank lines left out; None if there is no file."""
    if not exists(spark, path):
        return None
    return lines(spark, path, keep_blank=False).select("idx", F.from_json("value", item).alias("item")).select("idx", "item.*")


def positions(spark: SparkSession, path: str) -> DataFrame:
    """place, idx of an index file: a JSON array of row positions."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.posexplode(F.from_json("value", "array<bigint>")).alias("place", "idx")).withColumn("place", F.col("place").cast("long"))


def task(spark: SparkSession, path: str) -> DataFrame:
    """idx, prompt, db_id and the rest of a task file's questions."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", TASK).alias("t"))
    return raw.select(F.posexplode("t.questions").alias("idx", "q")).select(F.col("idx").cast("long"), "q.*")


def links(linking: DataFrame) -> DataFrame:
    """Long form (idx, db_id, q_id, kind, target_id, flag) of linking records, from their `token,target` maps."""
    out = None
    for kind, column in (("col", "sc_link.q_col_match"), ("tab", "sc_link.q_tab_match"), ("num", "cv_link.num_date_match"), ("cell", "cv_link.cell_match")):
        one = linking.select("idx", "db_id", F.explode(column).alias("k", "flag"))
        one = one.select("idx", "db_id", F.split_part("k", F.lit(","), F.lit(1)).cast("int").alias("q_id"), F.lit(kind).alias("kind"), F.split_part("k", F.lit(","), F.lit(2)).cast("int").alias("target_id"), "flag")
        out = one if out is None else out.union(one)
    return out
