"""Writers of dataset files.

Scalable outputs are Spark directories (JSON lines, text) in order of ``idx``. The few
formats that other tools want as one document are joined from ranges (``documents``).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.functions.answers import export_line
from querent.sources import documents


def linking_records(questions: DataFrame, links: DataFrame) -> DataFrame:
    """idx, db_id, question, sc_link, cv_link: records with `token,target` maps, from long links."""
    key = F.concat_ws(",", F.col("q_id").cast("string"), F.col("target_id").cast("string"))

    def of(kind: str) -> Column:
        entries = F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.struct(key.alias("k"), F.col("flag").alias("v")))))
        return F.map_from_entries(entries)

    maps = links.groupBy("idx").agg(*(of(k).alias(k) for k in ("col", "tab", "num", "cell")))
    none = F.create_map().cast("map<string,string>")
    have = lambda k: F.coalesce(k, none)
    joined = questions.join(maps, "idx", "left")
    sc = F.struct(have("col").alias("q_col_match"), have("tab").alias("q_tab_match"))
    cv = F.struct(have("num").alias("num_date_match"), have("cell").alias("cell_match"))
    return joined.select("idx", "db_id", F.col("toks").alias("question"), sc.alias("sc_link"), cv.alias("cv_link"))


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows by idx as JSON lines, without idx itself."""
    df.orderBy("idx").drop("idx").write.mode(mode).json(path)


def write_lines(df: DataFrame, path: str, value: str = "sql", append: bool = False) -> None:
    """One text line a row, by idx; append resumes an earlier run."""
    df.orderBy("idx").select(value).write.mode("append" if append else "overwrite").text(path)


def write_json_array(df: DataFrame, path: str, indent: bool = False) -> None:
    """Writes the rows by idx as one JSON array, without idx itself."""
    row = F.to_json(F.struct(*(c for c in df.columns if c != "idx")), {"pretty": "true"} if indent else {})
    if indent:
        documents.write(df, row, path, "[ ", " ]", ", ")
    else:
        documents.write(df, row, path)


def write_task(prompts: DataFrame, args: dict[str, str], costs: dict[str, float], path: str) -> None:
    """Writes the task document: its arguments, its costs, and the prompts by idx."""
    row = F.to_json(F.struct("prompt_tokens", "prompt", "response", "n_examples", "db_id"))
    head = json.dumps({"args": args, "costs": costs}, separators=(",", ":"), ensure_ascii=False)
    documents.write(prompts, row, path, head[:-1] + ',"questions":[', "]}")


def run_name(layout: str, shots: int, selector: str, style: str, max_seq_len: int, max_ans_len: int) -> str:
    """Folder name that tells a run's configuration: context and answer lengths under their own labels."""
    return f"{layout}_{shots}-SHOT" + (f"_{selector}_{style}-EXAMPLE" if shots else "") + f"_CTX-{max_seq_len}_ANS-{max_ans_len}"


def write_export(predictions: DataFrame, reference: DataFrame, path: str) -> None:
    """Writes {question_id: sql, mark, db_id} of predictions (idx, sql) aligned with (idx, question_id, db_id)."""
    rows = predictions.join(reference, "idx").select("idx", F.create_map(F.col("question_id").cast("string"), export_line(F.col("sql"), F.col("db_id"))).alias("m"))
    entry = F.to_json("m")
    documents.write(rows, F.substr(entry, F.lit(2), F.length(entry) - 2), path, "{", "}")
