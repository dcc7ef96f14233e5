"""SQLite databases as catalogs and tables.

A database file opens on the driver for its catalog (a few rows). Cells are read in tasks, a
range of rowids each (``sqlite_table``); a folder with many databases is read in parallel.
Files must be reachable by path where tasks run. Text that is not UTF-8 loses the broken bytes.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from querent.sources import sqlite_table
from querent.sources.catalog import Catalog
from querent.sources.sqlite_table import connect, quoted
from querent.sources.stored import stored, write


def databases(folder: str) -> list[tuple[str, str]]:
    """(db_id, path) of database/<db>/<db>.sqlite files, or of the first *.sqlite* file of a subfolder."""
    out = []
    for db in sorted(os.listdir(folder)):
        files = sorted(x for x in os.listdir(os.path.join(folder, db)) if ".sqlite" in x) if os.path.isdir(os.path.join(folder, db)) else []
        if files:
            named = f"{db}.sqlite"
            out.append((db, os.path.join(folder, db, named if named in files else files[0])))
    return out


def stamp(files: list[tuple[str, str]]) -> str:
    """A name for the contents of (db_id, path) files, by their sizes and times, those of a write-ahead log too."""
    state = []
    for db, path in files:
        for name in (path, f"{path}-wal"):
            if os.path.exists(name):
                own = os.stat(name)
                state.append([db, os.path.basename(name), own.st_size, own.st_mtime_ns])
    return hashlib.sha256(json.dumps(state).encode()).hexdigest()


def _kind(declared: str) -> str:
    d = declared.lower()
    if any(x in d for x in ("int", "real", "floa", "doub", "num", "dec")):
        return "number"
    if "bool" in d:
        return "boolean"
    return "time" if any(x in d for x in ("date", "time", "year")) else "text"


def catalog(spark: SparkSession, files: list[tuple[str, str]]) -> Catalog:
    """Catalog of (db_id, path) files. A foreign key without a column refers to the primary key of its table."""
    tables, columns, fks = [], [], []
    for db, path in files:
        con = connect(path)
        try:
            names = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite~_%' ESCAPE '~' ORDER BY rowid")]
            col_id, keys = 0, {}
            for table_id, name in enumerate(names):
                ddl = con.execute("SELECT sql FROM sqlite_master WHERE tbl_name = ? ORDER BY rowid", (name,)).fetchone()[0]
                tables.append((db, table_id, name, name.replace("_", " ").lower(), ddl))
                for _, column, declared, _, _, pk in con.execute(f"PRAGMA table_info({quoted(name)})"):
                    col_id += 1
                    columns.append((db, table_id, name, col_id, column, column.replace("_", " ").lower(), _kind(declared or ""), pk))
                    if pk == 1:
                        keys[name] = column
            for name in names:
                for r in con.execute(f"PRAGMA foreign_key_list({quoted(name)})"):
                    fks.append((db, name, r[3], r[2], r[4] or keys.get(r[2])))
        finally:
            con.close()
    return Catalog(
        spark.createDataFrame(tables, "db_id string, table_id int, table_name string, display string, ddl string"),
        spark.createDataFrame(columns, "db_id string, table_id int, table_name string, col_id int, column_name string, display string, type string, pk int"),
        spark.createDataFrame(fks, "db_id string, table_name string, source string, ref_table string, ref_column string"),
    )


def cells(spark: SparkSession, files: list[tuple[str, str]], frames: Catalog) -> DataFrame:
    """db_id, col_id, value: the distinct cells of all columns, as text; a task for each range of rowids of each table."""
    paths = spark.createDataFrame(files, "db_id string, path string")
    jobs = frames.columns.groupBy("db_id", "table_name").agg(F.collect_list(F.struct("col_id", "column_name")).alias("cols")).join(paths, "db_id")

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, table in zip(batch["path"], batch["table_name"], strict=True):
                own = sqlite_table.Reader(path, table, StructType(), sqlite_table.RANGE).partitions()
                yield pd.DataFrame({"path": path, "table_name": table, "low": pd.array([r.low for r in own], "Int64"), "high": pd.array([r.high for r in own], "Int64")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for job in batch.itertuples():
                con = connect(job.path)
                own = ("", ()) if pd.isna(job.low) else (" WHERE rowid BETWEEN ? AND ?", (int(job.low), int(job.high)))
                try:
                    for col in job.cols:
                        rows = con.execute(f"SELECT DISTINCT CAST({quoted(col['column_name'])} AS TEXT) FROM {quoted(job.table_name)}{own[0]}", own[1])
                        while part := rows.fetchmany(50_000):
                            yield pd.DataFrame({"db_id": job.db_id, "col_id": col["col_id"], "value": [r[0] for r in part]})
                finally:
                    con.close()

    n = max(1, frames.tables.count())
    found = stored(jobs.select("path", "table_name").distinct().repartition(n).mapInPandas(ranges, "path string, table_name string, low long, high long"), "ranges")
    dealt = jobs.join(found, ["path", "table_name"]).repartition(max(1, found.count()), "path", "table_name", "low")
    return dealt.mapInPandas(run, "db_id string, col_id int, value string").distinct()


def execute_query(path: str, queries: str | list[str]) -> list[tuple] | list[list[tuple]]:
    """All rows of a query on a database file, or of each of a list of queries; for the few rows of catalogs and checks."""
    if not isinstance(queries, str | list):
        raise TypeError(f"queries cannot be {type(queries)}")
    con = connect(path)
    try:
        return con.execute(queries).fetchall() if isinstance(queries, str) else [con.execute(q).fetchall() for q in queries]
    finally:
        con.close()


def frames(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A database's tables and views by name, each read by ranges of rowids."""
    return {name: sqlite_table.read(spark, path, name) for name in sqlite_table.table_names(path)}


def snapshot(spark: SparkSession, path: str) -> Callable[[SparkSession], dict[str, DataFrame]]:
    """What gives a database's tables to any session. At its first call they are written, once, as tables in the shared folder: candidates read the columns and row groups they need."""
    places: dict[str, str] = {}

    def tables(session: SparkSession) -> dict[str, DataFrame]:
        if not places:
            places.update({name: write(df, "sqlite") for name, df in frames(spark, path).items()})
        return {name: session.read.parquet(place) for name, place in places.items()}

    return tables


def register(spark: SparkSession, path: str) -> list[str]:
    """Temporary views of a database's tables, for running candidates; their names."""
    own = frames(spark, path)
    for name, df in own.items():
        df.createOrReplaceTempView(name)
    return list(own)
