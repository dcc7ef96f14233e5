"""SQLite tables as a Spark data source: ranges of rowids are partitions, columns and tests reach the database.

    spark.dataSource.register(SQLiteTable)
    spark.read.format("sqlite_table").options(path=..., table=...).load()

The driver asks for the columns and for the least and greatest rowid only; every task opens the
file, reads its own range and passes Arrow batches on, so a table of any size is never in one
process. Files must be reachable by path where tasks run. A table WITHOUT ROWID, or a view, is
one partition, still passed on in batches.

A view of fixed types holds a column's declared kind: whole numbers, doubles, truth values or
texts. Cells of another kind, which SQLite allows anywhere, are null there; text that is not
UTF-8 loses the broken bytes. ``read`` takes the columns that are wanted and tests on them; a
test is a first sieve in the database, where it cannot lose a row, and Spark applies it again.
(Spark's own push-down into Python sources is left alone: in 4.1.2 a frame keeps the filters
of one action for the next.)
"""

from __future__ import annotations

import json
import operator
import os
import sqlite3
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as S
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructType

#: Rowids of a partition, and rows of a batch.
RANGE, BATCH = 250_000, 8192


def connect(path: str) -> sqlite3.Connection:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    con.text_factory = lambda b: b.decode(errors="ignore")
    return con


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def spark_type(declared: str) -> str:
    """The type of a column as it is declared."""
    d = declared.lower()
    if "int" in d:
        return "bigint"
    if any(x in d for x in ("real", "floa", "doub", "num", "dec")):
        return "double"
    return "boolean" if "bool" in d else "string"


def columns(con: sqlite3.Connection, table: str) -> list[tuple[str, str, str]]:
    """(name, declared type, Spark type) of a table's columns."""
    return [(r[1], r[2] or "", spark_type(r[2] or "")) for r in con.execute(f"PRAGMA table_info({quoted(table)})")]


def whole(x: object) -> int | None:
    """A cell as a whole number of 64 bits; one that is none, a fraction among them, is null."""
    if isinstance(x, float):
        return int(x) if x.is_integer() and -(2**63) <= x < 2**63 else None
    return x if isinstance(x, int) else None


def real(x: object) -> float | None:
    return float(x) if isinstance(x, int | float) else None


def truth(x: object) -> bool | None:
    return bool(x) if isinstance(x, int | float) else None


def text(x: object) -> str | None:
    return x if x is None or isinstance(x, str) else x.decode(errors="ignore") if isinstance(x, bytes) else str(x)


_CELL = {"bigint": (whole, pa.int64()), "double": (real, pa.float64()), "boolean": (truth, pa.bool_()), "string": (text, pa.string())}
_TYPES = {"bigint": LongType(), "double": DoubleType(), "boolean": BooleanType(), "string": StringType()}
_TESTS = {"=": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "in": lambda column, values: column.isin(*values)}


def condition(column: str, operator: str, value: object, kinds: dict[str, tuple[str, str]]) -> tuple[str, list] | None:
    """SQLite text and values that hold for every row that a test keeps; None if that is not sure. kinds: (declared, Spark type) of each column."""
    if column not in kinds:
        return None
    name, (declared, kind) = quoted(column), kinds[column]
    # texts are compared as such only in a column that keeps them
    if kind == "boolean" or kind == "string" and not any(x in declared.lower() for x in ("char", "clob", "text")):
        return None
    values = list(value) if operator == "in" and isinstance(value, list | tuple) else [value]
    if not values or any(not isinstance(v, str if kind == "string" else int | float) or isinstance(v, bool) for v in values):
        return None
    if operator == "in":
        return (f"{name} IN ({', '.join('?' * len(values))})", values) if len(values) <= 500 else None
    return f"{name} {operator} ?", values


@dataclass
class Range(S.InputPartition):
    """Rowids from low to high, both included; the whole table if there are none."""

    low: int | None = None
    high: int | None = None


class Reader(S.DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, size: int, tests: Sequence[tuple[str, str, object]] = ()):
        self.path, self.table, self.schema, self.size = path, table, schema, size
        con = connect(path)
        try:
            kinds = {name: (declared, kind) for name, declared, kind in columns(con, table)}
        finally:
            con.close()
        self.conditions = [got for t in tests if (got := condition(*t, kinds))]

    def partitions(self) -> list[Range]:
        con = connect(self.path)
        try:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        except sqlite3.OperationalError:  # there are no rowids
            return [Range()]
        finally:
            con.close()
        if not isinstance(low, int) or not isinstance(high, int):
            return [Range()]
        return [Range(at, min(high, at + self.size - 1)) for at in range(low, high + 1, self.size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        names = self.schema.fieldNames()
        kinds = [_CELL[f.dataType.simpleString()] for f in self.schema.fields]
        own = [("rowid BETWEEN ? AND ?", [partition.low, partition.high])] if partition.low is not None else []
        tests = own + self.conditions
        where = " WHERE " + " AND ".join(t for t, _ in tests) if tests else ""
        con = connect(self.path)
        try:
            rows = con.execute(f"SELECT {', '.join(map(quoted, names)) or '1'} FROM {quoted(self.table)}{where}", [v for _, values in tests for v in values])
            while part := rows.fetchmany(BATCH):
                cells = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([f(x) for x in c], t) for c, (f, t) in zip(cells, kinds, strict=True)], names=names)
        finally:
            con.close()


class SQLiteTable(S.DataSource):
    """Options: path, table, rowids (those of a partition), and tests (a JSON array of [column, operator, value])."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        con = connect(self.options["path"])
        try:
            own = columns(con, self.options["table"])
        finally:
            con.close()
        if not own:
            raise ValueError(f"no table {self.options['table']}")
        out = StructType()
        for name, _, kind in own:
            out.add(name, _TYPES[kind])
        return out

    def reader(self, schema: StructType) -> Reader:
        tests = [tuple(x) for x in json.loads(self.options.get("tests", "[]"))]
        return Reader(self.options["path"], self.options["table"], schema, max(1, int(self.options.get("rowids", RANGE))), tests)


def read(spark: SparkSession, path: str, table: str, only: list[str] | None = None, tests: Sequence[tuple[str, str, object]] = (), rowids: int = RANGE) -> DataFrame:
    """A table of a database file; only: its columns that are read, in that order; tests: (column, operator, value) that all rows pass, operators =, >, >=, <, <= and in."""
    spark.dataSource.register(SQLiteTable)
    con = connect(path)
    try:
        kinds = {name: kind for name, _, kind in columns(con, table)}
    finally:
        con.close()
    more = [c for c, _, _ in tests if only is not None and c not in only]
    reader = spark.read.format("sqlite_table").options(path=path, table=table, rowids=rowids, tests=json.dumps(tests))
    if only is not None:
        reader = reader.schema(", ".join(f"`{c.replace('`', '``')}` {kinds[c]}" for c in dict.fromkeys([*only, *more])))
    df = reader.load()
    for column, test, value in tests:
        df = df.where(_TESTS[test](df[f"`{column.replace('`', '``')}`"], value))
    return df.select(*(f"`{c.replace('`', '``')}`" for c in only)) if more else df


def table_names(path: str) -> list[str]:
    con = connect(path)
    try:
        return [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite~_%' ESCAPE '~' ORDER BY rowid")]
    finally:
        con.close()
