"""Candidate execution and self-consistency voting.

Each distinct (database, candidate) runs once as a Spark query over registered views, a few at a
time; its result becomes a fingerprint: row and column counts, and a hash that equal bags of
rows share under any permutation of their columns. Votes are then plain aggregates.

Fingerprints need no collected rows. Columns get an order by colours that do not depend on
how they stand: first the bag of a column's cells, then, as long as this tells more columns
apart, the bag of its cells with the colours of their rows (a row's colour is the bag of its
cells with the colours of their columns). Columns that stay equal are swapped where a swap changes
nothing; where it does, each of them is tried first. The least hash over what is left is taken.
So results are told apart, or taken as one, by 64-bit hashes alone; no order is left out.

Candidates are written for SQLite: ``dialect`` rewrites them, so that a vote is over the results
that they have there. Each database has a session of its own, with its tables as views.

Only queries run: a candidate is parsed, and refused unless every part of its plan reads, and
reads nothing but tables of its database and what the statement itself names.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby, islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from querent.functions import dialect
from querent.functions.answers import before_comment, fixed_year, joined_operators, without_distinct
from querent.sources.stored import folder

#: Candidates that run at a time, and results that the driver holds before it writes them.
AT_ONCE, HELD = 4, 2000
#: Parts of a parsed plan that only read.
_READS = frozenset("""Aggregate Deduplicate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset
OneRowRelation Pivot Project Sample Sort SubqueryAlias Tail Union UnresolvedHaving UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases
UnresolvedWith Unpivot View Window WithWindowDefinition""".split())
#: Functions that call into the process.
_CALLS = re.compile(r"\b(java_method|reflect|try_reflect)\b", re.IGNORECASE)
RESULT = StructType([StructField("status", StringType()), StructField("n_rows", LongType()), StructField("n_cols", LongType()), StructField("fingerprint", StringType())])


def executable(sql: Column) -> Column:
    """A candidate as it is run: spaced operators joined, DISTINCT out, the current year fixed."""
    return fixed_year(without_distinct(joined_operators(sql)))


def tagged(cell: Column, kind: str) -> Column:
    """A cell as text under which equal values are equal: whole numbers of every type have all their digits, the rest is that of a double."""
    if kind in ("tinyint", "smallint", "int", "bigint", "boolean"):
        value = F.concat(F.lit("n"), (cell.cast("int") if kind == "boolean" else cell).cast("string"))
    elif kind in ("float", "double") or kind.startswith("decimal"):
        whole = cell.try_cast("decimal(38,0)").cast("string")
        value = F.concat(F.lit("n"), F.when(cell == F.floor(cell), whole).otherwise(cell.cast(DoubleType()).cast("string")))
        value = F.coalesce(value, F.concat(F.lit("n"), cell.cast(DoubleType()).cast("string")))
    else:
        value = F.concat(F.lit("s"), cell.cast("string"))
    return F.coalesce(value, F.lit("0"))


def _bag(*values: Column) -> Column:
    """An order-free hash of a bag: the sum of its members' hashes."""
    return F.coalesce(F.sum(F.xxhash64(*values).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")


class _Columns:
    """The columns of a result, and colours that do not depend on their order."""

    def __init__(self, cells: DataFrame):
        self.cells, self.names = cells, cells.columns

    def bags(self, values: dict[str, list[Column]]) -> dict[str, str]:
        return self.cells.agg(*(_bag(*v).alias(k) for k, v in values.items())).first().asDict()

    def refined(self, colours: dict[str, int]) -> dict[str, int]:
        """Colours as long as they tell more columns apart; equal ones stay equal under any order of the columns."""
        while len(set(colours.values())) < len(colours):
            row = F.xxhash64(F.array_sort(F.array(*(F.struct(F.lit(colours[c]).alias("k"), F.col(c).alias("v")) for c in self.names))))
            seen = self.bags({c: [row, F.col(c)] for c in self.names})
            keys = {c: (colours[c], seen[c]) for c in self.names}
            new = {c: sorted(set(keys.values())).index(keys[c]) for c in self.names}
            if len(set(new.values())) == len(set(colours.values())):
                break
            colours = new
        return colours

    def orders(self, colours: dict[str, int]) -> Iterator[list[str]]:
        """Orders of the columns by colours; of those that stay equal, each that a swap tells apart comes first once."""
        colours = self.refined(colours)
        by: dict[int, list[str]] = {}
        for c in self.names:
            by.setdefault(colours[c], []).append(c)
        tied = next((by[k] for k in sorted(by) if len(by[k]) > 1), None)
        if tied is None:
            yield sorted(self.names, key=colours.__getitem__)
            return
        swapped = {c: [tied[0] if x == c else c if x == tied[0] else x for x in self.names] for c in tied}
        bags = self.bags({c: [F.col(x) for x in order] for c, order in swapped.items()})
        for c in [tied[0], *(c for c in tied[1:] if bags[c] != bags[tied[0]])]:
            yield from self.orders({x: 2 * k + (k == colours[c] and x != c) for x, k in colours.items()})


def fingerprint(df: DataFrame, ordered: bool = False) -> tuple[int, int, str]:
    """(rows, columns, hash) of a result; all empty results share one hash. ordered: rows count with their places, columns still in any order."""
    cells = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    cells = cells.select(*(tagged(F.col(f.name), f.dataType.simpleString()).alias(f.name) for f in cells.schema.fields))
    n = len(cells.columns)
    held = [(_placed(cells) if ordered else cells).persist()]
    try:
        if ordered:
            held.append(_numbered(held[0]).persist())
        cells = held[-1]
        first = cells.agg(F.count(F.lit(1)).alias("n"), *(_bag(F.col(c)).alias(c) for c in cells.columns)).first()
        if not first["n"]:
            return 0, n, "empty"
        columns, kinds = _Columns(cells), sorted({first[c] for c in cells.columns})
        # a place is a colour of its own, so it stays where it is
        orders = list(columns.orders({c: -1 if c == "place" else kinds.index(first[c]) for c in cells.columns}))
        hashes = columns.bags({f"o{i}": [F.col(x) for x in order] for i, order in enumerate(orders)})
        return first["n"], n, min(hashes.values())
    finally:
        for x in held:
            x.unpersist()


def _placed(cells: DataFrame) -> DataFrame:
    return cells.withColumn("id", F.monotonically_increasing_id())


def _numbered(held: DataFrame) -> DataFrame:
    """place, gapless, in place of the id of a sorted frame: its partitions are in order, so places count within them and the rows of those before."""
    part = F.shiftright("id", 33)
    sizes = {r["part"]: r["n"] for r in held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a number for each partition
    before = [(p, sum(sizes[q] for q in sizes if q < p)) for p in sizes]
    own = F.broadcast(held.sparkSession.createDataFrame(before, "part long, before long"))
    place = F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before")
    return held.join(own, part == F.col("part")).withColumn("place", place.cast("string")).drop("id", "part", "before")


def reads_only(spark: SparkSession, sql: str, names: frozenset[str] | None = None) -> bool:
    """Whether a statement parses as a query of which every part reads, from tables of these names (lower case; None: any one-part name) and its own. Nothing is looked up or run."""
    if _CALLS.search(sql):
        return False

    def inner(node) -> list:
        sets = [node.children(), node.innerChildren()]
        return [x.apply(i) for x in sets for i in range(x.size()) if _is_plan(x.apply(i))]

    def reads(plan, own: frozenset[str]) -> bool:
        kind = plan.getClass().getSimpleName()
        if kind not in _READS:
            return False
        if kind == "UnresolvedRelation":
            parts = plan.multipartIdentifier()
            name = str(parts.apply(0)).lower()
            return parts.size() == 1 and (names is None or name in names or name in own)
        if kind == "UnresolvedWith":
            held = plan.cteRelations()
            own = own | {str(held.apply(i)._1()).lower() for i in range(held.size())}
        return all(reads(x, own) for x in inner(plan))

    def _is_plan(node) -> bool:
        return "plans.logical" in node.getClass().getName() or "catalyst.analysis" in node.getClass().getName()

    try:
        return reads(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), frozenset())
    except Exception:  # what does not parse does not run
        return False


#: Frames of a database by name, made on a session.
Tables = Callable[[SparkSession], dict[str, DataFrame]]


class Database:
    """A session of its own with the tables of a database as views."""

    def __init__(self, spark: SparkSession, tables: Tables | None):
        if tables is None:  # the views of the caller's session
            self.session, own = spark, {t.name: spark.table(t.name) for t in spark.catalog.listTables() if t.isTemporary}
        else:
            self.session = spark.newSession()
            for key, value in spark.conf.getAll.items():
                if key.startswith("spark.sql.") and self.session.conf.isModifiable(key):
                    self.session.conf.set(key, value)
            self.session.conf.set("spark.sql.ansi.enabled", "false")  # what is no number is NULL, as there
            own = tables(self.session)
            for name, df in own.items():
                df.createOrReplaceTempView(f"`{name.replace('`', '``')}`")
        self.names = dialect.names_of({name: df.dtypes for name, df in own.items()})

    def frame(self, sql: str, rewrite: bool = True) -> DataFrame | None:
        """The statement's result, None if it is no query over these tables."""
        try:
            text = dialect.to_spark(sql, self.names) if rewrite else sql
        except dialect.NotAQuery:
            return None
        return self.session.sql(text) if reads_only(self.session, text, self.names.tables) else None


def execute(spark: SparkSession, candidates: DataFrame, timeout_s: int = 60, tables: dict[str, Tables] | None = None, rewrite: bool = True) -> DataFrame:
    """(db_id, sql, status, n_rows, n_cols, fingerprint) for each distinct candidate (db_id, sql).

    Only single queries run; what fails or takes too long is a status, not an error. tables has the tables of each
    database, which gets a session; without it, candidates see the temporary views of this session. rewrite: statements are
    SQLite's. AT_ONCE run at a time; statements come to the driver one database after the other, never rows, and HELD
    results at a time go to a table in the shared folder.
    """
    schema = StructType([StructField("db_id", StringType()), StructField("sql", StringType()), *RESULT.fields])
    path = f"{folder(spark)}/results-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(path)
    spark.sparkContext.setInterruptOnCancel(True)
    rows = candidates.select("db_id", "sql", executable(F.col("sql")).alias("run")).distinct().orderBy("db_id", "sql").toLocalIterator()
    for db_id, own in groupby(rows, key=lambda r: r["db_id"]):
        if tables is not None and db_id not in tables:
            place = lambda _: {}
        else:
            place = None if tables is None else tables[db_id]
        database = Database(spark, place)
        with ThreadPoolExecutor(AT_ONCE) as pool:
            while part := list(islice(own, HELD)):
                done = list(pool.map(lambda r, on=database: (r["db_id"], r["sql"], *_run(on, r["run"], timeout_s, rewrite)), part))
                spark.createDataFrame(done, schema).coalesce(1).write.mode("append").parquet(path)
        if place is not None:
            for t in database.session.catalog.listTables():
                database.session.catalog.dropTempView(t.name)
    return spark.read.schema(schema).parquet(path)


def _run(database: Database, sql: str | None, timeout_s: int, rewrite: bool) -> tuple[str, int | None, int | None, str | None]:
    spark = database.session
    tag = f"candidate-{uuid.uuid4().hex}"
    timer = threading.Timer(timeout_s, lambda: spark.interruptTag(tag))
    spark.addTag(tag)
    timer.start()
    try:
        found = database.frame((sql or "").rstrip().rstrip(";"), rewrite)
        return ("ok", *fingerprint(found)) if found is not None else ("refused", None, None, None)
    except Exception as e:  # a model's statement may fail in any way
        return f"error: {type(e).__name__}", None, None, None
    finally:
        timer.cancel()
        spark.removeTag(tag)


def clusters(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """candidates (idx, db_id, cand_no, sql) that ran, with cluster (first candidate of equal results) and votes."""
    ok = candidates.join(results.where("status = 'ok'"), ["db_id", "sql"])
    same = Window.partitionBy("idx", "fingerprint", F.when(F.col("n_rows") > 0, F.col("n_cols")), "n_rows")
    return ok.select("idx", "db_id", "cand_no", "sql", F.min("cand_no").over(same).alias("cluster"), F.count(F.lit(1)).over(same).alias("votes"))


def winners(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """idx, db_id, sql, votes: the first candidate of the largest cluster (earliest on ties); the first of all, with 0 votes, if none ran."""
    voted = candidates.join(clusters(candidates, results).select("idx", "cand_no", "cluster", "votes"), ["idx", "cand_no"], "left")
    order = Window.partitionBy("idx").orderBy(F.coalesce("votes", F.lit(0)).desc(), F.coalesce("cluster", F.lit(1 << 30)), "cand_no")
    return voted.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("idx", "db_id", "sql", F.coalesce("votes", F.lit(0)).alias("votes"))


def first_candidates(answers: DataFrame, n: int) -> DataFrame:
    """idx, db_id, cand_no, sql of the first n of p_sqls, comments cut."""
    return answers.select("idx", "db_id", F.posexplode(F.slice("p_sqls", 1, n)).alias("cand_no", "sql")).withColumn("sql", before_comment(F.col("sql")))


def same_list(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, equal: whether two frames hold the same rows in the same order, under some order of their columns; 1 and 1.0 are equal, so are all empty results."""
    x, y = fingerprint(a, ordered=True), fingerprint(b, ordered=True)
    return a.sparkSession.createDataFrame([(x == y or x[0] == y[0] == 0,)], "equal boolean")


def same_bag(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, equal: whether two frames of equal column names hold the same bag of rows; signed counts, no collected rows."""
    cols = a.columns
    both = a.withColumn("_n", F.lit(1)).unionByName(b.select(*cols).withColumn("_n", F.lit(-1)))
    return both.groupBy(*cols).agg(F.sum("_n").alias("_n")).agg((F.coalesce(F.sum((F.col("_n") != 0).cast("long")), F.lit(0)) == 0).alias("equal"))
