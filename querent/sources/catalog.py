"""Schema catalogs as three frames: tables, columns and foreign keys.

tables: db_id, table_id, table_name, display, ddl
columns: db_id, table_id, table_name, col_id, column_name, display, type, pk (place in the primary key, 0: none)
foreign_keys: db_id, table_name, source, ref_table, ref_column

col_id counts over the database from 1; 0 is `*`, which no frame holds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.sources.files import exists


@dataclass(frozen=True)
class Catalog:
    tables: DataFrame
    columns: DataFrame
    foreign_keys: DataFrame

    def kept(self) -> Catalog:
        """The same frames, each computed once while they stay in memory; what an executor loses is read anew."""
        return Catalog(self.tables.persist(), self.columns.persist(), self.foreign_keys.persist())

    def per_database(self) -> DataFrame:
        """db_id, tables (in order: name, columns, ddl), fks (`a=b` texts in order), table_names, column_names (both lower-case)."""
        columns = self.columns.groupBy("db_id", "table_id").agg(F.array_sort(F.collect_list(F.struct("col_id", "column_name"))).alias("c"))
        tables = self.tables.join(columns, ["db_id", "table_id"], "left").withColumn("columns", F.coalesce(F.transform("c", lambda x: x["column_name"]), F.array().cast("array<string>")))
        tables = tables.groupBy("db_id").agg(F.array_sort(F.collect_list(F.struct("table_id", "table_name", "columns", "ddl"))).alias("tables"))
        order = self.tables.select("db_id", "table_id", "table_name")
        fks = foreign_key_pairs(self.foreign_keys).join(order, ["db_id", "table_name"]).groupBy("db_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("table_id", "source", "pair"))), lambda x: x["pair"]).alias("fks"))
        out = tables.join(fks, "db_id", "left").withColumn("fks", F.coalesce("fks", F.array().cast("array<string>")))
        names = F.transform("tables", lambda t: F.lower(t["table_name"]))
        cols = F.flatten(F.transform("tables", lambda t: F.transform(t["columns"], lambda c: F.lower(c))))
        return out.withColumns({"table_names": names, "column_names": cols})


def foreign_key_pairs(foreign_keys: DataFrame) -> DataFrame:
    """db_id, table_name, source, text (`(t.source, r.column)`) and pair (`t.source=r.column`) of each foreign key."""
    left, right = F.concat_ws(".", "table_name", "source"), F.concat_ws(".", "ref_table", "ref_column")
    return foreign_keys.select("db_id", "table_name", "source", F.concat(F.lit("("), left, F.lit(", "), right, F.lit(")")).alias("text"), F.concat_ws("=", left, right).alias("pair"))


def ddl(columns: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """db_id, table_id, table_name, ddl: a CREATE TABLE text for each table, from its columns and keys."""
    kinds = {"number": "REAL", "time": "TIMESTAMP", "boolean": "BOOLEAN"}
    kind: Column = F.lit("TEXT")
    for name, sql in kinds.items():
        kind = F.when(F.col("type") == name, F.lit(sql)).otherwise(kind)
    line = F.concat(F.lit("  "), F.col("column_name"), F.lit(" "), kind)
    own = columns.groupBy("db_id", "table_id", "table_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("col_id", line.alias("line")))), lambda x: x["line"]).alias("lines"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("pk") > 0, F.struct("pk", "column_name")))), lambda x: x["column_name"]).alias("pks"),
    )
    ref = F.concat(F.lit("  FOREIGN KEY ("), F.col("source"), F.lit(") REFERENCES "), F.col("ref_table"), F.lit("("), F.col("ref_column"), F.lit(")"))
    refs = foreign_keys.groupBy("db_id", "table_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("source", ref.alias("ref")))), lambda x: x["ref"]).alias("refs"))
    none = F.array().cast("array<string>")
    pk = F.when(F.size("pks") > 0, F.array(F.concat(F.lit("  PRIMARY KEY ("), F.array_join("pks", ", "), F.lit(")")))).otherwise(none)
    body = F.array_join(F.concat(F.col("lines"), pk, F.coalesce("refs", none)), ",\n")
    return own.join(refs, ["db_id", "table_name"], "left").select("db_id", "table_id", "table_name", F.concat(F.lit("CREATE TABLE "), F.col("table_name"), F.lit(" (\n"), body, F.lit("\n)")).alias("ddl"))


def of_frames(tables: DataFrame, columns: DataFrame, foreign_keys: DataFrame) -> Catalog:
    """A catalog with generated DDL."""
    return Catalog(tables.drop("ddl").join(ddl(columns, foreign_keys).drop("table_name"), ["db_id", "table_id"], "left"), columns, foreign_keys)


def snapshot(spark: SparkSession, key: str, root: str, make: Callable[[], Catalog]) -> Catalog:
    """The catalog that is stored under root for a key of its sources' contents; made and stored if there is none.

    Later uses, those of other sessions too, read what is stored. What a stopped run left unfinished is written anew.
    """
    place, frames = f"{root}/catalog-{key}", ("tables", "columns", "foreign_keys")
    if not exists(spark, f"{place}/{frames[-1]}/_SUCCESS"):
        made = make()
        for name in frames:
            getattr(made, name).write.mode("overwrite").parquet(f"{place}/{name}")
    return Catalog(*(spark.read.parquet(f"{place}/{name}") for name in frames))


TABLES_JSON = (
    "array<struct<db_id:string,table_names:array<string>,table_names_original:array<string>,column_names:array<array<string>>,"
    "column_names_original:array<array<string>>,column_types:array<string>,primary_keys:string,foreign_keys:array<array<int>>>>"
)


def read_tables_json(spark: SparkSession, path: str) -> Catalog:
    """Catalog of a tables.json file: one array of databases with names, types and keys by column position.

    A primary key is a column or a list of columns (a composite key). Names of one table or column may be null.
    """
    raw = read_databases(spark, path)
    tables = raw.select("db_id", F.posexplode(F.arrays_zip("table_names_original", "table_names")).alias("table_id", "t")).select("db_id", "table_id", F.col("t.table_names_original").alias("table_name"), F.col("t.table_names").alias("display"))
    # a composite key's columns count from 1; single keys have place 1
    keys = raw.select("db_id", F.explode(F.from_json("primary_keys", "array<string>")).alias("k"))
    keys = keys.select("db_id", F.posexplode(F.when(F.col("k").startswith("["), F.from_json("k", "array<int>")).otherwise(F.array(F.try_to_number("k", F.lit("999999999")).cast("int")))).alias("place", "col_id")).select("db_id", "col_id", (F.col("place") + 1).alias("pk"))
    columns = raw.select("db_id", F.posexplode(F.arrays_zip("column_names_original", "column_names", "column_types")).alias("col_id", "c"))
    columns = columns.select("db_id", F.col("c.column_names_original")[0].cast("int").alias("table_id"), "col_id", F.col("c.column_names_original")[1].alias("column_name"), F.col("c.column_names")[1].alias("display"), F.col("c.column_types").alias("type")).where("table_id >= 0")
    columns = columns.join(tables.select("db_id", "table_id", "table_name"), ["db_id", "table_id"]).join(keys, ["db_id", "col_id"], "left").withColumn("pk", F.coalesce("pk", F.lit(0)))
    columns = columns.select("db_id", "table_id", "table_name", "col_id", "column_name", "display", "type", "pk")
    pairs = raw.select("db_id", F.explode("foreign_keys").alias("p")).select("db_id", F.col("p")[0].alias("s"), F.col("p")[1].alias("r"))
    named = columns.select("db_id", "col_id", "table_name", "column_name")
    source, ref = named.toDF("db_id", "s", "table_name", "source"), named.toDF("db_id", "r", "ref_table", "ref_column")
    fks = pairs.join(source, ["db_id", "s"]).join(ref, ["db_id", "r"]).select("db_id", "table_name", "source", "ref_table", "ref_column")
    return of_frames(tables, columns, fks)


def read_databases(spark: SparkSession, path: str) -> DataFrame:
    """A tables.json file as it is: a row for each database."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", TABLES_JSON)).alias("d")).select("d.*")


def key_sets(databases: DataFrame) -> DataFrame:
    """db_id, column, representative (`__table.column__`) of the columns in foreign keys, from db_id, table_names_original, column_names_original, foreign_keys.

    Keys join a set in file order: the first that has either column, else a new one. Sets are not merged later; of a
    column in two sets, the later one counts. The representative is the set's first column.
    """

    def step(sets: Column, pair: Column) -> Column:
        at = F.array_position(F.transform(sets, lambda s: F.arrays_overlap(s, pair)), True)
        grown = F.transform(sets, lambda s, i: F.when(i + 1 == at, F.array_union(s, pair)).otherwise(s))
        return F.when(at > 0, grown).otherwise(F.concat(sets, F.array(F.array_distinct(pair))))

    none = F.array().cast("array<array<int>>")
    name = F.transform("column_names_original", lambda c: F.when(c[0].cast("int") >= 0, F.concat(F.lit("__"), F.lower(F.element_at("table_names_original", c[0].cast("int") + 1)), F.lit("."), F.lower(c[1]), F.lit("__"))).otherwise("__all__"))
    grouped = databases.select("db_id", name.alias("names"), F.posexplode(F.aggregate("foreign_keys", none, step)).alias("place", "set"))
    members = grouped.select("db_id", "names", "place", F.array_min("set").alias("least"), F.explode("set").alias("col_id"))
    named = members.groupBy("db_id", "col_id").agg(F.max_by(F.struct("names", "least"), "place").alias("m"))
    pick = lambda i: F.element_at("m.names", i + 1)
    return named.select("db_id", pick(F.col("col_id")).alias("column"), pick(F.col("m.least")).alias("representative"))


def preprocessed(catalog: Catalog) -> DataFrame:
    """One row a database: column_to_table, table_to_columns, table_bounds, primary_keys, foreign_keys, foreign_keys_tables, typed_columns.

    table_bounds holds the first column of each table and, last, one more than the last column. A table without columns has no bound.
    """
    c = catalog.columns
    by_table = c.groupBy("db_id", "table_id").agg(F.sort_array(F.collect_list("col_id")).alias("cols"), F.min("col_id").alias("first"))
    tables = by_table.groupBy("db_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("table_id", "cols")))).alias("table_to_columns"),
        F.transform(F.array_sort(F.collect_list(F.struct("table_id", "first"))), lambda x: x["first"]).alias("firsts"),
    )
    columns = c.groupBy("db_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("col_id", "table_id")))).alias("column_to_table"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("pk") > 0, F.struct("table_id", "pk", "col_id")))), lambda x: x["col_id"]).alias("primary_keys"),
        (F.max("col_id") + 1).alias("total"),
        F.transform(F.array_sort(F.collect_list(F.struct("col_id", F.concat(F.array(F.concat(F.lit("<type: "), F.col("type"), F.lit(">"))), F.split("display", " ")).alias("toks")))), lambda x: x["toks"]).alias("typed_columns"),
    )
    ids = c.select("db_id", "table_name", "column_name", "col_id", "table_id")
    edges = catalog.foreign_keys.join(ids.toDF("db_id", "table_name", "source", "s", "st"), ["db_id", "table_name", "source"]).join(ids.toDF("db_id", "ref_table", "ref_column", "r", "rt"), ["db_id", "ref_table", "ref_column"])
    fks = edges.groupBy("db_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("s", "r")))).alias("foreign_keys"))
    reach = edges.groupBy("db_id", "st").agg(F.sort_array(F.collect_set("rt")).alias("to")).groupBy("db_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("st", "to")))).alias("foreign_keys_tables"))
    out = tables.join(columns, "db_id").join(fks, "db_id", "left").join(reach, "db_id", "left")
    return out.select("db_id", "column_to_table", "table_to_columns", F.concat("firsts", F.array("total")).alias("table_bounds"), "primary_keys", "foreign_keys", "foreign_keys_tables", "typed_columns")
