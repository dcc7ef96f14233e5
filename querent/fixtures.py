"""Stand-ins, on the fixture tables, for the relations of a text-to-SQL dataset.

Each comes as a DataFrame and as the DuckDB text of the same relation, made from one list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querent.sources.catalog import Catalog, of_frames

DB = "shop"
WEB = "web"
#: db_id, table, display, columns (name, display, type, place in the key)
TABLES = [
    (DB, "region", "region", [("r_regionkey", "region key", "number", 1), ("r_name", "name", "text", 0)]),
    (DB, "nation", "nation", [("n_nationkey", "nation key", "number", 1), ("n_name", "name", "text", 0), ("n_regionkey", "region key", "number", 0)]),
    (DB, "customer", "customer", [("c_custkey", "customer key", "number", 1), ("c_name", "name", "text", 0), ("c_nationkey", "nation key", "number", 0), ("c_acctbal", "account balance", "number", 0), ("c_mktsegment", "market segment", "text", 0)]),
    (DB, "part", "part", [("p_partkey", "part key", "number", 1), ("p_name", "name", "text", 0), ("p_brand", "brand", "text", 0), ("p_type", "type", "text", 0), ("p_size", "size", "number", 0), ("p_retailprice", "retail price", "number", 0)]),
    (DB, "orders", "order", [("o_orderkey", "order key", "number", 1), ("o_custkey", "customer key", "number", 0), ("o_orderstatus", "status", "text", 0), ("o_totalprice", "total price", "number", 0), ("o_orderdate", "order date", "time", 0), ("o_orderpriority", "priority", "text", 0)]),
    (DB, "lineitem", "line item", [("l_orderkey", "order key", "number", 1), ("l_linenumber", "line number", "number", 2), ("l_partkey", "part key", "number", 0), ("l_quantity", "quantity", "number", 0), ("l_shipdate", "ship date", "time", 0)]),
    (WEB, "events", "event", [("event_id", "event id", "number", 1), ("user_id", "user id", "number", 0), ("event_type", "event type", "text", 0), ("value", "value", "number", 0), ("ts", "time", "time", 0)]),
]
FOREIGN_KEYS = [
    (DB, "nation", "n_regionkey", "region", "r_regionkey"),
    (DB, "customer", "c_nationkey", "nation", "n_nationkey"),
    (DB, "orders", "o_custkey", "customer", "c_custkey"),
    (DB, "lineitem", "l_orderkey", "orders", "o_orderkey"),
    (DB, "lineitem", "l_partkey", "part", "p_partkey"),
]


def _rows() -> tuple[list[tuple], list[tuple]]:
    tables, columns = [], []
    for db in (DB, WEB):
        col_id = 0
        for table_id, (_, name, display, cols) in enumerate(t for t in TABLES if t[0] == db):
            tables.append((db, table_id, name, display))
            for c, d, kind, pk in cols:
                col_id += 1
                columns.append((db, table_id, name, col_id, c, d, kind, pk))
    return tables, columns


TABLE_ROWS, COLUMN_ROWS = _rows()


def _values(rows: list[tuple], names: str) -> str:
    text = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {text}) AS v({names}))"


TABLES_SQL = _values(TABLE_ROWS, "db_id, table_id, table_name, display")
COLUMNS_SQL = _values(COLUMN_ROWS, "db_id, table_id, table_name, col_id, column_name, display, type, pk")
FOREIGN_KEYS_SQL = _values(FOREIGN_KEYS, "db_id, table_name, source, ref_table, ref_column")


def catalog(spark: SparkSession) -> Catalog:
    tables = spark.createDataFrame(TABLE_ROWS, "db_id string, table_id int, table_name string, display string")
    columns = spark.createDataFrame(COLUMN_ROWS, "db_id string, table_id int, table_name string, col_id int, column_name string, display string, type string, pk int")
    return of_frames(tables, columns, spark.createDataFrame(FOREIGN_KEYS, "db_id string, table_name string, source string, ref_table string, ref_column string"))


def raw_databases(spark: SparkSession) -> DataFrame:
    """The first database as a row of a tables.json file."""
    own = [t for t in TABLES if t[0] == DB]
    columns = [["-1", "*"], *([str(i), c[0]] for i, t in enumerate(own) for c in t[3])]
    place = {name: i for i, (_, name) in enumerate(columns)}
    keys = [[place[source], place[ref]] for _, _, source, _, ref in FOREIGN_KEYS]
    return spark.createDataFrame([(DB, [t[1] for t in own], columns, keys)], "db_id string, table_names_original array<string>, column_names_original array<array<string>>, foreign_keys array<array<int>>")


#: A database for each region: its nations are tables, their suppliers columns, each nation's first one a key that refers to the region's first.
TRADE_COLUMNS_SQL = "(SELECT r_name AS db_id, CAST(dense_rank() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1 AS INTEGER) AS table_id, n_name AS table_name, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey, s_suppkey) AS INTEGER) AS col_id, s_name AS column_name, lower(s_name) AS display, ['number', 'text', 'time', 'boolean'][CAST(s_suppkey % 4 + 1 AS INTEGER)] AS type, CAST(CASE WHEN row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) = 1 THEN 1 ELSE 0 END AS INTEGER) AS pk FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"
TRADE_KEYS_SQL = f"(SELECT a.db_id, a.table_name, a.column_name AS source, b.table_name AS ref_table, b.column_name AS ref_column FROM {TRADE_COLUMNS_SQL} a JOIN {TRADE_COLUMNS_SQL} b ON b.db_id = a.db_id AND b.col_id = 1 AND a.pk = 1 AND a.table_id > 0)"
TRADE_TABLES_SQL = f"(SELECT DISTINCT db_id, table_id, table_name, lower(table_name) AS display FROM {TRADE_COLUMNS_SQL})"


def widened(sql: str) -> str:
    """An oracle over the catalog, over the databases of the trade too."""
    for own, more in ((TABLES_SQL, TRADE_TABLES_SQL), (COLUMNS_SQL, TRADE_COLUMNS_SQL), (FOREIGN_KEYS_SQL, TRADE_KEYS_SQL)):
        sql = sql.replace(own, f"(SELECT * FROM {own} UNION ALL SELECT * FROM {more})")
    return sql


def _trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Columns and foreign keys of the trade's databases."""
    supplier, nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation", "region"))
    rows = supplier.join(nation, F.col("n_nationkey") == F.col("s_nationkey")).join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    by = Window.partitionBy("r_name")
    table_id, col_id = F.dense_rank().over(by.orderBy("n_nationkey")) - 1, F.row_number().over(by.orderBy("n_nationkey", "s_suppkey"))
    kind = F.element_at(F.array(*map(F.lit, ("number", "text", "time", "boolean"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    pk = F.when(F.row_number().over(Window.partitionBy("n_nationkey").orderBy("s_suppkey")) == 1, 1).otherwise(0)
    columns = rows.select(F.col("r_name").alias("db_id"), table_id.alias("table_id"), F.col("n_name").alias("table_name"), col_id.alias("col_id"), F.col("s_name").alias("column_name"), F.lower("s_name").alias("display"), kind.alias("type"), pk.alias("pk"))
    first = columns.where("col_id = 1").select("db_id", F.col("table_name").alias("ref_table"), F.col("column_name").alias("ref_column"))
    keys = columns.where("pk = 1 and table_id > 0").join(first, "db_id").select("db_id", "table_name", F.col("column_name").alias("source"), "ref_table", "ref_column")
    return columns, keys


def wide_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalog, with the databases of the trade."""
    own, (columns, keys) = catalog(spark), _trade(spark, sf_dir)
    tables = columns.select("db_id", "table_id", "table_name", F.lower("table_name").alias("display")).distinct()
    return of_frames(own.tables.drop("ddl").unionByName(tables), own.columns.unionByName(columns), own.foreign_keys.union(keys))


def raw_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The databases of the trade as rows of a tables.json file."""
    columns, keys = _trade(spark, sf_dir)
    names = columns.groupBy("db_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("table_id", "table_name"))), lambda x: x["table_name"]).alias("table_names_original"), F.transform(F.array_sort(F.collect_list(F.struct("col_id", F.array(F.col("table_id").cast("string"), F.col("column_name")).alias("c")))), lambda x: x["c"]).alias("c"))
    ids = columns.select("db_id", F.col("column_name").alias("source"), "col_id")
    pairs = keys.join(ids, ["db_id", "source"]).groupBy("db_id").agg(F.transform(F.sort_array(F.collect_list("col_id")), lambda x: F.array(x, F.lit(1))).alias("foreign_keys"))
    star = F.array(F.array(F.lit("-1"), F.lit("*")))
    return names.join(pairs, "db_id", "left").select("db_id", "table_names_original", F.concat(star, "c").alias("column_names_original"), F.coalesce("foreign_keys", F.array().cast("array<array<int>>")).alias("foreign_keys"))


#: Query log: text, normal form and skeleton, the last two derived by hand.
LOG = [
    ("SELECT p_name FROM part WHERE p_size > 10;", "select p_name from part where p_size > 10", "select _ from _ where _"),
    ("SELECT T1.c_name, T2.o_totalprice FROM customer AS T1 JOIN orders AS T2 ON T1.c_custkey = T2.o_custkey", "select customer.c_name , orders.o_totalprice from customer join orders on customer.c_custkey = orders.o_custkey", "select _ from _ "),
    ("SELECT count(*) FROM lineitem WHERE l_quantity >= 5 AND l_partkey = 7", "select count ( * ) from lineitem where l_quantity >= 5 and l_partkey = 7", "select count ( _ ) from _ where _"),
    ('SELECT n_name FROM nation WHERE n_name = "Nation A" ORDER BY n_name', "select n_name from nation where n_name = 'Nation A' order by n_name asc", "select _ from _ where _ order by _ asc"),
    ("SELECT p_brand, count(*) FROM part GROUP BY p_brand ORDER BY count(*) DESC LIMIT 3", "select p_brand , count ( * ) from part group by p_brand order by count ( * ) desc limit 3", "select _ , count ( _ ) from _ group by _ order by _ ( _ ) desc limit _"),
    ("SELECT DISTINCT o_orderstatus FROM orders WHERE o_totalprice < -1.5 OR o_orderkey != 3", "select distinct o_orderstatus from orders where o_totalprice < -1.5 or o_orderkey != 3", "select distinct _ from _ where _"),
    ("SELECT r_name AS label FROM region", "select r_name from region", "select _ from _"),
    ("SELECT t1.p_name FROM part AS t1 JOIN lineitem AS t2 ON t1.p_partkey = t2.l_partkey WHERE t2.l_quantity <= 2", "select part.p_name from part join lineitem on part.p_partkey = lineitem.l_partkey where lineitem.l_quantity <= 2", "select _ from _ where _"),
]
LOG_SQL = _values([(i, q.replace("'", "''"), n.replace("'", "''"), s) for i, (q, n, s) in enumerate(LOG)], "k, query, normal, skel")

#: Two tables, a column of each, and the columns that join them.
_JOINED = [
    ("customer", "orders", "c_name", "o_totalprice", "c_custkey", "o_custkey"),
    ("nation", "customer", "n_name", "c_acctbal", "n_nationkey", "c_nationkey"),
    ("region", "nation", "r_name", "n_nationkey", "r_regionkey", "n_regionkey"),
    ("part", "lineitem", "p_name", "l_quantity", "p_partkey", "l_partkey"),
]
#: Statement, normal form and skeleton, the last two by hand: aliases of one side only, comma joins, subqueries, doubled quotes.
_FORMS = [
    ("SELECT {a} FROM {t} JOIN {u} AS T2 ON {t}.{x} = T2.{y}", "select {a} from {t} join {u} on {t}.{x} = {u}.{y}", "select _ from _ "),
    ("SELECT p.{a}, q.{b} FROM {t} AS p , {u} AS q WHERE p.{x} = q.{y}", "select {t}.{a} , {u}.{b} from {t} , {u} where {t}.{x} = {u}.{y}", "select _ from _ where _"),
    ("SELECT {a} FROM {t} WHERE {a} = 'it''s'", "select {a} from {t} where {a} = 'it''s'", "select _ from _ where _"),
    ("SELECT q.{a} FROM {t} q WHERE q.{x} IN (SELECT r.{y} FROM {u} r WHERE r.{b} > 5)", "select {t}.{a} from {t} where {t}.{x} in ( select {u}.{y} from {u} where {u}.{b} > 5 )", "select _ from _ where _ in ( select _ from _ where _ )"),
    ("SELECT T1.{a} FROM {t} T1 LEFT JOIN {u} T2 ON T1.{x} = T2.{y} AND T2.{b} > 1", "select {t}.{a} from {t} left join {u} on {t}.{x} = {u}.{y} and {u}.{b} > 1", "select _ from _ left join _ and _"),
    ("SELECT count(DISTINCT {a}) AS n FROM {t} GROUP BY {x} HAVING count(*) > 2", "select count ( distinct {a} ) from {t} group by {x} having count ( * ) > 2", "select count ( distinct _ ) from _ group by _ having count ( _ ) > _"),
    ("SELECT {a} FROM {t} UNION SELECT {b} FROM {u} ORDER BY 1", "select {a} from {t} union select {b} from {u} order by 1 asc", "select _ from _ union select _ from _ order by _ asc"),
    ("SELECT {b} FROM {u} WHERE {b} BETWEEN 1 AND 2.5 OR {y} = -3", "select {b} from {u} where {b} between 1 and 2.5 or {y} = -3", "select _ from _ where _ between _ and _ or _"),
    ('SELECT {a} FROM {t} WHERE {a} LIKE "%X%" AND {x} <> 4', "select {a} from {t} where {a} like '%X%' and {x} <> 4", "select _ from _ where _ like _ and _ <> _"),
    ("SELECT T1.* FROM {t} AS T1 ORDER BY T1.{x} + 1 , T1.{a}", "select {t}.* from {t} order by {t}.{x} + 1 asc , {t}.{a}", "select _ from _ order by _ + _ asc , _"),
    ("SELECT max({b}) - min({b}) FROM {u};", "select max ( {b} ) - min ( {b} ) from {u}", "select max ( _ ) - min ( _ ) from _"),
    ("SELECT i.{a} FROM {t} AS i JOIN {u} AS j ON i.{x} = j.{y} JOIN {t} AS k ON k.{x} = j.{y}", "select {t}.{a} from {t} join {u} on {t}.{x} = {u}.{y} join {t} on {t}.{x} = {u}.{y}", "select _ from _ "),
    ("SELECT s.n FROM (SELECT {a} AS n FROM {t}) AS s", "select s.n from ( select {a} from {t} )", "select s.n from ( select _ from _ )"),
    ("SELECT {a} FROM {t} WHERE {x} >= 1 AND {x} <= 9 AND {a} != 'b' LIMIT 5", "select {a} from {t} where {x} >= 1 and {x} <= 9 and {a} != 'b' limit 5", "select _ from _ where _ limit _"),
    ("SELECT {a} , {x} FROM {t} WHERE NOT EXISTS (SELECT * FROM {u} WHERE {u}.{y} = {t}.{x})", "select {a} , {x} from {t} where not exists ( select * from {u} where {u}.{y} = {t}.{x} )", "select _ from _ where not exists ( select _ from _ where _ )"),
    ("SELECT T2.{b} FROM {t} , {u} T2 WHERE T2.{y} = 1", "select {u}.{b} from {t} , {u} where {u}.{y} = 1", "select _ from _ where _"),
]
#: The whole log: 72 statements.
STATEMENTS = LOG + [tuple(x.format(**dict(zip("tuabxy", own, strict=True))) for x in form) for form in _FORMS for own in _JOINED]
STATEMENTS_SQL = _values([(i, q.replace("'", "''"), n.replace("'", "''"), s) for i, (q, n, s) in enumerate(STATEMENTS)], "k, query, normal, skel")


def statements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(STATEMENTS)], "k int, query string")


def log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(LOG)], "k int, query string, normal string, skel string")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, db_id, question, toks: a question on each part, with its name, type and size."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.concat(F.lit("what is the retail price of part "), F.col("p_name"), F.lit(" with type "), F.lower("p_type"), F.lit(" and size "), F.col("p_size").cast("string"), F.lit(" ?"))
    return part.select(F.col("p_partkey").alias("idx"), F.lit(DB).alias("db_id"), text.alias("question")).withColumn("toks", F.split("question", " "))


QUESTIONS_SQL = f"(SELECT idx, db_id, question, string_split(question, ' ') AS toks FROM (SELECT p_partkey AS idx, '{DB}' AS db_id, 'what is the retail price of part ' || p_name || ' with type ' || lower(p_type) || ' and size ' || CAST(p_size AS VARCHAR) || ' ?' AS question FROM part))"

#: Columns whose cells are linked: table, column.
CELL_COLUMNS = [("region", "r_name"), ("nation", "n_name"), ("customer", "c_mktsegment"), ("part", "p_name"), ("part", "p_brand"), ("part", "p_type"), ("orders", "o_orderpriority")]
_IDS = {(t, c): i for _, _, t, i, c, *_ in COLUMN_ROWS}


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """db_id, col_id, value of every cell of the linked columns."""
    out = None
    for t, c in CELL_COLUMNS:
        one = spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.lit(DB).alias("db_id"), F.lit(_IDS[t, c]).alias("col_id"), F.col(c).alias("value"))
        out = one if out is None else out.union(one)
    return out


CELLS_SQL = "(" + " UNION ALL ".join(f"SELECT '{DB}' AS db_id, {_IDS[t, c]} AS col_id, {c} AS value FROM {t}" for t, c in CELL_COLUMNS) + ")"


def vectors(spark: SparkSession, sf_dir: str, masked: bool = False) -> DataFrame:
    """Pool of solved questions: idx, db_id, question, vector, query, skeleton, pre_skeleton. Masked questions have another vector: the first half."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = F.slice("embedding", 1, 32) if masked else F.col("embedding")
    base = e.select(F.col("vec_id").alias("idx"), F.col("label").cast("string").alias("db_id"), F.concat(F.lit("question "), (F.col("vec_id") % 97).cast("string")).alias("question"), v.alias("vector"), (F.col("vec_id") % 8).cast("int").alias("k"), ((F.col("vec_id") * 3 + 1) % 8).cast("int").alias("k2"))
    own = log(spark)
    first, second = own.select("k", "query", F.col("skel").alias("skeleton")), own.select(F.col("k").alias("k2"), F.col("skel").alias("pre_skeleton"))
    return base.join(F.broadcast(first), "k").join(F.broadcast(second), "k2").drop("k", "k2")


def targets(pool: DataFrame) -> DataFrame:
    """The stated set of questions to solve: every 25th."""
    return pool.where(F.col("idx") % 25 == 0)


def vectors_sql(masked: bool = False) -> str:
    v = "embedding[1:32]" if masked else "embedding"
    return f"(SELECT vec_id AS idx, CAST(label AS VARCHAR) AS db_id, 'question ' || CAST(vec_id % 97 AS VARCHAR) AS question, CAST({v} AS DOUBLE[]) AS vector, a.query, a.skel AS skeleton, b.skel AS pre_skeleton FROM embeddings JOIN {LOG_SQL} a ON a.k = vec_id % 8 JOIN {LOG_SQL} b ON b.k = (vec_id * 3 + 1) % 8)"
