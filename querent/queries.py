"""Queries on the fixture tables, one for each operator, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querent import fixtures as X
from querent.functions import answers, similarity, sql_text
from querent.operators import linking, metrics, nearest, prompts, relations, selection, similarity_join, skew, voting
from querent.plans import dataset, hooks, lemmas, llm_client
from querent.sources import catalog as catalogs
from querent.sources import files, sinks
from querent.sources.stored import folder, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
K = 9


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- similarity ---------------------------------------------------------------------------


def _jac(a: str, b: str) -> str:
    """DuckDB text of the multiset Jaccard similarity of two strings."""
    x, y = (rf"string_split(regexp_replace({v}, '^\s+|\s+$', '', 'g'), ' ')" for v in (a, b))
    both = f"coalesce(list_sum(list_transform(list_distinct({x}), lambda t: least(len(list_filter({x}, lambda v: v = t)), len(list_filter({y}, lambda v: v = t))))), 0)"
    return f"(CAST({both} AS DOUBLE) / (len({x}) + len({y}) - {both}))"


@query("jaccard_multiset", f"SELECT a.k AS a, b.k AS b, round({_jac('a.query', 'b.query')}, 6) AS sim FROM {X.LOG_SQL} a, {X.LOG_SQL} b UNION ALL SELECT CAST(100 + conv_id AS INTEGER), CAST(turn AS INTEGER), round({_jac('text', 'role')}, 6) FROM conversations")
def jaccard_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = X.log(spark).select(F.col("k").alias("a"), F.col("query").alias("qa"))
    b = X.log(spark).select(F.col("k").alias("b"), F.col("query").alias("qb"))
    sim = lambda x, y: F.round(similarity.jaccard_multiset(F.col(x), F.col(y)), 6).alias("sim")
    talk = _table(spark, sf_dir, "conversations").select((F.col("conv_id") + 100).cast("int"), F.col("turn").cast("int"), sim("text", "role"))
    return a.join(F.broadcast(b)).select("a", "b", sim("qa", "qb")).union(talk)


# --- SQL text -----------------------------------------------------------------------------


def _logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % len(X.STATEMENTS)).cast("int").alias("k"))
    return rows.join(F.broadcast(X.statements(spark)), "k")


_LOGGED = f"embeddings JOIN {X.STATEMENTS_SQL} ON k = vec_id % {len(X.STATEMENTS)}"


@query("sql_normalize", f"SELECT vec_id, normal FROM {_LOGGED}")
def sql_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logged(spark, sf_dir).select("vec_id", sql_text.normalize(F.col("query")).alias("normal"))


@query("sql_skeleton", f"SELECT vec_id, skel FROM {_LOGGED}")
def sql_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = X.catalog(spark).per_database().where(F.col("db_id") == X.DB).select("table_names", "column_names")
    skel = sql_text.skeleton(F.col("query"), F.col("table_names"), F.col("column_names"))
    return _logged(spark, sf_dir).join(F.broadcast(names)).select("vec_id", skel.alias("skel"))



_NUMBERS = ["5", "-7", "+3", "1.5", "-1.50", ".5", "5.", "1e5", "1_000", "nan", "-inf", "abc", "1.2.3", "", "-", "12a", "1__0", "Infinity"]
#: By hand: negative whole number, float in the narrow sense, number in the wide sense.
_FLAGS = [(0, 1, 1), (1, 1, 1), (0, 0, 1), (0, 1, 1), (0, 1, 1), (0, 0, 1), (0, 0, 1), (0, 0, 1), (0, 0, 1), (0, 0, 1), (0, 0, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 1)]


#: Words of conversations, prices and sizes as they are written.
_WORDS_SQL = "SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(text, ' ')) AS w FROM conversations UNION ALL SELECT CAST(p_size AS VARCHAR) || CASE WHEN p_size % 2 = 0 THEN '' ELSE '.5' END FROM part UNION ALL SELECT '-' || CAST(p_partkey AS VARCHAR) FROM part)"
_WIDE = r"(?i)^[\x09-\x0D ]*([+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|[+-]?(nan|inf|infinity))[\x09-\x0D ]*$"


@query("number_token_flags", "SELECT k, word, negative_int, narrow_float, number FROM " + X._values([(i, w, *f) for i, (w, f) in enumerate(zip(_NUMBERS, _FLAGS, strict=True))], "k, word, negative_int, narrow_float, number") + rf" UNION ALL SELECT -1, word, CAST(regexp_matches(word, '^-[0-9]+$') AS INTEGER), CAST(regexp_matches(word, '^-?[0-9]+([.][0-9]+)?$') AS INTEGER), CAST(regexp_matches(word, '{_WIDE}') AS INTEGER) FROM ({_WORDS_SQL})")
def number_token_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    words = _table(spark, sf_dir, "conversations").select(F.explode(F.split("text", " ")).alias("word"))
    words = words.union(part.select(F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, "").otherwise(".5")))).union(part.select(F.concat(F.lit("-"), F.col("p_partkey").cast("string"))))
    rows = spark.createDataFrame(list(enumerate(_NUMBERS)), "k int, word string").union(words.distinct().select(F.lit(-1), "word"))
    flag = lambda c, n: c.cast("int").alias(n)
    w = F.col("word")
    return rows.select("k", "word", flag(sql_text.is_negative_int(w), "negative_int"), flag(sql_text.is_float(w), "narrow_float"), flag(sql_text.is_number(w), "number"))


# --- selection ----------------------------------------------------------------------------


def _chosen(spark: SparkSession, sf_dir: str, name: str, k: int = K, threshold: float = selection.THRESHOLD) -> DataFrame:
    strategy = selection.STRATEGIES[name]
    pool = X.vectors(spark, sf_dir, strategy.masked)
    return selection.select(pool, X.targets(pool), strategy, k, threshold=threshold)


def _select_sql(name: str, k: int = K, threshold: float = selection.THRESHOLD) -> str:
    s = selection.STRATEGIES[name]
    sim = _jac(f"t.{s.skeleton}", f"c.{s.skeleton}") if s.skeleton else "CAST(NULL AS DOUBLE)"
    d = "list_cosine_similarity(t.vector, c.vector)" if s.metric == "cosine" else "list_distance(t.vector, c.vector)"
    score = f"({d} - {sim})" if s.metric == "hybrid" else d
    where = ["t.idx % 25 = 0", "c.db_id <> t.db_id"]
    where += ["c.question <> t.question"] * s.other_question + [f"{d} <= {threshold}"] * (s.most is not None) + [f"{sim} >= {threshold}"] * (s.gate and not s.backfill)
    late = f"(CASE WHEN {sim} < {threshold} THEN 1 ELSE 0 END)" if s.gate else "0"
    order = f"late, score {'DESC' if s.metric == 'cosine' else 'ASC'}, c_idx"
    pairs = f"SELECT t.idx AS t_idx, c.idx AS c_idx, {score} AS score, {sim} AS sim, {late} AS late FROM {X.vectors_sql(s.masked)} t, {X.vectors_sql(s.masked)} c WHERE {' AND '.join(where)}"
    return f"SELECT t_idx, c_idx, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY t_idx ORDER BY {order}) AS rank FROM ({pairs})) WHERE rank <= {k}"


#: Nearest distances of the fixture are 1.04 to 1.25; this one leaves pairs on both sides.
_FAR = 1.2

for _query, _name, _threshold in [
    ("knn_euclidean_topk", "EUCDISTANCE", 0.85), ("knn_cosine_topk", "COSSIMILAR", 0.85), ("knn_euclidean_threshold", "EUCDISTANCETHRESHOLD", _FAR), ("knn_masked_topk", "EUCDISQUESTIONMASK", 0.85),
    ("select_skeleton_gate_backfill", "EUCDISSKLSIMTHR", 0.85), ("select_preskeleton_gate_backfill", "EUCDISPRESKLSIMTHR", 0.85), ("select_flagship", "EUCDISMASKPRESKLSIMTHR", 0.85),
    ("select_gate_no_backfill", "EUCDISMASKPRESKLSIMTHRSHIFT", 0.85), ("select_distance_minus_jaccard", "EUCDISPRESKLSIMPLUS", 0.85),
]:
    QUERIES[_query] = lambda spark, sf_dir, n=_name, t=_threshold: _chosen(spark, sf_dir, n, threshold=t).select("t_idx", "c_idx", "rank", F.round("score", 6).alias("score"), F.round("sim", 6).alias("sim"))
    ORACLES[_query] = _select_sql(_name, threshold=_threshold)


# the product of two 64-bit numbers, modulo 2**64
_MIXED = "(((idx::UHUGEINT * 11400714819323198485 + t_idx::UHUGEINT * 14029467366897019727 + 1) % 18446744073709551616)::UBIGINT)"
_ONCE = f"(((xor({_MIXED}, {_MIXED} >> 31)::UHUGEINT * 15485907386658061715) % 18446744073709551616)::UBIGINT)"


@query("select_random_k", f"SELECT t_idx, idx AS c_idx, CAST(row_number() OVER (PARTITION BY t_idx ORDER BY key, idx) AS INTEGER) AS rank FROM (SELECT t_idx, idx, xor({_ONCE}, {_ONCE} >> 32) >> 1 AS key FROM (SELECT c.vec_id AS idx, t.vec_id AS t_idx FROM embeddings c, embeddings t WHERE t.vec_id % 25 = 0 AND c.label <> t.label)) QUALIFY rank <= {K}")
def select_random_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = X.vectors(spark, sf_dir)
    return selection.select_random(pool, X.targets(pool), K, cross_domain=True)


# --- linking ------------------------------------------------------------------------------

_STOPS = "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (*linking.STOP_WORDS, *linking.PUNCTUATION)) + ")"
_NUM = r"(regexp_matches(token, '^[+-]?[0-9]+(\.[0-9]*)?$'))"
_Q = X.QUESTIONS_SQL
_GRAMS = f"(SELECT idx, db_id, p - 1 AS start, n, array_to_string(toks[p:p + n - 1], ' ') AS gram FROM (SELECT idx, db_id, toks, n, unnest(range(1, len(toks) - n + 2)) AS p FROM {_Q}, (SELECT unnest(range(1, 6)) AS n) WHERE len(toks) >= n))"
_NAMES = f"(SELECT db_id, 'col' AS kind, col_id AS target_id, display AS name FROM {X.COLUMNS_SQL} UNION ALL SELECT db_id, 'tab', table_id, display FROM {X.TABLES_SQL})"
_EXACT = f"(SELECT idx, g.db_id, start, n, kind, target_id FROM {_GRAMS} g JOIN {_NAMES} m ON m.db_id = g.db_id AND m.name = g.gram)"
_PARTIAL = rf"(SELECT idx, g.db_id, start, n, kind, target_id FROM {_GRAMS} g JOIN {_NAMES} m ON m.db_id = g.db_id AND starts_with(m.name, g.gram) WHERE gram NOT IN {_STOPS} AND regexp_matches(left(m.name, 1), '^\w$') AND regexp_matches(right(gram, 1), '^\w$') <> regexp_matches(substr(m.name, length(gram) + 1, 1), '^\w$'))"
_LINKS = f"(SELECT idx, db_id, q_id, kind, target_id, CASE WHEN kind = 'col' THEN (CASE WHEN max(e) = 1 THEN 'CEM' ELSE 'CPM' END) ELSE (CASE WHEN max(e) = 1 THEN 'TEM' ELSE 'TPM' END) END AS flag FROM (SELECT *, unnest(range(start, start + n)) AS q_id FROM (SELECT *, 1 AS e FROM {_EXACT} UNION ALL SELECT *, 0 FROM {_PARTIAL})) GROUP BY idx, db_id, q_id, kind, target_id)"
_TOKENS = f"(SELECT * FROM (SELECT idx, db_id, unnest(range(0, len(toks))) AS q_id, unnest(toks) AS token FROM {_Q}) WHERE trim(token) <> '' AND token NOT IN {_STOPS})"
_NUMLINKS = f"(SELECT idx, t.db_id, q_id, 'num' AS kind, col_id AS target_id, upper(type) AS flag FROM {_TOKENS} t JOIN {X.COLUMNS_SQL} c ON c.db_id = t.db_id AND c.type IN ('number', 'time') WHERE {_NUM})"
_HITS = f"(SELECT DISTINCT idx, t.db_id, q_id, col_id FROM {_TOKENS} t JOIN (SELECT DISTINCT db_id, col_id, unnest(string_split(lower(value), ' ')) AS w FROM {X.CELLS_SQL}) c ON c.db_id = t.db_id AND c.w = lower(t.token) WHERE NOT {_NUM})"
_RUNS = f"(SELECT idx, db_id, col_id, min(q_id) AS a, max(q_id) AS b FROM (SELECT *, q_id - row_number() OVER (PARTITION BY idx, db_id, col_id ORDER BY q_id) AS island FROM {_HITS}) GROUP BY idx, db_id, col_id, island)"
_CELLLINKS = f"(SELECT idx, db_id, unnest(range(a, b + 1)) AS q_id, 'cell' AS kind, col_id AS target_id, flag FROM (SELECT r.idx, r.db_id, r.col_id, a, b, CASE WHEN EXISTS (SELECT 1 FROM {X.CELLS_SQL} c WHERE c.db_id = r.db_id AND c.col_id = r.col_id AND lower(c.value) = lower(array_to_string(q.toks[a + 1:b + 1], ' '))) THEN 'EXACTMATCH' ELSE 'PARTIALMATCH' END AS flag FROM {_RUNS} r JOIN {_Q} q ON q.idx = r.idx))"
_BARE = f"(SELECT * FROM {_CELLLINKS} c WHERE NOT EXISTS (SELECT 1 FROM {_LINKS} s WHERE s.idx = c.idx AND s.q_id = c.q_id))"


def _ints(sql: str, *names: str) -> str:
    return "SELECT " + ", ".join(f"CAST({n} AS INTEGER) AS {n}" if n in ("start", "n", "q_id", "target_id", "col_id") else n for n in names) + f" FROM {sql}"


@query("question_ngrams", _ints(_GRAMS, "idx", "start", "n", "gram"))
def question_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.ngrams(X.questions(spark, sf_dir)).select("idx", "start", "n", "gram")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions, each question's links made where its idx is dealt to."""
    return skew.spread(X.questions(spark, sf_dir), "idx")


def _names(spark: SparkSession) -> DataFrame:
    c = X.catalog(spark)
    return linking.names(c.columns, c.tables)


@query("link_names_exact", _ints(_EXACT, "idx", "start", "n", "kind", "target_id"))
def link_names_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.exact_names(_questions(spark, sf_dir), F.broadcast(_names(spark))).select("idx", "start", "n", "kind", "target_id")


@query("link_names_partial", _ints(_PARTIAL, "idx", "start", "n", "kind", "target_id"))
def link_names_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.partial_names(_questions(spark, sf_dir), F.broadcast(_names(spark))).select("idx", "start", "n", "kind", "target_id")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.catalog(spark)
    return linking.name_links(_questions(spark, sf_dir), c.columns, c.tables)


_LINK = ("idx", "q_id", "kind", "target_id", "flag")


@query("link_names_merged", _ints(_LINKS, *_LINK))
def link_names_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select(*_LINK)


@query("link_values_number", _ints(_NUMLINKS, *_LINK))
def link_values_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.number_links(_questions(spark, sf_dir), X.catalog(spark).columns).select(*_LINK)


@query("link_values_partial", _ints(_HITS, "idx", "q_id", "col_id"))
def link_values_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.partial_values(_questions(spark, sf_dir), linking.value_index(X.cells(spark, sf_dir))[0]).select("idx", "q_id", "col_id")


@query("link_values_islands", _ints(_CELLLINKS, *_LINK))
def link_values_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.value_links(_questions(spark, sf_dir), X.cells(spark, sf_dir)).select(*_LINK)


@query("link_cell_antijoin", _ints(_BARE, *_LINK))
def link_cell_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.cells_without_names(linking.value_links(_questions(spark, sf_dir), X.cells(spark, sf_dir)), _links(spark, sf_dir)).select(*_LINK)


#: Hand-made matches (question, token, kind, target, flag) and what is left after disambiguation, by hand.
_SHIFT = [(0, 0, "col", 1, "CEM"), (0, 0, "col", 2, "CPM"), (0, 1, "col", 1, "CEM"), (0, 1, "col", 2, "CPM"), (0, 2, "tab", 1, "TPM"), (1, 3, "col", 4, "CPM"), (1, 3, "tab", 4, "TPM"), (1, 5, "col", 4, "CPM"), (2, 0, "col", 7, "CEM"), (2, 1, "col", 7, "CPM"), (2, 1, "col", 8, "CPM")]
_SHIFTED = [(0, 0, "col", 1, "CEM"), (0, 1, "col", 1, "CEM"), (0, 2, "tab", 1, "TPM"), (1, 3, "col", 4, "CPM"), (1, 5, "col", 4, "CPM"), (2, 0, "col", 7, "CEM"), (2, 1, "col", 7, "CPM"), (2, 1, "col", 8, "CPM")]


#: A question on each part whose one token matches two columns, one of them exactly for some parts.
_PART_SHIFTED = "SELECT CAST(100 + p_partkey AS INTEGER) AS idx, 0 AS q_id, 'col' AS kind, p_size AS target_id, CASE WHEN p_size % 3 = 0 THEN 'CEM' ELSE 'CPM' END AS flag FROM part UNION ALL SELECT CAST(100 + p_partkey AS INTEGER), 0, 'col', 99, 'CPM' FROM part WHERE p_size % 3 <> 0"


@query("link_match_shift", "SELECT * FROM " + X._values(_SHIFTED, "idx, q_id, kind, target_id, flag") + " UNION ALL " + _PART_SHIFTED)
def link_match_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select((F.col("p_partkey") + 100).cast("int").alias("idx"), F.lit(0).alias("q_id"), F.lit("col").alias("kind"), "p_size")
    matches = part.select("idx", "q_id", "kind", F.col("p_size").alias("target_id"), F.when(F.col("p_size") % 3 == 0, "CEM").otherwise("CPM").alias("flag")).union(part.select("idx", "q_id", "kind", F.lit(99), F.lit("CPM")))
    rows = spark.createDataFrame(_SHIFT, "idx int, q_id int, kind string, target_id int, flag string").union(matches).withColumn("db_id", F.lit(X.DB))
    return linking.shifted(rows).select(*_LINK)


def _all_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    q = _questions(spark, sf_dir)
    return q, _links(spark, sf_dir), linking.number_links(q, X.catalog(spark).columns), linking.value_links(q, X.cells(spark, sf_dir))


def _masked_sql(values: str, mask: str, value: str) -> str:
    return f"SELECT q.idx, array_to_string(list_transform(range(0, len(toks)), lambda i: CASE WHEN list_contains(coalesce(s, []), i) THEN '{mask}' WHEN list_contains(coalesce(v, []), i) THEN '{value}' ELSE toks[i + 1] END), ' ') AS masked FROM {_Q} q LEFT JOIN (SELECT idx, list(DISTINCT q_id) AS s FROM {_LINKS} GROUP BY idx) a ON a.idx = q.idx LEFT JOIN (SELECT idx, list(DISTINCT q_id) AS v FROM {values} GROUP BY idx) b ON b.idx = q.idx"


# A token with schema links keeps at least one of them when matches are disambiguated, so masks need no fold here.
@query("question_masked", _masked_sql(f"(SELECT idx, q_id FROM {_NUMLINKS} UNION ALL SELECT idx, q_id FROM {_BARE})", "<mask>", "<unk>"))
def question_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.masked_questions(*_all_links(spark, sf_dir))


@query("question_pattern", _masked_sql(f"(SELECT idx, q_id FROM {_NUMLINKS} UNION ALL SELECT idx, q_id FROM {_CELLLINKS})", "_", "_"))
def question_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.question_patterns(*_all_links(spark, sf_dir))


_RELEVANT = f"(SELECT q.idx, q.db_id, coalesce(f.tables, e.tables) AS tables FROM {_Q} q JOIN (SELECT db_id, list_sort(list(table_name)) AS tables FROM {X.TABLES_SQL} GROUP BY db_id) e ON e.db_id = q.db_id LEFT JOIN (SELECT idx, list_sort(list(DISTINCT table_name)) AS tables FROM (SELECT idx, c.table_name FROM {_LINKS} l JOIN {X.COLUMNS_SQL} c ON c.db_id = l.db_id AND c.col_id = l.target_id WHERE kind = 'col' UNION ALL SELECT idx, t.table_name FROM {_LINKS} l JOIN {X.TABLES_SQL} t ON t.db_id = l.db_id AND t.table_id = l.target_id WHERE kind = 'tab' UNION ALL SELECT idx, c.table_name FROM {_CELLLINKS} l JOIN {X.COLUMNS_SQL} c ON c.db_id = l.db_id AND c.col_id = l.target_id WHERE flag = 'EXACTMATCH') GROUP BY idx) f ON f.idx = q.idx)"


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, schema, _, cells = _all_links(spark, sf_dir)
    c = X.catalog(spark)
    return linking.relevant_tables(q, schema, cells, c.columns, c.tables)


@query("relevant_tables", f"SELECT idx, array_to_string(tables, ',') AS tables FROM {_RELEVANT}")
def relevant_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relevant(spark, sf_dir).select("idx", F.array_join("tables", ",").alias("tables"))


@query("relevant_tables_quality", rf"SELECT count(*) AS total, CAST(sum(CASE WHEN len(list_filter(true_tables, lambda t: NOT list_contains(tables, t))) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad FROM (SELECT r.idx, r.tables, list(DISTINCT t.table_name) FILTER (list_contains(list_reduce(list_transform(regexp_split_to_array(lower(l.query), '\s+'), lambda w: string_split(w, '.')), lambda a, b: list_concat(a, b)), t.table_name)) AS true_tables FROM {_RELEVANT} r JOIN {X.LOG_SQL} l ON l.k = r.idx % 8 JOIN {X.TABLES_SQL} t ON t.db_id = r.db_id GROUP BY r.idx, r.tables)")
def relevant_tables_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    relevant = _relevant(spark, sf_dir)
    queries = X.questions(spark, sf_dir).select("idx", (F.col("idx") % 8).cast("int").alias("k")).join(F.broadcast(X.log(spark)), "k").select("idx", "query")
    return linking.relevant_table_quality(relevant, queries, X.catalog(spark).tables)


# --- catalog and prompts ------------------------------------------------------------------


@query("catalog_columns", f"SELECT * FROM {X.COLUMNS_SQL}")
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.wide_catalog(spark, sf_dir).columns


@query("catalog_fk_pairs", f"SELECT db_id, '(' || table_name || '.' || source || ', ' || ref_table || '.' || ref_column || ')' AS text, table_name || '.' || source || '=' || ref_table || '.' || ref_column AS pair FROM {X.FOREIGN_KEYS_SQL}")
def catalog_fk_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogs.foreign_key_pairs(X.wide_catalog(spark, sf_dir).foreign_keys).select("db_id", "text", "pair")


_DDL = f"(SELECT c.db_id, c.table_id, c.table_name, 'CREATE TABLE ' || c.table_name || ' (' || chr(10) || string_agg('  ' || column_name || ' ' || CASE type WHEN 'number' THEN 'REAL' WHEN 'time' THEN 'TIMESTAMP' WHEN 'boolean' THEN 'BOOLEAN' ELSE 'TEXT' END, ',' || chr(10) ORDER BY col_id) || coalesce(',' || chr(10) || '  PRIMARY KEY (' || string_agg(column_name, ', ' ORDER BY pk) FILTER (pk > 0) || ')', '') || coalesce(',' || chr(10) || any_value(f.refs), '') || chr(10) || ')' AS ddl FROM {X.COLUMNS_SQL} c LEFT JOIN (SELECT db_id, table_name, string_agg('  FOREIGN KEY (' || source || ') REFERENCES ' || ref_table || '(' || ref_column || ')', ',' || chr(10) ORDER BY source) AS refs FROM {X.FOREIGN_KEYS_SQL} GROUP BY db_id, table_name) f ON f.db_id = c.db_id AND f.table_name = c.table_name GROUP BY c.db_id, c.table_id, c.table_name)"


@query("catalog_ddl", f"SELECT db_id, table_name, ddl FROM {_DDL}")
def catalog_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.wide_catalog(spark, sf_dir).tables.select("db_id", "table_name", "ddl")


_FK_IDS = f"(SELECT f.db_id, a.col_id AS s, b.col_id AS r, a.table_id AS st, b.table_id AS rt FROM {X.FOREIGN_KEYS_SQL} f JOIN {X.COLUMNS_SQL} a ON a.db_id = f.db_id AND a.table_name = f.table_name AND a.column_name = f.source JOIN {X.COLUMNS_SQL} b ON b.db_id = f.db_id AND b.table_name = f.ref_table AND b.column_name = f.ref_column)"


@query("schema_preprocessed", f"SELECT c.db_id, string_agg(col_id || ':' || table_id, ',' ORDER BY col_id) AS column_to_table, (SELECT string_agg(low, ',' ORDER BY table_id) FROM (SELECT table_id, CAST(min(col_id) AS VARCHAR) AS low FROM {X.COLUMNS_SQL} x WHERE x.db_id = c.db_id GROUP BY table_id)) || ',' || CAST(max(col_id) + 1 AS VARCHAR) AS table_bounds, string_agg(CAST(col_id AS VARCHAR), ',' ORDER BY table_id, pk) FILTER (pk > 0) AS primary_keys, coalesce((SELECT string_agg(s || ':' || r, ',' ORDER BY s) FROM {_FK_IDS} k WHERE k.db_id = c.db_id), '') AS foreign_keys, string_agg('<type: ' || type || '> ' || display, '|' ORDER BY col_id) AS typed_columns FROM {X.COLUMNS_SQL} c GROUP BY c.db_id")
def schema_preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")
    p = catalogs.preprocessed(X.wide_catalog(spark, sf_dir))
    return p.select("db_id", pairs("column_to_table").alias("column_to_table"), F.array_join("table_bounds", ",").alias("table_bounds"), F.array_join("primary_keys", ",").alias("primary_keys"), F.coalesce(pairs("foreign_keys"), F.lit("")).alias("foreign_keys"), F.array_join(F.transform("typed_columns", lambda t: F.array_join(t, " ")), "|").alias("typed_columns"))


for _name in ("catalog_columns", "catalog_fk_pairs", "catalog_ddl", "schema_preprocessed"):
    ORACLES[_name] = X.widened(ORACLES[_name])


_BY_TABLE = f"(SELECT c.db_id, c.table_id, c.table_name, string_agg(column_name, ', ' ORDER BY col_id) AS cols, string_agg(c.table_name || '.' || column_name, ', ' ORDER BY col_id) AS dotted, any_value(d.ddl) AS ddl FROM {X.COLUMNS_SQL} c JOIN {_DDL} d ON d.db_id = c.db_id AND d.table_id = c.table_id GROUP BY c.db_id, c.table_id, c.table_name)"
_DBS = f"(SELECT db_id, string_agg(ddl, chr(10) || chr(10) ORDER BY table_id) AS s_ddl, string_agg(table_name || ': ' || cols, chr(10) ORDER BY table_id) AS s_colon, string_agg('# ' || table_name || '(' || cols || ')', chr(10) ORDER BY table_id) AS s_sign, string_agg('Table ' || table_name || ', columns = [' || cols || ']', chr(10) ORDER BY table_id) AS s_list, string_agg(table_name || '(' || cols || ')', chr(10) ORDER BY table_id) AS s_call, '' AS s_none, string_agg(table_name, ', ' ORDER BY table_id) AS tables, string_agg(dotted, ', ' ORDER BY table_id) AS columns, coalesce((SELECT string_agg(f.table_name || '.' || source || '=' || ref_table || '.' || ref_column, ', ' ORDER BY t.table_id, source) FROM {X.FOREIGN_KEYS_SQL} f JOIN {X.TABLES_SQL} t ON t.db_id = f.db_id AND t.table_name = f.table_name WHERE f.db_id = b.db_id), '') AS fks FROM {_BY_TABLE} b GROUP BY db_id)"


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _block_sql(name: str) -> str:
    """The question block of a layout: template pieces in SQL, names replaced by columns one after another."""
    layout = prompts.LAYOUTS[name]
    out = _sql_text(layout.info + layout.gap + layout.question)
    for part, column in {"schema": f"s_{layout.schema}", "fks": "fks", "tables": "tables", "columns": "columns", "question": "question"}.items():
        out = out.replace(f"{{{part}}}", f"' || {column} || '")
    return f"({out})"


for _name in prompts.LAYOUTS:
    QUERIES[f"prompt_{_name.lower()}"] = lambda spark, sf_dir, n=_name: prompts.rendered(X.questions(spark, sf_dir), X.catalog(spark).per_database(), n).select("idx", "prompt")
    ORACLES[f"prompt_{_name.lower()}"] = f"SELECT idx, {_block_sql(_name)} || {_sql_text(prompts.LAYOUTS[_name].suffix)} AS prompt FROM {_Q} q JOIN {_DBS} d ON d.db_id = q.db_id"


def _solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions on parts with a query of the log and their full block in one layout."""
    q = X.questions(spark, sf_dir).withColumn("k", (F.col("idx") % 8).cast("int")).join(F.broadcast(X.log(spark)), "k")
    return prompts.rendered(q, X.catalog(spark).per_database(), "TEXT")


for _name, (_, _template) in prompts.STYLES.items():
    _sql = _sql_text(_template).replace("{full}", f"' || {_block_sql('TEXT')} || '").replace("{question}", "' || question || '").replace("{query}", "' || l.query || '")
    QUERIES[f"example_{_name.lower()}"] = lambda spark, sf_dir, n=_name: _solved(spark, sf_dir).select("idx", prompts.example(n, F.col("question"), F.col("query"), F.col("block")).alias("example"))
    ORACLES[f"example_{_name.lower()}"] = f"SELECT idx, {_sql} AS example FROM {_Q} q JOIN {_DBS} d ON d.db_id = q.db_id JOIN {X.LOG_SQL} l ON l.k = q.idx % 8"

_SHOTS, _SEQ, _ANS = 3, 150, 60
_COUNT = r"len(regexp_extract_all({}, '\w+|[^\w\s]'))"
_OFFERS = f"(SELECT t_idx, rank, c_idx, '/* Answer the following: ' || c.question || ' */' || chr(10) || c.query AS example FROM ({_select_sql('EUCDISMASKPRESKLSIMTHR')}) s JOIN {X.vectors_sql()} c ON c.idx = s.c_idx)"
_FEW = f"""
WITH RECURSIVE t AS (SELECT idx, db_id, query, question || chr(10) || 'SELECT ' AS prompt FROM {X.vectors_sql()} WHERE idx % 25 = 0),
o AS MATERIALIZED (SELECT * FROM {_OFFERS}),
f AS (
  SELECT idx, 0 AS rank, '' AS done, 0 AS n, CAST({_COUNT.format('prompt')} AS BIGINT) AS tokens, prompt FROM t
  UNION ALL
  SELECT idx, r, CASE WHEN take THEN done || example || chr(10) || chr(10) ELSE done END, CASE WHEN take THEN n + 1 ELSE n END, CASE WHEN take THEN new ELSE tokens END, prompt
  FROM (SELECT *, n < {_SHOTS} AND new + {_ANS} <= {_SEQ} AS take FROM (
    SELECT f.idx, o.rank AS r, f.done, f.n, f.tokens, f.prompt, o.example, CAST({_COUNT.format(f"{_sql_text(prompts.STYLES['QA'][0])} || f.done || o.example || chr(10) || chr(10) || f.prompt")} AS BIGINT) AS new
    FROM f JOIN o ON o.t_idx = f.idx AND o.rank = f.rank + 1))),
e AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY idx ORDER BY rank DESC) = 1)
SELECT idx, CASE WHEN n > 0 THEN {_sql_text(prompts.STYLES['QA'][0])} || done || prompt ELSE prompt END AS prompt, tokens AS prompt_tokens, CAST(n AS INTEGER) AS n_examples FROM e
"""


def _few_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = X.vectors(spark, sf_dir)
    ranked = _chosen(spark, sf_dir, "EUCDISMASKPRESKLSIMTHR")
    text = prompts.example("QA", F.col("question"), F.col("query"), F.lit(""))
    offers = ranked.join(pool.select(F.col("idx").alias("c_idx"), text.alias("example")), "c_idx").select("t_idx", "rank", "c_idx", "example")
    targets = X.targets(pool).withColumn("prompt", F.concat("question", F.lit("\nSELECT ")))
    return prompts.few_shot(targets, offers, "QA", _SHOTS, _SEQ, _ANS)


@query("prompt_fewshot_budget", _FEW)
def prompt_fewshot_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _few_shot(spark, sf_dir).select("idx", "prompt", "prompt_tokens", "n_examples")


# --- answers ------------------------------------------------------------------------------

_ANSWER = ["SELECT a\n  FROM t ", "a FROM t /* why */ x", "select a", "  SELECT  1 /*c*/", ""]
_CLEAN = ["SELECT a FROM t", "SELECT a FROM t ", "SELECT select a", "SELECT 1 ", "SELECT "]


@query("response_clean", "SELECT event_id, sql FROM events JOIN " + X._values(list(enumerate(_CLEAN)), "k, sql") + " ON k = event_id % 5")
def response_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, _ANSWER)), (F.col("event_id") % 5 + 1).cast("int"))
    return _table(spark, sf_dir, "events").select("event_id", answers.answer_sql(raw).alias("sql"))


_POST = ["SELECT DISTINCT a FROM t WHERE x > = 3", "SELECT count(distinct a) FROM t WHERE y = 'distinct b' AND z ! = 1", "SELECT year( curdate( ) ) FROM t; SELECT 2", "SELECT 1 < = 2"]
_POSTED = ["SELECT  a FROM t WHERE x >= 3", "SELECT count( a) FROM t WHERE y = 'distinct b' AND z != 1", "SELECT 2020FROM t;", "SELECT 1 <= 2"]


@query("sql_postprocess", "SELECT event_id, sql FROM events JOIN " + X._values([(i, s.replace("'", "''")) for i, s in enumerate(_POSTED)], "k, sql") + " ON k = event_id % 4")
def sql_postprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, _POST)), (F.col("event_id") % 4 + 1).cast("int"))
    return _table(spark, sf_dir, "events").select("event_id", voting.executable(raw).alias("sql"))


# --- voting -------------------------------------------------------------------------------

_CANDIDATES = [
    (0, 0, "SELECT n_name, n_regionkey FROM nation"), (0, 1, "SELECT n_regionkey, n_name FROM nation"), (0, 2, "SELECT r_name FROM region"), (0, 3, "SELECT nothing FROM nowhere"),
    (1, 0, "SELECT count(*) FROM nation"), (1, 1, "SELECT count(*) FROM region"), (1, 2, "SELECT DISTINCT 25.0 AS c"), (1, 3, "SELECT 5"),
    (2, 0, "DROP TABLE nation"), (2, 1, "SELECT x"),
    (3, 0, "SELECT r_name FROM region WHERE r_regionkey > 100"), (3, 1, "SELECT 1 AS a, 2 AS b FROM region WHERE r_regionkey < 0"), (3, 2, "SELECT r_name FROM region"),
]
#: By hand: cluster and votes of the candidates that run; winners.
_CLUSTERS = [(0, 0, 0, 2), (0, 1, 0, 2), (0, 2, 2, 1), (1, 0, 0, 2), (1, 1, 1, 2), (1, 2, 0, 2), (1, 3, 1, 2), (3, 0, 0, 2), (3, 1, 0, 2), (3, 2, 2, 1)]
_WINNERS = [(0, "SELECT n_name, n_regionkey FROM nation", 2), (1, "SELECT count(*) FROM nation", 2), (2, "DROP TABLE nation", 0), (3, "SELECT r_name FROM region WHERE r_regionkey > 100", 2)]


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    for name in ("nation", "region"):
        _table(spark, sf_dir, name).createOrReplaceTempView(name)
    candidates = spark.createDataFrame([(i, X.DB, n, s) for i, n, s in _CANDIDATES], "idx int, db_id string, cand_no int, sql string")
    return candidates, voting.execute(spark, candidates)


_RAN = [(s, "ok", n, c) for s, n, c in [("SELECT n_name, n_regionkey FROM nation", 25, 2), ("SELECT n_regionkey, n_name FROM nation", 25, 2), ("SELECT r_name FROM region", 5, 1), ("SELECT count(*) FROM nation", 1, 1), ("SELECT count(*) FROM region", 1, 1), ("SELECT DISTINCT 25.0 AS c", 1, 1), ("SELECT 5", 1, 1), ("SELECT r_name FROM region WHERE r_regionkey > 100", 0, 1), ("SELECT 1 AS a, 2 AS b FROM region WHERE r_regionkey < 0", 0, 2)]]


#: By hand: of the candidates with equal results, the first by text, where it is another one.
_SAME = {
    "SELECT n_regionkey, n_name FROM nation": "SELECT n_name, n_regionkey FROM nation",
    "SELECT count(*) FROM nation": "SELECT DISTINCT 25.0 AS c",
    "SELECT count(*) FROM region": "SELECT 5",
    "SELECT r_name FROM region WHERE r_regionkey > 100": "SELECT 1 AS a, 2 AS b FROM region WHERE r_regionkey < 0",
}


@query("vote_fingerprint", "SELECT sql, status, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_cols AS BIGINT) AS n_cols, same_as FROM " + X._values([(*r, _SAME.get(r[0], r[0])) for r in _RAN], "sql, status, n_rows, n_cols, same_as"))
def vote_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = Window.partitionBy("fingerprint", "n_rows", F.when(F.col("n_rows") > 0, F.col("n_cols")))
    return _results(spark, sf_dir)[1].where("status = 'ok'").select("sql", "status", "n_rows", "n_cols", F.min("sql").over(same).alias("same_as"))


@query("vote_clusters", "SELECT idx, cand_no, cluster, CAST(votes AS BIGINT) AS votes FROM " + X._values(_CLUSTERS, "idx, cand_no, cluster, votes"))
def vote_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.clusters(*_results(spark, sf_dir)).select("idx", "cand_no", "cluster", "votes")


@query("vote_winner", "SELECT idx, sql, CAST(votes AS BIGINT) AS votes FROM " + X._values(_WINNERS, "idx, sql, votes"))
def vote_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.winners(*_results(spark, sf_dir)).select("idx", "sql", F.col("votes").cast("long").alias("votes"))


@query("bag_equality", "SELECT 'same' AS pair, NOT EXISTS ((SELECT n_name, n_regionkey FROM nation EXCEPT ALL SELECT n_name, n_regionkey FROM nation) UNION ALL (SELECT n_name, n_regionkey FROM nation EXCEPT ALL SELECT n_name, n_regionkey FROM nation)) AS equal UNION ALL SELECT 'other', NOT EXISTS ((SELECT c_nationkey FROM customer EXCEPT ALL SELECT n_nationkey FROM nation) UNION ALL (SELECT n_nationkey FROM nation EXCEPT ALL SELECT c_nationkey FROM customer))")
def bag_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "customer")
    same = voting.same_bag(nation.select("n_name", "n_regionkey"), nation.orderBy(F.desc("n_nationkey")).select("n_name", "n_regionkey"))
    other = voting.same_bag(customer.select(F.col("c_nationkey").alias("k")), nation.select(F.col("n_nationkey").alias("k")))
    return same.select(F.lit("same").alias("pair"), "equal").union(other.select(F.lit("other"), "equal"))


# --- datasets -----------------------------------------------------------------------------


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "source", "text")


@query("union_splits", "SELECT doc_id AS idx, source FROM documents UNION ALL SELECT doc_id + (SELECT count(*) FROM documents), lang FROM documents")
def union_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return relations.union_splits(d.select(F.col("doc_id").alias("idx"), "source"), d.select(F.col("doc_id").alias("idx"), F.col("lang").alias("source")))


@query("dedup_positions", "SELECT doc_id AS idx FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1")
def dedup_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.later_duplicates(_docs(spark, sf_dir).select("idx", F.sha2("text", 256).alias("text")), "text").select("idx")


_TOKENS = "flatten(list_transform(list_filter(string_split({0}, ' '), lambda t: t <> ''), lambda t: CASE WHEN length(t) > 1 AND right(t, 1) IN ('?', '.', ':', ';', ',') THEN [left(t, length(t) - 1), right(t, 1)] ELSE [t] END))"


@query("bird_tokens", f"SELECT conv_id, turn, array_to_string({_TOKENS.format('text')}, '|') AS toks FROM conversations")
def bird_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(answers.question_tokens(F.col("text")), "|").alias("toks"))


_ASKED = "trim(p_name || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' ' || p_brand END)"


@query("bird_converted", f"SELECT p_partkey, {_ASKED} AS question, array_to_string({_TOKENS.format(_ASKED)}, '|') AS toks, 'SELECT ' || p_size AS query FROM part")
def bird_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.col("p_brand"))
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("question"), evidence.alias("evidence"), F.concat(F.lit("SELECT "), F.col("p_size").cast("string")).alias("SQL"))
    return dataset.converted(rows).select("p_partkey", "question", F.array_join("question_toks", "|").alias("toks"), "query")


@query("gold_answer", rf"SELECT vec_id, substring(trim(regexp_replace(query, '\s+', ' ', 'g')), 8) AS answer FROM {_LOGGED}")
def gold_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logged(spark, sf_dir).select("vec_id", answers.gold_answer(F.col("query")).alias("answer"))


_TRIMMED = r"regexp_replace(x, '^[\x09-\x0D ]+|[\x09-\x0D ]+$', '', 'g')"


@query("first_candidates", f"SELECT doc_id AS idx, CAST(i AS INTEGER) AS cand_no, split_part({_TRIMMED}, '/*', 1) AS sql FROM (SELECT doc_id, i, string_split(text, ' ')[CAST(i AS INTEGER) + 1] AS x FROM (SELECT doc_id, text, unnest(range(0, least(3, len(string_split(text, ' '))))) AS i FROM documents WHERE text IS NOT NULL))")
def first_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _table(spark, sf_dir, "documents").where("text is not null")
    rows = texts.select(F.col("doc_id").alias("idx"), F.lit(X.DB).alias("db_id"), F.split("text", " ").alias("p_sqls"))
    return voting.first_candidates(rows, 3).select("idx", "cand_no", "sql")


@query("token_totals", r"SELECT count(*) AS answers, CAST(0 AS BIGINT) AS failed, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS total_tokens FROM benchmark WHERE text IS NOT NULL")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "benchmark").where("text is not null").select(F.xxhash64("item_id").alias("idx"), F.lit(X.DB).alias("db_id"), F.col("text").alias("prompt"))
    return llm_client.token_totals(llm_client.ask(rows, llm_client.Replay()))


_LEMMA = "CASE " + " ".join(f"WHEN ends_with(t, '{end}') AND length(t) > {len(end) + 2} THEN left(t, length(t) - {len(end)}) || '{put}'" for end, put in hooks._ENDINGS) + " ELSE t END"


@query("annotated_tokens", rf"SELECT item_id, array_to_string(list_transform(regexp_extract_all(lower(text), '\d+(?:\.\d+)?|[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'), lambda t: {_LEMMA}), ' ') AS toks FROM benchmark WHERE text IS NOT NULL")
def annotated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hooks.with_tokens(_table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", "text"), hooks.PlainTokens(), "text")
    return rows.select("item_id", F.array_join("toks", " ").alias("toks"))


#: By hand: columns in foreign keys of the fixture's catalog, and the first column of their set.
_KEY_SETS = [(x, y) for y, own in {"region.r_regionkey": ["nation.n_regionkey"], "nation.n_nationkey": ["customer.c_nationkey"], "customer.c_custkey": ["orders.o_custkey"], "orders.o_orderkey": ["lineitem.l_orderkey"], "part.p_partkey": ["lineitem.l_partkey"]}.items() for x in [y, *own]]


@query("foreign_key_sets", "SELECT '__' || a || '__' AS \"column\", '__' || b || '__' AS representative FROM " + X._values(_KEY_SETS, "a, b") + f" UNION ALL SELECT DISTINCT '__' || lower(t) || '.' || lower(c) || '__', '__' || lower(first(t) OVER w) || '.' || lower(first(c) OVER w) || '__' FROM (SELECT c.db_id, c.table_name AS t, c.column_name AS c, c.col_id FROM {X.TRADE_COLUMNS_SQL} c JOIN (SELECT db_id, source AS c FROM {X.TRADE_KEYS_SQL} UNION SELECT db_id, ref_column FROM {X.TRADE_KEYS_SQL}) k ON k.db_id = c.db_id AND k.c = c.column_name) WINDOW w AS (PARTITION BY db_id ORDER BY col_id)")
def foreign_key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = X.raw_databases(spark)
    return catalogs.key_sets(raw.unionByName(X.raw_trade(spark, sf_dir))).select("column", "representative")


@query("list_equality", "SELECT * FROM (VALUES ('same', true), ('turned', false), ('shorter', false)) AS v(pair, equal)")
def list_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("double"), "n_name").orderBy("n_nationkey")
    pairs = {"same": _table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey"), "turned": nation.orderBy(F.desc("n_nationkey")), "shorter": nation.where("n_nationkey > 3").orderBy("n_nationkey")}
    out = [voting.same_list(nation, other).select(F.lit(name).alias("pair"), "equal") for name, other in pairs.items()]
    return out[0].union(out[1]).union(out[2])


@query("bird_evidence", "SELECT p_partkey, trim(p_name || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' ' || p_brand END) AS question FROM part")
def bird_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.col("p_brand"))
    return _table(spark, sf_dir, "part").select("p_partkey", answers.with_evidence(F.col("p_name"), evidence).alias("question"))


@query("bird_export", f"SELECT vec_id, l.query || ' ' || chr(9) || '----- bird -----' || chr(9) || CAST(label AS VARCHAR) AS line FROM embeddings JOIN {X.LOG_SQL} l ON l.k = vec_id % 8")
def bird_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.vectors(spark, sf_dir).select(F.col("idx").alias("vec_id"), answers.export_line(F.concat("query", F.lit(" /* x */")), F.col("db_id")).alias("line"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = X.vectors(spark, sf_dir)
    t = pool.select(F.col("idx").alias("t_idx"), F.col("skeleton").alias("a"), F.col("question").alias("qa"))
    c = pool.select(F.col("idx").alias("c_idx"), F.col("skeleton").alias("b"), F.col("question").alias("qb"))
    return _chosen(spark, sf_dir, "EUCDISMASKPRESKLSIMTHR").join(t, "t_idx").join(c, "c_idx")


_PAIRS = f"(SELECT t_idx, t.skeleton AS a, c.skeleton AS b, t.question AS qa, c.question AS qb FROM ({_select_sql('EUCDISMASKPRESKLSIMTHR')}) s JOIN {X.vectors_sql()} t ON t.idx = t_idx JOIN {X.vectors_sql()} c ON c.idx = c_idx)"


@query("example_quality", f"SELECT round(avg({_jac('a', 'b')}), 6) AS quality FROM {_PAIRS}")
def example_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.quality(_pairs(spark, sf_dir), F.col("a"), F.col("b")).select(F.round("quality", 6).alias("quality"))


@query("pattern_similarity", f"SELECT round(avg({_jac('qa', 'qb')}), 6) AS quality FROM {_PAIRS}")
def pattern_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.quality(_pairs(spark, sf_dir), F.col("qa"), F.col("qb")).select(F.round("quality", 6).alias("quality"))


@query("quality_per_target", f"SELECT t_idx, round(avg({_jac('a', 'b')}), 6) AS quality FROM {_PAIRS} GROUP BY t_idx")
def quality_per_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.quality_per_target(_pairs(spark, sf_dir), F.col("a"), F.col("b")).select("t_idx", F.round("quality", 6).alias("quality"))


_PRICES = X._values(list(metrics.PRICES.items()), "model, price")


@query("token_cost", f"SELECT model, n AS prompts, tokens, round(avg_tokens, 6) AS tokens_per_prompt, round(CAST(price AS DOUBLE) * (tokens + n * 200) / 1000, 6) AS cost FROM {_PRICES}, (SELECT count(*) AS n, CAST(sum(x) AS BIGINT) AS tokens, avg(x) AS avg_tokens FROM (SELECT {_COUNT.format('question')} AS x FROM {_Q}))")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = X.questions(spark, sf_dir).select(answers.token_count(F.col("question")).cast("long").alias("prompt_tokens"))
    return metrics.costs(spark, counted).select("model", "prompts", "tokens", F.round("tokens_per_prompt", 6).alias("tokens_per_prompt"), F.round("cost", 6).alias("cost"))


@query("positional_join", "SELECT doc_id AS idx, source, item_id FROM documents JOIN benchmark ON item_id = doc_id")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.aligned(_docs(spark, sf_dir).select("idx", "source"), _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idx"), "item_id"))


@query("index_subset", "SELECT place AS idx, source FROM (SELECT item_id AS place, item_id * 3 AS src FROM benchmark) JOIN documents ON doc_id = src")
def index_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("place"), (F.col("item_id") * 3).alias("idx"))
    return relations.subset(_docs(spark, sf_dir).select("idx", "source"), places)


@query("batch_slice", "SELECT doc_id AS idx FROM documents WHERE doc_id // 16 >= 2 AND doc_id // 16 < 9")
def batch_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.batches(_docs(spark, sf_dir).select("idx"), 16, 2, 9)


@query("line_filter", "SELECT event_id FROM events WHERE trim(CASE WHEN event_id % 3 = 0 THEN '  ' ELSE props END) <> ''")
def line_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit(" \t")).otherwise(F.col("props")).alias("value"))
    return relations.not_blank(lines).select("event_id")


@query("resume_antijoin", "SELECT o_orderkey AS idx FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.resumed(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx")), _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("idx")))


# --- statements of another dialect -----------------------------------------------------------

#: A statement for SQLite that gives one value, and the same for DuckDB as a number or a text.
_DIALECT = [
    ("SELECT sum(p_size) / count(*) FROM part", "sum(p_size) // count(*) FROM part", ""),
    ("SELECT 7 * max(p_size) / 3 * 1.5 FROM part", "7 * max(p_size) // 3 * 1.5 FROM part", ""),
    ("SELECT CAST(sum(p_size) AS REAL) / count(*) FROM part", "avg(p_size) FROM part", ""),
    ("SELECT count(*) / 0 FROM nation", "NULL", ""),
    ("SELECT -7 / 2 + count(*) % 4 FROM part", "-3 + count(*) % 4 FROM part", ""),
    ("SELECT count(*) FROM part WHERE p_name LIKE '%R%' AND p_type NOT LIKE \"eco%\"", "count(*) FROM part WHERE p_name ILIKE '%r%' AND p_type NOT ILIKE 'eco%'", ""),
    ("SELECT count(*) FROM part WHERE p_name GLOB '*R*' OR p_name GLOB '[a-m]*'", "count(*) FROM part WHERE regexp_matches(p_name, 'R|^[a-m]')", ""),
    ("SELECT count(*) FROM customer WHERE c_mktsegment = \"BUILDING\" AND \"c_acctbal\" > 0 AND c_name IS NOT 'x'", "count(*) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0", ""),
    ("SELECT sum(p_size > 25), count(*) FROM part", "count(*) FILTER (p_size > 25) FROM part", ""),
    ("SELECT count(*) FROM orders WHERE strftime('%Y', o_orderdate) = '1995' AND strftime('%m', o_orderdate) >= '07'", "count(*) FROM orders WHERE year(o_orderdate) = 1995 AND month(o_orderdate) >= 7", ""),
    ("SELECT julianday(max(o_orderdate)) - julianday(min(o_orderdate)) FROM orders", "date_diff('day', min(o_orderdate), max(o_orderdate)) FROM orders", ""),
    ("SELECT max(date(o_orderdate, 'start of month', '+1 month', '-1 day')) FROM orders", "", "CAST(last_day(max(o_orderdate)) AS VARCHAR) FROM orders"),
    ("SELECT strftime('%d/%m/%Y', min(o_orderdate)) FROM orders", "", "strftime(min(o_orderdate), '%d/%m/%Y') FROM orders"),
    ("SELECT iif(count(*) > 10, 'many', 'few') || '!' FROM supplier", "", "CASE WHEN count(*) > 10 THEN 'many' ELSE 'few' END || '!' FROM supplier"),
    ("SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 1, 1", "", "p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 1 OFFSET 1"),
    ("SELECT CAST('12abc' AS INTEGER) + CAST(' 3.5x' AS REAL) + count(*) FROM nation", "15.5 + count(*) FROM nation", ""),
    ("SELECT p_partkey FROM part WHERE p_retailprice = (SELECT p_retailprice FROM part WHERE p_partkey = 3) ORDER BY p_partkey LIMIT 1", "min(p_partkey) FROM part WHERE p_retailprice = (SELECT p_retailprice FROM part WHERE p_partkey = 3)", ""),
    ("SELECT max(o_totalprice), o_orderkey FROM orders WHERE o_custkey < 100", "max(o_totalprice) FROM orders WHERE o_custkey < 100", ""),
    ("SELECT o_orderkey FROM (SELECT o_orderkey, max(o_totalprice) FROM orders)", "arg_max(o_orderkey, o_totalprice) FROM orders", ""),
    ("SELECT total(l_quantity) FROM lineitem WHERE l_orderkey < 0", "0", ""),
    ("SELECT upper(substr(n_name, 0, 4)) || length(n_name) FROM nation ORDER BY n_nationkey LIMIT 1", "", "upper(n_name[1:3]) || length(n_name) FROM nation ORDER BY n_nationkey LIMIT 1"),
]


def _shop(sf_dir: str) -> Callable[[SparkSession], dict[str, DataFrame]]:
    """The tables of the catalog's first database."""
    return lambda session: {t[1]: _table(session, sf_dir, t[1]) for t in X.TABLES if t[0] == X.DB} | {"supplier": _table(session, sf_dir, "supplier")}


def _valued(k: int, number: str, text: str) -> str:
    own, _, rest = (number or text).partition(" FROM ")
    value = f"(SELECT {own} AS v" + (f" FROM {rest})" if rest else ")")
    return f"SELECT {k} AS k, " + (f"round(CAST(v AS DOUBLE), 6) AS num, CAST(NULL AS VARCHAR) AS txt FROM {value}" if number else f"CAST(NULL AS DOUBLE) AS num, CAST(v AS VARCHAR) AS txt FROM {value}")


@query("dialect_values", " UNION ALL ".join(_valued(k, number, text) for k, (_, number, text) in enumerate(_DIALECT)))
def dialect_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    database = voting.Database(spark, _shop(sf_dir))
    out = None
    for k, (sql, number, _) in enumerate(_DIALECT):
        found = database.frame(sql)
        df = found.toDF(*(f"c{i}" for i in range(len(found.columns))))
        num = F.round(F.col("c0").try_cast("double"), 6) if number else F.lit(None).cast("double")
        txt = F.lit(None).cast("string") if number else F.col("c0").cast("string")
        one = df.select(F.lit(k).alias("k"), num.alias("num"), txt.alias("txt"))
        out = one if out is None else out.union(one)
    return out


#: Two ways to ask one thing and one way to ask another; the last reads a file of the machine and is refused.
_ALIKE = [
    ("SELECT sum(p_size) / count(*) FROM part", "SELECT (sum(p_size) - sum(p_size) % count(*)) / count(*) FROM part", "SELECT sum(p_size) * 1.0 / count(*) + 0.123 FROM part"),
    ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%R%'", "SELECT p_name, p_partkey FROM part WHERE p_name LIKE '%r%'", "SELECT p_partkey, p_name FROM part WHERE p_name GLOB '*R*'"),
    ("SELECT count(*) FROM orders WHERE strftime('%Y', o_orderdate) = '1995'", "SELECT count(*) FROM orders WHERE date(o_orderdate, 'start of year') = '1995-01-01'", "SELECT 1 + count(*) FROM orders"),
    ("SELECT c_mktsegment, count(*) FROM customer WHERE c_mktsegment = \"BUILDING\"", "SELECT count(*), [c_mktsegment] FROM customer GROUP BY `c_mktsegment` HAVING c_mktsegment IS 'BUILDING'", "SELECT c_mktsegment FROM customer LIMIT 0"),
    ("SELECT n_name FROM nation WHERE n_regionkey = 1 ORDER BY n_nationkey LIMIT 0, 3", "SELECT n_name FROM nation WHERE n_regionkey = 1 ORDER BY n_nationkey LIMIT 3 OFFSET 0", "SELECT * FROM text.`/etc/hostname`"),
]
_ALIKE_ROWS = [(i, k, s) for i, own in enumerate(_ALIKE) for k, s in enumerate(own)]


@query("vote_dialect", "SELECT idx, cand_no, cluster, CAST(votes AS BIGINT) AS votes FROM " + X._values([(i, k, 0 if k < 2 else 2, 2 if k < 2 else 1) for i, k, _ in _ALIKE_ROWS if (i, k) != (4, 2)], "idx, cand_no, cluster, votes"))
def vote_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = spark.createDataFrame([(i, X.DB, k, s) for i, k, s in _ALIKE_ROWS], "idx int, db_id string, cand_no int, sql string")
    return voting.clusters(candidates, voting.execute(spark, candidates, tables={X.DB: _shop(sf_dir)})).select("idx", "cand_no", "cluster", "votes")


# --- joins and indexes of selection ----------------------------------------------------------


_NUMBERED = "(SELECT t, w, row_number() OVER (PARTITION BY t, w) AS i FROM (SELECT t, unnest(string_split(t, ' ')) AS w FROM (SELECT DISTINCT p_name || ' ' || p_brand || ' ' || p_type AS t FROM part)))"


@query("similar_texts", f"SELECT a, b, round(k / (len(string_split(a, ' ')) + len(string_split(b, ' ')) - k), 6) AS sim FROM (SELECT x.t AS a, y.t AS b, CAST(count(*) AS DOUBLE) AS k FROM {_NUMBERED} x JOIN {_NUMBERED} y ON x.w = y.w AND x.i = y.i GROUP BY ALL) WHERE k / (len(string_split(a, ' ')) + len(string_split(b, ' ')) - k) >= 0.6")
def similar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    return similarity_join.similar(texts, texts, 0.6).select("a", "b", F.round("sim", 6).alias("sim"))


@query("knn_indexed", _select_sql("EUCDISTANCE"))
def knn_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = X.vectors(spark, sf_dir)
    found, _ = nearest.search(nearest.build(pool), X.targets(pool), selection.STRATEGIES["EUCDISTANCE"], K)
    return found.select("t_idx", "c_idx", "rank", F.round("score", 6).alias("score"), F.round("sim", 6).alias("sim"))


#: Every seventh vector is zero.
_SOME_ZERO = "(SELECT idx, db_id, question, CASE WHEN idx % 7 = 3 THEN list_transform(vector, lambda x: 0.0) ELSE vector END AS v, idx % 7 = 3 AS zero FROM " + X.vectors_sql() + ")"


@query(
    "knn_cosine_zero_vectors",
    f"SELECT t_idx, c_idx, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY t_idx ORDER BY score DESC, c_idx) AS rank FROM (SELECT t.idx AS t_idx, c.idx AS c_idx, CASE WHEN t.zero OR c.zero THEN 0.0 ELSE list_cosine_similarity(t.v, c.v) END AS score FROM {_SOME_ZERO} t, {_SOME_ZERO} c WHERE t.idx % 25 = 0 AND c.db_id <> t.db_id AND c.question <> t.question)) WHERE rank <= {K}",
)
def knn_cosine_zero_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = X.vectors(spark, sf_dir)
    pool = pool.withColumn("vector", F.when(F.col("idx") % 7 == 3, F.transform("vector", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("vector")))
    return selection.select(pool, X.targets(pool), selection.STRATEGIES["COSSIMILAR"], K).select("t_idx", "c_idx", "rank", F.round("score", 6).alias("score"))


@query("split_documents", "SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS idx, doc_id, md5(text) AS digest FROM documents")
def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as one JSON array, and that array read back by ranges of bytes."""
    path = f"{folder(spark)}/array-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents")
    sinks.write_json_array(docs.select(F.col("doc_id").alias("idx"), F.col("doc_id").alias("id"), "text"), path)
    return files.json_array(spark, path, "struct<id:bigint,text:string>", whole=-1).select("idx", F.col("id").alias("doc_id"), F.md5("text").alias("digest"))


# --- lemmas -------------------------------------------------------------------------------

#: Endings of the given tables' lexicon: a word that is another word of three letters or more with one of these has the shortest such word as its lemma, others have themselves.
_INFLECTED = ("s", "es", "ed", "er", "ly", "ing")
_HELD = "substr(md5(form), 1, 1) < '4'"


def _lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """form, lemma of every word of documents."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = stored(_table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(lower, F.lit("[a-z]+"), F.lit(0))).alias("form")).distinct(), "words")
    cut = F.explode(F.array(*(F.when(F.col("form").endswith(e) & (F.length("form") >= len(e) + 3), F.lit(len(e))) for e in _INFLECTED)))
    bases = words.select("form", cut.alias("cut")).where("cut is not null").select("form", F.expr("left(form, length(form) - cut)").alias("lemma"))
    found = bases.join(words.withColumnRenamed("form", "lemma"), "lemma").groupBy("form").agg(F.min_by("lemma", F.length("lemma")).alias("lemma"))
    return words.join(found, "form", "left").select("form", F.coalesce("lemma", "form").alias("lemma"))


_LEXICON_SQL = f"""
words AS (SELECT DISTINCT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+')) AS form FROM documents),
bases AS (SELECT form, left(form, length(form) - length(x)) AS base FROM words, (VALUES {", ".join(f"('{e}')" for e in _INFLECTED)}) e(x) WHERE ends_with(form, x) AND length(form) >= length(x) + 3),
found AS (SELECT form, min_by(base, length(base)) AS lemma FROM bases WHERE base IN (SELECT form FROM words) GROUP BY form),
lexicon AS (SELECT form, coalesce(lemma, form) AS lemma FROM words LEFT JOIN found USING (form)),
change AS (SELECT form, lemma, len(list_filter(range(1, least(length(form), length(lemma)) + 1), lambda i: left(form, i) = left(lemma, i))) AS common FROM lexicon WHERE NOT {_HELD}),
ends AS (SELECT form, length(form) - common AS cut, substr(lemma, common + 1) AS add, unnest(range(length(form) - common, least(length(form), {lemmas.MAX_SUFFIX}) + 1)) AS k FROM change),
taken AS (SELECT right(form, k) AS suffix, cut, add, count(*) AS n FROM ends GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY suffix ORDER BY n DESC, cut, add) AS r FROM taken) WHERE r = 1 AND n >= {lemmas.LEAST}),
shorter AS (SELECT suffix AS own, unnest(range(0, length(suffix))) AS k FROM best),
above AS (SELECT own, max_by(best.cut, k) AS cut, max_by(best.add, k) AS add FROM shorter JOIN best ON best.suffix = right(own, k) GROUP BY own),
rules AS (SELECT suffix, best.cut AS cut, best.add AS add, n FROM best LEFT JOIN above ON own = suffix WHERE best.cut <> coalesce(above.cut, 0) OR best.add <> coalesce(above.add, '')),
asked AS (SELECT form, unnest(range(0, least(length(form), {lemmas.MAX_SUFFIX}) + 1)) AS k FROM lexicon),
ruled AS (SELECT form, max_by(cut, k) AS cut, max_by(add, k) AS add FROM asked JOIN rules ON suffix = right(form, k) GROUP BY form),
guessed AS (SELECT lexicon.form AS form, lemma, coalesce(nullif(left(lexicon.form, length(lexicon.form) - cut) || add, ''), lexicon.form) AS guess FROM lexicon LEFT JOIN ruled ON ruled.form = lexicon.form)
"""


@query("lemma_rules", f"WITH {_LEXICON_SQL} SELECT suffix, CAST(cut AS INTEGER) AS cut, add, n FROM rules")
def lemma_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lemmas.fit(_lexicon(spark, sf_dir).where(f"not {_HELD}")).rules


@query("lemma_exceptions", f"WITH {_LEXICON_SQL} SELECT form, lemma FROM guessed WHERE guess <> lemma AND NOT {_HELD}")
def lemma_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lemmas.fit(_lexicon(spark, sf_dir).where(f"not {_HELD}")).exceptions


@query("lemma_held_out", f"WITH {_LEXICON_SQL} SELECT count(*) AS n, CAST(coalesce(sum(CAST(guess = lemma AS INTEGER)), 0) AS BIGINT) AS hits FROM guessed WHERE {_HELD}")
def lemma_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = stored(_lexicon(spark, sf_dir), "lexicon")
    return lemmas.accuracy(lemmas.fit(lexicon.where(f"not {_HELD}")), lexicon.where(_HELD))
