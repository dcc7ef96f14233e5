"""Links of many questions: no whole table of links passes the driver, no column or database gathers its links in one task."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from querent.operators import linking, skew
from querent.queries import QUERIES
from querent.sources.stored import stored
from tests.conftest import SF


@pytest.fixture(scope="module")
def tables(spark):
    """Questions, schema links, number links, cell links, columns and tables; links as stored, so that their files look small."""
    q = spark.createDataFrame([(i, "d", ["size", "of", "red", "part", "7"]) for i in range(40)] + [(40, "e", ["none"])], "idx long, db_id string, toks array<string>")
    columns = spark.createDataFrame([("d", 0, "part", 1, "size", "number"), ("d", 0, "part", 2, "red part", "text"), ("d", 1, "order", 3, "day", "time"), ("e", 0, "x", 1, "y", "text")], "db_id string, table_id int, table_name string, col_id int, display string, type string")
    names = spark.createDataFrame([("d", 0, "Part", "part"), ("d", 1, "Order", "order"), ("e", 0, "x", "x")], "db_id string, table_id int, table_name string, display string")
    cells = spark.createDataFrame([("d", 2, "red"), ("d", 3, "red day")], "db_id string, col_id int, value string")
    return q, stored(linking.name_links(q, columns, names), "links"), linking.number_links(q, columns), stored(linking.value_links(q, cells), "values"), columns, names, cells


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_masks_broadcast_no_links(tables):
    """links met their questions by a broadcast, as their stored files are small."""
    q, schema, numbers, values, *_ = tables
    q = stored(q, "questions")
    for f in (linking.masked_questions, linking.question_patterns):
        assert "BroadcastExchange" not in plan(f(q, schema, stored(numbers, "numbers"), values))
    got = {r["idx"]: r["masked"] for r in linking.masked_questions(q, schema, numbers, values).collect()}
    assert got == {i: "<mask> of <mask> <mask> <unk>" for i in range(40)} | {40: "none"}


def test_links_are_not_gathered_by_their_target(tables):
    """all links of a column, and all questions of a database, met the catalog in one task."""
    q, schema, _, values, columns, names, _ = tables
    found = linking.relevant_tables(q, schema, values, columns, names)
    assert not [x for x in plan(found).split("\n") if "hashpartitioning" in x and "target_id" in x.split("hashpartitioning")[1]]
    got = {r["idx"]: r["tables"] for r in found.collect()}
    assert got == {i: ["Part"] for i in range(40)} | {40: ["x"]}
    asked = q.select("idx", F.when(F.col("idx") < 3, "SELECT Order.day FROM part").otherwise("select 1 from Part").alias("query"))
    assert tuple(linking.relevant_table_quality(found, asked, names).first()) == (41, 3)


def test_name_links_need_no_shuffle_of_tokens(tables):
    """exact and partial links were merged by a shuffle and an aggregate over all tokens."""
    q, _, _, _, columns, names, _ = tables
    assert "hashpartitioning(idx" not in plan(linking.name_links(q, columns, names))


def test_questions_of_a_small_file_are_dealt_over_tasks(spark):
    """the task that read a row group of a small file made all links of its questions."""
    few = spark.range(2000).coalesce(1).select(F.col("id").alias("idx"))
    counts = skew.spread(few, "idx").groupBy(F.spark_partition_id()).count().collect()
    assert len(counts) >= 8 and max(r["count"] for r in counts) < 500
    for name in ("question_pattern", "question_masked", "link_names_merged", "link_values_number", "link_values_partial", "link_values_islands", "link_cell_antijoin"):
        assert "REPARTITION_BY_NUM" in plan(QUERIES[name](spark, SF)), name


def test_small_tables_leave_rows_in_their_tasks(spark, tables, monkeypatch):
    """questions, and their tokens that no more than 100,000 rows have, were counted and shuffled however small the table is that they met."""
    q, schema, _, values, columns, names, cells = tables
    links = lambda: (linking.name_links(q, columns, names), linking.number_links(q, columns))
    small = links()
    assert "hashpartitioning(db_id" not in plan(small[0]) + plan(small[1])
    by = spark.createDataFrame([("d", 1)], "db_id string, v int")
    assert "Broadcast" in plan(skew.measured_join(q, by, ["db_id"]))
    want = [sorted(map(tuple, x.collect())) for x in small]
    monkeypatch.setattr(skew, "SMALL", -1)
    assert [sorted(map(tuple, x.collect())) for x in links()] == want
    assert "Broadcast" not in plan(skew.measured_join(q, by, ["db_id"]))


def test_cell_links_stay_with_their_question(spark, tables):
    """names and cell links were shuffled by question and token, a row a link."""
    q, _, _, _, columns, names, cells = tables
    dealt = skew.spread(q, "idx")
    bare = linking.cells_without_names(linking.value_links(dealt, cells), linking.name_links(dealt, columns, names))
    exchanges = [x for x in plan(bare).split("\n") if "Exchange hashpartitioning(idx" in x]
    assert exchanges and all("REPARTITION_BY_NUM" in x for x in exchanges)
    schema = spark.createDataFrame([(0, 3, "col", 2, "CEM"), (0, 3, "tab", 0, "TPM"), (1, 2, "col", 2, "CPM")], "idx long, q_id int, kind string, target_id int, flag string")
    values = spark.createDataFrame([(i, "d", t, "cell", 2, "EXACTMATCH") for i in (0, 1, 2) for t in (2, 3)], "idx long, db_id string, q_id int, kind string, target_id int, flag string")
    got = linking.cells_without_names(values, schema)
    assert got.columns == values.columns and sorted((r["idx"], r["q_id"]) for r in got.collect()) == [(0, 2), (1, 3), (2, 2), (2, 3)]


def test_value_links_of_a_small_index_need_no_shuffle_of_tokens(spark, tables, monkeypatch):
    """F8: tokens were counted and shuffled to their index, and runs to their phrases, though both are small; a large index gives the same."""
    q, *_, cells = tables
    links = linking.value_links(q, cells)
    assert "hashpartitioning(db_id" not in plan(links)
    want = sorted(map(tuple, links.collect()))
    assert len(want) == 80
    monkeypatch.setattr(skew, "SMALL", -1)
    for hot, least in ((10_000, 100_000), (20, 10)):
        monkeypatch.setattr(skew, "HOT", hot)
        monkeypatch.setattr(skew, "LEAST", least)
        large = linking.value_links(q, cells)
        assert "hashpartitioning(db_id" in plan(large) and sorted(map(tuple, large.collect())) == want
