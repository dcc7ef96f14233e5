"""Readers, writers, the model client, the two-pass pipeline and the resumable stream."""

from __future__ import annotations

import json
import sqlite3

import pytest

from querent import fixtures as X
from querent.operators import voting
from querent.plans import pipeline
from querent.plans.llm_client import Answers, Replay, ask
from querent.sources import catalog, files, sinks, sqlite
from querent.streaming.resume import answer_stream


def test_tables_json(spark, tmp_path):
    entry = {
        "db_id": "d", "table_names": ["one", "two"], "table_names_original": ["One", "Two"],
        "column_names": [[-1, "*"], [0, "id"], [0, "name"], [1, "id"], [1, "one id"]], "column_names_original": [[-1, "*"], [0, "Id"], [0, "Name"], [1, "Id"], [1, "OneId"]],
        "column_types": ["text", "number", "text", "number", "number"], "primary_keys": [1, [3, 4]], "foreign_keys": [[4, 1]],
    }
    (tmp_path / "tables.json").write_text(json.dumps([entry]))
    c = catalog.read_tables_json(spark, str(tmp_path / "tables.json"))
    assert [(r["col_id"], r["column_name"], r["pk"]) for r in c.columns.orderBy("col_id").collect()] == [(1, "Id", 1), (2, "Name", 0), (3, "Id", 1), (4, "OneId", 2)]
    assert [r["text"] for r in catalog.foreign_key_pairs(c.foreign_keys).collect()] == ["(Two.OneId, One.Id)"]
    p = catalog.preprocessed(c).first()
    assert p["table_bounds"] == [1, 3, 5] and p["primary_keys"] == [1, 3, 4] and p["foreign_keys_tables"] == {1: [0]}


def test_lines_and_positions(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x \n\ny\n")
    (tmp_path / "b.jsonl").write_text('{"db_id": "d"}\n\n{"db_id": "e"}\n')
    (tmp_path / "c.json").write_text("[4, 0]")
    assert [(r["idx"], r["value"]) for r in files.lines(spark, str(tmp_path / "a.txt")).collect()] == [(0, "x"), (1, ""), (2, "y")]
    assert [(r["idx"], r["db_id"]) for r in files.json_lines(spark, str(tmp_path / "b.jsonl"), "struct<db_id:string>").collect()] == [(0, "d"), (1, "e")]
    assert files.json_lines(spark, str(tmp_path / "none"), "struct<a:int>") is None
    assert [(r["place"], r["idx"]) for r in files.positions(spark, str(tmp_path / "c.json")).collect()] == [(0, 4), (1, 0)]


def test_task_round_trip(spark, tmp_path):
    prompts = spark.createDataFrame([(1, 5, "p1", "r1", 0, "d"), (0, 6, "p0", "r0", 1, "e")], "idx long, prompt_tokens long, prompt string, response string, n_examples int, db_id string")
    sinks.write_task(prompts, {"k": "1"}, {"gpt-4": 0.5}, str(tmp_path / "t"))
    back = files.task(spark, str(tmp_path / "t")).orderBy("idx").collect()
    assert [(r["idx"], r["prompt"], r["db_id"]) for r in back] == [(0, "p0", "e"), (1, "p1", "d")]


def test_linking_round_trip(spark, tmp_path):
    q = spark.createDataFrame([(0, "d", ["a", "b"]), (1, "d", ["c"])], "idx long, db_id string, toks array<string>")
    links = spark.createDataFrame([(0, "d", 0, "col", 3, "CEM"), (0, "d", 1, "cell", 2, "EXACTMATCH")], "idx long, db_id string, q_id int, kind string, target_id int, flag string")
    sinks.write_json_lines(sinks.linking_records(q, links).coalesce(1), str(tmp_path / "l"))
    path = next(str(p) for p in (tmp_path / "l").glob("part-*"))
    back = files.links(files.json_lines(spark, path, files.LINKING))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, links.collect()))


def test_export(spark, tmp_path):
    p = spark.createDataFrame([(0, "SELECT 1 /* x"), (1, "SELECT 2")], "idx long, sql string")
    r = spark.createDataFrame([(0, 10, "d"), (1, 11, "e")], "idx long, question_id long, db_id string")
    sinks.write_export(p, r, str(tmp_path / "e"))
    assert json.loads((tmp_path / "e" / "part-00000").read_text()) == {"10": "SELECT 1 \t----- bird -----\td", "11": "SELECT 2\t----- bird -----\te"}


def test_sqlite(spark, tmp_path):
    (tmp_path / "d").mkdir()
    con = sqlite3.connect(tmp_path / "d" / "d.sqlite")
    con.executescript("CREATE TABLE a (id INTEGER PRIMARY KEY, name TEXT); CREATE TABLE b (id INT, a_id INT REFERENCES a); INSERT INTO a VALUES (1, 'x'), (2, NULL); INSERT INTO b VALUES (5, 1);")
    con.commit()
    con.close()
    found = sqlite.databases(str(tmp_path))
    c = sqlite.catalog(spark, found)
    assert [r["pair"] for r in catalog.foreign_key_pairs(c.foreign_keys).collect()] == ["b.a_id=a.id"]
    assert c.tables.where("table_name = 'b'").first()["ddl"] == "CREATE TABLE b (id INT, a_id INT REFERENCES a)"
    assert ("d", 2, "x") in {tuple(r) for r in sqlite.cells(spark, found, c).collect()}
    sqlite.register(spark, found[0][1])
    rows = spark.createDataFrame([("d", "SELECT count(*) FROM a"), ("d", "SELECT id + 1 FROM a WHERE id = 1"), ("d", "INSERT INTO a VALUES (1)"), ("d", "SELECT 1; SELECT 2")], "db_id string, sql string")
    status = {r["sql"]: (r["status"], r["fingerprint"]) for r in voting.execute(spark, rows).collect()}
    first, second = status["SELECT count(*) FROM a"], status["SELECT id + 1 FROM a WHERE id = 1"]
    assert first[0] == "ok" and first == second
    assert status["INSERT INTO a VALUES (1)"][0] == "refused"
    assert status["SELECT 1; SELECT 2"][0] == "ok"  # only the first statement is kept


class Failing:
    def __call__(self):
        def answer(prompts, n, temperature):
            if "bad" in prompts[0]:
                raise RuntimeError("no")
            return Answers([[p.upper()] for p in prompts], 3)

        return answer


def test_failed_prompts_become_statuses(spark):
    prompts = spark.createDataFrame([(0, "d", "ok"), (1, "d", "bad")], "idx long, db_id string, prompt string")
    got = {r["idx"]: r for r in ask(prompts, Failing(), retries=1, pause_s=0).collect()}
    assert got[0]["p_sqls"] == ["OK"] and got[0]["status"] == "ok"
    assert got[1]["p_sqls"] == [] and got[1]["status"].startswith("error: RuntimeError")


def test_two_passes(spark):
    from pyspark.sql import functions as F

    from tests.conftest import SF

    vectors = X.vectors(spark, SF).where("idx < 40").withColumn("db_id", F.when(F.col("idx") % 3 == 0, X.WEB).otherwise(X.DB)).drop("skeleton", "pre_skeleton")
    config = pipeline.Config(layout="TEXT", shots=2, n=3)
    client = Replay(default=("SELECT 1", "SELECT 1.0", "SELECT 2"))
    got = pipeline.run(vectors.where("idx < 4"), vectors.where("idx >= 4"), X.catalog(spark), client, config, lambda c: voting.execute(spark, c)).collect()
    assert sorted(r["idx"] for r in got) == [0, 1, 2, 3]
    assert {r["sql"] for r in got} <= {"SELECT 1", "SELECT 1.0"}


@pytest.mark.parametrize("n", [1, 3])
def test_every_prompt_is_paid_once_a_pass(spark, tmp_path, n):
    from pyspark.sql import functions as F

    from tests.conftest import SF

    vectors = X.vectors(spark, SF).where("idx < 60").withColumn("db_id", F.when(F.col("idx") % 3 == 0, X.WEB).otherwise(X.DB)).drop("skeleton", "pre_skeleton")
    calls = tmp_path / "calls"
    calls.mkdir()
    got = pipeline.run(vectors.where("idx < 20"), vectors.where("idx >= 20"), X.catalog(spark), Counting(str(calls)), pipeline.Config(layout="TEXT", shots=2, n=n), lambda c: voting.execute(spark, c))
    assert got.count() == 20 and len(got.collect()) == 20
    assert len(list(calls.iterdir())) == 20 * 2


class Counting:
    """Leaves a file for every prompt that it is asked."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self):
        import os
        import uuid

        def answer(prompts, n, temperature):
            for _ in prompts:
                open(os.path.join(self.folder, uuid.uuid4().hex), "w").close()
            return Answers([[f"SELECT {len(p) % 3}"] * n for p in prompts], 1)

        return answer


def test_resumed_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"idx": 0, "db_id": "d", "prompt": "p"}\n{"idx": 1, "db_id": "d", "prompt": "q"}\n')

    def run():
        answer_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"), lambda df: df.selectExpr("idx", "upper(prompt) AS sql")).awaitTermination()
        return sorted((r["idx"], r["sql"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [(0, "P"), (1, "Q")]
    (src / "b.json").write_text('{"idx": 1, "db_id": "d", "prompt": "again"}\n{"idx": 2, "db_id": "d", "prompt": "r"}\n')
    assert run() == [(0, "P"), (1, "Q"), (2, "R")]


@pytest.mark.parametrize("shots, want", [(0, "TEXT_0-SHOT_CTX-4096_ANS-200"), (2, "TEXT_2-SHOT_S_QA-EXAMPLE_CTX-4096_ANS-200")])
def test_run_name(shots, want):
    assert sinks.run_name("TEXT", shots, "S", "QA", 4096, 200) == want
